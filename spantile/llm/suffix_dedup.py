"""Suffix-array dedup: a common-prefix-aware distributed merge sort over sparse suffixes.

A byte goes where a string of LENGTH bytes covers it that also starts anywhere else.  Not every suffix has to be sorted
for that: each string of LENGTH bytes picks an anchor, the K-byte inner string with the smallest hash, so two equal
strings pick the same anchor at the same place, and neighbouring strings mostly share theirs.  The suffixes at anchors
are the sparse suffix array:

1. Texts are packed into blocks, a table in the shared folder.  Blocks send one row for each distinct anchor and its
   context (the anchor with all bytes that its strings cover), both as hashes; anchors that one block has in one context
   end here.
2. Each block sorts the suffixes of the contexts that are left, one copy of each, and sends the run, front-coded: for
   each suffix the length of the prefix it shares with the one before, and the rest.  Runs are cut at splitters into ranges.
3. Each range merges its runs with a loser tree that carries common-prefix lengths: bytes that two suffixes are known to
   share are never compared again.  In the merged order a class is a stretch of suffixes that share the anchor's K bytes;
   contexts that are equal there, byte for byte, repeat as a whole, and of the different ones strings are compared whole,
   those alone that the common prefixes leave possible.
4. Blocks blot out what has been found, and what stands twice in themselves.

Hashes choose what is sorted; bytes decide what goes.  A group of copies costs one context for each block that has it, and
no pairs are made.  A class is one range's work: copies are one dictionary entry each there, but an anchor in very many
*different* surroundings makes a list of as many.

Defined cases: a null text is empty; texts shorter than LENGTH keep all; rows that repeat are copies of each other; a
null doc_id is kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, documents, partitions, written

LENGTH = 200
#: Inner strings of which each string of LENGTH bytes picks one.
INNER = 100
#: Bytes of text in a block, about, and bytes that are hashed at once.
BLOCK_BYTES, SEGMENT = 4_000_000, 1 << 18
#: Blocks whose sorted suffixes, all of them together, one task may merge.
RANGE_BLOCKS = 8
#: Documents whose text decides where the sorted order is cut into ranges: for balance alone.
SAMPLE_DOCS = 1_000
_B1, _B2, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, np.uint64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- blocks


def blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks: block, ids, sizes, data (compressed bytes of all texts)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        ids, texts, held = [], [], 0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"block": [(task << 24) + number], "ids": [ids], "sizes": [[len(t) for t in texts]], "data": [squeeze.compress(b"".join(texts))]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                texts.append(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield done()
                    ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield done()

    return docs.select("doc_id", "text").mapInPandas(pack, "block long, ids array<long>, sizes array<int>, data binary")


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(data)) if data else b""


# ---------------------------------------------------------------- anchors


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        a = np.full(n, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _sums(data: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _powers(base, SEGMENT + 2 * LENGTH)[0][: len(data)], dtype=np.uint64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Anchors:
    """The anchors of a block: hash h, context hash c, place, first of their strings and how many."""

    def __init__(self, text: bytes, sizes: list[int], length: int = LENGTH, inner: int = INNER) -> None:
        self.k = length - inner + 1
        sizes = np.asarray(sizes, dtype=np.int64)
        self.ends = np.cumsum(sizes)
        found = [self._segment(text, at, length, inner) for at in range(0, max(0, len(text) - length + 1), SEGMENT)]
        empty = (np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        self.h, self.c, self.place, self.first, self.count = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty

    def _segment(self, text: bytes, at: int, length: int, inner: int) -> tuple:
        n, k = min(SEGMENT, len(text) - length + 1 - at), self.k
        data = np.frombuffer(text, dtype=np.uint8, count=n + length - 1, offset=at).astype(np.uint64) + np.uint64(1)
        back = _powers(_B1, SEGMENT + 2 * LENGTH)[1]
        sums = _sums(data, _B1)
        h = _mixed((sums[k:] - sums[:-k]) * back[: len(data) - k + 1])
        mask = np.uint64((1 << (SEGMENT + 2 * LENGTH).bit_length()) - 1)
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= inner:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < inner:
            low = np.minimum(low[: width - inner], low[inner - width :])
        place = (low & mask).astype(np.int64)
        start = np.arange(n)
        doc = np.searchsorted(self.ends, start + at, side="right")
        inside = start + at + length <= self.ends[doc]
        place, start, doc = place[inside], start[inside], doc[inside]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))) if len(place) else np.empty(0, np.int64)
        count, place, first = np.diff(np.append(new, len(place))), place[new], start[new]
        sums = _sums(data, _B2)
        c = (sums[first + count - 1 + length] - sums[first]) * _powers(_B2, SEGMENT + 2 * LENGTH)[1][first]
        c = _mixed(_mixed(c) ^ ((place - first) * 4096 + count).astype(np.uint64))
        return h[place], c, place + at, first + at, count

    def local(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct context: its first anchor and number of anchors; and for all anchors their context, and whether contexts share a class."""
        order = np.lexsort((np.arange(len(self.h)), self.c, self.h))
        h, c = self.h[order], self.c[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.empty(0, bool)
        context = np.empty(len(h), np.int64)
        context[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        own = h[at]
        shared = np.zeros(len(at), bool)
        if len(at) > 1:
            same = own[1:] == own[:-1]
            shared[1:] |= same
            shared[:-1] |= same
        return order[at], np.diff(np.append(at, len(h))), context, shared


def _asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each distinct anchor of a block; for each context of it where the block has several."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            a = Anchors(unpacked(r.data), r.sizes)
            first, _, _, several = a.local()
            yield pd.DataFrame({"h": a.h[first].view(np.int64), "c": a.c[first].view(np.int64), "block": r.block, "at": first, "several": several})


def open_contexts(packed: DataFrame) -> DataFrame:
    """block, at: the contexts whose anchor another block has, or the same block in another context."""
    by_class = Window.partitionBy("h")
    rows = packed.mapInPandas(_asking, "h long, c long, block long, at long, several boolean")
    return rows.withColumn("rows", F.count(F.lit(1)).over(by_class)).where("rows > 1").select("block", "at")


# ---------------------------------------------------------------- runs


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes two strings share at their start; ``known`` of them are known to."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 8:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while low < high and a[low] == b[low]:
        low += 1
    return low


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For each string of a sorted run what it shares with the one before, and the rest."""
    lcps = [0, *(shared_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False))][: len(strings)]
    return lcps, [s[n:] for s, n in zip(strings, lcps, strict=True)]


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merges front-coded runs: (what the string shares with the one before, run, place in the run, string).

    A loser tree over the runs' heads.  Each head carries the length of the prefix that it shares with the last string
    that left its path.  Of two heads, the one that shares more with that string is the smaller; only where they share
    the same do bytes decide, and those from there on.
    """
    n = max(1, len(runs))
    size = 1 << (n - 1).bit_length()
    heads: list[bytes | None] = [None] * size
    lcps, places = [0] * size, [0] * size
    for i, (_, rests) in enumerate(runs):
        if rests:
            heads[i] = rests[0]
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's length becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        common = shared_prefix(x, y, lcps[a])
        win, lose = (a, b) if x[common:] < y[common:] or x[common:] == y[common:] and a < b else (b, a)
        lcps[lose] = common
        return win, lose

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        yield lcps[top], top, places[top], heads[top]
        shared, rests = runs[top]
        places[top] += 1
        if places[top] < len(rests):
            lcps[top] = shared[places[top]]
            heads[top] = heads[top][: lcps[top]] + rests[places[top]]
        else:
            heads[top] = None
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def _runs(splitters: list[bytes]):
    """Sorted, front-coded suffixes of a block's contexts, by range."""

    def make(packed: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "block", "lcps", "rests", "lefts", "first", "count"]
        if not len(packed) or not len(told):
            return pd.DataFrame(columns=columns)
        row = packed.iloc[0]
        text = unpacked(row["data"])
        a = Anchors(text, row["sizes"])
        at = told["at"].to_numpy()
        entries = sorted((text[p : f + n - 1 + LENGTH], text[f:p], f, n) for p, f, n in zip(a.place[at].tolist(), a.first[at].tolist(), a.count[at].tolist(), strict=True))
        rows, low = [], 0
        suffixes = [e[0] for e in entries]
        from bisect import bisect_left

        for part in range(len(splitters) + 1):
            high = bisect_left(suffixes, splitters[part], low) if part < len(splitters) else len(suffixes)
            if high > low:
                lcps, rests = front_coded(suffixes[low:high])
                own = entries[low:high]
                rows.append((part, int(row["block"]), lcps, rests, [e[1] for e in own], [e[2] for e in own], [e[3] for e in own]))
            low = high
        out = pd.DataFrame(rows, columns=columns)
        for c in ("rests", "lefts"):
            out[f"{c}_n"] = [[len(x) for x in r] for r in out[c]]
            out[c] = [b"".join(r) for r in out[c]]
        squeeze = zstandard.ZstdCompressor(level=3)
        out["data"] = [squeeze.compress(np.array([len(r.lcps)], np.int32).tobytes() + np.array([r.lcps, r.rests_n, r.lefts_n, r.first, r.count], dtype=np.int32).tobytes() + r.rests + r.lefts) for r in out.itertuples(index=False)]
        return out[["part", "block", "data"]]

    def checked(packed: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = make(packed, told)
        return out[["part", "block", "data"]] if len(out) else pd.DataFrame({"part": [], "block": [], "data": []})

    return checked


def _split(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _read_run(data: bytes) -> tuple[list[int], list[bytes], list[bytes], list[int], list[int]]:
    data = unpacked(data)
    n = int(np.frombuffer(data, np.int32, 1)[0])
    lcps, rests_n, lefts_n, first, count = np.frombuffer(data, np.int32, 5 * n, 4).reshape(5, n)
    at = 4 + 20 * n
    mid = at + int(rests_n.sum())
    return lcps.tolist(), _split(data[at:mid], rests_n), _split(data[mid:], lefts_n), first.tolist(), count.tolist()


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    """Merges the runs of a range; block, begin and end of what is repeated."""
    runs = [_read_run(d) for d in part["data"]]
    owners = part["block"].tolist()
    found: dict[int, list[tuple[int, int]]] = {}
    k = LENGTH - INNER + 1
    group: list[tuple[bytes, bytes, int, int, int]] = []
    shared: list[int] = []

    def settle() -> None:
        """Finds equal contexts and equal strings within a class.  shared[i]: what member i shares with the one before."""
        nonlocal group, shared
        # equal contexts repeat as a whole; one of them stays, to be held against the others
        met: dict[tuple[bytes, bytes, int], int] = {}
        own: list[tuple[bytes, bytes, int, int, int]] = []
        own_shared: list[int] = []
        link = LENGTH * 2
        for member, common in zip(group, shared, strict=True):
            suffix, left, block, first, count = member
            link = min(link, common) if own else 0
            before = met.get((suffix, left, count))
            if before is None:
                met[(suffix, left, count)] = len(own)
                own.append(member)
                own_shared.append(link)
                link = LENGTH * 2
                continue
            found.setdefault(block, []).append((first, first + count - 1 + LENGTH))
            if before >= 0:
                _, _, block, first, count = own[before]
                found.setdefault(block, []).append((first, first + count - 1 + LENGTH))
                met[(suffix, left, count)] = -1
        group, shared = own, own_shared
        if len(group) < 2:
            return
        reach = [max(shared[i] if i else 0, shared[i + 1] if i + 1 < len(group) else 0) for i in range(len(group))]
        by_offset: dict[int, list[int]] = {}
        for i, (_, left, _, _, count) in enumerate(group):
            # strings begin len(left) .. len(left) - count + 1 bytes before the anchor, and need the rest of LENGTH bytes after it
            for ahead in range(max(len(left) - count + 1, LENGTH - reach[i]), len(left) + 1):
                by_offset.setdefault(ahead, []).append(i)
        for ahead, members in by_offset.items():
            seen: dict[bytes, int] = {}
            for i in members:
                suffix, left, block, first, _ = group[i]
                string = left[len(left) - ahead :] + suffix[: LENGTH - ahead]
                before = seen.get(string)
                at = first + len(left) - ahead
                if before is None:
                    seen[string] = i
                    continue
                found.setdefault(block, []).append((at, at + LENGTH))
                if before >= 0:
                    _, left, block, first, _ = group[before]
                    at = first + len(left) - ahead
                    found.setdefault(block, []).append((at, at + LENGTH))
                    seen[string] = -1

    for lcp, run, place, suffix in merge([(r[0], r[1]) for r in runs]):
        if lcp < k and group:
            if len(group) > 1:
                settle()
            group, shared = [], []
        _, _, lefts, first, count = runs[run]
        group.append((suffix, lefts[place], owners[run], first[place], count[place]))
        shared.append(lcp)
    if len(group) > 1:
        settle()
    rows = []
    for block, spans in found.items():
        spans = joined(np.array(spans, dtype=np.int64))
        rows.append((block, spans.tobytes()))
    return pd.DataFrame(rows, columns=["block", "spans"])


def joined(spans: np.ndarray) -> np.ndarray:
    """The union of spans, as sorted spans that do not touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[new, 0], reach[np.append(new[1:] - 1, len(spans) - 1)]), 1)


# ---------------------------------------------------------------- result


def _kept(packed: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Each text's kept bytes and removed spans, from what stands twice in the block and the spans of the merge."""
    columns = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    if not len(packed):
        return pd.DataFrame(columns=columns)
    row = packed.iloc[0]
    text, sizes = unpacked(row["data"]), np.asarray(row["sizes"], dtype=np.int64)
    a = Anchors(text, sizes)
    begin, end = a.first, a.first + a.count - 1 + LENGTH
    first, n, context, _ = a.local()
    twice = n[context] >= 2 if len(context) else np.empty(0, bool)
    # a context that is only hashed like the block's first of it is none
    model = first[context[twice]]
    same = [text[i:j] == text[k:m] for i, j, k, m in zip(begin[twice].tolist(), end[twice].tolist(), begin[model].tolist(), end[model].tolist(), strict=True)]
    own = np.flatnonzero(twice)[np.array(same, dtype=bool)]
    spans = [np.stack((begin[own], end[own]), 1)]
    spans += [np.frombuffer(s, np.int64).reshape(-1, 2) for s in told["spans"] if s is not None]
    change = np.zeros(len(text) + 1, dtype=np.int32)
    for s in spans:
        np.add.at(change, s[:, 0], 1)
        np.add.at(change, s[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    data, rows, at = np.frombuffer(text, np.uint8), [], 0
    for doc_id, size in zip(row["ids"], sizes.tolist(), strict=True):
        mark = gone[at : at + size]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
        rows.append((doc_id, size, int(mark.sum()), edges.tolist(), data[at : at + size][~mark].tobytes()))
        at += size
    return pd.DataFrame(rows, columns=columns)


def splitters(docs: DataFrame, ranges: int) -> list[bytes]:
    """Where the sorted order is cut, from a bounded sample of texts."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    # an id that repeats gives as many rows as any other
    heads = docs.join(F.broadcast(ids), "doc_id").select(F.substring("text", 1, 1_000).alias("t")).where("length(t) >= 16")
    rows = heads.distinct().orderBy(F.xxhash64("t"), "t").limit(4 * SAMPLE_DOCS).collect()
    starts = sorted(r["t"].encode()[i : i + 12] for r in rows for i in range(0, len(r["t"].encode()) - 12, 37))
    return sorted({starts[len(starts) * i // ranges] for i in range(1, ranges)}) if starts else []


def repeats(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each row's doc_id, n_bytes, n_removed, spans (begin, end, begin, end ...) and kept bytes."""
    spark = docs.sparkSession
    packed = written(blocks(docs))
    # a range merges what RANGE_BLOCKS blocks have at most, if their borders are spread evenly
    cuts = splitters(docs, ranges or max(4 * partitions(spark), -(-packed.count() // RANGE_BLOCKS)))
    told = written(open_contexts(packed))
    # one row a block on either side; a block's anchors bound what it is told
    runs = packed.select("block", "sizes", "data").groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_runs(cuts), "part int, block long, data binary")
    spans = runs.groupBy("part").applyInPandas(_merged, "block long, spans binary")
    return packed.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(_kept, "doc_id long, n_bytes long, n_removed long, spans array<int>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 1_000)
    out = repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT id, i, hash(substr(h, 2 * i + 1, 2 * {LENGTH})) AS s
  FROM (SELECT id, h, unnest(range(0, length(h) // 2 - {LENGTH} + 1)) AS i FROM texts)),
repeated AS (
  SELECT id, i FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
islands AS (
  SELECT id, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS span
  FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS before FROM repeated)),
spans AS (SELECT id, span, min(i) AS low, max(i) + {LENGTH} AS high FROM islands GROUP BY id, span),
parts AS (
  SELECT id, low, high, coalesce(lag(high) OVER (PARTITION BY id ORDER BY low), 0) AS kept_from FROM spans),
kept AS (
  SELECT id, count(*) AS n_spans, sum(high - low) AS n_removed,
         string_agg(substr(h, 2 * kept_from + 1, 2 * (low - kept_from)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS h
  FROM parts JOIN texts USING (id) GROUP BY id)
SELECT doc_id, length(texts.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, texts.h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (id)
"""
