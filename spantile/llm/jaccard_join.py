"""N-gram Jaccard join: size-aware heavy-light join on word shingles.

Two documents link when 100 * |both| >= PERCENT * |either| of their shingle sets; the result is each document's set
size and component.  Equal sets are one set from the start, so copies cost one row each and never a pair.

Light sets (few shingles) enumerate subsets: for sizes s <= t that may link, every subset of the least overlap c(s, t);
sets that share one link without further check.  Heavy sets scan inverted lists of the shingles of their prefix: the
n - ceil(PERCENT n / 100) + 1 rarest ones, of which two linked sets share one at least.  The boundary is the size at
which subsets stop being cheaper, by the numbers of keys that all documents of each size would make.  Rarity comes from
counters over the shingles of all documents; it decides what is fast, not what is found.

Lists are worked off in two rounds.  First each set is verified against one pivot, the smallest set of the lists that it
shares most of; what links is joined into components, and lists that lie in one component are done.  So a group of near
copies costs about one verified pair for each member.  Then the lists that are left are scanned: their members' odd
sketches, whose distance never exceeds that of the sets, are compared, and only pairs of different components that may
link by them are verified.  Each set's nearest partners go first, and what they join need not be met again.  Every pair of different components that shares a list is met; none is made a row before.

Defined cases: null and empty texts have no shingles and link with nothing (component_id is the doc_id); fewer words
than K make one shingle; rows that repeat give their result as often; a null doc_id is never the smallest of a component
that has another; of a component of null ids alone component_id is null.  Shingles and sets are compared by 64-bit
hashes, subsets by 128 bits.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, cut, documents, summed, whole, written

K, PERCENT = 4, 85
#: Largest size for which subsets are considered at all.
LIGHT_MOST = 32
#: What meeting and verifying a list's members costs, in keys, for each key of a prefix.
SCAN_COST = 4
#: Bits of a counter's number: so many that there are four counters for each document, within these bounds.
LEAST_BITS, MOST_BITS, COUNTER_PARTS = 20, 22, 64
#: Lists that may be longer than this, by the counters, are not sorted in one task.
LONG_LIST = 50_000
SKETCH = 1024
#: Members of a list that are compared with each other at once; longer lists are split by size first.
LIST_BLOCK = 1_000
PAIRS_AT_ONCE = 200_000
#: Scans: one list of so many, and which of a set's partners that may link, from the nearest on; the last takes all that are left.
ROUNDS = ((8, (0, 1)), (1, (0, 3)), (1, (3, None)))
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 19
_BASE, _FACTOR = 0xC2B2AE3D27D4EB4F, np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(n, b, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTOR
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and the text it is from.  Words are what white space leaves, A-Z lower-cased."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), dtype=np.uint8)
    space = np.concatenate(([True], (data == 32) | (data >= 9) & (data <= 13)))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    power, back = _powers(1 << max(16, len(data).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return _mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)), np.searchsorted(begins, start, side="right") - 1


def shingle_sets(texts: list[str | None], k: int = K) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of all runs of k words; of all words if they are fewer."""
    out, part, held = [], [], 0
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for i, t in enumerate(coded):
        part.append(t)
        held += len(t)
        if held >= AT_ONCE or i == len(coded) - 1:
            h, of = word_hashes(part)
            ends = np.searchsorted(of, np.arange(len(part) + 1))
            runs = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
            for j in range(k):
                runs = _mixed(runs ^ h[j : j + len(runs)])
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if b - a >= k:
                    out.append(np.unique(runs[a : b - k + 1]))
                else:
                    few = np.full(1, b - a, dtype=np.uint64)
                    for x in h[a:b]:
                        few = _mixed(few ^ x)
                    out.append(few[: b > a])
            part, held = [], 0
    return out


def links(both: int, n: int, m: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def least_overlap(s: int, t: int, percent: int) -> int:
    return -(-percent * (s + t) // (100 + percent))


def size_pairs(n: int, percent: int) -> list[tuple[int, int]]:
    """The pairs of sizes (s <= t) that may link and of which n is one."""
    return [(s, n) for s in range(-(-percent * n // 100), n)] + [(n, t) for t in range(n, 100 * n // percent + 1)]


def subsets_of(n: int, percent: int) -> int:
    return sum(comb(n, least_overlap(s, t, percent)) for s, t in size_pairs(n, percent))


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size whose sets enumerate subsets, by what both ways cost over all documents."""
    cost, best, most = 0, 0, 0
    for n in range(1, LIGHT_MOST + 1):
        cost += sizes.get(n, 0) * (prefix(n, percent) * SCAN_COST - subsets_of(n, percent))
        if cost >= most and subsets_of(n, percent) <= 4_000:
            best, most = n, cost
    return best


def counted(docs: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int]]:
    """Counters of all shingles by hash, as powers of two, and how many documents have each small size."""

    bits = min(MOST_BITS, max(LEAST_BITS, (4 * docs.count()).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sizes = np.zeros(1 << bits, dtype=np.int64), np.zeros(LIGHT_MOST + 1, dtype=np.int64)
        for batch in batches:
            for found in shingle_sets(batch["text"].tolist(), k):
                np.add.at(held, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
                if len(found) <= LIGHT_MOST:
                    sizes[len(found)] += 1
        squeeze = zstandard.ZstdCompressor(level=1)
        yield pd.DataFrame({"part": [*range(COUNTER_PARTS), -1], "held": [squeeze.compress(x.tobytes()) for x in (*np.split(held, COUNTER_PARTS), sizes)]})

    def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the driver gets one byte for each counter
        for batch in batches:
            totals = [np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), dtype=np.int64) for b in batch["held"]]
            yield batch.assign(held=[x.tobytes() if p < 0 else coded(x).tobytes() for p, x in zip(batch["part"], totals, strict=True)])

    rows = summed(docs.select("text").mapInPandas(count, "part int, held binary"), "int64").mapInPandas(small, "part int, held binary").collect()
    if not rows:
        return np.zeros(1 << bits, dtype=np.uint8), {}
    parts = {r["part"]: bytes(r["held"]) for r in rows}
    return np.frombuffer(b"".join(parts[i] for i in range(COUNTER_PARTS)), dtype=np.uint8), dict(enumerate(np.frombuffer(parts[-1], dtype=np.int64).tolist()))


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts as eighths of powers of two, in one byte; those beyond 2 ** 31 are all alike."""
    return np.minimum(255, np.ceil(8 * np.log2(1 + counts))).astype(np.uint8)


def _sketch(found: np.ndarray) -> list[int]:
    odd = np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def sets(docs: DataFrame, counters: np.ndarray, light: int, k: int, percent: int) -> DataFrame:
    """doc_id, row (the text's hash), n, kid (the set's hash), sketch, heavy and long keys (prefix shingles), light keys (two hashes) and their small sizes."""
    handed = docs.sparkSession.sparkContext.broadcast(counters)
    shift = np.uint64(65 - len(counters).bit_length())
    # where counters are full of rare shingles, only what stands out by a factor of two is long
    hot = max(int(coded(np.array(LONG_LIST))), int(np.median(counters)) + 8)

    def one(found: np.ndarray, weight: np.ndarray, met: set[int]) -> tuple:
        n = len(found)
        if not n:
            return 0, None, None, [], [], [], [], []
        kid = xxhash.xxh64_intdigest(found.tobytes())
        if kid in met:
            return n, kid, None, [], [], [], [], []
        met.add(kid)
        heavy = long = found[:0]
        keys, small = [], []
        if n <= light:
            for s, t in size_pairs(n, percent):
                if t > light:
                    continue
                head = np.array([s, t], dtype=np.uint64).tobytes()
                for part in combinations(found.tolist(), least_overlap(s, t, percent)):
                    keys.append(xxhash.xxh128_digest(head + np.array(part, dtype=np.uint64).tobytes()))
                    small.append(s)
        if 100 * n // percent > light:
            rarity = weight[(found >> shift).astype(np.int64)]
            first = np.lexsort((found, rarity))[: prefix(n, percent)]
            heavy, long = found[first[rarity[first] < hot]], found[first[rarity[first] >= hot]]
        both = np.frombuffer(b"".join(keys), dtype=np.int64)
        return n, kid, _sketch(found), heavy.view(np.int64), long.view(np.int64), both[::2], both[1::2], small

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # copies within a task make their keys once
        weight, met = handed.value, set()
        for batch in batches:
            rows = [one(found, weight, met) for found in shingle_sets(batch["text"].tolist(), k)]
            kid = pd.array([None if r[1] is None else r[1] - (1 << 64) if r[1] >> 63 else r[1] for r in rows], dtype="Int64")
            out = pd.DataFrame([(r[0], *r[2:]) for r in rows], columns=["n", "sketch", "heavy", "long", "light", "light2", "small"])
            yield out.assign(row=batch["row"], doc_id=batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), kid=kid)

    schema = "n long, kid long, sketch array<long>, heavy array<long>, long array<long>, light array<long>, light2 array<long>, small array<int>, row long, doc_id long"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInPandas(make, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and its component (the smallest node that it reaches), for the nodes of edges (a, b)."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        # stars whose edges stay as they are
        same = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        if edges.agg(F.count(F.lit(1)), same).first() == after.agg(F.count(F.lit(1)), same).first():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = after


def _verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of sets that link.  owners: for each set a document (doc_id, row) that has it."""
    one = sketches.select(F.col("kid").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    two = sketches.select(F.col("kid").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    near = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = pairs.join(one, "a").join(two, "b").where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))
    likely = written(likely.where(near * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b"))
    wanted = owners.join(likely.select(F.col("a").alias("kid")).union(likely.select("b")).distinct(), "kid", "left_semi")
    wanted = wanted.select("kid", F.col("doc_id").alias("of"), F.col("row").alias("at"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("at")))
    texts = written(texts.select("kid", "text"))
    held = likely.join(texts.select(F.col("kid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("kid").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            firsts = shingle_sets(batch["text_a"].tolist(), k)
            others = dict(zip(batch["b"], batch["text_b"], strict=True))
            others = dict(zip(others, shingle_sets(list(others.values()), k), strict=True))
            keep = []
            for own, b in zip(firsts, batch["b"], strict=True):
                both = len(np.intersect1d(own, others[b], assume_unique=True))
                keep.append(links(both, len(own), len(others[b]), percent))
            yield batch.loc[keep, ["a", "b"]]

    return held.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def set_components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For each row: doc_id, row, n, kid; and for the sets that link with another: node, component."""
    counters, sizes = counted(docs, k)
    light = boundary(sizes, percent)
    rows = written(sets(docs, counters, light, k, percent))
    distinct = rows.where("n > 0").groupBy("kid").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "row")).alias("one"))
    owners = distinct.select("kid", "one.doc_id", "one.row")

    # light sets: a shared subset, recognised by 128 bits, is a link
    subsets = rows.where(F.size("light") > 0).select("kid", "n", F.explode(F.arrays_zip("light", "light2", "small")).alias("x")).select("kid", "n", F.col("x.light").alias("key"), F.col("x.light2").alias("key2"), F.col("x.small").alias("small")).distinct()
    hubs = subsets.groupBy("key", "key2").agg(F.min(F.when(F.col("n") == F.col("small"), F.col("kid"))).alias("hub"), F.min("kid").alias("low"), F.max("kid").alias("high")).where("hub IS NOT NULL AND low <> high")
    found = [subsets.join(hubs.select("key", "key2", "hub"), ["key", "key2"]).where("kid <> hub").select(F.col("kid").alias("a"), F.col("hub").alias("b"))]

    # heavy sets: inverted lists with two sets at least, and the first pivot of each
    def lists(column: str) -> DataFrame:
        return rows.where(F.size(column) > 0).select("kid", F.explode(column).alias("key"))

    along = Window.partitionBy("key")
    short = lists("heavy").withColumns({"low": F.min("kid").over(along), "high": F.max("kid").over(along)}).where("low <> high").select("key", "kid", "low").distinct()
    ends = lists("long").groupBy("key").agg(F.min("kid").alias("low"), F.max("kid").alias("high")).where("low <> high").select("key", "low")
    held = written(short.unionByName(lists("long").distinct().join(ends, "key").select("key", "kid", "low")))

    members = held.select("kid").distinct()
    sketches = written(rows.where("sketch IS NOT NULL").select("kid", "n", "sketch").join(members, "kid", "left_semi").dropDuplicates(["kid"]))

    # first round: each set with the pivot that it shares most keys with
    shared_keys = held.where("kid <> low").groupBy("kid", "low").agg(F.count(F.lit(1)).alias("shared"))
    pairs = shared_keys.groupBy("kid").agg(F.max_by("low", F.struct("shared", "low")).alias("b")).select(F.col("kid").alias("a"), "b")
    found.append(_verified(pairs, docs, owners, sketches, k, percent))
    edges = cut(reduce(DataFrame.unionByName, found))
    parts = components(edges)
    # then the lists that lie in several components are scanned: first for each set's nearest partner, which joins most
    met = None
    for share, ranks in ROUNDS:
        lists_now = held.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
        placed = lists_now.select("key", "kid").join(parts.select(F.col("node").alias("kid"), "component"), "kid", "left").withColumn("component", F.coalesce("component", "kid"))
        mixed = written(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size"))
        longest = mixed.agg(F.max("size")).first()[0]
        if longest is None:
            continue
        pairs = _scanned(placed.join(mixed, "key").join(sketches, "kid"), percent, ranks, longest).distinct()
        now = written(pairs if met is None else pairs.join(met, ["a", "b"], "left_anti"))
        met = now if met is None else met.unionByName(now)
        more = None if now.isEmpty() else cut(_verified(now, docs, owners, sketches, k, percent))
        if more is None or more.isEmpty():
            continue
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return rows.select("doc_id", "row", "n", "kid"), parts


def _scanned(lists: DataFrame, percent: int, ranks: tuple[int, int | None], longest: int) -> DataFrame:
    """Pairs (a, b) of a list's members of different components whose sizes and sketches leave a link possible.

    lists: key, size (of the list, ``longest`` at most), kid, component, n, sketch.  A long list is split by size: sizes that may link are in
    the same band or in neighbouring ones, so each member meets its own band, and the next one as a guest; guests do not
    meet each other.  A band of a list that is still long is cut into blocks, and each pair of blocks is a group of its
    own, so that no task holds more than two blocks.
    """
    columns = ("key", "band", "low", "high", "own", "guest", "kid", "component", "n", "sketch")
    none = F.lit(0)
    dealt = lists.where(F.col("size") <= LIST_BLOCK).withColumns({"band": F.lit(-1), "low": none, "high": none, "own": none, "guest": F.lit(False)}).select(*columns)
    if longest > LIST_BLOCK:
        dealt = dealt.unionByName(_split(lists.where(F.col("size") > LIST_BLOCK), percent).select(*columns))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for batch in batches:
            rows = batch if carry is None else pd.concat((carry, batch), ignore_index=True)
            own = rows[["key", "band", "low", "high"]].to_numpy()
            # the last list may go on in the next batch
            last = int(np.flatnonzero((own != own[-1]).any(1))[-1] + 1) if (own != own[-1]).any() else 0
            carry = rows.iloc[last:]
            if last:
                yield _near(rows.iloc[:last], percent, ranks)
        if carry is not None and len(carry):
            yield _near(carry, percent, ranks)

    group = ("key", "band", "low", "high")
    return dealt.repartition(*group).sortWithinPartitions(*group, "kid").mapInPandas(scan, "a long, b long")


def _split(lists: DataFrame, percent: int) -> DataFrame:
    """Long lists by bands of size, each with the guests of the band below, and blocks of bands."""
    # rounded down a little, so that an inexact logarithm does not part sizes that may link by more than a band
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.001 / percent))).cast("int")
    dealt = lists.withColumn("x", F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))))
    dealt = dealt.select("key", "x.band", "x.guest", "kid", "component", "n", "sketch")
    many = dealt.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"), F.bool_and("guest").alias("guests")).where("NOT guests").drop("guests")
    dealt = dealt.join(many, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("kid"), F.col("blocks")).cast("int"))
    return dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "with"), "high": F.greatest("own", "with")})


def _near(rows: pd.DataFrame, percent: int, ranks: tuple[int, int | None]) -> pd.DataFrame:
    """Pairs of whole lists, which stand one after the other.

    ranks: which of the partners after it in the list each member gives, from the nearest on, whatever their components;
    so all rounds together give every pair whose members are of different components when its turn comes.
    """
    lists = rows[["key", "band", "low", "high"]].to_numpy()
    n, component, kid, own, guest = (rows[c].to_numpy() for c in ("n", "component", "kid", "own", "guest"))
    across = (rows["low"] != rows["high"]).to_numpy()
    sketch = np.array(rows["sketch"].tolist(), dtype=np.int64).view(np.uint64)
    begins = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]).any(1))))
    size = np.diff(np.append(begins, len(rows)))
    more = np.repeat(begins + size, size) - np.arange(len(rows)) - 1
    ends = np.cumsum(more)
    out, at = [], 0
    while at < len(rows):
        # so many rows that their pairs with what follows in their lists are at most PAIRS_AT_ONCE, but one row at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        i = np.repeat(np.arange(at, to), more[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[at:to]) - more[at:to], more[at:to])
        keep = (n[i] * 100 >= n[j] * percent) & (n[j] * 100 >= n[i] * percent) & (~across[i] | (own[i] != own[j])) & ~(guest[i] & guest[j])
        i, j = i[keep], j[keep]
        apart = np.zeros(len(i), dtype=np.int64)
        for k in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[i, k] ^ sketch[j, k])
        near = apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        i, j, apart = i[near], j[near], apart[near]
        order = np.lexsort((kid[j], apart, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        given = (component[i] != component[j]) & (rank >= ranks[0]) & (rank < (ranks[1] or len(i) + 1))
        i, j = i[given], j[given]
        pairs = np.stack((np.maximum(kid[i], kid[j]), np.minimum(kid[i], kid[j])), 1)
        out.append(np.unique(pairs, axis=0))
        at = to
    found = np.concatenate(out)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def row_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, row (the text's hash), n_shingles and component_id of each row of ``docs``, and whether it is its component's first.

    The first has the smallest doc_id, and of several texts under that the smallest hash; null ids come last.  A row that
    links with nothing is first.
    """
    docs = docs.select("doc_id", whole(F.col("text")).alias("text"))
    rows, parts = set_components(docs, k, percent)
    of = parts.select(F.col("node").alias("kid"), "component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = rows.where("n > 0").groupBy("kid").agg(F.min(order).alias("least")).join(of, "kid", "left").withColumn("component", F.coalesce("component", "kid"))
    smallest = least.groupBy("component").agg(F.min("least").alias("one"))
    out = rows.join(least.join(smallest, "component").select("kid", "one"), "kid", "left")
    first = (F.col("n") == 0) | F.col("one.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("one.row") == F.col("row"))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("one.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), first.alias("first"))


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    return row_components(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 256)
    return jaccard_components(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {K} THEN [array_to_string(w[i:i + {K} - 1], ' ') for i in range(1, len(w) - {K} + 2)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS (SELECT doc_id, hash(s) AS s FROM shingles),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= {PERCENT} * (x.n + y.n - shared.n)),
reached AS (
  SELECT doc_id, doc_id AS to_id FROM documents
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.to_id = links.a)
SELECT documents.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reached.to_id) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN reached USING (doc_id) GROUP BY documents.doc_id
"""
