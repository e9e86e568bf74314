"""Line dedup: sharded cuckoo filters backed by exact reference tables, so that documents can be added and taken back.

The exact side is a table of references, one row for each (line key, document).  From it follow each key's number of
documents and the largest document that holds it.  For keys that reach the limit, each shard keeps a stored cuckoo
filter; a line asks its shard's filter first, and only what the filter lets through meets the exact table in a join.
Lines go to their shard packed; a shard that many lines ask is asked in slices, each of which reads the filter once.

``insert`` and ``delete`` are incremental: they read no text but the batch's own, count anew only the keys that the
batch touches, and put keys that cross the limit into their shards' stored filters or take them out (the filters'
own ``insert`` and ``delete``).  Shards without such keys keep their filters as they are.

Defined cases: a null or empty text is one empty line; a null doc_id counts as one document and never is the largest;
rows that repeat give their result as often; lines shorter than the limit always stay; an empty table gives an empty
result.  A column that the caller has besides ``doc_id`` and ``text`` is kept, whatever its name, but for n_lines and
n_dropped, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut, documents, lower_ascii, whole, written

#: Keys for which one shard's filter is meant.
SHARD_KEYS = 50_000
#: Line keys that are packed together before they are sent to the shards: so many for each shard, within these bounds.
SHARD_LINES, LEAST_BLOCK, MOST_BLOCK = 500, 200_000, 2_000_000
#: Lines in a packed row at most, and lines that one reading of a filter is for.
ROW_LINES, SLICE_LINES = 20_000, 200_000
#: A filter whose stash is longer than this is built anew.
MOST_STASHED = 2_000
SLOTS = 4


class CuckooFilter:
    """Cuckoo filter over unsigned 64-bit keys with 16-bit fingerprints; what does not fit goes to an exact stash."""

    def __init__(self, capacity: int) -> None:
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.8)))))
        self.table = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
        self.stash: dict[int, int] = {}

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys, dtype=np.uint64)
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, place, mark):
        return place ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def insert(self, keys: np.ndarray) -> None:
        marks, firsts, seconds = self._places(keys)
        for key, mark, first, second in zip(np.asarray(keys, dtype=np.uint64).tolist(), marks, firsts, seconds, strict=True):
            for place in (first, second):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    break
            else:
                self._move(key, mark, int(second))

    def _move(self, key: int, mark: np.uint16, place: int) -> None:
        trail = []
        for step in range(200):
            slot = (place + step) % SLOTS
            trail.append((place, slot, self.table[place, slot]))
            mark, self.table[place, slot] = self.table[place, slot], mark
            place = int(self._other(np.int64(place), np.asarray(mark)))
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        for place, slot, old in reversed(trail):
            self.table[place, slot] = old
        self.stash[key] = self.stash.get(key, 0) + 1

    def delete(self, keys: np.ndarray) -> None:
        """Takes back keys that were inserted."""
        marks, firsts, seconds = self._places(keys)
        for key, mark, first, second in zip(np.asarray(keys, dtype=np.uint64).tolist(), marks, firsts, seconds, strict=True):
            if key in self.stash:
                self.stash[key] -= 1
                if not self.stash[key]:
                    del self.stash[key]
                continue
            for place in (first, second):
                held = np.flatnonzero(self.table[place] == mark)
                if len(held):
                    self.table[place, held[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Never false for a key that is held."""
        marks, firsts, seconds = self._places(keys)
        found = (self.table[firsts] == marks[:, None]).any(1) | (self.table[seconds] == marks[:, None]).any(1)
        if self.stash:
            found |= np.isin(np.asarray(keys, dtype=np.uint64), np.fromiter(self.stash, dtype=np.uint64))
        return found

    def to_bytes(self) -> bytes:
        stash = np.array([k for k, n in self.stash.items() for _ in range(n)], dtype=np.uint64)
        return np.array([self.buckets, len(stash)], dtype=np.int64).tobytes() + stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, n = np.frombuffer(data, dtype=np.int64, count=2).tolist()
        out = cls.__new__(cls)
        out.buckets, out.stash = buckets, {}
        for k in np.frombuffer(data, dtype=np.uint64, count=n, offset=16).tolist():
            out.stash[k] = out.stash.get(k, 0) + 1
        out.table = np.frombuffer(data, dtype=np.uint16, offset=16 + 8 * n).reshape(buckets, SLOTS).copy()
        return out


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line that is long enough: doc_id, row (hash of the text), i, and the key's two hashes."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    keys = lines.select("doc_id", "row", "i", lower_ascii(F.btrim("line", F.lit(" \t\n\x0b\f\r"))).alias("k"))
    return keys.where(F.char_length("k") >= min_chars).select("doc_id", "row", "i", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


_FILTERS = "shard long, version int, stashed long, held binary"


def _filter_row(shard: int, version: int, held: CuckooFilter) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "version": [version], "stashed": [sum(held.stash.values())], "held": [held.to_bytes()]})


def _building(version: int):
    def build(keys: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter(len(keys))
        held.insert(keys["h1"].to_numpy().view(np.uint64))
        return _filter_row(int(keys["shard"].iloc[0]), version, held)

    return build


def _updating(version: int):
    def update(stored: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.from_bytes(stored["held"].iloc[0]) if len(stored) else CuckooFilter(len(keys))
        for gained, change in ((False, held.delete), (True, held.insert)):
            change(keys.loc[keys["gained"] == gained, "h1"].to_numpy(dtype=np.int64).view(np.uint64))
        return _filter_row(int((stored if len(stored) else keys)["shard"].iloc[0]), version, held)

    return update


class LineIndex:
    """References of lines to documents, with stored filters of the keys found in at least ``min_docs`` documents.

    refs: h1, h2, doc_id.  common: h1, h2, n_docs, last of the keys that reach the limit.  filters: shard, the version that
    last changed it, the filter.  The number of shards stays as it was when the index was built.
    """

    def __init__(self, refs: DataFrame, common: DataFrame, filters: DataFrame | None, shards: int, min_docs: int, min_chars: int, version: int = 0, stored: bool = False) -> None:
        self.refs, self.common, self.shards, self.min_docs, self.min_chars, self.version, self.stored = refs, common, shards, min_docs, min_chars, version, stored
        self.filters = written(self._built(common)) if filters is None else filters

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
        refs = cls._refs_of(docs, min_chars)
        common = cut(cls._counted(refs, min_docs))
        return cls(refs, common, None, max(1, -(-common.count() // SHARD_KEYS)), min_docs, min_chars)

    @staticmethod
    def _refs_of(docs: DataFrame, min_chars: int) -> DataFrame:
        return line_rows(docs.select("doc_id", whole(F.col("text")).alias("text")), min_chars).select("h1", "h2", "doc_id").distinct()

    @staticmethod
    def _counted(refs: DataFrame, min_docs: int) -> DataFrame:
        return refs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)

    def shard(self):
        return F.pmod(F.shiftright("h1", 20), F.lit(self.shards)).cast("long")

    def _built(self, keys: DataFrame) -> DataFrame:
        return keys.select(self.shard().alias("shard"), "h1").groupBy("shard").applyInPandas(_building(self.version), _FILTERS)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents.  A document that it has already gets more lines."""
        refs = self.refs if self.stored else written(self.refs)
        more = written(self._refs_of(docs, self.min_chars).alias("new").join(refs.alias("old"), F.expr("new.h1 = old.h1 AND new.h2 = old.h2 AND new.doc_id <=> old.doc_id"), "left_anti"))
        return self._after(refs.unionByName(more), more)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index as if these documents had never been inserted."""
        refs = self.refs if self.stored else written(self.refs)
        gone = doc_ids.select(F.col("doc_id").alias("gone")).distinct()
        taken = written(refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi"))
        return self._after(refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti"), taken)

    def _after(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        """The index with these references, of which ``changed`` came or went: only the keys of these are counted."""
        keys, at = cut(changed.select("h1", "h2").distinct()), ["h1", "h2"]
        now = cut(self._counted(refs.join(keys, at, "left_semi"), self.min_docs))
        before = self.common.join(keys, at, "left_semi")
        crossed = now.join(before, at, "left_anti").select("h1", "h2", F.lit(True).alias("gained")).unionByName(before.join(now, at, "left_anti").select("h1", "h2", F.lit(False).alias("gained")))
        crossed = cut(crossed.select(self.shard().alias("shard"), "h1", "gained"))
        common = cut(self.common.join(keys, at, "left_anti").unionByName(now))
        touched = crossed.select("shard").distinct()
        out = LineIndex(refs, common, self.filters, self.shards, self.min_docs, self.min_chars, self.version + 1, True)
        updated = self.filters.join(touched, "shard", "left_semi").groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_updating(out.version), _FILTERS)
        updated = written(updated)
        crowded = updated.where(F.col("stashed") > MOST_STASHED).select("shard")
        anew = written(out._built(common.join(crowded, self.shard() == F.col("shard"), "left_semi")))
        out.filters = self.filters.join(touched, "shard", "left_anti").unionByName(updated.join(crowded, "shard", "left_anti")).unionByName(anew)
        return out

    def drops(self, docs: DataFrame) -> DataFrame:
        """For each row of ``docs`` (doc_id, text) that loses lines: doc_id, row, drop (the lines' places)."""
        spark = docs.sparkSession
        lines = line_rows(docs, self.min_chars).withColumn("shard", self.shard())
        arrow_batches(spark, 10_000)
        packed = written(lines.mapInPandas(_packing(min(MOST_BLOCK, max(LEAST_BLOCK, SHARD_LINES * self.shards))), f"shard long, n long, {_PACKED}"))
        # packed rows are large
        arrow_batches(spark, 64)
        slices = packed.groupBy("shard").agg(F.ceil(F.sum("n") / SLICE_LINES).cast("int").alias("slices"))
        copies = self.filters.join(slices, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("turn"), "held")
        asking = packed.join(slices, "shard").withColumns({"slice": F.pmod(F.xxhash64("h1"), F.col("slices")).cast("int"), "turn": F.lit(1)}).drop("n", "slices")
        dealt = copies.unionByName(asking, allowMissingColumns=True).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "turn")
        asked = dealt.mapInPandas(_asked, "h1 long, h2 long, doc_id long, row long, i int")
        found = asked.join(self.common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        return found.groupBy("doc_id", "row").agg(F.collect_set("i").alias("drop"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its texts cleaned, and n_lines, n_dropped of each."""
        rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
        docs = docs.select("doc_id", whole(F.col("text")).alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(None).cast("int").alias("rest"))
        drops = self.drops(docs.select("doc_id", "text")).select(F.col("doc_id").alias("of"), F.col("row").alias("at"), "drop")
        joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("at")), "left")
        lines, drop = F.split("text", "\n", -1), F.coalesce("drop", F.array().cast("array<int>"))
        kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
        out = joined.select("doc_id", lines.alias("lines"), drop.alias("drop"), "rest")
        text = F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n")
        return out.select("doc_id", text.alias("text"), *[F.col("rest")[c].alias(c) for c in rest], F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"))


_FIELDS = {"h1": np.int64, "h2": np.int64, "doc_id": np.int64, "known": bool, "row": np.int64, "i": np.int32}
_PACKED = ", ".join(f"{name} binary" for name in _FIELDS)


def _packing(block: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines by shard, many in a row."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= block:
                yield _pack(pd.concat(held))
                held = []
        if sum(map(len, held)):
            yield _pack(pd.concat(held))

    return pack


def _pack(lines: pd.DataFrame) -> pd.DataFrame:
    known = lines["doc_id"].notna().to_numpy()
    lines = lines.assign(known=known, doc_id=lines["doc_id"].fillna(0).astype("int64"))
    rows = []
    for shard, part in lines.groupby("shard"):
        columns = {c: part[c].to_numpy(dtype=kind) for c, kind in _FIELDS.items()}
        rows += [{"shard": shard, "n": min(ROW_LINES, len(part) - at)} | {c: x[at : at + ROW_LINES].tobytes() for c, x in columns.items()} for at in range(0, len(part), ROW_LINES)]
    return pd.DataFrame(rows, columns=["shard", "n", *_FIELDS])


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines that the filter of their shard lets through.  A shard's filter comes before its lines, if it has one."""
    shard, held = None, None
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.turn == 0:
                shard, held = r.shard, CuckooFilter.from_bytes(r.held)
                continue
            if r.shard != shard:
                continue
            own = {name: np.frombuffer(getattr(r, name), dtype=kind) for name, kind in _FIELDS.items()}
            hit = held.contains(own["h1"].view(np.uint64))
            ids = pd.array(own["doc_id"][hit], dtype="Int64")
            ids[~own["known"][hit]] = pd.NA
            yield pd.DataFrame({"h1": own["h1"][hit], "h2": own["h2"][hit], "doc_id": ids, "row": own["row"][hit], "i": own["i"][hit]})


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` without the lines whose keys at least ``min_docs`` documents hold, except in the largest doc_id."""
    return LineIndex.build(docs, min_docs, min_chars).apply(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, i, line, common.k IS NOT NULL AND keyed.doc_id <> common.last AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
