"""Sharding: a k-d tree over metadata, cut at distributed weighted medians.  DataFrame operations only.

The law is ``bytes``: the shards' sizes are near equal.  A node that stands for m leaves is cut along its widest
metadata dimension, where floor(m/2) of m parts of its bytes lie on one side; so any number of leaves works, not only
powers of two.  All cuts of a level are found together by histograms that zoom into the bin that holds the cut; the
driver sees only bins.  Documents that agree in the dimension follow their text's checksum, so that equal texts stay
together unless a cut runs through their group, and then a hash of doc_id, so that a group of any size can be cut.

Metadata are those of ``lang``, ``source`` and ``n_chars`` that the table has.  Defined cases: a null text has no bytes;
null metadata are the smallest value; rows that repeat are sharded as often; an empty table gives an empty result.
Columns besides doc_id, text and the metadata are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, small_table, whole

SHARDS = 24
DIMENSIONS = ("lang", "source", "n_chars")
#: Bytes that each document counts besides its text.
OVERHEAD = 8
BINS = 2048
#: A cut may miss its place by this share of a leaf's bytes.
TOLERANCE = 5e-4
#: Rows of a shard that one task numbers, about.
SLOT_ROWS = 100_000
TOP = 2**30 - 1


@dataclass
class Node:
    """A leaf range [first, first + leaves) of the tree; a node that was cut has a dimension and two children."""

    first: int
    leaves: int
    dimension: int = 0
    children: tuple[Node, Node] | None = None


def _slim(docs: DataFrame, dimensions: tuple[str, ...]) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32 and a number from 0 to TOP for each dimension."""
    text = whole(F.col("text"))
    kinds, columns = dict(docs.dtypes), [d for d in dimensions if d in docs.columns]
    slim = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(d).alias(f"m{i}") for i, d in enumerate(columns)])
    slim = cut(slim)
    numeric = [i for i, d in enumerate(columns) if kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    ends = slim.agg(F.count(F.lit(1)), *[f(F.col(f"m{i}").cast("double")) for i in numeric for f in (F.min, F.max)]).first()
    place = {}
    for i in range(len(columns)):
        if i in numeric:
            low, high = ends[1 + 2 * numeric.index(i)] or 0.0, ends[2 + 2 * numeric.index(i)] or 0.0
            value = F.round((F.col(f"m{i}").cast("double") - low) / max(high - low, 1e-9) * TOP)
        else:
            value = F.shiftrightunsigned(F.xxhash64(F.col(f"m{i}").cast("string")), 34)
        place[f"m{i}"] = F.coalesce(F.when(F.col(f"m{i}").isNotNull(), value), F.lit(0)).cast("long")
    return slim.withColumns(place) if place else slim.withColumn("m0", F.lit(0).cast("long")), max(1, len(columns))


def _table(data: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each open node: as many as leaves at most, and so small enough to hand to every task."""
    return F.broadcast(small_table(data.sparkSession, rows, schema))


def _level(data: DataFrame, nodes: list[Node], dims: int) -> DataFrame:
    """``data`` with ``node`` after all ``nodes`` have been cut in two."""
    stats = {r["node"]: r for r in data.groupBy("node").agg(F.sum("size").alias("size"), *[f(f"m{i}").alias(f"{k}{i}") for i in range(dims) for k, f in (("min", F.min), ("max", F.max))]).collect()}
    state = {}
    for n in nodes:
        n.children = (Node(n.first, n.leaves // 2), Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2))
        if r := stats.get(n.first):
            n.dimension = max(range(dims), key=lambda i: r[f"max{i}"] - r[f"min{i}"])
            low, high = r[f"min{n.dimension}"] << 32, (r[f"max{n.dimension}"] << 32) + 2**32
            state[n.first] = Cut(n, low, high, want=r["size"] * (n.leaves // 2) / n.leaves, slack=TOLERANCE * r["size"] / n.leaves)
    if not state:
        return data
    # the order of a node's documents: two numbers of 63 bits
    chosen = _table(data, [(k, s.node.dimension) for k, s in state.items()], "node int, dimension int")
    place = F.element_at(F.array(*[f"m{i}" for i in range(dims)]), F.col("dimension") + 1)
    keyed = data.join(chosen, "node", "left").withColumns({"key1": F.shiftleft(place, 32) + F.col("text_crc32"), "key2": F.shiftrightunsigned(F.xxhash64("doc_id"), 1)}).drop("dimension")
    while open_ := {k: s for k, s in state.items() if s.at is None}:
        rows = [(k, s.first, s.low, s.high, s.step) for k, s in open_.items()]
        held = keyed.join(_table(data, rows, "node int, first long, low long, high long, step long"), "node")
        key = F.when(F.col("first").isNull(), F.col("key1")).otherwise(F.col("key2"))
        inside = (F.col("first").isNull() | (F.col("key1") == F.col("first"))) & (key >= F.col("low")) & (key < F.col("high"))
        bins = held.where(inside).groupBy("node", F.expr("(CASE WHEN first IS NULL THEN key1 ELSE key2 END - low) DIV step").alias("bin")).agg(F.sum("size").alias("size")).collect()
        for k, s in open_.items():
            s.zoom(sorted((r["bin"], r["size"]) for r in bins if r["node"] == k))
    cuts = _table(data, [(k, *s.at, s.node.children[1].first) for k, s in state.items()], "node int, at1 long, at2 long, right int")
    after = (F.col("key1") > F.col("at1")) | (F.col("key1") == F.col("at1")) & (F.col("key2") >= F.col("at2"))
    moved = keyed.join(cuts, "node", "left").withColumn("node", F.when(after, F.col("right")).otherwise(F.col("node")))
    return cut(moved.drop("key1", "key2", "at1", "at2", "right"))


@dataclass
class Cut:
    """The search for one node's cut: the bracket that holds it, in the first key or, where ``first`` is set, in the second."""

    node: Node
    low: int
    high: int
    want: float
    slack: float
    left: int = 0
    first: int | None = None
    at: tuple[int, int] | None = None

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low) // BINS))

    def zoom(self, bins: list[tuple[int, int]]) -> None:
        """Goes on to the bin that holds the cut, or ends there."""
        step, left = self.step, self.left
        for b, size in bins:
            if left + size >= self.want:
                break
            left += size
        else:
            self._end(self.high)
            return
        low, high = self.low + b * step, min(self.low + (b + 1) * step, self.high)
        self.left = left
        if size <= self.slack or self.first is not None and step == 1:
            self._end(low if self.want - left < left + size - self.want else high)
        elif step == 1:
            self.first, self.low, self.high = low, 0, 2**63 - 1
        else:
            self.low, self.high = low, high

    def _end(self, key: int) -> None:
        self.at = (key, 0) if self.first is None else (self.first, key)


def kd_tree(slim: DataFrame, leaves: int, dims: int) -> tuple[Node, DataFrame]:
    """The tree, and ``slim`` with the leaf of each row as ``node``."""
    root, data = Node(0, leaves), slim.withColumn("node", F.lit(0))
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        data = _level(data, level, dims)
        level = [c for n in level for c in n.children]
    return root, data


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document: ``shards`` leaves, or as many as ``target_bytes`` asks for."""
    slim, dims = _slim(docs, dimensions)
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    leaves = shards or max(1, -(-total // target_bytes))
    out = kd_tree(slim, leaves, dims)[1].withColumnRenamed("node", "shard")
    buckets = max(1, -(-rows // (leaves * SLOT_ROWS)))
    out = out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    out = out.join(counts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(order) - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", *DIMENSIONS)
    out = kd_shards(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
