"""Phrases: a content word and the function words after it, as one running sum over each text's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The tags of content words, and the sub-tags that make them function words.
CONTENT = {
    "名詞": ("非自立", "接尾"),
    "動詞": ("非自立", "接尾"),
    "形容詞": ("非自立",),
    "副詞": (),
    "連体詞": (),
    "接続詞": (),
    "感動詞": (),
    "フィラー": (),
    "接頭詞": (),
}
PUNCTUATION = "記号"


def content(pos0: Column, pos1: Column) -> Column:
    """Whether a token is a content word; a missing sub-tag counts as ``*``."""
    sub = F.coalesce(pos1, F.lit("*"))
    out = F.lit(False)
    for tag, but in CONTENT.items():
        out = out | (pos0 == tag) & ~sub.isin(*but) if but else out | (pos0 == tag)
    return F.coalesce(out, F.lit(False))


def chunk_of(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``tokens`` (keys, idx, pos0, pos1) with the number of each one's phrase: null for punctuation."""
    along = Window.partitionBy(*keys).orderBy("idx")
    before = F.lag(F.coalesce("pos0", F.lit(""))).over(along)
    mark = F.coalesce(F.col("pos0") == PUNCTUATION, F.lit(False))
    opens = ~mark & (content(F.col("pos0"), F.col("pos1")) | before.isNull() | (before == PUNCTUATION))
    number = F.sum(F.col("_opens").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return tokens.withColumn("_opens", opens).withColumn("chunk", F.when(~mark, number).cast("int")).drop("_opens")


def chunks(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk, s, e, head and surface of each phrase."""
    placed = chunk_of(tokens, keys).where(F.col("chunk").isNotNull())
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "surface"))), lambda t: t["surface"]), "")
    return placed.groupBy(*keys, "chunk").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"), F.min("idx").alias("head"), text.alias("surface"))


def same_chunk(a: Column, b: Column) -> Column:
    """Whether two tokens are of one phrase; punctuation is of none."""
    return F.coalesce(a == b, F.lit(False))
