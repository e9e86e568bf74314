"""A training corpus from ``documents`` in five stages: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes the documents that the one before kept and returns the columns of ``documents``, with ``n_chars`` of the
text as it then is; the last returns the pieces of the packed sequences.  A document that loses all its lines stays, as
an empty one.  Rows that repeat with the same doc_id and text count as one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantile.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from spantile.llm.common import arrow_batches, whole, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of five words, a likeness of 0.8 or more.
SHINGLE_WORDS, LIKE_PERCENT = 5, 80
#: Lines found in so many documents go, but for one.
LINE_DOCS, LINE_CHARS = 3, 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels, predicts to be toxic go."""
    arrow_batches(spark, 256)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), LINE_DOCS, LINE_CHARS)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays; of two texts under that id, the one with the smaller hash.

    Rows go by doc_id and text: another text under the id of one that goes is another document.
    """
    arrow_batches(spark, 256)
    found = jaccard_join.row_components(docs, SHINGLE_WORDS, LIKE_PERCENT)
    gone = found.where("NOT first").select(F.col("doc_id").alias("gone"), "row").distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.xxhash64(whole(F.col("text"))) == F.col("row")), "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    arrow_batches(spark, 512)
    return decontaminate.holds_any(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("leaks")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    arrow_batches(spark, 256)
    return packing.packed_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The model, the joins and the tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
