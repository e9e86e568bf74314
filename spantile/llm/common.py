"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case: the contracts lower-case A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns of the table ``documents`` that an operator needs."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def arrow_batches(spark: SparkSession, rows: int) -> None:
    """Bounds the rows that reach a Python worker at once, so that long texts stay within its memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the cluster names the folder; in local mode, where one machine runs all, a local one serves."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spantile-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that a lost executor costs no recomputation from the start."""
    shared(df.sparkSession)
    return df.checkpoint()


def handed_back() -> None:
    """Gives freed memory back to the machine, where the C library can: a driver that has trained a model has other work to do."""
    gc.collect()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


#: Lots in which the shares of a part are added up before the lots are.
LOTS = 32


def summed(shares: DataFrame, kind: str) -> DataFrame:
    """One row for each ``part``: the sum of its arrays ``held`` (compressed, of the numpy type ``kind``, equally long).

    Shares are added as they stream by, in LOTS for each part and then the lots, so a task holds one sum for each of its
    parts however many tasks have sent shares.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze, total = zstandard.ZstdCompressor(level=1), {}
        for batch in batches:
            for part, held in zip(batch["part"].tolist(), batch["held"], strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(held)), dtype=kind)
                if part in total:
                    total[part] += x
                else:
                    total[part] = x.copy()
        for part, x in total.items():
            yield pd.DataFrame({"part": [part], "held": [squeeze.compress(x.tobytes())]})

    dealt = shares.select("part", "held", F.pmod(F.xxhash64("held"), F.lit(LOTS)).alias("lot")).repartition("part", "lot")
    lots = dealt.select("part", "held").mapInPandas(add, "part int, held binary")
    return lots.repartition("part").mapInPandas(add, "part int, held binary")


def small_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows of numbers, of a bounded count, that the JVM holds without any Python worker."""
    parts = names.split(", ")
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in rows)
    casts = [f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in map(str.split, parts)]
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {values} AS t({', '.join(f'`{p.split()[0]}`' for p in parts)})")


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder: compressed, and read again by column.  It goes when the driver ends."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.parquet(path)
