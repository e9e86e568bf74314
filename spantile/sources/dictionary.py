"""Dictionaries: the packed container, lexicon files as typed tables, and what is known of a dictionary."""

from __future__ import annotations

import gzip
import io
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The container's mark and version, and its files in the order they are written.
MAGIC, VERSION = b"MCBD", 1
FILES = ("char.bin", "dicrc", "matrix.bin", "sys.dic", "unk.dic")
#: Bytes that a container may have when it is unpacked.
MOST_BYTES = 64 * 1024 * 1024
DICTIONARY_VERSION = 102
LEXICON = "surface string, left_id int, right_id int, cost int, feature string"


class DictionaryError(ValueError):
    """A dictionary that cannot be read or written."""


def unpack(data: bytes) -> list[tuple[str, bytes]]:
    """Names and contents of a container's files."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            raw = f.read(MOST_BYTES + 1)
    except (OSError, EOFError) as e:
        raise DictionaryError(f"not a gzip file: {e}") from e
    if len(raw) > MOST_BYTES:
        raise DictionaryError(f"more than {MOST_BYTES} bytes")
    view, at = memoryview(raw), 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(view):
            raise DictionaryError("the container ends too early")
        at += n
        return bytes(view[at - n : at])

    number = lambda: struct.unpack("<I", take(4))[0]
    if take(4) != MAGIC:
        raise DictionaryError("not a dictionary container")
    if (version := number()) != VERSION:
        raise DictionaryError(f"version {version} is not known")
    out = []
    for _ in range(number()):
        name = take(number()).decode("utf-8", "replace")
        if not name or "/" in name or "\\" in name or ".." in name:
            raise DictionaryError(f"{name!r} cannot be a file's name")
        out.append((name, take(number())))
    return out


def pack(files: list[tuple[str, bytes]]) -> bytes:
    out = [MAGIC, struct.pack("<II", VERSION, len(files))]
    for name, data in files:
        if len(data) >= 1 << 32:
            raise DictionaryError(f"{name} is larger than 4 GiB")
        coded = name.encode()
        out += [struct.pack("<I", len(coded)), coded, struct.pack("<I", len(data)), data]
    return gzip.compress(b"".join(out), mtime=0)


def pack_dir(folder: str, path: str) -> None:
    """Packs a dictionary's files into one."""
    files = []
    for name in FILES:
        try:
            with open(os.path.join(folder, name), "rb") as f:
                files.append((name, f.read()))
        except OSError as e:
            raise DictionaryError(f"{name}: {e}") from e
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        f.write(pack(files))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """name and data of the files of a container; at most MOST_BYTES are held."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return spark.createDataFrame([(n, bytearray(d)) for n, d in unpack(data)], "name string, data binary")


def compile_lexicon(spark: SparkSession, paths: str | list[str], out: str, charset: str = "UTF-8") -> None:
    """CSV lexicons (surface, left, right, cost, then the feature's fields) as a typed table."""

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame({"value": bytes(data).decode(charset).splitlines()})

    # a lexicon is a few files of some megabytes, in charsets that the JVM's readers may not take
    lines = spark.read.format("binaryFile").load(paths).select("content").mapInPandas(lines_of, "value string")
    cells = F.split("value", ",", 5)
    rows = lines.where(F.trim("value") != "").select(F.get(cells, 0).alias("surface"), *[F.get(cells, i).cast("int").alias(n) for i, n in ((1, "left_id"), (2, "right_id"), (3, "cost"))], F.get(cells, 4).alias("feature"))
    rows.write.mode("overwrite").parquet(out)


def dictionary_info(lexicon: DataFrame, filename: str = "lexicon", kind: int = 0) -> DataFrame:
    """One row: filename, charset, size, type (0 system, 1 user, 2 unknown words), lsize, rsize, version."""
    return lexicon.agg(F.count(F.lit(1)).alias("size"), (F.coalesce(F.max("left_id"), F.lit(-1)) + 1).cast("long").alias("lsize"), (F.coalesce(F.max("right_id"), F.lit(-1)) + 1).cast("long").alias("rsize")).select(
        F.lit(filename).alias("filename"), F.lit("utf-8").alias("charset"), "size", F.lit(kind).alias("type"), "lsize", "rsize", F.lit(DICTIONARY_VERSION).alias("version")
    )


def dictionary_infos(spark: SparkSession, compiled) -> DataFrame:
    """One row for each lexicon of a compiled dictionary: filename, charset, size, type, lsize, rsize, version."""
    names = ("filename", "charset", "size", "type", "lsize", "rsize", "version")
    return spark.createDataFrame([tuple(i[n] for n in names) for i in compiled.infos], "filename string, charset string, size long, type int, lsize long, rsize long, version int")
