"""License scans by diagonal voting.

All rolling hashes of K neighbouring words of a document meet, in a Spark join, the positions where the templates have
the same K words.  Each meeting votes for the diagonal (place in the document less place in the template).  Votes are
counted by diagonal, neighbouring diagonals are merged (words were put in or left out), and each merged span whose votes
could carry the template is verified word by word against the text.  A template is found where its words, in order, make
up COVERAGE of it at least, or all of it if it is short.  A document's spans are verified together, so that its text
goes to a worker once.  Beside that, phrases are looked for as they stand.  Labels of SHORT alone are no places.

The templates are a parameter and go to every task; their number of words is checked.  Defined cases: a null or empty
text has no words and no labels; rows that repeat give their result as often; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, documents, whole

K = 3
COVERAGE = 0.7
#: Templates of fewer words must be there whole: short notices differ in single words.
WHOLE_BELOW = 20
#: Diagonals at most this far apart are of one span.
NEAR = 4
#: Words of all templates together that may be handed to every task.
MOST_WORDS = 1_000_000
REMEMBERED = 400_000

# Phrases and labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Too short for a place or a score, yet a label of the method.
SHORT = (("mit license", "mit"),)

# Public license notices and the opening clauses of public licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)

_TABLE = bytes(ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z (A-Z lower-cased) and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def rolling(words: list[bytes], hashes: Hashes, k: int = K) -> np.ndarray:
    """The hash of each run of k words."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _FACTOR
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def base_places(words: list[bytes], text: bytes, phrases: tuple[tuple[str, str], ...] = PHRASES) -> tuple[list[int], set[str]]:
    """Where the phrases stand, and their labels.  text: the words, each with a blank before and after."""
    places, labels = [], set()
    for phrase, label in phrases:
        asked, at = f" {phrase} ".encode(), text.find(f" {phrase} ".encode())
        while at >= 0:
            places.append(text.count(b" ", 0, at))
            labels.add(label)
            at = text.find(asked, at + 1)
    return places, labels


def base(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """doc_id, row, n_words, n_base, first_word, last_word, base_labels, short_labels of each row of docs (doc_id, text, row)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, row in zip(batch["doc_id"].array, batch["text"].array, batch["row"].array, strict=True):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                places, labels = base_places(words, joined, phrases)
                short = base_places(words, joined, SHORT)[1]
                rows.append((doc_id, row, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(short))))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base_labels", "short_labels"])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.mapInPandas(count, "doc_id long, row long, n_words long, n_base long, first_word long, last_word long, base_labels string, short_labels string")


def spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = K, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans in docs (doc_id, text, row): doc_id, row, label, template, first_word, last_word, score."""
    spark = docs.sparkSession
    held = [(label, words_of(text)) for label, text in templates]
    if sum(len(w) for _, w in held) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are not handed to every task")
    grams = [(int(h), t, i) for t, (_, words) in enumerate(held) for i, h in enumerate(rolling(words, Hashes(), k))]
    positions = F.broadcast(spark.createDataFrame(grams, "h long, template int, at int"))
    sizes = F.array(*[F.lit(len(w)) for _, w in held])

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            rows = [rolling(words_of(text), hashes, k) for text in batch["text"].array]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "row": batch["row"], "grams": rows})

    rolled = docs.mapInPandas(roll, "doc_id long, row long, grams array<long>")
    hits = rolled.select("doc_id", "row", F.posexplode("grams").alias("place", "h")).join(positions, "h")
    votes = hits.groupBy("doc_id", "row", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"))
    along = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True)).cast("int")
    merged = votes.withColumn("new", new).withColumn("span", F.sum("new").over(along)).groupBy("doc_id", "row", "template", "span")
    merged = merged.agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), (F.max("high") + k).alias("high"))
    # each word that is changed, added or left out costs k votes at most
    size = F.element_at(sizes, F.col("template") + 1)
    likely = merged.where(F.col("votes") >= F.greatest(F.lit(1), size - k + 1 - k * F.ceil(size * (1 - coverage)))).select(F.col("doc_id").alias("of"), F.col("row").alias("at"), "template", "low", "high")
    # a document's spans are as many as its words allow; its text is sent and cut into words once
    grouped = likely.groupBy("of", "at").agg(F.collect_set(F.struct("template", "low", "high")).alias("asked"))
    asked = docs.join(grouped, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("at"))).select("doc_id", "row", "text", "asked").dropDuplicates(["doc_id", "row"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, row, text, spans in zip(batch["doc_id"].array, batch["row"].array, batch["text"].array, batch["asked"].array, strict=True):
                words = words_of(text)
                for span in spans:
                    template, first, last = span["template"], span["low"], span["high"]
                    label, wanted = held[template]
                    low, high = max(0, first - len(wanted)), min(len(words), last + len(wanted))
                    blocks = [b for b in difflib.SequenceMatcher(None, words[low:high], wanted, autojunk=False).get_matching_blocks() if b.size]
                    score = sum(b.size for b in blocks) / len(wanted)
                    if score >= (coverage if len(wanted) >= WHOLE_BELOW else 1):
                        rows.append((doc_id, row, label, template, low + blocks[0].a, low + blocks[-1].a + blocks[-1].size - 1, score))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "label", "template", "first_word", "last_word", "score"]).astype({"doc_id": "Int64"})

    return asked.mapInPandas(verify, "doc_id long, row long, label string, template int, first_word long, last_word long, score double")


def scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """One row for each document: what ``base`` has, labels and score."""
    docs = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn("row", F.xxhash64("text"))
    found = spans(docs).groupBy(F.col("doc_id").alias("of"), F.col("row").alias("at")).agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    out = base(docs, phrases).join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("at")), "left")
    named = F.filter(F.split(F.concat_ws(",", "base_labels", "short_labels"), ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(named, F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 256)
    return scan(documents(spark, sf_dir))
