"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (hashed into BUCKETS vectors) and itself; so a misspelling that training never
saw shares most of its vectors with the words it comes from.  A stretch of at most WINDOW words is the average of its
words, and a softmax over two classes reads it.  A document is as toxic as its worst stretch: each epoch picks that
stretch anew for every training document and moves the vectors and the softmax together.  Steps are full batches with
momentum, scaled for all vectors alike, so that an n-gram of many documents moves more than one that a single document has.  All
stretches of a text are scored, whatever its length.

Training uses at most MAX_TRAIN labelled documents of each class, those with the smallest hash of doc_id, and of these so
many whole texts as MAX_BYTES allows: the bound on what the driver holds.  Everything else covers all rows.

Defined cases: a null or empty text has the score of the bias alone; labels that are null or without a document are left
out; with no labelled documents of both classes every score is the same and below 0.5; rows that repeat are scored as
often, and of several texts under one labelled doc_id one trains; an empty table gives an empty result.  Other columns are
never read and are kept, but for ``score`` and ``predicted``, which the results replace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, documents, handed_back, whole

BUCKETS, DIMENSION = 1 << 17, 8
WINDOW = 48
#: Labelled documents of each class that training takes at most.
MAX_TRAIN = 2_000
#: Bytes of their texts, for each class.
MAX_BYTES = 50_000_000
EPOCHS = 150
#: The largest step of a weight in the first epoch.
RATE = 0.04
#: By how much the average of a stretch counts in the softmax, so that one word of WINDOW can decide.
SCALE = 30.0
#: Words whose n-grams are added up at once.
LOT = 1 << 15
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Word scores that a worker remembers.
REMEMBERED = 400_000
EDGES = ".,;:!?*&%$#@|()[]{}\"'<>-_=+~/\\"


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) for each n-gram of 3 to 5 characters of each word, with marked ends, and for each word itself."""
    marked = [f"<{w.strip(EDGES) or w}>" for w in words]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    of, end = np.repeat(np.arange(len(words), dtype=np.int32), sizes), np.repeat(np.cumsum(sizes), sizes)
    owners, buckets = [np.arange(len(words), dtype=np.int32)], [np.array([zlib.crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marked], dtype=np.int32)]
    for n in (3, 4, 5):
        m = max(0, len(codes) - n + 1)
        h = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            h = (h + codes[j : j + m]) * FACTOR
        inside = np.arange(m) + n <= end[:m]
        owners.append(of[:m][inside])
        buckets.append(((h[inside] >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def words_of(text: str | None) -> list[str]:
    """The words in order; one that follows itself counts once."""
    words = (text or "").lower().split()
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def stretches(scores: np.ndarray) -> np.ndarray:
    """The mean of each stretch of WINDOW neighbours, or of all if they are fewer."""
    n = min(WINDOW, len(scores))
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    return (total[n:] - total[:-n]) / n


@dataclass
class Model:
    """What the difference of the two classes' logits gets from each bucket, and the bias."""

    gram_scores: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[float]:
        """The mean of each word's buckets."""
        owners, buckets = bags(words)
        return (np.bincount(owners, weights=self.gram_scores[buckets], minlength=len(words)) / np.bincount(owners, minlength=len(words))).tolist()

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        """The score of each text.  known: words met before, with what they count."""
        out = []
        docs = [words_of(t) for t in texts]
        new = list({w for d in docs for w in d if w not in known})
        for i in range(0, len(new), LOT):
            known.update(zip(new[i : i + LOT], self.words(new[i : i + LOT]), strict=True))
        for d in docs:
            worst = stretches(np.fromiter(map(known.__getitem__, d), dtype=np.float64, count=len(d))).max() if d else 0.0
            out.append(float(sigmoid(self.bias + worst)))
        return out


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Vectors of the n-grams and the softmax, from labelled texts."""
    number: dict[str, int] = {}
    tokens, y = [], []
    for text, t in zip(texts, toxic, strict=True):
        if words := words_of(text):
            tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)))
            y.append(float(t))
    if not y or min(y) == max(y):
        return Model(np.zeros(BUCKETS, dtype=np.float32), -1.0)
    y = np.array(y)
    words = list(number)
    del number
    # words in lots, so that what a lot's n-grams need is small
    lots = [(i, *bags(words[i : i + LOT])) for i in range(0, len(words), LOT)]
    sizes = np.concatenate([np.bincount(owners) for _, owners, _ in lots])
    rng = np.random.default_rng(seed)
    vectors, softmax, bias = rng.uniform(-0.01, 0.01, (BUCKETS, DIMENSION)).astype(np.float32), rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    weight = np.where(y == 1, 0.35 / (y == 1).sum(), 0.65 / (y == 0).sum())
    momenta = [np.zeros_like(p) for p in (vectors, softmax, bias)]
    for epoch in range(1, epochs + 1):
        direction = softmax[:, 1] - softmax[:, 0]
        gram_scores = vectors @ (SCALE * direction)
        word_scores = np.concatenate([np.bincount(owners, weights=gram_scores[buckets]) for _, owners, buckets in lots]) / sizes
        slope_of_word, logits = np.zeros(len(sizes)), np.empty(len(y))
        picked: list[np.ndarray] = []
        for i, t in enumerate(tokens):
            means = stretches(word_scores[t])
            at = int(means.argmax())
            logits[i] = means[at]
            picked.append(t[at : at + WINDOW])
        slope = weight * (sigmoid(logits + float(bias[1] - bias[0])) - y)
        for t, g in zip(picked, slope, strict=True):
            np.add.at(slope_of_word, t, g / len(t))
        slope_of_gram = np.zeros(BUCKETS)
        for i, owners, buckets in lots:
            slope_of_gram += np.bincount(buckets, weights=(slope_of_word[i : i + LOT] / sizes[i : i + LOT])[owners], minlength=BUCKETS)
        slope_of_gram = slope_of_gram.astype(np.float32) * SCALE
        # of the softmax' two columns the gradients are opposite
        pull = slope_of_gram @ vectors
        gradients = (slope_of_gram[:, None] * direction[None, :], np.stack((-pull, pull), 1), np.array([-slope.sum(), slope.sum()], dtype=np.float32))
        for p, g, m in zip((vectors, softmax, bias), gradients, momenta, strict=True):
            m += 0.2 * (g - m)
            p -= RATE * (1 - epoch / (epochs + 1)) * m / (np.abs(m).max() + 1e-20)
    return Model((vectors @ (SCALE * (softmax[:, 1] - softmax[:, 0]))).astype(np.float32), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, keep: Column, most: int = MAX_TRAIN) -> tuple[list[str], list[int]]:
    """At most ``most`` texts of each class among the labels for which ``keep`` (of doc_id) holds."""
    ids = labels.where(keep & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    # one text for an id, and in order of hash so many whole texts as fit: 2 * most rows at most are ordered
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    along = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("held", F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(along)).where(F.col("held") <= MAX_BYTES).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the score of each text, in place of a column of that name."""
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[tuple[pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            if len(known) > REMEMBERED:
                known = {}
            yield pd.Series(handed.value.scores(texts.tolist(), known), dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf(score, "double")(whole(F.col("text"))))


def toxicity(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """``docs`` with score and predicted, by a model of the labelled documents for which ``keep`` holds."""
    model = train(*labelled(docs, labels, keep))
    handed_back()
    return scored(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Whether the contract holds a document out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 256)
    out = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
