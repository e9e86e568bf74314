"""Benchmark decontamination: pigeonhole edit matching.

A benchmark item of n characters allows ``rate`` * n edits.  It is split into one piece more than that: whatever holds
the item within the budget holds one of its pieces unchanged.  An automaton finds all pieces in a document at once.  A
hit is verified with Myers' bit-parallel edit distance on runs of 2, 4, 8 ... pieces around it before the whole item is:
m neighbouring pieces allow m - 1 edits, for if either half had as many edits as pieces, so would the whole.
Documents and items are compared with letters lower-cased and everything else but letters and digits as one blank.

The benchmark is a query set, stated against all documents: it is handed to the workers in broadcast blocks of bounded
size, each of which the documents pass once; work is documents times blocks, so a benchmark of n blocks costs n scans.
A passage that many documents hold gives each of them its own row and no pairs of documents.

Defined cases: a null or empty text matches nothing, nor does an item without letters or digits; items with equal words
match together; rows that repeat give their matches once; empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, documents

RATE = 0.1
#: Bytes of items that are handed to the workers at once.
BLOCK_BYTES = 8_000_000
WORDS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall((text or "").lower()))


def myers_end(pattern: dict[str, int], n: int, text: str, most: int, any_end: bool = False) -> tuple[int, int] | None:
    """Fewest edits, and the first end, of a stretch of ``text`` that equals the pattern of ``n`` characters within ``most`` edits.

    pattern: for each character, a number with a bit for each of its places.  any_end: the first match will do.
    """
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, most + 1, -1
    get = pattern.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        hu = down | ~(xh | up) & full
        hd = up & xh
        if hu & last:
            score += 1
        elif hd & last:
            score -= 1
            if score < best:
                best, end = score, at + 1
                if not best or any_end and best <= most:
                    break
        hu = hu << 1
        hd = hd << 1
        up = (hd | ~(xv | hu)) & full
        down = hu & xv & full
    return (best, end) if best <= most else None


def bits(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """Benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        import ahocorasick

        self.items, pieces = [], {}
        for item_id, text in items:
            if not (words := normal(text)):
                continue
            budget = min(int(len(words) * rate), len(words) - 1)
            at, ends = len(self.items), [len(words) * k // (budget + 1) for k in range(budget + 2)]
            self.items.append((item_id, words, bits(words), bits(words[::-1]), budget))
            for k in range(budget + 1):
                pieces.setdefault(words[ends[k] : ends[k + 1]], []).append((at, ends[k], ends[k + 1] - ends[k], self._runs(words, ends, k)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()
        self.pieces = pieces

    @staticmethod
    def _runs(words: str, ends: list[int], k: int) -> list[tuple[int, str, list]]:
        """The runs of pieces that hold piece ``k``, from small to large, without the whole: start, words, and room for their bits."""
        lo, hi, runs = 0, len(ends) - 1, []
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if k < mid else (mid, hi)
            runs.append((ends[lo], words[ends[lo] : ends[hi]], hi - lo - 1, []))
        return [r for r in reversed(runs) if r[2]]

    @staticmethod
    def _likely(text: str, item_at: int, runs: list) -> bool:
        """Whether each run matches within its own budget where the item would begin at ``item_at``."""
        for offset, words, budget, held in runs:
            if not held:
                held.append(bits(words))
            start = item_at + offset
            if not myers_end(held[0], len(words), text[max(0, start - budget) : max(0, start + len(words) + budget)], budget, True):
                return False
        return True

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best match of each item in a normal text."""
        stretches: dict[int, list[list[int]]] = {}
        if not self.pieces:
            return []
        for last, places in self.automaton.iter(text):
            for at, offset, size, runs in places:
                if not self._likely(text, last + 1 - size - offset, runs):
                    continue
                _, words, _, _, budget = self.items[at]
                start = max(0, last + 1 - size - offset - budget)
                end = min(len(text), last + 1 - size - offset + len(words) + budget)
                held = stretches.setdefault(at, [])
                if held and start <= held[-1][1] and max(end, held[-1][1]) - min(start, held[-1][0]) <= 3 * len(words):
                    held[-1] = [min(start, held[-1][0]), max(end, held[-1][1])]
                else:
                    held.append([start, end])
        found = []
        for at, held in stretches.items():
            item_id, words, forward, backward, budget = self.items[at]
            best = None
            for start, end in held:
                if end - start < len(words) - budget:
                    continue
                exact = text.find(words, start, end)
                got = (0, exact + len(words) - start) if exact >= 0 else myers_end(forward, len(words), text[start:end], budget)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], start, start + got[1])
                    if not got[0]:
                        break
            if best:
                edits, start, end = best
                back = myers_end(backward, len(words), text[start:end][::-1], edits) if edits else (0, len(words))
                found.append((item_id, edits, end - back[1], end))
        return found


def in_text(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in a text of spans of its normal form.  Some letters are several when lower-cased; their places are the letter's."""
    lower = text.lower()
    of = range(len(text) + 1) if len(lower) == len(text) else [*(i for i, c in enumerate(text) for _ in c.lower()), len(text)]
    starts, ends = [], []
    for m in WORDS.finditer(lower):
        starts += range(m.start(), m.end())
        ends += range(m.start() + 1, m.end() + 1)
        starts.append(m.end())
        ends.append(m.end())
    return [(of[starts[a]], of[ends[b - 1] - 1] + 1) for a, b in spans]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about BLOCK_BYTES; one empty block if there are none."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES) or 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        yield sorted((r[0], r[1]) for r in rows)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_edits, start_char, end_char."""
    out = None
    for items in _blocks(benchmark):
        found = _block(docs, items, rate)
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("n_edits", "start_char", "end_char")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _block(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    handed = docs.sparkSession.sparkContext.broadcast(items)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = Items(handed.value, rate)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                if isinstance(text, str) and (found := asked.matches(normal(text))):
                    places = in_text(text, [(a, b) for _, _, a, b in found])
                    rows += [(doc_id, i, edits, *span) for (i, edits, _, _), span in zip(found, places, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_edits", "start_char", "end_char"])

    return docs.select("doc_id", "text").mapInPandas(look, "doc_id long, item_id long, n_edits long, start_char long, end_char long")


def _leaks(handed, rate: float):
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        asked = Items(handed.value, rate)
        for texts in batches:
            yield pd.Series([bool(isinstance(t, str) and asked.matches(normal(t))) for t in texts], dtype="bool")

    look.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(look, "boolean")


def holds_any(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with a column ``leaks``, in place of one of that name: whether the text holds an item within its budget."""
    leaks = F.lit(False)
    for items in _blocks(benchmark):
        leaks = leaks | _leaks(docs.sparkSession.sparkContext.broadcast(items), rate)("text")
    return docs.withColumn("leaks", leaks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_batches(spark, 512)
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
