"""Which of the matches of a text stay: by level, by containment, by noise and by how many phrases they span.

The first two go through a text's matches from the most specific on and keep what no kept match speaks against; that is
one fold over an array, inside the row, without a join of matches with matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import let

#: Levels up to this make others noise; levels from NOISE on are noise beside them.
SPECIFIC, NOISE = 2, 4
#: Phrases that a match of a noisy level may span where its rule sets no limit.
NOISE_SPAN = 2


def priority(levels: Column) -> Column:
    """The smallest number among levels ``N<number>`` up to 255; null if there is none."""
    numbers = F.transform(levels, lambda x: F.when(x.rlike(r"^N\+?[0-9]+$"), F.regexp_extract(x, r"^N\+?0*([0-9]{1,9})$", 1).try_cast("int")))
    return F.array_min(F.filter(numbers, lambda n: n.between(0, 255)))


def level_number(levels: tuple[str, ...]) -> int | None:
    """As ``priority``, of a rule's levels."""
    numbers = [int(m[1]) for x in levels if (m := re.fullmatch(r"N\+?([0-9]+)", x))]
    return min((n for n in numbers if n <= 255), default=None)


def resolved(ms: Column) -> Column:
    """The matches of one text (structs that begin with p, nl, s, ord, e, sorted) that stay after dominance, containment and noise."""

    def keep(held: Column, m: Column) -> Column:
        against = lambda a: ((a["p"] < m["p"]) & (m["s"] < a["e"]) & (m["e"] > a["s"])) | (a["p"].eqNullSafe(m["p"]) & (m["s"] >= a["s"]) & (m["e"] <= a["e"]) & (a["nl"] < m["nl"]))
        return F.when(F.exists(held, lambda a: F.coalesce(against(a), F.lit(False))), held).otherwise(F.concat(held, F.array(m)))

    def quiet(kept: Column) -> Column:
        loud = F.exists(kept, lambda a: F.coalesce(a["p"] <= SPECIFIC, F.lit(False)))
        return F.when(loud, F.filter(kept, lambda a: ~F.coalesce(a["p"] >= NOISE, F.lit(False)))).otherwise(kept)

    return let(F.aggregate(ms, F.filter(ms, lambda m: F.lit(False)), keep), quiet)


def resolve(matches: DataFrame, keys: list[str], rest: list[str] | None = None) -> DataFrame:
    """``matches`` (keys, ord, s, e, p and what ``rest`` names) that stay after dominance, containment and noise."""
    rest = rest or []
    one = F.struct("p", (F.col("s") - F.col("e")).alias("nl"), "s", "ord", "e", *rest)
    kept = matches.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("ms")).withColumn("ms", resolved(F.col("ms")))
    return kept.select(*keys, F.explode("ms").alias("m")).select(*keys, "m.ord", "m.s", "m.e", "m.p", *[f"m.{c}" for c in rest])


def span_of(first: Column, last: Column) -> Column:
    """How many phrases lie between two phrase numbers; 0 where either is punctuation (-1)."""
    return F.when((first >= 0) & (last >= 0), last - first + 1).otherwise(0)


def spanned(matches: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``matches`` with chunk_s and chunk_e (-1: punctuation) and span, from tokens with their ``chunk``."""
    places = tokens.select(*keys, "idx", F.coalesce("chunk", F.lit(-1)).alias("chunk"))
    first = places.select(*keys, F.col("idx").alias("s"), F.col("chunk").alias("chunk_s"))
    last = places.select(*keys, (F.col("idx") + 1).alias("e"), F.col("chunk").alias("chunk_e"))
    found = matches.join(first, [*keys, "s"], "left").join(last, [*keys, "e"], "left").fillna(-1, ["chunk_s", "chunk_e"])
    return found.withColumn("span", span_of(F.col("chunk_s"), F.col("chunk_e")))


def spans_enough(match: Column, max_span: Column) -> Column:
    """Whether a match (a struct with p and span) spans no more phrases than its rule, or its level, allows."""
    most = F.when(max_span > 0, max_span).when(F.coalesce(match["p"] >= NOISE, F.lit(False)), NOISE_SPAN)
    return most.isNull() | (match["span"] == 0) | (match["span"] <= most)


def within_span(matches: DataFrame, max_span: Column) -> DataFrame:
    """Matches (with p and span) that span no more phrases than their rule, or their level, allows."""
    return matches.where(spans_enough(F.struct("p", "span"), max_span))
