"""What is shown of matches: spans in brackets, matches by token, containment, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def of_rules(matches: DataFrame, names: list[str]) -> DataFrame:
    return matches.where(F.col("rule").isin(*names)) if names else matches


def bracketed(nodes: Column, fixed: Column, s: Column) -> Column:
    """The words of a match (``nodes``, of which the first stands at ``s``), those that a test has read in brackets."""
    one = lambda n, i: F.when(F.array_contains(fixed, i + s), F.concat(F.lit("["), n["surface"], F.lit("]"))).otherwise(n["surface"])
    return F.array_join(F.transform(nodes, one), " ")


def match_line(levels: Column, rule: Column, fixed: Column) -> Column:
    """A match in one line: levels, rule and the words that its tests have read."""
    pad = lambda x, n: F.concat(x, F.repeat(F.lit(" "), F.greatest(n - F.char_length(x), F.lit(0))))
    named = F.when(F.size(levels) > 0, F.array_join(levels, "/")).otherwise("N?")
    return F.concat_ws(" ", pad(named, 6), pad(rule, 30), F.concat(F.lit("fixed: "), F.array_join(fixed, " ")))


def fixed_surfaces(nodes: Column, fixed: Column, s: Column) -> Column:
    return F.transform(fixed, lambda i: F.element_at(nodes, (i - s + 1).cast("int"))["surface"])


def outermost(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that lie within no longer match of their text, whatever the levels.

    One sorted pass: by start, then by falling end, a match lies within an earlier one when an end before it reaches as far.
    """
    spans = matches.select(*keys, "s", "e").distinct()
    before = Window.partitionBy(*keys).orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    kept = spans.withColumn("reach", F.max("e").over(before)).where(F.col("reach").isNull() | (F.col("reach") < F.col("e"))).drop("reach")
    return matches.join(kept, [*keys, "s", "e"])


def by_token(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, rules (in order) and fixed of each token that a match covers; matches have ord, rule, s, e and fixed."""
    rows = matches.select(*keys, "ord", "rule", "fixed", F.explode(F.sequence("s", F.col("e") - 1)).alias("idx"))
    rules = F.transform(F.sort_array(F.collect_list(F.struct("ord", "rule"))), lambda x: x["rule"])
    return rows.groupBy(*keys, "idx").agg(rules.alias("rules"), F.bool_or(F.array_contains("fixed", F.col("idx"))).alias("fixed"))


def preview(examples: Column, most: int = 3) -> Column:
    """The first examples with their translations."""
    line = lambda x: F.concat_ws("  ", x["sentence"], F.nullif(F.array_join(F.transform(x["translations"], lambda t: t["text"]), " / "), F.lit("")))
    return F.transform(F.slice(examples, 1, most), line)
