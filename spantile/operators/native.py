"""Patterns as DataFrame plans: what a pattern matches is a relation of keys, s and e, made by filters, windows and joins.

Rows of single-token items read their neighbours by ``lead`` in one window and never join; slots and back-references
become comparisons of bases there.  Repeats of a single-token item are runs of tokens (islands).  A ``_*`` is never made
into rows: it turns into ``>=`` in the join with the next item, or into the end of the text.  Rules that come back to
themselves, and repeats of several tokens, raise Unsupported: those go to the general matcher.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pattern import Any, Choice, Grammar, Ref, Repeat, Rule, Sequence, Text, Token
from .match import _recursive
from .tokens import FIELDS


class Unsupported(ValueError):
    """A pattern that has no plan of built-in operations."""


def text_test(test: Text, value: Column) -> Column:
    if test.kind == "exact":
        return value == test.value
    if test.kind == "suffix":
        return value.endswith(test.value)
    return value.rlike(f"(?U){test.value}")


def predicate(test: Token) -> Column:
    """All tests of a token but its back-reference, on the columns of parsed token rows."""
    out = [F.col(FIELDS[i]) == tag for i, tag in enumerate(test.path)]
    out += [text_test(t, F.col(c)) for t, c in ((test.surface, "surface"), (test.base, "base"), (test.form, "cform"), (test.conjugation, "ctype")) if t is not None]
    return F.coalesce(reduce(Column.__and__, out), F.lit(False)) if out else F.lit(True)


class Plan:
    """Plans over parsed token rows: keys, idx, surface and the feature's fields."""

    def __init__(self, tokens: DataFrame, keys: list[str], grammar: Grammar) -> None:
        self.tokens, self.keys, self.grammar = tokens, keys, grammar
        self.along = Window.partitionBy(*keys).orderBy("idx")

    def sizes(self) -> DataFrame:
        return self.tokens.groupBy(*self.keys).agg((F.max("idx") + 1).alias("n"))

    def everywhere(self) -> DataFrame:
        """The empty match at every place, the end included."""
        here = self.tokens.select(*self.keys, F.col("idx").alias("s"))
        return here.unionByName(self.sizes().select(*self.keys, F.col("n").alias("s"))).withColumn("e", F.col("s"))

    def relation(self, node) -> DataFrame:
        if isinstance(node, Token | Any):
            return self.row([node])
        if isinstance(node, Choice):
            return reduce(DataFrame.unionByName, map(self.relation, node.items)).distinct()
        if isinstance(node, Sequence):
            return self.sequence(list(node.items)) if node.items else self.everywhere()
        if isinstance(node, Ref):
            rule = self.grammar.rule(node.name)
            if rule is None:
                return self.everywhere().where(F.lit(False))
            if _recursive(self.grammar, node.name):
                raise Unsupported(f"rule {node.name!r} comes back to itself")
            return self.relation(rule.pattern)
        if node.sign == "?":
            return self.everywhere().unionByName(self.relation(node.item)).distinct()
        runs = self.runs(node.item)
        found = runs.select(*self.keys, "s", F.explode(F.sequence(F.col("s") + 1, F.col("end"))).alias("e"))
        return found if node.sign == "+" else self.everywhere().unionByName(found)

    def runs(self, item) -> DataFrame:
        """For each place where a single-token item holds, the end of the run of such tokens that it is in."""
        if not isinstance(item, Token | Any) or _slots(item):
            raise Unsupported("a repeat of several tokens, or of slots")
        held = self.tokens.where(predicate(item) if isinstance(item, Token) else F.lit(True))
        island = F.col("idx") - F.row_number().over(self.along)
        own = Window.partitionBy(*self.keys, "island")
        return held.withColumn("island", island).select(*self.keys, F.col("idx").alias("s"), (F.max("idx").over(own) + 1).alias("end"))

    def row(self, items: list) -> DataFrame:
        """Neighbouring single tokens."""
        marks: dict[str, Column] = {}
        conditions, slots = [], {}
        for i, item in enumerate(items):
            base = F.lead("base", i).over(self.along) if i else F.col("base")
            if isinstance(item, Token):
                marks[f"_p{i}"] = F.lead(predicate(item), i).over(self.along) if i else predicate(item)
                if item.back is not None:
                    marks[f"_p{i}"] = marks[f"_p{i}"] & (base == slots[item.back] if item.back in slots else F.lit(False))
            else:
                marks[f"_p{i}"] = F.lead(F.lit(True), i).over(self.along) if i else F.lit(True)
            if item.slot is not None:
                slots[item.slot] = base
            conditions.append(F.coalesce(F.col(f"_p{i}"), F.lit(False)))
        found = self.tokens.withColumns(marks).where(reduce(Column.__and__, conditions))
        return found.select(*self.keys, F.col("idx").alias("s"), (F.col("idx") + len(items)).alias("e"))

    def sequence(self, items: list, last: bool = False) -> DataFrame:
        """last: nothing follows, so of several ends the longest will do."""
        out, gap = None, None
        while items:
            n = next((i for i, x in enumerate(items) if not isinstance(x, Token | Any)), len(items))
            if n:
                part, items = self.row(items[:n]), items[n:]
            elif isinstance(items[0], Repeat) and isinstance(items[0].item, Any) and items[0].sign in "*+" and items[0].item.slot is None:
                gap = (gap or 0) + (items[0].sign == "+")
                items = items[1:]
                continue
            else:
                part, items = self.relation(items[0]), items[1:]
            if out is None and gap is None:
                out = part
                continue
            left = (out if out is not None else self.everywhere()).withColumnRenamed("e", "mid")
            if gap is not None and last and n and not items:
                # tokens at the very end, after a gap: of all their places the last one is the longest
                ends = part.groupBy(*self.keys).agg(F.max("s").alias("from"), F.max("e").alias("e"))
                return left.join(ends, self.keys).where(F.col("from") >= F.col("mid") + gap).select(*self.keys, "s", "e").distinct()
            part = part.withColumnRenamed("s", "from")
            near = F.col("from") == F.col("mid") if gap is None else F.col("from") >= F.col("mid") + gap
            out, gap = left.join(part, self.keys).where(near).select(*self.keys, "s", "e").distinct(), None
        if gap is None:
            return out
        left = out if out is not None else self.everywhere()
        open_ = left.join(self.sizes(), self.keys).where(F.col("e") + gap <= F.col("n"))
        # of an open end, the last place is the longest; the others matter where something may follow
        ends = F.col("n") if last else F.explode(F.sequence(F.col("e") + gap, F.col("n")))
        return open_.select(*self.keys, "s", ends.alias("e")).distinct()

    def longest(self, node) -> DataFrame:
        """For each start its longest end."""
        if isinstance(node, Repeat) and node.sign != "?":
            return self.runs(node.item).withColumnRenamed("end", "e")
        if isinstance(node, Sequence) and node.items and isinstance(last := node.items[-1], Repeat) and last.sign != "?" and isinstance(last.item, Token) and not _slots(last.item):
            if all(x == last.item for x in node.items[:-1]):
                # so many of the same in a row: runs that are long enough
                least = len(node.items) - (last.sign == "*")
                return self.runs(last.item).where(F.col("end") - F.col("s") >= least).withColumnRenamed("end", "e")
            # of a repeat at the end, its longest run is enough
            left = self.sequence(list(node.items[:-1]))
            runs = self.runs(last.item).withColumnRenamed("s", "e")
            held = left.join(runs, [*self.keys, "e"], "left" if last.sign == "*" else "inner")
            return held.groupBy(*self.keys, "s").agg(F.max(F.coalesce("end", "e")).alias("e")).where("e > s")
        found = self.sequence(list(node.items), last=True) if isinstance(node, Sequence) and node.items else self.relation(node)
        return found.where("e > s").groupBy(*self.keys, "s").agg(F.max("e").alias("e"))

    def find(self, rule: Rule) -> DataFrame:
        return leftmost(self.longest(rule.pattern), self.keys)


def _slots(node) -> bool:
    return node.slot is not None or isinstance(node, Token) and node.back is not None


def leftmost(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Of matches (keys, s, e), each text's leftmost ones that do not overlap: one fold over the sorted row."""
    kind = "array<struct<s: int, e: int>>"
    found = matches.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("ms"))
    keep = lambda held, m: F.when(F.size(held) == 0, F.array(m)).when(m["s"] >= F.element_at(held, -1)["e"], F.concat(held, F.array(m))).otherwise(held)
    return found.select(*keys, F.explode(F.aggregate("ms", F.array().cast(kind), keep)).alias("m")).select(*keys, "m.s", "m.e")


def find_native(tokens: DataFrame, keys: list[str], grammar: Grammar, rule: str) -> DataFrame:
    """keys, s and e of a rule's matches by built-in operations; ``tokens`` has the feature's fields as columns."""
    found = grammar.rule(rule)
    if found is None:
        return tokens.select(*keys, F.col("idx").alias("s"), F.col("idx").alias("e")).where(F.lit(False))
    if grammar.captures(found) and not (isinstance(found.pattern, Sequence) and all(isinstance(x, Token | Any) for x in found.pattern.items)):
        raise Unsupported("slots outside a row of single tokens")
    return Plan(tokens, keys, grammar).find(found)
