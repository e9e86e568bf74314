"""Grammars as they are used: find, find all, test, merge, and matches with all that belongs to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Grammar, PatternError, Rule, parse, parse_file
from ..sources.rules import rules_from_gz
from .inbatch import FOUND, find_all
from .inrow import matched, phrase_numbers
from .match import nested
from .resolve import level_number, span_of, spans_enough


@dataclass(frozen=True)
class PatternSet:
    """A grammar, and what can be asked of token rows (keys, idx, surface, feature) with it.  It never changes."""

    grammar: Grammar

    @classmethod
    def from_text(cls, text: str) -> PatternSet:
        try:
            return cls(parse(text))
        except PatternError as e:
            raise PatternError(f"Grammar parse error: {e}") from e

    @classmethod
    def from_file(cls, path: str) -> PatternSet:
        return cls(parse_file(path))

    @classmethod
    def from_gz(cls, data: bytes) -> PatternSet:
        return cls(rules_from_gz(data))

    def rule_names(self) -> list[str]:
        return self.grammar.names()

    def clone(self) -> PatternSet:
        return PatternSet(self.grammar)

    def merge(self, text: str) -> PatternSet:
        return PatternSet(self.grammar.merge(parse(text)))

    def set_max_span(self, rule: str, most: int) -> PatternSet:
        return PatternSet(self.grammar.with_max_span(rule, most))

    def rules(self, spark) -> DataFrame:
        """The rules as rows, in order."""
        rows = [(i, r.name, list(r.levels), r.description, r.connection, [(s, [tuple(t) for t in ts]) for s, ts in r.examples], r.max_span, self.grammar.captures(r)) for i, r in enumerate(self.grammar.rules)]
        examples = "array<struct<sentence: string, translations: array<struct<lang: string, text: string>>>>"
        return spark.createDataFrame(rows, f"ord int, rule string, levels array<string>, description string, connection string, examples {examples}, max_span int, captures boolean")

    def raw(self, tokens: DataFrame, keys: list[str], rules: list[str] | None = None) -> DataFrame:
        """keys, rule, ord, s, e and fixed of each rule's matches, or of those that are named."""
        found = matched(nested(tokens, keys), self.grammar, rules)
        return found.select(*keys, F.explode("matches").alias("m")).select(*keys, "m.rule", "m.ord", "m.s", "m.e", "m.fixed")

    def find(self, tokens: DataFrame, keys: list[str], rule: str) -> DataFrame:
        """The matches of one rule; of an unknown one there are none."""
        return self._told(matched(nested(tokens, keys), self.grammar, [rule]), keys)

    def test(self, tokens: DataFrame, keys: list[str], rule: str) -> DataFrame:
        """keys and ``hit`` of each text."""
        return matched(nested(tokens, keys), self.grammar, [rule]).select(*keys, (F.size("matches") > 0).alias("hit"))

    def find_all(self, tokens: DataFrame, keys: list[str]) -> DataFrame:
        """The matches of all rules that stay; those of a text in order of start, then of falling end.

        The tokens are nested once, and from there on the matches of many texts are found, resolved and placed together.
        """
        texts, grammar = nested(tokens, keys), self.grammar
        schema = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys) + f", {FOUND}"
        found = texts.mapInArrow(lambda batches: (x for batch in batches if len(batch) for x in find_all(grammar, batch, keys)), schema)
        rules = F.broadcast(self.rules(tokens.sparkSession).select("ord", "rule", "levels", "description", "connection", "examples"))
        return found.join(rules, "ord").select(*keys, "ord", "rule", "s", "e", "fixed", "nodes", "levels", "description", "connection", "examples", "chunk_s", "chunk_e", "span")

    def fits(self) -> Column:
        """Whether a row of ``find_all`` spans no more phrases than this set allows its rule; for one pass under several sets' limits."""
        level, most = self._by_rule(lambda r: level_number(r.levels), "int"), self._by_rule(lambda r: r.max_span, "int")
        return spans_enough(F.struct(F.get(level, F.col("ord")).alias("p"), "span"), F.get(most, F.col("ord")))

    def _by_rule(self, of: Callable[[Rule], object], kind: str) -> Column:
        """A value of each rule, by its place."""
        return F.array(*[F.lit(of(r)).cast(kind) for r in self.grammar.rules]) if self.grammar.rules else F.array().cast(f"array<{kind}>")

    def _told(self, texts: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of the matches in ``texts`` (keys, tokens, matches), with all that belongs to them."""
        level = self._by_rule(lambda r: level_number(r.levels), "int")
        texts = texts.withColumn("phrases", phrase_numbers(F.col("tokens")))
        # -1 stands for no level, which sorts first
        ordered = F.sort_array(F.transform("matches", lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("minus"), F.coalesce(F.get(level, m["ord"]), F.lit(-1)).alias("level"), m["ord"].alias("ord"), m["e"].alias("e"), m["rule"].alias("rule"), m["fixed"].alias("fixed"))))
        rules = F.broadcast(self.rules(texts.sparkSession).select("ord", "levels", "description", "connection", "examples"))
        rows = texts.withColumn("matches", ordered).select(*keys, "tokens", "phrases", F.posexplode("matches").alias("_place", "m"))
        rows = rows.select(*keys, "m.ord", "m.rule", "m.s", "m.e", "m.fixed", F.slice("tokens", F.col("m.s") + 1, F.col("m.e") - F.col("m.s")).alias("nodes"), F.get("phrases", F.col("m.s")).alias("chunk_s"), F.get("phrases", F.col("m.e") - 1).alias("chunk_e"))
        out = rows.join(rules, "ord").withColumn("span", span_of(F.col("chunk_s"), F.col("chunk_e")))
        return out.select(*keys, "ord", "rule", "s", "e", "fixed", "nodes", "levels", "description", "connection", "examples", "chunk_s", "chunk_e", "span")
