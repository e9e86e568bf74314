"""Patterns over tokens that lie in one row: arrays in, arrays of matches out, and nothing is shuffled.

Each test becomes an array of booleans, worked out once for each token; a row of single tokens is a filter over its
places, and a repeat at the end reads the ends of the runs.  Patterns of other shapes raise Unsupported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Any, Choice, Grammar, Ref, Repeat, Rule, Sequence, Token
from .match import MATCHES, _recursive, match_column
from .native import Unsupported, text_test
from .phrases import PUNCTUATION, content
from .tokens import FIELDS, let

SPAN = "array<struct<s: int, e: int>>"
#: How a field of a token is read.
Field = Callable[[Column, str], Column]


def by_name(*names: str) -> Field:
    """Fields of tokens that are structs with these; what they lack is ``*``."""
    return lambda token, name: token[name] if name in names else F.lit("*")


def by_feature(token: Column, name: str) -> Column:
    """Fields of tokens with a feature record."""
    return token["surface"] if name == "surface" else F.get(F.split(token["feature"], ","), FIELDS.index(name))


@dataclass(frozen=True)
class Single:
    """One token: any of some tests, or a wildcard (no tests)."""

    tests: tuple[Token, ...]
    slot: int | None = None
    back: int | None = None

    def holds(self, token: Column, field: Field) -> Column:
        if not self.tests:
            return F.lit(True)
        return F.coalesce(reduce(Column.__or__, [_holds(t, token, field) for t in self.tests]), F.lit(False))


def _holds(test: Token, token: Column, field: Field) -> Column:
    out = [field(token, FIELDS[i]) == tag for i, tag in enumerate(test.path)]
    out += [text_test(t, field(token, c)) for t, c in ((test.surface, "surface"), (test.base, "base"), (test.form, "cform"), (test.conjugation, "ctype")) if t is not None]
    return reduce(Column.__and__, [F.coalesce(c, F.lit(False)) for c in out]) if out else F.lit(True)


def shape(grammar: Grammar, rule: Rule) -> tuple[list[Single], Single | None, int]:
    """The single tokens of a rule, what is repeated after them (or nothing) and how often that must be there."""
    items = _flat(grammar, rule.pattern)
    if not items:
        raise Unsupported("an empty pattern")
    if not isinstance(items[-1], Repeat):
        return [_single(grammar, x) for x in items], None, 0
    last = items[-1]
    more = _single(grammar, last.item)
    if last.sign == "?" or not more.tests or more.slot is not None or more.back is not None:
        raise Unsupported("a repeat that is not of one plain test")
    return [_single(grammar, x) for x in items[:-1]], more, int(last.sign == "+")


def _flat(grammar: Grammar, node) -> list:
    if isinstance(node, Sequence):
        return [y for x in node.items for y in _flat(grammar, x)]
    if isinstance(node, Ref):
        rule = grammar.rule(node.name)
        if rule is None or _recursive(grammar, node.name):
            raise Unsupported("a rule that is not known or comes back to itself")
        return _flat(grammar, rule.pattern)
    return [node]


def _single(grammar: Grammar, node) -> Single:
    if isinstance(node, Any):
        return Single((), node.slot)
    if isinstance(node, Token):
        return Single((node,), node.slot, node.back)
    if isinstance(node, Ref | Sequence):
        items = _flat(grammar, node)
        if len(items) == 1:
            return _single(grammar, items[0])
    if isinstance(node, Choice):
        found = [_single(grammar, x) for x in node.items]
        if all(x.tests and x.slot is None and x.back is None for x in found):
            return Single(tuple(t for x in found for t in x.tests))
    raise Unsupported("not one token")


def _places(n: Column) -> Column:
    """0 to n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _flags(tokens: Column, test: Single, field: Field) -> Column:
    return F.transform(tokens, lambda t: test.holds(t, field))


def spans(tokens: Column, field: Field, items: list[Single], more: Single | None, least: int) -> Column:
    """The leftmost matches, without overlap, of a shape in an array of tokens: array of s and e."""
    tests = list(dict.fromkeys([*items, *([more] if more else [])]))
    flags = F.array(*[_flags(tokens, x, field) for x in tests])
    at = {x: F.lit(i) for i, x in enumerate(tests)}
    bases = F.transform(tokens, lambda t: field(t, "base")) if any(x.back is not None or x.slot is not None for x in items) else F.array().cast("array<string>")
    k = len(items)

    def begins(held: Column, base: Column, i: Column) -> Column:
        """Whether the single tokens stand at place i."""
        out, slots = [F.get(F.get(held, at[x]), i + j) for j, x in enumerate(items) if x.tests], {}
        for j, x in enumerate(items):
            if x.back is not None:
                # as a capture has it, a token without a base has an empty one
                one = lambda y: F.coalesce(F.get(base, i + y), F.lit(""))  # noqa: B023, E731
                out.append(one(j) == one(slots[x.back]) if x.back in slots else F.lit(False))
            if x.slot is not None:
                slots[x.slot] = j
        return reduce(Column.__and__, out, F.lit(True))

    def plain(held: Column, base: Column) -> Column:
        starts = F.filter(_places(F.size(tokens) - k + 1), lambda i: begins(held, base, i))
        found = F.transform(starts, lambda i: F.struct(i.alias("s"), (i + k).alias("e")))
        return found if k == 1 else leftmost(found)

    def runs(run: Column) -> Column:
        """Whole runs of a test."""
        places = _places(F.size(run))
        first = F.filter(places, lambda i: F.get(run, i) & ~F.coalesce(F.when(i > 0, F.get(run, i - 1)), F.lit(False)))
        last = F.filter(places, lambda i: F.get(run, i) & ~F.coalesce(F.get(run, i + 1), F.lit(False)))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

    def repeated(held: Column, base: Column, run: Column) -> Column:
        if all(x == more for x in items):
            # so many of the same in a row
            return F.filter(runs(run), lambda r: r["e"] - r["s"] >= k + least)

        def longest(whole: Column) -> Column:
            starts = F.filter(_places(F.size(tokens) - k + 1), lambda i: begins(held, base, i) & (F.coalesce(F.get(run, i + k), F.lit(False)) if least else F.lit(True)))
            after = lambda i: F.when(F.coalesce(F.get(run, i + k), F.lit(False)), F.get(F.filter(whole, lambda r: r["e"] > i + k), 0)["e"]).otherwise(i + k)
            return leftmost(F.transform(starts, lambda i: F.struct(i.alias("s"), after(i).alias("e"))))

        return let(runs(run), longest)

    if more is None:
        return let(flags, lambda held: let(bases, lambda base: plain(held, base)))
    return let(flags, lambda held: let(bases, lambda base: let(F.get(held, at[more]), lambda run: repeated(held, base, run))))


def leftmost(found: Column) -> Column:
    """Of spans by start those that do not overlap, from the left."""
    keep = lambda held, m: F.when(F.size(held) == 0, F.array(m)).when(m["s"] >= F.element_at(held, -1)["e"], F.concat(held, F.array(m))).otherwise(held)
    return F.when(F.size(found) < 2, found).otherwise(F.aggregate(found, F.array().cast(SPAN), keep))


def matches(tokens: Column, grammar: Grammar, rule: Rule, field: Field = by_feature) -> Column:
    """The matches of a rule in an array of tokens: array of s, e and fixed (what a test has read)."""
    items, more, least = shape(grammar, rule)
    offsets = [j for j, x in enumerate(items) if x.tests]

    def fixed(m: Column) -> Column:
        own = F.array(*[m["s"] + j for j in offsets]) if offsets else F.array().cast("array<int>")
        if more is None:
            return own
        rest = F.when(m["e"] - m["s"] > len(items), F.sequence(m["s"] + len(items), m["e"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(own, rest)

    return F.transform(spans(tokens, field, items, more, least), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), fixed(m).alias("fixed")))


def matched(texts: DataFrame, grammar: Grammar, rules: list[str] | None = None) -> DataFrame:
    """``texts`` (with ``tokens`` of surface and feature) with ``matches``: array of rule, ord, s, e, fixed, rules in their order.

    Rules that have a shape are matched by built-in operations; the others by the general matcher, in Arrow batches.
    rules: names of which the first rule each is asked for; none: all rules.
    """
    chosen = [(i, r) for i, r in enumerate(grammar.rules) if rules is None or (r.name in rules and grammar.rule(r.name) is r)]
    found, general = [], []
    for i, r in chosen:
        try:
            found.append(_as_rule(matches(F.col("tokens"), grammar, r), r.name, i))
        except Unsupported:
            general.append((i, r))
    if general:
        found.append(match_column(F.transform("tokens", lambda t: t["surface"]), F.transform("tokens", lambda t: t["feature"]), grammar, general))
    none = F.array().cast(MATCHES)
    return texts.withColumn("matches", F.concat(*found) if len(found) > 1 else found[0] if found else none)


def _as_rule(found: Column, name: str, ord_: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("rule"), F.lit(ord_).alias("ord"), m["s"].alias("s"), m["e"].alias("e"), m["fixed"].alias("fixed")))


# ---------------------------------------------------------------- phrases


def phrase_spans(tokens: Column, field: Field = by_feature) -> Column:
    """The phrases of an array of tokens: array of s and e, in order."""
    kinds = F.transform(tokens, lambda t: F.when(F.coalesce(field(t, "pos0") == PUNCTUATION, F.lit(False)), 2).otherwise(content(field(t, "pos0"), field(t, "pos1")).cast("int")))

    def of(kind: Column) -> Column:
        places = _places(F.size(kind))
        mark = lambda i: F.coalesce(F.get(kind, i) == 2, F.lit(True))  # noqa: E731  beyond the end as well
        opens = lambda i: (F.get(kind, i) == 1) | (F.get(kind, i) == 0) & F.when(i == 0, True).otherwise(F.coalesce(F.get(kind, i - 1) == 2, F.lit(False)))
        first = F.filter(places, opens)
        last = F.filter(places, lambda i: (F.get(kind, i) != 2) & (mark(i + 1) | (F.get(kind, i + 1) == 1)))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

    return let(kinds, of)


def phrase_numbers(tokens: Column, field: Field = by_feature) -> Column:
    """For each token of an array the number of its phrase; -1 for punctuation."""

    def of(found: Column) -> Column:
        inside = F.flatten(F.transform(found, lambda p, c: F.transform(F.sequence(p["s"], p["e"] - 1), lambda i: F.struct(i.alias("i"), c.alias("c")))))
        marks = F.transform(F.filter(_places(F.size(tokens)), lambda i: F.coalesce(field(F.get(tokens, i), "pos0") == PUNCTUATION, F.lit(False))), lambda i: F.struct(i.alias("i"), F.lit(-1).alias("c")))
        return F.transform(F.sort_array(F.concat(inside, marks)), lambda x: x["c"])

    return let(phrase_spans(tokens, field), of)


def surface_of(tokens: Column, s: Column, e: Column) -> Column:
    return F.array_join(F.transform(F.slice(tokens, s + 1, e - s), lambda t: t["surface"]), "")
