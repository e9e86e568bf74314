"""The general matcher: all patterns, over the tokens of one text at a time, in Arrow batches.

``ends(pattern, i)`` is the set of places where a match that begins at i can end, as bits of a number; a match is the
longest one from the leftmost place, and the next is looked for after it.  ``trace`` is which tokens of a match a
token test has read, by the first way through the pattern, shortest parts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Any, Choice, Grammar, Ref, Repeat, Rule, Sequence, Token, parse

FIELDS = ("pos0", "pos1", "pos2", "pos3", "ctype", "cform", "base")
MATCH_SCHEMA = "rule string, ord int, s int, e int, fixed array<int>"
MATCHES = "array<struct<rule: string, ord: int, s: int, e: int, fixed: array<int>>>"


def features(feature: str) -> list[str]:
    return feature.split(",")


class Tokens:
    """Tokens of one text, with what each test says of them worked out once for each distinct token."""

    def __init__(self, surfaces: list[str], feats: list[str], known: dict) -> None:
        self.n, self.known = len(surfaces), known
        self.kinds = list(zip(surfaces, feats, strict=True))
        self.bases = [p[6] if len(p := f.split(",")) > 6 else "" for f in feats]

    def holds(self, test: Token, i: int) -> bool:
        key = (test, self.kinds[i])
        if (found := self.known.get(key)) is None:
            found = self.known[key] = token_holds(test, *self.kinds[i])
        return found


def token_holds(test: Token, surface: str, feature: str) -> bool:
    """All tests but the back-reference."""
    parts = feature.split(",")
    if tuple(parts[: len(test.path)]) != test.path:
        return False
    if test.surface is not None and not test.surface.holds(surface):
        return False
    for text, at in ((test.base, 6), (test.form, 5), (test.conjugation, 4)):
        if text is not None and not (at < len(parts) and text.holds(parts[at])):
            return False
    return True


class Matcher:
    """Matches of a grammar's rules in one text."""

    def __init__(self, grammar: Grammar, tokens: Tokens) -> None:
        self.grammar, self.tokens, self.n = grammar, tokens, tokens.n
        self.memo: dict = {}

    # -- without slots: sets of ends

    def ends(self, node, i: int, active: frozenset = frozenset()) -> int:
        """Bits of all ends of a match that begins at i."""
        key = (id(node), i)
        if not active and key in self.memo:
            return self.memo[key]
        found = self._ends(node, i, active)
        if not active:
            self.memo[key] = found
        return found

    def _ends(self, node, i: int, active: frozenset) -> int:
        if isinstance(node, Token):
            return 1 << (i + 1) if i < self.n and node.back is None and self.tokens.holds(node, i) else 0
        if isinstance(node, Any):
            return 1 << (i + 1) if i < self.n else 0
        if isinstance(node, Sequence):
            found = 1 << i
            for item in node.items:
                found = self._all(item, found, active)
                if not found:
                    break
            return found
        if isinstance(node, Choice):
            found = 0
            for item in node.items:
                found |= self.ends(item, i, active)
            return found
        if isinstance(node, Ref):
            rule = self.grammar.rule(node.name)
            if rule is None or (node.name, i) in active:
                return 0
            return self.ends(rule.pattern, i, active | {(node.name, i)} if _recursive(self.grammar, node.name) else active)
        if node.sign == "?":
            return 1 << i | self.ends(node.item, i, active)
        if isinstance(node.item, Any):
            every = (1 << (self.n + 1)) - (1 << i)
            return every if node.sign == "*" else every & ~(1 << i)
        first = self.ends(node.item, i, active)
        found = front = first & ~(1 << i)
        while front:
            front = self._all(node.item, front, active) & ~found
            found |= front
        return found | (1 << i if node.sign == "*" else first & 1 << i)

    def _all(self, item, places: int, active: frozenset) -> int:
        if isinstance(item, Repeat) and isinstance(item.item, Any) and item.sign == "*" and places:
            low = places & -places
            return (1 << (self.n + 1)) - low
        found = 0
        while places:
            low = places & -places
            found |= self.ends(item, low.bit_length() - 1, active)
            places ^= low
        return found

    def trace(self, node, s: int, e: int) -> tuple[int, ...] | None:
        """The tokens that tests have read in the first way from s to e; None: there is no way."""
        key = ("trace", id(node), s, e)
        if key not in self.memo:
            self.memo[key] = None
            self.memo[key] = self._trace(node, s, e)
        return self.memo[key]

    def _trace(self, node, s: int, e: int) -> tuple[int, ...] | None:
        if isinstance(node, Token):
            return (s,) if e == s + 1 and self.ends(node, s) else None
        if isinstance(node, Any):
            return () if e == s + 1 and s < self.n else None
        if isinstance(node, Choice):
            return next((t for x in node.items if (t := self.trace(x, s, e)) is not None), None)
        if isinstance(node, Ref):
            rule = self.grammar.rule(node.name)
            return None if rule is None else self.trace(rule.pattern, s, e)
        if isinstance(node, Sequence):
            return self._trace_row(node.items, 0, s, e)
        if s == e:
            return () if node.sign != "+" else None
        if node.sign == "?":
            return self.trace(node.item, s, e)
        return self._trace_more(node.item, s, e)

    def _trace_row(self, items: tuple, at: int, s: int, e: int) -> tuple[int, ...] | None:
        if at == len(items):
            return () if s == e else None
        key = ("row", id(items), at, s, e)
        if key not in self.memo:
            self.memo[key] = self._split(self.ends(items[at], s), s, e, lambda mid: self.trace(items[at], s, mid), lambda mid: self._trace_row(items, at + 1, mid, e))
        return self.memo[key]

    def _trace_more(self, item, s: int, e: int) -> tuple[int, ...] | None:
        key = ("more", id(item), s, e)
        if key not in self.memo:
            rest = lambda mid: () if mid == e else self._trace_more(item, mid, e)
            self.memo[key] = self._split(self.ends(item, s) & ~(1 << s), s, e, lambda mid: self.trace(item, s, mid), rest)
        return self.memo[key]

    def _split(self, ends: int, s: int, e: int, first, rest) -> tuple[int, ...] | None:
        ends &= (1 << (e + 1)) - 1
        while ends:
            low = ends & -ends
            mid = low.bit_length() - 1
            if (a := first(mid)) is not None and (b := rest(mid)) is not None:
                return a + b
            ends ^= low
        return None

    # -- with slots: places and what the slots hold

    def states(self, node, i: int, slots: tuple, active: frozenset = frozenset()) -> dict[tuple, None]:
        """(end, slots) of all matches that begin at i, in the order they are found."""
        if isinstance(node, Token):
            if i >= self.n or not self.tokens.holds(node, i):
                return {}
            base = self.tokens.bases[i]
            if node.back is not None and slots[node.back] != base:
                return {}
            return {(i + 1, slots if node.slot is None else _kept(slots, node.slot, base)): None}
        if isinstance(node, Any):
            if i >= self.n:
                return {}
            return {(i + 1, slots if node.slot is None else _kept(slots, node.slot, self.tokens.bases[i])): None}
        if isinstance(node, Sequence):
            found = {(i, slots): None}
            for item in node.items:
                found = {y: None for x in found for y in self.states(item, *x, active)}
            return dict.fromkeys(sorted(found, key=lambda x: x[0]))
        if isinstance(node, Choice):
            return dict.fromkeys(sorted({y: None for item in node.items for y in self.states(item, i, slots, active)}, key=lambda x: x[0]))
        if isinstance(node, Ref):
            rule = self.grammar.rule(node.name)
            if rule is None or (node.name, i) in active:
                return {}
            return self.states(rule.pattern, i, slots, active | {(node.name, i)})
        if node.sign == "?":
            return dict.fromkeys(sorted({(i, slots): None} | self.states(node.item, i, slots, active), key=lambda x: x[0]))
        first = self.states(node.item, i, slots, active)
        found = ({(i, slots): None} if node.sign == "*" else {}) | {x: None for x in first if node.sign == "+" or x[0] > i}
        front = [x for x in first if x[0] > i]
        while front:
            after = {y: None for x in front for y in self.states(node.item, *x, active) if y[0] > x[0] and y not in found}
            found |= after
            front = list(after)
        return dict.fromkeys(sorted(found, key=lambda x: x[0]))

    def slot_trace(self, node, s: int, e: int, slots: tuple) -> tuple[tuple[int, ...], tuple] | None:
        """As ``trace``, from slots that are set to begin with; also the slots at the end."""
        if isinstance(node, Token | Any):
            after = next((x[1] for x in self.states(node, s, slots) if x[0] == e), None)
            return None if after is None else ((s,) if isinstance(node, Token) else (), after)
        if isinstance(node, Choice):
            return next((t for x in node.items if (t := self.slot_trace(x, s, e, slots)) is not None), None)
        if isinstance(node, Ref):
            rule = self.grammar.rule(node.name)
            return None if rule is None else self.slot_trace(rule.pattern, s, e, slots)
        if isinstance(node, Sequence):
            return self._slot_row(list(node.items), s, e, slots)
        if s == e:
            return ((), slots) if node.sign != "+" else None
        if node.sign == "?":
            return self.slot_trace(node.item, s, e, slots)
        for mid in sorted({x[0] for x in self.states(node.item, s, slots) if s < x[0] <= e}):
            if (a := self.slot_trace(node.item, s, mid, slots)) is not None:
                b = ((), a[1]) if mid == e else self.slot_trace(Repeat(node.item, "*"), mid, e, a[1])
                if b is not None:
                    return a[0] + b[0], b[1]
        return None

    def _slot_row(self, items: list, s: int, e: int, slots: tuple) -> tuple[tuple[int, ...], tuple] | None:
        if not items:
            return ((), slots) if s == e else None
        for mid in sorted({x[0] for x in self.states(items[0], s, slots) if x[0] <= e}):
            if (a := self.slot_trace(items[0], s, mid, slots)) is not None and (b := self._slot_row(items[1:], mid, e, a[1])) is not None:
                return a[0] + b[0], b[1]
        return None

    # -- scans

    def find(self, rule: Rule) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, fixed) of a rule's matches: leftmost, longest, none within another."""
        slots, out, i = self.grammar.captures(rule), [], 0
        while i < self.n:
            if slots:
                states = list(self.states(rule.pattern, i, (None,) * 10))
                end, held = states[-1] if states else (i, None)
            else:
                end = self.ends(rule.pattern, i).bit_length() - 1
            if end > i:
                if slots:
                    traced = self.slot_trace(rule.pattern, i, end, held)
                    fixed = traced[0] if traced else ()
                else:
                    fixed = self.trace(rule.pattern, i, end) or ()
                out.append((i, end, tuple(sorted(set(fixed)))))
                i = end
            else:
                i += 1
        return out


def _kept(slots: tuple, at: int, base: str) -> tuple:
    return (*slots[:at], base, *slots[at + 1 :])


def _recursive(grammar: Grammar, name: str) -> bool:
    """Whether a rule can come back to itself."""
    met, left = set(), [name]
    while left:
        rule = grammar.rule(left.pop())
        nodes = [rule.pattern] if rule else []
        while nodes:
            node = nodes.pop()
            if isinstance(node, Ref):
                if node.name == name:
                    return True
                if node.name not in met:
                    met.add(node.name)
                    left.append(node.name)
            elif isinstance(node, Sequence | Choice):
                nodes += node.items
            elif isinstance(node, Repeat):
                nodes.append(node.item)
    return False


def match_texts(texts: DataFrame, grammar: Grammar, keys: list[str], rules: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Raw matches of each rule (or of the first rule of each given name) in ``texts``.

    texts: the key columns and ``tokens array<struct<surface, feature>>`` in order.  by: a column of ``texts`` that names the
    rule to be tried on each.  Returns the keys and MATCH_SCHEMA.
    """
    chosen = [(i, r) for i, r in enumerate(grammar.rules) if rules is None or (r.name in rules and grammar.rule(r.name) is r)]
    schema = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            rows = []
            for key, tokens, name in zip(batch[keys].itertuples(index=False), batch["tokens"], batch[by] if by else repeat(None), strict=False):
                m = Matcher(grammar, Tokens([t["surface"] for t in tokens], [t["feature"] or "" for t in tokens], known))
                rows += [(*key, r.name, i, s, e, list(fixed)) for i, r in chosen if by is None or r.name == name and grammar.rule(name) is r for s, e, fixed in m.find(r)]
            if len(known) > 1_000_000:
                known.clear()
            yield pd.DataFrame(rows, columns=[*keys, "rule", "ord", "s", "e", "fixed"])

    return texts.select(*keys, "tokens", *([by] if by else [])).mapInPandas(run, f"{schema}, {MATCH_SCHEMA}")


def tested(texts: DataFrame, keys: list[str], by: str, lines: str) -> DataFrame:
    """keys and ``hit``: whether the rule that ``by`` names matches a text, where ``lines`` holds that rule and all that it needs."""
    schema = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars: dict[str, Grammar] = {}
        known: dict = {}
        for batch in batches:
            hits = []
            for at in range(0, len(batch), 200):  # so that few texts are objects at once
                part = batch.slice(at, 200)
                nodes, stop = part.column("tokens").flatten(), 0
                surfaces, feats = (nodes.field(x).to_pylist() for x in ("surface", "feature"))
                for n, name, own in zip(part.column("tokens").value_lengths().to_pylist(), part.column(by).to_pylist(), part.column(lines).to_pylist(), strict=True):
                    start, stop, text = stop, stop + (n or 0), "\n".join(own)
                    if text not in grammars:
                        if len(grammars) >= 1_000:
                            grammars.clear()
                        grammars[text] = parse(text)
                    rule = grammars[text].rule(name)
                    m = Matcher(grammars[text], Tokens(surfaces[start:stop], [f or "" for f in feats[start:stop]], known))
                    hits.append(rule is not None and bool(m.find(rule)))
                if len(known) > 200_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(hits, pa.bool_())], [*keys, "hit"])

    return texts.select(*keys, "tokens", by, lines).mapInArrow(run, f"{schema}, hit boolean")


def match_column(surfaces: Column, features_: Column, grammar: Grammar, chosen: list[tuple[int, Rule]]) -> Column:
    """The raw matches of some rules (place and rule) in the tokens of a row, as an array."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict = {}
        for words, feats in batches:
            out = []
            for own, feat in zip(words, feats, strict=True):
                m = Matcher(grammar, Tokens(list(own), [f or "" for f in feat], known))
                out.append([{"rule": r.name, "ord": i, "s": s, "e": e, "fixed": list(fixed)} for i, r in chosen for s, e, fixed in m.find(r)])
            if len(known) > 1_000_000:
                known.clear()
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, MATCHES)(surfaces, features_)


def nested(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Token rows (keys, idx, surface, feature) as one row for each text."""
    found = F.sort_array(F.collect_list(F.struct("idx", "surface", "feature")))
    return tokens.groupBy(*keys).agg(F.transform(found, lambda t: F.struct(t["surface"].alias("surface"), t["feature"].alias("feature"))).alias("tokens"))
