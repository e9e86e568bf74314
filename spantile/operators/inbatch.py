"""All matches of a grammar that stay, for the texts of an Arrow batch at once: patterns, levels and phrases as numbers by token.

The tokens of a batch lie one after another; each different one is tested once, rules of a plain shape (see ``inrow``) are
shifts of these flags, and others go through the general matcher text by text.  Time grows with tokens and matches, not with
their pairs: what lies under a more specific match, or within a longer one of its level, is told by running sums and maxima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..plans.pattern import Choice, Grammar, Ref, Repeat, Rule, Sequence
from .inrow import shape
from .match import Matcher, Tokens, token_holds
from .native import Unsupported
from .phrases import CONTENT, PUNCTUATION
from .resolve import NOISE, NOISE_SPAN, SPECIFIC, level_number

FOUND = "ord int, s int, e int, fixed array<int>, nodes array<struct<surface: string, feature: string>>, chunk_s int, chunk_e int, span int"


def possible(grammar: Grammar, node, met: frozenset = frozenset()) -> bool:
    """Whether a pattern can match anything, as far as references to rules that are not there tell."""
    if isinstance(node, Ref):
        rule = grammar.rule(node.name)
        return rule is not None and (node.name in met or possible(grammar, rule.pattern, met | {node.name}))
    if isinstance(node, Sequence):
        return all(possible(grammar, x, met) for x in node.items)
    if isinstance(node, Choice):
        return any(possible(grammar, x, met) for x in node.items)
    return not isinstance(node, Repeat) or node.sign != "+" or possible(grammar, node.item, met)


class Found:
    """The texts of a batch (``tokens``: a list of structs of surface and feature), and the matches in them by place in the batch."""

    def __init__(self, tokens: pa.ListArray) -> None:
        lengths = np.asarray(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        self.nodes = tokens.flatten()
        self.n = len(self.nodes)
        self.last = np.cumsum(lengths)
        self.first = self.last - lengths
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.end = self.last[self.text]
        coded = [self.nodes.field(name).dictionary_encode("encode") for name in ("surface", "feature")]
        surfaces, feats = (x.dictionary.to_pylist() for x in coded)
        of, feat = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in coded)
        pairs, self.kind = np.unique(of * max(1, len(feats)) + feat, return_inverse=True)
        self.kinds = [(surfaces[x // max(1, len(feats))], feats[x % max(1, len(feats))] or "") for x in pairs.tolist()]
        self.flags: dict = {}

    def by_kind(self, of, kind: type) -> np.ndarray:
        """A value of each token, worked out for each different one."""
        return np.array([of(*k) for k in self.kinds], kind)[self.kind] if self.kinds else np.zeros(0, kind)

    def holds(self, tests: tuple) -> np.ndarray:
        if tests not in self.flags:
            one = lambda s, f: any(token_holds(t, s, f) if s is not None or t.surface is None else False for t in tests)
            self.flags[tests] = self.by_kind(one, bool) if tests else np.ones(self.n, bool)
        return self.flags[tests]

    def ahead(self, values: np.ndarray, by: int) -> np.ndarray:
        """The values of the tokens that stand so far ahead; at the batch's end zeros."""
        return values if not by else np.concatenate([values[by:], np.zeros(min(by, self.n), values.dtype)])

    def spans(self, grammar: Grammar, rule: Rule) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
        """Starts and ends of a rule's matches, leftmost and longest; its single tokens, and those of them that tests read."""
        items, more, least = shape(grammar, rule)
        k, places = len(items), np.arange(self.n)
        read = [j for j, x in enumerate(items) if x.tests]
        run = run_end = None
        if more is not None:
            run = self.holds(more.tests)
            last = run & ~(self.ahead(run, 1) & (places + 1 < self.end))
            stops = np.flatnonzero(last) + 1
            run_end = stops[np.minimum(np.searchsorted(stops, places, "right"), max(0, len(stops) - 1))] if len(stops) else places
            if all(x == more for x in items):
                begin = np.flatnonzero(run & ~np.concatenate([[False], run[:-1] & (self.text[1:] == self.text[:-1])])) if self.n else places
                e = run_end[begin]
                kept = e - begin >= k + least
                return begin[kept], e[kept], k, read
        hit, slots = places + k <= self.end, {}
        for j, x in enumerate(items):
            if x.tests:
                hit &= self.ahead(self.holds(x.tests), j)
            if x.back is not None:
                hit &= self.ahead(self.bases(), j) == self.ahead(self.bases(), slots[x.back]) if x.back in slots else False
            if x.slot is not None:
                slots[x.slot] = j
        s = np.flatnonzero(hit)
        e = s + k
        if more is not None:
            goes = e < self.end[s]
            goes[goes] = run[e[goes]]
            e[goes] = run_end[e[goes]]
            if least:
                s, e = s[goes], e[goes]
        if k > 1 or more is not None:
            reach, kept = -1, []
            for i, (a, b) in enumerate(zip(s.tolist(), e.tolist(), strict=True)):
                if a >= reach:
                    kept.append(i)
                    reach = b
            s, e = s[kept], e[kept]
        return s, e, k, read

    def bases(self) -> np.ndarray:
        if "bases" not in self.flags:
            numbers: dict[str, int] = {}
            base = lambda _, f: numbers.setdefault(p[6] if len(p := f.split(",")) > 6 else "", len(numbers))
            self.flags["bases"] = self.by_kind(base, np.int64)
        return self.flags["bases"]

    def matches(self, grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """ord, start and end of all matches, and what their tests have read."""
        rows, general = [], []
        for i, r in enumerate(grammar.rules):
            try:
                s, e, k, read = self.spans(grammar, r)
                rows.append((np.full(len(s), i), s, e, [(k, read)] * len(s)))
            except Unsupported:
                if possible(grammar, r.pattern):
                    general.append((i, r))
        if general:
            known: dict = {}
            own = []
            for first, stop in zip(self.first.tolist(), self.last.tolist(), strict=True):
                told = [self.kinds[x] for x in self.kind[first:stop].tolist()]
                m = Matcher(grammar, Tokens([s for s, _ in told], [f for _, f in told], known))
                own += [(i, first + s, first + e, [first + x for x in fixed]) for i, r in general for s, e, fixed in m.find(r)]
            if own:
                rows.append((*(np.array([x[c] for x in own], np.int64) for c in range(3)), [x[3] for x in own]))
        ord_, s, e = (np.concatenate([np.zeros(0, np.int64), *[x[c] for x in rows]]).astype(np.int64) for c in range(3))
        return ord_, s, e, [y for x in rows for y in x[3]]

    def stay(self, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Places of the matches that stay after dominance, containment and noise (see ``resolve``); p is -1 without a level."""
        kept, covered = [], np.zeros(self.n + 1, np.int64)
        for level in np.unique(p).tolist():
            own = np.flatnonzero(p == level)
            if level >= 0:
                under = np.concatenate([[0], np.cumsum(np.cumsum(covered)[: self.n] > 0)])
                own = own[under[e[own]] == under[s[own]]]
            own = own[np.lexsort((-e[own], s[own]))]
            a, b = s[own], e[own]
            at = np.searchsorted(a, a, "left")  # the first, and longest, of each start
            before = np.where(at > 0, np.maximum.accumulate(b)[at - 1], -1) if len(own) else b
            own = own[(before < b) & (b[at] <= b)] if len(own) else own
            if level >= 0:
                np.add.at(covered, s[own], 1)
                np.add.at(covered, e[own], -1)
            kept.append(own)
        out = np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int64)
        loud = np.zeros(len(self.first), bool)
        loud[self.text[s[out[(p[out] >= 0) & (p[out] <= SPECIFIC)]]]] = True
        return out[~(loud[self.text[s[out]]] & (p[out] >= NOISE))]

    def phrases(self) -> np.ndarray:
        """The number of each token's phrase in its text; -1 for punctuation."""

        def one(_, f: str) -> int:
            pos0, pos1 = (f.split(",") + ["*"])[:2]
            return 2 if pos0 == PUNCTUATION else int(pos0 in CONTENT and pos1 not in CONTENT[pos0])

        kind = self.by_kind(one, np.int64)
        begins = np.concatenate([[True], self.text[1:] != self.text[:-1]])[: self.n]
        marked = np.concatenate([[True], kind[:-1] == 2])[: self.n]
        opened = np.cumsum((kind == 1) | (kind == 0) & (begins | marked))
        before = np.concatenate([[0], opened])[self.first]
        return np.where(kind == 2, -1, opened - before[self.text] - 1)


def find_all(grammar: Grammar, batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """keys and FOUND of the matches of a batch's texts (keys, tokens) that stay; those of a text by start, then by falling end."""
    found = Found(batch.column("tokens"))
    ord_, s, e, told = found.matches(grammar)
    numbers = [level_number(r.levels) for r in grammar.rules]
    levels = np.array([-1 if x is None else x for x in numbers], np.int64)
    kept = found.stay(levels[ord_], s, e)
    chunk = found.phrases()
    first, last = chunk[s[kept]], chunk[e[kept] - 1]
    span = np.where((first >= 0) & (last >= 0), last - first + 1, 0)
    most = np.array([r.max_span if r.max_span and r.max_span > 0 else NOISE_SPAN if (x or 0) >= NOISE else -1 for r, x in zip(grammar.rules, numbers, strict=True)], np.int64)[ord_[kept]]
    fit = (most < 0) | (span == 0) | (span <= most)
    kept, first, last, span = kept[fit], first[fit], last[fit], span[fit]
    order = np.lexsort((ord_[kept], levels[ord_[kept]], -e[kept], s[kept]))
    kept, first, last, span = kept[order], first[order], last[order], span[order]
    begin, stop = s[kept], e[kept]
    start = found.first[found.text[begin]]
    fixed = []
    for i, a, b, at in zip(kept.tolist(), begin.tolist(), stop.tolist(), start.tolist(), strict=True):
        x = told[i]
        fixed.append([a - at + j for j in x[1]] + list(range(a - at + x[0], b - at)) if isinstance(x, tuple) else [y - at for y in x])
    length = stop - begin
    offsets = np.concatenate([[0], np.cumsum(length)])
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length) + np.repeat(begin, length)
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found.nodes.take(pa.array(inside)))
    ints = lambda x: pa.array(x, pa.int32())
    own = [batch.column(k).take(pa.array(found.text[begin])) for k in keys]
    yield pa.RecordBatch.from_arrays([*own, ints(ord_[kept]), ints(begin - start), ints(stop - start), pa.array(fixed, pa.list_(pa.int32())), nodes, ints(first), ints(last), ints(span)], [*keys, "ord", "s", "e", "fixed", "nodes", "chunk_s", "chunk_e", "span"])
