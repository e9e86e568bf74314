"""Lattice tokenizer: the cheapest path of dictionary words and unknown words through a text, and the n cheapest.

After Kudo, Yamamoto and Matsumoto (EMNLP 2004): every dictionary word at every place is a node; where none begins, or
always for classes that ask for it, runs of one character class are unknown words; a path costs its words and the
connections between them.  The best costs are found forwards; the n best paths come from a search backwards that always
goes on with the path of the least total cost, which the forward costs give exactly.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.compiled import MOST_WORDS, Compiled

NODE = "id long, surface string, feature string, length int, rlength int, rc_attr int, lc_attr int, posid int, char_type int, stat int, isbest boolean, alpha double, beta double, prob double, wcost int, cost long"
VERSION = "0.996"


@dataclass(frozen=True)
class Entry:
    surface: str
    left: int
    right: int
    cost: int
    feature: str
    posid: int = 0


# Character classes of a lexicon without its own (name, first and last code point), and what an unknown word costs.
CLASSES = (
    ("HIRAGANA", 0x3041, 0x309F),
    ("KATAKANA", 0x30A0, 0x30FF),
    ("KANJI", 0x3400, 0x9FFF),
    ("NUMERIC", 0x30, 0x39),
    ("NUMERIC", 0xFF10, 0xFF19),
    ("ALPHA", 0x41, 0x5A),
    ("ALPHA", 0x61, 0x7A),
    ("ALPHA", 0xC0, 0x24F),
    ("SPACE", 0x20, 0x20),
    ("SPACE", 0x09, 0x0D),
    ("SPACE", 0x3000, 0x3000),
)
UNKNOWN = {
    "HIRAGANA": (12_000, "名詞,一般,*,*,*,*,*"),
    "KATAKANA": (9_000, "名詞,一般,*,*,*,*,*"),
    "KANJI": (10_000, "名詞,一般,*,*,*,*,*"),
    "NUMERIC": (4_000, "名詞,数,*,*,*,*,*"),
    "ALPHA": (6_000, "名詞,固有名詞,組織,*,*,*,*"),
    "SYMBOL": (8_000, "記号,一般,*,*,*,*,*"),
}
#: Classes whose runs are one unknown word, also where the dictionary has words.
RUNS = ("KATAKANA", "NUMERIC", "ALPHA")
#: Characters that an unknown word of a whole run has at most, where a lexicon is not told otherwise.
LONGEST_RUN = 24
BOS = "BOS/EOS,*,*,*,*,*,*,*,*"


@dataclass(frozen=True)
class Kind:
    """A character's classes (bits), the first of them, and how unknown words that begin with it are made."""

    classes: int
    first: int
    invoke: bool
    group: bool
    length: int

    def akin(self, other: Kind) -> bool:
        return bool(self.classes & other.classes)


class Characters:
    """Kinds of characters by code point."""

    def __init__(self, names: list[str], kinds: Callable[[int], Kind]) -> None:
        self.names, self.kinds, self.known = names, kinds, {}
        self.space = 1 << names.index("SPACE")

    def ranges(self) -> list[tuple[int, int, Kind]] | None:
        """First and last code point of stretches of one kind; none where the kinds' bounds are not known."""
        if self.kinds is _plain_kind:
            bounds = [c for _, low, high in CLASSES for c in (low, high + 1)]
        elif isinstance(self.kinds, _TableKinds):
            bounds = self.kinds.bounds()
        else:
            return None
        bounds = sorted({0, *(c for c in bounds if c < 0x110000)})
        return [(low, high - 1, self.kinds(low)) for low, high in zip(bounds, [*bounds[1:], 0x110000], strict=True)]

    def of(self, c: str) -> Kind:
        if (found := self.known.get(c)) is None:
            found = self.known[c] = self.kinds(ord(c))
        return found

    def __getstate__(self):
        return self.names, self.kinds

    def __setstate__(self, state):
        self.__init__(*state)


def _plain_kind(code: int) -> Kind:
    name = next((name for name, low, high in CLASSES if low <= code <= high), "SYMBOL")
    at = _PLAIN.index(name)
    return Kind(1 << at, at, name in RUNS, name in RUNS, 0 if name in RUNS else 1)


_PLAIN = [*UNKNOWN, "SPACE"]


@dataclass(frozen=True)
class _TableKinds:
    """Kinds by the records of a compiled dictionary; beyond the table, that of the first code point."""

    table: np.ndarray

    def bounds(self) -> list[int]:
        """Code points from which on the kind may be another, but for that of 0."""
        return [*(np.flatnonzero(np.diff(self.table)) + 1).tolist(), len(self.table)]

    def __call__(self, code: int) -> Kind:
        x = int(self.table[code if code < len(self.table) else 0])
        return Kind(x & 0x3FFFF, x >> 18 & 0xFF, bool(x >> 31), bool(x >> 30 & 1), x >> 26 & 15)


@dataclass
class Lexicon:
    """Dictionary words, connection costs by (right id of the first, left id of the second), characters, and options.

    partial: texts are lines, ``surface<tab>feature`` for a word that is given (``*``: any feature) and plain ones for
    stretches whose ends alone are.  theta: how sharply costs become probabilities, where ``marginal`` asks for these.
    longest_run: characters that an unknown word of a whole run has at most, a longer run being cut up; none: all runs
    are whole.
    """

    entries: list[Entry]
    matrix: dict[tuple[int, int], int] | np.ndarray = field(default_factory=dict)
    partial: bool = False
    theta: float = 0.75
    marginal: bool = False
    characters: Characters = field(default_factory=lambda: Characters(_PLAIN, _plain_kind))
    unknown: dict[str, list[Entry]] | None = None
    longest_run: int | None = LONGEST_RUN

    def __post_init__(self) -> None:
        self.theta = float(np.float32(self.theta))
        if self.unknown is None:
            self.unknown = {name: [Entry(name, 0, 0, cost, feature)] for name, (cost, feature) in UNKNOWN.items()}
        self.by_surface: dict[str, list[Entry]] = {}
        for e in self.entries:
            self.by_surface.setdefault(e.surface, []).append(e)
        self.longest = max(map(len, self.by_surface), default=0)

    @classmethod
    def opened(cls, compiled: Compiled, **options) -> Lexicon:
        """Of a compiled dictionary."""
        entry = lambda w: Entry(w.surface, w.left, w.right, w.cost, w.feature, w.posid)
        names = [c.name for c in compiled.categories]
        return cls([entry(w) for w in compiled.words], np.ascontiguousarray(compiled.matrix.T), characters=Characters(names, _TableKinds(compiled.characters)), unknown={n: [entry(w) for w in own] for n, own in compiled.unknown.items()}, **options)

    @classmethod
    def of_table(cls, rows: DataFrame, **options) -> Lexicon:
        """Of a table of surface, left_id, right_id, cost and feature; its size is checked, as every worker gets it."""
        if rows.count() > MOST_WORDS:
            raise ValueError(f"a lexicon of more than {MOST_WORDS} words is not handed to the workers")
        return cls([Entry(r["surface"], r["left_id"], r["right_id"], r["cost"], r["feature"]) for r in rows.orderBy("surface", "left_id", "right_id", "cost", "feature").collect()], **options)

    def connection(self, right: int, left: int) -> int:
        return int(self.matrix[right, left]) if isinstance(self.matrix, np.ndarray) else self.matrix.get((right, left), 0)

    def stretches(self) -> re.Pattern | None:
        """Runs of characters of linked classes (such that a character of one may be akin to one of the other), and the character 0 alone.

        Runs that can only be blanks are left out.
        """
        ranges = self.characters.ranges()
        if ranges is None:
            return None
        linked: list[int] = []
        for bits in {kind.classes for _, _, kind in ranges}:
            for other in [x for x in linked if x & bits]:
                linked.remove(other)
                bits |= other
            linked.append(bits)
        sets: dict[int, str] = {}
        for low, high, kind in ranges:
            if high > 0:
                group = next((x for x in linked if x & kind.classes), 0)
                sets[group] = sets.get(group, "") + f"\\U{max(low, 1):08x}-\\U{high:08x}"
        blank = {x for x in linked if all(kind.classes & self.characters.space for _, _, kind in ranges if kind.classes & x)}
        return re.compile("\0|" + "|".join(f"[{x}]+" for group, x in sets.items() if group not in blank))

    def at(self, text: str, i: int) -> list[tuple[Entry, int]]:
        """Words that begin at a place, and their kind (0 known, 1 unknown)."""
        found = [(e, 0) for n in range(1, min(self.longest, len(text) - i) + 1) for e in self.by_surface.get(text[i : i + n], ())]
        kind = self.characters.of(text[i])
        if found and not kind.invoke:
            return found
        stops = []
        j = i + 1
        while j < len(text) and kind.akin(self.characters.of(text[j])):
            j += 1
        if kind.group and (self.longest_run is None or j - i <= self.longest_run):
            stops.append(j)
        stops += [n for n in range(i + 1, min(j, i + kind.length) + 1) if n not in stops]
        if not found and not stops:
            stops = [i + 1]
        name = self.characters.names[kind.first]
        return found + [(replace(e, surface=text[i:stop]), 1) for stop in stops for e in self.unknown.get(name, ())]

    def paths(self, text: str, n: int = 1) -> Iterator[list[Node]]:
        """The n cheapest paths, cheapest first."""
        if "\0" in text:
            raise ValueError("a text cannot hold the character 0")
        text, given, inside = stated(text) if self.partial else (text, {}, frozenset())
        size = len(text)
        cuts = sorted({c for a, (b, _) in given.items() for c in (a, b)})
        # nodes: (entry, kind, begin, real begin, best cost up to its end)
        ending: list[list[tuple]] = [[] for _ in range(size + 1)]
        ending[0].append((Entry("", 0, 0, 0, BOS), 2, 0, 0, 0))
        for i in range(size):
            if not ending[i]:
                continue
            j = i
            while j < size and (j not in given or given[j][1] is None) and self.characters.of(text[j]).classes & self.characters.space:
                j += 1
            if j == size:
                ending[size] += ending[i]
                continue
            found = self.at(text, j)
            if self.partial:
                found = self._within(found, text, j, given, inside, cuts)
            for entry, kind in found:
                cost = min(p[4] + self.connection(p[0].right, entry.left) for p in ending[i]) + entry.cost
                ending[j + len(entry.surface)].append((entry, kind, i, j, cost))
        told = self._marginals(ending) if self.marginal else {}
        tie = 0
        heap = [(p[4] + self.connection(p[0].right, 0), (tie := tie + 1), self.connection(p[0].right, 0), (p, None)) for p in ending[size]]
        heapq.heapify(heap)
        while heap and n:
            _, _, behind, path = heapq.heappop(heap)
            node = path[0]
            if node[1] == 2:
                n -= 1
                out, left, total = [], path[1], 0
                before = node
                while left is not None:
                    p, left = left
                    total += self.connection(before[0].right, p[0].left) + p[0].cost
                    out.append(Node(p[0], p[1], p[3], total, *told.get(id(p), (0.0, 0.0, 0.0))))
                    before = p
                yield out
                continue
            behind += node[0].cost
            for p in ending[node[2]]:
                link = self.connection(p[0].right, node[0].left)
                heapq.heappush(heap, (p[4] + link + behind, (tie := tie + 1), link + behind, (p, path)))

    def _within(self, found: list, text: str, at: int, given: dict, inside: frozenset, cuts: list[int]) -> list:
        """Words that break none of what is given; where a word is given that none is, one of that feature."""
        if at in given and given[at][1] is not None:
            end, feature = given[at]
            own = [(e, k) for e, k in found if at + len(e.surface) == end and fits(e.feature, feature)]
            kinds = self.unknown.get(self.characters.names[self.characters.of(text[at]).first], ())
            return own or [(Entry(text[at:end], e.left, e.right, e.cost, e.feature if feature == "*" else feature), 1) for e in (kinds or [Entry("", 0, 0, 0, BOS)])[:1]]
        after = bisect_right(cuts, at)
        stop = cuts[after] if after < len(cuts) else len(text)
        kept = [(e, k) for e, k in found if at + len(e.surface) <= stop and at + len(e.surface) not in inside]
        return kept or [(replace(e, surface=text[at:stop]), 1) for e in [*self.unknown.get(self.characters.names[self.characters.of(text[at]).first], ()), Entry("", 0, 0, 0, BOS)][:1]]

    def _marginals(self, ending: list[list[tuple]]) -> dict[int, tuple[float, float, float]]:
        """alpha, beta and the probability of each node, by its id."""
        alpha: dict[int, float] = {}
        for nodes in ending:
            for p in nodes:
                if id(p) not in alpha:
                    alpha[id(p)] = 0.0 if p[1] == 2 else _log_sum([alpha[id(b)] - self.theta * (self.connection(b[0].right, p[0].left) + p[0].cost) for b in ending[p[2]]])
        last = [(alpha[id(p)] - self.theta * self.connection(p[0].right, 0), p) for p in ending[-1]]
        total = _log_sum([x for x, _ in last])
        after: dict[int, list[float]] = {}
        for _, p in last:
            after.setdefault(id(p), []).append(-self.theta * self.connection(p[0].right, 0))
        beta: dict[int, float] = {}
        for p in sorted({id(p): p for nodes in ending for p in nodes}.values(), key=lambda p: (-p[3] - len(p[0].surface), -p[3])):
            beta[id(p)] = _log_sum(after.get(id(p), [])) if id(p) in after else -math.inf
            if p[1] != 2 and beta[id(p)] > -math.inf:
                for b in ending[p[2]]:
                    after.setdefault(id(b), []).append(beta[id(p)] - self.theta * (self.connection(b[0].right, p[0].left) + p[0].cost))
        return {i: (alpha[i], beta[i], math.exp(min(0.0, alpha[i] + beta[i] - total))) for i in alpha}


class Node(NamedTuple):
    """A word of a path: its entry, its kind, where it begins, the path's cost up to it, and its marginals."""

    entry: Entry
    kind: int
    begin: int
    cost: int
    alpha: float = 0.0
    beta: float = 0.0
    prob: float = 0.0


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def stated(text: str) -> tuple[str, dict[int, tuple[int, str | None]], frozenset[int]]:
    """A partly analysed text: the plain one, and by its begin each line's end and feature (none: a free stretch); places inside words."""
    plain, given, inside = "", {}, set()
    for line in text.split("\n"):
        if line == "EOS" or not line:
            continue
        surface, tab, feature = line.partition("\t")
        at, plain = len(plain), plain + surface
        if surface:
            given[at] = (len(plain), feature if tab else None)
            if tab:
                inside.update(range(at + 1, len(plain)))
    return plain, given, frozenset(inside)


def fits(feature: str, asked: str) -> bool:
    """Whether a record has the fields that are asked for; ``*`` in either is any, and the shorter one decides."""
    return all("*" in (a, b) or a == b for a, b in zip(feature.split(","), asked.split(","), strict=False))


def printed_path(path: list[Node]) -> str:
    return "".join(f"{x.entry.surface}\t{x.entry.feature}\n" for x in path) + "EOS\n"


def tokenized(texts: DataFrame, keys: list[str], text: str, lexicon: Lexicon, n: int = 1) -> DataFrame:
    """The n cheapest paths of each text as rows: keys, rank (from 1), idx and the columns of NODE."""
    handed = texts.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys) + f", rank int, idx int, {NODE}"
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, said in zip(batch[keys].itertuples(index=False), batch[text], strict=True):
                for rank, path in enumerate(handed.value.paths(said or "", n), 1):
                    end, plain = 0, stated(said or "")[0] if handed.value.partial else said or ""
                    for idx, x in enumerate(path):
                        e = x.entry
                        size = len(e.surface.encode())
                        gap = len(plain[end : x.begin].encode())
                        end = x.begin + len(e.surface)
                        kind = handed.value.characters.of(e.surface[0]).first
                        rows.append((*key, rank, idx, idx + 1, e.surface, e.feature, size, size + gap, e.right, e.left, e.posid, kind, x.kind, rank == 1, x.alpha, x.beta, x.prob, e.cost, x.cost))
            yield pd.DataFrame(rows, columns=[*keys, "rank", "idx", *names])

    return texts.select(*keys, text).mapInPandas(run, schema)


class Pieces(dict):
    """Numbers of pieces of text with one path each, whatever stands beside them: what a piece gives is worked out once.

    No word goes beyond a run of characters whose classes are linked, but for words of the dictionary, so texts are cut into
    such runs (partly given ones: into lines).  A run with one word at every place that its path comes to is the same in
    every text.  ``HARD`` is the number of all others: texts that hold them are searched as a whole.
    """

    END, HARD = 0, 1
    #: Pieces and characters that are kept at most between two batches.
    MOST, MOST_CHARS = 200_000, 8_000_000

    def __init__(self, lexicon: Lexicon, printed: bool = False) -> None:
        """printed: ``words`` has each piece's words in print."""
        self.lexicon, self.printed, self.features = lexicon, printed, {}
        self.cut = None if lexicon.partial else lexicon.stretches()
        surfaces = [s for s in lexicon.by_surface if len(s) > 1]
        if lexicon.partial:
            self.begun = {s[:n] for s in surfaces for n in range(1, len(s))}
        elif self.cut:
            self.begun = {s[:n] for s in surfaces for n in range(1, len(s)) if len(self.cut.findall(s[n - 1 : n + 1])) > 1}
        self.first = {s[0] for s in lexicon.by_surface if s}
        kinds = {kind for _, _, kind in lexicon.characters.ranges() or ()}
        self.alone = {k for k in kinds if not any(k.akin(other) for other in kinds if other != k)}
        self.plain: dict[str, Entry | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.size, self.chars = 2, 0
        self.words, self.values = ["", ""], np.zeros((4, 1024), np.int64)  # words, bytes, cost, place of the features
        self.features.clear()
        self.features[()] = 0
        self["\0"] = self.END

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The numbers of the pieces of some texts, and END after each."""
        if self.size > self.MOST or self.chars > self.MOST_CHARS:
            self._reset()
        if self.lexicon.marginal or self.cut is None and not self.lexicon.partial:
            return np.tile((self.HARD, self.END), len(texts))
        if any("\0" in t for t in texts):
            raise ValueError("a text cannot hold the character 0")
        found = "".join([t + "\n\0\n" for t in texts]).split("\n")[:-1] if self.lexicon.partial else self.cut.findall("".join([t + "\0" for t in texts]))
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def __missing__(self, piece: str) -> int:
        self.chars += len(piece)
        surface, _, feature = piece.partition("\t") if self.lexicon.partial else (piece, "", None)
        plain = self._plain(surface[0]) if surface else None
        if plain and (feature == plain.feature if self.lexicon.partial else self.lexicon.longest_run is None or len(piece) <= self.lexicon.longest_run):
            sums, own = (1, len(surface.encode()), plain.cost), (plain.feature,)
            words = f"{surface}\t{plain.feature}\n" if self.printed else ""
        else:
            found = self._given(piece) if self.lexicon.partial else self._path(piece)
            if found is None:
                self[piece] = self.HARD
                return self.HARD
            sums, own = (len(found), sum(len(e.surface.encode()) for e in found), sum(e.cost for e in found)), tuple(sorted({e.feature for e in found}))
            words = "".join(f"{e.surface}\t{e.feature}\n" for e in found) if self.printed else ""
        number = self[piece] = self.size
        self.size += 1
        if number == self.values.shape[1]:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)], 1)
        self.values[:, number] = *sums, self.features.setdefault(own, len(self.features))
        self.words.append(words)
        return number

    def _plain(self, c: str) -> Entry | None:
        """The one unknown word of runs that begin with a character; none where there may be more, or others, or parts of runs.

        Of a given word its kind is asked alone: where its feature is that of the unknown word, it costs the same either way.
        """
        if c not in self.plain:
            of = self.lexicon.characters
            kind = of.of(c)
            own = self.lexicon.unknown.get(of.names[kind.first], ())
            runs = self.lexicon.partial or kind in self.alone and kind.group and not kind.length and not kind.classes & of.space
            self.plain[c] = own[0] if len(own) == 1 and c not in self.first and runs else None
        return self.plain[c]

    def _path(self, piece: str) -> list[Entry] | None:
        """The words of a run, where there is no choice."""
        of, i, out = self.lexicon.characters, 0, []
        spaces = [bool(of.of(c).classes & of.space) for c in piece]
        if any(spaces):
            return [] if all(spaces) else None
        while i < len(piece):
            found = self.lexicon.at(piece, i)
            if len(found) != 1 or piece[i:] in self.begun:
                return None
            out.append(found[0][0])
            i += len(out[-1].surface)
        return out

    def _given(self, line: str) -> list[Entry] | None:
        """The word that a line gives, where it is the same whether or not the next one goes on with the same class."""
        surface, tab, feature = line.partition("\t")
        if not surface or line == "EOS":
            return []
        if not tab or surface in self.begun:
            return None
        given = {0: (len(surface), feature)}
        alone, beside = (self.lexicon._within(self.lexicon.at(t, 0), t, 0, given, frozenset(), []) for t in (surface, surface + surface[0]))
        told = lambda found: [(e.surface, e.feature, e.cost) for e, _ in found]
        return [alone[0][0]] if len(alone) == len(beside) == 1 and told(alone) == told(beside) else None


class Runs:
    """Sums of texts, of which runs of characters with one way to be cut are counted by their code points; other runs are pieces."""

    #: How a class of linked characters is cut: in pieces to be asked for, not at all, by character, in whole runs.
    ASK, BLANK, EACH, WHOLE = range(4)

    def __init__(self, lexicon: Lexicon) -> None:
        self.pieces, self.lexicon = Pieces(lexicon), lexicon
        self.known = None
        ranges = lexicon.characters.ranges()
        if lexicon.partial or lexicon.marginal or ranges is None:
            return
        kinds = list(dict.fromkeys(kind for _, _, kind in ranges))
        group, self.known = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
        #: Of each group: how it is cut, the cost of its word and its feature; of the character 0, and of all that must be asked for.
        self.ways, self.costs, self.names, place = [self.BLANK, self.ASK], [0, 0], ["", ""], {}
        for kind in kinds[:200]:
            own = lexicon.unknown.get(lexicon.characters.names[kind.first], ())
            if kind.classes & lexicon.characters.space:
                way = self.BLANK
            else:
                way = self.WHOLE if kind.group and not kind.length else self.EACH if not kind.group and kind.length == 1 else self.ASK
            if kind in self.pieces.alone and way != self.ASK and (way == self.BLANK or len(own) == 1):
                place[kind] = len(self.ways)
                self.ways.append(way)
                self.costs.append(own[0].cost if own else 0)
                self.names.append(own[0].feature if own else "")
        for low, high, kind in ranges:
            group[low : high + 1] = place.get(kind, 1)
        group[0] = 0
        self.group = group
        self.known[[ord(c) for c in self.pieces.first]] = True
        self.ways, self.costs = np.array(self.ways), np.array(self.costs)

    def sums(self, texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Words, bytes and costs of each row, and its features; texts have the rows' numbers, in order."""
        if self.known is None:
            return self._by_pieces(texts, rows)
        if any("\0" in t for t in texts):
            raise ValueError("a text cannot hold the character 0")
        size = int(rows[-1]) + 1
        said = "\0".join(texts) + "\0"
        codes = np.frombuffer(said.encode("utf-32-le"), np.uint32)
        group = self.group[codes]
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (group[1:] == 0)]))
        own = group[starts]
        text = np.cumsum(own == 0) - (own == 0)
        way, length = self.ways[own], np.diff(starts, append=len(codes))
        n = np.where(way == self.WHOLE, 1, length)
        n[(way == self.BLANK) | (own == 0)] = 0
        wide = (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        n_bytes = np.where(n > 0, length + np.add.reduceat(wide, starts, dtype=np.int64), 0)
        ask = way == self.ASK
        if self.known.any():
            known = self.known[codes]
            if known.any():
                ask |= (way == self.WHOLE) & known[starts] | (way == self.EACH) & np.logical_or.reduceat(known, starts)
        if self.lexicon.longest_run is not None:
            ask |= (way == self.WHOLE) & (length > self.lexicon.longest_run)
        # texts with a run that must be asked for go by their pieces
        others = np.unique(text[ask])
        if len(others):
            left = np.isin(text, others)
            n[left] = n_bytes[left] = 0
            own = np.where(left, 0, own)
        row = rows[text]
        sums = [n, n_bytes, n * self.costs[own]]
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total = np.stack([np.add.reduceat(x, edges) for x in sums])
        kinds = len(self.names)
        some = n > 0
        seen = np.flatnonzero(np.bincount(row[some] * kinds + own[some], minlength=1))
        features: list[set[str]] = [set() for _ in range(size)]
        for x in seen.tolist():
            features[x // kinds].add(self.names[x % kinds])
        if len(others):
            places, again = np.unique(rows[others], return_inverse=True)
            more, named = self._by_pieces([texts[i] for i in others.tolist()], again)
            total[:, places] += more
            for i, found in zip(places.tolist(), named, strict=True):
                features[i] |= found
        return total, features

    def _by_pieces(self, texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        pieces = self.pieces
        found = pieces.numbers(texts)
        ends = found == Pieces.END
        at = np.cumsum(ends) - ends  # the text of each piece
        hard = np.unique(at[found == Pieces.HARD])
        if len(hard):
            found[np.isin(at, hard) & ~ends] = Pieces.HARD
        row, names = rows[at], list(pieces.features)
        values = pieces.values[:, found]
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total = np.add.reduceat(values[:3], edges, axis=1)
        features: list[set[str]] = [set() for _ in range(len(edges))]
        for x in np.unique(row * len(names) + values[3]).tolist():
            features[x // len(names)].update(names[x % len(names)])
        for i in hard.tolist():
            path = next(self.lexicon.paths(texts[i]))
            total[:, rows[i]] += len(path), sum(len(x.entry.surface.encode()) for x in path), sum(x.entry.cost for x in path)
            features[rows[i]] |= {x.entry.feature for x in path}
        return total, features


def sums(texts: DataFrame, keys: list[str], text: str, lexicon: Lexicon) -> DataFrame:
    """keys, words (n), their bytes and costs (n_bytes, wcost) and their different features of the cheapest paths of texts.

    Texts with the same keys that lie beside each other are one row, if they are in one batch; those without words are none.
    """
    handed = texts.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys) + ", n long, n_bytes long, wcost long, features array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(handed.value)
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            new[0] = True
            for k in keys:
                code = batch.column(k).dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            total, features = runs.sums([t or "" for t in batch.column(text).to_pylist()], np.cumsum(new) - 1)
            kept = np.flatnonzero(total[0] > 0)
            columns = [batch.column(k).take(pa.array(np.flatnonzero(new)[kept])) for k in keys] + [pa.array(x[kept]) for x in total]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sorted(features[i]) for i in kept.tolist()], pa.list_(pa.string()))], [*keys, "n", "n_bytes", "wcost", "features"])

    return texts.select(*keys, text).mapInArrow(run, schema)


def n_best_printed(texts: DataFrame, keys: list[str], text: str, lexicon: Lexicon, n: int) -> DataFrame:
    """keys, rank and the printed form of each of the n cheapest paths."""
    handed = texts.sparkSession.sparkContext.broadcast(lexicon)
    schema = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys) + ", rank int, printed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(handed.value, printed=True)
        for batch in batches:
            said = [t or "" for t in batch.column(text).to_pylist()]
            found = pieces.numbers(said)
            words = pieces.words
            words[Pieces.END], words[Pieces.HARD] = "EOS\n\0", "\1"
            printed = "".join(map(words.__getitem__, found.tolist())).split("\0")[:-1]
            hard = set((np.cumsum(found == Pieces.END)[found == Pieces.HARD]).tolist())
            if hard:
                every = [(i, rank, p) for i, (t, own) in enumerate(zip(said, printed, strict=True)) for rank, p in enumerate(map(printed_path, handed.value.paths(t, n)) if i in hard else [own], 1)]
            else:
                every = [(i, 1, p) for i, p in enumerate(printed)]
            at, ranks, lines = zip(*every, strict=True) if every else ((), (), ())
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in keys), pa.array(ranks, pa.int32()), pa.array(lines, pa.string())], [*keys, "rank", "printed"])

    return texts.select(*keys, text).mapInArrow(run, schema)


def _entries(*rows: str) -> list[Entry]:
    out = []
    for row in rows:
        surface, cost, feature = row.split(" ")
        out.append(Entry(surface, 1, 1, int(cost), feature))
    return out


# A small lexicon of our own, for tests and examples.
MINI = Lexicon(
    _entries(
        "すもも 5000 名詞,一般,*,*,*,*,すもも,スモモ,スモモ", "もも 2500 名詞,一般,*,*,*,*,もも,モモ,モモ", "も 1500 助詞,係助詞,*,*,*,*,も,モ,モ", "の 1500 助詞,連体化,*,*,*,*,の,ノ,ノ",
        "うち 3000 名詞,非自立,副詞可能,*,*,*,うち,ウチ,ウチ", "東京 3000 名詞,固有名詞,地域,一般,*,*,東京,トウキョウ,トーキョー", "都 3000 名詞,接尾,地域,*,*,*,都,ト,ト", "に 1500 助詞,格助詞,一般,*,*,*,に,ニ,ニ",
        "住ん 3500 動詞,自立,*,*,五段・マ行,連用タ接続,住む,スン,スン", "で 2000 助詞,接続助詞,*,*,*,*,で,デ,デ", "い 2500 動詞,非自立,*,*,一段,連用形,いる,イ,イ", "ます 2000 助動詞,*,*,*,特殊・マス,基本形,ます,マス,マス",
        "私 3000 名詞,代名詞,一般,*,*,*,私,ワタシ,ワタシ", "は 1500 助詞,係助詞,*,*,*,*,は,ハ,ワ", "学生 3500 名詞,一般,*,*,*,*,学生,ガクセイ,ガクセイ", "です 2000 助動詞,*,*,*,特殊・デス,基本形,です,デス,デス",
        "携帯 3500 名詞,サ変接続,*,*,*,*,携帯,ケイタイ,ケイタイ", "電話 3500 名詞,サ変接続,*,*,*,*,電話,デンワ,デンワ", "番号 3500 名詞,一般,*,*,*,*,番号,バンゴウ,バンゴー", "を 1500 助詞,格助詞,一般,*,*,*,を,ヲ,ヲ", "入力 3500 名詞,サ変接続,*,*,*,*,入力,ニュウリョク,ニューリョク",
        "する 2500 動詞,自立,*,*,サ変・スル,基本形,する,スル,スル", "食べ 3000 動詞,自立,*,*,一段,連用形,食べる,タベ,タベ", "食べる 3000 動詞,自立,*,*,一段,基本形,食べる,タベル,タベル", "て 1500 助詞,接続助詞,*,*,*,*,て,テ,テ", "寝る 3000 動詞,自立,*,*,一段,基本形,寝る,ネル,ネル",
        "いくら 3000 副詞,一般,*,*,*,*,いくら,イクラ,イクラ", "騒い 3500 動詞,自立,*,*,五段・ガ行,連用タ接続,騒ぐ,サワイ,サワイ", "大丈夫 3500 名詞,形容動詞語幹,*,*,*,*,大丈夫,ダイジョウブ,ダイジョーブ", "だ 2000 助動詞,*,*,*,特殊・ダ,基本形,だ,ダ,ダ",
        "美しい 3500 形容詞,自立,*,*,形容詞・イ段,基本形,美しい,ウツクシイ,ウツクシイ", "花 3500 名詞,一般,*,*,*,*,花,ハナ,ハナ", "大学 3500 名詞,一般,*,*,*,*,大学,ダイガク,ダイガク", "勉強 3500 名詞,サ変接続,*,*,*,*,勉強,ベンキョウ,ベンキョー", "し 2500 動詞,自立,*,*,サ変・スル,連用形,する,シ,シ", "た 1500 助動詞,*,*,*,特殊・タ,基本形,た,タ,タ",
        "こんにちは 3000 感動詞,*,*,*,*,*,こんにちは,コンニチハ,コンニチワ", "。 1000 記号,句点,*,*,*,*,。,。,。", "、 1000 記号,読点,*,*,*,*,、,、,、",
    )
)
