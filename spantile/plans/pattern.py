"""The pattern language: syntax trees, the lexer and the parser.

A grammar is a list of rules ``name [levels, "description"] = pattern ;``.  A pattern is alternatives of sequences of
items; an item is a token test, ``_``, a group or a rule's name, and may have one of ``? * +`` after it.  White space
means nothing: tests that follow each other without a space or with one belong to the same token where they can.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import regex

SPECIAL = set('"/()[]{}|?*+=;,.@~$') | {"_"}


class PatternError(ValueError):
    """A grammar text that cannot be read."""


# ---------------------------------------------------------------- trees


@dataclass(frozen=True)
class Text:
    """A test of a string: ``exact``, ``suffix`` or ``regex`` (found anywhere)."""

    kind: str
    value: str

    def holds(self, text: str) -> bool:
        if self.kind == "exact":
            return text == self.value
        if self.kind == "suffix":
            return text.endswith(self.value)
        try:
            return compiled(self.value).search(text, timeout=5) is not None
        except TimeoutError:
            return False


@dataclass(frozen=True)
class Token:
    """One token: all tests that are set hold; ``back`` compares the base with a slot, ``slot`` then keeps it."""

    path: tuple[str, ...] = ()
    surface: Text | None = None
    base: Text | None = None
    form: Text | None = None
    conjugation: Text | None = None
    slot: int | None = None
    back: int | None = None


@dataclass(frozen=True)
class Any:
    """Any one token; with a slot, its base is kept."""

    slot: int | None = None


@dataclass(frozen=True)
class Sequence:
    items: tuple


@dataclass(frozen=True)
class Choice:
    items: tuple


@dataclass(frozen=True)
class Repeat:
    """``?``, ``*`` or ``+`` of an item."""

    item: object
    sign: str


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: object
    levels: tuple[str, ...] = ()
    description: str | None = None
    connection: str | None = None
    examples: tuple = ()
    #: Most phrases that a match may span; 0: no limit of its own.
    max_span: int = 0


@dataclass(frozen=True)
class Grammar:
    rules: tuple[Rule, ...] = ()
    #: Rules whose pattern could not be read, and why; they never match.
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def rule(self, name: str) -> Rule | None:
        """The first rule of that name."""
        return next((r for r in self.rules if r.name == name), None)

    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def merge(self, other: Grammar) -> Grammar:
        """Rules of ``other`` take the place of the first rule of their name, or come last."""
        rules = list(self.rules)
        for new in other.rules:
            at = next((i for i, r in enumerate(rules) if r.name == new.name), None)
            if at is None:
                rules.append(new)
            else:
                rules[at] = new
        return Grammar(tuple(rules), self.warnings + other.warnings)

    def with_max_span(self, name: str, most: int) -> Grammar:
        at = next((i for i, r in enumerate(self.rules) if r.name == name), None)
        if at is None:
            raise PatternError(f"no rule is called {name!r}")
        return Grammar((*self.rules[:at], replace(self.rules[at], max_span=most), *self.rules[at + 1 :]), self.warnings)

    def captures(self, rule: Rule) -> bool:
        """Whether a rule, or any that it refers to, uses slots."""
        return _captures(self, rule.pattern, set())

    def check(self) -> None:
        """Refuses rules that begin with themselves: they would never end."""
        for r in self.rules:
            if r.name in _leading(self, r.pattern, set()):
                raise PatternError(f"rule {r.name!r} begins with itself")


def children(node) -> tuple:
    if isinstance(node, Sequence | Choice):
        return node.items
    return (node.item,) if isinstance(node, Repeat) else ()


def parts_of(node) -> Iterator:
    """A pattern and all that is within it."""
    yield node
    for c in children(node):
        yield from parts_of(c)


def _captures(grammar: Grammar, node, met: set[str]) -> bool:
    if isinstance(node, Token):
        return node.slot is not None or node.back is not None
    if isinstance(node, Any):
        return node.slot is not None
    if isinstance(node, Ref):
        rule = grammar.rule(node.name)
        if rule is None or node.name in met:
            return False
        met.add(node.name)
        return _captures(grammar, rule.pattern, met)
    return any(_captures(grammar, c, met) for c in children(node))


def nullable(grammar: Grammar, node, met: frozenset[str] = frozenset()) -> bool:
    """Whether a pattern can match no token at all."""
    if isinstance(node, Token | Any):
        return False
    if isinstance(node, Sequence):
        return all(nullable(grammar, c, met) for c in node.items)
    if isinstance(node, Choice):
        return any(nullable(grammar, c, met) for c in node.items)
    if isinstance(node, Repeat):
        return node.sign != "+" or nullable(grammar, node.item, met)
    rule = grammar.rule(node.name)
    return rule is not None and node.name not in met and nullable(grammar, rule.pattern, met | {node.name})


def _leading(grammar: Grammar, node, met: set[str]) -> set[str]:
    """Names of rules that a pattern may begin with."""
    if isinstance(node, Ref):
        if node.name in met or grammar.rule(node.name) is None:
            return {node.name}
        return {node.name} | _leading(grammar, grammar.rule(node.name).pattern, met | {node.name})
    if isinstance(node, Sequence):
        out: set[str] = set()
        for c in node.items:
            out |= _leading(grammar, c, met)
            if not nullable(grammar, c):
                break
        return out
    return set().union(*(_leading(grammar, c, met) for c in children(node)))


def compiled(pattern: str):
    """A regular expression in the dialect that both executors read, with Unicode classes."""
    if pattern not in _COMPILED:
        try:
            _COMPILED[pattern] = regex.compile(pattern)
        except regex.error as e:
            raise PatternError(f"regular expression /{pattern}/: {e}") from e
    return _COMPILED[pattern]


_COMPILED: dict[str, object] = {}


# ---------------------------------------------------------------- lexer


@dataclass(frozen=True)
class Lexeme:
    kind: str
    value: str = ""
    at: int = 0


def lexemes(text: str) -> Iterator[Lexeme]:
    """The lexemes of a grammar text, and ``end``."""
    i, n = 0, len(text)
    while i < n:
        c, at = text[i], i
        if c.isspace():
            i += 1
        elif text.startswith("//", i):
            i = n if (j := text.find("\n", i)) < 0 else j
        elif c in '"/':
            value, i = _quoted(text, i)
            yield Lexeme("string" if c == '"' else "regex", value, at)
        elif c == "$":
            if i + 1 >= n or text[i + 1] not in "0123456789":
                raise PatternError(f"a digit must follow $ at {i}")
            yield Lexeme("slot", text[i + 1], at)
            i += 2
        elif c == "_":
            j = i + 1
            while j < n and not text[j].isspace() and (text[j] not in SPECIAL or text[j] == "_"):
                j += 1
            yield Lexeme("any" if j == i + 1 else "name", text[i:j], at)
            i = j
        elif c in SPECIAL:
            yield Lexeme(c, c, at)
            i += 1
        else:
            j = i
            while j < n and not text[j].isspace() and (text[j] not in SPECIAL or text[j] == "_"):
                j += 1
            yield Lexeme("name", text[i:j], at)
            i = j
    yield Lexeme("end", "", n)


def _quoted(text: str, i: int) -> tuple[str, int]:
    """The inside of a string or regular expression, and where it ends.  In strings a backslash gives the next character."""
    quote, out, i = text[i], [], i + 1
    while True:
        if i >= len(text):
            raise PatternError(f"no closing {quote}")
        c = text[i]
        if c == quote:
            return "".join(out), i + 1
        if c == "\\":
            if i + 1 >= len(text):
                raise PatternError("nothing after a backslash")
            out.append(text[i + 1] if quote == '"' else text[i : i + 2])
            i += 2
        else:
            out.append(c)
            i += 1


# ---------------------------------------------------------------- parser


class _Parser:
    def __init__(self, text: str) -> None:
        self.left = list(lexemes(text))
        self.i = 0

    @property
    def kind(self) -> str:
        return self.left[self.i].kind

    def take(self, *kinds: str) -> str | None:
        """The value of the next lexeme if it is of one of these kinds."""
        if self.kind not in kinds:
            return None
        self.i += 1
        return self.left[self.i - 1].value

    def need(self, *kinds: str) -> str:
        found = self.take(*kinds)
        if found is None:
            here = self.left[self.i]
            raise PatternError(f"{' or '.join(kinds)} is needed at {here.at}, not {here.value or 'the end'}")
        return found

    def grammar(self) -> Grammar:
        rules = []
        while self.kind != "end":
            rules.append(self.rule())
        out = Grammar(tuple(rules))
        out.check()
        return out

    def rule(self) -> Rule:
        name = self.need("name")
        levels, description = [], None
        if self.take("[") is not None:
            while (level := self.take("name")) is not None:
                levels.append(level)
                self.take(",")
            description = self.take("string")
            self.need("]")
        self.need("=")
        pattern = self.choice()
        self.need(";")
        return Rule(name, pattern, tuple(levels), description)

    def choice(self):
        items = [self.sequence()]
        while self.take("|") is not None:
            items.append(self.sequence())
        return items[0] if len(items) == 1 else Choice(tuple(items))

    def sequence(self):
        items = []
        while self.kind not in ("|", ")", ";", "end"):
            items.append(self.item())
        if not items:
            raise PatternError(f"a pattern is needed at {self.left[self.i].at}")
        return items[0] if len(items) == 1 else Sequence(tuple(items))

    def item(self):
        atom = self.atom()
        sign = self.take("?", "*", "+")
        return atom if sign is None else Repeat(atom, sign)

    def atom(self):
        if self.take("(") is not None:
            inside = self.choice()
            self.need(")")
            return inside
        if self.take("any") is not None:
            if (slot := self.take("slot")) is not None:
                return Any(int(slot))
            back = self.back()
            return Any() if back is None else Token(back=back)
        if self.kind == "name":
            return self.tagged()
        if (text := self.text("string", "regex", "~")) is not None:
            return Token(surface=text, base=self.base() if self.kind == "@" else None)
        if self.kind == "@":
            if (back := self.back()) is not None:
                return Token(back=back)
            return Token(base=self.base())
        here = self.left[self.i]
        raise PatternError(f"{here.value or 'the end'} cannot begin an item, at {here.at}")

    def tagged(self):
        path = [self.need("name")]
        while self.take(".") is not None:
            path.append(self.need("name"))
        slot, form, conjugation, surface, base, back = None, None, None, None, None, None
        if (s := self.take("slot")) is not None:
            slot = int(s)
        if self.take("[") is not None:
            form = self.bracketed("]", strings=False)
        if self.take("{") is not None:
            conjugation = self.bracketed("}", strings=True)
        if form is None and conjugation is None:
            surface = self.text("string", "regex", "~")
        if self.kind == "@" and (back := self.back()) is None:
            base = self.base()
        bare = slot is None and back is None and not (surface or base or form or conjugation)
        if bare and len(path) == 1 and path[0].isascii():
            return Ref(path[0])
        return Token(tuple(path), surface, base, form, conjugation, slot, back)

    def bracketed(self, close: str, strings: bool) -> Text:
        found = self.take("name")
        out = Text("exact", found) if found is not None else self.text(*(["string"] if strings else []), "regex", "~")
        if out is None:
            raise PatternError(f"a test is needed before {close} at {self.left[self.i].at}")
        self.need(close)
        return out

    def back(self) -> int | None:
        """The slot of ``@=$N``."""
        if self.kind == "@" and self.left[self.i + 1].kind == "=":
            self.i += 2
            return int(self.need("slot"))
        return None

    def base(self) -> Text:
        self.need("@")
        out = self.text("string", "regex", "~")
        if out is None:
            raise PatternError(f"a test is needed after @ at {self.left[self.i].at}")
        return out

    def text(self, *kinds: str) -> Text | None:
        if "~" in kinds and self.take("~") is not None:
            return Text("suffix", self.need("string"))
        if "regex" in kinds and (found := self.take("regex")) is not None:
            compiled(found)
            return Text("regex", found)
        found = self.take("string") if "string" in kinds else None
        return None if found is None else Text("exact", found)


def parse(text: str) -> Grammar:
    """The grammar of a text."""
    return _Parser(text).grammar()


def parse_file(path: str) -> Grammar:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except (OSError, PatternError, UnicodeDecodeError) as e:
        raise PatternError(f"{path}: {e}") from e


#: What an empty pattern is: it matches no token, so it is never reported.
EMPTY = Sequence(())
