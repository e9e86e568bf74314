"""The pattern language and the matcher, on hand-made tokens; native plans against the matcher."""

import random

import pytest
from pyspark.sql import functions as F

from spantile.operators import inrow
from spantile.operators.api import PatternSet
from spantile.operators.match import Matcher, Tokens, match_texts, nested
from spantile.operators.native import Unsupported, find_native
from spantile.operators.phrases import chunk_of
from spantile.operators.tokens import parsed
from spantile.plans import pattern as P


def tok(text):
    """surface/base/pos0.pos1[form]{type}"""
    surface, base, tags = text.split("/")
    form = tags.split("[")[1].split("]")[0] if "[" in tags else "*"
    kind = tags.split("{")[1].split("}")[0] if "{" in tags else "*"
    path = [*tags.split("[")[0].split("{")[0].split("."), "*", "*", "*"][:4]
    return surface, ",".join([*path, kind, form, base, "*", "*"])


def find(pattern, tokens):
    grammar = P.parse(f"r = {pattern} ;")
    made = [tok(t) if "/" in t else (t, f"名詞,一般,*,*,*,*,{t},*,*") for t in tokens.split()]
    return Matcher(grammar, Tokens([t[0] for t in made], [t[1] for t in made], {})).find(grammar.rules[0])


# Patterns, tokens and what they match.
CASES = [
    ("動詞", "食べ/食べる/動詞 た/た/助動詞", [(0, 1, (0,))]),
    ('動詞 助詞.接続助詞"て"', "食べ/食べる/動詞 て/て/助詞.接続助詞 いる/いる/動詞.非自立", [(0, 2, (0, 1))]),
    ('"いくら" _* 助詞.係助詞"も"', "いくら/いくら/副詞 騒い/騒ぐ/動詞 で/で/助詞.接続助詞 も/も/助詞.係助詞", [(0, 4, (0, 3))]),
    ("形容詞", "食べ/食べる/動詞", []),
    ('動詞@"する"', "し/する/動詞 食べ/食べる/動詞", [(0, 1, (0,))]),
    ("名詞+", "東京/東京/名詞 大学/大学/名詞 の/の/助詞", [(0, 2, (0, 1))]),
    ('形容詞[ガル接続] "さ"', "大き/大きい/形容詞[ガル接続] さ/さ/名詞", [(0, 2, (0, 1))]),
    ('形容詞[ガル接続] "さ"', "大き/大きい/形容詞[連用テ接続] さ/さ/名詞", []),
    ('動詞 動詞@"過ぎる"', "食べ/食べる/動詞 すぎる/過ぎる/動詞", [(0, 2, (0, 1))]),
    ('動詞@~"上がる"', "盛り上がっ/盛り上がる/動詞 た/た/助動詞", [(0, 1, (0,))]),
    ("動詞@/す[るれ]/", "し/する/動詞 すれ/すれ/動詞", [(0, 1, (0,)), (1, 2, (1,))]),
    ('~"ない"', "少ない/少ない/形容詞 多い/多い/形容詞", [(0, 1, (0,))]),
    ('動詞$1 助詞"に" 動詞@=$1 助動詞*', "泣き/泣く/動詞 に/に/助詞 泣い/泣く/動詞 た/た/助動詞", [(0, 4, (0, 1, 2, 3))]),
    ('動詞$1 助詞"に" 動詞@=$1 助動詞*', "行き/行く/動詞 に/に/助詞 来/来る/動詞 た/た/助動詞", []),
    ('_$1 助詞"ば" _@=$1', "考えれ/考える/動詞 ば/ば/助詞 考える/考える/動詞", [(0, 3, (1, 2))]),
    ('_$1 助詞"ば" _@=$1', "考えれ/考える/動詞 ば/ば/助詞 食べる/食べる/動詞", []),
    ('(名詞$1 | 動詞$1) 助詞"に" 動詞@=$1', "泣き/泣く/動詞 に/に/助詞 泣い/泣く/動詞", [(0, 3, (0, 1, 2))]),
    ('動詞{/五段/} 助詞"に"', "行き/行く/動詞{五段・カ行} に/に/助詞", [(0, 2, (0, 1))]),
    ('("A" | "A" "B")', "A B", [(0, 2, (0, 1))]),
    ('"A" _* "B"', "A x B x B", [(0, 5, (0, 4))]),
    ('"A" _* "B" _*', "A x B x B", [(0, 5, (0, 2))]),
    ('"A"? _*', "A A", [(0, 2, ())]),
    ('("A"?)+ "B"', "B", [(0, 1, ())]),
    ('"A"*', "B", []),
    ("unknown", "A", []),
]


@pytest.mark.parametrize(("pattern", "tokens", "want"), CASES)
def test_cases(pattern, tokens, want):
    assert find(pattern, tokens) == want


def test_shapes():
    rule = P.parse('a [N5 N4, "what"] = 動詞.自立$2[~"x"]{"y"}@"z" (b | _$3)? ; // comment\nb = "\\"" ;').rules[0]
    assert (rule.levels, rule.description) == (("N5", "N4"), "what")
    token, maybe = rule.pattern.items
    assert token == P.Token(("動詞", "自立"), None, P.Text("exact", "z"), P.Text("suffix", "x"), P.Text("exact", "y"), 2, None)
    assert maybe == P.Repeat(P.Choice((P.Ref("b"), P.Any(3))), "?")
    assert P.parse('x = 動詞 "て" ;').rules[0].pattern == P.Token(("動詞",), P.Text("exact", "て"))
    assert len(P.parse('x = 形容詞[ガル接続] "さ" ;').rules[0].pattern.items) == 2
    assert P.parse("x = _y ;").rules[0].pattern == P.Ref("_y")
    assert P.parse("").rules == ()
    assert P.parse("x = NOUN.a ;").rules[0].pattern == P.Token(("NOUN", "a"))


@pytest.mark.parametrize("text", ['a = "x', "a = /x", 'a = "x\\', "a = $x ;", "a = _$ ;", "a = ;", "a = () ;", "a = | b ;", "a b ;", 'a = "x"', "a = /(/ ;", "a = ~x ;", "a = x?? ;", 'a [N1 =] = "x" ;', 'a = 動詞["x"] ;', 'a = "s"@=$1 ;', "a = a x ;", "a = b ; b = a ;"])
def test_errors(text):
    with pytest.raises(P.PatternError):
        P.parse(text)
    with pytest.raises(P.PatternError, match="Grammar parse error:"):
        PatternSet.from_text(text)


def test_set_of_rules(spark, tmp_path):
    rules = PatternSet.from_text('a = "x" ; b = c ; c = _$1 ; a = "y" ;')
    assert rules.rule_names() == ["a", "b", "c", "a"]
    assert [rules.grammar.captures(r) for r in rules.grammar.rules] == [False, True, True, False]
    merged = rules.merge('a = "z" ; d = "w" ;')
    assert merged.rule_names() == ["a", "b", "c", "a", "d"] and merged.grammar.rules[0].pattern.surface.value == "z"
    assert rules.clone() == rules != merged
    assert merged.set_max_span("d", 3).grammar.rule("d").max_span == 3
    with pytest.raises(P.PatternError):
        rules.set_max_span("e", 1)
    with pytest.raises(P.PatternError, match="nowhere"):
        PatternSet.from_file(str(tmp_path / "nowhere"))
    (tmp_path / "g").write_text('q = "x" ;', encoding="utf-8")
    assert PatternSet.from_file(str(tmp_path / "g")).rule_names() == ["q"]


def test_right_recursion():
    grammar = P.parse('r = "A" r? "B" ;')
    made = Tokens(list("AAABBBAB"), [f"名詞,*,*,*,*,*,{c}" for c in "AAABBBAB"], {})
    assert [m[:2] for m in Matcher(grammar, made).find(grammar.rules[0])] == [(0, 6), (6, 8)]


def test_native_is_the_matcher(spark):
    """Random grammars over random tokens: both ways find the same."""
    rnd = random.Random(11)
    rows = [(key, i, c, f"名詞,一般,*,*,*,*,{c},*,*") for key in range(60) for i, c in enumerate(rnd.choice("ABCD") for _ in range(rnd.randint(1, 9)))]
    tokens = parsed(spark.createDataFrame(rows, "k long, idx int, surface string, feature string")).cache()
    texts = {}
    for key, _, c, f in rows:
        texts.setdefault(key, []).append((c, f))

    def item(depth):
        kind = rnd.randrange(8 if depth else 4)
        if kind < 3:
            return rnd.choice(('"A"', '"B"', "/[CD]/", "_"))
        if kind == 3:
            return rnd.choice(('"A"', "/[AB]/", "_")) + rnd.choice("?*+")
        if kind < 6:
            return f"({row(depth - 1)} | {row(depth - 1)})"
        return f"({row(depth - 1)})?"

    def row(depth):
        return " ".join(item(depth) for _ in range(rnd.randint(1, 3)))

    tried = 0
    for _ in range(14):
        grammar = P.parse(f"r = {row(1)} ;")
        try:
            got = find_native(tokens, ["k"], grammar, "r").collect()
        except Unsupported:
            continue
        tried += 1
        want = set()
        for key, made in texts.items():
            want |= {(key, s, e) for s, e, _ in Matcher(grammar, Tokens([t[0] for t in made], [t[1] for t in made], {})).find(grammar.rules[0])}
        assert {(r.k, r.s, r.e) for r in got} == want, grammar
    assert tried >= 8


def test_stream(spark, tmp_path):
    from spantile.streaming.tokens import streamed_matches, streamed_tokens

    spark.createDataFrame([(1, "The cat. is running"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = streamed_tokens(stream).writeStream.format("memory").queryName("tokens_seen").start()
    query.processAllAvailable()
    query.stop()
    assert [r.surface for r in spark.sql("SELECT surface FROM tokens_seen ORDER BY doc_id, sent, idx").collect()] == ["The", "cat", "is", "running"]
    spark.sql("SELECT 1 AS k, array(named_struct('surface', 'x', 'feature', '名詞'), named_struct('surface', 'y', 'feature', '動詞')) AS tokens").write.parquet(str(tmp_path / "t"))
    texts = spark.readStream.schema("k int, tokens array<struct<surface: string, feature: string>>").parquet(str(tmp_path / "t"))
    query = streamed_matches(texts, P.parse("r = 名詞 動詞 ;"), ["k"]).writeStream.format("memory").queryName("matches_seen").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.k, r.s, r.e) for r in spark.sql("SELECT * FROM matches_seen").collect()] == [(1, 0, 2)]


def test_empty(spark):
    texts = spark.createDataFrame([], "k long, tokens array<struct<surface: string, feature: string>>")
    assert match_texts(texts, P.parse("r = 名詞 ;"), ["k"]).count() == 0


def test_patterns_in_rows_are_the_matcher(spark):
    """Shapes that are matched within rows: spans and what the tests have read, slots and references among them."""
    rnd = random.Random(5)
    texts = [[(c, f"名詞,一般,*,*,*,{form},{c if c != 'D' else '*'},*,*") for c, form in ((rnd.choice("ABCD"), rnd.choice(("x", "y"))) for _ in range(rnd.randint(0, 9)))] for _ in range(80)]
    texts += [[("A", "名詞"), ("B", "名詞,一般"), ("A", "名詞")]]
    frame = spark.createDataFrame([(k, [tuple(t) for t in made]) for k, made in enumerate(texts)], "k long, tokens array<struct<surface: string, feature: string>>").cache()
    single = lambda: rnd.choice(('"A"', '"B"', "/[CD]/", "_", "名詞[x]", '@"C"', '("A" | "C")', "(one)"))
    shapes = [" ".join(single() for _ in range(rnd.randint(1, 3))) + rnd.choice(("", ' "A"+', ' "B"*', " /[AB]/+")) for _ in range(30)]
    shapes += ['"A" "A" "A"*', '"B"+', "_$1 _ _@=$1", "名詞$2 _@=$2", '_@=$1 "A"', "名詞$1 名詞@=$1"]
    grammar = P.parse('one = "B" | "D" ;' + "".join(f"r{i} = {x} ;" for i, x in enumerate(shapes)))
    for rule in grammar.rules:
        got = {r.k: [(m.s, m.e, tuple(m.fixed)) for m in r.m] for r in frame.select("k", inrow.matches(F.col("tokens"), grammar, rule).alias("m")).collect()}
        for k, made in enumerate(texts):
            assert got[k] == Matcher(grammar, Tokens([t[0] for t in made], [t[1] for t in made], {})).find(rule), (rule, made)


def test_rules_of_either_way_in_one_set(spark):
    """Rules that are matched within rows and rules that need the general matcher, in the order of the grammar."""
    rules = PatternSet.from_text('a = "x" "y" ; b = ("x" "y")+ ; a = "y" ; c = "y" c? ;')
    tokens = spark.createDataFrame([(1, i, c, "名詞") for i, c in enumerate("xyxyy")], "k long, idx int, surface string, feature string")
    got = rules.raw(tokens, ["k"]).collect()
    assert [(r.rule, r.ord, r.s, r.e, list(r.fixed)) for r in got] == [("a", 0, 0, 2, [0, 1]), ("a", 0, 2, 4, [2, 3]), ("a", 2, 1, 2, [1]), ("a", 2, 3, 4, [3]), ("a", 2, 4, 5, [4]), ("b", 1, 0, 4, [0, 1, 2, 3]), ("c", 3, 1, 2, [1]), ("c", 3, 3, 5, [3, 4])]
    assert {(r.rule, r.ord) for r in rules.raw(tokens, ["k"], ["a"]).collect()} == {("a", 0)}


def test_phrases_in_rows(spark):
    rnd = random.Random(6)
    tags = [("名詞", "一般"), ("名詞", "接尾"), ("助詞", "*"), ("記号", "読点"), ("動詞", "自立"), ("副詞", "*"), ("形容詞", "非自立")]
    rows = [(k, i, "w", ",".join(rnd.choice(tags))) for k in range(60) for i in range(rnd.randint(1, 10))]
    tokens = spark.createDataFrame(rows, "k long, idx int, surface string, feature string")
    want = {(r.k, r.idx): -1 if r.chunk is None else r.chunk for r in chunk_of(parsed(tokens), ["k"]).collect()}
    got = nested(tokens, ["k"]).select("k", F.posexplode(inrow.phrase_numbers(F.col("tokens"))).alias("idx", "c")).collect()
    assert {(r.k, r.idx): r.c for r in got} == want
