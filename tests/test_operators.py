"""Resolution, phrases, sources, the lattice and the catalogue."""

import dataclasses
import gzip
import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spantile import queries
from spantile.operators import catalogue, consumers, inbatch, lattice, match, phrases, tokens
from spantile.operators.api import PatternSet
from spantile.operators.resolve import level_number, priority, resolve
from spantile.sources import compiled, dictionary, rules


def test_priority(spark):
    levels = [["N5", "N4"], ["N3", "x"], ["n5"], ["N256"], ["N+2", "N05"], [], ["N0"]]
    got = spark.createDataFrame([(x,) for x in levels], "x array<string>").select(priority(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [4, 3, None, None, 2, None, 0]


def kept(matches):
    """The fold as it is said: from the most specific on, what no accepted match speaks against."""
    held = []
    for m in sorted(matches, key=lambda m: (-1 if m[0] is None else m[0], m[1] - m[2], m[1], m[3])):
        p, s, e, _ = m
        if any((a[0] is not None and p is not None and a[0] < p and s < a[2] and e > a[1]) or (a[0] == p and s >= a[1] and e <= a[2] and a[2] - a[1] > e - s) for a in held):
            continue
        held.append(m)
    if any(m[0] is not None and m[0] <= 2 for m in held):
        held = [m for m in held if m[0] is None or m[0] < 4]
    return held


def test_resolve(spark):
    rnd = random.Random(2)
    data = {k: [(rnd.choice((None, 1, 2, 3, 4, 5)), s := rnd.randrange(8), s + rnd.randint(1, 4), i) for i in range(rnd.randint(0, 9))] for k in range(200)}
    rows = [(k, *m) for k, ms in data.items() for m in ms]
    got = resolve(spark.createDataFrame(rows, "k long, p int, s int, e int, ord int"), ["k"])
    assert sorted((r.k, r.ord) for r in got.collect()) == sorted((k, m[3]) for k, ms in data.items() for m in kept(ms))


def test_chunks(spark):
    words = [("私", "名詞", "代名詞"), ("は", "助詞", "係助詞"), ("学生", "名詞", "一般"), ("です", "助動詞", None), ("。", "記号", "句点")]
    data = spark.createDataFrame([(1, i, *w) for i, w in enumerate(words)] + [(2, i, *w) for i, w in enumerate([("食べ", "動詞", "自立"), ("て", "助詞", "接続助詞"), ("いる", "動詞", "非自立")])], "k int, idx int, surface string, pos0 string, pos1 string")
    got = phrases.chunks(data, ["k"]).orderBy("k", "chunk").collect()
    assert [(r.k, r.s, r.e, r.head, r.surface) for r in got] == [(1, 0, 2, 0, "私は"), (1, 2, 4, 2, "学生です"), (2, 0, 3, 0, "食べている")]


def test_find_all(spark):
    found = lattice.tokenized(spark.createDataFrame([(1, "食べて寝る"), (2, "いくら騒いでも大丈夫だ"), (3, "東京大学")], "k long, text string"), ["k"], "text", lattice.MINI)
    pattern = PatternSet.from_text('te [N5, "te"] = 動詞 助詞.接続助詞 ; ikura [N2] = "いくら" _* 助詞.接続助詞"で" 助詞.係助詞"も" ; nouns = 名詞 名詞+ ;')
    got = pattern.find_all(found, ["k"]).collect()
    assert [(r.k, r.rule, r.s, r.e, list(r.fixed)) for r in got] == [(1, "te", 0, 2, [0, 1]), (2, "ikura", 0, 4, [0, 2, 3]), (3, "nouns", 0, 2, [0, 1])]
    assert [t.surface for t in got[0].nodes] == ["食べ", "て"] and got[0].levels == ["N5"] and (got[0].chunk_s, got[0].span) == (0, 1)
    assert pattern.find(found, ["k"], "no such rule").count() == 0
    assert {r.k: r.hit for r in pattern.test(found, ["k"], "te").collect()} == {1: True, 2: True, 3: False}


def test_lattice(spark):
    best = lambda t: [x.entry.surface for x in next(lattice.MINI.paths(t))]
    assert {"すもも", "もも"} <= set(best("すもももももももものうち")) and best("東京都に住んでいます")[:3] == ["東京", "都", "に"]
    assert best("携帯電話番号を入力する")[:3] == ["携帯", "電話", "番号"] and {"私", "学生"} <= set(best("私は学生です"))
    assert best("こんにちは") and best("コンピューター") == ["コンピューター"] and best("") == [] and best(" 東京  都 ") == ["東京", "都"]
    paths = [lattice.printed_path(p) for p in lattice.MINI.paths("すもももももももものうち", 5)]
    assert len(set(paths)) == len(paths) > 1 and all(p.endswith("EOS\n") for p in paths)
    costs = [p[-1].cost for p in lattice.MINI.paths("いくら騒いでも大丈夫だ", 6)]
    assert costs == sorted(costs)
    with pytest.raises(ValueError):
        list(lattice.MINI.paths("a\0b"))
    got = lattice.n_best_printed(spark.createDataFrame([(1, ""), (2, "東京")], "k long, text string"), ["k"], "text", lattice.MINI, 2)
    assert {(r.k, r["rank"]): r.printed for r in got.collect()}[(1, 1)] == "EOS\n"
    node = lattice.tokenized(spark.createDataFrame([(1, "東京 都")], "k long, text string"), ["k"], "text", lattice.MINI).orderBy("idx").collect()[1]
    assert (node.surface, node.length, node.rlength, node.stat, node.isbest, node.cost) == ("都", 3, 4, 0, True, 6000)


def test_printed(spark):
    data = spark.createDataFrame([(1, 0, "a", "x,y"), (1, 1, "b", "z")], "k int, idx int, surface string, feature string")
    text = tokens.printed(data, ["k"])
    assert text.first().printed == "a\tx,y\nb\tz\nEOS\n"
    assert [tuple(t) for t in text.select(tokens.from_printed(F.col("printed")).alias("t")).first().t] == [("a", "x,y"), ("b", "z")]


def test_container(spark, tmp_path):
    files = [(n, n.encode() * 3) for n in dictionary.FILES]
    for name, data in files:
        (tmp_path / name).write_bytes(data)
    dictionary.pack_dir(str(tmp_path), str(tmp_path / "deep" / "packed"))
    assert dictionary.unpack((tmp_path / "deep" / "packed").read_bytes()) == files
    assert [(r.name, bytes(r.data)) for r in dictionary.read_packed(spark, str(tmp_path / "deep" / "packed")).collect()] == files
    for bad in (b"", b"plain", gzip.compress(b"NOPE"), gzip.compress(b"MCBD\x02\0\0\0\0\0\0\0"), gzip.compress(b"MCBD\x01\0\0\0\x01\0\0\0\xff\0\0\0"), dictionary.pack([("../x", b"")]), dictionary.pack([("", b"")]), dictionary.pack([("a\\b", b"")])):
        with pytest.raises(dictionary.DictionaryError):
            dictionary.unpack(bad)
    with pytest.raises(dictionary.DictionaryError, match="sys.dic"):
        (tmp_path / "sys.dic").unlink()
        dictionary.pack_dir(str(tmp_path), str(tmp_path / "x"))


@pytest.mark.parametrize("charset", ["UTF-8", "EUC-JP"])
def test_lexicon(spark, tmp_path, charset):
    (tmp_path / "a.csv").write_bytes("東京,3,4,500,名詞,固有名詞,*\nもも,1,9,-7,名詞,一般,*\n".encode(charset))
    dictionary.compile_lexicon(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), charset)
    lexicon = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in lexicon.collect()} == {("東京", 3, 4, 500, "名詞,固有名詞,*"), ("もも", 1, 9, -7, "名詞,一般,*")}
    assert tuple(dictionary.dictionary_info(lexicon, "f").first()) == ("f", "utf-8", 2, 0, 4, 10, 102)


CSV = '''rule_name,levels,name,description,connection,pattern,examples
te,N5  N4,て形,"says ""so"", and
more",V,"動詞 ""て""",ja:食べて;zh:吃|ja:見て
,N1,no name,,,,
bad,,,only this,,"動詞 (",
none,,,,,,
'''


def test_rule_files(spark, tmp_path):
    grammar = rules.rules_from_gz(gzip.compress(CSV.encode()))
    te, bad, none = grammar.rules
    assert (te.levels, te.description, te.connection) == (("N5", "N4"), 'て形：says "so", and\nmore', "V")
    assert te.examples == (("食べて", (("zh", "吃"),)), ("見て", ()))
    assert bad.description == "：only this" and len(grammar.warnings) == 1 and none.description is None
    (tmp_path / "r.csv").write_text(CSV, encoding="utf-8")
    read = {r.name: r for r in rules.read_rules(spark, str(tmp_path / "r.csv")).collect()}
    assert list(read) == ["te", "bad", "none"] and read["te"].levels == ["N5", "N4"] and read["te"].description == te.description
    assert [(e.sentence, [tuple(t) for t in e.translations]) for e in read["te"].examples] == [("食べて", [("zh", "吃")]), ("見て", [])]
    with pytest.raises(rules.PatternError):
        rules.rules_from_gz(b"no")
    data = spark.createDataFrame([(2, "b", None, "x, y", 'say "so"\n   now', None, "動詞", ""), (1, "a", "N5", "n", "", "", "名詞", "ja:x")], "id long, rule_name string, levels string, name string, description string, connection string, pattern string, examples string")
    rules.write_rules(data, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [",".join(rules.CSV_COLUMNS), "a,N5,n,,,名詞,ja:x", 'b,,"x, y","say ""so"" now",,動詞,']
    assert [r.name for r in PatternSet.from_gz(gzip.compress("\n".join(lines).encode())).grammar.rules] == ["a", "b"]


def test_examples_both_ways(spark):
    texts = ["ja:a;zh:b|ja:c", "ja:a:b;en:c:d", "plain;ja:x", "zh:only", "", "ja:;zh:x", "ja:a;ja:b;c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rules.decoded_examples(F.col("t")).alias("e")).collect()
    assert [tuple((e.sentence, tuple(map(tuple, e.translations))) for e in r.e) for r in got] == [rules.examples_of(t) for t in texts]


def test_pages(spark):
    html = """<title>て形 | site</title><h1></h1><h2>解説 about</h2><p>It &amp; that</p>
text of no element<div> two
 lines </div><h2>接続</h2><p></p><h4>つなぎ方</h4><ul><li>V</li></ul><h3>解説 again</h3><p>no</p><h4>意味</h4><p>means</p><h3>例文です</h3><p>
    intro
    （１） 食べて寝る ▶
    eat and sleep ▶
    吃了睡
    見る？
    (2) ▶
    (3)
    lost
    （ 10 ）行く
    go</p><p>go again
    (4) 来る</p><h2>例文</h2><p>(1) no</p>"""
    page = spark.createDataFrame([(1, "http://h/a-b/te-form", html), (2, "http://nihongokyoshi-net.com/x/", "<h1>【Ｎ３文法】～あまり｜b</h1><h2>意味</h2><p>only</p>"), (3, "none", "jlpt  n4 N2")], "id int, url string, html string")
    one, two, three = catalogue.records(page).orderBy("id").collect()
    assert (one["name"], one.rule_name, one.levels, one.source, one.pattern) == ("て形", "te_form", "", "unknown", "")
    assert one.description == "It & that\ntwo\n lines\n\n【意味】\nmeans" and one.connection == "V"
    assert [(e.sentence, [tuple(t) for t in e.translations]) for e in one.examples] == [("食べて寝る", [("en", "eat and sleep"), ("zh", "吃了睡")]), ("", []), ("行く", [("en", "go")]), ("来る", [])]
    assert (two["name"], two.rule_name, two.levels, two.description, two.source) == ("～あまり", "x", "N3", "only", "nihongokyoshi_net")
    assert (three.levels, three.rule_name, three.examples) == ("n4", "grammar_6e6f6e65", [])


def test_links(spark):
    html = "<a href='/grammar-0'>zero</a><h2>JLPT N5</h2><a href=\"/x-y/grammar/\">one</a><a href='http://b/jlpt'> <b>two</b></a><a href=/grammar-3 class=x>three</a><a href='/other'>o</a><a href='/grammar-e'></a><h4>N1</h4><a href='/jlpt4'>four</a><h3>none</h3><a href='/grammar-5'>five</a>"
    page = spark.createDataFrame([(1, html)], "id int, html string")
    links = catalogue.links(page, "id", "html").select("href", "text", catalogue.absolute(F.col("href"), "https://r").alias("u")).collect()
    assert [tuple(r) for r in links] == [("/grammar-0", "zero", "https://r/grammar-0"), ("/x-y/grammar/", "one", "https://r/x-y/grammar/"), ("/grammar-3", "three", "https://r/grammar-3"), ("/grammar-5", "five", "https://r/grammar-5")]
    assert catalogue.links(page, "id", "html", None).count() == 7
    assert [(r.href, r.text, r.level) for r in catalogue.links_by_level(page, "id", "html").collect()] == [("/x-y/grammar/", "one", "N5"), ("http://b/jlpt", "two", "N5"), ("/grammar-3", "three", "N5"), ("/grammar-e", "", "N5"), ("/jlpt4", "four", "N5")]
    lines = ["①. 食べるのだ", "短い", "latin letters alone", "接続が分かるように", "食べるのだ", "1) 飲むのです", "カタカナノミデス", *[f"例文その{i}です" for i in range(9)]]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "id int, place int, line string")
    assert [r.line for r in catalogue.top_examples(rows, "id").orderBy("rank").collect()] == ["食べるのだ", "飲むのです", "例文その0です", "例文その1です", "例文その2です"]
    texts = spark.createDataFrame([(["x", " Vて y", "接続： Nの＋こと", "接続 z"],), (["none"],)], "t array<string>").select(catalogue.connection_of(F.col("t")).alias("c")).collect()
    assert [r.c for r in texts] == ["Nの＋こと", ""]


def test_fetch():
    waits, calls = [], []

    def get(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "page"

    assert catalogue.fetch("u", get, wait=waits.append) == "page" and waits == [5.0, 10.0]
    assert catalogue.fetch("u", lambda u: 1 / 0, tries=7, wait=waits.append) is None and waits[2:] == [5.0, 10.0, 20.0, 40.0, 80.0, 120.0]


def test_tables(spark):
    old = rules.with_schema(spark.createDataFrame([(1, "a", "N5,N4", "x"), (2, "b", "N3", " "), (3, "c", "", None)], "id long, rule_name string, levels string, pattern string"), rules.GRAMMARS)
    updates = catalogue.read_updates(spark.createDataFrame([('[{"id": 2, "pattern": "y"}, {"id": 3}]',)], "value string"))
    assert {r.id: r.pattern for r in catalogue.updated_patterns(old, updates).collect()} == {1: "x", 2: "y", 3: ""}
    assert [r.id for r in catalogue.page_of(old, 1, 1).collect()] == [2] and catalogue.with_pattern(old).count() == 1
    assert catalogue.filtered(old, level="N4").count() == 1 and catalogue.filtered(old, name="b", holding="b").count() == 1
    examples = spark.createDataFrame([(1, 1, "s2", "ja", 1), (2, 1, "s1", "ja", 0)], "id long, grammar_id long, sentence string, lang string, sort_order int")
    joined = {r.id: [e.sentence for e in r.examples] for r in catalogue.with_examples(old, examples).collect()}
    assert joined == {1: ["s1", "s2"], 2: [], 3: []}
    gone = spark.createDataFrame([(1, " s1 ")], "grammar_id long, sentence string")
    assert [r.sentence for r in catalogue.without_pairs(examples, gone).collect()] == ["s2"]
    new = spark.createDataFrame([(1, ["p", "q", "r"]), (2, [])], "grammar_id long, sentences array<string>")
    gone, kept = spark.createDataFrame([(1, "q")], "grammar_id long, sentence string"), spark.createDataFrame([], "grammar_id long")
    out = catalogue.replaced_examples(examples.drop("id"), new, gone, kept)
    assert sorted((r.grammar_id, r.sentence, r.sort_order) for r in out.collect()) == [(1, "p", 0), (1, "r", 2)]
    told = spark.createDataFrame([(1, [("p", [("zh", "P"), ("en", "pp")]), ("q", [("en", "Q")])])], f"grammar_id long, examples array<struct<sentence: string, translations: {catalogue.TRANSLATIONS}>>")
    out = catalogue.replaced_examples(examples.drop("id"), told, gone, kept)
    assert sorted((r.sort_order, r.lang, r.sentence) for r in out.collect()) == [(0, "en", "pp"), (0, "ja", "p"), (0, "zh", "P")]
    assert catalogue.replaced_examples(examples.drop("id"), told, gone, told.select("grammar_id")).count() == 2
    assert {r.id: r.n for r in catalogue.example_counts(old, examples).collect()} == {1: 2, 2: 0, 3: 0}
    assert tuple(catalogue.totals(old, examples).first()) == (3, 2)
    added = catalogue.upserted(old, rules.with_schema(spark.createDataFrame([("b",), ("z",), ("y",)], "rule_name string"), rules.GRAMMARS))
    assert {r.rule_name: r.id for r in added.collect()} == {"a": 1, "b": 2, "c": 3, "y": 4, "z": 5}


def test_conformance(spark):
    """Rules are tried on their own examples, by the lattice tokenizer; after so many failures no more are reported."""
    made = [(1, "te", '動詞 助詞"て"'), (2, "never", '"no such word"'), (3, "ref", "te 動詞"), (4, "alone", "名詞"), (5, "never2", '"none"'), (6, "late", "動詞"), (7, "blank", " ")]
    rows = spark.createDataFrame(made, "id long, rule_name string, pattern string")
    said = [(1, "食べて寝る", "ja", 0), (1, "eat", "en", 0), (1, " 大学 ", "ja", 1), (2, "食べる", "ja", 0), (2, "食べる", "ja", 1), (3, "食べて寝る", "ja", 0), (4, " ", "ja", 0), (5, "花", "ja", 0), (6, "寝る", "ja", 0), (7, "花", "ja", 0)]
    examples = spark.createDataFrame(said, "grammar_id long, sentence string, lang string, sort_order int")
    excluded = spark.createDataFrame([(1, "大学")], "grammar_id long, sentence string")
    tokenize = lambda texts: lattice.tokenized(texts, ["grammar_id", "example"], "text", lattice.MINI)
    report = catalogue.conformance_of(rows, examples, excluded, tokenize)
    assert {r.rule: (r.id, r.passed, r.matched, r.failed) for r in report.collect()} == {"te": (1, True, 1, 0), "never": (2, False, 0, 2), "ref": (3, True, 1, 0), "alone": (4, None, 0, 0), "never2": (5, False, 0, 1), "late": (6, True, 1, 0)}
    assert tuple(catalogue.conformance_totals(report).first()) == (5, 3, 2, 1)
    assert {r.id for r in catalogue.conformance_of(rows, examples, excluded, tokenize, 2).collect()} == {1, 2, 3, 4, 5}
    assert {r.id for r in catalogue.conformance_of(rows, examples, excluded, tokenize, 1).collect()} == {1, 2}


def test_consumers(spark):
    found = spark.createDataFrame([(1, 0, "a", 0, 3, [0, 2]), (1, 1, "b", 1, 2, [1])], "k int, ord int, rule string, s int, e int, fixed array<int>")
    assert [r.rule for r in consumers.outermost(found, ["k"]).collect()] == ["a"] and consumers.of_rules(found, ["b"]).count() == 1
    assert {r.idx: (r.rules, r.fixed) for r in consumers.by_token(found, ["k"]).collect()} == {0: (["a"], True), 1: (["a", "b"], True), 2: (["a"], True)}
    row = spark.sql("SELECT array(named_struct('surface', 'x'), named_struct('surface', 'y'), named_struct('surface', 'z')) AS t")
    assert row.select(consumers.bracketed(F.col("t"), F.array(F.lit(5), F.lit(7)), F.lit(5))).first()[0] == "[x] y [z]"
    assert row.select(consumers.match_line(F.array(), F.lit("r"), F.array(F.lit("a"), F.lit("b")))).first()[0] == "N?     r" + " " * 30 + "fixed: a b"
    assert row.select(consumers.fixed_surfaces(F.slice("t", 2, 2), F.array(F.lit(2)), F.lit(1))).first()[0] == ["z"]
    shown = spark.createDataFrame([("ja:a;zh:b;en:c|ja:d",)], "t string").select(consumers.preview(rules.decoded_examples(F.col("t")))).first()[0]
    assert shown == ["a  b / c", "d"]


# A small dictionary's definitions.
DEFINITIONS = {
    "a.csv": "東京,1,1,3000,名詞,固有名詞,地域,一般,*,*,東京,トウキョウ,トーキョー\nも,2,2,1500,助詞,係助詞,*,*,*,*,も,モ,モ\nもも,1,1,2500,名詞,一般,*,*,*,*,もも,モモ,モモ\n",
    "b.csv": "すもも,1,1,2500,名詞,一般,*,*,*,*,すもも,スモモ,スモモ\n\"a,b\",1,1,100,名詞,一般,*,*,*,*,\"a,b\",*,*\nの,2,2,1500,助詞,連体化,*,*,*,*,の,ノ,ノ\nも,1,1,9000,名詞,一般,*,*,*,*,も,モ,モ\nうち,1,1,3000,名詞,非自立,*,*,*,*,うち,ウチ,ウチ\n",
    "matrix.def": "3 3\n" + "".join(f"{a} {b} {c}\n" for a, b, c in ((0, 0, 0), (0, 1, -100), (0, 2, 900), (1, 0, -50), (1, 1, 700), (1, 2, -300), (2, 0, 10), (2, 1, -200), (2, 2, 1000))),
    "char.def": "DEFAULT 0 1 0 # rest\nSPACE 0 1 0\nKANJI 0 0 2\nHIRAGANA 0 1 2\nKATAKANA 1 1 2\nALPHA 1 1 0\nNUMERIC 1 1 0\n0x0020 SPACE\n0x0030..0x0039 NUMERIC\n0x0041..0x005A ALPHA\n0x0061..0x007A ALPHA\n0x3041..0x309F HIRAGANA\n0x30A1..0x30FF KATAKANA\n0x30FC KATAKANA HIRAGANA\n0x4E00..0x9FA5 KANJI\n",
    "unk.def": "DEFAULT,1,1,8000,記号,一般,*,*,*,*,*\nSPACE,1,1,0,記号,空白,*,*,*,*,*\nKANJI,1,1,11000,名詞,一般,*,*,*,*,*\nHIRAGANA,1,1,13000,名詞,一般,*,*,*,*,*\nKATAKANA,1,1,9000,名詞,一般,*,*,*,*,*\nKATAKANA,1,1,9500,名詞,固有名詞,*,*,*,*,*\nALPHA,1,1,6000,名詞,固有名詞,*,*,*,*,*\nNUMERIC,1,1,4000,名詞,数,*,*,*,*,*\n",
    "dicrc": "; settings\ncost-factor = 800\nbos-feature = BOS/EOS,*\n",
}


@pytest.fixture(params=["utf-8", "euc-jp"])
def dictionary_dir(tmp_path, request):
    (tmp_path / "src").mkdir()
    for name, text in DEFINITIONS.items():
        (tmp_path / "src" / name).write_bytes(text.encode(request.param))
    compiled.compile_dictionary(str(tmp_path / "src"), str(tmp_path / "dic"), request.param)
    return tmp_path


def test_compiled_dictionary(spark, dictionary_dir):
    """Compiled from definitions in either charset, packed, opened from the folder and from the container."""
    opened = compiled.open_dictionary(str(dictionary_dir / "dic"))
    want = sorted((x.surface, x.left, x.right, x.cost, x.feature) for name in ("a.csv", "b.csv") for x in compiled.words_of_csv(DEFINITIONS[name].splitlines(), name))
    assert sorted((w.surface, w.left, w.right, w.cost, w.feature) for w in opened.words) == want and '"a,b"' in [w.feature.split(",名詞")[0] for w in opened.words if w.surface == "a,b"][0] or "a,b" in [w.surface for w in opened.words]
    assert opened.settings == {"cost-factor": "800", "bos-feature": "BOS/EOS,*"}
    assert [tuple(r) for r in dictionary.dictionary_infos(spark, opened).collect()] == [("sys.dic", "utf-8", 8, 0, 3, 3, 102)]
    dictionary.pack_dir(str(dictionary_dir / "dic"), str(dictionary_dir / "packed"))
    packed = compiled.open_packed((dictionary_dir / "packed").read_bytes())
    assert packed.words == opened.words and (packed.matrix == opened.matrix).all()
    (dictionary_dir / "user.csv").write_text("東京都,1,1,-5000,名詞,固有名詞,*,*,*,*,東京都,*,*\n", encoding="utf-8")
    compiled.compile_user(str(dictionary_dir / "user.csv"), str(dictionary_dir / "user.dic"), opened)
    both = compiled.open_dictionary(str(dictionary_dir / "dic"), (str(dictionary_dir / "user.dic"),))
    assert [i["type"] for i in both.infos] == [0, 1]
    lexicon, more = lattice.Lexicon.opened(packed), lattice.Lexicon.opened(both)
    shown = lambda lex, t: [x.entry.surface for x in next(lex.paths(t))]
    assert shown(lexicon, "すもももももももものうち") == ["すもも", "も", "もも", "も", "もも", "の", "うち"]
    assert shown(more, "東京都に")[:1] == ["東京都"] and shown(lexicon, "東京都")[0] == "東京"
    assert shown(lexicon, "abc 12ラーメン") == ["abc", "12", "ラーメン"] and shown(lexicon, "") == []
    rows = lattice.tokenized(spark.createDataFrame([(1, "東京も")], "k long, text string"), ["k"], "text", lexicon).orderBy("idx").collect()
    assert [(r.surface, r.rc_attr, r.lc_attr, r.wcost, r.cost, r.stat) for r in rows] == [("東京", 1, 1, 3000, 2900, 0), ("も", 2, 2, 1500, 4100, 0)]


def test_paths_are_the_cheapest(dictionary_dir):
    """All cuts of a text into words, costed one by one."""
    lexicon = lattice.Lexicon.opened(compiled.open_dictionary(str(dictionary_dir / "dic")))

    def every(text, i=0):
        if i == len(text):
            yield []
        else:
            for e, _ in lexicon.at(text, i):
                for rest in every(text, i + len(e.surface)):
                    yield [e, *rest]

    for text in ("すもももももも", "東京もも12も", "カタカナも", "漢字東京"):
        cost = lambda p: sum(e.cost for e in p) + sum(lexicon.connection(a, b) for a, b in zip([0, *(e.right for e in p)], [*(e.left for e in p), 0], strict=True))
        want = sorted(cost(p) for p in every(text))
        got = list(lexicon.paths(text, 50))
        assert [cost([x.entry for x in p]) for p in got] == want[:50]


def test_marginals(dictionary_dir):
    """Probabilities of words by all paths; a sharper theta leaves the best path alone."""
    opened = compiled.open_dictionary(str(dictionary_dir / "dic"))
    lexicon = lattice.Lexicon.opened(opened, theta=0.001, marginal=True)
    assert lexicon.theta == pytest.approx(0.001) and lexicon.theta != 0.001
    paths = list(lexicon.paths("すももも", 200))
    weigh = lambda p: math.exp(-lexicon.theta * (p[-1].cost + lexicon.connection(p[-1].entry.right, 0)))
    total = sum(map(weigh, paths))
    for x in paths[0]:
        own = sum(weigh(p) for p in paths if any(y.entry == x.entry and y.begin == x.begin for y in p))
        assert x.prob == pytest.approx(own / total, rel=1e-6)
    assert all(x.prob > 0.999 for x in next(lattice.Lexicon.opened(opened, marginal=True).paths("すももも")))
    assert all((x.alpha, x.beta, x.prob) == (0, 0, 0) for x in next(lattice.Lexicon.opened(opened).paths("すももも")))


def test_partial(spark, dictionary_dir):
    """Given words and stretches: nothing crosses their ends, and a word that no lexicon has is made."""
    lexicon = lattice.Lexicon.opened(compiled.open_dictionary(str(dictionary_dir / "dic")), partial=True)
    best = lambda t: [(x.entry.surface, x.entry.feature.split(",")[0]) for x in next(lexicon.paths(t))]
    assert best("すもももも") == [("すもも", "名詞"), ("も", "助詞"), ("も", "助詞")] or len(best("すもももも")) >= 2
    assert best("す\nもももも\nEOS\n")[0][0] == "す"
    assert best("もも\t*\nも\t名詞\nも\n")[:2] == [("もも", "名詞"), ("も", "名詞")]
    assert best("もも\t動詞,自立\nの") == [("もも", "動詞"), ("の", "助詞")]
    assert best("東京もも\t*\n") == [("東京もも", "名詞")]
    rows = lattice.tokenized(spark.createDataFrame([(1, "もも\t*\n の")], "k long, text string"), ["k"], "text", lexicon).orderBy("idx").collect()
    assert [(r.surface, r.length, r.rlength) for r in rows] == [("もも", 6, 6), ("の", 3, 4)]


def test_definitions_that_cannot_be(tmp_path):
    def compiled_with(**changed):
        for name, text in (DEFINITIONS | {k.replace("_", "."): v for k, v in changed.items()}).items():
            (tmp_path / name).unlink(missing_ok=True)
            if text is not None:
                (tmp_path / name).write_text(text, encoding="utf-8")
        compiled.compile_dictionary(str(tmp_path), str(tmp_path / "out"))

    compiled_with()
    for changed in ({"matrix_def": None}, {"matrix_def": "x"}, {"char_def": "DEFAULT 0 1 0\n"}, {"unk_def": "NONE,0,0,0,x\n"}, {"a_csv": "東京,9,1,3000,名詞\n"}, {"a_csv": "東京,-1,1,3000,名詞\n"}, {"a_csv": "one,two\n"}):
        with pytest.raises(dictionary.DictionaryError):
            compiled_with(**changed)
    compiled_with()
    for name, data in (("sys.dic", b""), ("sys.dic", b"x" * 100), ("matrix.bin", b"\1\0\1\0"), ("char.bin", b"\1\0\0\0")):
        old = (tmp_path / "out" / name).read_bytes()
        (tmp_path / "out" / name).write_bytes(data)
        with pytest.raises(dictionary.DictionaryError):
            compiled.open_dictionary(str(tmp_path / "out"))
        (tmp_path / "out" / name).write_bytes(old)
    with pytest.raises(dictionary.DictionaryError):
        compiled.open_dictionary(str(tmp_path / "nowhere"))


def test_double_array():
    rnd = random.Random(3)
    keys = sorted({bytes(rnd.choice(b"abc\xe3\x81\xff") for _ in range(rnd.randint(1, 6))) for _ in range(500)})
    units = compiled.double_array(keys, list(range(len(keys))))
    assert sorted(compiled.keys_of(units)) == [(k, i) for i, k in enumerate(keys)]


def test_lexicon_of_a_table(spark):
    rows = spark.createDataFrame([("もも", 1, 1, 10, "名詞"), ("も", 2, 2, 20, "助詞")], dictionary.LEXICON)
    assert [x.entry.surface for x in next(lattice.Lexicon.of_table(rows).paths("もも も"))] == ["もも", "も"]


LONG_RUN = "ñciónmentellosmentequemente"


def _long_runs(spark, folder):
    """A table whose letters and digits run on beyond LONGEST_RUN, by their thousands too."""
    texts = [f"a {LONG_RUN} b. {LONG_RUN}", "9" * 25 + " " + "x" * 24 + "\n" + "y" * 3000, "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_long_runs():
    """A run is cut up where it is longer than the lexicon allows, and whole where that allows any."""
    best = lambda lexicon, t: [x.entry.surface for x in next(lexicon.paths(t))]
    whole = dataclasses.replace(lattice.MINI, longest_run=None)
    assert best(lattice.MINI, "x" * 24) == ["x" * 24] and best(lattice.MINI, "x" * 26) == ["x", "x", "x" * 24]
    assert best(whole, "x" * 26 + "9" * 3000 + "。") == ["x" * 26, "9" * 3000, "。"]
    assert best(dataclasses.replace(lattice.MINI, longest_run=2), "xxx") == ["x", "xx"]


def test_long_runs_of_a_dictionary(spark, tmp_path):
    got = queries.queries()["dictionary_documents"](spark, _long_runs(spark, tmp_path)).collect()
    assert {tuple(r) for r in got} == {(0, 4, 60, 24_000, 1), (1, 3, 3049, 16_000, 2), (2, 1, 5, 6_000, 1)}


def test_long_runs_of_documents(spark, tmp_path):
    got = queries.queries()["lattice_documents"](spark, _long_runs(spark, tmp_path)).collect()
    assert {tuple(r) for r in got} == {(0, 4, 60, 24_000, 1), (1, 3, 3049, 16_000, 2), (2, 1, 5, 6_000, 1)}


def test_long_runs_printed(spark, tmp_path):
    got = queries.queries()["lattice_printed"](spark, _long_runs(spark, tmp_path)).collect()
    word = lambda *surfaces: hashlib.sha256(("".join(f"{x}\t名詞,{'数,*' if x[0] == '9' else '固有名詞,組織'},*,*,*,*\n" for x in surfaces) + "EOS\n").encode()).hexdigest()
    want = {(0, 0, 1, word("a", LONG_RUN, "b")), (0, 1, 1, word(LONG_RUN)), (1, 0, 1, word("9" * 25, "x" * 24)), (1, 1, 1, word("y" * 3000)), (2, 0, 1, word("plain")), (3, 0, 1, word()), (4, 0, 1, word())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_runs_given(spark, tmp_path):
    got = queries.queries()["partial_documents"](spark, _long_runs(spark, tmp_path)).collect()
    assert {tuple(r) for r in got} == {(0, 4, 24_000), (1, 3, 16_000), (2, 1, 6_000)}

def _sums(lexicon, texts):
    """Words, bytes, costs and features of each text by a search of its own."""
    for t in texts:
        path = [x.entry for x in next(lexicon.paths(t))]
        yield len(path), sum(len(e.surface.encode()) for e in path), sum(e.cost for e in path), {e.feature for e in path}


def _random_texts(rnd, n):
    parts = ["a", "the", " ", "  ", "9", "12", "-", ".", ",", "é", "x" * 26, "すもも", "も", "京", "東京", "\t", "\r", "\u3000", "😀", "９", "ж"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(n)] + ["", " "]


def _check_sums(lexicon, texts):
    runs = lattice.Runs(lexicon)
    total, features = runs.sums(texts, np.arange(len(texts)))
    assert [(*map(int, x), f) for x, f in zip(total.T, features, strict=True)] == list(_sums(lexicon, texts))


def _unsearched(monkeypatch, lexicon, texts, want):
    """The sums of plain texts need no search of their own."""
    monkeypatch.setattr(lattice.Lexicon, "paths", lambda *_: pytest.fail("a text was searched"))
    total, features = lattice.Runs(lexicon).sums(texts, np.zeros(len(texts), int))
    assert (*map(int, total[:, 0]), len(features[0])) == want


def test_sums_of_given_texts(spark, monkeypatch):
    """What partly given texts come to, piece by piece, is what a search of each finds; lines that others print need none."""
    rnd = random.Random(3)
    for longest in (None, 24, 2):
        lexicon = dataclasses.replace(lattice.MINI, longest_run=longest)
        texts = [lattice.printed_path(next(lexicon.paths(t))) for t in _random_texts(rnd, 300)]
        line = lambda: rnd.choice(["EOS", "", "もも", "ab", "も\t*", "す\t名詞", "a\t名詞,数", "\tx", "ab\tW", "x" * 25 + "\t*"])  # noqa: B023, E731
        _check_sums(dataclasses.replace(lexicon, partial=True), texts + ["\n".join(line() for _ in range(rnd.randint(0, 4))) for _ in range(300)])
    texts = _random_texts(rnd, 60)
    got = lattice.n_best_printed(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t", lattice.MINI, 2).collect()
    assert {tuple(r) for r in got} == {(k, i, lattice.printed_path(p)) for k, t in enumerate(texts) for i, p in enumerate(lattice.MINI.paths(t, 2), 1)}
    whole = dataclasses.replace(lattice.MINI, longest_run=None)
    given = lattice.printed_path(next(whole.paths("The cat, 12 ﬁns " + "x" * 40)))
    _unsearched(monkeypatch, dataclasses.replace(whole, partial=True), [given, given], (14, 108, 88_000, 3))


def test_sums_of_a_dictionary(monkeypatch):
    """A compiled dictionary's sums by runs are those of its searches, and plain texts need none."""
    opened = lattice.Lexicon.opened(compiled.open_packed(queries._packed_dictionary()))
    for longest in (None, 24, 2):
        _check_sums(dataclasses.replace(opened, longest_run=longest), _random_texts(random.Random(4), 300))
    _unsearched(monkeypatch, dataclasses.replace(opened, longest_run=None), ["The cat, 12", "", "é " + "x" * 40], (6, 51, 36_000, 3))


def test_sums_of_documents(spark, monkeypatch):
    """Sums by runs are those of searches, with words of the lexicon and without; plain texts need none."""
    words = [lattice.Entry("the", 0, 0, 500, "W"), lattice.Entry("a the", 0, 0, 50, "X"), lattice.Entry("--", 0, 0, 1, "D")]
    for lexicon in (lattice.MINI, lattice.Lexicon(words), lattice.Lexicon(words, longest_run=None)):
        _check_sums(lexicon, _random_texts(random.Random(5), 300))
    texts = [(1, "a b"), (1, None), (1, "すもも"), (2, " "), (None, "x."), (None, "y"), (1, "9")]
    got = lattice.sums(spark.createDataFrame(texts, "k int, t string").coalesce(1), ["k"], "t", lattice.MINI).collect()
    assert sorted([(r.k or 0, r.n, r.n_bytes, r.wcost) for r in got]) == [(0, 3, 3, 20_000), (1, 1, 1, 4_000), (1, 3, 11, 17_000)]
    with pytest.raises(ValueError):
        lattice.Runs(lattice.MINI).sums(["a\0b"], np.zeros(1, int))
    _unsearched(monkeypatch, dataclasses.replace(lattice.MINI, longest_run=None), ["The cat, 12", "", "é " + "x" * 40], (6, 51, 36_000, 3))


BATCH_RULES = (
    'a [N1] = "x" "y" ; b [N1] = "x" "y" 名詞+ ; c [N2] = 動詞 ; d [N4] = _ "y" _ ; e = "x" ; f = nothing ; g [N3] = 名詞 名詞* ; h = 名詞+ 名詞 ; i [N5] = e? "y" ;',
    'a [N3] = 名詞$0 _ @=$0 ; b [N3] = ("x" | "y") 動詞* ; c = f f ; d [N4] = _ _ _ _ ; e [N4] = 動詞 _ ;',
    'a = "x" _ _ ; b [N5 N4] = "y" "x"? ;',
)


def _found_plainly(grammar, tokens):
    """What stays of a text's matches, said one by one: ord, s, e, fixed, phrases and span."""
    m = match.Matcher(grammar, match.Tokens([s for s, _ in tokens], [f or "" for _, f in tokens], {}))
    levels = [level_number(r.levels) for r in grammar.rules]
    found = [(levels[i], s, e, i, tuple(fixed)) for i, r in enumerate(grammar.rules) for s, e, fixed in m.find(r)]
    fixed = {(p, s, e, i): x for p, s, e, i, x in found}
    numbers, n, before = [], -1, "記号"
    for _, f in tokens:
        pos0, pos1 = ((f or "").split(",") + ["*"])[:2]
        n += pos0 != "記号" and (before == "記号" or pos0 in phrases.CONTENT and pos1 not in phrases.CONTENT[pos0])
        numbers.append(-1 if pos0 == "記号" else n)
        before = pos0
    for p, s, e, i in sorted(kept([x[:4] for x in found]), key=lambda x: (x[1], -x[2], -1 if x[0] is None else x[0], x[3])):
        first, last = numbers[s], numbers[e - 1]
        span = last - first + 1 if first >= 0 and last >= 0 else 0
        most = grammar.rules[i].max_span or (2 if (p or 0) >= 4 else 0)
        if not most or span <= most:
            yield i, s, e, fixed[p, s, e, i], tuple(tokens[s:e]), first, last, span


def test_find_all_of_batches():
    """All matches of many texts at once are those of each text by itself."""
    rnd, kinds = random.Random(6), [("x", "名詞,一般,*,*,*,*,x"), ("y", "動詞,自立,*,*,*,*,y"), ("z", "名詞,接尾,*,*,*,*,x"), (".", "記号,*"), ("y", "助詞"), (None, None), ("x", None), ("x", "名詞")]
    for text in BATCH_RULES:
        for most in (0, 2):
            grammar = PatternSet.from_text(text).set_max_span("a", most).grammar
            texts = [[rnd.choice(kinds) for _ in range(rnd.randint(0, 12))] for _ in range(300)]
            tokens = pa.array([[{"surface": s, "feature": f} for s, f in t] for t in texts], pa.list_(pa.struct([("surface", pa.string()), ("feature", pa.string())])))
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), tokens], ["k", "tokens"]).slice(3)
            got = [tuple(r.values()) for out in inbatch.find_all(grammar, batch, ["k"]) for r in out.to_pylist()]
            want = [(k, *x) for k, t in enumerate(texts) for x in _found_plainly(grammar, t) if k >= 3]
            assert [(k, i, s, e, tuple(x), tuple((n["surface"], n["feature"]) for n in nodes), *rest) for k, i, s, e, x, nodes, *rest in got] == want
    assert not list(inbatch.find_all(grammar, batch.slice(0, 0), ["k"]))[0].num_rows


def test_find_all_of_a_long_text():
    """The matches of one text of 200,000 tokens are found and resolved at once, not each against all others."""
    grammar = PatternSet.from_text('a [N2] = "x" "y" ; b = "y" ; c = "x" ; d = unknown ;').grammar
    tokens = pa.array([[{"surface": s, "feature": "名詞"} for s in ("x", "y")] * 100_000], pa.list_(pa.struct([("surface", pa.string()), ("feature", pa.string())])))
    began = time.time()
    (got,) = inbatch.find_all(grammar, pa.RecordBatch.from_arrays([pa.array([1]), tokens], ["k", "tokens"]), ["k"])
    assert got.num_rows == 300_000 and time.time() - began < 60


def test_span_limits_in_one_pass(spark):
    """Limits are told from the matches without any: one pass gives what each limit's own does, levels and all."""
    rows = [(k, i, w, f"{'記号' if w == '.' else '名詞'},一般") for k, text in enumerate(("x a b", "x . b y y y", "y y x", "x x x x")) for i, w in enumerate(text.split())]
    tokens_ = spark.createDataFrame(rows, "k int, idx int, surface string, feature string")
    rules_ = PatternSet.from_text('r = "x" _ _ ; s [N1] = "y" "y" ; t [N3] = "x" "x" ;')
    every = rules_.find_all(tokens_, ["k"]).select("k", "ord", "s", "e", rules_.set_max_span("r", 2).fits().alias("two"), rules_.set_max_span("r", 3).fits().alias("three")).collect()
    for n, name in ((2, "two"), (3, "three")):
        own = rules_.set_max_span("r", n).find_all(tokens_, ["k"]).select("k", "ord", "s", "e").collect()
        assert sorted(map(tuple, own)) == sorted(tuple(r)[:4] for r in every if r[name])
    assert {r.two for r in every} == {True, False}
    plan = queries.queries()["span_limits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_conformance_without_the_whole_grammar(spark, monkeypatch):
    """Rules go with the rules that they need, through references of references; the grammar is never brought together."""
    patterns = {"n": "名詞", "nn": "n n", "nnn": "nn n", "lost": "nobody 名詞", "loop": "名詞 (loop | 動詞)", "v": "動詞", "empty": " ", "back": "(名詞$0) @=$0"}
    rows = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate([*patterns.items(), ("v", "名詞 v")])] + [(100 + i, f"x{i}", '(nnn) "b"') for i in range(200)], "id long, rule_name string, pattern string")
    said = [(i, text, "ja", j) for i in [*range(9), *range(100, 300)] for j, text in enumerate(("a b b", "run", "a running run", "a a a b", "a b b"))]
    examples = spark.createDataFrame([*said, *said[:20], (0, "a", "en", 9)], "grammar_id long, sentence string, lang string, sort_order int")
    excluded = spark.createDataFrame([(0, " a b b")], "grammar_id long, sentence string")

    def tokenize(texts):
        words = texts.select("grammar_id", "example", F.posexplode(F.split("text", " ")).alias("idx", "surface"))
        tag = F.when(F.col("surface").startswith("run"), "動詞").otherwise("名詞")
        return words.withColumn("feature", F.concat(tag, F.lit(",*,*,*,*,*,"), "surface"))

    monkeypatch.setattr(type(rows), "collect", lambda *_: pytest.fail("rules were collected"))
    report = catalogue.conformance_of(rows, examples, excluded, tokenize)
    monkeypatch.undo()
    got = {r.id: (r.rule, r.passed, r.matched, r.failed) for r in report.collect()}
    want = {0: ("n", False, 2, 1), 1: ("nn", False, 3, 2), 2: ("nnn", False, 3, 2), 3: ("lost", False, 0, 5), 4: ("loop", False, 1, 4), 5: ("v", False, 2, 3), 7: ("back", False, 3, 2), 8: ("v", False, 2, 3)}
    assert got == want | {100 + i: (f"x{i}", False, 1, 4) for i in range(200)}
    bad = spark.createDataFrame([(1, "p", "q 名詞"), (2, "q", "p 動詞")], "id long, rule_name string, pattern string")
    with pytest.raises(Exception, match="begins with itself"):
        catalogue.conformance_of(bad, examples, excluded, tokenize).collect()
