"""The rule catalogue: pages to records, and records into the catalogue's tables."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.pattern import Ref, parse, parts_of
from ..sources.rules import rule_id
from .match import nested, tested

TAG = r"<[^>]*>"
# Scripts by their code points, sites by a part of their address, and the words by which pages name their parts.
HIRAGANA, KANA, HAN = r"[\x{3040}-\x{309F}]", r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]", r"[\x{4E00}-\x{9FFF}]"
SITES = {"mainichi-nonbiri": "mainichi_nonbiri", "nihongokyoshi-net": "nihongokyoshi_net"}
PARTS = {"description": ("解説",), "connection": ("接続", "つなぎ方"), "meaning": ("意味",)}
EXAMPLES, CONNECTION = "例文", ("接続", "つなぎ方", "Vて", "Nの")
#: Elements whose text is one part of a section; one within another of its own kind ends at the first end tag.
BLOCKS = "p|div|ul|ol|dl|table|blockquote|pre|section|figure"
TRANSLATIONS = "array<struct<lang: string, text: string>>"


# ---------------------------------------------------------------- pages


def fetch(url: str, get: Callable[[str], str] | None = None, tries: int = 5, wait: Callable[[float], None] = time.sleep) -> str | None:
    """A page's text; null after ``tries`` failures with waits of 5, 10, 20 ... 120 seconds."""
    get = get or (lambda u: urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": "Mozilla/5.0"}), timeout=30).read().decode("utf-8", "replace"))
    for i in range(tries):
        try:
            return get(url)
        except Exception:  # noqa: BLE001  whatever failed, the next try may not
            if i + 1 < tries:
                wait(min(5.0 * 2**i, 120.0))
    return None


def source_of(url: Column, known: dict[str, str] = SITES, otherwise: str = "unknown") -> Column:
    """The name of the first part that a URL holds."""
    out = F.lit(otherwise)
    for part, name in reversed(known.items()):
        out = F.when(url.contains(part), F.lit(name)).otherwise(out)
    return out


def half_width_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def unmarked(html: Column) -> Column:
    """The text of a piece of HTML: without tags, with the common entities resolved; blanks and lines as they are."""
    text = F.regexp_replace(html, TAG, "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def plain(html: Column) -> Column:
    """The text of a piece of HTML, with blanks as one."""
    return F.trim(F.regexp_replace(unmarked(html), r"\s+", " "))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title_of(html: Column) -> Column:
    """h1, else title, else nothing; cut at a bar and at the words for 'meaning of'."""
    h1, title = (F.regexp_extract(html, f"(?is)<{t}[^>]*>(.*?)</{t}>", 1) for t in ("h1", "title"))
    found = F.when(plain(h1) != "", plain(h1)).otherwise(plain(title))
    return F.trim(F.regexp_replace(F.regexp_replace(found, r"(?s)\s*[|｜].*$", ""), r"(?s)の意味.*$", ""))


def level_of(title: Column, html: Column) -> Column:
    """The title's mark in full-width characters, else the first level after JLPT, else the first at all, else nothing."""
    marked = half_width_digits(F.regexp_extract(title, r"【Ｎ([０-９])文法】", 1))
    first = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return F.coalesce(F.when(marked != "", F.concat(F.lit("N"), marked)), first(r"(?i)JLPT\s*(N[1-5])"), first(r"(N[1-5])"), F.lit(""))


def name_of(title: Column) -> Column:
    """The title without its mark of a level."""
    return F.trim(F.regexp_replace(title, r"【Ｎ[０-９]文法】", ""))


def sections(html: Column) -> Column:
    """The parts of a page that an h2, h3 or h4 begins: array of heading and parts (the text of each element up to the next heading)."""
    cut = F.filter(F.split(html, r"(?i)(?=<h[234][ >])", -1), lambda x: x.rlike(r"(?is)^<h([234])[^>]*>.*?</h\1>"))
    pattern = r"(?is)^<h([234])[^>]*>(.*?)</h\1>(.*)$"

    def part(x: Column) -> Column:
        elements = F.regexp_extract_all(F.regexp_extract(x, pattern, 3), F.lit(rf"(?is)<({BLOCKS})\b[^>]*>.*?</\1>"), F.lit(0))
        texts = F.filter(F.transform(elements, lambda e: _trimmed(unmarked(e))), lambda t: t != "")
        return F.struct(plain(F.regexp_extract(x, pattern, 2)).alias("heading"), texts.alias("parts"))

    return F.transform(cut, part)


def first_sections(found: Column, words: dict[str, tuple[str, ...]] = PARTS) -> Column:
    """A struct of the text of the first section for each name: one whose heading holds one of its words.

    A section without text counts for nothing, and one section for one name: the first whose words it has and that has none yet.
    """
    names = list(words)
    start = F.struct(*[F.lit("").alias(n) for n in names])

    def step(held: Column, x: Column) -> Column:
        taken, fields = F.size(x["parts"]) == 0, []
        for n in names:
            hit = F.lit(False)
            for w in words[n]:
                hit = hit | x["heading"].contains(w)
            mine = ~taken & hit & (held[n] == "")
            fields.append(F.when(mine, F.array_join(x["parts"], "\n")).otherwise(held[n]).alias(n))
            taken = taken | mine
        return F.struct(*fields)

    return F.aggregate(found, start, step)


def language_of(text: Column) -> Column:
    """zh: Han and no kana; en: begins with a letter A-Z; else null."""
    return F.when(text.rlike(HAN) & ~text.rlike(KANA), "zh").when(text.rlike("^[A-Za-z]"), "en")


def numbered_examples(found: Column) -> Column:
    """The examples of the first section for them: array of sentence and translations.

    In each element's text a line ``(1) sentence`` begins an example, and the lines after it are its translations where
    their language can be told; a number without a sentence begins nothing, and ends the one before.
    """
    number = r"^[（(]\s*[0-9０-９]+\s*[）)]"
    section = F.get(F.filter(found, lambda x: x["heading"].contains(EXAMPLES)), 0)
    unplayed = lambda t: F.trim(F.regexp_replace(t, r"\s*▶\s*$", ""))
    kind = f"array<struct<sentence: string, translations: {TRANSLATIONS}>>"

    def step(held: Column, line: Column) -> Column:
        begins, said = line.rlike(number), unplayed(line)
        rest = _trimmed(F.regexp_replace(line, number, ""))
        sentence = F.when(rest != "", unplayed(rest))
        one = F.struct(sentence.alias("sentence"), F.array().cast(TRANSLATIONS).alias("translations"))
        last, lang = F.element_at(held, -1), language_of(said)
        more = F.struct(last["sentence"].alias("sentence"), F.concat(last["translations"], F.array(F.struct(lang.alias("lang"), said.alias("text")))).alias("translations"))
        return F.when(begins, F.concat(held, F.array(one))).when((F.size(held) > 0) & lang.isNotNull(), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(more))).otherwise(held)

    def of(part: Column) -> Column:
        lines = F.filter(F.transform(F.split(part, "\n"), _trimmed), lambda x: x != "")
        return F.filter(F.aggregate(lines, F.array().cast(kind), step), lambda x: x["sentence"].isNotNull())

    return F.coalesce(F.flatten(F.transform(section["parts"], of)), F.array().cast(kind))


def records(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with rule_name, levels, name, description (with the meaning), connection, pattern (empty), examples and source."""
    title = title_of(F.col(html))
    out = pages.withColumns({"_title": title, "_sections": sections(F.col(html))}).withColumn("_first", first_sections(F.col("_sections")))
    about, meaning = F.col("_first.description"), F.col("_first.meaning")
    said = F.when(meaning == "", about).when(about == "", meaning).otherwise(F.concat(about, F.lit("\n\n【意味】\n"), meaning))
    return out.withColumns(
        {"rule_name": rule_id(F.col(url)), "levels": level_of(F.col("_title"), F.col(html)), "name": name_of(F.col("_title")), "description": said, "connection": F.col("_first.connection"), "pattern": F.lit(""), "examples": numbered_examples(F.col("_sections")), "source": source_of(F.col(url))}
    ).drop("_title", "_sections", "_first")


_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def href_of(anchor: Column) -> Column:
    """The address of a link, in quotes of either kind or in none."""
    return F.concat(*[F.regexp_extract(anchor, _HREF, i) for i in (1, 2, 3)])


def _holding(column: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | column.contains(part)
    return hit


def links(pages: DataFrame, key: str, html: str, holding: tuple[str, ...] | None = ("/grammar/", "grammar-")) -> DataFrame:
    """key, place, href and text of the links with an address and a text, whose address holds one of ``holding`` (null: any)."""
    anchors = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href\s*=[^>]*>.*?</a>"), F.lit(0))).alias("place", "a"))
    out = anchors.select(key, "place", href_of(F.col("a")).alias("href"), plain(F.col("a")).alias("text")).where("text <> '' AND href <> ''")
    return out if holding is None else out.where(_holding(F.col("href"), holding))


def links_by_level(pages: DataFrame, key: str, html: str, holding: tuple[str, ...] = ("grammar", "jlpt")) -> DataFrame:
    """key, place, href, text and level of the links under an h2 or h3 that names a level."""
    marks = F.regexp_extract_all(html, F.lit(r"(?is)<h([23])\b[^>]*>.*?</h\1>|<a\s[^>]*href\s*=[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(key, F.posexplode(marks).alias("place", "mark")).withColumn("heading", F.when(F.col("mark").rlike("(?i)^<h"), plain(F.col("mark"))))
    along = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("level", F.regexp_extract(F.last("heading", ignorenulls=True).over(along), "(N[1-5])", 1)).where("heading IS NULL AND level <> ''")
    out = held.select(key, "place", href_of(F.col("mark")).alias("href"), plain(F.col("mark")).alias("text"), "level")
    return out.where(_holding(F.col("href"), holding))


def absolute(href: Column, root: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(root), href))


def first_place_last_value(rows: DataFrame, by: str, place: str, columns: list[str]) -> DataFrame:
    """One row for each ``by``: where it came first, and what it held last."""
    return rows.groupBy(by).agg(F.min(place).alias(place), F.max_by(F.struct(*columns), place).alias("v")).select(by, place, *[f"v.{c}" for c in columns])


def head(text: Column, most: int) -> Column:
    """The first characters of a text (code points, where others count surrogates)."""
    return F.substring(_trimmed(text), 1, most)


def connection_of(texts: Column, most: int = 100) -> Column:
    """Of the texts of a page's elements, what the first that names a connection says of it; else nothing."""
    pattern = r"(?:接続|つなぎ方)[：:]?\s*(.+)"
    said = F.filter(F.transform(texts, _trimmed), lambda t: _holding(t, CONNECTION) & t.rlike(pattern))
    return F.coalesce(head(F.regexp_extract(F.get(said, 0), pattern, 1), most), F.lit(""))


def top_examples(lines: DataFrame, key: str, most: int = 5, low: int = 5, high: int = 150, without: tuple[str, ...] = ("接続", "意味"), letters: str | None = f"{HIRAGANA}|{HAN}") -> DataFrame:
    """The first ``most`` different lines (key, place, line) of each key that may be examples: key, rank, line.

    A line is judged as it stands; a number before it goes after that.
    """
    line = F.trim("line")
    fit = (F.char_length(line) > low) & (F.char_length(line) < high) & ~_holding(line, without)
    rows = lines.where(fit & line.rlike(letters) if letters else fit).select(key, "place", F.trim(F.regexp_replace(line, r"^[①②③④⑤⑥⑦⑧⑨⑩0-9]+[.)）]\s*", "")).alias("line")).where("line <> ''")
    once = rows.groupBy(key, "line").agg(F.min("place").alias("place"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("rank") <= most).select(key, "rank", "line")


# ---------------------------------------------------------------- tables


def page_of(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return rows.orderBy("id").offset(offset).limit(limit)


def with_examples(grammars: DataFrame, examples: DataFrame) -> DataFrame:
    """Each grammar with the array of its examples in order."""
    own = examples.groupBy(F.col("grammar_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", F.col("id").alias("example_id"), "lang", "sentence"))), lambda x: F.struct(x["lang"].alias("lang"), x["sentence"].alias("sentence"))).alias("examples"))
    return grammars.join(own, "id", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<struct<lang: string, sentence: string>>")))


def updated_patterns(grammars: DataFrame, updates: DataFrame) -> DataFrame:
    """``grammars`` with the patterns of ``updates`` (id, pattern; null: empty), the last of each id."""
    new = updates.withColumn("_n", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by(F.coalesce("pattern", F.lit("")), "_n").alias("_new"))
    return grammars.join(new, "id", "left").withColumns({"pattern": F.coalesce("_new", "pattern"), "updated_at": F.when(F.col("_new").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at"))}).drop("_new")


def read_updates(lines: DataFrame) -> DataFrame:
    """The updates in rows of JSON text: arrays of id and pattern."""
    return lines.select(F.explode(F.from_json("value", "array<struct<id: bigint, pattern: string>>")).alias("u")).select("u.id", "u.pattern")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records by rule_name: new ones are added; of known ones all but the pattern is renewed, and a manual source stays.

    Known records keep their id and created_at; new ones get the ids after the largest, in order of rule_name (they are as
    many as people have written since).  ``new`` may lack id and the times.
    """
    fields = ("levels", "name", "description", "connection", "source_url")
    o, n = old.select(F.struct("*").alias("o")), new.select(F.struct("*").alias("n"))
    both = o.join(n, F.col("o.rule_name") == F.col("n.rule_name"), "full")
    known, renewed = F.col("o.rule_name").isNotNull(), F.col("n.rule_name").isNotNull()
    pick = lambda c: F.when(renewed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    source = F.when(renewed & ~(known & F.coalesce(F.col("o.source") == "manual", F.lit(False))), F.col("n.source")).otherwise(F.col("o.source"))
    out = both.select(F.col("o.id").alias("id"), F.coalesce("o.rule_name", "n.rule_name").alias("rule_name"), *map(pick, fields), F.when(known, F.col("o.pattern")).otherwise(F.col("n.pattern")).alias("pattern"), source.alias("source"), F.when(known, F.col("o.created_at")).otherwise(F.current_timestamp()).alias("created_at"), F.when(renewed, F.current_timestamp()).otherwise(F.col("o.updated_at")).alias("updated_at"))
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = out.where("id IS NULL").drop("id").withColumn("_n", F.row_number().over(Window.orderBy("rule_name")))
    names = ["id", "rule_name", "levels", "name", "description", "connection", "pattern", "source", "source_url", "created_at", "updated_at"]
    return out.where("id IS NOT NULL").select(*names).unionByName(added.withColumn("id", F.lit(last) + F.col("_n")).select(*names))


def replaced_examples(old: DataFrame, new: DataFrame, excluded: DataFrame, manual: DataFrame) -> DataFrame:
    """Examples (grammar_id, sentence, lang, sort_order) after grammars' new ones took the old ones' place.

    new: grammar_id and the array ``examples`` of sentence and translations, or ``sentences`` of plain ones.  Grammars in
    ``manual`` (grammar_id), and those whose array is empty, keep theirs.  Excluded sentences are left out, with their
    translations; the others keep their place in the array, gaps and all.  A translation has its sentence's place.
    """
    if "examples" not in new.columns:
        new = new.select("grammar_id", F.transform("sentences", lambda s: F.struct(s.alias("sentence"), F.array().cast(TRANSLATIONS).alias("translations"))).alias("examples"))
    taken = new.where(F.size("examples") > 0).join(manual, "grammar_id", "left_anti")
    rows = taken.select("grammar_id", F.posexplode("examples").alias("sort_order", "x")).select("grammar_id", "sort_order", "x.sentence", "x.translations").join(excluded, ["grammar_id", "sentence"], "left_anti")
    own = F.array(F.struct(F.lit("ja").alias("lang"), F.col("sentence").alias("text")))
    said = rows.select("grammar_id", "sort_order", F.explode(F.concat(own, "translations")).alias("t"))
    kept = old.join(taken.select("grammar_id"), "grammar_id", "left_anti").select("grammar_id", "sentence", "lang", "sort_order")
    return kept.unionByName(said.select("grammar_id", F.col("t.text").alias("sentence"), F.col("t.lang").alias("lang"), "sort_order"))


def example_counts(grammars: DataFrame, examples: DataFrame) -> DataFrame:
    """Each grammar's id and its number of examples, none included."""
    own = examples.groupBy(F.col("grammar_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return grammars.select("id").join(own, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def totals(grammars: DataFrame, examples: DataFrame) -> DataFrame:
    """One row: the number of grammars and of examples."""
    rows = grammars.select(F.lit("g").alias("kind")).unionByName(examples.select(F.lit("e").alias("kind")))
    return rows.agg(F.count_if(F.col("kind") == "g").alias("grammars"), F.count_if(F.col("kind") == "e").alias("examples"))


def with_pattern(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("pattern").isNotNull() & (F.trim("pattern") != ""))


def without_pairs(examples: DataFrame, excluded: DataFrame) -> DataFrame:
    """Examples whose id and trimmed sentence are not excluded."""
    gone = excluded.select("grammar_id", F.trim("sentence").alias("_s")).distinct()
    return examples.withColumn("_s", F.trim("sentence")).join(gone, ["grammar_id", "_s"], "left_anti").drop("_s")


def filtered(rules: DataFrame, name: str | None = None, level: str | None = None, holding: str | None = None) -> DataFrame:
    """Rules by name, by one of the comma-separated levels, and by a part of name and pattern."""
    if name is not None:
        rules = rules.where(F.col("rule_name") == name)
    if level is not None:
        rules = rules.where(F.array_contains(F.transform(F.split("levels", ","), F.trim), level))
    if holding is not None:
        rules = rules.where(F.concat_ws(" ", "rule_name", "pattern").contains(holding))
    return rules


def conformance(hits: DataFrame) -> DataFrame:
    """For hits (rule, hit; null: the rule has no example): rule, passed (all its examples match; null if it has none), matched, failed."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return hits.groupBy("rule").agg(F.bool_and("hit").alias("passed"), count(F.col("hit")).alias("matched"), count(~F.col("hit")).alias("failed"))


def _with_needed(asked: DataFrame) -> DataFrame:
    """rule_name and ``lines``: the first rule (id, rule_name, pattern) of each name and all rules that it refers to, by id, as a grammar's text.

    Rules that begin with themselves, and patterns that cannot be read, are refused as in one grammar.
    """
    line = F.concat("rule_name", F.lit(" = "), "pattern", F.lit(" ;"))
    rows = asked.select("id", line.alias("line")).mapInPandas(_names_of, "id long, line string, names array<string>, refs array<string>")
    first = rows.select(F.explode("names").alias("name"), "id").groupBy("name").agg(F.min("id").alias("need"))
    pairs = rows.select("id", F.explode("refs").alias("name")).join(first, "name").select("id", "need").distinct()
    needed = new = pairs
    while not new.isEmpty():
        new = new.withColumnRenamed("need", "by").join(pairs.withColumnRenamed("id", "by"), "by").select("id", "need").distinct().join(needed, ["id", "need"], "left_anti")
        needed = needed.unionByName(new)
    every = needed.unionByName(rows.select("id", F.col("id").alias("need"))).distinct()
    lines = every.join(rows.select(F.col("id").alias("need"), "line"), "need").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("need", "line"))), lambda x: x["line"]).alias("lines"))
    checked = lines.mapInPandas(_checked, "id long, lines array<string>")
    return first.select(F.col("name").alias("rule_name"), F.col("need").alias("id")).join(checked, "id").select("rule_name", "lines")


def _names_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """With each line of a grammar the names of its rules and those that they refer to."""
    for batch in batches:
        names, refs = [], []
        for line in batch["line"]:
            found = parse(line).rules
            names.append([r.name for r in found])
            refs.append(sorted({x.name for r in found for x in parts_of(r.pattern) if isinstance(x, Ref)}))
        yield batch.assign(names=names, refs=refs)


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lines in batch["lines"]:
            parse("\n".join(lines))
        yield batch


def conformance_of(rules: DataFrame, examples: DataFrame, excluded: DataFrame, tokenize: Callable[[DataFrame], DataFrame], fail_limit: int | None = None) -> DataFrame:
    """Whether each rule's own examples match it: id, rule, passed (null: skipped, it has none), matched, failed.

    rules: id, rule_name, pattern; examples: grammar_id, sentence, lang, sort_order; excluded: grammar_id, sentence.
    tokenize makes token rows (grammar_id, example, idx, surface, feature) of rows of grammar_id, example and text.  All rules
    are one grammar, as they may refer to each other, but it stands nowhere as a whole: with each rule go the rules that it
    needs.  A rule without a pattern is not tested.  After fail_limit failures, by id, no more rules are reported.
    """
    asked = with_pattern(rules).select("id", "rule_name", "pattern")
    own = without_pairs(examples.where("lang = 'ja'"), excluded).withColumn("text", F.trim("sentence")).where("text <> ''")
    keys = ["grammar_id", "example"]
    own = own.join(asked.select(F.col("id").alias("grammar_id"), "rule_name"), "grammar_id").select("grammar_id", "rule_name", F.xxhash64("sort_order", "text").alias("example"), "text").dropDuplicates(keys)
    texts = nested(tokenize(own.select(*keys, "text")), keys).join(own.select(*keys, "rule_name"), keys).join(_with_needed(asked), "rule_name")
    hits = own.select(*keys).join(tested(texts, keys, "rule_name", "lines"), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    found = conformance(asked.select(F.col("id").alias("rule")).join(hits.select(F.col("grammar_id").alias("rule"), "hit"), "rule", "left"))
    out = found.join(asked.select(F.col("id").alias("rule"), "rule_name"), "rule").select(F.col("rule").alias("id"), F.col("rule_name").alias("rule"), "passed", "matched", "failed")
    if fail_limit is None:
        return out
    before = F.sum(F.coalesce(~F.col("passed"), F.lit(False)).cast("int")).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < fail_limit).drop("_before")


def conformance_totals(report: DataFrame) -> DataFrame:
    """One row: tested, passed, failed and skipped rules."""
    return report.agg(F.count("passed").alias("tested"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.col("passed").isNull()).alias("skipped"))
