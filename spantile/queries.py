"""Queries over the driver's tables for the reference's own operators, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import catalogue, consumers, lattice, phrases, tokens
from .operators.api import PatternSet
from .operators.match import match_texts, nested
from .operators.native import Plan, find_native
from .operators.resolve import priority, resolve, spanned, within_span
from .plans.pattern import parse
from .sources import compiled, dictionary, rules

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
KEYS = ["doc_id", "sent"]


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- token streams


def doc_tokens(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """dealt: for what looks at neighbours; the documents are dealt by doc_id, and their tokens are not shuffled."""
    return tokens.document_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), dealt)


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order, as tokens."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    feature = F.concat(F.lit("名詞,一般,*,*,*,*,"), F.col("event_type"), F.lit(",*,*"))
    return tokens.parsed(events.select("user_id", place.alias("idx"), F.col("event_type").alias("surface"), feature.alias("feature")))


_TOKENS = r"""WITH RECURSIVE sentences AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS sent, unnest(x) AS sentence
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.\n]') AS x FROM documents)),
words AS (
  SELECT doc_id, sent, generate_subscripts(w, 1) - 1 AS idx, unnest(w) AS surface
  FROM (SELECT doc_id, sent, regexp_extract_all(sentence, '[A-Za-z\x{C0}-\x{17F}]+|[0-9]+|[^A-Za-z\x{C0}-\x{17F}0-9\s]') AS w FROM sentences)),
tagged AS (
  SELECT *, lower(surface) AS base, regexp_matches(surface, '^[0-9]') AS num, regexp_matches(surface, '^[A-Za-z\x{C0}-\x{17F}]') AS letter,
    lower(surface) IN ('a','and','at','be','by','de','der','die','el','et','in','la','le','les','of','on','que','the','to','und','y','zu') AS particle,
    regexp_matches(lower(surface), '(ing|ed|er|ar|en)$') AS verb FROM words),
tokens AS (
  SELECT doc_id, sent, idx, surface, base,
    CASE WHEN num THEN '名詞' WHEN NOT letter THEN '記号' WHEN particle THEN '助詞' WHEN verb THEN '動詞' ELSE '名詞' END AS pos0,
    CASE WHEN num THEN '数' WHEN NOT letter THEN '一般' WHEN particle THEN '格助詞' WHEN verb THEN '自立' ELSE '一般' END AS pos1 FROM tagged)
"""
_EVENTS = """WITH RECURSIVE tokens AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS surface FROM events)
"""
_LEADS = """, led AS (
  SELECT user_id, idx AS s, surface AS a, lead(surface, 1) OVER w AS b, lead(surface, 2) OVER w AS c,
         count(*) OVER (PARTITION BY user_id) AS n FROM tokens WINDOW w AS (PARTITION BY user_id ORDER BY idx))
"""


def _leftmost_sql(candidates: str, keys: str) -> str:
    """SQL of the leftmost matches without overlap among ``candidates`` (keys, s, e)."""
    same = " AND ".join(f"c.{k} = w.{k}" for k in keys.split(", "))
    own = ", ".join(f"w.{k}" for k in keys.split(", "))
    return f""", candidates AS ({candidates}), walk AS (
  SELECT {keys}, min(s) AS s, arg_min(e, s) AS e FROM candidates GROUP BY {keys}
  UNION ALL
  SELECT {own}, min(c.s) AS s, arg_min(c.e, c.s) AS e FROM walk w JOIN candidates c ON {same} AND c.s >= w.e GROUP BY {own}, w.s)
"""


# ---------------------------------------------------------------- tokens


@_query(_TOKENS + "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT base) AS n_bases, sum(octet_length(encode(surface)))::BIGINT AS n_bytes, max(sent)::BIGINT AS last_sent FROM tokens GROUP BY doc_id")
def tokenize_documents(spark, sf_dir):
    return doc_tokens(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("base").alias("n_bases"), F.sum(F.octet_length("surface")).alias("n_bytes"), F.max("sent").cast("long").alias("last_sent"))


@_query(_TOKENS + "SELECT doc_id, sent::INT AS sent, sha256(string_agg(surface || chr(9) || pos0 || ',' || pos1 || ',*,*,*,*,' || base || ',*,*' || chr(10), '' ORDER BY idx) || 'EOS' || chr(10)) AS printed FROM tokens GROUP BY doc_id, sent")
def token_print(spark, sf_dir):
    return tokens.printed(doc_tokens(spark, sf_dir, True), KEYS).withColumn("printed", F.sha2("printed", 256))


@_query(_TOKENS + "SELECT pos0, pos1, '*' AS ctype, count(*) AS n, count(DISTINCT base) AS bases FROM tokens GROUP BY pos0, pos1")
def feature_parse(spark, sf_dir):
    found = tokens.parsed(doc_tokens(spark, sf_dir).select("feature"))
    return found.groupBy("pos0", "pos1", "ctype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("base").alias("bases"))


@_query(_TOKENS + "SELECT 'pos0=' || pos0 || ';pos1=' || pos1 || CASE WHEN base IN ('*', ',') THEN '' ELSE ';base=' || base END AS labels, count(*) AS n FROM tokens GROUP BY 1")
def feature_labels(spark, sf_dir):
    return doc_tokens(spark, sf_dir).groupBy("feature").count().groupBy(tokens.labelled(F.col("feature")).alias("labels")).agg(F.sum("count").alias("n"))


@_query(_TOKENS + "SELECT '[' || (idx % 3) || '] ' || rpad(surface, greatest(8, length(surface))::INT, ' ') || ' ' || pos0 || ',' || pos1 || CASE WHEN surface = ',' THEN ' base=' WHEN base <> surface AND base <> '*' THEN ' base=' || base ELSE '' END AS shown, count(*) AS n FROM tokens GROUP BY 1")
def token_pretty(spark, sf_dir):
    found = doc_tokens(spark, sf_dir).groupBy((F.col("idx") % 3).alias("idx"), "surface", "feature").count()
    return found.groupBy(tokens.pretty(F.col("idx"), F.col("surface"), F.col("feature")).alias("shown")).agg(F.sum("count").alias("n"))


# ---------------------------------------------------------------- predicates


def _tests(name: str, pattern: str, where: str) -> None:
    """A query that counts the tokens for which a one-token pattern holds."""

    def run(spark, sf_dir):
        found = Plan(tokens.parsed(doc_tokens(spark, sf_dir)), KEYS, parse(f"r = {pattern} ;"))
        return found.relation(found.grammar.rules[0].pattern).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s").cast("long").alias("places"))

    run.__name__ = name
    _query(_TOKENS + f"SELECT doc_id, count(*) AS n, sum(idx)::BIGINT AS places FROM tokens WHERE {where} GROUP BY doc_id")(run)


_tests("pred_exact", '"The"', "surface = 'The'")
_tests("pred_suffix", '~"tion"', "surface LIKE '%tion'")
_tests("pred_regex", "/th[ae]/", "regexp_matches(surface, 'th[ae]')")
_tests("pred_pos_path", "名詞.数", "pos0 = '名詞' AND pos1 = '数'")
_tests("pred_base", '動詞@~"ing"', "pos0 = '動詞' AND base LIKE '%ing'")
_tests("pred_form", '動詞[/[*]/]{"*"}', "pos0 = '動詞'")


# ---------------------------------------------------------------- patterns on events


def _raw(spark, sf_dir, grammar: str, rule: str = "r") -> DataFrame:
    return find_native(event_tokens(spark, sf_dir), ["user_id"], parse(grammar), rule)


@_query(_EVENTS + _LEADS + _leftmost_sql("SELECT user_id, s, s + 2 AS e FROM led WHERE a = 'view' AND b = 'click'", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e FROM walk")
def seq_events(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = "view" "click" ;')


@_query(_EVENTS + _LEADS + "SELECT user_id, s::INT AS s, max(e)::INT AS e FROM (SELECT user_id, s, s + 1 AS e FROM led WHERE a = 'view' UNION ALL SELECT user_id, s, s + 2 FROM led WHERE a = 'view' AND b = 'click') GROUP BY user_id, s")
def alt_longest(spark, sf_dir):
    grammar = parse('r = "view" | "view" "click" ;')
    return Plan(event_tokens(spark, sf_dir), ["user_id"], grammar).longest(grammar.rules[0].pattern).select("user_id", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


@_query(_EVENTS + _LEADS + _leftmost_sql("SELECT user_id, s, CASE WHEN b = 'error' AND c = 'click' THEN s + 3 ELSE s + 2 END AS e FROM led WHERE a = 'view' AND (b = 'click' OR b = 'error' AND c = 'click')", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e FROM walk")
def optional(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = "view" "error"? "click" ;')


_RUNS = """, runs AS (
  SELECT user_id, min(idx) AS s, max(idx) + 1 AS e FROM (
    SELECT user_id, idx, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM tokens WHERE surface IN ('view', 'click')) GROUP BY user_id, g)
"""


@_query(_EVENTS + _RUNS + "SELECT user_id, s::INT AS s, e::INT AS e FROM runs")
def plus_islands(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = /^(view|click)$/+ ;')


@_query(_EVENTS + _RUNS + _leftmost_sql("SELECT t.user_id, t.idx AS s, coalesce(max(r.e), t.idx + 1) AS e FROM tokens t LEFT JOIN runs r ON r.user_id = t.user_id AND r.s <= t.idx + 1 AND r.e > t.idx + 1 WHERE t.surface = 'signup' GROUP BY t.user_id, t.idx", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e FROM walk")
def star_islands(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = "signup" /^(view|click)$/* ;')


@_query(_EVENTS + "SELECT a.user_id, min(a.idx)::INT AS s, (max(b.idx) + 1)::INT AS e FROM tokens a JOIN tokens b ON a.user_id = b.user_id AND b.idx > a.idx WHERE a.surface = 'signup' AND b.surface = 'purchase' GROUP BY a.user_id")
def wildcard_gap(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = "signup" _* "purchase" ;')


@_query(_EVENTS + _LEADS + _leftmost_sql("SELECT user_id, s, s + 3 AS e FROM led WHERE a = c AND b = 'error'", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e FROM walk")
def capture_backref(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = _$1 "error" _@=$1 ;')


@_query(_EVENTS + _LEADS + _leftmost_sql("SELECT user_id, s, s + 2 AS e FROM led WHERE a IN ('view', 'click') AND b = 'purchase'", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e FROM walk")
def rule_ref(spark, sf_dir):
    return _raw(spark, sf_dir, 'look = "view" | "click" ; r = (look) "purchase" ;')


@_query(_EVENTS + _LEADS + _leftmost_sql("SELECT user_id, s, s + 3 AS e FROM led WHERE a IN ('view', 'click') AND c IN ('error', 'view')", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e FROM walk")
def find_nonoverlap(spark, sf_dir):
    return _raw(spark, sf_dir, 'r = ("view" | "click") _ ("error" | "view") ;')


@_query(_EVENTS + _LEADS + "SELECT user_id, bool_or(coalesce(a = 'signup' AND b = 'signup' AND c = 'purchase', false)) AS hit FROM led GROUP BY user_id")
def test_rule(spark, sf_dir):
    rule = PatternSet.from_text('r = "signup" "signup" "purchase" ;')
    return rule.test(event_tokens(spark, sf_dir), ["user_id"], "r")


@_query(_EVENTS + _LEADS + _leftmost_sql("SELECT user_id, s, s + 3 AS e FROM led WHERE a = 'view' AND c = 'error'", "user_id") + "SELECT user_id, s::INT AS s, e::INT AS e, s || ',' || (s + 2) AS fixed FROM walk")
def fixed_indices(spark, sf_dir):
    found = match_texts(nested(event_tokens(spark, sf_dir), ["user_id"]), parse('r = "view" _ "error" ;'), ["user_id"])
    return found.select("user_id", "s", "e", F.concat_ws(",", F.col("fixed").cast("array<string>")).alias("fixed"))


@_query(_EVENTS + ", runs AS (SELECT user_id, min(idx) AS s, max(idx) + 1 AS e FROM (SELECT user_id, idx, idx - row_number() OVER (PARTITION BY user_id ORDER BY idx) AS g FROM tokens WHERE surface = 'view') GROUP BY user_id, g) SELECT user_id, s::INT AS s, e::INT AS e FROM runs")
def recursive_rule(spark, sf_dir):
    found = match_texts(nested(event_tokens(spark, sf_dir), ["user_id"]), parse('r = "view" r? ;'), ["user_id"])
    return found.select("user_id", "s", "e")


# ---------------------------------------------------------------- patterns on documents

_NOUN_RUNS = """, runs AS (
  SELECT doc_id, sent, min(idx) AS s, max(idx) + 1 AS e FROM (
    SELECT doc_id, sent, idx, idx - row_number() OVER (PARTITION BY doc_id, sent ORDER BY idx) AS g FROM tokens WHERE pos0 = '名詞') GROUP BY doc_id, sent, g HAVING count(*) >= 2)
"""


@_query(_TOKENS + _NOUN_RUNS + "SELECT lang, count(*) AS matches, max(e - s)::INT AS longest, sum(e - s)::BIGINT AS tokens FROM runs JOIN documents USING (doc_id) GROUP BY lang")
def compound_nouns(spark, sf_dir):
    """The flagship: runs of two nouns or more in each sentence, by language."""
    found = find_native(tokens.parsed(doc_tokens(spark, sf_dir, True)), KEYS, parse("compound = 名詞 名詞+ ;"), "compound")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    size = F.col("e") - F.col("s")
    return found.join(docs, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("matches"), F.max(size).alias("longest"), F.sum(size).alias("tokens"))


@_query(_TOKENS + ", led AS (SELECT doc_id, pos0 AS a, lead(pos0) OVER w AS b, lead(base, 1) OVER w AS bb FROM tokens WINDOW w AS (PARTITION BY doc_id, sent ORDER BY idx)) SELECT doc_id, count(*) AS n FROM led WHERE a = '動詞' AND b = '助詞' AND bb LIKE '%e' GROUP BY doc_id")
def seq_tokens(spark, sf_dir):
    found = find_native(tokens.parsed(doc_tokens(spark, sf_dir, True)), KEYS, parse('r = 動詞 助詞@~"e" ;'), "r")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_CHUNKS = """, marked AS (
  SELECT *, lag(pos0) OVER (PARTITION BY doc_id, sent ORDER BY idx) AS before FROM tokens),
opened AS (
  SELECT *, pos0 <> '記号' AND (pos0 IN ('名詞', '動詞') OR before IS NULL OR before = '記号') AS opens FROM marked),
placed AS (
  SELECT *, CASE WHEN pos0 <> '記号' THEN sum(opens::INT) OVER (PARTITION BY doc_id, sent ORDER BY idx) - 1 END AS chunk FROM opened)
"""


@_query(_TOKENS + _CHUNKS + "SELECT doc_id, count(*) AS chunks, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM (SELECT doc_id, sent, chunk, min(idx) AS s, max(idx) + 1 AS e FROM placed WHERE chunk IS NOT NULL GROUP BY doc_id, sent, chunk) GROUP BY doc_id")
def chunks(spark, sf_dir):
    return phrases.chunks(doc_tokens(spark, sf_dir, True), KEYS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("s").cast("long").alias("starts"), F.sum("e").cast("long").alias("ends"))


@_query(_TOKENS + _CHUNKS + "SELECT surface, count(*) AS n FROM (SELECT string_agg(surface, '' ORDER BY idx) AS surface FROM placed WHERE chunk IS NOT NULL GROUP BY doc_id, sent, chunk) GROUP BY surface HAVING count(*) >= 3")
def chunk_surface(spark, sf_dir):
    return phrases.chunks(doc_tokens(spark, sf_dir, True), KEYS).groupBy("surface").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@_query(_TOKENS + _CHUNKS + "SELECT doc_id, sum(coalesce(chunk, -1))::BIGINT AS chunk_sum, count(*) FILTER (WHERE chunk IS NULL) AS marks, count(*) FILTER (WHERE coalesce(chunk = follows, false)) AS same FROM (SELECT *, lead(chunk) OVER (PARTITION BY doc_id, sent ORDER BY idx) AS follows FROM placed) GROUP BY doc_id")
def chunk_of(spark, sf_dir):
    placed = phrases.chunk_of(doc_tokens(spark, sf_dir, True), KEYS)
    same = phrases.same_chunk(F.col("chunk"), F.lead("chunk").over(Window.partitionBy(*KEYS).orderBy("idx")))
    return placed.withColumn("same", same).groupBy("doc_id").agg(F.sum(F.coalesce("chunk", F.lit(-1))).cast("long").alias("chunk_sum"), F.count_if(F.col("chunk").isNull()).alias("marks"), F.count_if("same").alias("same"))


# ---------------------------------------------------------------- resolution

EVENT_RULES = """
pair [N2, "a look and a click"] = "view" "click" ;
triple [N3] = "view" _ "error" ;
noise [N4] = "signup" _ ;
tail [N5] = "error" "error" "error"? ;
free = "purchase" "view" ;
"""
_RAW = (
    _LEADS
    + _leftmost_sql(
        """SELECT user_id, 0 AS ord, 2 AS p, s, s + 2 AS e FROM led WHERE a = 'view' AND b = 'click'
  UNION ALL SELECT user_id, 1, 3, s, s + 3 FROM led WHERE a = 'view' AND c = 'error'
  UNION ALL SELECT user_id, 2, 4, s, s + 2 FROM led WHERE a = 'signup' AND b IS NOT NULL
  UNION ALL SELECT user_id, 3, 5, s, CASE WHEN c = 'error' THEN s + 3 ELSE s + 2 END FROM led WHERE a = 'error' AND b = 'error'
  UNION ALL SELECT user_id, 4, 9, s, s + 2 FROM led WHERE a = 'purchase' AND b = 'view'""",
        "user_id, ord, p",
    )
)


def _level_sql(level: int, accepted: list[int]) -> str:
    over = " ".join(f"AND NOT EXISTS (SELECT 1 FROM k{n} x WHERE x.user_id = m.user_id AND x.s < m.e AND x.e > m.s)" for n in accepted)
    return f""", d{level} AS (SELECT * FROM walk m WHERE p = {level} {over}),
k{level} AS (SELECT * FROM d{level} m WHERE NOT EXISTS (SELECT 1 FROM d{level} x WHERE x.user_id = m.user_id AND x.s <= m.s AND x.e >= m.e AND x.e - x.s > m.e - m.s))
"""


_KEPT = _RAW + _level_sql(2, []) + _level_sql(3, [2]) + _level_sql(4, [2, 3]) + _level_sql(5, [2, 3, 4]) + _level_sql(9, [])
_KEPT += """, kept AS (SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k5 UNION ALL SELECT * FROM k9),
loud AS (SELECT DISTINCT user_id FROM kept WHERE p <= 2),
quiet AS (SELECT * FROM kept WHERE p NOT IN (4, 5) OR user_id NOT IN (SELECT user_id FROM loud)),
spans AS (SELECT * FROM quiet WHERE p NOT IN (4, 5) OR e - s <= 2)
"""


def _event_matches(spark, sf_dir) -> DataFrame:
    rules_ = PatternSet.from_text(EVENT_RULES)
    levels = F.broadcast(rules_.rules(spark).select("ord", priority(F.col("levels")).alias("p"), "max_span"))
    return rules_.raw(event_tokens(spark, sf_dir), ["user_id"]).join(levels, "ord")


@_query(_EVENTS + _RAW + "SELECT user_id, ord, CASE WHEN p < 9 THEN p END AS p, s::INT AS s, e::INT AS e FROM walk")
def rule_union(spark, sf_dir):
    return _event_matches(spark, sf_dir).select("user_id", "ord", "p", "s", "e")


@_query(_EVENTS + _KEPT + "SELECT user_id, ord, CASE WHEN p < 9 THEN p END AS p, s::INT AS s, e::INT AS e FROM quiet")
def resolve_matches(spark, sf_dir):
    return resolve(_event_matches(spark, sf_dir), ["user_id"]).select("user_id", "ord", "p", "s", "e")


@_query(_EVENTS + _KEPT + "SELECT user_id, ord, s::INT AS s, e::INT AS e, (e - s)::INT AS span FROM spans")
def resolve_span(spark, sf_dir):
    kept = resolve(_event_matches(spark, sf_dir), ["user_id"], ["max_span"])
    placed = spanned(kept, phrases.chunk_of(event_tokens(spark, sf_dir), ["user_id"]), ["user_id"])
    return within_span(placed, F.col("max_span")).select("user_id", "ord", "s", "e", "span")


@_query(_EVENTS + _KEPT + "SELECT user_id, ord AS ord, s::INT AS s, e::INT AS e, (e - s)::INT AS span, s::INT AS chunk_s, (e - 1)::INT AS chunk_e, (SELECT string_agg(surface, ' ' ORDER BY idx) FROM tokens t WHERE t.user_id = m.user_id AND t.idx >= m.s AND t.idx < m.e) AS nodes FROM spans m")
def find_all(spark, sf_dir):
    found = PatternSet.from_text(EVENT_RULES).find_all(event_tokens(spark, sf_dir), ["user_id"])
    return found.select("user_id", "ord", "s", "e", "span", "chunk_s", "chunk_e", F.array_join(F.transform("nodes", lambda t: t["surface"]), " ").alias("nodes"))


@_query(_EVENTS + _RAW + "SELECT user_id, ord, s::INT AS s, e::INT AS e FROM walk m WHERE NOT EXISTS (SELECT 1 FROM walk x WHERE x.user_id = m.user_id AND x.s <= m.s AND x.e >= m.e AND x.e - x.s > m.e - m.s)")
def display_filter(spark, sf_dir):
    return consumers.outermost(_event_matches(spark, sf_dir), ["user_id"]).select("user_id", "ord", "s", "e")


@_query(_EVENTS + _RAW + ", names AS (SELECT * FROM (VALUES (0, 'pair'), (1, 'triple'), (2, 'noise'), (3, 'tail'), (4, 'free')) v(ord, rule)) SELECT user_id, idx::INT AS idx, string_agg(rule, ',' ORDER BY ord) AS rules, bool_or(NOT (ord IN (1, 2) AND idx = s + 1)) AS fixed FROM (SELECT user_id, ord, s, e, unnest(generate_series(s, e - 1)) AS idx FROM walk) JOIN names USING (ord) GROUP BY user_id, idx")
def node_match_map(spark, sf_dir):
    return consumers.by_token(_event_matches(spark, sf_dir), ["user_id"]).select("user_id", "idx", F.array_join("rules", ",").alias("rules"), "fixed")


# ---------------------------------------------------------------- catalogue

@_query("SELECT i::BIGINT AS i, name FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(i, name)")
def merge_rules(spark, sf_dir):
    merged = PatternSet.from_text('a = "x" ; b = "y" ;').merge('b = "z" ; c = "w" ;')
    return spark.createDataFrame(list(enumerate(merged.rule_names())), "i long, name string")


_SENTENCES = "SELECT conv_id AS grammar_id, list(text ORDER BY turn) AS sentences FROM conversations GROUP BY conv_id"


@_query(f"SELECT grammar_id, (i - 1)::INT AS sort_order, sentence, 'ja' AS lang FROM (SELECT grammar_id, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) AS i FROM ({_SENTENCES})) x WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = x.grammar_id AND c.turn % 2 = 1 AND c.text = x.sentence)")
def exclude_examples(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    new = rows.groupBy(F.col("conv_id").alias("grammar_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("sentences"))
    gone = rows.where("turn % 2 = 1").select(F.col("conv_id").alias("grammar_id"), F.col("text").alias("sentence")).distinct()
    none = spark.range(0).select(F.col("id").alias("grammar_id"), F.lit("").alias("sentence"), F.lit("").alias("lang"), F.lit(0).alias("sort_order"))
    return catalogue.replaced_examples(none, new, gone, none.select("grammar_id"))


@_query("SELECT conv_id AS grammar_id, string_agg(g, '|' ORDER BY o) AS examples FROM (SELECT conv_id, turn // 2 AS o, string_agg(role || ':' || length(text), ';' ORDER BY turn) AS g FROM conversations GROUP BY conv_id, turn // 2) GROUP BY conv_id")
def examples_encode(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rules.encoded_examples(rows.select(F.col("conv_id").alias("grammar_id"), F.floor(F.col("turn") / 2).alias("sort_order"), F.col("turn").alias("id"), F.col("role").alias("lang"), F.char_length("text").cast("string").alias("sentence")))


@_query("""SELECT * FROM (VALUES ('ja:a;zh:b|ja:c', 'a<zh=b>/c<>'), ('ja:a:b;en:c:d', 'a:b<en=c:d>'), ('plain;ja:x', 'plain<ja=x>'), ('zh:only', '<zh=only>'), ('ja:;zh:x;ja:y', 'y<zh=x>'), ('', '')) v(raw, decoded)""")
def examples_decode(spark, sf_dir):
    raw = spark.createDataFrame([("ja:a;zh:b|ja:c",), ("ja:a:b;en:c:d",), ("plain;ja:x",), ("zh:only",), ("ja:;zh:x;ja:y",), ("",)], "raw string")
    shown = lambda e: F.concat(e["sentence"], F.lit("<"), F.array_join(F.transform(e["translations"], lambda t: F.concat(t["lang"], F.lit("="), t["text"])), ","), F.lit(">"))
    return raw.select("raw", F.array_join(F.transform(rules.decoded_examples(F.col("raw")), shown), "/").alias("decoded"))


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _plain_sql(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{c}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_TITLE = _plain_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_TITLE2 = _plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")


@_query(f"SELECT page_id, trim(regexp_replace(regexp_replace(CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE {_TITLE2} END, '(?s)\\s*[|｜].*$', ''), '(?s)の意味.*$', '')) AS title FROM pages")
def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", catalogue.title_of(F.col("html")).alias("title"))


@_query(f"""WITH a AS (SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS a FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS x FROM pages)),
l AS (SELECT page_id * 10000 + i - 1 AS place, regexp_extract(a, '(?is)href="([^"]*)"', 1) AS href, {_plain_sql("regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1)")} AS text FROM a)
SELECT CASE WHEN href LIKE 'http%' THEN href ELSE 'https://example.com' || href END AS url, min(place) AS place, arg_max(text, place) AS text FROM l WHERE text <> '' GROUP BY 1""")
def page_links_dedup(spark, sf_dir):
    found = catalogue.links(_pages(spark, sf_dir), "page_id", "html", None).withColumn("place", F.col("page_id") * 10000 + F.col("place"))
    found = found.withColumn("url", catalogue.absolute(F.col("href"), "https://example.com"))
    return catalogue.first_place_last_value(found, "url", "place", ["text"])


# ---------------------------------------------------------------- dictionary and lattice

_TEXTS = ["すもももももももものうち", "東京都に住んでいます", "携帯電話番号を入力する", "いくら騒いでも大丈夫だ", "私は学生です", ""]


def _texts(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_TEXTS)), "text_id long, text string")


@_query("SELECT * FROM (VALUES (0::BIGINT, 'すもも もも もも もも の うち'), (1, '東京 都 に 住ん で い ます'), (2, '携帯 電話 番号 を 入力 する'), (3, 'いくら 騒い で も 大丈夫 だ'), (4, '私 は 学生 です')) v(text_id, words)")
def lattice_best(spark, sf_dir):
    found = lattice.tokenized(_texts(spark), ["text_id"], "text", lattice.MINI)
    return found.groupBy("text_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "surface"))), lambda x: x["surface"]), " ").alias("words"))


_LEXICON = ", ".join(f"('{e.surface}', {e.cost})" for e in lattice.MINI.entries)
_SAID = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in enumerate(_TEXTS))


@_query(f"""WITH RECURSIVE lexicon(surface, cost) AS (VALUES {_LEXICON}), texts(text_id, said) AS (VALUES {_SAID}),
places AS (SELECT text_id, said, unnest(range(0, length(said))) AS place FROM texts),
known AS (SELECT text_id, place, length(surface) AS size, cost FROM places JOIN lexicon ON starts_with(substr(said, place + 1), surface)),
words AS (
  SELECT * FROM known
  UNION ALL
  SELECT text_id, place, 1, CASE WHEN regexp_matches(substr(said, place + 1, 1), '[ぁ-ゟ]') THEN 12000 ELSE 10000 END FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.text_id = p.text_id AND k.place = p.place)),
walk AS (
  SELECT text_id, said, 0::BIGINT AS place, 0::BIGINT AS cost FROM texts WHERE said <> ''
  UNION ALL
  SELECT w.text_id, w.said, w.place + x.size, w.cost + x.cost FROM walk w JOIN words x ON w.text_id = x.text_id AND w.place = x.place)
SELECT text_id, rank::INT AS rank, cost FROM (SELECT text_id, cost, row_number() OVER (PARTITION BY text_id ORDER BY cost) AS rank FROM walk WHERE place = length(said)) WHERE rank <= 9""")
def nbest(spark, sf_dir):
    """What the nine cheapest paths of each text cost."""
    found = lattice.tokenized(_texts(spark), ["text_id"], "text", lattice.MINI, 9)
    return found.groupBy("text_id", "rank").agg(F.max("cost").alias("cost"))


def _packed_dictionary() -> bytes:
    """The small lexicon, compiled with characters and unknown words of its own, and packed."""
    ranges = "0x0009..0x000D SPACE,0x0020 SPACE,0x3000 SPACE,0x0030..0x0039 NUMERIC,0x0041..0x005A ALPHA,0x0061..0x007A ALPHA,0x00C0..0x024F ALPHA"
    categories, table = compiled.characters_of(["DEFAULT 0 0 1", "SPACE 0 0 1", "NUMERIC 1 1 0", "ALPHA 1 1 0", *ranges.split(",")])
    words = [compiled.Word(e.surface, e.left, e.right, e.cost, e.feature) for e in lattice.MINI.entries]
    costs = {"DEFAULT": (8_000, "記号,一般,*,*,*,*,*"), "SPACE": (0, "記号,空白,*,*,*,*,*"), "NUMERIC": (4_000, "名詞,数,*,*,*,*,*"), "ALPHA": (6_000, "名詞,固有名詞,組織,*,*,*,*")}
    unknown = [compiled.Word(name, 0, 0, cost, feature) for name, (cost, feature) in costs.items()]
    files = compiled.compiled_files(words, unknown, compiled.matrix_of(["2 2"]), categories, table)
    return dictionary.pack([(name, files[name]) for name in dictionary.FILES])


@_query("SELECT 'sys.dic' AS filename, 'utf-8' AS charset, 39::BIGINT AS size, 0 AS type, 2::BIGINT AS lsize, 2::BIGINT AS rsize, 102 AS version")
def dictionary_info(spark, sf_dir):
    return dictionary.dictionary_infos(spark, compiled.open_packed(_packed_dictionary()))


@_query("SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 0::BIGINT)) v(name, size)")
def mcbd_roundtrip(spark, sf_dir):
    found = dictionary.unpack(dictionary.pack([("a", b"x"), ("b", b"")]))
    return spark.createDataFrame([(n, len(d)) for n, d in found], "name string, size long")


@_query(_TOKENS + "SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id")
def printed_tokens(spark, sf_dir):
    """Printed tokens read again."""
    lines = tokens.printed(doc_tokens(spark, sf_dir, True), KEYS)
    return lines.select("doc_id", F.size(tokens.from_printed(F.col("printed"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))


from . import catalogue_queries as _more  # noqa: E402, F401  registers its queries here
