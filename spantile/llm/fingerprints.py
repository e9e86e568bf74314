"""Document fingerprints from closed syncmers.  DataFrame operations only.

A text is a row of units: words of at most 32 characters, and single characters in scripts that write without blanks.
Of its runs of K units (k-mers), those are chosen whose smallest inner run of S units, by hash, is the first or the last
one: closed syncmers.  The choice looks at the k-mer alone, so a passage has the same anchors in any text and at any
place.  The fingerprint holds, in hexadecimal, all distinct 32-bit hashes of the text's syncmers that are below SHARE,
and at least the BOTTOM smallest: so it grows with the text, by an eighth of its anchors.  The likeness of two
fingerprints estimates the Jaccard likeness of the texts' syncmers, from the hashes up to the bound to which both
fingerprints are complete.

Anchors are for positional matching: ``anchor_rows`` gives them with their places, and ``shared_passages`` joins the
anchors of some texts with those of others, counts them by diagonal (place less place) and gives each passage that both
have, with its places in either.

Defined cases: a null text is empty; a text without units has the empty fingerprint, and two of these are alike (1.0);
a text of fewer than K units has one anchor for all of it; rows that repeat and ties of doc_id are ordered by their text,
a null doc_id after all others; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, partitions, small_table, whole

K, S = 5, 2
BOTTOM = 64
#: Hashes below this are always kept: an eighth of all.
SHARE = 1 << 29
#: Characters of scripts that write without blanks: CJK, Hangul, Thai, Lao, Myanmar, Khmer.
_SINGLE = r"⺀-꓏가-퟿豈-﫿฀-໿က-႟ក-៿"
UNITS = rf"[^{_SINGLE}\x00-\x20]{{1,32}}|[{_SINGLE}]"
#: Documents that are ordered together, about, while that makes fewer ranges than RANGES for each shuffle partition.
PART_DOCS, RANGES = 1_000, 4
#: Anchors in a row, at least, that make a shared passage; and places that neighbouring ones may lie apart.
PASSAGE_ANCHORS, PASSAGE_GAP = 3, 40


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))


def _syncmers(text: Column, made: Callable[[Column, Column], Column], kind: str) -> Column:
    """``made`` (of hash and place) of each closed syncmer of a text, in order of their places."""

    def chosen(unit: Column, small: Column) -> Column:
        inner = K - S
        runs = F.transform(F.sequence(F.lit(0), F.size(unit) - K), lambda i: F.when(F.least(small[i], small[i + inner]) <= F.least(*[small[i + j] for j in range(1, inner)]), made(F.xxhash64(*[unit[i + j] for j in range(K)]), i)))
        return F.filter(runs, lambda x: x.isNotNull())

    def of(unit: Column) -> Column:
        pairs = F.zip_with(unit, F.slice(unit, 2, F.size(unit)), lambda a, b: F.xxhash64(a, b))
        none = F.array().cast(f"array<{kind}>")
        return F.when(F.size(unit) >= K, let(pairs, lambda small: chosen(unit, small))).when(F.size(unit) > 0, F.array(made(F.xxhash64(unit), F.lit(0)))).otherwise(none)

    return let(F.transform(units(text), lambda w: F.xxhash64(w)), of)


def anchors(text: Column) -> Column:
    """All closed syncmers of a text, as hashes in order of their places."""
    return _syncmers(text, lambda h, i: h, "bigint")


def placed_anchors(text: Column) -> Column:
    """All closed syncmers of a text with their places: the number of the first unit."""
    return _syncmers(text, lambda h, i: F.struct(h.alias("hash"), i.cast("int").alias("place")), "struct<hash:bigint,place:int>")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string of 8 hexadecimal digits for each anchor that it keeps."""
    marks = F.transform(anchors(text), lambda h: F.shiftrightunsigned(h, 32))
    # some texts have no chosen k-mer at all: then all of it is the anchor
    marks = let(marks, lambda m: F.when((F.size(m) == 0) & (F.regexp_count(text, F.lit(UNITS)) > 0), F.array(F.shiftrightunsigned(F.xxhash64(text), 32))).otherwise(m))
    low = let(F.sort_array(F.array_distinct(marks)), lambda m: F.slice(m, 1, F.greatest(F.lit(BOTTOM), F.size(F.filter(m, lambda h: h < SHARE)))))
    return F.array_join(F.transform(low, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: the share of the anchors that either has, up to where both are complete, that both have."""

    def split(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.regexp_extract_all(x, F.lit("[0-9A-F]{8}"), F.lit(0))).otherwise(F.array().cast("array<string>"))

    share = f"{SHARE - 1:08X}"
    # fewer than BOTTOM are all that there are; else a fingerprint is complete to its last hash, and to SHARE in any case
    complete = lambda p: F.when(F.size(p) < BOTTOM, F.lit("G")).otherwise(F.greatest(F.element_at(p, -1), F.lit(share)))

    def of(p: Column, q: Column, bound: Column) -> Column:
        both = F.size(F.filter(F.array_intersect(p, q), lambda x: x <= bound))
        either = F.size(F.filter(F.array_union(p, q), lambda x: x <= bound))
        return F.when(either == 0, F.lit(0.0)).otherwise(both / either)

    return F.when(a == b, F.lit(1.0)).otherwise(let(split(a), lambda p: let(split(b), lambda q: let(F.least(complete(p), complete(q)), lambda bound: of(p, q, bound)))))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row for each anchor of ``docs`` (doc_id, text): doc_id, row (hash of the text), hash, place."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.explode(placed_anchors(whole(F.col("text")))).alias("anchor"))
    return rows.select("doc_id", "row", "anchor.hash", "anchor.place")


def shared_passages(docs: DataFrame, queries: DataFrame, most_places: int = 1_000_000) -> DataFrame:
    """Passages of ``queries`` that ``docs`` have: query_id, doc_id, query_place, place (first units), length (units), anchors.

    Both tables have doc_id and text.  ``queries`` is a set of bounded size, stated against all documents: more anchors
    than ``most_places`` are refused.  Equal anchors on one diagonal, at most PASSAGE_GAP places apart, are one passage;
    it counts with PASSAGE_ANCHORS anchors or more, or all that the query has.
    """
    asked = anchor_rows(queries).select(F.col("doc_id").alias("query_id"), F.col("row").alias("query_row"), "hash", F.col("place").alias("query_place"))
    if asked.count() > most_places:
        raise ValueError(f"queries have more than {most_places} anchors")
    has = Window.partitionBy("query_id", "query_row")
    asked = asked.withColumn("has", F.count(F.lit(1)).over(has))
    hits = anchor_rows(docs).join(asked, "hash").withColumn("diagonal", F.col("place") - F.col("query_place"))
    along = Window.partitionBy("query_id", "query_row", "doc_id", "row", "diagonal").orderBy("place")
    hits = hits.withColumn("new", F.coalesce(F.col("place") - F.lag("place").over(along) > PASSAGE_GAP, F.lit(True)).cast("int"))
    hits = hits.withColumn("run", F.sum("new").over(along))
    runs = hits.groupBy("query_id", "query_row", "doc_id", "row", "diagonal", "run").agg(F.min("query_place").alias("query_place"), F.min("place").alias("place"), (F.max("place") - F.min("place") + K).alias("length"), F.countDistinct("place").alias("anchors"), F.max("has").alias("has"))
    return runs.where(F.col("anchors") >= F.least(F.lit(PASSAGE_ANCHORS), F.col("has"))).select("query_id", "doc_id", "query_place", "place", "length", "anchors").distinct()


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``docs`` (doc_id, text) with ``columns``, and all of that of the next document by falling doc_id (after the last: the first).

    Ranges of (doc_id, hash of the text) are ordered by themselves; each also gets the documents at the top of the range
    below, whose next one it has.  There are RANGES ranges for each shuffle partition at most, whatever the number of
    documents; an id that holds several ranges' worth of rows is cut by the hash.
    """
    n = max(1, min(-(-docs.count() // PART_DOCS), RANGES * partitions(docs.sparkSession)))
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash"))
    ids = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(-(2**63))), [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    many = Counter(ids or [])
    bounds = sorted((i, -(2**63) + k * 2**64 // m) for i, m in many.items() for k in range(m))
    # the bounds in two layers, so that a row meets few of them
    step = max(2, int(n**0.5))
    coarse, fine = bounds[step - 1 :: step], [bounds[i : i + step - 1] for i in range(0, len(bounds) + 1, step)]
    kind = "struct<id:bigint,hash:bigint>"
    listed = lambda xs: F.from_json(F.lit(json.dumps([{"id": i, "hash": h} for i, h in xs])), f"array<{kind}>")
    below = lambda xs, own: F.size(F.filter(xs, lambda b: b <= own))
    first = below(listed(coarse), key)
    part = first * step + below(F.element_at(F.from_json(F.lit(json.dumps([[{"id": i, "hash": h} for i, h in f] for f in fine])), f"array<array<{kind}>>"), first + 1), key)
    docs = docs.select("doc_id", "text", key.alias("key"), part.cast("int").alias("part"))
    tops = sorted((r[0], *r[1]) for r in docs.groupBy("part").agg(F.max("key")).collect())
    above = {p: tops[(i + 1) % len(tops)][0] for i, (p, *_) in enumerate(tops)}
    # a row for each range: as many as RANGES for each shuffle partition
    visits = F.broadcast(small_table(docs.sparkSession, [(p, i, h, above[p]) for p, i, h in tops] or [(0, 0, 0, 0)], "part int, top_id long, top_hash long, host int"))
    is_top = (F.col("key.id") == F.col("top_id")) & (F.col("key.hash") == F.col("top_hash"))
    dealt = docs.join(visits, "part").select("doc_id", "text", "key", "part", F.posexplode(F.when(is_top, F.array("part", "host")).otherwise(F.array("part"))).alias("guest", "at"))
    # the guest comes last: it is the largest of the range below, or of all for the lowest range
    order = Window.partitionBy("at").orderBy(F.col("guest"), F.col("key").desc(), F.col("text").desc())
    dealt = dealt.withColumns(columns)
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *columns)})
    return following.where(F.col("guest") == 0).drop("guest", "at", "part", "key")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last floor(n / 2) code points give way to the first as many of another text, or all it has."""
    n = F.char_length(text)
    gone = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - gone), F.left(following, gone))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole(F.col("text")).alias("text"))
    out = with_next(docs, {"fingerprint": fingerprint(F.col("text"))}).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
