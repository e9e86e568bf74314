"""Text to token rows with built-in expressions: sentences, words, and a rule-based tagger that writes the nine-field record.

The tagger needs no dictionary: digits are numbers, other marks are symbols, a closed list are particles, and words with
a verb's ending are verbs; everything else is a noun.  Tags have the Japanese names, as patterns expect them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[A-Za-zÀ-ſ]+|[0-9]+|[^A-Za-zÀ-ſ0-9\\s]"
# Particles of four languages, and endings of verbs, of this tagger.
PARTICLES = ("a", "and", "at", "be", "by", "de", "der", "die", "el", "et", "in", "la", "le", "les", "of", "on", "que", "the", "to", "und", "y", "zu")
VERB_ENDINGS = ("ing", "ed", "er", "ar", "en")
FIELDS = ("pos0", "pos1", "pos2", "pos3", "ctype", "cform", "base", "reading", "pron")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sent (place of the sentence) and sentence; sentences end at a full stop or a line's end."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "[.\n]", -1)).alias("sent", "sentence"))


def words(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, idx and surface of each word of a text."""
    return texts.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("idx", "surface"))


def _tags(surface: Column) -> tuple[Column, Column, Column]:
    """pos0, pos1 and base of a word."""
    low = F.lower(surface)
    number, letter = surface.rlike("^[0-9]"), surface.rlike("^[A-Za-zÀ-ſ]")
    verb = low.rlike(f"({'|'.join(VERB_ENDINGS)})$")
    pos0 = F.when(number, "名詞").when(~letter, "記号").when(low.isin(*PARTICLES), "助詞").when(verb, "動詞").otherwise("名詞")
    pos1 = F.when(number, "数").when(~letter, "一般").when(low.isin(*PARTICLES), "格助詞").when(verb, "自立").otherwise("一般")
    return pos0, pos1, low


def tagged(tokens: DataFrame) -> DataFrame:
    """Adds pos0, pos1, base and feature (nine fields) to token rows with a surface."""
    feature = F.concat_ws(",", "pos0", "pos1", F.lit("*"), F.lit("*"), F.lit("*"), F.lit("*"), "base", F.lit("*"), F.lit("*"))
    return tokens.withColumns(dict(zip(("pos0", "pos1", "base"), _tags(F.col("surface")), strict=True))).withColumn("feature", feature)


def document_tokens(docs: DataFrame, dealt: bool = False) -> DataFrame:
    """doc_id, sent, idx, surface, pos0, pos1, base, feature of all words of all documents.

    dealt: the documents are dealt by doc_id before they become tokens.  Windows and groups by doc_id (and more) then need
    no shuffle of tokens, which take ten times the texts' room.
    """
    texts = docs.select("doc_id", "text").repartition("doc_id") if dealt else docs
    return tagged(words(sentences(texts), ["doc_id", "sent"], "sentence"))


def parsed(tokens: DataFrame, feature: str = "feature") -> DataFrame:
    """The fields of the feature record as columns; fields that a short record lacks are null."""
    parts = F.split(feature, ",")
    return tokens.withColumns({name: F.get(parts, i) for i, name in enumerate(FIELDS)})


def printed(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``printed``: a line ``surface<tab>feature`` for each token, and EOS."""
    found = F.sort_array(F.collect_list(F.struct("idx", "surface", "feature")))
    lines = F.transform(found, lambda t: F.concat(t["surface"], F.lit("\t"), t["feature"], F.lit("\n")))
    return tokens.groupBy(*keys).agg(F.concat(F.array_join(lines, ""), F.lit("EOS\n")).alias("printed"))


def from_printed(lines: Column) -> Column:
    """The tokens of printed text, as an array of surface and feature."""
    rows = F.filter(F.split(lines, "\n"), lambda x: (x != "") & (x != "EOS"))
    return F.transform(rows, lambda x: F.struct(F.substring_index(x, "\t", 1).alias("surface"), F.substring_index(x, "\t", -1).alias("feature")))


def labelled(feature: Column, labels: tuple[str, ...] = FIELDS) -> Column:
    """``label=value`` for each field of a record that says something."""
    parts = F.split(feature, ",")
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.get(parts, i).alias("value")) for i, n in enumerate(labels)])
    return F.array_join(F.transform(F.filter(rows, lambda r: r["value"].isNotNull() & ~r["value"].isin("*", "")), lambda r: F.concat(r["label"], F.lit("="), r["value"])), ";")


def pretty(idx: Column, surface: Column, feature: Column) -> Column:
    """``[place] surface tags form base`` of a token: the tags that say something, the form, and the base where it differs."""
    parts = F.split(feature, ",")
    tags = F.array_join(F.filter(F.slice(parts, 1, 4), lambda x: x != "*"), ",")
    told = lambda i: F.coalesce(F.get(parts, i), F.lit("*"))
    form = F.when(told(5) != "*", F.concat(F.lit(" 活用形="), told(5))).otherwise("")
    base = F.when((told(6) != "*") & (told(6) != surface), F.concat(F.lit(" base="), told(6))).otherwise("")
    padded = F.concat(surface, F.repeat(F.lit(" "), F.greatest(8 - F.char_length(surface), F.lit(0))))
    return F.concat(F.lit("["), idx.cast("string"), F.lit("] "), padded, F.lit(" "), tags, form, base)
