"""Rules as CSV, gzip CSV and text; the micro-format of their examples, both ways."""

from __future__ import annotations

import csv
import gzip
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.pattern import EMPTY, Grammar, PatternError, Rule, parse

CSV_COLUMNS = ("rule_name", "levels", "name", "description", "connection", "pattern", "examples")
EXAMPLES = "array<struct<sentence: string, translations: array<struct<lang: string, text: string>>>>"


def _schema(columns: str) -> T.StructType:
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, columns.split(", "))])


GRAMMARS = _schema("id bigint, rule_name string, levels string, name string, description string, connection string, pattern string, source string, source_url string, created_at timestamp, updated_at timestamp")
EXAMPLE_ROWS = _schema("id bigint, grammar_id bigint, sentence string, lang string, sort_order int")
EXCLUDED = _schema("id bigint, grammar_id bigint, sentence string, reason string")


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: those it lacks are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


# ---------------------------------------------------------------- examples


def examples_of(text: str) -> tuple:
    """``ja:a;zh:b|ja:c`` as ((sentence, ((language, text), ...)), ...).

    The first text marked ``ja``, or not marked at all, is the sentence; while that is empty, the next one may be.  What else
    is not marked goes; a group without any is an empty sentence with its translations.
    """
    out = []
    for group in text.split("|") if text else ():
        sentence, translations = "", []
        for part in group.split(";"):
            lang, colon, said = part.partition(":")
            if sentence or (colon and lang != "ja"):
                translations += [(lang, said)] if colon else []
            else:
                sentence = said if colon else part
        out.append((sentence, tuple(translations)))
    return tuple(out)


def decoded_examples(text: Column) -> Column:
    """As ``examples_of``, as an expression."""

    def group(g: Column) -> Column:
        start = F.struct(F.lit("").alias("sentence"), F.array().cast("array<struct<lang: string, text: string>>").alias("translations"))

        def step(held: Column, part: Column) -> Column:
            marked = F.instr(part, ":") > 0
            lang, said = F.substring_index(part, ":", 1), F.substr(part, F.instr(part, ":") + 1)
            fills = (held["sentence"] == "") & (~marked | (lang == "ja"))
            sentence = F.when(~fills, held["sentence"]).when(marked, said).otherwise(part)
            more = F.array(F.struct(lang.alias("lang"), said.alias("text")))
            return F.struct(sentence.alias("sentence"), F.when(marked & ~fills, F.concat(held["translations"], more)).otherwise(held["translations"]).alias("translations"))

        return F.aggregate(F.split(g, ";"), start, step)

    none = F.array().cast(EXAMPLES)
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(F.transform(F.split(text, r"\|"), group))


def encoded_examples(rows: DataFrame) -> DataFrame:
    """Example rows (grammar_id, sort_order, id, lang, sentence) as grammar_id and text."""
    one = F.concat_ws(":", "lang", "sentence")
    groups = rows.groupBy("grammar_id", "sort_order").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("t")))), lambda x: x["t"]), ";").alias("g"))
    return groups.groupBy("grammar_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "g"))), lambda x: x["g"]), "|").alias("examples"))


# ---------------------------------------------------------------- rules


def rule_of(row: dict[str, str]) -> tuple[Rule | None, str | None]:
    """The rule of a CSV row, and why it never matches if its pattern cannot be read; no rule for a row without a name."""
    name = row.get("rule_name") or ""
    if not name:
        return None, None
    title, said = row.get("name") or "", row.get("description") or ""
    description = f"{title}：{said}" if said else title or None
    pattern, warning = EMPTY, None
    if text := (row.get("pattern") or "").strip():
        try:
            pattern = parse(f"{name} = {text} ;").rules[0].pattern
        except PatternError as e:
            warning = f"{name}: {e}"
    levels = tuple((row.get("levels") or "").split())
    return Rule(name, pattern, levels, description, row.get("connection") or None, examples_of(row.get("examples") or "")), warning


def rules_from_csv(text: str) -> Grammar:
    rows = [rule_of(row) for row in csv.DictReader(io.StringIO(text, newline=""))]
    out = Grammar(tuple(r for r, _ in rows if r), tuple(w for _, w in rows if w))
    out.check()
    return out


def rules_from_gz(data: bytes) -> Grammar:
    try:
        return rules_from_csv(gzip.decompress(data).decode("utf-8"))
    except (OSError, EOFError, UnicodeDecodeError, csv.Error) as e:
        raise PatternError(f"rules cannot be read: {e}") from e


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows of a CSV file (gzip by its name): name, pattern, levels, description, connection, examples."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return decoded_rules(with_schema(raw, T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])))


def decoded_rules(raw: DataFrame) -> DataFrame:
    """Decoded rule rows; those without a name go."""
    none = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    title, said = none("name"), none("description")
    return raw.where(F.coalesce("rule_name", F.lit("")) != "").select(
        F.col("rule_name").alias("name"),
        F.trim(F.coalesce("pattern", F.lit(""))).alias("pattern"),
        F.filter(F.split(F.coalesce("levels", F.lit("")), r"\s+"), lambda x: x != "").alias("levels"),
        F.when(said.isNotNull(), F.concat(F.coalesce(title, F.lit("")), F.lit("："), said)).otherwise(title).alias("description"),
        none("connection").alias("connection"),
        decoded_examples(F.col("examples")).alias("examples"),
    )


def csv_cell(value: Column) -> Column:
    """A value in one line, in quotes where a comma or a quote asks for them."""
    line = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s*\r?\n\s*", " "))
    return F.when(line.rlike('[,"]'), F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(line)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule rows (CSV_COLUMNS, id) as one gzip CSV with a header, in order of id."""
    line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in CSV_COLUMNS])
    header = rules.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(",".join(CSV_COLUMNS)).alias("value"))
    lines = header.unionByName(rules.select(F.col("id").cast("long"), line.alias("value")))
    # one file is what the format is; a catalogue has as many rows as people have written
    lines.repartitionByRange(1, "id").sortWithinPartitions("id").select("value").write.option("compression", "gzip").text(path)


def rule_id(url: Column) -> Column:
    """What follows a URL's last slash (but for one at the end), with ``_`` for ``-``; else ``grammar_`` and 12 hexadecimal digits of it."""
    last = F.regexp_extract(url, r"/([^/]+)/?$", 1)
    return F.when(last != "", F.translate(last, "-", "_")).otherwise(F.concat(F.lit("grammar_"), F.lower(F.substring(F.hex(url), 1, 12))))
