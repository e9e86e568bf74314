"""The queries of this package and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this package; each module has ``query(spark, sf_dir)`` and may have ``ORACLE_SQL``.
MODULES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op2_sharding": "sharding",
    "op3_packing": "packing",
    "op4_toxicity": "toxicity",
    "op5_line_dedup": "line_dedup",
    "op6_fingerprints": "fingerprints",
    "op7_jaccard_join": "jaccard_join",
    "op8_lm_scoring": "lm_scoring",
    "op9_licenses": "licenses",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
