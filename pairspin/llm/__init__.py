"""Operators of a training-data pipeline.  Nothing outside this package imports it.

``queries()`` and ``oracle_sql()`` collect what each operator module registers.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with a ``QUERIES`` dict and, where SQL can express the operator, an ``ORACLE_SQL`` dict.
MODULES: tuple[str, ...] = (
    "token_files",
    "digest_cache",
    "bpe_codec",
    "mixing",
    "language_id",
    "ngram_join",
    "cap_join",
    "adaptive_ann",
    "warc_fixity",
    "tool_calls",
    "piece_codec",
    "token_alignment",
    "spelling_variants",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable(spark, sf_dir) of every query of this package."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL for the queries that SQL can express."""
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {})
    return found
