"""Every registered query of the engine: a function (spark, sf_dir) -> DataFrame, and the same in SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registered import checks, company, company_views, core, frames, parsing, signals, streams, texts, vectors

FLAGSHIP = "emerging_combinations"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (parsing, core, company, signals, company_views, vectors, texts, checks, frames, streams):
    QUERIES |= _part.REG.queries
    ORACLE_SQL |= _part.REG.sql
