"""The engine's operators applied to the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.stored import document_frame


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}
        self.over_docs: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = f
        if sql is not None:
            self.sql[name] = sql

    def docs(self, name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
        """A query over the standard frame."""
        self.over_docs[name] = f
        self.add(name, lambda spark, sf_dir: f(document_frame(spark, sf_dir)), sql)
