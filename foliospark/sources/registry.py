"""Named datasets: injected frames, and tables that are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class DatasetRegistry:
    """Frames by name, in front of the session's catalogue. Names outside both are refused."""

    def __init__(self, spark: SparkSession, allowed: list[str] | None = None) -> None:
        self.spark, self.allowed, self.frames = spark, allowed, {}

    def inject(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def remove(self, name: str) -> bool:
        return self.frames.pop(name, None) is not None

    def names(self) -> list[str]:
        tables = [t.name for t in self.spark.catalog.listTables()]
        return sorted({*self.frames, *(t for t in tables if self.allowed is None or t in self.allowed)})

    def validate(self, name: str) -> str:
        if name not in self.names():
            raise KeyError(f"unknown dataset {name!r}")
        return name

    def load(self, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.frames[name] if name in self.frames else self.spark.table(self.validate(name))
        return df if columns is None else df.select(*[c for c in df.columns if c in columns])

    def columns(self, name: str) -> list[str]:
        return self.load(name).columns
