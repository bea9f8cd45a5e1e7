"""Tabular scans. Text formats are read as strings, without an inference pass; types come later, from the parsers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an uploaded sheet that are read at most, and of a bounded sample.
UPLOAD_ROWS, SAMPLE_ROWS = 60_000, 300


def _tidy(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Stripped headers, only the requested columns that exist, no rows that are null all over."""
    df = df.toDF(*[str(c).strip() for c in df.columns])
    keep = [c for c in df.columns if columns is None or c in columns]
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in df.columns], F.lit(False))
    return df.where(some).select(*[F.col(f"`{c}`") for c in keep])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str | None = None, delimiter: str = ",", multi_line: bool = True) -> DataFrame:
    """All columns as strings. Without ``encoding``: UTF-8, or cp949 if any line holds bytes that aren't UTF-8, for which the file is read once more.

    Cells of exports may hold line breaks, so a file is one task; without
    ``multi_line`` large files are split among tasks.
    """
    reader = lambda enc: spark.read.option("header", True).option("encoding", enc).option("sep", delimiter).option("multiLine", multi_line).csv(path)
    if encoding is None:
        encoding = "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "x-windows-949"
    if encoding.upper() not in ("UTF-8", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32", "ISO-8859-1", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark 4 reads no other charset
    return _tidy(reader(encoding), columns)


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None, fmt: str | None = None, **options: str) -> DataFrame:
    """A catalogued table or view, or a path with ``fmt`` (parquet, orc, json, jdbc ...); unused columns are never read."""
    df = spark.read.format(fmt).options(**options).load(name) if fmt else spark.table(name)
    return _tidy(df, columns)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, columns: list[str] | None = None, rows: int = UPLOAD_ROWS) -> DataFrame:
    """A sheet of at most ``rows`` rows, through pandas on the driver (needs an engine such as openpyxl)."""
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet, nrows=rows, dtype=str)
    schema = ", ".join(f"`{str(c).strip()}` string" for c in frame.columns)
    return _tidy(spark.createDataFrame(frame.where(frame.notna(), None), schema), columns)


def sheet_names(path: str) -> list[str]:
    """The sheets of an Excel file, in order (needs an engine such as openpyxl)."""
    import pandas as pd

    with pd.ExcelFile(path) as book:
        return [str(n) for n in book.sheet_names]


def sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return df.limit(rows)
