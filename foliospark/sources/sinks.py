"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS


def write_table(df: DataFrame, path: str, fmt: str = "parquet", rows: int | None = None, mode: str = "errorifexists") -> None:
    """Writes ``df``, or its first ``rows`` rows. csv turns arrays into text joined by "; "; xlsx is one file of export_max_rows rows at most, made on the driver."""
    out = df if rows is None else df.limit(rows)
    if fmt in ("csv", "xlsx"):
        out = _flat(out)
    if fmt == "xlsx":
        out.limit(LIMITS["export_max_rows"]).toPandas().to_excel(path, index=False)
    elif fmt == "csv":
        out.write.mode(mode).option("header", True).csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def write_sheets(tables: dict[str, DataFrame], path: str, fmt: str = "csv", rows: int | None = None) -> None:
    """Several tables: a folder with one table each under its name, or the sheets of one xlsx file (at most export_max_rows rows each, made on the driver; needs an engine such as openpyxl)."""
    if fmt != "xlsx":
        for name, df in tables.items():
            write_table(df, f"{path.rstrip('/')}/{name}", fmt, rows)
        return
    import pandas as pd

    most = min(rows or LIMITS["export_max_rows"], LIMITS["export_max_rows"])
    with pd.ExcelWriter(path) as book:
        for name, df in tables.items():
            _flat(df).limit(most).toPandas().to_excel(book, sheet_name=name[:31], index=False)


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as text joined by "; "."""
    is_array = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    return df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if c in is_array else F.col(c) for c in df.columns])
