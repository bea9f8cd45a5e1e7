"""Vectors from .npy and .npz files or tables, and how they are attached to documents."""

from __future__ import annotations

import contextlib
import zipfile
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.parse import id_key, parse_vector


#: Rows that a partition reads, and rows of a batch.
ROWS, BATCH = 50_000, 1_000


class _Part(NamedTuple):
    """One array of a file: a whole .npy file, or a member of an .npz file. ``offset``: of its first item in the file, None in a compressed member."""

    member: str | None
    shape: tuple[int, ...]
    dtype: np.dtype
    offset: int | None


def _opened(uri: str) -> Any:
    """A seekable file of any file system that Arrow has."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    fs, path = pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs.open_input_file(path)


def _header(f: Any) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def _parts(uri: str) -> list[_Part]:
    """The arrays of a file, by their headers alone."""
    found = []
    with _opened(uri) as f:
        if f.read(2) != b"PK":
            f.seek(0)
            shape, fortran, dtype = _header(f)
            found.append((_Part(None, shape, dtype, f.tell()), fortran))
        else:
            f.seek(0)
            with zipfile.ZipFile(f) as z:
                for info in z.infolist():
                    with z.open(info) as m:
                        shape, fortran, dtype = _header(m)
                        inside = m.tell()
                    f.seek(info.header_offset + 26)
                    skipped = 30 + sum(np.frombuffer(f.read(4), "<u2").tolist())
                    found.append((_Part(info.filename, shape, dtype, info.header_offset + skipped + inside if info.compress_type == zipfile.ZIP_STORED else None), fortran))
    if any(p.dtype.hasobject or fortran and len(p.shape) > 1 for p, fortran in found):
        raise ValueError("arrays must be plain and stored row by row")
    return [p for p, _ in found]


def _slice(uri: str, part: _Part, start: int, stop: int) -> Iterator[np.ndarray]:
    """Rows ``start`` to ``stop`` of an array, in batches; a compressed member is read from its beginning."""
    width = int(np.prod(part.shape[1:], dtype=np.int64)) * part.dtype.itemsize
    with _opened(uri) as f, contextlib.ExitStack() as stack:
        if part.offset is not None:
            f.seek(part.offset + start * width)
            source = f
        else:
            source = stack.enter_context(stack.enter_context(zipfile.ZipFile(f)).open(part.member))
            _header(source)
            for at in range(0, start, BATCH):
                source.read(min(BATCH, start - at) * width)
        for at in range(start, stop, BATCH):
            n = min(BATCH, stop - at)
            yield np.frombuffer(source.read(n * width), part.dtype).reshape(n, *part.shape[1:])


class VectorFile(DataSource):
    """Format ``vectors``: an .npy or .npz file, a slice of rows for each partition.

    The driver reads the headers. An .npz file has the vectors in its first
    two-dimensional array and ids in its first one-dimensional one, if any.
    """

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "position long, id string, vector array<double>"

    def reader(self, schema: Any) -> VectorFileReader:  # noqa: ARG002
        return VectorFileReader(self.options)


class VectorFileReader(DataSourceReader):
    def __init__(self, options: Any) -> None:
        self.path, self.rows = options["path"], int(options.get("rowsPerPartition", ROWS))
        parts = _parts(self.path)
        two, one = [p for p in parts if len(p.shape) == 2], [p for p in parts if len(p.shape) == 1]
        if not two or not all(two[0].shape) or not np.issubdtype(two[0].dtype, np.number):
            raise ValueError("vectors must be a two-dimensional array of numbers with values")
        self.vectors, self.ids = two[0], one[0] if one else None
        if self.ids is not None and self.ids.shape[0] != self.vectors.shape[0]:
            raise ValueError("there must be as many ids as vectors")

    def partitions(self) -> list[InputPartition]:
        n = self.vectors.shape[0]
        # Each partition of a compressed array would have to read all before it.
        step = n if self.vectors.offset is None else self.rows
        return [InputPartition((at, min(n, at + step))) for at in range(0, n, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, stop = partition.value
        ids = _slice(self.path, self.ids, start, stop) if self.ids is not None else None
        for v in _slice(self.path, self.vectors, start, stop):
            if not np.isfinite(v).all():
                raise ValueError("vectors must be finite numbers")
            names = pa.nulls(len(v), pa.string()) if ids is None else pa.array([str(x) for x in next(ids)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(v))), names, lists], ["position", "id", "vector"])
            start += len(v)


def read_vectors(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """position, id (null if the file has none), vector: ``rows`` vectors for each partition."""
    spark.dataSource.register(VectorFile)
    VectorFileReader({"path": path, "rowsPerPartition": rows})  # an unfit file is an error here, not in a task
    return spark.read.format("vectors").option("path", path).option("rowsPerPartition", rows).load()


def vectors_of(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and vector of a table whose vectors are arrays or text."""
    kind = df.schema[vector].dataType.typeName()
    return df.select(F.col(id_).cast("string").alias("id"), (F.col(vector).cast("array<double>") if kind == "array" else parse_vector(F.col(vector))).alias("vector"))


def attach_by_id(docs: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with embedding, joined on the one of ``keys`` that matches most ids, compared without punctuation or a trailing .0."""
    v = vectors.where("id is not null and vector is not null").select(id_key(F.col("id")).alias("_k"), "vector").groupBy("_k").agg(F.min("vector").alias("embedding"))
    flat = docs.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), id_key(F.col(k)).alias("_k")) for i, k in enumerate(keys)])).alias("x")).select("x.i", "x._k")
    best = flat.join(v.select("_k"), "_k", "left_semi").groupBy("i").count().orderBy(F.desc("count"), "i").first()
    key = keys[best["i"] if best else 0]
    return docs.drop("embedding").withColumn("_k", id_key(F.col(key))).join(v, "_k", "left").drop("_k")


def attach_by_order(docs: DataFrame, vectors: DataFrame, order: str = "doc_id") -> DataFrame:
    """``docs`` with embedding by position in ``order``; refused unless both have as many rows."""
    if docs.count() != vectors.count():
        raise ValueError("vectors without ids need as many rows as there are documents")
    # Positions by a two-step count: within ranges of the order, and before them.
    spread = docs.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    sizes = spread.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    placed = spread.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1).join(F.broadcast(sizes), "_p").withColumn("position", F.col("_n") + F.col("_before"))
    return placed.drop("embedding", "_p", "_n", "_before").join(vectors.select("position", F.col("vector").alias("embedding")), "position", "left").drop("position")
