"""Embedding whitening: principal components with unit variance.

An entry c becomes the integer floor(64 c) + 1000000, so that counts and sums are
exact: n * x - S (the centred entry, n times) is an integer as well, whatever the
order of the rows. Spark MLlib's ``computeSVD`` decomposes the distributed centred
rows; its singular values s give the eigenvalues s^2 / n of the covariance with
divisor n. The total variance, of which an eigenvalue is a share, isn't taken from
them but summed exactly from the deviations. What the driver and the tasks hold is
bounded by the number of dimensions: sums of one number each, and the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unused
from .encode import tidy

SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond this can't be told from their neighbours once they are integers.
LARGEST = float(1 << 52)
#: Up to so many dimensions all eigenvalues are computed directly, from the distributed Gram matrix; beyond, the largest by the distributed Lanczos solver.
DIRECT = 4096


class Fit(NamedTuple):
    """``n`` vectors of ``len(sums)`` entries; ``axes`` has a component in each column, ``values`` their eigenvalues, ``total`` the sum of all variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float


def integers(vectors: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer entries) of the vectors that are whole and finite, for each length (or only ``size``)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0)).astype(np.int64)
    for m in [size] if size is not None else [int(x) for x in np.unique(lengths[lengths > 0])]:
        at = np.flatnonzero(lengths == m)
        v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)  # null entries are NaN
        with np.errstate(invalid="ignore"):
            good = (np.abs(SCALE * v) < LARGEST).all(axis=1)
        yield at[good], np.floor(SCALE * v[good]).astype(np.int64) + SHIFT


def _exact(x: np.ndarray, largest: int) -> np.ndarray:
    """``x`` as it is where numbers up to ``largest`` fit into 64 bits, else as Python's integers."""
    return x if largest < 1 << 62 else x.astype(object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    return _exact(x, largest) * n - np.array(sums, dtype=np.int64 if largest < 1 << 62 else object)


def _deviations(d: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exact."""
    d = _exact(d, int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]))
    return (d * d).sum(axis=1)


def _totals(df: DataFrame, of: Callable[[pa.Array], dict[tuple[int, int], int | float]], kind: str) -> dict[tuple[int, int], int | float]:
    """Sums over all rows of the numbers that ``of`` finds in a batch of vectors, by their keys: a row for each key and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int | float] = {}
        for batch in batches:
            for k, v in of(batch.column(0)).items():
                found[k] = found.get(k, 0) + v
        values = pa.array([Decimal(v) for v in found.values()], pa.decimal128(38, 0)) if kind != "double" else pa.array([*found.values()], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), values], ["a", "b", "v"])

    rows = df.mapInArrow(tidy(run), f"a long, b long, v {kind}").groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    return {(r["a"], r["b"]): float(r["v"]) if kind == "double" else int(r["v"]) for r in rows}


EXACT = "decimal(38,0)"


def fit(df: DataFrame, vector: str = "embedding", k: int = 32) -> Fit | None:
    """The first ``k`` components of the vectors in a column; None if there is no vector that is whole.

    Left out are vectors that are null or empty, or have an entry that is null,
    not finite or beyond 2^46; where lengths differ, all but those of the most
    frequent length (of several, the largest). Directions in which the vectors
    don't vary (singular values under 1e-9 of the largest) are no components, so
    there may be fewer than ``k``; repeated rows count as often as they come.
    """
    d = df.select(F.col(f"`{vector}`").alias("v"))

    def sums(vectors: pa.Array) -> dict:
        out: dict[tuple[int, int], int] = {}
        for _, x in integers(vectors):
            m = x.shape[1]
            if len(x):
                out |= {(m, -1): len(x)} | {(m, j): int(s) for j, s in enumerate(_exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0))}
        return out

    found = _totals(d, sums, EXACT)
    if not found:
        return None
    n, size = max((v, m) for (m, j), v in found.items() if j == -1)
    total_of = [found[size, j] for j in range(size)]

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in integers(batch.column(0), size):
                rows = (_centred(x, n, total_of) / n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(rows.ravel()))], ["v"])

    rows = MLUtils.convertVectorColumnsFromML(d.mapInArrow(tidy(centred), "v array<double>").select(array_to_vector("v").alias("v")), "v")
    # For more than half of the directions the library takes the whole Gram matrix, whose eigenvalues are as exact as doubles are.
    svd = RowMatrix(rows).computeSVD(max(min(k, size), size // 2 + 1) if size <= DIRECT else min(k, size))
    s = svd.s.toArray()[:k]
    s = s[s > 0]
    values, axes = s * s / n, svd.V.toArray()[:, : len(s)]

    def deviations(vectors: pa.Array) -> dict:
        return {(0, 0): sum(map(int, _deviations(_centred(x, n, total_of)))) for _, x in integers(vectors, size)}

    def means(vectors: pa.Array) -> dict:
        return {(0, j): float(y) for _, x in integers(vectors, size) for j, y in enumerate(_whitened(_centred(x, n, total_of), n, axes, values).sum(axis=0))}

    total = _totals(d, deviations, EXACT)[0, 0] / n**3
    mean = np.array([v for _, v in sorted(_totals(d, means, "double").items())]) / n

    def products(vectors: pa.Array) -> dict:
        out: dict[tuple[int, int], float] = {}
        for _, x in integers(vectors, size):
            w = _whitened(_centred(x, n, total_of), n, axes, values) - mean
            out = {(i, j): float(y) for i, row in enumerate(w.T @ w) for j, y in enumerate(row)}
        return out

    error = max((abs(v / n - (i == j)) for (i, j), v in (_totals(d, products, "double") if len(s) else {}).items()), default=0.0)
    return Fit(n, total_of, axes, values, total, error)


def _whitened(d: np.ndarray, n: int, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (d / n).astype(np.float64) @ axes / np.sqrt(values)


def whiten(df: DataFrame, model: Fit | None, vector: str = "embedding") -> DataFrame:
    """``df``'s rows with a vector that ``model`` can take, all columns as they are, and whitened array<double> and deviation decimal(38,0) after them.

    Rows that ``fit`` leaves out are left out. Columns of ``df`` of these two
    names are replaced. Repeated rows stay repeated.
    """
    own = [c for c in df.columns if c.lower() not in ("whitened", "deviation")]
    v = unused(df, "vector")
    d = df.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{vector}`").alias(v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                continue
            for at, x in integers(batch.column(len(own)), len(model.sums)):
                c = _centred(x, model.n, model.sums)
                w = _whitened(c, model.n, model.axes, model.values)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(own)], lists, pa.array([*map(Decimal, map(int, _deviations(c)))], pa.decimal128(38, 0))], [*own, "whitened", "deviation"])

    schema = d.select(*[F.col(f"`{c}`") for c in own], F.array().cast("array<double>").alias("whitened"), F.lit(None).cast(EXACT).alias("deviation")).schema
    return d.mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str, k: int = 32) -> DataFrame:  # noqa: ANN001
    """A row for each whole vector and component. A deviation beyond a long, which takes some ten million vectors, is an error here; ``whiten`` has it as a decimal."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(d, k=k)
    explained = (model.values / model.total).tolist() if model is not None and model.total else []
    w = whiten(d, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    share = F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("i"))
    return w.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", share.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
