"""Kernel density of points in the plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that meet the grid at once.
ROWS = 256


def kernel_density(points: DataFrame, cells: int = 60, point: str = "point") -> DataFrame:
    """gx, gy, x, y, density: a Gaussian kernel density over a grid of ``cells`` x ``cells`` from the least to the largest coordinates.

    The kernel has the points' covariance (divisor n - 1), scaled by Scott's rule:
    n^(-1/6) in each direction. Each task sums the kernels of its points at the
    grid's nodes, so that a row for each node and task is shuffled, and the time
    grows with the number of points. Points that are null or not finite are left
    out. Without two points that span a plane there is no density and no row.
    """
    x = points.select(F.get(point, F.lit(0)).cast("double").alias("x"), F.get(point, F.lit(1)).cast("double").alias("y")).where("x is not null and y is not null and abs(x) < double('infinity') and abs(y) < double('infinity')")
    r = x.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy")).first()
    schema = "gx int, gy int, x double, y double, density double"
    det = (r["xx"] or 0.0) * (r["yy"] or 0.0) - (r["xy"] or 0.0) ** 2
    if r["n"] < 2 or not det > 0:
        return points.sparkSession.createDataFrame([], schema)
    scale = r["n"] ** (-1 / 3)  # the square of Scott's factor
    a, b, c = r["yy"] / det / scale, -r["xy"] / det / scale, r["xx"] / det / scale
    top = 1 / (2 * np.pi * scale * np.sqrt(det) * r["n"])
    gx, gy = np.linspace(r["x0"], r["x1"], cells), np.linspace(r["y0"], r["y1"], cells)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, cells))
        for batch in batches:
            px, py = (np.asarray(batch.column(i)) for i in range(2))
            for t in range(0, len(px), ROWS):
                dx, dy = gx[None] - px[t : t + ROWS, None], gy[None] - py[t : t + ROWS, None]
                power = a * dx[:, :, None] ** 2 + 2 * b * dx[:, :, None] * dy[:, None, :] + c * dy[:, None, :] ** 2
                total += np.exp(-0.5 * power).sum(axis=0)
        at = np.indices((cells, cells)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total.ravel())], ["gx", "gy", "s"])

    sums = x.mapInArrow(kernels, "gx int, gy int, s double").groupBy("gx", "gy").agg((F.sum("s") * float(top)).alias("density"))
    place = lambda g, lo, hi: F.col(g) * ((hi - lo) / (cells - 1)) + lo
    return sums.select("gx", "gy", place("gx", r["x0"], r["x1"]).alias("x"), place("gy", r["y0"], r["y1"]).alias("y"), "density")
