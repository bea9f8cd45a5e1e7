"""A map of many-dimensional points in the plane that keeps neighbourhoods: neighbour lists, a fuzzy graph and a layout by its edges.

1. Neighbour lists by descent: points that lie side by side along random
   directions begin as candidates; then the neighbours of a point get to know one
   another, round by round. A round shuffles 3 k vectors for each point, and no
   group has more. The recall against exact lists is measured in the tests.
2. The strength of a neighbour falls with its distance beyond the first one, so
   that the strengths of a list come to log2(k); the two directions of an edge
   are united.
3. Points are drawn to their neighbours by strength and pushed from a sample of
   all points. Each round hands a task the places of its points' neighbours as they
   were, and the task moves its own points for some steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import checkpointed, stored
from .metric import distances
from .ranking import ranked

#: Points that lie side by side along a direction, directions, and rounds of descent.
BESIDE, DIRECTIONS, ROUNDS = 64, 8, 4
#: The curve of attraction for points that may come as near as 0.1 of the spread.
CURVE_A, CURVE_B = 1.577, 0.895
#: Points that stand for all when points are pushed apart, and pushes for each pull.
CROWD, PUSHES = 20_000, 5


def _best(entries: DataFrame, k: int) -> DataFrame:
    """i, near array<struct<d, j>>: of (i, j, d) the ``k`` nearest of each point."""
    return entries.groupBy("i", "j").agg(F.min("d").alias("d")).groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "j"))), 1, k).alias("near"))


def _acquainted(groups: DataFrame, k: int) -> DataFrame:
    """(i, j, d): the ``k`` nearest of each point among the points (g, i, v) of its groups."""

    def meet(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["i"].combine_chunks())
        v = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(ids), -1)
        far = distances(v, v)
        far[ids[:, None] == ids[None, :]] = np.inf
        m = min(k, len(ids) - 1)
        if m <= 0:
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        at = np.argpartition(far, m - 1, axis=1)[:, :m]
        d = np.take_along_axis(far, at, axis=1)
        x, y = np.nonzero(np.isfinite(d))
        return pa.table({"i": ids[x], "j": ids[at[x, y]], "d": d[x, y]})

    return groups.groupBy("g").applyInArrow(meet, "i long, j long, d double")


def neighbours(points: DataFrame, k: int = 15, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """i, near: about the ``k`` nearest others of each point (i long, v array<double>), as structs d, j, nearest first.

    Ids must be distinct. Null points are left out; with few points the lists are exact.
    """
    p = stored(points.where("i is not null and v is not null").select("i", "v"))
    first = p.first()
    if first is None:
        return p.select("i", F.array().cast("array<struct<d:double,j:bigint>>").alias("near"))
    rng = np.random.default_rng(seed)
    found = None
    for _ in range(DIRECTIONS):
        way = rng.normal(size=len(first["v"])).tolist()
        along = F.aggregate(F.zip_with("v", F.array(*map(F.lit, way)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        placed = ranked(p.withColumn("_along", along), [F.asc("_along"), F.asc("i")], "_place")
        beside = _acquainted(placed.select(F.floor(F.col("_place") / BESIDE).alias("g"), "i", "v"), k)
        found = beside if found is None else found.unionByName(beside)
    lists = stored(_best(found, k))
    for _ in range(rounds):
        links = lists.select("i", F.explode("near").alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.d").alias("d"))
        # Those that a point is near to: its own, and the nearest of those that have it in their lists.
        back = links.groupBy(F.col("j").alias("g")).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("i").alias("j")))), 1, 2 * k).alias("near"))
        members = lists.select(F.col("i").alias("g"), F.explode("near.j").alias("i")).unionByName(back.select("g", F.explode("near.j").alias("i"))).unionByName(p.select(F.col("i").alias("g"), "i")).distinct()
        known = _acquainted(members.join(p, "i").select("g", "i", "v"), k)
        lists = stored(_best(known.unionByName(links), k))
    return lists


def fuzzy_graph(lists: DataFrame) -> DataFrame:
    """(i, j, w), both directions: united strengths of neighbours."""

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, d = batch.column(0), batch.column(1)
            sizes = np.asarray(d.value_lengths()).astype(np.int64)
            flat, out = np.asarray(d.flatten()), []
            for far in np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []:
                beyond = np.maximum(far - (far[far > 0].min() if (far > 0).any() else 0.0), 0)
                lo, hi = 0.0, np.inf
                s, want = max(float(beyond.mean()), 1e-9), np.log2(max(2, len(far)))
                for _ in range(60):
                    total = np.exp(-beyond / s).sum()
                    lo, hi = (s, hi) if total < want else (lo, s)
                    s = 2 * s if np.isinf(hi) else (lo + hi) / 2
                out.append(np.exp(-beyond / max(s, 1e-3 * float(far.mean()) if len(far) else 1e-9, 1e-12)))
            w = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *out])))
            yield pa.RecordBatch.from_arrays([own, w, batch.column(2)], ["i", "w", "j"])

    told = lists.select("i", F.col("near.d").alias("d"), F.col("near.j").alias("j")).mapInArrow(strengths, "i long, w array<double>, j array<long>")
    one = told.select("i", F.explode(F.arrays_zip("j", "w")).alias("x")).select("i", F.col("x.j").alias("j"), F.col("x.w").alias("w"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    # a + b - a b, where b is 0 if only one of the two has the other in its list.
    return both.groupBy("i", "j").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


def layout(graph: DataFrame, start: DataFrame, rounds: int = 12, steps: int = 25, seed: int = 7) -> DataFrame:
    """i, x, y: places of points, from ``start`` (i, x, y), after ``rounds`` of ``steps`` moves each.

    Points without edges are pushed only. The result depends on the seed and on
    how points are dealt to tasks.
    """
    s = start.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.greatest(F.max(F.abs("x")), F.max(F.abs("y"))).alias("m")).first()
    scale = 10 / (s["m"] or 1.0)
    at = stored(start.select("i", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y")))
    edges = stored(graph)
    n = max(1, at.count())

    for r in range(rounds):
        rate = 1.0 - r / rounds
        crowd = np.array([(c["x"], c["y"]) for c in at.where(F.pmod(F.xxhash64(F.lit(r), "i"), F.lit(1 << 20)) < max(1, int(min(1.0, CROWD / n) * (1 << 20)))).select("x", "y").collect()] or [(0.0, 0.0)])

        def move(batches: Iterator[pa.RecordBatch], r: int = r, rate: float = rate, crowd: np.ndarray = crowd) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(seed + r)
            for b in batches:
                p = np.stack([np.asarray(b.column(1)), np.asarray(b.column(2))], axis=1).copy()
                near = b.column(3)
                of = np.repeat(np.arange(len(p)), np.asarray(near.value_lengths().fill_null(0)).astype(np.int64))
                x = near.flatten()
                tail, w = np.stack([np.asarray(x.field("x")), np.asarray(x.field("y"))], axis=1), np.asarray(x.field("w"))
                for k in range(steps):
                    a = rate * (1 - k / steps / rounds)
                    gap = p[of] - tail
                    square = (gap * gap).sum(axis=1)
                    pull = -2 * CURVE_A * CURVE_B * np.power(np.maximum(square, 1e-9), CURVE_B - 1) / (1 + CURVE_A * np.power(square, CURVE_B))
                    force = np.zeros_like(p)
                    np.add.at(force, of, np.clip((w * pull)[:, None] * gap, -4, 4))
                    weight = np.bincount(of, weights=w, minlength=len(p))
                    for _ in range(PUSHES):
                        gap = p - crowd[rng.integers(0, len(crowd), len(p))]
                        square = (gap * gap).sum(axis=1)
                        push = 2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * np.power(square, CURVE_B)))
                        force += np.clip(push[:, None] * gap, -4, 4) * weight[:, None]
                    p += a * np.clip(force / np.maximum(weight, 1)[:, None], -4, 4)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1])], ["i", "x", "y"])

        ends = edges.join(at.select(F.col("i").alias("j"), "x", "y"), "j").groupBy("i").agg(F.collect_list(F.struct("x", "y", "w")).alias("near"))
        rows = at.join(ends, "i", "left").select("i", "x", "y", F.coalesce("near", F.array().cast("array<struct<x:double,y:double,w:double>>")).alias("near"))
        at = checkpointed(rows.mapInArrow(move, "i long, x double, y double"))
    return at


def mapped(df: DataFrame, k: int = 15, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``df`` with point array<double>: places that keep the neighbourhoods of unit vectors; zero and null ones have none."""
    from .vectors import _unit, project

    unit = stored(_unit(df, id_, vector))
    graph = fuzzy_graph(neighbours(unit, k))
    begin = project(unit, "v").select("i", F.get("point", F.lit(0)).alias("x"), F.get("point", F.lit(1)).alias("y"))
    found = layout(graph, begin).select(F.col("i").alias("_i"), F.array("x", "y").alias("point"))
    return df.drop("point").join(found, F.col(id_).cast("long") == F.col("_i"), "left").drop("_i")
