"""Recall of the neighbour lists, and whether the map keeps neighbourhoods better than principal components."""

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import layout, metric
from foliospark.operators import vectors as V


def trust(far, place, k):
    """Trustworthiness: 1 if no point is among the ``k`` nearest on the map that isn't near in truth."""
    n = len(far)
    rank = far.argsort(axis=1).argsort(axis=1)  # 0 is the point itself
    on_map = metric.distances(place, place).argsort(axis=1)[:, 1 : k + 1]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, on_map, axis=1) - k, 0).sum()


def test_lists_and_map(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(14, 12)) * 3
    p = np.concatenate([c + rng.normal(size=(40, 12)) * 0.6 for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)] + [(None, p[0].tolist()), (-1, None)], "i long, v array<double>").repartition(4)
    far = metric.distances(p, p)
    exact = [set(r) for r in far.argsort(axis=1)[:, 1:11]]
    lists = layout.neighbours(df, 10)
    got = {r["i"]: r["near"] for r in lists.collect()}
    assert sorted(got) == list(range(len(p)))
    assert np.mean([len({x["j"] for x in got[i]} & exact[i]) for i in got]) >= 9.5
    assert all([x["d"] for x in near] == sorted(x["d"] for x in near) and np.allclose([x["d"] for x in near], [far[i, x["j"]] for x in near]) for i, near in got.items())
    graph = layout.fuzzy_graph(lists)
    edges = {(r["i"], r["j"]): r["w"] for r in graph.collect()}
    assert all(0 < w <= 1 + 1e-9 and np.isclose(edges[j, i], w) for (i, j), w in edges.items())
    flat = V.project(df.where("i >= 0 and v is not null"), "v").select("i", F.get("point", F.lit(0)).alias("x"), F.get("point", F.lit(1)).alias("y"))
    place = {r["i"]: (r["x"], r["y"]) for r in layout.layout(graph, flat).collect()}
    before = np.array([[r["x"], r["y"]] for r in flat.orderBy("i").collect()])
    after = np.array([place[i] for i in range(len(p))])
    assert np.isfinite(after).all() and 1 - trust(far, after, 10) < (1 - trust(far, before, 10)) * 2 / 3


def test_few_points(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["point"] for r in layout.mapped(df).collect()}
    assert got[3] is None and got[4] is None and len(got[1]) == len(got[2]) == 2 and np.isfinite(got[1] + got[2]).all()
    assert layout.neighbours(spark.createDataFrame([], "i long, v array<double>")).collect() == []
