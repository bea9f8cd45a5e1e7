"""The metric index against all pairs, what it leaves out, and HDBSCAN against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import hdbscan as H
from foliospark.operators import metric
from foliospark.operators import vectors as V


def frame(spark, points):
    return spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(points)], "vec_id long, point array<double>").repartition(4)


def groups(seed, n, dims, each):
    """``n`` close groups of ``each`` points, far from one another."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.normal(size=dims) * 20, 0.3, (each, dims)) for _ in range(n)])


@pytest.mark.parametrize("dims, block", [(2, 16), (12, 25), (3, 1000)])
def test_nearest_against_all_pairs(spark, dims, block):
    p = np.concatenate([groups(3, 5, dims, 30), np.zeros((4, dims))])
    index = metric.build(frame(spark, p).select(F.col("vec_id").alias("i"), F.col("point").alias("v")), block=block)
    far = metric.distances(p, p)
    np.fill_diagonal(far, np.inf)
    want = {i: sorted(zip(far[i].tolist(), range(len(p)), strict=True))[:6] for i in range(len(p))}
    for r in metric.nearest(index, 6).collect():
        assert [x["j"] for x in r["near"]] == [j for _, j in want[r["i"]]] or np.allclose([x["d"] for x in r["near"]], [d for d, _ in want[r["i"]]], atol=1e-6)
        assert np.allclose([x["d"] for x in r["near"]], [d for d, _ in want[r["i"]]], atol=1e-6)


def test_cells_far_apart_do_not_meet(spark):
    """The pairs of vectors that are compared grow with the number of close groups, not with its square."""
    compared = []
    for n in (10, 40):
        p = groups(5, n, 16, 50)
        unit = p / np.linalg.norm(p, axis=1, keepdims=True)
        index = metric.build(frame(spark, unit).select(F.col("vec_id").alias("i"), F.col("point").alias("v")), block=50)
        rows = np.array([r[1] for r in sorted(map(tuple, index.rows.groupBy("cell").count().collect()))])
        wanted = (index.apart() <= np.sqrt(2 - 2 * 0.99) + metric.SLACK)[np.ix_(*[[c for c in range(len(index.blocks)) if index.far[c].any() or index.near[c].any()]] * 2)]
        assert len(rows) == len(wanted)
        compared.append(int((np.outer(rows, rows) * wanted).sum()))
        got = V.similarity_pairs(frame(spark, p), 0.99, vector="point", block=50)
        s = unit @ unit.T
        assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a, b in zip(*np.nonzero(s >= 0.99), strict=True) if a < b}
    assert compared[1] < 8 * compared[0] < compared[0] * 16


def test_overlap_density_of_few_and_zero_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["node"]: r["density"] for r in V.overlap_density(df, k=20).collect()}
    h = 0.5**0.5
    assert got[4] is None and got[2] == 0.0
    assert got[1] == pytest.approx((h + 0 + 0) / 3) and got[3] == pytest.approx((h + 0 + 0) / 3) and got[5] == pytest.approx((0 + 0 - h) / 3)
    assert [r["density"] for r in V.overlap_density(df.where("vec_id in (1, 4)")).collect()].count(0.0) == 1


def by_definition(p, least, samples):
    """HDBSCAN from above: at each weight, from the largest, what is left of a cluster falls into its parts."""
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    core = np.sort(far, axis=1)[:, samples]
    reach = np.maximum(far, np.maximum(core[:, None], core[None]))

    def parts(inside, w):
        left, out = set(inside), []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                x = todo.pop()
                near = [y for y in left if reach[x, y] < w]
                left -= set(near)
                part |= set(near)
                todo += near
            out.append(sorted(part))
        return out

    lam = lambda w: 1 / max(w, H.LEAST_WEIGHT * reach[np.triu_indices(len(p), 1)].max())

    def best(inside, born, root):
        """(stability, clusters) of the best choice within a cluster."""
        now, stability = list(inside), 0.0
        for w in sorted({reach[a, b] for a in inside for b in inside if a < b}, reverse=True):
            found = parts(now, w)
            large = [x for x in found if len(x) >= least]
            if len(found) == 1:
                continue
            stability += (len(now) - (len(large[0]) if len(large) == 1 else 0)) * (lam(w) - born)
            if len(large) != 1:
                below = [best(x, lam(w), False) for x in large]
                total = sum(s for s, _ in below)
                return (total, [c for _, cs in below for c in cs]) if root or below and total > stability else (stability, [inside])
            now = large[0]
        return (0.0, []) if root else (stability, [inside])

    label = np.full(len(p), -1)
    for c in best(list(range(len(p))), 0.0, True)[1]:
        label[c] = min(c)
    return label.tolist()


@pytest.mark.parametrize("block, edges", [(2048, H.EDGES), (30, H.EDGES), (30, 60)])
def test_hdbscan_against_its_definition(spark, block, edges):
    """Whatever the size of blocks and tasks: pruned pairs, Borůvka rounds and weights merged range by range give the same."""
    rng = np.random.default_rng(block + 4)
    p = np.concatenate([rng.normal([0, 0], 0.3, (60, 2)), rng.normal([3, 0], 0.5, (60, 2)), rng.normal([1, 3], 0.2, (50, 2)), rng.uniform(-2, 5, (30, 2))])
    want = by_definition(p, 8, 5)
    assert len(set(want)) > 3
    got = dict(map(tuple, H.hdbscan(frame(spark, p), 8, 5, block=block, edges=edges).collect()))
    assert [got[i] for i in range(len(p))] == want


def test_hdbscan_with_ties_and_copies(spark):
    """A lattice (nearly all weights are equal) beside a point with more copies than a cluster needs, and a few points by themselves."""
    p = np.array([(x, y) for x in range(6) for y in range(6)] + [(40.0, 40.0)] * 9 + [(40.5, 40.0)] * 2 + [(20.0, 20.0), (-30.0, 5.0)])
    got = dict(map(tuple, H.hdbscan(frame(spark, p), 6, 3).collect()))
    assert [got[i] for i in range(len(p))] == by_definition(p, 6, 3)
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, point array<double>")
    assert sorted(map(tuple, H.hdbscan(few).collect())) == [(1, -1), (3, -1)]
    assert H.hdbscan(few.limit(0)).collect() == []
