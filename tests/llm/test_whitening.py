"""Whitening against numpy's eigenvectors and Python's integers, and vectors that are left out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors):
    """n, integers, centred integers, covariance (in doubles, of exact integers) of a list of lists."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    d = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    cov = [[sum(r[i] * r[j] for r in d) / n**3 for j in range(len(sums))] for i in range(len(sums))]
    return n, d, np.array(cov)


def check(rows, vectors, k):
    """Rows of the query against the definition: eigenvectors up to their sign."""
    n, d, cov = exact([v for _, v in vectors])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = np.array(d, float) / n @ axes / np.sqrt(values)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(vectors) * k
    for c in range(k):
        mine = np.array([got[i, c + 1]["whitened"] for i, _ in vectors])
        sign = np.sign(mine @ want[:, c])
        assert np.allclose(sign * mine, want[:, c], atol=1e-6)
        assert {got[i, c + 1]["explained"] for i, _ in vectors} == {rows[0]["explained"] if c + 1 == rows[0]["component"] else got[vectors[0][0], c + 1]["explained"]}
        assert got[vectors[0][0], c + 1]["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
    for (i, _), row in zip(vectors, d, strict=True):
        assert got[i, 1]["deviation"] == sum(a * a for a in row) and got[i, 1]["n"] == n
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_query_against_the_definition(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_embedding_whitening"](spark, d).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(rows, vectors, 32)


def test_vectors_that_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(7)
    whole = [(i, rng.normal(size=5).astype(np.float32).tolist(), 1) for i in range(60)] + [(3, [9.0] * 5, 1), (3, [9.0] * 5, 1), (None, [1.0, 2.0, 3.0, 4.0, 5.5], None)]
    odd = [(100, None, 1), (101, [], 1), (102, [1.0, None, 0.0, 0.0, 0.0], 1), (103, [math.nan] * 5, 1), (104, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (105, [1.0], 1), (106, [3e38, 0.0, 0.0, 0.0, 0.0], 1)]
    spark.createDataFrame(whole + odd, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect()
    assert len(rows) == len(whole) * 5
    named = [r for r in rows if r["vec_id"] is not None and r["vec_id"] != 3]
    _, d, cov = exact([v for _, v, _ in whole])
    assert {r["deviation"] for r in named if r["vec_id"] == 0} == {sum(a * a for a in d[0])}
    assert sum(r["explained"] for r in rows if r["vec_id"] == 0) == pytest.approx(1.0, rel=1e-9) and rows[0]["identity_error"] < 1e-9
    assert {r["n"] for r in rows} == {len(whole)}


def test_operator_keeps_columns_and_rank(spark):
    """Vectors in a plane of four dimensions have two components; columns named like the new ones are replaced, others kept."""
    rows = [(i, [float(i), float(i * i % 7), 0.0, 5.0], i) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _vector int").withColumn("Whitened", F.lit("x"))
    model = whitening.fit(df)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "_vector", "whitened", "deviation"] and model.axes.shape == (4, 2)
    got = out.collect()
    w = np.array([r["whitened"] for r in got])
    assert len(got) == 40 and np.allclose(np.cov(w.T, bias=True), np.eye(2), atol=1e-9)
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["whitened"], int(r["deviation"])) for r in whitening.whiten(alike, whitening.fit(alike)).collect()] == [([], 0), ([], 0)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect() == []


def test_sums_beyond_64_bits():
    x = np.array([[1 << 52, 5], [-(1 << 52), 7]]) + whitening.SHIFT
    n, sums = 1 << 40, [3, -(1 << 91)]
    d = whitening._centred(x, n, sums)
    assert d.tolist() == [[n * int(a) - s for a, s in zip(r, sums, strict=True)] for r in x]
    assert whitening._deviations(d).tolist() == [sum(a * a for a in r) for r in d.tolist()]
