"""Formulas against worked examples, and streams against tables."""

import math

import pytest
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import metrics as M
from foliospark.operators import core, expand, signals, vectors
from foliospark.streaming.events import sessions, windowed_counts


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_pair_formulas(spark):
    n = [F.lit(v) for v in (5, 20, 10, 100)]
    assert one(spark, M.lift(*n)) == 2.5
    assert one(spark, M.jaccard(*n[:3])) == 0.2
    assert math.isclose(one(spark, M.pmi(*n)), math.log2(2.5))
    assert one(spark, M.lift(F.lit(0), *n[1:])) == 0 and one(spark, M.npmi(F.lit(0), *n[1:])) is None
    assert one(spark, M.safe_div(F.lit(1), F.lit(0))) == 0
    assert one(spark, M.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, M.weighted_geometric_mean([(F.lit(1.0), 0.0)])) is None


def test_concentration(spark):
    r = M.concentration(spark.createDataFrame([("a", 50), ("a", 50), ("b", 3), ("b", 0)], "key string, n int"), ["key"]).orderBy("key").collect()
    assert [round(x, 9) for x in (r[0].hhi, r[0].entropy, r[0].entropy_norm)] == [0.5, 1.0, 1.0]
    assert (r[1].hhi, r[1].entropy, r[1].entropy_norm, r[1].k) == (1.0, 0.0, 0.0, 1)


def growth(spark, series, recent=3, year_max=None):
    df = spark.createDataFrame([("k", y, n) for y, n in series.items()], "k string, year int, n int")
    r = M.growth_ladder(df, ["k"], recent, year_max).first()
    return r.growth, r.method


def test_growth_ladder(spark):
    assert growth(spark, {2019: 2, 2020: 4, 2021: 8}) == (1.0, "cagr")
    assert growth(spark, {2019: 5, 2020: 8, 2021: 12, 2022: 0})[1] == "linreg_slope_ratio"
    assert growth(spark, {2018: 2, 2021: 1})[1] == "linreg_slope_ratio"  # the gap years count as 0
    assert growth(spark, {2019: 2}, year_max=2024) == (-1.0, "period_over_period")
    assert growth(spark, {2020: 0, 2021: 4}, recent=1) == (1.0, "period_over_period_newzero")
    assert growth(spark, {2021: 3}) == (None, "insufficient")


def test_kaplan_meier(spark):
    df = spark.createDataFrame([(2.0, 1), (3.0, 0), (4.0, 0), (6.0, 1), (8.0, 0)], "duration double, event int")
    assert [(r.t, round(r.survival, 9)) for r in M.kaplan_meier(df, []).orderBy("t").collect()] == [(2.0, 0.8), (6.0, 0.4)]
    s = signals.survival(df, F.lit("all"), 1).first()
    assert (round(s.s5, 9), s.median) == (0.8, 6.0)


def test_lagged_correlation_needs_variation(spark):
    rows = [("p", lag, x, y) for lag, pairs in {0: [(1, 5), (2, 5), (3, 5), (4, 5)], 1: [(1, 2), (2, 4), (3, 6), (4, 8)], -1: [(1, 4), (2, 3), (3, 2), (4, 1)]}.items() for x, y in pairs]
    r = M.lagged_correlation(spark.createDataFrame(rows, "k string, lag int, x int, y int"), ["k"]).collect()
    assert [(x.lag, round(x["corr"], 6)) for x in r] == [(-1, -1.0)]


def test_ratio_to_max_and_normalize(spark):
    df = spark.createDataFrame([(6.0, 5.0), (4.0, -2.0)], "a double, b double")
    assert [(round(r.a, 3), r.b) for r in M.ratio_to_max(df, ["a", "b"]).collect()] == [(1.0, 1.0), (0.667, 0.0)]
    z = M.normalize(df.withColumn("c", F.lit(1.0)), {"a": False, "c": True}, 0.0).collect()
    assert [(r.norm_a, r.norm_c) for r in z] == [(1.0, 0.5), (0.0, 0.5)]


def test_counting_of_joint_filings(spark):
    rows = [("A", ["A"]), ("A", ["A"]), ("A", ["A", "B"]), ("B", ["B"])]
    df = spark.createDataFrame(rows, "applicant string, co_applicants array<string>")
    count = lambda mode: {r.company: r["count"] for r in expand.explode_applicants(df, mode).groupBy("company").count().collect()}
    assert count("all") == {"A": 3, "B": 2} and count("first") == {"A": 3, "B": 1}
    assert expand.explode_applicants(df, "all", ["A"]).count() == 2
    with pytest.raises(ValueError):
        expand.explode_tech(df, "other")


def test_set_gaps(spark):
    rows = [(["A", "C"],) if i % 2 else (["B", "D"],) for i in range(120)]
    got = {r.combo: r for r in core.upset_gaps(spark.createDataFrame(rows, "tech_list array<string>")).collect()}
    assert got["A & B"].actual == 0 and got["A & B"].expected == 30


def test_bursts_restart_after_each_window(spark):
    days = ["2020-01-01", "2020-01-10", "2020-06-28", "2020-06-30", "2020-07-01", "2020-07-02"]
    df = spark.createDataFrame([("x", d) for d in days], "k string, d string").withColumn("d", F.to_date("d"))
    assert [(str(r.start), r.n) for r in signals.bursts(df, "k", "d").orderBy("start").collect()] == [("2020-01-01", 3), ("2020-06-30", 3)]


def test_bridges_and_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 3), (8, 9)]
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, similarity double").selectExpr("least(a,b) a", "greatest(a,b) b", "similarity")
    labels = vectors.components(pairs)
    assert {r.node: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert sorted(r.node for r in vectors.bridges(pairs, labels).collect()) == [2, 3]


def test_settings_overlay():
    s = Settings({"limits": {"network_max_edges": "7"}, "thresholds": {"recent_years": "x"}, "weights": {"emerging": {"lift": 2}}})
    assert s.limit("network_max_edges") == 7 and s.threshold("recent_years") == 3 and s.weights("emerging")["lift"] == 2.0


def test_stream_is_like_the_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(spark.table("w")) == rows(windowed_counts(table))
    assert sum(r.n for r in sessions(table).collect()) == table.count()
