"""Self-checks with planted faults, and samples that don't depend on how a table is dealt."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from foliospark.operators import sampling, selfcheck

DAY = datetime.date(2020, 1, 1)
SCHEMA = "doc_id long, base_year int, applicant string, co_applicants array<string>, tech_list array<string>, tech_l1_list array<string>, tech_l3_list array<string>, legal_status string, active_flag boolean, app_date date, reg_date date, cites_forward double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, 2015 + i % 5, f"C{i % 3}", [f"C{i % 3}", f"C{(i + 1) % 3}"][: 1 + i % 2], ["a", "b", "c"][: 1 + i % 3], ["x"], ["y"], "Pending", True, DAY, DAY, 1.0) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


def status(df, year=2020):
    return {r["name"]: r["status"] for r in selfcheck.self_check(df, year).collect()}


def test_self_check(spark, docs):
    assert set(status(docs).values()) == {"passed"}
    assert status(docs, 2018)["years ahead"] == "attention"
    faulty = docs.unionByName(docs.limit(6)).withColumns({"applicant": F.when(F.col("doc_id") > 9, F.col("applicant")).otherwise(" "), "reg_date": F.when(F.col("doc_id") == 3, F.lit("2019-01-01").cast("date")).otherwise(F.col("reg_date")), "tech_l1_list": F.when(F.col("doc_id") == 5, F.array().cast("array<string>")).otherwise(F.col("tech_l1_list")), "base_year": F.when(F.col("doc_id") > 12, F.col("base_year")), "active_flag": F.when(F.col("doc_id") > 30, True)})
    got = status(faulty)
    assert {k for k, v in got.items() if v == "attention"} == {"years known", "applicants known", "numbers repeated", "granted before filed", "deep class without top class", "states known"}
    few = status(docs.drop("reg_date", "tech_l3_list").withColumns({"active_flag": F.lit(None).cast("boolean"), "cites_forward": F.lit(None).cast("double")}))
    assert {k for k, v in few.items() if v == "unknown"} == {"granted before filed", "deep class without top class", "states known", "citations known"}


def test_charts_agree_with_their_drill_downs(docs):
    cells = selfcheck.chart_cells(docs)
    got = selfcheck.reconcile(docs, cells, each=7).collect()
    assert len(got) == len(cells) > 25 and all(r["agrees"] and r["n"] == r["drilled"] > 0 for r in got)
    wrong = [cells[0]._replace(n=cells[0].n + 1), cells[1], cells[2]._replace(drill={"tech": "nothing"})]
    assert [r["agrees"] for r in sorted(selfcheck.reconcile(docs, wrong).collect(), key=lambda r: r["label"])] == [wrong[i] is cells[i] for i in sorted(range(3), key=lambda i: wrong[i].label)]
    # A chart that counts some documents twice is found out.
    doubled = selfcheck.chart_cells(docs.unionByName(docs.where("doc_id < 3")))
    assert {r["agrees"] for r in selfcheck.reconcile(docs, doubled).collect()} == {True, False}
    assert selfcheck.reconcile(docs, []).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 250, 999, 1000, 5000])
def test_sample_by_hash(spark, n):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")))
    h = lambda i: int(hashlib.md5(f"42:{i}:{i if i % 7 else ''}".encode()).hexdigest()[:15], 16)
    want = sorted(sorted(range(1000), key=h)[:n])
    for k in (1, 9):
        assert sorted(r["id"] for r in sampling.seeded_sample(df.repartition(k), n, ["id", "s"]).collect()) == want


def test_sample_of_repeated_rows(spark):
    df = spark.createDataFrame([(i % 5,) for i in range(50)], "k int")
    got = sampling.seeded_sample(df, 15, ["k"]).groupBy("k").count().collect()
    assert len(got) == 2 and {r["count"] for r in got} == {10}
    assert sampling.seeded_sample(df.limit(0), 5, ["k"]).collect() == []


def test_both_ends(spark):
    df = spark.createDataFrame([(f"c{i}", float(i // 2)) for i in range(9)] + [("none", None)], "c string, v double")
    got = sampling.ends(df, "v", 6, "c").collect()
    assert sorted(r["c"] for r in got) == [f"c{i}" for i in range(9)] and sum(r["end"] == "top" for r in got) == 6
    assert sorted(r["c"] for r in sampling.ends(df, "v", 2, "c").where("end = 'bottom'").collect()) == ["c0", "c1"]
