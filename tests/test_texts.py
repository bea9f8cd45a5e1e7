"""Terms, keywords, texts, densities and ranks on small cases by hand and by plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import terms as T
from foliospark.operators import density, ranking
from foliospark.operators import keywords as W


def words(text):
    """The stems of a text by the definition, letter by letter."""
    for w in re.findall(T.WORD, text):
        w = w.lower()
        long = next((p for p in T.PARTICLES if w.endswith(p) and len(w) - len(p) >= 2), None)
        if long:
            w = w[: -len(long)]
        elif len(w) >= 3 and w[-1] in T.SHORT_PARTICLES:
            w = w[:-1]
        if len(w) >= 2 and w not in T.STOP_WORDS:
            yield w


def test_terms(spark):
    texts = ["기판을 기판이 기판의 기판에서의 기판들을", "증가 온도 도로", "하이브리드 본딩, 재배선 소재 및 몰딩으로써", "The Bonding method and Hybrid-Bonding x", "가에서의 나에서", "로로 이이이", "bonding bonding bonding", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", T.clean_tokens(F.col("t")).alias("w"), T.document_terms(F.col("t")).alias("d")).collect():
        said = r["t"] or ""
        assert r["w"] == [*words(said)]
        want = []
        for part in re.split(T.BREAK, said):
            w = [*words(part)]
            want += w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a != b]
        assert sorted(r["d"]) == sorted(set(want))


def test_keywords_pass_over_what_is_chosen(spark):
    """A phrase, then no word of it, then a phrase with one new word; a cluster whose words are everywhere falls back on the most frequent."""
    a = ["alpha beta", "alpha", "beta", "beta gamma", "gamma", "delta"]
    rows = [("a", a)] * 10 + [("b", ["common", "other"])] * 3 + [("b", ["common"])] + [("c", ["common", "rest"])] * 30
    df = spark.createDataFrame(rows, "cluster string, terms array<string>")
    got = {}
    for r in W.cluster_keywords(df, top=3).collect():
        got.setdefault(r["cluster"], []).append((r["place"], r["term"], r["score"] is None))
    assert sorted(got["a"]) == [(1, "beta gamma", False), (2, "alpha beta", False), (3, "delta", False)]
    assert sorted(got["b"]) == [(1, "other", False)] and sorted(got["c"]) == [(1, "rest", False)]
    alone = spark.createDataFrame([("x", ["p", "q"]), ("x", ["q"])], "cluster string, terms array<string>")
    assert sorted((r["place"], r["term"], r["score"]) for r in W.cluster_keywords(alone).collect()) == [(1, "q", None), (2, "p", None)]


def test_stability(spark):
    rows = [(2000 + i % 10, ["t"], ["same", f"early{i}" if i % 10 < 5 else f"late{i}"]) for i in range(10)] + [(2000, ["u"], ["x"]), (None, ["t"], ["y"])]
    got = {r["tech"]: r for r in W.keyword_stability(spark.createDataFrame(rows, "base_year int, tech_list array<string>, words array<string>")).collect()}
    assert got["t"]["early"] == 6 and got["t"]["late"] == 6 and got["t"]["stability"] == round(1 / 11, 3)
    assert got["u"]["late"] == 0 and got["u"]["stability"] is None


@pytest.mark.parametrize(
    "columns, source",
    [(("ai_summary", "feature_summary", "abstract", "title"), "summary and features"), (("ai_summary", "abstract", "title"), "summary"), (("abstract", "title", "indep_claim"), "title and abstract"), (("abstract",), "title and abstract"), (("indep_claim", "title"), "claim"), (("title",), "title"), ((), None)],
)
def test_corpus_text_takes_the_best_source(spark, columns, source):
    rows = [{"doc_id": i} | {c: f"{c}  of\tdocument {i} at some length" for c in columns} for i in range(30)] + [{"doc_id": 99} | {c: None for c in columns}]
    df = spark.createDataFrame(rows, "doc_id long" + "".join(f", {c} string" for c in columns))
    got = {r["doc_id"]: r for r in W.corpus_text(df).collect()}
    assert {r["source"] for r in got.values()} == ({source} if source else set())
    if source:
        assert len(got) == 30 and "  " not in got[3]["text"] and "\t" not in got[3]["text"]
        assert got[3]["text"].startswith({"summary and features": "ai_summary of", "summary": "ai_summary of", "claim": "indep_claim of", "title": "title of"}.get(source, "title of document 3 at some length. abstract" if "title" in columns else "abstract of"))
    assert W.corpus_text(df.limit(5)).count() == 0


def test_density_sums_to_one(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    df = spark.createDataFrame([(x.tolist(),) for x in p] + [(None,), ([math.nan, 1.0],), ([1.0],)], "point array<double>")
    got = density.kernel_density(df, cells=40).collect()
    cov = np.cov(p.T) * len(p) ** (-1 / 3)
    for r in got[::97]:
        d = np.array([r["x"], r["y"]]) - p
        want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)).sum() / (len(p) * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
        assert r["density"] == pytest.approx(want, rel=1e-9)
    area = (np.ptp(p[:, 0]) / 39) * (np.ptp(p[:, 1]) / 39)
    assert len(got) == 1600 and 0.8 < sum(r["density"] for r in got) * area <= 1.01
    assert density.kernel_density(df.limit(1)).collect() == [] and density.kernel_density(spark.createDataFrame([([1.0, 2.0],)] * 5, "point array<double>")).collect() == []


def test_ranks_without_one_task(spark):
    rng = np.random.default_rng(5)
    values = [int(x) for x in rng.integers(0, 30, 500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(7)
    got = {r["i"]: r["rank"] for r in ranking.ranked(df, [F.desc("v"), F.asc("i")]).collect()}
    order = sorted(range(500), key=lambda i: (-values[i], i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    for method, of in (("min", lambda v: sum(x < v for x in values) + 1), ("max", lambda v: sum(x <= v for x in values)), ("average", lambda v: (sum(x < v for x in values) + 1 + sum(x <= v for x in values)) / 2)):
        assert all(r["rank"] == of(r["v"]) for r in ranking.with_ties(df, [F.asc("v")], ["v"], method=method).collect())
    some = df.withColumn("v", F.when(F.col("i") % 50 > 0, F.col("v")))
    known = [v for i, v in enumerate(values) if i % 50]
    for r in ranking.percentile_ranks(some, "v").collect():
        assert (r["percentile"] is None) == (r["v"] is None)
        assert r["v"] is None or r["percentile"] == pytest.approx(100 * sum(x <= r["v"] for x in known) / len(known))
    assert ranking.ranked(df.limit(0), [F.asc("v")]).collect() == []
    plan = ranking.ranked(df, [F.asc("v")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
