"""The partitioned sources: slices of vector files, and made-up filings that don't depend on their partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark import sources
from foliospark.plans import frame, mapping
from foliospark.sources import generated


@pytest.mark.parametrize("kind", ["npy", "npz", "compressed"])
def test_vectors_slice_by_slice(spark, tmp_path, kind):
    v = np.random.default_rng(1).normal(size=(2503, 3)).astype(np.float32)
    ids = np.array([f"KR{i}" for i in range(len(v))])
    path = str(tmp_path / ("v.npy" if kind == "npy" else "v.npz"))
    if kind == "npy":
        np.save(path, v)
    else:
        (np.savez if kind == "npz" else np.savez_compressed)(path, ids=ids, other=np.zeros(3, bool)[:0].reshape(0, 1, 1), vectors=v)
    df = sources.read_vectors(spark, path, rows=400)
    assert df.rdd.getNumPartitions() == (1 if kind == "compressed" else 7)
    got = sorted(df.collect())
    assert [r["position"] for r in got] == list(range(len(v))) and np.array_equal(np.array([r["vector"] for r in got], np.float32), v)
    assert [r["id"] for r in got] == ([None] * len(v) if kind == "npy" else ids.tolist())


def test_unfit_vector_files(spark, tmp_path):
    for name, a in (("flat", np.zeros(3)), ("empty", np.zeros((0, 3))), ("words", np.array([["a"]])), ("columns", np.asfortranarray(np.zeros((3, 2))))):
        np.save(tmp_path / f"{name}.npy", a)
        with pytest.raises(ValueError):
            sources.read_vectors(spark, str(tmp_path / f"{name}.npy"))
    np.savez(tmp_path / "ids.npz", ids=np.array(["a"]), vectors=np.zeros((2, 2)))
    with pytest.raises(ValueError):
        sources.read_vectors(spark, str(tmp_path / "ids.npz"))
    np.save(tmp_path / "nan.npy", np.array([[np.nan]]))
    with pytest.raises(Exception, match="finite"):
        sources.read_vectors(spark, str(tmp_path / "nan.npy")).collect()


def test_filings_do_not_depend_on_partitions(spark):
    a, b = (generated.filings(spark, rows=300, partitions=k) for k in (1, 7))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 300
    assert generated.filings(spark, rows=100).exceptAll(a).isEmpty()
    assert not generated.filings(spark, rows=300, seed=1).exceptAll(a).isEmpty()


def test_variants(spark):
    """What is odd in each of the twelve."""
    v = {k: generated.filings(spark, k) for k in generated.VARIANTS}
    assert len(v) == 12 and v["many rows"].count() == 50_000
    assert not set(generated.OPTIONAL) & set(v["optional columns missing"].columns)
    assert v["other separators"].where(F.col("다중 기술분류").contains("|")).count() > 100 and v["classes as json"].where(F.col("다중 기술분류").startswith("[")).count() == 600
    assert v["a class of one"].where("`기술 중분류` = 'lonely class'").count() == 1
    assert v["no recent years"].agg(F.max(F.left("출원일", F.lit(4)))).first()[0] == "2021"
    assert v["repeated families"].select("패밀리 ID").distinct().count() == 120
    assert 140 < v["states missing"].where("`법적상태` = ''").count() < 240
    assert "피인용 수" not in v["no citations"].columns and "임베딩 벡터" not in v["no vectors"].columns


@pytest.mark.parametrize("variant", ["spellings of names", "classes as json"])
def test_frame_over_filings(spark, variant):
    raw = generated.filings(spark, variant, rows=200)
    found = {k: x["column"] for k, x in mapping.suggest_mapping(raw.columns).items()}
    assert len(found) == len(raw.columns)
    d = frame.build_frame(raw, found).df
    rows = {r["doc_id"]: r for r in d.collect()}
    assert len(rows) == 200
    for r in raw.collect():
        got = rows[r["공개번호"]]
        assert got["base_year"] == int(r["출원일"][:4]) and str(got["reg_date"] or "") == r["등록일"] and got["is_granted"] == (r["등록 여부"] == "Y")
        assert {x.capitalize() for x in got["co_applicants"]} <= set(generated.COMPANIES) and len(got["embedding"]) == generated.DIMS
        assert got["tech_list"][0] == r["기술 중분류"] and got["cites_forward"] == float(r["피인용 수"]) and got["problem"] in ("휨 문제", "방열 문제", "박리 문제")


def test_rows_with_one_number_keep_their_names(spark):
    rows = [("KR1", "Zeta Corp"), ("KR1", "Alpha Inc"), ("KR2", "")]
    d = frame.build_frame(spark.createDataFrame(rows, "`공개번호` string, `출원인` string"), {"pub_number": "공개번호", "applicant": "출원인"}).df
    assert sorted((r["doc_id"], r["applicant"], r["co_applicants"]) for r in d.collect()) == [("KR1", "ALPHA", ["ALPHA"]), ("KR1", "ZETA", ["ZETA"]), ("KR2", "", [])]


def test_encoding_is_found_wherever_it_shows(spark, tmp_path):
    (tmp_path / "late.csv").write_bytes("\n".join(["name,n", *[f"plain {i},{i}" for i in range(3000)], "삼성,1"]).encode("cp949"))
    got = sources.read_csv(spark, str(tmp_path / "late.csv"))
    assert got.where("name = '삼성'").count() == 1 and got.count() == 3001
