"""How often the analyses read the document frame."""

import pathlib

import pytest

from foliospark.operators import core
from foliospark.plans import stored
from foliospark.plans.stored import document_frame


def scans_of(df, path):
    """File scans of the physical plan that read ``path``."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(path in x.relation().location().rootPaths().mkString() for x in found if x.nodeName().strip().startswith("Scan parquet"))


@pytest.mark.parametrize(("analysis", "most"), [("opportunity", 14), ("lifecycle", 6), ("emerging_combinations", 8)])
def test_scans_of_the_frame(spark, monkeypatch, analysis, most):
    """Counted over what is written on the way and the result: inputs of a normalisation are read three times, so they are written once."""
    docs = document_frame(spark, "/root/testdata/sf0.001")
    path, scans = docs.inputFiles()[0].rsplit("/", 2)[1], []
    write = core.stored

    def counted(df):
        scans.append(scans_of(df, path))
        return write(df)

    monkeypatch.setattr(core, "stored", counted)
    result = getattr(core, analysis)(docs)
    scans.append(scans_of(result, path))
    assert 0 < sum(scans) <= most, scans


def test_written_tables_are_made_anew_and_released(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t"))

    assert [stored.once(spark, str(tmp_path), "x", make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t"))
    table = stored.once(spark, str(tmp_path), "x", make)
    assert table.count() == 8 and len(made) == 2
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert pathlib.Path(folder).exists()
    assert stored.release(spark) >= 2 and not pathlib.Path(folder).exists() and stored.release(spark) == 0
