"""The driver's contract, and that the two parts don't lean on each other."""

import pathlib

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns[:3] == ["a", "b", "n_ab"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_part():
    for p in (ROOT / "foliospark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
