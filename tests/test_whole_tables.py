"""Registered queries that once read an id subset, against their SQL with that subset's filter taken out."""

import re

import duckdb
import pytest

from foliospark import catalogue

#: Part of each query's SQL, and what stands for it where the operator's own threshold isn't in the SQL.
QUERIES = {"growth_ladder": (), "new_combinations": (), "upset_gaps": (), "transition_applicant": (), "threats": (), "new_agents_share": ()}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def whole_sql(name):
    text = catalogue.ORACLE_SQL[name]
    text = re.sub(r"WHERE (doc_id|l_orderkey) % \d+ = 0 AND ", "WHERE ", text)
    text = re.sub(r" (AND|WHERE) (doc_id|l_orderkey) % \d+ = 0", "", text)
    assert " % " not in text
    return text.replace(*QUERIES[name]) if QUERIES[name] else text


@pytest.fixture(scope="session")
def few_orders(tmp_path_factory):
    """A twelfth of the orders of the smallest tables: rare pairs, newcomers and gaps, which the given tables are too dense for."""
    out = tmp_path_factory.mktemp("few")
    for t in TABLES:
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'{f' WHERE {key} % 12 = 1' if key else ''}) TO '{out}/{t}.parquet' (FORMAT parquet)")
    return str(out)


def rows(found):
    return sorted([tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in found], key=str)


def check(spark, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = con.sql(whole_sql(name)).select(*[f'"{c}"' for c in got.columns]).fetchall()
    got = rows(map(tuple, got.collect()))
    assert got == rows(want)
    return got


@pytest.mark.parametrize("name", QUERIES)
def test_all_documents_are_read(spark, few_orders, name):
    """Each agrees on all three sets of tables, and has rows on one of them at least: families are too few for threats on the smaller ones."""
    assert [check(spark, name, d) for d in ("/root/testdata/sf0.001", few_orders, "/root/testdata/sf0.01")] != [[], [], []]
