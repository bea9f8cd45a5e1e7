"""Archives are read back by another reader, the index is held against a scan, and odd pages come out as they went in."""

import gzip
import hashlib
import pathlib
import urllib.parse
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import queries, warc

LONG = "<p>same</p>" * 20
ODD = [
    (5, "http://A.example.com/x?y#z", LONG), (3, "https://b.example.com/ä ö\n?q", LONG), (9, None, LONG), (3, "https://b.example.com/other", LONG),
    (1, "http://a.example.com/x?y", None), (2, "", ""), (4, "no scheme", "short"), (6, "http://a.example.com/x?y", "short"),
    (None, "http://c.org", LONG), (None, "http://c.org", "<b>no id</b>" * 30), (None, "http://d.org", "<b>no id</b>" * 30),
    (7, "http://e.org:8080", "é漢" * 200_000), (7, "http://e.org:8080", "é漢" * 200_000), (8, "http://f.org/" + "p" * 50_000, "x" * 99), (10, "http://f.org/", "x" * 99), (11, "http://g.org", "x" * 100), (12, "http://g.org", "x" * 100),
]
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", digest string, payload int").repartition(5)


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html] = min(first.get(html, page), page)
    for page, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and html in first and first[html] != page
        yield page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None


def members(path):
    """Every record of an archive from front to end, with the offset and length of its member."""
    data, at = pathlib.Path(path).read_bytes(), 0
    while at < len(data):
        z = zlib.decompressobj(31)
        record = z.decompress(data[at:])
        n = len(data) - at - len(z.unused_data)
        yield at, n, record
        at += n


@pytest.mark.parametrize("archive_bytes, block_lines", [(warc.ARCHIVE_BYTES, warc.BLOCK_LINES), (600, 2)])
def test_round_trip(spark, pages, tmp_path, archive_bytes, block_lines):
    a = warc.write_warc(pages, str(tmp_path / "w"), archive_bytes=archive_bytes, block_lines=block_lines)
    assert a.captures == len(ODD)
    got = a.records(a.lookup(pages.select("url"))).collect()
    key = lambda r: tuple(map(str, r))
    as_text = lambda x: None if x is None else str(x)
    assert sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(((as_text(p), n, d, k, as_text(f)) for p, n, d, k, f in expected(ODD)), key=key)
    assert all(r.intact for r in got)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert {r.url for r in got} == {None if u is None else urllib.parse.quote(u, safe=warc._PRINTED) for _, u, _ in ODD}
    # Another reader: whole archives, each gzip member by member; revisits refer to records that exist.
    records = [r for p in (tmp_path / "w").glob("*.warc.gz") for _, _, x in members(p) for r in [warc.parse_record(x)]]
    assert sum(r.kind != "warcinfo" for r in records) == len(ODD)
    ids = {r.fields["warc-record-id"] for r in records if r.kind == "response"}
    assert all(r.fields["warc-refers-to"] in ids for r in records if r.kind == "revisit")


def test_index_against_a_scan(spark, tmp_path):
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/{'hot' if i % 2 else i}", f"{i}" * 50) for i in range(400)]
    a = warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), block_lines=7)
    lines = [x for p in (tmp_path / "w").glob("*.cdx.gz") for x in gzip.open(p, "rt").read().splitlines()]
    assert len(lines) == 400 and len(list((tmp_path / "w").glob("*.idx"))) == len(a.parts)
    for p in (tmp_path / "w").glob("*.cdx.gz"):
        kept = gzip.open(p, "rt").read().splitlines()
        assert kept == sorted(kept, key=lambda x: x.split()[0])
    for wanted in (["http://a.example.com/hot"], ["https://B.example.com/10", "http://c.example.com/hot#f"], ["http://none.org/"], [None, ""], []):
        got = a.lookup(spark.createDataFrame([(u,) for u in wanted], "url string"))
        keys = {warc.capture_key(u) for u in wanted}
        assert sorted(r.page for r in got.collect()) == sorted(x.split()[1] for x in lines if x.split()[0] in keys)


def test_empty_table_and_text_ids(spark, tmp_path):
    a = warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert a == (str(tmp_path / "e"), [], 0)
    assert a.records(a.lookup(spark.createDataFrame([("http://a.org",)], "url string"))).collect() == []
    ids = ["", "%", "a b\n", None, "é"]
    b = warc.write_warc(spark.createDataFrame([(x, "http://a.org", f"{x}" * 9) for x in ids], "page_id string, url string, html string"), str(tmp_path / "t"))
    c = b.lookup(spark.createDataFrame([("http://a.org/",)], "url string"))
    assert {r.page for r in c.collect()} == {r.page for r in b.records(c).collect()} == set(ids)


def test_damage_is_told(spark, tmp_path):
    good = warc.page_record("1", "http://a.org", b"x" * 200, hashlib.sha256(b"y" * 200).hexdigest(), None, None)
    with pytest.raises(ValueError):
        warc.parse_record(good[:-1])
    a = warc.write_warc(spark.createDataFrame([(1, "http://a.org", "x" * 200)], SCHEMA), str(tmp_path / "w"))
    path = next((tmp_path / "w").glob("*.warc.gz"))
    (offset, n, _) = [*members(path)][1]
    bad = warc._member(good)
    path.write_bytes(path.read_bytes()[:offset] + bad)
    c = a.lookup(spark.createDataFrame([("http://a.org",)], "url string")).withColumn("length", F.lit(len(bad)).cast("long"))
    assert [r.intact for r in a.records(c).collect()] == [False]


def test_query_agrees_with_its_sql(spark):
    d = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_warc"](spark, d)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(warc.SQL).select(*got.columns).fetchall(), key=str)
