"""Importance resampling against plain Python, chunks of any size, and odd documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import encode, importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, items, percent=5, least=20):
    """doc_id, n_features, weight, score, rank of rows (doc_id, text)."""
    found = [(i, *features(t)) for i, t in docs]
    raw, target = Counter(x for _, _, f in found for x in f), Counter(x for t in items for x in features(t)[1])
    s, t = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]

    def noise(i):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    rows = [(i, len(f), w := sum(gain[x] for x in f), w + noise(i), n) for i, n, f in found]
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def sort(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = queries.QUERIES["op12_importance_resampling"](spark, d)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = brute(docs, items)
    assert any(r[4] for r in want) and sort(got.collect()) == sort(want)


@pytest.mark.parametrize("chunk", [encode.CHUNK, 50])
def test_features_of_chunks_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(encode, "CHUNK", chunk)
    texts = ["One two ONE two one", None, "", "x", "a-b a.b", "é É ñ9z", "\t\n", "w " * 300, "one two three four " * 20]
    got = [[] for _ in texts]
    for first, rows, words, buckets in importance.features(pa.array(texts, pa.string())):
        for r, b in zip(rows.tolist(), buckets.tolist(), strict=True):
            got[first + r].append(b)
        for i, n in enumerate(words.tolist()):
            assert n == features(texts[first + i])[0]
    assert [sorted(x) for x in got] == [sorted(features(t)[1]) for t in texts]


def test_odd_documents(spark, odd, none):
    """Nulls, long texts, ties of repeated rows, and columns named like the new ones."""
    items = ["alpha beta gamma delta", None, "", "long text of many words"]
    target = spark.createDataFrame([(x,) for x in items], "text string")
    docs = odd.withColumn("Rank", F.lit("x")).withColumn("weight", F.lit("y")).withColumn("_text_", F.lit(3))
    w = importance.weighed(docs, target)
    assert w.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept_text", "component_id", "Rank", "_text_", "n_words", "n_features", "weight", "score"]
    got = importance.drawn(w.select("doc_id", "n_words", "n_features", "weight", "score", "Rank"), percent=50, least_words=1)
    assert sort(got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == sort(brute([(r["doc_id"], r["text"]) for r in odd.collect()], items, 50, 1))
    kept = importance.resample(docs, target, percent=50, least_words=1)
    ranks = {r["doc_id"] for r in got.where("rank is not null").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ranks and set(docs.columns) - {"weight"} <= set(kept.columns)
    assert importance.drawn(importance.weighed(none, target, keep=["doc_id"])).collect() == []
    assert importance.drawn(importance.weighed(odd, target.limit(0), keep=["doc_id"])).count() == odd.count()
    assert importance.resample(none, target).collect() == []
