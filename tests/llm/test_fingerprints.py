import hashlib
import math
import re

import xxhash

from foliospark.llm import fingerprints


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    terms = [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] or ([" ".join(w)] if w else [])
    out = 0
    for s in range(2):
        for b in range(64):
            votes = 0
            for t in terms:
                seed = 42 if s == 0 else xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=42)
                votes += len(t) * (1 if xxhash.xxh64_intdigest(t.encode(), seed=seed) >> b & 1 else -1)
            out |= (votes > 0) << (64 * s + b)
    return out


def brute(rows):
    texts = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), (lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64_intdigest((r.text or "").encode(), seed=42))))
    out = []
    like = lambda a, b: max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 128))
    for i, r in enumerate(texts):
        t, after = r.text or "", texts[(i + 1) % len(texts)].text or ""
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        a, b, c = brute_print(t), brute_print(e), brute_print(after)
        text = lambda f: f"{f & (2**64 - 1):016x}{f >> 64:016x}"
        out.append((r.doc_id is None, r.doc_id or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_query_is_brute_force(odd, none, documents):
    few = documents.where("doc_id < 30")
    for docs in (odd, few):
        assert got(fingerprints.query(docs)) == brute(docs.collect())
    assert fingerprints.query(none).count() == 0


def test_small_ranges_give_the_same(documents, odd):
    for docs in (documents.select("doc_id", "text"), odd.select("doc_id", "text")):
        a, b = (sorted(map(str, fingerprints.with_next(docs, n).collect())) for n in (3, 10**6))
        assert a == b


def test_edited_texts_are_nearer_than_others(documents):
    rows = fingerprints.query(documents).where("n_chars > 300").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.99 * len(rows)


def test_least_id_and_ids_without_a_value(spark, none):
    rows = [(-(2**63), "the least id"), (2**63 - 1, "the largest id of all"), (0, ""), *[(None, f"text number {i} of those without an id") for i in range(9)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(fingerprints.query(docs)) == brute(docs.collect())
    a, b = (sorted(map(str, fingerprints.with_next(docs, n).collect())) for n in (1, 10**6))
    assert a == b


def test_heads_that_are_not_broadcast_give_the_same(documents, odd, monkeypatch):
    want = [sorted(map(str, fingerprints.query(d).collect())) for d in (documents, odd)]
    monkeypatch.setattr(fingerprints.small, "__defaults__", (None, 0))
    assert [sorted(map(str, fingerprints.query(d).collect())) for d in (documents, odd)] == want


def test_near_counts_are_brute_force(documents, odd):
    for docs in (documents, odd):
        rows = fingerprints.query(docs).collect()
        values = {int(r.fingerprint, 16) for r in rows}
        for r in rows:
            f = int(r.fingerprint, 16)
            assert r.n_near == sum(0 < (f ^ x).bit_count() <= fingerprints.RADIUS for x in values)


def test_lookups_are_the_same_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more {i % 3}") for i in range(60)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, fingerprints.query(docs).collect()))
    held = rows()
    monkeypatch.setattr(fingerprints, "LOOKUP_BYTES", 0)
    assert rows() == held


def test_block_tables_are_not_broadcast(spark):
    """entries were taken for as small as the fingerprints they are exploded from, and broadcast through the driver."""
    df = spark.createDataFrame([(i * 7919, i // 2) for i in range(50)], "fp0 long, fp1 long")
    pairs = fingerprints.near_fingerprints(df)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
