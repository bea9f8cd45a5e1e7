import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import repeats


def brute(rows, length=200):
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for doc, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc is None, doc or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def mixed(seed=1):
    """Passages that repeat in several documents between and beside others, runs of one letter, and repeats inside a document."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rnd.randint(20, 200)) for _ in range(6)]
    docs = [" ".join(rnd.choice([prose(rnd.randint(1, 60)), rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 80) :]]) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    return docs + ["x" * 450, "y" * 199 + "z", "ab" * 300, "q" * 200, passages[0], passages[0], prose(30)]


def test_query_is_brute_force(spark, odd, none):
    for docs in (odd, spark.createDataFrame(list(enumerate(mixed())), "doc_id long, text string"), none):
        assert got(repeats.query(docs)) == brute(docs.collect())


def test_large_groups_give_the_same(spark):
    docs = spark.createDataFrame(list(enumerate(mixed(2))), "doc_id long, text string")
    want = sorted(map(str, repeats.repeated_spans(docs).collect()))
    assert sorted(map(str, repeats.repeated_spans(docs, block=1500).collect())) == want
    assert sorted(map(str, repeats.repeated_spans(docs, block=0).collect())) == want


def test_shuffled_joins_give_the_same(spark, odd, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(mixed(3))), "doc_id long, text string")
    monkeypatch.setattr(repeats.within, "__defaults__", (None, 0))
    assert got(repeats.query(docs)) == brute(docs.collect())
    assert got(repeats.query(odd)) == brute(odd.collect())


@pytest.mark.parametrize("length", [2, 3, 10, 40])
def test_interval_expansion(length):
    rnd = random.Random(length)
    for _ in range(20):
        parts = [bytes(rnd.choices(b"ab", k=rnd.randint(0, 30))) + bytes(rnd.choices(b"abc", k=rnd.randint(0, 60))) for _ in range(5)] + [b"a" * 50]
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        found = repeats.repeated_windows(parts, length)
        assert [f.tolist() for f in found] == [[seen[p[i : i + length]] > 1 for i in range(max(0, len(p) - length + 1))] for p in parts]


def test_stretches_cover_all_windows():
    rnd = np.random.default_rng(5)
    for _ in range(10):
        sizes = rnd.integers(0, 900, 6)
        data = rnd.integers(97, 100, sizes.sum()).astype(np.uint8)
        doc, first, last, *_ = repeats.stretches(data, np.cumsum(sizes), 200, 40)
        want = [w for e, s in zip(np.cumsum(sizes), sizes) for w in range(e - s, e - 199)]
        assert [w for a, b in zip(first, last) for w in range(a, b)] == want
