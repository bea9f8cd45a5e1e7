"""Line dedup, decontamination, URL filters and the pipeline against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex

import corpus_pipeline
from foliospark.llm import decontaminate, line_dedup, tokens, url_filter

from .test_simhash import brute_fingerprint


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_lines(rows, min_chars=40, min_docs=5):
    """(doc_id, lines, kept lines) of each row (doc_id, text)."""
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and d is not None:
                docs[key(line)].add(d)
    keep_in = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    return [(d, lines := (t or "").split("\n"), [x for x in lines if key(x) not in keep_in or d == keep_in[key(x)]]) for d, t in rows]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def brute_hits(rows, items, n=13):
    windows = defaultdict(set)
    for i, t in items:
        w = brute_words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = brute_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                ids = windows.get(tuple(w[k : k + size]))
                if ids is not None:
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def order(rows):
    return sorted(rows, key=repr)


COMMON = "A line that is long enough to count for something, really"


def shared(spark):
    rows = [(i, f"own {i}\n  {COMMON.upper() if i % 2 else COMMON}\t\nlast\n{COMMON}") for i in range(7)] + [(3, "other\n" + COMMON), (None, COMMON), (8, "\n".join(["short"] * 9))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_line_dedup(spark, documents, odd, none):
    for docs in (documents, odd, none, shared(spark)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = [(d, len(a), len(a) - len(k), sha("\n".join(k))) for d, a, k in brute_lines(rows)]
        assert order(tuple(r) for r in line_dedup.query(docs).collect()) == order(want)
    full = line_dedup.line_dedup(odd)
    assert full.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id", "kept_text", "n_lines", "n_dropped"] and full.count() == odd.count()


def test_clashing_columns_stay(spark, odd):
    from pyspark.sql import functions as F

    names = ["_h", "_hash", "_id", "_lines", "_drop", "_words", "_hits", "_key", "drop", "hits", "n_words", "text_hash", "window", "copies"]
    docs = odd.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    rows = lambda d: sorted(repr([r[c] for c in ["doc_id", "text", *names]]) for r in d.collect())
    assert rows(line_dedup.line_dedup(docs)) == rows(docs)
    kept = decontaminate.decontaminate(docs, bench(spark))
    ids = {r.doc_id for r in kept.collect()}
    assert rows(kept) == rows(docs.where(F.col("doc_id").isNull() | F.col("doc_id").isin([i for i in ids if i is not None])))
    spans = decontaminate.decontaminate(docs, bench(spark), mode="spans")
    assert spans.columns == docs.columns and sorted(str(r._words) for r in spans.collect()) == sorted(str(r._words) for r in docs.collect())


def bench(spark):
    items = [(1, "Alpha beta; GAMMA delta"), (2, "one"), (3, ""), (4, None), (None, "zeta eta"), (5, "long text of many words and lines long text of many words and lines"), (6, "one")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontaminate(spark, documents, odd, none):
    real = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for docs, b in ((documents, real), (odd, bench(spark)), (none, real), (odd, real.limit(0))):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = [(d, n, h, len(i), sha(",".join(i)), h > 0 and 20 * h >= n) for d, n, h, i in brute_hits(rows, [(r.item_id, r.text) for r in b.collect()])]
        assert order(tuple(r) for r in decontaminate.query(docs, b).collect()) == order(want)
    # The join of a benchmark too large to broadcast gives the same.
    a, b = (order((r.doc_id, r.n_hit, r.n_words) for r in decontaminate.contamination(odd, bench(spark), limit=x).collect()) for x in (0, 1 << 30))
    assert a == b


def test_spans_and_documents(spark, odd):
    docs = spark.createDataFrame([(1, "Keep this. Alpha, beta gamma DELTA; and this"), (2, "clean text"), (3, None)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench(spark), mode="spans").collect()}
    assert cut == {1: "Keep this. and this", 2: "clean text", 3: None}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench(spark)).collect()} == {2, 3}
    assert decontaminate.decontaminate(odd, bench(spark)).columns == odd.columns


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = low(host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter(spark):
    urls = ["https://a.com/en/x", "http://B.Example.COM/en/77?q#f", "http://example.com/en/6", "x://net/de/", "http://xexample.net/de/8", "http://www.example.net/de/88", "no scheme", None, "", "http://", "a://org/es", "http://com:80/en/", "http://é.org/es/ü", "http://a.com/en/x"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("verdict", url_filter.F.lit(1))
    rules = url_filter.CONTRACT_RULES + [("example.com", "/en/", "block"), ("www.example.net", "/", "allow"), ("net", "/de/8", "allow")]
    df = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    want = order((i, *brute_url(u, rules)) for i, u in [*enumerate(urls), (0, urls[0])])
    for block in (1 << 20, 30):
        got = url_filter.url_filter(pages, df, block_bytes=block).select("page_id", "host", "path", "rule", "verdict")
        assert order(tuple(r) for r in got.collect()) == want
    assert url_filter.url_filter(pages.limit(0), df).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, df.limit(0), "block").collect()} == {"block"}


def test_pipeline_is_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id % 2 = 0")
    extra = [(10_000, None, "en", "x", None), (10_001, "12 34", "en", "x", 5), (10_002, "", None, None, 0), (None, "two words without an id", "en", "x", 9), (None, "quite another text that has no id", "en", "x", 9), *[(10_010 + i, f"{COMMON}\nown words number {i} here", "en", "x", 80) for i in range(6)], (10_020, "own words number 1 here", "en", "x", 23)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{source}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    rows = [r for r in rows if regex.search(r"\p{L}", r[1] or "")]
    rows = [(d, "\n".join(k)) for d, _, k in brute_lines(rows)]
    names = {f"none {i}" if d is None else d: (d, t) for i, (d, t) in enumerate(rows)}
    rows = [(n, t) for n, (_, t) in names.items()]
    prints = {d: brute_fingerprint(t) for d, t in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints, key=lambda x: (isinstance(x, str), x))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)), key=lambda x: (isinstance(x, str), x))
                root[y] = x
    rows = [(names[d][0], t) for d, t in rows if find(d) == d]
    assert sum(d is None for d, _ in rows) == 2
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    bad = {(d, t) for (d, t), (_, n, h, _) in zip(rows, brute_hits(rows, items)) if h > 0 and 20 * h >= n}
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for d, t in rows:
        if (d, t) not in bad:
            e = tok.encode(t, add_special_tokens=False).ids + [0]
            for k, at in enumerate(range(0, len(e), 2048)):
                want[(d, k, at, len(e[at : at + 2048]), zlib.crc32(np.asarray(e[at : at + 2048], "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
