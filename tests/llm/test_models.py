"""Held-out accuracy of the trained models, and the language model against a plain reading of its definition."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from foliospark.llm import class_lm, language_id, quality


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " "]


def held(doc_id, modulus, out):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == out


def check_base(docs):
    rows = docs.collect()
    c = Counter(t for r in rows if not held(r.doc_id, 7, 2) for t in toks(r.text))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = toks(r.text)
        want.append((r.doc_id is None, r.doc_id or 0, held(r.doc_id, 7, 2), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 4)))
    out = class_lm.query(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == sorted(want)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in out)
    return out


def test_language_model(documents, odd):
    out = check_base(documents)
    check_base(odd)
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def learnt(df, **kw):
    """The whole lexicon, by word."""
    lex = class_lm.lexicon(df, **kw)
    return lex, {r.word: (r.c, r["class"]) for r in lex.table.collect()}


def test_what_tasks_hold_changes_nothing(documents, odd):
    for docs, core in ((documents, 4096), (documents, 200), (odd, 20)):
        few, many = (sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in class_lm.score_documents(docs, core=core, head=h).collect()) for h in (0, 10**6))
        assert few == many
    assert [x[1:] for x in few] and few == sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in class_lm.score_documents(docs, core=core, head=7).collect())


def test_score_is_brute_force(documents):
    """Classes from the lexicon; transitions, emissions and their sum in plain Python."""
    rows = documents.select("doc_id", "text").collect()
    train = [toks(r.text) for r in rows if not held(r.doc_id, 7, 2)]
    lex, words = learnt(documents.where(documents.doc_id.isin([r.doc_id for r in rows if not held(r.doc_id, 7, 2)])), core=300)
    counts = Counter(t for d in train for t in d)
    assert {w: c for w, (c, _) in words.items()} == counts
    k = max(c for _, c in words.values()) + 1
    total, types, once = Counter(), Counter(), Counter()
    for c, x in words.values():
        total[x] += c
        types[x] += 1
        once[x] += c == 1
    unseen = min(range(k), key=lambda x: (-once[x], x))
    one, two = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.95, max(0.05, one / (one + 2 * two)))
    cls = lambda w: words[w][1] if w in words else unseen
    table = Counter((cls(a), cls(b)) for t in train for a, b in zip([" ", *t], t))
    out_of, kinds = Counter(), Counter()
    for (a, _), n in table.items():
        out_of[a] += n
        kinds[a] += 1
    n = sum(counts.values())

    def logp(a, w):
        x, y = cls(a), cls(w)
        most = max(kinds[x], 1)
        step = (table[x, y] + most * (total[y] + 1) / (n + k)) / (out_of[x] + most)
        c = counts[w]
        mine = (c - d * (y == unseen) if c else d * types[unseen]) / total[y]
        return math.log10(step) + math.log10(mine)

    want = {r.doc_id: sum(logp(a, b) for a, b in zip([" ", *toks(r.text)], toks(r.text))) for r in rows}
    for r in class_lm.score_documents(documents, core=300).collect():
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-6), r.doc_id
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
    # What can follow a word sums up to one: all known words, and the unseen ones together.
    assert math.isclose(sum(10 ** logp("the", w) for w in counts) + 10 ** logp("the", "never seen"), 1, rel_tol=1e-6)


def test_rare_words_join_the_class_of_the_largest_gain(documents):
    texts = [toks(r.text)[:-1] for r in documents.collect()]
    lex, words = learnt(documents, core=150)
    n = lex.n
    core = {w for w, (c, _) in words.items() if c * 150 >= n or w == " "}
    k = len(lex.tokens)
    table = np.zeros((k, k))
    seen = {}
    for t in texts:
        row = [" ", *t, " "]
        for a, b in zip(row, row[1:]):
            if a in core and b in core:
                table[words[a][1], words[b][1]] += 1
        for a, w, b in zip(row, row[1:], row[2:]):
            if w not in core:
                seen.setdefault(w, []).append((words[a][1] if a in core else k, words[b][1] if b in core else k))
    before, after = class_lm.votes(table)
    likely = 1e-6 * np.log1p(table.sum(axis=1))
    for w, pairs in seen.items():
        gain = sum(before[a] + after[b] for a, b in pairs) + likely
        assert gain[words[w][1]] >= gain.max() - 1e-6, w
    assert len(core) <= 151 and len(seen) + len(core) == len(words)


def test_exchange_finds_classes():
    rnd = np.random.default_rng(0)
    truth = np.arange(30) % 3  # class c is followed by class c + 1
    pairs = Counter()
    for _ in range(20000):
        a = rnd.integers(30)
        b = rnd.choice(np.flatnonzero(truth == (truth[a] + 1) % 3))
        pairs[(a, b)] += 1
    bigrams = np.array([(a, b, n) for (a, b), n in pairs.items()])
    got = class_lm.exchange(bigrams, np.bincount(bigrams[:, 0], weights=bigrams[:, 2], minlength=30), 3)
    assert all(len(set(got[truth == c].tolist())) == 1 for c in range(3)) and len(set(got.tolist())) == 3


def test_exchange_ends_where_no_move_helps():
    rnd = np.random.default_rng(3)
    for size, k in ((12, 3), (25, 5)):
        pairs = Counter(zip(rnd.zipf(1.5, 4000) % size, rnd.zipf(1.4, 4000) % size))
        bigrams = np.array([(a, b, n) for (a, b), n in pairs.items()])
        got = class_lm.exchange(bigrams, np.bincount(bigrams[:, 0], weights=bigrams[:, 2], minlength=size), k)

        def likelihood(classes):
            t = np.zeros((k, k))
            np.add.at(t, (classes[bigrams[:, 0]], classes[bigrams[:, 1]]), bigrams[:, 2])
            f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
            return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

        best = likelihood(got)
        for w in range(size):
            for c in range(k):
                assert likelihood(np.where(np.arange(size) == w, c, got)) <= best + 1e-4 * abs(best)


def test_nothing_to_learn_from(spark, none):
    assert class_lm.query(none).count() == language_id.query(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0
    only = spark.createDataFrame([(i, "word", "en") for i in range(40) if held(i, 7, 2) and held(i, 3, 1)][:1], "doc_id long, text string, lang string")
    r = class_lm.query(only).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.perplexity) == (2, 0, 0, 0.0, 0.0, None)
    assert language_id.query(only).first().lang_pred == "und"
    assert quality.classify(only, labels).first().score == 0.5


def test_language_id(spark, documents, odd):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    out = language_id.query(documents).collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.98 * len(test)
    assert len(language_id.query(odd).collect()) == odd.count()
    by = {r.doc_id: r for r in language_id.query(odd).collect() if r.doc_id is not None}
    assert {i for i, r in by.items() if r.lang_pred == "und"} == {3, 4, 8}


def more_documents(spark, documents, odd):
    more = odd.select(documents.columns).union(spark.createDataFrame([(50, "zqxv " + "langeswort" * 9, "de", "s", 95), (51, "qq", "de", "s", 2)], odd.select(documents.columns).schema))
    return documents.unionByName(more)


def test_language_id_is_the_same_by_cache_and_by_join(spark, documents, odd):
    from pyspark.sql import functions as F

    from foliospark.llm.common import in_training

    docs = more_documents(spark, documents, odd).select("doc_id", "text", "lang").withColumn("lang_pred", F.lit(1))
    train = docs.where(in_training(F.col("doc_id"), 3, 1))
    assert language_id.train_model(train, 10**7).model.all_words
    found = []
    for words in (10**7, 300, 0):
        trained = language_id.train_model(train, words)
        out = language_id.predict(docs, trained)
        assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
        found.append(sorted((str(r.doc_id), r.text or "", str(r.lang), r.lang_pred, round(r.score, 4)) for r in out.collect()))
        kept = language_id.keep_known(docs, trained)
        assert kept.columns == docs.columns and kept.count() == sum(x[3] != "und" for x in found[-1])
    assert found[0] == found[1] == found[2]


def test_language_id_is_brute_force(spark, documents, odd):
    """Words by log frequency; unseen ones from the left by the longest n-gram that any training word has."""
    import regex

    rows = more_documents(spark, documents, odd).collect()
    low = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    words, grams = {}, [{} for _ in range(4)]
    langs = sorted({r.lang for r in rows if r.lang is not None and not held(r.doc_id, 3, 1)})
    for r in rows:
        if r.lang is not None and not held(r.doc_id, 3, 1):
            for w in low(r.text):
                words.setdefault(w, Counter())[r.lang] += 1
    for w, c in words.items():
        t = f"^{w}$"
        for n in range(1, 5):
            for i in range(len(t) - n + 1):
                grams[n - 1].setdefault(t[i : i + n], Counter()).update(c)
    total = Counter()
    for c in words.values():
        total.update(c)
    sums = [Counter() for _ in range(4)]
    for n in range(4):
        for c in grams[n].values():
            sums[n].update(c)
    log = lambda c, all_, keys: np.array([math.log((c[x] + 0.5) / (all_[x] + 0.5 * (keys + 1))) for x in langs])

    def of(w):
        if w in words:
            return log(words[w], total, len(words))
        t, at, out = f"^{w}$", 0, np.zeros(len(langs))
        while at < len(t):
            n = next((n for n in (4, 3, 2, 1) if t[at : at + n] in grams[n - 1] and at + n <= len(t)), 0)
            out += log(grams[max(n, 1) - 1].get(t[at : at + max(n, 1)], Counter()), sums[max(n, 1) - 1], len(grams[max(n, 1) - 1]))
            at += max(n, 1)
        return out

    want = []
    for r in rows:
        ws = low(r.text)
        x = sum((of(w) for w in ws), np.zeros(len(langs)))
        p = 1 / np.exp(x - x.max()).sum()
        want.append((str(r.doc_id), "und" if not ws else langs[int(x.argmax())], round(p if ws else 0.0, 3)))
    from pyspark.sql import functions as F

    from foliospark.llm.common import in_training

    docs = more_documents(spark, documents, odd)
    shipped = {"words": language_id.MODEL_WORDS, "grams": language_id.MODEL_GRAMS}
    for caches in (shipped, {"words": 100}, {"grams": 50}, {"words": 100, "grams": 50}):  # results don't depend on what tasks hold
        trained = language_id.train_model(docs.where(in_training(F.col("doc_id"), 3, 1)), **caches)
        assert trained.model.all_words == ("words" not in caches or caches is shipped) and trained.model.all_grams == ("grams" not in caches or caches is shipped)
        got = [(str(r.doc_id), r.lang_pred, round(r.score, 3)) for r in language_id.languages(docs, trained, ["doc_id"]).collect()]
        assert sorted(got) == sorted(want)


def test_quality(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    assert {r.doc_id for r in quality.classify(docs, labels).collect()} == {r.doc_id for r in docs.collect()}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, some).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def quality_rows(spark, x, positive):
    schema = "p boolean, x array<float>"
    return spark.createDataFrame([(bool(p), [float(v) for v in row]) for p, row in zip(positive, x)], schema)


def test_prior_and_risk_are_what_they_say(spark):
    """Two classes of known shares: the prior is found, and the weights are a minimum of the risk in plain NumPy."""
    rnd = np.random.default_rng(7)
    n, share = 6000, 0.6
    good = rnd.random(n) < share
    x = np.zeros((n, quality.N_FEATURES), np.float32)
    x[:, :3] = rnd.normal(size=(n, 3)) + np.where(good, 2.0, -2.0)[:, None]
    positive = good & (rnd.random(n) < 0.3)
    fit = quality._Fit(quality_rows(spark, x, positive), ridge=1.0)
    assert abs(fit.prior() - share) < 0.05
    w = fit.minimise(share)
    z = fit.design(x.astype(np.float64))
    g = z @ w
    assert ((g > 0) == good).mean() > 0.98

    def risk(w):
        g, ridge = z @ w, fit.ridge * (w[:-1] ** 2).sum() / 2
        return share * np.logaddexp(0, -g[positive]).mean() + max(0, np.logaddexp(0, g).mean() - share * np.logaddexp(0, g[positive]).mean()) + ridge

    best = risk(w)
    assert np.logaddexp(0, g).mean() - share * np.logaddexp(0, g[positive]).mean() >= -1e-9
    for i in (0, 1, 2, len(w) - 1):
        for e in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += e
            gm = z @ moved
            if np.logaddexp(0, gm).mean() - share * np.logaddexp(0, gm[positive]).mean() >= 0:
                assert risk(moved) >= best - 1e-5


def test_scores_are_the_formula(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = quality.train(docs, labels)
    for r in quality.score(docs, m, ["doc_id"]).join(docs, "doc_id").collect():
        z = np.clip((quality.features(r.text) - m.centre) / m.scale, -6, 6) @ m.weights + m.bias
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6)
