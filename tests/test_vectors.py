"""Vector queries against plain NumPy."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from foliospark import catalogue
from foliospark.operators import ngrams as N
from foliospark.operators import vectors as V


def nearest_mean(vectors, k):
    v = np.array(vectors, float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    s = (v / np.where(n > 1e-12, n, np.inf)) @ (v / np.where(n > 1e-12, n, np.inf)).T
    np.fill_diagonal(s, 0.0)
    k = min(k, len(v) - 1)
    return np.sort(s, axis=1)[:, -k:].mean(axis=1) if k else np.zeros(len(v))


def test_overlap_density_is_of_the_twenty_nearest_of_all(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    got = {r.node: r.density for r in catalogue.QUERIES["overlap_density"](spark, "/root/testdata/sf0.01").collect()}
    want = dict(zip([r.vec_id for r in rows], nearest_mean([r.embedding for r in rows], 20), strict=True))
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_overlap_density_over_blocks_and_odd_vectors(spark):
    v = np.random.default_rng(0).normal(size=(60, 4)).tolist() + [[0.0] * 4]
    df = spark.createDataFrame([*enumerate(v), (99, None)], "vec_id long, embedding array<double>")
    for k in (3, 20, 100):
        got = {r.node: r.density for r in V.overlap_density(df, k, block=16).collect()}
        assert got.pop(99) is None
        assert np.allclose([got[i] for i in range(61)], nearest_mean(v, k)) and len(got) == 61
    assert [r.density for r in V.overlap_density(df.where("vec_id = 1")).collect()] == [0.0]


def plain_dbscan(points, eps, least):
    """(cluster's smallest core point or -1) of each point; a border point takes the smallest."""
    d = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)) <= eps
    core = np.flatnonzero(d.sum(axis=1) >= least)
    own = {i: i for i in core}
    for _ in core:
        own = {i: min(own[j] for j in core if d[i, j]) for i in core}
    return [own.get(i, min((own[j] for j in core if d[i, j]), default=-1)) for i in range(len(points))]


def test_dense_clusters_have_border_points_and_noise(spark):
    rnd = np.random.default_rng(3)
    p = np.vstack([rnd.normal(0, 0.5, (60, 2)), rnd.normal(6, 0.5, (40, 2)), rnd.uniform(-4, 10, (30, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "vec_id long, point array<double>")
    for least in (2, 6):
        got = {r.node: r.component for r in V.dense_clusters(df, least=least).collect()}
        want = plain_dbscan(p, 0.05 * (p.max() - p.min()), least)
        assert [got[i] for i in range(len(p))] == want and -1 in want and len(set(want)) > 2
    assert V.dense_clusters(df.where("false")).collect() == []


def test_silhouette_over_all_pairs(spark):
    rnd = np.random.default_rng(1)
    v, label = rnd.normal(size=(40, 3)), [*(i % 3 for i in range(39)), 9]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    far, want = 1 - u @ u.T, {}
    for i, c in enumerate(label):
        means = {o: np.mean([far[i, j] for j in range(40) if j != i and label[j] == o] or [0.0]) for o in {*label}}
        a, b = means.pop(c), min(means.values())
        want.setdefault(c, []).append((b - a) / max(a, b) if c != 9 else 0.0)
    rows = [(x.tolist(), c) for x, c in zip(v, label, strict=True)]
    df = spark.createDataFrame([*rows, ([0.0] * 3, 1), (None, 2), ([1.0] * 3, None)], "embedding array<double>, label int")
    got = {r.label: r.silhouette for r in V.silhouette(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - np.mean(want[c])) < 1e-9 for c in want)
    assert [r.silhouette for r in V.silhouette(df.where("label = 1")).collect()] == [None]


def modularity(edges, group):
    total = 2 * sum(w for _, _, w in edges)
    inside = sum(2 * w for a, b, w in edges if group[a] == group[b])
    mass = Counter()
    for a, b, w in edges:
        mass[group[a]] += w
        mass[group[b]] += w
    return inside / total - sum((m / total) ** 2 for m in mass.values())


def all_groupings(nodes):
    if not nodes:
        yield {}
        return
    for rest in all_groupings(nodes[1:]):
        for g in range(max(rest.values(), default=-1) + 2):
            yield {**rest, nodes[0]: g}


def test_communities_are_nearly_the_best_of_all(spark):
    rnd = random.Random(5)
    graphs = [[("a", "b", 3), ("b", "c", 3), ("a", "c", 3), ("d", "e", 3), ("e", "f", 3), ("d", "f", 3), ("c", "d", 1)]]
    graphs += [[(a, b, rnd.randint(1, 5)) for a, b in itertools.combinations("abcdefg", 2) if rnd.random() < 0.4] for _ in range(2)]
    for edges in graphs:
        df = spark.createDataFrame(edges, "a string, b string, n_ab long")
        got = {r.node: r.community for r in V.communities(df).collect()}
        nodes = sorted({x for a, b, _ in edges for x in (a, b)})
        assert sorted(got) == nodes
        best = max(modularity(edges, g) for g in all_groupings(nodes))
        assert modularity(edges, got) >= 0.9 * best - 1e-9
    df = spark.createDataFrame(graphs[0], "a string, b string, n_ab long")
    assert {r.node: r.community for r in V.communities(df).collect()} == dict.fromkeys("abc", 0) | dict.fromkeys("def", 1)


def test_bridges_are_the_nodes_that_hold_random_graphs_together(spark):
    rnd = random.Random(7)
    edges = [(c * 20 + a, c * 20 + b) for c in range(6) for a, b in itertools.combinations(range(12), 2) if rnd.random() < 0.16]

    def parts(keep):
        near, left, n = {x: set() for x in keep}, set(keep), 0
        for a, b in edges:
            if a in near and b in near:
                near[a].add(b)
                near[b].add(a)
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                new = near[todo.pop()] & left
                left -= new
                todo += new
        return n

    nodes = {x for e in edges for x in e}
    want = {x for x in nodes if parts(nodes - {x}) > parts(nodes)}
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, similarity double")
    assert {r.node for r in V.bridges(pairs, V.components(pairs)).collect()} == want and want


def test_char_ngrams_and_their_singular_directions(spark):
    texts = ["a Battery cell", "battery  pack", None, "", "motor cell cell", "zz battery motor", "pack of cells"]
    df = spark.createDataFrame([*enumerate(texts)], "id int, t string")
    counts = {}
    for i, t in enumerate(texts):
        words = [f" {w} " for w in (t or "").lower().split()]
        counts[i] = Counter(w[j : j + k] for w in words for k in (2, 3, 4) for j in range(len(w) - k + 1))
    in_texts, all_ = Counter(g for c in counts.values() for g in c), sum(counts.values(), Counter())
    kept = sorted((g for g, n in in_texts.items() if n >= 2), key=lambda g: (-all_[g], g))[:15]
    x = np.array([[c[g] * (math.log(8 / (in_texts[g] + 1)) + 1) for g in kept] for c in counts.values()])
    x /= np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
    weights = V.char_tfidf(df, "id", "t", features=15)
    got = {(r.id, r.gram): r.weight for r in weights.collect()}
    want = {(i, g): x[i, j] for i in range(7) for j, g in enumerate(kept) if x[i, j]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    points = {r.id: r.point for r in V.reduced(weights, 3).collect()}
    ids = sorted(points)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    best = (u[:, :3] * s[:3])[ids]
    p = np.array([points[i] for i in ids])
    assert ids == sorted({i for i, _ in want}) and np.allclose(p @ p.T, best @ best.T, atol=1e-6)


def test_phrases_group_by_average_linkage(spark):
    rnd = np.random.default_rng(2)
    v = np.vstack([rnd.normal(size=(25, 4)), [[0.0] * 4]])
    u = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    groups = [[i] for i in range(len(v))]
    while True:
        d, i, j = min((np.mean([1 - u[x] @ u[y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d >= 0.45:
            break
        groups[i] += groups.pop(j)
    got = V.phrase_groups([str(i) for i in range(len(v))], v)
    assert {frozenset(g) for g in groups} == {frozenset(int(p) for p, x in got.items() if x == g) for g in {*got.values()}}
    assert V.phrase_groups([], np.zeros((0, 1))) == {} and 1 < len(groups) < 26


def test_semantic_matrix_joins_like_phrases(spark):
    rows = [("heat loss", "metal plate")] * 3 + [("heat losses", "metal plates"), ("noise", "foam"), (None, "foam"), ("noise", " ")]
    df = spark.createDataFrame(rows, "problem string, solution string")
    got = {(r.problem, r.solution): r.n for r in V.semantic_matrix(df).collect()}
    assert got == {("heat loss", "metal plate"): 4, ("noise", "foam"): 1}
    assert V.semantic_matrix(df.where("false")).collect() == []


def test_classification_quality_suggests(spark):
    rows = [(["A", "B"], 0.9)] * 4 + [(["C"], 0.4)] * 2 + [(["C"], 0.9)] * 2 + [(["D"], None)] * 3 + [(["E"], 0.1)]
    d = spark.createDataFrame(rows, "tech_list array<string>, class_confidence double")
    assert {r.tech: r.suggestion for r in V.classification_quality(d).collect()} == {"A": "split", "B": "split", "C": "review", "D": "keep", "E": "merge"}


def test_texts_are_dealt_once_for_their_ngrams(spark):
    """words and n-grams were shuffled by id and n-gram, several times a text's size, for each of three uses."""
    d = spark.createDataFrame([(1, "ab ab cd"), (2, "ab ce"), (2, "cd"), (3, None), (None, "ab cd")], "id int, t string")
    weights = V.char_tfidf(d, "id", "t")
    weights.collect()
    plan = weights._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(id#" in plan and not [x for x in plan.splitlines() if "hashpartitioning(id#" in x and "gram#" in x]
    squares = {}
    for r in weights.collect():
        squares[r["id"]] = squares.get(r["id"], 0) + r["weight"] ** 2
    assert set(squares) == {None, 1, 2} and all(abs(x - 1) < 1e-9 for x in squares.values())


def test_words_are_counted_before_ngrams_and_ids_stay_apart(spark):
    """every n-gram of every text was a row that Spark grouped, before most of them were left out."""
    rows = [(1, "aa ab\u00a0x \U0001f600b aaaa"), (None, "AB zz aaaa\x1caa\x0baa"), (2, ""), (None, "zz zz"), (3, None), (1, "q aa"), (4, "zz"), (5, "qqqq qqqq")]
    d = spark.createDataFrame(rows, "id long, t string")
    counts = {}
    for i, t in rows:
        words = [f" {w} " for w in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if w]
        counts.setdefault(i, Counter()).update(w[j : j + k] for w in words for k in (2, 3, 4) for j in range(len(w) - k + 1))
    in_ids, all_ = Counter(g for c in counts.values() for g in c), sum(counts.values(), Counter())
    for least in (1, 2, 3):
        kept = sorted((g for g, n in in_ids.items() if n >= least), key=lambda g: (-all_[g], g))[:9]
        want = {(i, g): c[g] * (math.log((len(rows) + 1) / (in_ids[g] + 1)) + 1) for i, c in counts.items() for g in kept if c[g]}
        length = Counter()
        for (i, _), w in want.items():
            length[i] += w * w
        weights = V.char_tfidf(d, "id", "t", features=9, least=least)
        got = {(r.id, r.gram): r.weight for r in weights.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k] / math.sqrt(length[k[0]])) < 1e-12 for k in want)
    plan = V.char_tfidf(d.where("id > 1"), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_directions_of_text_need_few_passes(spark):
    """each Lanczos step read the rows again, hundreds of times."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 300)) * 0.97 ** np.arange(300)
    passes = []
    found = N.directions(lambda q: passes.append(1) or x.T @ (x @ q), 300, 20, block=30)
    _, _, v = np.linalg.svd(x)
    assert np.allclose(np.abs(np.sum(found * v[:20].T, axis=0)), 1, atol=1e-9) and len(passes) <= 10
    assert N.directions(lambda q: np.zeros_like(q), 5, 3).shape == (5, 0)
    d = spark.createDataFrame([(i, " ".join("".join(rnd.choice(list("abc"), 3)) for _ in range(6))) for i in range(40)], "id int, t string")
    a, b = ({r.id: r.point for r in df.collect()} for df in (V.text_points(d, "id", "t", 5), V.reduced(V.char_tfidf(d, "id", "t"), 5)))
    ids = sorted(a)
    p, q = (np.array([z[i] for i in ids]) for z in (a, b))
    assert ids == sorted(b) and p.shape == (40, 5) and np.allclose(p @ p.T, q @ q.T, atol=1e-9)
