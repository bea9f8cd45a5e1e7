import random
import re

import xxhash

from foliospark.llm import simhash


def brute_fingerprint(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    terms = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in terms]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_fingerprint(r.text) for r in rows]
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[find(p)] = min(least.get(find(p), r.doc_id), r.doc_id)
    return sorted((r.doc_id is None, r.doc_id or 0, f"{p:016x}", -1 if least.get(find(p)) is None else least[find(p)]) for r, p in zip(rows, prints))


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_query_is_brute_force(spark, documents, odd, none):
    for docs in (documents, odd):
        assert got(simhash.query_near_dedup(docs)) == brute_components(docs.collect())
    assert simhash.query_near_dedup(none).count() == 0


def roots(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_near_links_connect_what_near_pairs_connect(spark):
    rnd = random.Random(1)
    fps = {0, -1 % 2**64}
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps |= {x, *(x ^ (1 << rnd.randrange(64)) for _ in range(4)), *(x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(6)), x ^ 1 ^ 2 ^ 4, x ^ 7 << 20 ^ 1 << 63}
    x = rnd.getrandbits(64)  # a dense group: a whole ball
    fps |= {x ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(0, 64, 7)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    links = [(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links) and len(links) < len(near)
    assert roots(signed, links) == roots(signed, near)


def test_candidates_of_segment_tables(spark):
    """The tables give every near pair, verification rejects others, and values that are indexed further give the same."""
    rnd = random.Random(4)
    low = rnd.getrandbits(32)
    fps = {(rnd.getrandbits(32) << 32) | low for _ in range(40)} | {(low << 32) | rnd.getrandbits(32) for _ in range(40)}
    for x in [*fps][:50]:
        fps |= {x ^ (1 << rnd.randrange(64)), x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)), x ^ 7 << rnd.randrange(60)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    seen = {}
    for hot in (1, 20, 10_000):
        found = simhash.candidates(df, hot).collect()
        assert {(r.a, r.b) for r in found if r.distance <= 2} == near and all(r.distance == ((r.a ^ r.b) & (2**64 - 1)).bit_count() for r in found)
        seen[hot] = sum(r.distance > 2 for r in found)
        links = [(r.a, r.b) for r in simhash.near_links(df, hot).collect()]
        assert set(links) <= near and len(links) == len(set(links)) and roots(signed, links) == roots(signed, near)
    assert 0 < seen[1] < seen[10_000] and seen[20] < seen[10_000]


def brute_kept(rows):
    """(doc_id, text) of the row that stays of each component."""
    prints = [brute_fingerprint(r.text) for r in rows]
    root = roots(sorted(set(prints)), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 2])
    best = {}
    for r, p in zip(rows, prints):
        h = xxhash.xxh64_intdigest(r.text.encode(), seed=42) if r.text is not None else 42
        key = (r.doc_id is None, r.doc_id or 0, h - (1 << 64) * (h >> 63))
        best[root[p]] = min(best.get(root[p], (key, r.doc_id, r.text)), (key, r.doc_id, r.text), key=lambda x: x[0])
    return sorted(map(repr, (x[1:] for x in best.values())))


def test_near_dedup_keeps_one_of_each(spark, documents, odd, none):
    from pyspark.sql import functions as F

    clashing = odd.withColumns({c: F.lit(5) for c in ("_key", "_hash", "_c", "root", "fp", "copies")})
    for docs in (documents, odd, clashing):
        kept = simhash.near_dedup(docs)
        assert kept.columns == docs.columns
        assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == brute_kept(docs.collect())
    assert sum(r.doc_id is None for r in simhash.near_dedup(odd).collect()) == 2
    assert simhash.near_dedup(none).count() == 0


def test_block_tables_find_all(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(128) for _ in range(30)]
    fps = {*base, *(x ^ sum(1 << b for b in rnd.sample(range(128), k)) for x in base for k in (1, 2, 3, 3, 4, 5))}
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    rows = {(sign(f & (2**64 - 1)), sign(f >> 64)): f for f in fps}
    want = sorted((a ^ b).bit_count() for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame(list(rows), "fp0 long, fp1 long")
    found = simhash.block_table_pairs(df, ["fp0", "fp1"], radius=3).collect()
    assert sorted(r.distance for r in found) == want
    assert len({(r.a, r.b) for r in found}) == len(found)


def test_components_of_a_long_path(spark):
    from foliospark.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100}
