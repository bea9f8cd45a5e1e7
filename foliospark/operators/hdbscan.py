"""HDBSCAN on Spark: a minimum spanning tree over mutual reachability, a condensed tree, and clusters by stability.

1. Points that are equal become one with a multiplicity; the core distance of a
   point is that to its ``samples``-th nearest other point, by the metric index.
2. Every pair of blocks that may hold tree edges gives the spanning tree of its
   own points; the tree of all points is among these edges. A pair may be left
   out if its blocks are connected by shorter edges all the way.
3. While there are more edges than one task takes, Borůvka rounds thin them to the
   spanning tree: each component keeps its least edge (a keyed minimum),
   components are joined, edges within one go.
4. Edges are merged in the order of their weights, a bounded range of weights at a
   time. Weights that are equal are merged at once, so that the result doesn't
   depend on which of several trees was found.
5. The condensed tree has at most 2 n / ``least`` nodes, which the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from . import metric
from .vectors import components

#: Edges that one task merges.
EDGES = 1_000_000
#: Neighbours that tell how near two cells are at most.
NEAR = 4
#: Weights below this share of the largest count as this share, so that points that are equal don't weigh infinitely.
LEAST_WEIGHT = 1e-9


def _core(a: metric.Block, best: list[np.ndarray], samples: int) -> pa.RecordBatch:
    """i, core, and d, j of the NEAR nearest: neighbours stand for as many points as are equal to them (as do those equal to the point itself)."""
    x, d, j, n = best
    rows = np.arange(len(a.ids))
    first, last = np.searchsorted(x, rows), np.searchsorted(x, rows, side="right")
    passed = np.concatenate([[0.0], np.cumsum(n)])
    # The neighbour with which ``samples`` others are reached, or the last there is.
    at = np.minimum(np.searchsorted(passed, passed[first] + samples - (a.extra[0] - 1)) - 1, last - 1)
    core = np.where((a.extra[0] - 1 >= samples) | (first == last), 0.0, np.concatenate([d, [0.0]])[np.maximum(at, 0)])
    kept = np.flatnonzero(np.arange(len(x)) - first[x] < NEAR) if len(x) else np.zeros(0, np.int64)
    ends = pa.array(np.append(0, np.searchsorted(x[kept], rows, side="right")).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(c[kept])) for c in (d, j)]
    return pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(core), *lists], ["i", "core", "d", "j"])


def _tree(v: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, weight): the spanning tree of points by mutual reachability (Prim)."""
    n = len(v)
    best, parent, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    a, w, at = np.zeros(n - 1, np.int64), np.zeros(n - 1), 0
    order = np.zeros(n - 1, np.int64)
    for step in range(n - 1):
        out[at] = False
        far = np.maximum(metric.distances(v[at : at + 1], v)[0], np.maximum(core, core[at]))
        nearer = out & (far < best)
        best[nearer], parent[nearer] = far[nearer], at
        at = int(np.where(out, best, np.inf).argmin())
        order[step], a[step], w[step] = at, parent[at], best[at]
    return a, order, w


def _edges(index: metric.Index, near: DataFrame) -> DataFrame:
    """w, a, b: edges that the spanning tree of all points is among."""
    cells = len(index.blocks)

    def tree(a: metric.Block, b: metric.Block | None) -> Iterator[dict]:
        ids, v, core = (a.ids, a.v, a.extra[0]) if b is None else (np.concatenate(x) for x in ((a.ids, b.ids), (a.v, b.v), (a.extra[0], b.extra[0])))
        if len(ids) > 1:
            x, y, w = _tree(v, core)
            # Of two blocks only what lies between them: the rest each has by itself.
            kept = np.ones(len(w), bool) if b is None else (x < len(a.ids)) != (y < len(a.ids))
            yield {"w": w[kept], "a": np.minimum(ids[x], ids[y])[kept], "b": np.maximum(ids[x], ids[y])[kept]}

    schema = "w double, a long, b long"
    alone = stored(index.pairs(np.eye(cells, dtype=bool), tree, schema))
    if cells == 1 and index.blocks[0] == 1:
        return alone
    home = index.rows.select("i", "cell")
    inner = np.zeros(cells)  # what holds a cell together
    for c, w in alone.join(home.withColumnRenamed("i", "a"), "a").groupBy("cell").agg(F.max("w")).collect():
        inner[c] = w
    core = np.zeros((cells, 2))
    for c, lo, hi in index.rows.groupBy("cell").agg(F.min("core"), F.max("core")).collect():
        core[c] = lo, hi
    known = np.maximum(index.within(), np.maximum(core[:, 1][:, None], core[:, 1][None, :]))
    between = near.join(home, "i").join(home.select(F.col("i").alias("j"), F.col("cell").alias("other")), "j").where("cell <> other").groupBy("cell", "other").agg(F.min("w"))
    for c, o, w in between.collect():
        known[c, o] = known[o, c] = min(known[c, o], w)
    # The weight below which two cells are connected at most: the largest step of the best path between them.
    path = np.maximum(known, np.maximum(inner[:, None], inner[None, :]))
    reached = _bottleneck(path)
    split = index.blocks > 1  # blocks of one cell aren't held together by their own trees
    floor = np.maximum(index.apart(), np.maximum(core[:, 0][:, None], core[:, 0][None, :]))
    wanted = (floor <= reached) | split[:, None] | split[None, :]
    return alone.unionByName(index.pairs(wanted & ~np.eye(cells, dtype=bool) | np.diag(split), tree, schema)).distinct()


def _bottleneck(path: np.ndarray) -> np.ndarray:
    """The least largest step between any two nodes of a complete graph."""
    n = len(path)
    out, member = np.zeros_like(path), [[i] for i in range(n)]
    home = np.arange(n)
    for e in np.argsort(path, axis=None):
        i, j = divmod(int(e), n)
        a, b = home[i], home[j]
        if a != b:
            x, y = member[a], member[b]
            out[np.ix_(x, y)] = path[i, j]
            out[np.ix_(y, x)] = path[i, j]
            member[a] = x + y
            home[y] = a
            if len(member[a]) == n:
                break
    return out


def _thinned(edges: DataFrame, most: int) -> DataFrame:
    """The spanning tree's edges among ``edges`` (a, b distinct), if there are more than ``most``: Borůvka rounds."""
    left, kept = stored(edges.select("w", "a", "b", F.col("a").alias("x"), F.col("b").alias("y"))), None
    if left.count() <= most:
        return edges
    while not left.isEmpty():
        ends = left.select(F.col("x").alias("c"), F.struct("w", "a", "b").alias("e")).unionByName(left.select(F.col("y").alias("c"), F.struct("w", "a", "b").alias("e")))
        least = stored(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        kept = least if kept is None else kept.unionByName(least)
        hooks = least.join(left, ["w", "a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
        label = stored(components(hooks))
        of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))  # noqa: E731, B023
        moved = left.join(of("x"), "x", "left").join(of("y"), "y", "left").select("w", "a", "b", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")).where("x <> y")
        # Of several edges between two components the least will do.
        left = stored(moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*", "x", "y"))
    return kept


def _merged(pdf: pd.DataFrame, least: int, first_node: int) -> pd.DataFrame:
    """Edges w, a, b between components of given sizes (sa, sb) and nodes (na, nb, -1: fewer than ``least`` points), merged by rising weight.

    kind 0: component ``a`` is in ``b`` now, which has ``size`` points and is ``node``;
    kind 1: the points of component ``a`` joined ``node`` at weight w;
    kind 2: ``node`` came to be at weight w; kind 3: node ``a`` went into ``node`` at weight w.
    """
    size: dict[int, int] = {}
    node: dict[int, int] = {}
    for c in ("a", "b"):
        size.update(zip(pdf[c].tolist(), pdf[f"s{c}"].tolist(), strict=True))
        node.update(zip(pdf[c].tolist(), pdf[f"n{c}"].tolist(), strict=True))
    root, parts, out, made = {x: x for x in size}, {x: [x] for x in size}, [], first_node

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x in sorted(size):
        if node[x] < 0 and size[x] >= least:  # as many equal points
            node[x] = made
            out += [(2, x, 0, 0, made, 0.0), (1, x, 0, 0, made, 0.0)]
            parts[x], made = [], made + 1
    pdf = pdf.sort_values(["w", "a", "b"])
    weights = pdf["w"].to_numpy()
    starts = np.flatnonzero(np.append(True, weights[1:] != weights[:-1])) if len(weights) else []
    a, b = pdf["a"].tolist(), pdf["b"].tolist()
    for s, e in zip(starts, [*starts[1:], len(weights)], strict=True):
        w, groups = float(weights[s]), {}
        for x, y in zip(a[s:e], b[s:e], strict=True):
            x, y = find(x), find(y)
            if x != y:
                gx, gy = groups.pop(x, [x]), groups.pop(y, [y])
                if size[x] < size[y]:
                    x, y = y, x
                root[y] = x
                size[x] += size[y]
                groups[x] = gx + gy
        for x, members in groups.items():
            large = sorted({node[m] for m in members if node[m] >= 0})
            small = [p for m in members if node[m] < 0 for p in parts[m]]
            if not large and size[x] < least:
                node[x], parts[x] = -1, small
                continue
            if len(large) == 1:
                own = large[0]
            else:
                own, made = made, made + 1
                out += [(2, x, 0, 0, own, w), *[(3, c, 0, 0, own, w) for c in large]]
            out += [(1, p, 0, 0, own, w) for p in small]
            node[x], parts[x] = own, []
    out += [(0, x, find(x), size[find(x)], node[find(x)], 0.0) for x in root]
    return pd.DataFrame(out, columns=["kind", "a", "b", "size", "node", "w"])


def _hierarchy(points: DataFrame, edges: DataFrame, least: int, most: int) -> tuple[DataFrame, list[tuple], list[tuple]]:
    """(i, n, e, node of each point), nodes (node, w) and their parents (child, node, w)."""
    labels = points.select("i", "n", F.col("i").alias("root"), F.lit(None).cast("double").alias("e"), F.lit(None).cast("int").alias("at"))
    state = points.select(F.col("i").alias("root"), F.col("n").alias("size"), F.lit(-1).alias("node"))
    total = edges.count()
    cuts = [] if total <= most else edges.agg(F.percentile_approx("w", [k / (total // most + 1) for k in range(1, total // most + 1)], 100_000).alias("c")).first()["c"]
    cuts = [-1.0, *sorted(set(cuts)), float("inf")]
    nodes: list[tuple] = []
    parents: list[tuple] = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = edges.where((F.col("w") > low) & (F.col("w") <= high))
        if len(cuts) > 2:
            root = labels.select("i", "root")
            part = part.join(root.select(F.col("i").alias("a"), F.col("root").alias("_a")), "a").join(root.select(F.col("i").alias("b"), F.col("root").alias("_b")), "b").select("w", F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
        side = lambda c: state.select(F.col("root").alias(c), F.col("size").alias(f"s{c}"), F.col("node").alias(f"n{c}"))  # noqa: E731, B023
        sized = part.join(side("a"), "a").join(side("b"), "b").select("w", "a", "b", "sa", "sb", "na", "nb")
        merge = partial(_merged, least=least, first_node=len(nodes))
        found = stored(sized.groupBy().applyInPandas(lambda pdf: merge(pdf), "kind int, a long, b long, size long, node int, w double"))  # noqa: B023
        nodes += [(r["node"], r["w"]) for r in found.where("kind = 2").collect()]
        parents += [(r["a"], r["node"], r["w"]) for r in found.where("kind = 3").collect()]
        joined = found.where("kind = 1").select(F.col("a").alias("root"), F.col("w").alias("_e"), F.col("node").alias("_at"))
        moved = found.where("kind = 0").select(F.col("a").alias("root"), F.col("b").alias("_root"))
        x = labels.join(joined, "root", "left").join(moved, "root", "left")
        labels = stored(x.select("i", "n", F.coalesce("_root", "root").alias("root"), F.coalesce("e", "_e").alias("e"), F.coalesce("at", "_at").alias("at")))
        now = found.where("kind = 0").select(F.col("b").alias("root"), "size", "node").distinct()
        state = stored(state.join(found.where("kind = 0").select(F.col("a").alias("root")), "root", "left_anti").unionByName(now)) if len(cuts) > 2 else now
    return labels, nodes, parents


def _selected(own: dict[int, tuple[int, float]], nodes: list[tuple], parents: list[tuple], floor: float) -> dict[int, int]:
    """The chosen node that each node is in. ``own``: points that joined a node, and their sum of 1 / weight."""
    lam = {k: 1 / max(w, floor) for k, w in nodes}
    up = {c: p for c, p, _ in parents}
    down: dict[int, list[int]] = {k: [] for k in lam}
    for c, p in up.items():
        down[p].append(c)
    count, stability, chosen = {}, {}, {}
    for k in sorted(lam):  # children are numbered before their parents
        n, s = own.get(k, (0, 0.0))
        inside = sum(count[c] for c in down[k])
        count[k] = n + inside
        born = lam[up[k]] if k in up else 0.0
        stability[k] = s - n * born + inside * (lam[k] - born)
        below = sum(stability[c] for c in down[k])
        chosen[k] = k in up and (not down[k] or below <= stability[k])
        if not chosen[k]:
            stability[k] = below
    out: dict[int, int] = {}
    for k in sorted(lam, reverse=True):
        top = out.get(up.get(k, -1), -1)
        out[k] = top if top >= 0 else (k if chosen[k] else -1)
    return out


def hdbscan(points: DataFrame, least: int | None = None, samples: int | None = None, id_: str = "vec_id", point: str = "point", block: int = 2048, edges: int = EDGES) -> DataFrame:
    """node, component (the smallest id of its cluster; -1: noise) of every point.

    ``least``: points of a cluster at least, by default a 60th of all and 5;
    ``samples``: which neighbour gives the core distance, by default ``least``.
    The whole is no cluster. Points of any dimension; null ones are left out.
    """
    d = points.select(F.col(id_).cast("long").alias("id"), F.col(point).cast("array<double>").alias("v")).where("id is not null and v is not null")
    same = stored(d.groupBy("v").agg(F.min("id").alias("i"), F.count("*").alias("n")))
    total = same.agg(F.sum("n")).first()[0] or 0
    least = max(2, max(5, total // 60) if least is None else least)
    samples = least if samples is None else samples
    index = metric.build(same, ["n"], block)
    if index is None:
        return d.select(F.col("id").alias("node"), F.lit(-1).cast("long").alias("component"))
    lists = stored(metric.nearest(index, samples, finish=partial(_core, samples=samples), schema="i long, core double, d array<double>, j array<long>"))
    rows = index.rows.join(lists.select("i", "core"), "i", "left").select("i", "v", "cell", F.coalesce("core", F.lit(0.0)).alias("core"))
    index = index._replace(rows=stored(rows), extra=["core"])
    pairs = lists.select("i", "core", F.explode(F.arrays_zip("d", "j")).alias("x")).select("i", F.col("x.j").alias("j"), F.greatest("core", "x.d").alias("w"))
    crossing = pairs.join(lists.select(F.col("i").alias("j"), F.col("core").alias("other")), "j").select("i", "j", F.greatest("w", "other").alias("w"))
    tree = stored(_thinned(_edges(index, crossing), edges))
    labels, nodes, parents = _hierarchy(same, tree, least, edges)
    floor = LEAST_WEIGHT * (tree.agg(F.max("w")).first()[0] or 1.0)
    own = {r["at"]: (r["n"], r["s"]) for r in labels.where("at is not null").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.greatest("e", F.lit(floor))).alias("s")).collect()}
    chosen = _selected(own, nodes, parents, floor)
    kind = d.sparkSession.createDataFrame([*chosen.items()], "at int, cluster int")
    of = same.select("v", "i").join(labels.select("i", "at"), "i").join(F.broadcast(kind), "at", "left").select("v", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    rows = stored(d.join(of, "v").select("id", "cluster"))
    named = rows.where("cluster >= 0").groupBy("cluster").agg(F.min("id").alias("component"))
    return rows.join(F.broadcast(named), "cluster", "left").select(F.col("id").alias("node"), F.coalesce("component", F.lit(-1)).alias("component"))
