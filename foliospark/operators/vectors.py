"""Analyses of embedding vectors, clusters and graphs. Similarity joins and neighbour lists go through the metric index (``metric``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..plans.stored import stored
from . import metric, ngrams


def _unit(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """i, v: the vectors that aren't null or zero, with length 1."""
    v = F.col(vector).cast("array<double>")
    x = df.select(F.col(id_).cast("long").alias("i"), v.alias("v"), F.sqrt(M.dot(v, v)).alias("l")).where("l > 1e-12")
    return x.select("i", F.transform("v", lambda c: F.try_divide(c, F.col("l"))).alias("v"))


def similarity_pairs(df: DataFrame, threshold: float, id_: str = "vec_id", vector: str = "embedding", block: int = metric.BLOCK) -> DataFrame:
    """a, b, similarity of all pairs a < b with a cosine of ``threshold`` or more.

    Cells of the metric index that are further apart than the threshold allows
    don't meet. Zero and null vectors have no pairs.
    """
    schema = "a long, b long, similarity double"
    index = metric.build(stored(_unit(df, id_, vector)), block=block)
    if index is None:
        return df.sparkSession.createDataFrame([], schema)

    def compare(a: metric.Block, b: metric.Block | None) -> Iterator[dict]:
        other = a if b is None else b
        for t in range(0, len(a.ids), metric.TILE):
            s = a.v[t : t + metric.TILE] @ other.v.T
            x, y = np.nonzero(s >= threshold)
            ia, ib = a.ids[t + x], other.ids[y]
            keep = ia < ib if b is None else ia != ib
            yield {"a": np.minimum(ia, ib)[keep], "b": np.maximum(ia, ib)[keep], "similarity": s[x, y][keep]}

    return index.pairs(index.apart() <= np.sqrt(max(0.0, 2 - 2 * threshold)) + metric.SLACK, compare, schema)


def followers(df: DataFrame, pairs: DataFrame, top: int = 12, least_cross: int = 2) -> DataFrame:
    """doc, followers, cross_followers, companies, avg_similarity, score: later documents that are near, of other companies.

    ``df``: vec_id, year, company. Keeps documents with ``least_cross`` cross followers.
    """
    d = df.select(F.col("vec_id").alias("i"), "year", "company")
    j = pairs.join(d.select(F.col("i").alias("a"), F.col("year").alias("ya"), F.col("company").alias("ca")), "a").join(d.select(F.col("i").alias("b"), F.col("year").alias("yb"), F.col("company").alias("cb")), "b")
    one = j.where("yb > ya").select(F.col("a").alias("doc"), F.col("cb").alias("company"), (F.col("ca") != F.col("cb")).alias("cross"), "similarity")
    two = j.where("ya > yb").select(F.col("b").alias("doc"), F.col("ca").alias("company"), (F.col("ca") != F.col("cb")).alias("cross"), "similarity")
    x = one.unionByName(two).groupBy("doc").agg(
        F.count("*").alias("followers"), F.sum(F.col("cross").cast("long")).alias("cross_followers"), F.count_distinct(F.when(F.col("cross"), F.col("company"))).alias("companies"), (F.sum(F.round("similarity", 9)) / F.count("*")).alias("avg_similarity"), F.round(F.sum(F.when(F.col("cross"), F.round("similarity", 9)).otherwise(0.0)), 6).alias("score")
    )
    return x.where(F.col("cross_followers") >= least_cross).orderBy(F.desc("score"), "doc").limit(top)


def components(pairs: DataFrame) -> DataFrame:
    """node, component (the smallest node connected), by spreading minimum labels and jumping along them until none changes.

    Each round is written as a table in the folder that all machines share (``plans.stored``).
    """
    both = stored(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct())
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("c"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        roots = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = stored(step.join(roots, "component", "left").select("node", "old", F.least("component", F.coalesce("root", F.col("component"))).alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels


def communities(edges: DataFrame, weight: str = "n_ab") -> DataFrame:
    """node, community (0, 1, ... by smallest member) of a network's edges a, b: modularity raised by moving nodes, then groups, one at a time.

    For the capped edge list of a network (``network_max_edges``), which one task
    holds as a matrix; nodes move in order of their names, so a result is repeatable.
    """

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        at = {n: i for i, n in enumerate(names)}
        links = np.zeros((len(names), len(names)))
        np.add.at(links, (pdf["a"].map(at), pdf["b"].map(at)), pdf["w"].astype(float))
        links += links.T
        label = np.arange(len(names))
        while True:
            home = _moved(links)
            kept, home = np.unique(home, return_inverse=True)
            label = home[label]
            if len(kept) == len(links):
                break
            member = np.eye(len(kept))[home]
            links = member.T @ links @ member
        order = {g: k for k, g in enumerate(dict.fromkeys(label.tolist()))}
        return pd.DataFrame({"node": names, "community": [order[g] for g in label.tolist()]})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.where("a <> b").select("a", "b", F.col(weight).alias("w")).groupBy().applyInPandas(grouped, f"node {kind}, community int")


def _moved(links: np.ndarray) -> np.ndarray:
    """The group of each node once no move of a single node raises the modularity of a weighted graph."""
    n, degree = len(links), links.sum(axis=1)
    home, mass, total, moving = np.arange(n), degree.copy(), degree.sum(), True
    while moving:
        moving = False
        for i in range(n):
            old, near = home[i], links[i].copy()
            near[i] = 0
            mass[old] -= degree[i]
            gain = np.bincount(home, weights=near, minlength=n) - degree[i] * mass / total
            best = int(np.argmax(gain))
            if gain[best] > gain[old] + 1e-9:
                home[i], moving = best, True
            mass[home[i]] += degree[i]
    return home


def bridges(pairs: DataFrame, labels: DataFrame, most_edges: int = 400) -> DataFrame:
    """component, node: articulation points of each component of the ``most_edges`` strongest edges (Tarjan, per component)."""
    top = pairs.orderBy(F.desc("similarity"), "a", "b").limit(most_edges)
    edges = top.join(labels.withColumnRenamed("node", "a"), "a").select("component", "a", "b")

    def cut_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen, low, found = {}, {}, set()
        for root in sorted(near):
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack, branches = [(root, None, iter(sorted(near[root])))], 0
            while stack:
                node, parent, it = stack[-1]
                for nxt in it:
                    if nxt == parent:
                        continue
                    if nxt in seen:
                        low[node] = min(low[node], seen[nxt])
                        continue
                    seen[nxt] = low[nxt] = len(seen)
                    branches += node == root
                    stack.append((nxt, node, iter(sorted(near[nxt]))))
                    break
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[node])
                        if parent != root and low[node] >= seen[parent]:
                            found.add(parent)
            if branches > 1:
                found.add(root)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]] * len(found), "node": sorted(found)})

    return edges.groupBy("component").applyInPandas(cut_nodes, "component long, node long")


def class_cohesion(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, cohesion: the mean cosine of a class's vectors to their centroid. Sums by dimension, so a large class is no large group."""
    norm = F.sqrt(M.dot(F.col(vector), F.col(vector)))
    x = df.withColumn("_n", norm).where("_n > 1e-12").select(F.col(label).alias("label"), F.posexplode(vector).alias("d", "x"), "_n")
    s = x.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("c"), F.avg(F.col("x") / F.col("_n")).alias("u"), F.count("*").alias("n"))
    return s.groupBy("label").agg(F.max("n").alias("n"), (F.sum(F.col("c") * F.col("u")) / F.sqrt(F.sum(F.col("c") * F.col("c")))).alias("cohesion"))


def class_confusion(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """a, b, similarity: the cosine of class centroids, a < b."""
    c = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    n = c.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    j = c.select(F.col("label").alias("a"), "d", "x").join(c.select(F.col("label").alias("b"), "d", F.col("x").alias("y")), "d").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    return j.join(n.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("similarity"))


def class_drift(df: DataFrame, year: str = "year", label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, year, drift = 1 - cosine of a class's centroid to that of its year before."""
    c = df.select(F.col(label).alias("label"), F.col(year).alias("year"), F.posexplode(vector).alias("d", "x")).groupBy("label", "year", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    p = c.withColumn("p", F.lag("x").over(Window.partitionBy("label", "d").orderBy("year"))).where("p is not null")
    return p.groupBy("label", "year").agg((1 - F.sum(F.col("x") * F.col("p")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("p") * F.col("p")))).alias("drift"))


def silhouette(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, n, silhouette: the mean silhouette of a class's vectors by cosine distance, over all pairs.

    A vector's mean distance to a class follows from the class's sum of unit
    vectors, so no pair is built; what is broadcast is one vector for each class.
    Zero and null vectors and null labels are left out. A class of one vector
    has 0, a single class null.
    """
    norm = F.sqrt(M.dot(F.col(vector), F.col(vector)))
    x = df.where(F.col(label).isNotNull()).withColumn("_n", norm).where("_n > 1e-12").select(F.col(label).alias("label"), F.transform(vector, lambda v: F.try_divide(v.cast("double"), F.col("_n"))).alias("u"))
    sums = x.select("label", F.posexplode("u").alias("d", "x")).groupBy("label", "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("s"))
    classes = per.agg(F.collect_list(F.struct("label", "n", "s")).alias("cs"))
    far = lambda c: c["n"] - M.dot(F.col("u"), c["s"])  # noqa: E731  the sum of distances to a class
    y = x.join(F.broadcast(classes)).select(
        "label", F.get(F.filter("cs", lambda c: c["label"] == F.col("label")), F.lit(0)).alias("own"), F.array_min(F.transform(F.filter("cs", lambda c: c["label"] != F.col("label")), lambda c: far(c) / c["n"])).alias("b"), "u"
    )
    y = y.withColumn("a", far(F.col("own")) / F.greatest(F.col("own.n") - 1, F.lit(1)))
    one = F.when(F.col("b").isNotNull(), F.when(F.col("own.n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))
    return y.groupBy("label").agg(F.count("*").alias("n"), F.avg(one).alias("silhouette"))


def class_suggestions(confusion: DataFrame, cohesion: DataFrame, least: int = 3, merge: float = 0.8, split: float = 0.3) -> DataFrame:
    """kind, a, b, value: classes to merge (their centroids more alike than ``merge``), to split (cohesion under ``split``), and too small ones."""
    none = F.lit(None).cast(cohesion.schema["label"].dataType)
    alike = confusion.where(F.col("similarity") > merge).select(F.lit("merge").alias("kind"), "a", "b", F.col("similarity").alias("value"))
    loose = cohesion.where(F.col("cohesion") < split).select(F.lit("split").alias("kind"), F.col("label").alias("a"), none.alias("b"), F.col("cohesion").alias("value"))
    small = cohesion.where(F.col("n") < least).select(F.lit("small").alias("kind"), F.col("label").alias("a"), none.alias("b"), F.col("n").cast("double").alias("value"))
    return alike.unionByName(loose).unionByName(small)


def classification_quality(docs: DataFrame, least: int = 3, low: float = 0.5) -> DataFrame:
    """tech, n, multi_ratio, low_confidence_ratio, suggestion."""
    from .expand import explode_tech

    x = explode_tech(docs).groupBy("tech").agg(F.count("*").alias("n"), F.avg((F.size("tech_list") > 1).cast("int")).alias("multi_ratio"), F.avg((F.col("class_confidence") < low).cast("int")).alias("low_confidence_ratio"))
    return x.withColumn("suggestion", F.when(F.col("n") < least, "merge").when(F.col("multi_ratio") >= 0.8, "split").when(F.col("low_confidence_ratio") >= 0.3, "review").otherwise("keep"))


def class_review(docs: DataFrame, stability: DataFrame, least: int = 3, overlap: float = 0.5, unstable: float = 0.3, multi: float = 0.6) -> DataFrame:
    """kind, a, b, value: suggestions without vectors. Classes to merge (their documents overlap by more than ``overlap``), to name anew
    (keywords less stable than ``unstable``), too small ones, and whether more than a share ``multi`` of documents has several classes.

    ``stability``: tech, stability (``keywords.keyword_stability``).
    """
    from .expand import explode_tech

    n = explode_tech(docs.select("tech_list")).groupBy("tech").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    row = lambda kind, a, b, value: (F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), value.cast("double").alias("value"))
    alike = class_overlap(docs).where(F.col("jaccard") > overlap).select(*row("merge", F.col("a"), F.col("b"), F.col("jaccard")))
    loose = stability.where(F.col("stability") < unstable).select(*row("rename", F.col("tech"), none, F.col("stability")))
    small = n.where(F.col("n") < least).select(*row("small", F.col("tech"), none, F.col("n")))
    several = docs.agg(F.avg((F.size(F.array_distinct("tech_list")) >= 2).cast("int")).alias("r")).where(F.col("r") > multi).select(*row("several classes", none, none, F.col("r")))
    return alike.unionByName(loose).unionByName(small).unionByName(several)


def low_confidence(docs: DataFrame, low: float = 0.5, most: int = 50) -> DataFrame:
    """doc_id, confidence, techs (4 at most) of the ``most`` documents with the least confidence under ``low``."""
    x = docs.where(F.col("class_confidence") < low).orderBy("class_confidence", "doc_id").limit(most)
    return x.select("doc_id", F.round("class_confidence", 3).alias("confidence"), F.slice("tech_list", 1, 4).alias("techs"))


def class_overlap(docs: DataFrame) -> DataFrame:
    """a, b, jaccard of the document sets of two classes."""
    from .expand import explode_pairs, explode_tech

    n = explode_tech(docs.select("tech_list")).groupBy("tech").agg(F.count("*").alias("n"))
    p = explode_pairs(docs.select("tech_list")).groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    j = p.join(n.select(F.col("tech").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("tech").alias("b"), F.col("n").alias("n_b")), "b")
    return j.select("a", "b", M.jaccard(F.col("n_ab"), F.col("n_a"), F.col("n_b")).alias("jaccard"))


def clusters(df: DataFrame, k: int | None = None, vector: str = "embedding", seed: int = 42) -> DataFrame:
    """``df`` with cluster: k-means, by default min(18, max(6, n // 40)) clusters."""
    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    n = x.count()
    model = KMeans(k=k or min(18, max(6, n // 40)), seed=seed, featuresCol="_v", predictionCol="cluster").fit(x)
    return model.transform(x).drop("_v")


def emerging_clusters(rows: DataFrame, recent: int = 3, least: int = 5, share: float = 0.5) -> DataFrame:
    """cluster, n, first_year, mean_year, recent_share, new_applicant_ratio, score, emerging, of rows with cluster, year and company."""
    y = rows.agg(F.max("year")).first()[0] or 0
    a = rows.groupBy("cluster", "company").agg(F.min("year").alias("lo")).groupBy("cluster").agg(F.avg((F.col("lo") > y - recent).cast("int")).alias("new_applicant_ratio"), F.count("*").alias("companies"))
    x = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.avg("year").alias("mean_year"), F.avg((F.col("year") > y - recent).cast("int")).alias("recent_share")).join(a, "cluster")
    new = (F.col("first_year") > y - recent).cast("int")
    score = F.when(F.col("companies") <= 1, (0.5 * F.col("recent_share") + 0.2 * new) / 0.7).otherwise(0.5 * F.col("recent_share") + 0.3 * F.col("new_applicant_ratio") + 0.2 * new)
    return x.select("cluster", "n", "first_year", "mean_year", "recent_share", "new_applicant_ratio", score.alias("score"), ((F.col("recent_share") >= share) & (F.col("n") >= least)).alias("emerging"))


def project(df: DataFrame, vector: str = "embedding", k: int = 2) -> DataFrame:
    """``df`` with point array<double>: principal components (signs are arbitrary)."""
    x = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(x).transform(x).withColumn("point", vector_to_array("_p")).drop("_v", "_p")


def dense_clusters(points: DataFrame, eps_share: float = 0.05, id_: str = "vec_id", point: str = "point", least: int | None = None) -> DataFrame:
    """node, component (its smallest core point; -1: noise) of every point: DBSCAN on a grid of eps cells.

    Core points have ``least`` points within eps, themselves included (by
    default a 120th of n, 2 at least); eps is ``eps_share`` of the larger
    span. A border point takes the smallest component of the core points near it.
    """
    x = stored(points.select(F.col(id_).cast("long").alias("i"), F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y")))
    r = x.agg((F.greatest(F.max("x"), F.max("y")) - F.least(F.min("x"), F.min("y"))).alias("span"), F.count("*").alias("n")).first()
    eps = max(1e-6, eps_share * float(r["span"] or 0))
    least = max(max(5, r["n"] // 60) // 2, 2) if least is None else least
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    a = x.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    around = F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    b = a.select(F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(around).alias("g")).select("j", "x2", "y2", "g.gx", "g.gy")
    near = stored(a.join(b, ["gx", "gy"]).where("i <> j").where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= eps).select("i", "j"))
    core = stored(x.join(near.groupBy("i").agg(F.count("*").alias("k")), "i", "left").where(F.coalesce("k", F.lit(0)) + 1 >= least).select("i"))
    links = near.join(core, "i").join(core.withColumnRenamed("i", "j"), "j").where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    found = core.join(components(links).withColumnRenamed("node", "i"), "i", "left").select("i", F.coalesce("component", "i").alias("own"))
    border = near.join(found.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.min("own").alias("beside"))
    return x.join(found, "i", "left").join(border, "i", "left").select(F.col("i").alias("node"), F.coalesce("own", "beside", F.lit(-1)).alias("component"))


def density_grid(points: DataFrame, cells: int = 60, point: str = "point") -> DataFrame:
    """gx, gy, n: a two-dimensional histogram of ``cells`` x ``cells``."""
    x = points.select(F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y"))
    b = x.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, lo, hi: F.least(F.floor(F.coalesce(F.try_divide((F.col(v) - F.col(lo)) * cells, F.col(hi) - F.col(lo)), F.lit(0.0))), F.lit(cells - 1)).cast("int")
    return x.join(F.broadcast(b)).groupBy(at("x", "x0", "x1").alias("gx"), at("y", "y0", "y1").alias("gy")).agg(F.count("*").alias("n"))


def overlap_density(df: DataFrame, k: int = 20, id_: str = "vec_id", vector: str = "embedding", block: int = metric.BLOCK) -> DataFrame:
    """node, density: the mean cosine of the ``k`` nearest of all vectors, or of all others if there are fewer.

    A row for each vector; null for a null one. As in the reference, a zero
    vector's cosines are 0, and so is that of a vector to itself, which counts
    where fewer than ``k`` others have more.
    """
    unit = stored(_unit(df, id_, vector))
    there, lengthy = df.where(F.col(vector).isNotNull()).count(), unit.count()
    k = max(0, min(k, there - 1))
    rows = df.select(F.col(id_).cast("long").alias("node"), F.col(vector).isNotNull().alias("_has"))
    index = metric.build(unit, block=block) if k else None
    if index is None:
        return rows.select("node", F.when(F.col("_has"), 0.0).alias("density"))
    found = metric.nearest(index, k, cosine=True)
    cosines = F.concat(F.transform("near", lambda x: -x["d"]), F.array_repeat(F.lit(0.0), min(k, there - lengthy + 1)))
    top = F.slice(F.sort_array(cosines, asc=False), 1, k)
    found = found.select(F.col("i").alias("node"), (F.aggregate(top, F.lit(0.0), lambda x, y: x + y) / k).alias("density"))
    return rows.join(found, "node", "left").select("node", F.when(F.col("_has"), F.coalesce("density", F.lit(0.0))).alias("density"))


def char_tfidf(df: DataFrame, id_: str, text: str, sizes: tuple[int, int] = (2, 4), features: int = 5000, least: int = 2) -> DataFrame:
    """id, gram, weight: l2-normalised TF-IDF of n-grams within words (a blank before and after each), of the ``features`` most frequent in ``least`` texts or more.

    Words are counted over all texts before they are cut into n-grams. Rows of
    one id are one text; texts without such an n-gram have no rows.
    """
    return ngrams.flat_weights(*ngrams.weights(df.select(F.col(id_).alias("id"), F.lower(text).alias("t")), sizes, features, least))


def reduced(weights: DataFrame, k: int = 64) -> DataFrame:
    """id, point array<double>: the first ``k`` singular directions of rows id, gram, weight, not centred (signs are arbitrary).

    A block Lanczos solver passes over packed rows; tasks hold blocks of
    distinct grams x ``ngrams.BLOCK``, which ``char_tfidf`` bounds.
    """
    weights = stored(weights)  # read for the names, and for the rows
    names = [r["gram"] for r in weights.select("gram").distinct().orderBy("gram").collect()]
    at = weights.sparkSession.createDataFrame([*enumerate(names)], "f int, gram string")
    rows = weights.join(F.broadcast(at), "gram").select("id", "f", F.col("weight").cast("double").alias("v"))
    return ngrams.turned(stored(ngrams.gathered(rows, ngrams.WEIGHT)), len(names), k, ngrams.WEIGHT)


def text_points(df: DataFrame, id_: str, text: str, k: int = 64) -> DataFrame:
    """``reduced`` of ``char_tfidf``, without a row for each weight; written, as it is read several times."""
    names, idf, rows = ngrams.weights(df.select(F.col(id_).alias("id"), F.lower(text).alias("t")), (2, 4), 5000, 2)
    return stored(ngrams.turned(rows, len(names), k, ngrams.COUNT, idf))


def phrase_groups(phrases: list[str], vectors: np.ndarray, distance: float = 0.45) -> dict[str, int]:
    """Average-linkage clusters of at most some hundred phrases by cosine distance (a bounded list, on the driver); equal distances merge in order.

    The distances of a merged group are the means of its parts', weighted by their sizes.
    """
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(length > 1e-12, length, np.inf)
    far = 1 - unit @ unit.T
    np.fill_diagonal(far, np.inf)
    members: list[list[int]] = [[i] for i in range(len(phrases))]
    while len(members) > 1:
        i, j = divmod(int(np.argmin(far)), len(far))
        if far[i, j] >= distance:
            break
        i, j = min(i, j), max(i, j)
        a, b = len(members[i]), len(members[j])
        both = (a * far[i] + b * far[j]) / (a + b)
        far[i] = far[:, i] = both
        far[i, i] = np.inf
        far[j] = far[:, j] = np.inf
        members[i] += members[j]
        members[j] = []
        if not np.isfinite(far).any():
            break
    return {phrases[i]: g for g, group in enumerate(m for m in members if m) for i in group}


def semantic_groups(df: DataFrame, column: str, most: int = 300, distance: float = 0.45) -> DataFrame:
    """phrase, group, label, n: the ``most`` most frequent phrases of a column, grouped by their n-gram vectors.

    Groups are numbered by documents, largest first; a label is a group's most frequent phrase.
    """
    counts = df.where(F.trim(column) != "").groupBy(F.col(column).alias("phrase")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(most)
    rows = counts.collect()  # the reference's bound: ``most`` phrases
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, r["phrase"]) for i, r in enumerate(rows)], "id int, phrase string")
    weights = stored(char_tfidf(listed, "id", "phrase"))
    points = {} if weights.isEmpty() else {r["id"]: r["point"] for r in reduced(weights).collect()}
    size = max(map(len, points.values()), default=1)
    group = phrase_groups([r["phrase"] for r in rows], np.array([points.get(i, [0.0] * size) for i in range(len(rows))]).reshape(len(rows), size), distance)
    total: dict[int, int] = {}
    for r in rows:
        total[group[r["phrase"]]] = total.get(group[r["phrase"]], 0) + r["n"]
    first = {}
    for r in rows:
        first.setdefault(group[r["phrase"]], r["phrase"])
    order = {g: k for k, g in enumerate(sorted(total, key=lambda g: (-total[g], first[g])))}
    return spark.createDataFrame([(r["phrase"], order[group[r["phrase"]]], first[group[r["phrase"]]], r["n"]) for r in rows], "phrase string, group int, label string, n long")


def semantic_matrix(docs: DataFrame, problem: str = "problem", solution: str = "solution", rows: int = 30, distance: float = 0.45) -> DataFrame:
    """problem, solution (labels of groups), n documents, of the ``rows`` largest groups of each."""
    both = docs.where((F.trim(problem) != "") & (F.trim(solution) != ""))
    side = lambda c: F.broadcast(semantic_groups(both, c, distance=distance).where(F.col("group") < rows).select(F.col("phrase").alias(c), F.col("label").alias(f"_{c}")))
    found = both.join(side(problem), problem).join(side(solution), solution)
    return found.groupBy(F.col(f"_{problem}").alias("problem"), F.col(f"_{solution}").alias("solution")).agg(F.count("*").alias("n"))
