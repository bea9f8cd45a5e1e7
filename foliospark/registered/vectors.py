"""Queries on embeddings, clusters and class quality. Where a library's random start decides, there is no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core as C
from ..operators import hdbscan as H
from ..operators import layout as L
from ..operators import vectors as V
from ..plans.binding import sql, table
from ..plans.stored import once
from . import Registry
from .core import PAIRS, TECH, TECHN

REG = Registry()
THETA = 0.35


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", "label", (1995 + F.col("vec_id") % 7).cast("int").alias("year"), (F.col("vec_id") % 11).cast("string").alias("company"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "pairs", lambda: V.similarity_pairs(embeddings(spark, sf_dir), THETA))


COS = f"cs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id), sp AS (SELECT * FROM cs WHERE similarity >= {THETA})"
FOL = """fo AS (SELECT CASE WHEN ay < byr THEN a ELSE b END AS doc, CASE WHEN ay < byr THEN bc ELSE ac END AS company, ac <> bc AS cross_, similarity FROM (SELECT *, a % 7 AS ay, b % 7 AS byr, a % 11 AS ac, b % 11 AS bc FROM sp) WHERE ay <> byr)"""
REG.add("similarity_pairs", lambda s, d: _pairs(s, d).withColumn("similarity", F.round("similarity", 7)), f"WITH {COS} SELECT a, b, round(similarity, 7) AS similarity FROM sp")
REG.add("semantic_followers", lambda s, d: V.followers(embeddings(s, d), _pairs(s, d)).withColumn("avg_similarity", F.round("avg_similarity", 7)), f"WITH {COS}, {FOL} SELECT doc, count(*) AS followers, count(*) FILTER (cross_) AS cross_followers, count(DISTINCT company) FILTER (cross_) AS companies, round(avg(similarity), 7) AS avg_similarity, round(sum(round(similarity, 9)) FILTER (cross_), 6) AS score FROM fo GROUP BY doc HAVING count(*) FILTER (cross_) >= 2 ORDER BY score DESC, doc LIMIT 12")
REG.add("components", lambda s, d: V.components(_pairs(s, d)), f"WITH RECURSIVE {COS}, e AS (SELECT a AS u, b AS v FROM sp UNION SELECT b, a FROM sp), r(node, other) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.other) SELECT node, min(other) AS component FROM r GROUP BY node")
REG.add("bridges", lambda s, d: V.bridges(p := _pairs(s, d), V.components(p)))
REG.add("overlap_density", lambda s, d: V.overlap_density(embeddings(s, d)).withColumn("density", F.round("density", 7)), f"WITH {COS}, bo AS (SELECT a AS node, b AS o, similarity FROM cs UNION ALL SELECT b, a, similarity FROM cs) SELECT node, round(avg(similarity), 7) AS density FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(similarity, 12) DESC, o) AS r FROM bo) WHERE r <= 20 GROUP BY node")
REG.add("class_cohesion", lambda s, d: V.class_cohesion(embeddings(s, d)).withColumn("cohesion", F.round("cohesion", 6)), """WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), c AS (SELECT label, d, avg(x) AS c, avg(x / n) AS u, count(*) AS n FROM x GROUP BY ALL) SELECT label, max(n) AS n, round(sum(c * u) / sqrt(sum(c * c)), 6) AS cohesion FROM c GROUP BY label""")
CEN = "x AS (SELECT label, vec_id % 7 + 1995 AS year, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"
REG.add("class_confusion", lambda s, d: V.class_confusion(embeddings(s, d)).withColumn("similarity", F.round("similarity", 6)), f"WITH {CEN}, c AS (SELECT label, d, avg(x) AS x FROM x GROUP BY ALL) SELECT p.label AS a, q.label AS b, round(sum(p.x * q.x) / sqrt(sum(p.x * p.x) * sum(q.x * q.x)), 6) AS similarity FROM c p JOIN c q ON p.d = q.d AND p.label < q.label GROUP BY 1, 2")
REG.add("class_drift", lambda s, d: V.class_drift(embeddings(s, d)).withColumn("drift", F.round("drift", 6)), f"WITH {CEN}, c AS (SELECT label, year, d, avg(x) AS x FROM x GROUP BY ALL), p AS (SELECT *, lag(x) OVER (PARTITION BY label, d ORDER BY year) AS p FROM c) SELECT label, year::INT AS year, round(1 - sum(x * p) / sqrt(sum(x * x) * sum(p * p)), 6) AS drift FROM p WHERE p IS NOT NULL GROUP BY ALL")
REG.docs(
    "classification_quality", V.classification_quality,
    sql("SELECT *, CASE WHEN n < 3 THEN 'merge' WHEN multi_ratio >= 0.8 THEN 'split' WHEN low_confidence_ratio >= 0.3 THEN 'review' ELSE 'keep' END AS suggestion FROM (SELECT tech, count(*) AS n, avg((k > 1)::INT) AS multi_ratio, avg((class_confidence < 0.5)::INT) AS low_confidence_ratio FROM (SELECT class_confidence, len(tech_list) AS k, unnest(tech_list) AS tech FROM docs) GROUP BY tech)"),
)
REG.docs("class_overlap", lambda d: V.class_overlap(d).withColumn("jaccard", F.round("jaccard", 9)), sql("SELECT a, b, round(c.n::DOUBLE / (x.n + y.n - c.n), 9) AS jaccard FROM (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b) c JOIN techn x ON x.tech = a JOIN techn y ON y.tech = b", TECH, PAIRS, TECHN))
REG.add("emerging_clusters_by_label", lambda s, d: V.emerging_clusters(embeddings(s, d).withColumn("cluster", F.col("label"))), "WITH e AS (SELECT label AS cluster, vec_id % 7 + 1995 AS year, vec_id % 11 AS company FROM embeddings), a AS (SELECT cluster, company, min(year) AS lo FROM e GROUP BY ALL), n AS (SELECT cluster, avg((lo > 1998)::INT) AS r, count(*) AS k FROM a GROUP BY ALL), c AS (SELECT cluster, count(*) AS n, min(year)::INT AS first_year, avg(year) AS mean_year, avg((year > 1998)::INT) AS recent_share FROM e GROUP BY ALL) SELECT c.*, r AS new_applicant_ratio, CASE WHEN k <= 1 THEN (0.5 * recent_share + 0.2 * (first_year > 1998)::INT) / 0.7 ELSE 0.5 * recent_share + 0.3 * r + 0.2 * (first_year > 1998)::INT END AS score, recent_share >= 0.5 AND c.n >= 5 AS emerging FROM c JOIN n ON n.cluster = c.cluster")
REG.add("emerging_clusters", lambda s, d: V.emerging_clusters(V.clusters(embeddings(s, d))))
REG.add("claim_map", lambda s, d: V.density_grid(V.project(embeddings(s, d))))
REG.add("claim_clusters", lambda s, d: V.dense_clusters(V.project(embeddings(s, d))))
REG.add("embedding_map", lambda s, d: L.mapped(embeddings(s, d)).select("vec_id", F.get("point", F.lit(0)).alias("x"), F.get("point", F.lit(1)).alias("y")))
REG.add("claim_hdbscan", lambda s, d: H.hdbscan(V.project(embeddings(s, d))))
BOTH = "bo AS (SELECT a AS i, b AS j, similarity FROM cs UNION ALL SELECT b, a, similarity FROM cs), ds AS (SELECT i, x.label AS label, y.label AS other, avg(1 - similarity) AS d FROM bo JOIN embeddings x ON x.vec_id = i JOIN embeddings y ON y.vec_id = j GROUP BY ALL)"
REG.add(
    "silhouette", lambda s, d: V.silhouette(embeddings(s, d)).withColumn("silhouette", F.round("silhouette", 6)),
    f"WITH {COS}, {BOTH}, ab AS (SELECT i, label, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM ds GROUP BY ALL) SELECT label, count(*) AS n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM ab GROUP BY label",
)
REG.add(
    "class_suggestions", lambda s, d: V.class_suggestions(V.class_confusion(e := embeddings(s, d)), V.class_cohesion(e)).withColumn("value", F.round("value", 6)),
    f"""WITH {CEN}, c AS (SELECT label, d, avg(x) AS x FROM x GROUP BY ALL), cf AS (SELECT p.label AS a, q.label AS b, sum(p.x * q.x) / sqrt(sum(p.x * p.x) * sum(q.x * q.x)) AS s FROM c p JOIN c q ON p.d = q.d AND p.label < q.label GROUP BY 1, 2),
u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), m AS (SELECT label, d, avg(x) AS c, avg(x / l) AS u, count(*) AS n FROM u GROUP BY ALL), co AS (SELECT label, max(n) AS n, sum(c * u) / sqrt(sum(c * c)) AS co FROM m GROUP BY label)
SELECT 'merge' AS kind, a, b, round(s, 6) AS value FROM cf WHERE s > 0.8 UNION ALL SELECT 'split', label, NULL, round(co, 6) FROM co WHERE co < 0.3 UNION ALL SELECT 'small', label, NULL, n::DOUBLE FROM co WHERE n < 3""",
)
GRAMS = """wd AS (SELECT id, ' ' || w || ' ' AS w, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
tf AS (SELECT id, gram, sum(n) AS tf FROM (SELECT id, n, unnest(list_transform(range(1, len(w) - k + 2), lambda i: substr(w, i, k))) AS gram FROM wd, (SELECT unnest([2, 3, 4]) AS k)) GROUP BY ALL),
kn AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2 ORDER BY sum(tf) DESC, gram LIMIT 5000),
w AS (SELECT id, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS w FROM tf JOIN kn ON kn.gram = tf.gram)"""
REG.add(
    "char_tfidf", lambda s, d: V.char_tfidf(table(s, d, "documents"), "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_grams"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("most")),
    f"WITH {GRAMS} SELECT id AS doc_id, count(*) AS n_grams, round(sum(w) / sqrt(sum(w * w)), 6) AS total, round(max(w) / sqrt(sum(w * w)), 6) AS most FROM w GROUP BY id",
)
REG.docs("network_communities", lambda d: V.communities(C.network_edges(d)).withColumnRenamed("node", "tech"))
REG.add("text_map", lambda s, d: V.density_grid(V.project(V.text_points(table(s, d, "documents"), "doc_id", "text"), "point")))
REG.docs("ps_semantic", lambda d: V.semantic_matrix(d.select(F.get("tech_b_list", F.lit(0)).alias("problem"), F.element_at("tech_b_list", -1).alias("solution"))))
