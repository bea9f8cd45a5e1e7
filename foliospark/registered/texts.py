"""Queries on terms, keywords, representative texts, densities and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import density as D
from ..operators import keywords as W
from ..operators import vectors as V
from ..operators.expand import explode_applicants
from ..operators.ranking import percentile_ranks
from ..plans.binding import sql, table
from . import Registry
from .core import PAIRS, TECH, TECHN

REG = Registry()


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- terms and keywords ----------------------------------------------------------

TERMS = f"""sg AS (SELECT doc_id, lang, generate_subscripts(s, 1) AS k, unnest(s) AS seg FROM (SELECT doc_id, lang, regexp_split_to_array(trim(coalesce(text, '')), '{T.BREAK}') AS s FROM documents)),
tk AS (SELECT doc_id, lang, k, list_filter(list_transform(regexp_extract_all(seg, '{T.WORD}'), lambda w:
  CASE WHEN regexp_matches(lower(w), '{T._STEM}') THEN regexp_replace(lower(w), '{T._STEM}', '\\1') ELSE regexp_replace(lower(w), '{T._SHORT_STEM}', '\\1') END),
  lambda w: length(w) >= 2 AND NOT list_contains({_quoted(T.STOP_WORDS)}, w)) AS w FROM sg),
tm AS (SELECT DISTINCT doc_id, lang, term FROM (SELECT doc_id, lang, unnest(w) AS term FROM tk
  UNION ALL SELECT doc_id, lang, a || ' ' || b FROM (SELECT doc_id, lang, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM tk WHERE len(w) > 1) WHERE a <> b))"""
SCORED = """nc AS (SELECT lang, count(*) AS n_c FROM documents GROUP BY lang), g AS (SELECT term, count(*) AS g FROM tm GROUP BY term), c AS (SELECT lang, term, count(*) AS n FROM tm GROUP BY ALL),
sc AS (SELECT c.lang, c.term, n, (n / n_c) / ((g + 1) / (SELECT count(*) FROM documents)) AS lift FROM c JOIN nc ON nc.lang IS NOT DISTINCT FROM c.lang JOIN g ON g.term = c.term
  WHERE n >= greatest(2, floor(CASE WHEN contains(c.term, ' ') THEN 0.12 ELSE 0.18 END::DOUBLE * n_c))),
cd AS (SELECT lang, term, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term DESC) AS r FROM (SELECT lang, term, round(lift * n * CASE WHEN contains(term, ' ') THEN 1.6 ELSE 1.0 END::DOUBLE, 9) AS score FROM sc WHERE lift >= 1.3))"""
GREEDY = """gr(lang, r, kept, scores, words) AS (SELECT DISTINCT lang, 0::BIGINT, []::VARCHAR[], []::DOUBLE[], []::VARCHAR[] FROM cd
  UNION ALL SELECT lang, r, CASE WHEN known THEN kept ELSE list_append(kept, term) END, CASE WHEN known THEN scores ELSE list_append(scores, score) END, CASE WHEN known THEN words ELSE list_concat(words, w) END
  FROM (SELECT gr.lang, cd.r, kept, scores, words, cd.term, cd.score, string_split(cd.term, ' ') AS w, len(kept) >= 8 OR len(list_filter(string_split(cd.term, ' '), lambda x: NOT list_contains(words, x))) = 0 AS known FROM gr JOIN cd ON cd.lang = gr.lang AND cd.r = gr.r + 1))"""


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("cluster"), T.document_terms(F.col("text")).alias("terms"))


REG.add(
    "cluster_terms", lambda s, d: W.scored_terms(_by_language(s, d)).withColumn("score", F.round("score", 6)),
    f"WITH {TERMS}, {SCORED} SELECT cd.lang AS cluster, cd.term, n, round(score, 6) AS score FROM cd JOIN sc ON sc.lang = cd.lang AND sc.term = cd.term",
)
REG.add(
    "cluster_keywords", lambda s, d: W.cluster_keywords(_by_language(s, d)).select("cluster", "term", F.round("score", 6).alias("score"), "place"),
    f"WITH RECURSIVE {TERMS}, {SCORED}, {GREEDY} SELECT lang AS cluster, unnest(kept) AS term, round(unnest(scores), 6) AS score, generate_subscripts(kept, 1)::INT AS place FROM (SELECT lang, kept, scores FROM gr QUALIFY row_number() OVER (PARTITION BY lang ORDER BY r DESC) = 1)",
)

#: The names of a document's parts are its text here.
NAMED = f"nm AS (SELECT base_year, tech_list, list_filter(regexp_extract_all(lower(array_to_string(tech_b_list, ' ')), '{T.LABEL_WORD}'), lambda w: NOT list_contains({_quoted(T.LABEL_STOP_WORDS)}, w)) AS words FROM docs)"
WORDS = "lw AS (SELECT tech, base_year > (SELECT median(base_year) FROM docs) AS late, unnest(words) AS word FROM (SELECT base_year, words, unnest(tech_list) AS tech FROM nm))"
HALVES = """kw AS (SELECT tech, late, word FROM (SELECT tech, late, word, count(*) AS n FROM lw GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY tech, late ORDER BY n DESC, word) <= 10),
st AS (SELECT tech, count(*) FILTER (e) AS early, count(*) FILTER (l) AS late, CASE WHEN count(*) FILTER (e) > 0 AND count(*) FILTER (l) > 0 THEN round(count(*) FILTER (e AND l) / count(*), 3) END AS stability
  FROM (SELECT tech, word, bool_or(NOT late) AS e, bool_or(late) AS l FROM kw GROUP BY ALL) GROUP BY tech)"""


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("base_year", "tech_list", T.label_words(F.concat_ws(" ", "tech_b_list")).alias("words"))


REG.docs("keyword_stability", lambda d: W.keyword_stability(_named(d)), sql("SELECT * FROM st", NAMED, WORDS, HALVES))
REG.docs(
    "class_keywords", lambda d: W.label_keywords(_named(d).select(F.explode("tech_list").alias("tech"), "words"), ["tech"]).select("tech", "word", "n", "place"),
    sql("SELECT tech, word, n, row_number() OVER (PARTITION BY tech ORDER BY n DESC, word)::INT AS place FROM (SELECT tech, word, count(*) AS n FROM lw GROUP BY ALL) QUALIFY place <= 8", NAMED, WORDS),
)
REG.docs(
    "class_review", lambda d: V.class_review(d, W.keyword_stability(_named(d)), least=700, overlap=0.05, unstable=0.7).withColumn("value", F.round("value", 9)),
    sql("""SELECT 'merge' AS kind, c.a, c.b, round(c.n::DOUBLE / (x.n + y.n - c.n), 9) AS value FROM (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b) c JOIN techn x ON x.tech = a JOIN techn y ON y.tech = b WHERE c.n::DOUBLE / (x.n + y.n - c.n) > 0.05
UNION ALL SELECT 'rename', tech, NULL, round(stability, 9) FROM st WHERE stability < 0.7 UNION ALL SELECT 'small', tech, NULL, n::DOUBLE FROM techn WHERE n < 700
UNION ALL SELECT 'several classes', NULL, NULL, round(r, 9) FROM (SELECT avg((len(tech_list) >= 2)::INT) AS r FROM docs) WHERE r > 0.6""", TECH, PAIRS, TECHN, NAMED, WORDS, HALVES),
)
REG.docs("low_confidence", lambda d: V.low_confidence(d, low=0.95), sql("SELECT doc_id, round(class_confidence, 3) AS confidence, tech_list[:4] AS techs FROM docs WHERE class_confidence < 0.95 ORDER BY class_confidence, doc_id LIMIT 50"))

# --- representative texts: the source and the language stand for a title and its summary -----


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", F.col("source").alias("title"), F.when(F.col("lang") == "en", F.col("text")).alias("ai_summary"), F.when(F.col("lang") != "de", F.col("text")).alias("abstract"), F.col("text").alias("indep_claim"))


REG.add(
    "corpus_text", lambda s, d: W.corpus_text(_filed(s, d)).select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")),
    r"""WITH f AS (SELECT doc_id, coalesce(source, '') AS title, CASE WHEN lang = 'en' THEN text ELSE '' END AS s, CASE WHEN lang <> 'de' THEN text ELSE '' END AS a, coalesce(text, '') AS c FROM documents),
k AS (SELECT count(*) AS n, count(*) FILTER (length(s) >= 30) AS s, count(*) FILTER (length(a) >= 30) AS a, count(*) FILTER (length(c) >= 30) AS c, count(*) FILTER (length(title) >= 10) AS t FROM f),
w AS (SELECT CASE WHEN s >= greatest(20, 0.3 * n) THEN 'summary' WHEN a >= greatest(20, 0.3 * n) THEN 'title and abstract' WHEN c >= 20 THEN 'claim' WHEN t >= 20 THEN 'title' END AS source FROM k),
x AS (SELECT doc_id, source, trim(regexp_replace(CASE source WHEN 'summary' THEN s WHEN 'title and abstract' THEN title || '. ' || coalesce(a, '') WHEN 'claim' THEN c ELSE title END, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM f, w)
SELECT doc_id, source, length(text) AS n_chars, sha256(text) AS text_sha256 FROM x WHERE length(text) >= 15""".replace("\\\\", "\\"),
)

# --- densities -----------------------------------------------------------------


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("point"))


REG.add(
    "kernel_density", lambda s, d: D.kernel_density(_plane(s, d)).select("gx", "gy", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("density", 7).alias("density")),
    """WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), v AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, pow(count(*), -1.0 / 3) AS k FROM p),
g AS (SELECT i.i::INT AS gx, j.j::INT AS gy, x0 + i.i * (x1 - x0) / 59 AS x, y0 + j.j * (y1 - y0) / 59 AS y FROM v, range(60) i(i), range(60) j(j))
SELECT gx, gy, round(g.x, 9) AS x, round(g.y, 9) AS y, round(sum(exp(-0.5 * (yy * pow(g.x - p.x, 2) - 2 * xy * (g.x - p.x) * (g.y - p.y) + xx * pow(g.y - p.y, 2)) / (xx * yy - xy * xy) / k)) / (2 * pi() * k * sqrt(xx * yy - xy * xy) * n), 7) AS density
FROM g, p, v GROUP BY gx, gy, g.x, g.y, k, xx, yy, xy, n""",
)
REG.add("claim_density_map", lambda s, d: D.kernel_density(V.project(table(s, d, "embeddings").select("vec_id", "embedding"))))

# --- ranks -----------------------------------------------------------------------

REG.docs(
    "company_percentiles", lambda d: percentile_ranks(explode_applicants(d).groupBy("company").agg(F.count("*").alias("n")), "n").withColumn("percentile", F.round("percentile", 9)),
    sql("SELECT company, n, round(100 * (count(*) OVER (ORDER BY n)) / (count(*) OVER ()), 9) AS percentile FROM (SELECT company, count(*) AS n FROM (SELECT unnest(co_applicants) AS company FROM docs) GROUP BY company)"),
)
REG.docs("document_percentiles", lambda d: percentile_ranks(d.select("doc_id", F.col("family_size").alias("size")), "size").withColumn("percentile", F.round("percentile", 9)), sql("SELECT doc_id, family_size AS size, round(100 * (count(*) OVER (ORDER BY family_size)) / (count(*) OVER ()), 9) AS percentile FROM docs"))
