"""Keywords of clusters and classes, and the text that stands for a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expand import explode_tech


def scored_terms(rows: DataFrame, terms: str = "terms", lift: float = 1.3, single: float = 0.18, double: float = 0.12, weight: float = 1.6) -> DataFrame:
    """cluster, term, n, score: terms (distinct in a document) that are frequent in a cluster and ``lift`` times as frequent as over all documents.

    A phrase needs a share of ``double`` of the cluster's documents and weighs
    ``weight``, a word ``single``; either two documents.
    """
    size = rows.groupBy("cluster").agg(F.count("*").alias("n_c"))
    total = rows.agg(F.count("*").alias("_total"))
    t = rows.select("cluster", F.explode(terms).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("n"))
    everywhere = t.groupBy("term").agg(F.sum("n").alias("g"))
    two = F.col("term").contains(" ")
    least = F.greatest(F.lit(2), F.floor(F.when(two, double).otherwise(single) * F.col("n_c")))
    rise = (F.col("n") / F.col("n_c")) / ((F.col("g") + 1) / F.col("_total"))
    x = t.join(size, "cluster").where(F.col("n") >= least).join(everywhere, "term").join(F.broadcast(total)).withColumn("_lift", rise)
    return x.where(F.col("_lift") >= lift).select("cluster", "term", "n", F.round(F.col("_lift") * F.col("n") * F.when(two, weight).otherwise(1.0), 9).alias("score"))


def cluster_keywords(rows: DataFrame, terms: str = "terms", top: int = 8) -> DataFrame:
    """cluster, term, score, place: the ``top`` best terms of each cluster (``rows``: cluster, terms).

    Taken from the best on (equal scores from the last in the alphabet): a word
    is passed over if a chosen term has it, a phrase if chosen terms have all of
    its words. A cluster without a distinctive term has its most frequent ones,
    with score null. A term that a seventh of a cluster's documents have is one
    of as many as seven documents are long, whatever the cluster's size: the
    lists that are folded are short.
    """
    best = F.array_sort(F.collect_list(F.struct("score", "term")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    lists = scored_terms(rows, terms).groupBy("cluster").agg(best.alias("found"))
    nothing = F.struct(F.array().cast("array<struct<score:double,term:string>>").alias("kept"), F.array().cast("array<string>").alias("words"))

    def take(s: Column, x: Column) -> Column:
        words = F.split(x["term"], " ")
        known = F.forall(words, lambda w: F.array_contains(s["words"], w))
        full = F.size(s["kept"]) >= top
        return F.when(full | known, s).otherwise(F.struct(F.array_append(s["kept"], x).alias("kept"), F.array_union(s["words"], words).alias("words")))

    chosen = lists.select("cluster", F.posexplode(F.aggregate("found", nothing, take)["kept"]).alias("place", "x")).select("cluster", F.col("x.term").alias("term"), F.col("x.score").alias("score"), (F.col("place") + 1).alias("place"))
    plain = rows.join(lists.select("cluster"), "cluster", "left_anti").select("cluster", F.explode(terms).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), F.desc("term"))
    frequent = plain.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("cluster", "term", F.lit(None).cast("double").alias("score"), "place")
    return chosen.unionByName(frequent)


def label_keywords(rows: DataFrame, by: list[str], words: str = "words", top: int = 8) -> DataFrame:
    """``by``, word, n, place: the ``top`` most frequent words of each group (equal ones by the alphabet), counted before they are ranked."""
    n = rows.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))
    return n.withColumn("place", place).where(F.col("place") <= top)


def keyword_stability(docs: DataFrame, words: str = "words", top: int = 10) -> DataFrame:
    """tech, early, late, stability: the Jaccard share of the ``top`` keywords up to the median year of all documents and after it; null where one half has none."""
    mid = docs.where("base_year is not null").agg(F.percentile("base_year", F.lit(0.5)).alias("mid"))
    x = explode_tech(docs.where("base_year is not null")).join(F.broadcast(mid)).withColumn("late", F.col("base_year") > F.col("mid"))
    k = label_keywords(x, ["tech", "late"], words, top).groupBy("tech", "word").agg(F.max(~F.col("late")).alias("early"), F.max("late").alias("late"))
    n = k.groupBy("tech").agg(F.sum(F.col("early").cast("long")).alias("early"), F.sum(F.col("late").cast("long")).alias("late"), F.sum((F.col("early") & F.col("late")).cast("long")).alias("_both"), F.count("*").alias("_any"))
    return n.select("tech", "early", "late", F.when((F.col("early") > 0) & (F.col("late") > 0), F.round(F.col("_both") / F.col("_any"), 3)).alias("stability"))


def corpus_text(docs: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """doc_id, text, source: the text that stands for a document, from the best source that enough documents have.

    Summaries (with features after them, if any document has some) where at
    least ``least`` documents and a ``share`` of all have 30 characters of it;
    else title and abstract, by the same rule for abstracts; else the first
    claim, if ``least`` have 30 characters; else the title, if ``least`` have 10.
    Documents with fewer than 15 characters of it have no row. One aggregation
    within the plan decides; no job runs beforehand.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    long = lambda c, n: F.sum((F.length(said(c)) >= n).cast("long"))
    facts = docs.agg(F.count("*").alias("_n"), long("ai_summary", 30).alias("_s"), long("feature_summary", 10).alias("_f"), long("abstract", 30).alias("_a"), long("indep_claim", 30).alias("_c"), long("title", 10).alias("_t"))
    enough = F.greatest(F.lit(least), share * F.col("_n"))
    source = F.when(F.col("_s") >= enough, F.when(F.col("_f") > 0, "summary and features").otherwise("summary")).when(F.col("_a") >= enough, "title and abstract").when(F.col("_c") >= least, "claim").when(F.col("_t") >= least, "title")
    whole = (
        F.when(F.col("source") == "summary and features", F.concat(said("ai_summary"), F.lit(" "), said("feature_summary"))).when(F.col("source") == "summary", said("ai_summary"))
        .when(F.col("source") == "title and abstract", F.concat(F.concat(said("title"), F.lit(". ")) if "title" in docs.columns else F.lit(""), said("abstract"))).when(F.col("source") == "claim", said("indep_claim")).when(F.col("source") == "title", said("title"))
    )
    x = docs.join(F.broadcast(facts)).withColumn("source", source)
    x = x.select("doc_id", F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("text"), "source")
    return x.where(F.length("text") >= 15)


def preprocessed_claim(c: Column) -> Column:
    """A claim with its blanks tidied; null if fewer than 30 characters are left."""
    s = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return F.when((F.length(s) >= 30) & ~F.lower(s).isin("nan", "none"), s)
