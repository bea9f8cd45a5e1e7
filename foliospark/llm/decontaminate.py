"""Benchmark decontamination with built-in expressions only.

The normalised n-grams of the benchmark form a hash table that is broadcast
after its size is measured (a larger one is joined by shuffle). Each document's
token windows are hashed and probed in one generated stage; a probe that
matches is verified word for word; hits are then summed up per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SYMBOL, ascii_lower, cut, small, unused, whole, words

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, len, window): the windows of ``n`` words of each item; a shorter item, if not empty, is one window."""
    w = benchmark.select("item_id", words(ascii_lower(whole("text")), SYMBOL).alias("w")).where(F.size("w") > 0)
    return (
        w.withColumn("len", F.least(F.size("w"), F.lit(n)))
        .select("item_id", "w", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("i"))
        .select("item_id", "len", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("len"))).alias("window"))
    )


def _window_hash(words_array, start, length):
    return F.xxhash64(F.slice(words_array, start, length))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, hits (sorted array of (pos, len, window_id)), n_hit, items.

    Null texts have no words. Several rows with one doc_id are judged on their
    own; a null item_id is matched but can't be listed in ``items``. An empty
    benchmark leaves every document clean, an empty table gives no row. Texts and
    items are read whole, however long; items with equal windows are all listed.
    Other columns play no part, whatever their names.
    """
    per_item = benchmark_windows(benchmark, n)
    distinct = per_item.select("len", "window").distinct()
    lengths, size = [], 0
    for r in distinct.groupBy("len").agg(F.sum(F.octet_length("window") + 64).alias("bytes")).collect():  # n rows at most
        lengths.append(r["len"])
        size += r["bytes"]
    lengths = sorted(lengths, reverse=True) or [n]
    near = (lambda df: F.broadcast(df)) if size <= limit else (lambda df: df)
    # The same split as the documents' makes both sides' hashes alike.
    table = distinct.select(
        F.xxhash64(F.transform(F.split("window", " "), lambda x: F.xxhash64(x))).alias("key"), F.col("len").alias("w_len"), "window", F.xxhash64(F.lit(7), "window").alias("window_id")
    )
    if size > limit:
        table = cut(table)  # a shuffled side that is only read, so that the probes of a very common window can be split
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(ascii_lower(whole("text")), SYMBOL).alias("w"))
    d = d.select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    # Position -1 of the first length stands for the document itself, so that clean ones stay in the one pass.
    first, at = F.lit(lengths[0]), F.greatest("pos", F.lit(0)) + 1
    if len(lengths) > 1:
        d = d.withColumn("L", F.explode(F.array(*map(F.lit, lengths))))
    else:
        d = d.withColumn("L", first)
    last = F.col("n_words") - F.col("L")
    low = F.when(F.col("L") == first, -1).otherwise(0)
    spots = F.when(last >= low, F.sequence(low, last)).when(low == -1, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    probes = d.select("doc_id", "text_hash", "w", "n_words", "h", "L", F.explode(spots).alias("pos"))
    probes = probes.withColumn("probe", F.when(F.col("pos") >= 0, _window_hash(F.col("h"), at, F.col("L"))))
    mine = F.concat_ws(" ", F.slice("w", at, F.col("L")))
    if size > limit:
        # Rows that are shuffled carry their own window, not their document; a document's own row goes anywhere but to one task.
        own = F.xxhash64("doc_id", "text_hash", F.lit("document"))
        probes = probes.select("doc_id", "text_hash", "n_words", "L", "pos", F.coalesce("probe", own).alias("probe"), F.when(F.col("pos") >= 0, mine).alias("mine"))
        mine = F.col("mine")
    same = (F.col("probe") == F.col("key")) & (F.col("L") == F.col("w_len")) & (mine == F.col("window"))
    hits = probes.join(near(table), same, "left").where((F.col("pos") == -1) | F.col("window_id").isNotNull())
    hit = F.struct(F.col("pos"), F.col("L").alias("len"), F.col("window_id"))
    grouped = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sum((F.col("pos") == -1).cast("int")).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("window_id").isNotNull(), hit))).alias("hits"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["pos"] + x["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    items = cut(per_item.select(F.xxhash64(F.lit(7), "window").alias("id"), "item_id").distinct())
    named = (
        grouped.withColumn("n_hit", covered)
        .select("*", F.explode_outer(F.array_distinct(F.transform("hits", lambda x: x["window_id"]))).alias("wid"))
        .join(small(items, F.octet_length(F.col("item_id").cast("string")) + 32, limit), F.col("wid") == F.col("id"), "left")
        .groupBy("doc_id", "text_hash", "n_words", "copies", "n_hit")
        .agg(F.first("hits").alias("hits"), F.collect_set("item_id").alias("items"))
    )
    return named.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


def contaminated(n_hit, n_words):
    """At least a twentieth of the words, and one at least, lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, mode: str = "documents") -> DataFrame:
    """``docs`` without its contaminated documents (mode "documents") or with the hit words cut out of them ("spans").

    A document keeps all its columns, whatever their names. Null and empty texts
    are clean; texts are scanned whole; repeated rows and rows with one doc_id
    are judged each on its own text. Spans are cut together with the separators
    inside and after them. An empty benchmark leaves all as it is.
    """
    found = contamination(docs.select("doc_id", "text"), benchmark, n).where(F.col("n_hit") > 0)
    key, h, hits, ws = (unused(docs, x) for x in ("id", "hash", "hits", "words"))
    found = found.withColumns({key: F.col("doc_id"), h: F.col("text_hash"), hits: F.col("hits")})
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h))
    if mode == "documents":
        bad = cut(found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(key, h).distinct())
        return docs.join(small(bad, F.lit(48)), same, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    found = cut(found.select(key, h, hits).dropDuplicates([key, h]))
    hit = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(ws) - 1), hit)
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    left = F.concat(lead, F.array_join(F.transform(kept, lambda i: F.get(F.col(ws), i)), ""))
    joined = docs.join(small(found, 64 + 16 * F.size(hits)), same, "left").withColumn(ws, F.regexp_extract_all("text", F.lit(WORD + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), 0))
    cleaned = F.when(F.col(hits).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[cleaned.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    c = contamination(docs, benchmark)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return c.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 13) AS l, unnest(list_transform(range(0, (len(w) - least(len(w), 13) + 1)::BIGINT), lambda i: array_to_string(w[i + 1 : i + least(len(w), 13)], ' '))) AS k FROM bw WHERE len(w) > 0
), lens AS (SELECT DISTINCT l FROM win),
probe AS (
  SELECT doc_id, l, unnest(range(0, (len(w) - l + 1)::BIGINT)) AS pos, unnest(list_transform(range(0, (len(w) - l + 1)::BIGINT), lambda i: array_to_string(w[i + 1 : i + l], ' '))) AS k FROM dw, lens WHERE len(w) >= l
), hit AS (SELECT p.doc_id, p.pos, p.l, w.item_id FROM probe p JOIN win w ON p.k = w.k AND p.l = w.l),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
