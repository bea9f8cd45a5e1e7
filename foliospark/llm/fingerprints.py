"""Document fingerprints: SimHash over weighted terms, with built-in expressions only.

Terms are pairs of neighbouring words, as often as they occur, and a term's
weight is its length. The next document of each document is found inside ranges
of doc_id, so no task orders all documents.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, ascii_lower, cut, hex64, small, whole, words
from .simhash import block_table_pairs, term_fingerprints

BITS, SHINGLE, RADIUS = 128, 2, 3
#: Bytes of each of two lookup tables that may be broadcast at once; the driver builds both beside each other, at several times their size.
LOOKUP_BYTES = 8 << 20
PRINTS = [f"fp{i}" for i in range(BITS // 64)]


def likeness(a: list[Column], b: list[Column]) -> Column:
    """The cosine that the share of different bits stands for, 0 if it is negative."""
    differing = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return F.greatest(F.lit(0.0), F.cos(differing * (math.pi / (64 * len(a)))))


def fingerprint_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, copies and the fingerprint columns; equal texts have equal fingerprints, and texts without words have 0."""
    d = df.select(*keys, words(ascii_lower(whole(text)), BLANK).alias("_words"))
    return term_fingerprints(d, keys, "_words", SHINGLE, BITS, weighted=True)


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Upper doc_ids of about equal ranges; where they lie changes the work of each task, never the result."""
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(1000, 4 * ranges)).alias("b")).first()["b"] if shares else None
    return sorted(set(found or []))


#: Rows without a doc_id are dealt to so many ranges by their text's hash.
NULL_RANGES = 1024


def _range_of(doc_id: Column, text_hash: Column, bounds: list[int]) -> Column:
    """How many bounds are under ``doc_id``, in two steps of about sqrt(n) comparisons; negative for null, falling with the hash."""
    without = -1 - F.shiftright(text_hash, 54) - NULL_RANGES // 2
    if not bounds:
        return F.when(doc_id.isNull(), without).otherwise(F.lit(0).cast("long"))
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    listed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  one literal, however long
    c = F.size(F.filter(listed([x[-1] for x in parts if len(x) == step], "array<bigint>"), lambda b: b < doc_id))
    fine = F.size(F.filter(F.coalesce(F.get(listed(parts, "array<array<bigint>>"), c), F.array().cast("array<bigint>")), lambda b: b < doc_id))
    return F.when(doc_id.isNull(), without).otherwise((c * step + fine).cast("long"))


def with_next(docs: DataFrame, rows_per_range: int = 2000, most_ranges: int = 65_536) -> DataFrame:
    """doc_id, text, next_text: the text after each document in descending doc_id; the first one's after the last.

    Null texts are empty. Null doc_ids come last, and rows with the same doc_id
    in the order of their text hashes. Each text is shuffled once, with the
    others of its range of doc_ids; the first rows of all ranges (a range at
    most each) follow the last rows of the ranges before them.
    """
    ranges = max(1, min(most_ranges, -(-docs.count() // rows_per_range)))
    bounds = _bounds(docs, ranges)
    d = docs.select("doc_id", whole("text").alias("text")).withColumn("_h", F.xxhash64("text"))
    d = d.withColumn("_range", _range_of(F.col("doc_id"), F.col("_h"), bounds))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_h"))
    # ~doc_id falls as doc_id rises, and can't overflow.
    heads_id = d.groupBy("_range").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("neg"), F.col("_h").alias("h"))).alias("m"))
    heads_id = heads_id.select(F.col("_range").alias("_r"), F.bitwise_not("m.neg").alias("_id"), F.col("m.h").alias("_hh"))
    heads = d.join(F.broadcast(heads_id), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh"))).groupBy("_range").agg(F.first("text").alias("head"))
    # After the last range comes the first one again; both are over at most most_ranges + NULL_RANGES rows.
    before = heads_id.select("_r", F.coalesce(F.lag("_r").over(Window.orderBy("_r")), F.max("_r").over(Window.partitionBy())).alias("_from"))
    following = cut(before.join(heads, F.col("_from") == F.col("_range")).select("_r", "head"))
    linked = d.withColumn("_next", F.lead("text").over(order)).withColumn("_last", F.lead("_h").over(order).isNull())
    # Where the heads are too much to broadcast, rows that aren't the last of a range have a key of their own.
    key = F.when(F.col("_last"), F.col("_range")).otherwise((1 << 40) + F.abs(F.col("_h") % (1 << 40)))
    out = linked.withColumn("_key", key).join(small(following, F.octet_length("head") + 64), F.col("_key") == F.col("_r"), "left")
    return out.select("doc_id", "text", F.coalesce("_next", "head").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third (rounded down) replaced by as many of the first code points of ``following``."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, text, edited and next document's fingerprints, one row for each row of ``docs``.

    Each text is fingerprinted with its edited form in one pass; the next
    document's fingerprint is that of the row which follows, found once more by
    the order of (doc_id, text), on narrow rows.
    """
    d = with_next(docs).select("doc_id", "text", F.xxhash64("text").alias("_h"), edited(F.col("text"), F.col("next_text")).alias("edited"), F.xxhash64("next_text").alias("_nh"))
    facts = ["doc_id", "_h", "_nh", "n_chars", "edited_sha256"]
    d = d.select("doc_id", "_h", "_nh", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"))
    prints = fingerprint_texts(d.select(*facts, F.col("x.kind").alias("kind"), F.col("x.t").alias("t")), [*facts, "kind"], "t")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return prints.groupBy(*facts).agg(
        F.max("copies").alias("copies"), *[pick(0, c).alias(c) for c in PRINTS], *[pick(1, c).alias(f"edited_{c}") for c in PRINTS]
    )


def near_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of all pairs of different fingerprints within ``radius`` bits, by permuted block tables."""
    return block_table_pairs(prints, PRINTS, radius)


def query(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; n_near: how many other fingerprints of documents lie within RADIUS bits of its own.

    Null and empty texts have fingerprint 0, 0 characters, and are near to one
    another. Repeated rows stay repeated, ties of doc_id go by text hash, one
    document is its own next, and an empty table gives an empty one.
    near_next compares by text hash: equal texts have equal fingerprints, so any
    row with the next text will do.
    """
    f = cut(fingerprint_documents(docs.select("doc_id", "text")))
    by_text = cut(f.groupBy("_h").agg(*[F.first(c).alias(f"next_{c}") for c in PRINTS]).withColumnRenamed("_h", "_nh"))
    pairs = near_fingerprints(f)
    both = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_near"))
    near = cut(both.select(*[F.col(f"fp.{c}").alias(f"_{c}") for c in PRINTS], "n_near"))
    rows = f.join(small(by_text, F.lit(40), LOOKUP_BYTES), "_nh").join(small(near, F.lit(40), LOOKUP_BYTES), [F.col(c) == F.col(f"_{c}") for c in PRINTS], "left")
    rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    own = [F.col(c) for c in PRINTS]
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat(*[hex64(c) for c in own]).alias("fingerprint"),
        F.concat(*[hex64(F.col(f"edited_{c}")) for c in PRINTS]).alias("edited_fingerprint"),
        likeness(own, [F.col(f"edited_{c}") for c in PRINTS]).alias("near_edited"),
        likeness(own, [F.col(f"next_{c}") for c in PRINTS]).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
