"""Target-distribution importance resampling on hashed n-gram features.

A chunk of texts gets an integer word dictionary. N-grams are tuples of word ids:
each longer one is a pair of the number of the tuple without its last word and
that word's id. The bytes of each distinct tuple are put together and hashed once,
and every occurrence takes the bucket of its tuple's number. So no n-gram is
shuffled: of the corpus come ``BUCKETS`` sums for each task, and the gains of the
buckets, which is all that tasks need to weigh a document, are as many numbers.
Documents are drawn by their places in a distributed sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import cut, table, unused
from .encode import encoded, tidy

BUCKETS, LONGEST = 10_000, 3
SEED, LEAST_WORDS, PERCENT = 42, 20, 5


def symbol_words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; some may be empty."""
    return pc.split_pattern_regex(pc.ascii_lower(texts), pattern=r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _buckets(grams: pa.Array) -> np.ndarray:
    """crc32 of each string's bytes, modulo BUCKETS."""
    grams = grams.cast(pa.large_string())
    _, offsets, data = grams.buffers()
    ends = np.frombuffer(offsets, np.int64)[grams.offset : grams.offset + len(grams) + 1].tolist()
    view = memoryview(data if data is not None else b"")
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.int64, len(grams)) % BUCKETS


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words of each row, buckets) of the texts, chunk by chunk; rows (from 0 in the chunk) and buckets are aligned, an entry for each n-gram occurrence."""
    for e in encoded(texts, symbol_words):
        row, size, n = e.rows, max(1, len(e.words)), len(e.codes)
        tuples, words, where = e.codes, e.words.cast(pa.large_string()), np.arange(n)
        rows, buckets = [row], [_buckets(words)[tuples]]
        for k in range(1, LONGEST):
            # Places of which the k words before the last and the last are in one text.
            where = np.flatnonzero(row[: n - k] == row[k:]) if n > k else np.zeros(0, np.int64)
            pairs = tuples[where] * size + e.codes[where + k]
            distinct, number = np.unique(pairs, return_inverse=True)
            words = pc.binary_join_element_wise(words.take(pa.array(distinct // size)), e.words.cast(pa.large_string()).take(pa.array(distinct % size)), pa.scalar(" ", pa.large_string()))
            tuples = np.zeros(n, np.int64)
            tuples[where] = number
            rows.append(row[where])
            buckets.append(_buckets(words)[number])
        yield e.first, np.concatenate(rows), np.diff(e.ends, prepend=0), np.concatenate(buckets)


def bucket_counts(df: DataFrame) -> DataFrame:
    """(bucket, n): the n-gram occurrences of the one text column of ``df``, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, buckets in features(batch.column(0)):
                total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return df.mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: a thousand times the log ratio of its shares in the target's and in the raw texts, smoothed by one, rounded down."""
    spark = raw.sparkSession
    all_ = spark.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = all_.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS)))).cast("long")
    rows = both.join(F.broadcast(sums)).select("bucket", gain.alias("gain")).collect()  # BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    for b, g in rows:
        out[b] = g
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel noise of a document, in thousandths, rounded down; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all), with n_words, n_features, weight and score (longs) after them.

    Texts are read whole; null and empty ones have no features and weight 0. Rows
    are weighed each by itself, repeated ones alike. An empty table gives an
    empty one; with an empty target the gains are those of unseen buckets.
    Columns of ``docs`` named like the four new ones are replaced.
    """
    gain = gains(bucket_counts(docs.select("text")), bucket_counts(target.select("text")))
    new = ["n_words", "n_features", "weight"]
    own = [c for c in (keep or docs.columns) if c.lower() not in (*new, "score")]
    text = unused(docs, "text_")
    d = docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, rows, words, buckets in features(batch.column(len(own))):
                n[first : first + len(words)] = words
                # Sums of doubles are exact below 2^53, which no text's sum of gains comes near.
                weight[first : first + len(words)] = np.bincount(rows, weights=gain[buckets], minlength=len(words)).astype(np.int64)
            n_features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(n), pa.array(n_features), pa.array(weight)], [*own, *new])

    schema = d.select(*[F.col(f"`{c}`") for c in own], *[F.lit(0).cast("long").alias(c) for c in new]).schema
    return d.mapInArrow(tidy(run), schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(w: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``w``, rows of ``weighed``, with rank after them: 1, 2, 3 ... for the ``percent`` of those with ``least_words`` words or more that score highest, else null.

    Equal scores go by doc_id, null ids last, then in any order; of rows that are
    repeated each counts. All columns of ``w`` are sorted over the cluster, so
    texts should be left out; a column of it named rank is replaced.
    """
    w = cut(w.select(*[F.col(f"`{c}`") for c in w.columns if c.lower() != "rank"]))
    enough = F.col("n_words") >= least_words
    most = percent * w.where(enough).count() // 100
    place = ranked(w, [(~enough).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    return place.withColumn("rank", F.when(enough & (F.col("rank") <= most), F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns and weight and score: no text is sorted or joined.

    The last of the ranks gives a bound on score and id; rows that tie with it
    in both (repeated ones, and those without an id) are drawn as well.
    """
    w = cut(weighed(docs, target, seed, keep=["doc_id"]))
    last = drawn(w, percent, least_words).where("rank is not null").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("_last"))
    out, bound = weighed(docs, target, seed), F.col("_last.score")
    far, near = F.col("_last.doc_id"), F.col("doc_id")
    inside = (F.col("score") > bound) | ((F.col("score") == bound) & (far.isNull() | F.coalesce(near <= far, F.lit(False))))
    return out.join(F.broadcast(last)).where((F.col("n_words") >= least_words) & inside).drop("_last", "n_words", "n_features")


def query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    w = weighed(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn(w).select("doc_id", "n_features", "weight", "score", "rank")
