"""Line dedup: lines that many documents share stay in one document only.

Normalised lines are exploded and hashed to 128 bits, the distinct documents of
each hash are counted in two aggregation steps (so a line found in a third of
all documents is summed up before it is shuffled), and each document is put
together again by line position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small, unused, whole

STRIPPED = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(STRIPPED)))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, drop array<int>): the positions that each document loses.

    A key counts a ``doc_id`` once however often it or its row is repeated; a
    row whose doc_id is null adds to no count, and loses the lines that are
    common among the others.
    """
    lines = cut(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(whole("text"), "\n")).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", _key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Written before the join: broadcast if it is small, and else the rows of a very common line can be split.
    common = cut(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("kept_in"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "kept_in")
    )
    return (
        lines.join(small(common, F.lit(40)), ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("kept_in")))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias("drop"))
    )


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs``, with kept_text, n_lines and n_dropped after them.

    Null and empty texts are one empty line; null ids count for no line. Lines
    are compared and put together whole, however long. Repeated rows lose the
    same lines and stay repeated; of the documents with a common line that with
    the largest doc_id keeps it. An empty table gives an empty one. Columns of
    ``docs`` named like the three new ones are replaced, others never touched.
    """
    key, h, drop, lines = (unused(docs, x) for x in ("id", "hash", "drop", "lines"))
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    drops = drops.select(F.col("doc_id").alias(key), F.col("text_hash").alias(h), F.col("drop").alias(drop))
    own = [c for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")]
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h))
    joined = docs.select(*own).join(drops.hint("shuffle_hash"), same, "left").withColumn(lines, F.split(whole("text"), "\n"))
    kept = F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda i: F.get(F.col(lines), i)))
    return joined.select(
        *own,
        F.when(F.col(drop).isNull(), whole("text")).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS kept_in FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.kept_in AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
