"""Expressions and helpers that several training-data operators share.

Every operator here treats ``(doc_id, xxhash64(text))`` as the identity of a
row, so a null or repeated ``doc_id`` never merges different texts, and rows
that are repeated as a whole come out as often as they went in.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a side that may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 48 << 20
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. ASCII texts take the fast built-in path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def whole(c: Column | str) -> Column:
    """The text, or an empty one where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column, separators: str) -> Column:
    """The pieces of ``c`` between runs of ``separators``, none of them empty."""
    return F.array_remove(F.split(c, separators), "")


def in_training(doc_id: Column, modulus: int, held_out: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` isn't ``held_out``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) != held_out


def hex64(c: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores after it, such that ``df`` has no column of that name, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_folder(spark: SparkSession) -> None:
    """Sees to it that there is a checkpoint folder: the session's ``spark.checkpoint.dir``.

    Where that isn't set, local mode gets a temporary folder; on a cluster, whose
    machines wouldn't share it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: later jobs read it instead of computing it anew."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if its measured size is within ``limit``; else left to a shuffled join."""
    each = row_bytes if row_bytes is not None else F.lit(64)
    size = df.agg(F.sum(each)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("shuffle_hash")


def count_floor(totals: DataFrame, column: str, most: int) -> int:
    """The least count that ``most`` rows at most reach or exceed, by a histogram of about a thousand classes.

    So the most frequent are found by a filter, where a sort with a limit would
    bring the candidates of all partitions to one task. If even the highest class
    has more rows, the floor is above it.
    """
    classes = totals.groupBy(F.floor(F.log2(column) * 16).alias("k")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("k")).collect()
    floor, held = (classes[0]["hi"] + 1 if classes else 1), 0
    for c in classes:
        held += c["n"]
        if held > most:
            break
        floor = c["lo"]
    return int(floor)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
