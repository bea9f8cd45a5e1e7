"""Ranks over a whole table without a one-task window: range partitions, and the counts of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import checkpointed

#: What ``monotonically_increasing_id`` has for the rows of one partition.
_ROWS = 1 << 33


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with ``rank`` (1, 2, 3 ... by ``order``, ties in any order): as row_number over the whole table.

    Rows are sorted into range partitions, which are written; a row's rank is its
    place in its partition and the rows of all partitions before, a number for
    each partition. Equal rows are spread by a random number, so that many of
    them don't fall into one partition.
    """
    parts = checkpointed(df.withColumn("_tie", F.rand()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie"))
    placed = parts.withColumn("_at", F.monotonically_increasing_id())
    part = F.floor(F.col("_at") / _ROWS).cast("int")
    sizes = sorted(map(tuple, placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()))  # a row for each partition
    before, total = [0] * (sizes[-1][0] + 1 if sizes else 1), 0
    for p, n in sizes:
        before[p], total = total, total + n
    starts = df.sparkSession.createDataFrame([(before,)], "_before array<long>")
    return placed.join(F.broadcast(starts)).withColumn(rank, F.col("_at") % _ROWS + 1 + F.get("_before", part)).drop("_at", "_before")


def with_ties(df: DataFrame, order: list[Column], values: list[str], rank: str = "rank", method: str = "min") -> DataFrame:
    """``df`` with ``rank``: rows that are equal in ``values`` (what ``order`` sorts by) share their least rank, the largest or the mean one (``method`` min, max, average).

    Only the distinct values are ranked, by the counts of those before.
    """
    n = df.groupBy(*values).agg(F.count("*").alias("_n"))
    place = counted_before(n, order, "_n", "_less")
    first = F.col("_less") + 1
    value = {"min": first, "max": F.col("_less") + F.col("_n"), "average": first + (F.col("_n") - 1) / 2}[method]
    ranks = place.select(*[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)], value.alias(rank))
    same = [F.col(v).eqNullSafe(F.col(f"_v{i}")) for i, v in enumerate(values)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.join(ranks, on).drop(*[f"_v{i}" for i in range(len(values))])


def counted_before(df: DataFrame, order: list[Column], amount: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of the long column ``amount`` over the rows before, by ``order`` (an exclusive running sum over the whole table)."""
    parts = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = parts.withColumn("_at", F.monotonically_increasing_id())
    part = F.floor(F.col("_at") / _ROWS).cast("int")
    placed = placed.withColumn("_p", part)
    sums = sorted(map(tuple, placed.groupBy("_p").agg(F.sum(amount).alias("n")).collect()))  # a row for each partition
    before, total = [0] * (sums[-1][0] + 1 if sums else 1), 0
    for p, n in sums:
        before[p], total = total, total + n
    starts = df.sparkSession.createDataFrame([(before,)], "_before array<long>")
    own = F.coalesce(F.sum(amount).over(Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_own", own).join(F.broadcast(starts)).withColumn(out, F.col("_own") + F.get("_before", "_p")).drop("_at", "_p", "_own", "_before")


def percentile_ranks(df: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """``df`` with ``out``: the share of rows with a value as large or less, in per cent; null for a null value, which isn't counted."""
    known = df.where(F.col(value).isNotNull())
    n = known.agg(F.count("*").alias("_total"))
    x = with_ties(known, [F.col(value).asc()], [value], out, "max").join(F.broadcast(n))
    x = x.withColumn(out, F.col(out) / F.col("_total") * 100).drop("_total")
    return x.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))
