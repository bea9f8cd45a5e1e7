"""Seeded samples of a bounded size, and both ends of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that decide, and bits of them that one histogram looks at.
BITS, ROUND = 60, 10


def draw(keys: list[str], seed: int) -> Column:
    """BITS bits of the md5 of the seed and the keys as text, joined by colons (null: nothing)."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows of ``df`` (all, if there are fewer): those with the least hashes of ``seed`` and ``keys``.

    The same rows whatever the partitioning, and of a table with more rows mostly
    the same ones. The bound comes from histograms of ever more bits, 1,024
    classes each, of the rows that agree with the bound so far; a filter then
    draws, and nothing is sorted. Rows that tie with the last one in all keys
    (repeated ones) are drawn with it.
    """
    h, bound, before = draw(keys, seed), 0, 0
    if n <= 0:
        return df.limit(0)
    for shift in range(BITS - ROUND, -1, -ROUND):
        group = F.shiftright(h, shift)
        inside = df.where(F.shiftright(h, shift + ROUND) == bound)
        counts = sorted(map(tuple, inside.groupBy((group % (1 << ROUND)).alias("k")).agg(F.count("*").alias("n")).collect()))
        if before + sum(c for _, c in counts) <= n:
            return df.where(F.shiftright(h, shift + ROUND) <= bound)
        for k, c in counts:
            if before + c >= n:
                break
            before += c
        bound = bound << ROUND | k
        if before + c == n:
            return df.where(group <= bound)
    return df.where(h <= bound)


def ends(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """``df`` with end (top, bottom): the ``n`` rows with the largest ``by`` and the ``n`` with the least of the rest; null values are left out."""
    known = df.where(F.col(by).isNotNull())
    top = known.orderBy(F.desc(by), *ties).limit(n).withColumn("end", F.lit("top"))
    bottom = known.orderBy(F.asc(by), *[F.desc(t) for t in ties]).limit(n).withColumn("end", F.lit("bottom"))
    keys = [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in ties]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    taken = F.broadcast(top.select(*[F.col(t).alias(f"_{t}") for t in ties]))
    return top.unionByName(bottom.join(taken, on, "left_anti"))
