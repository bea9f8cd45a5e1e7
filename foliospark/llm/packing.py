"""Best-fit packing of token pieces into sequences of a fixed capacity.

What is packed where depends on the piece lengths alone, so it is planned from
their histogram (``capacity`` rows at most, whatever the corpus), in runs: "the
next n pieces of length L go into bins b, b + 1, ... at offset o, q to a bin".
The pieces find their places by their rank among those of equal length, which is
counted in salted groups, so that no length is a hot key.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import PIECES, tokenized_pieces

#: Of a run: the pieces' length, their first rank and the one after their last, the first bin, pieces to a bin, where the first is put.
RUN = ["_length", "lo", "hi", "bin", "each", "_offset"]


class _Bins:
    """Ranges of equal bins, by the room they have left."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in self.ranges:
            self.ranges[room] = []
            insort(self.rooms, room)
        self.ranges[room].append((first, count))

    def tightest(self, length: int) -> int | None:
        at = bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of a range with this room."""
        first, count = self.ranges[room].pop()
        if count > most:
            self.ranges[room].append((first + most, count - most))
            count = most
        if not self.ranges[room]:
            del self.ranges[room]
            self.rooms.remove(room)
        return first, count


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The runs, and the number of bins used.

    Pieces above a third of the capacity are matched first, two to a bin at
    most: from the longest down, each takes the longest partner that still
    fits. The others then go, longest first, to the bin with the least room
    that holds them.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins, used = _Bins(), 0

    def place(length: int, count: int, first: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], rank[length] + count, first, each, offset))
        rank[length] += count
        left[length] -= count

    large = [-n for n in left if 3 * n > capacity]
    heapq.heapify(large)
    lengths = sorted(-n for n in large)
    while large:
        n = -large[0]
        if not left[n]:
            heapq.heappop(large)
            continue
        at = bisect_left(lengths, capacity - n + 1) - 1
        while at >= 0 and not left[lengths[at]]:
            lengths.pop(at)
            at -= 1
        mate = lengths[at] if at >= 0 else None
        if mate is None or mate == n and left[n] == 1:
            # Nothing fits beside it, or it is the last of its kind: try a shorter one before it stays alone.
            others = [m for m in lengths if m <= capacity - n and m != n and left[m]]
            if mate is None or not others:
                count = left[n] if mate is None else 1
                place(n, count, used, 1, 0)
                bins.add(capacity - n, used, count)
                used += count
                continue
            mate = others[-1]
        if mate == n:
            count = left[n] // 2
            place(n, 2 * count, used, 2, 0)
        else:
            count = min(left[n], left[mate])
            place(n, count, used, 1, 0)
            place(mate, count, used, 1, n)
        bins.add(capacity - n - mate, used, count)
        used += count
    for n in sorted((n for n in left if n and 3 * n <= capacity), reverse=True):
        while left[n]:
            room = bins.tightest(n)
            if room is None:
                each = capacity // n
                count = max(1, left[n] // each)
                bins.add(capacity, used, count)
                used += count
                room = capacity
            each = min(room // n, left[n])
            first, count = bins.take(room, max(1, left[n] // each))
            place(n, count * each, first, each, capacity - room)
            bins.add(room - each * n, first, count)
    return runs, used


def pack(pieces: DataFrame, capacity: int, salts: int | None = None) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``capacity``) with sequence_id and offset after its columns.

    Rows that are alike in all columns are packed one by one.
    """
    spark = pieces.sparkSession
    own = pieces.columns
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").count()
    # A window over capacity * salts rows at most.
    base = counts.withColumn("_base", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select(F.col("length").cast("int").alias("length"), "_salt", F.coalesce("_base", F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    r = F.broadcast(spark.createDataFrame(runs, ", ".join(f"{c} long" for c in RUN)))
    ranked = (
        salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*own)) - 1)
        .join(F.broadcast(base), ["length", "_salt"])
        .withColumn("_rank", F.col("_n") + F.col("_base"))
    )
    placed = ranked.join(r, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    return placed.select(
        *own, (F.col("bin") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset")
    )


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and then ``end_id``; a null text is empty,
    so that every row makes a piece. Only documents longer than ``capacity`` are
    cut, into as many pieces as they need. Repeated rows are packed as often as they come; an empty table packs
    into nothing. Of pieces that are equally long any may come first. Other
    columns than doc_id and text play no part, whatever their names.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer, capacity, end_id))
    return pack(pieces, capacity).select(*[c.split()[0] for c in PIECES.split(", ")], "sequence_id", "offset")
