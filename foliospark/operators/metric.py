"""Exact neighbour searches over vectors: cells around pivots, which the triangle inequality keeps apart.

Each vector goes to the nearest of at most ``CELLS`` pivots. Of a cell the least
and the largest distance to some reference pivots are known, hence bounds of the
distance of any two of its and another cell's vectors; only pairs of cells that may
hold what is looked for meet. A cell is dealt to blocks of a bounded number of
rows, a block is packed into one row, and a task compares two blocks as matrices.
Pivots and bounds come from all rows or only decide how fast it goes: results are
the same with any pivots. The driver holds a row for each cell.

How much is skipped depends on the vectors: in the plane, or with close groups,
nearly all pairs of cells; with directions that are spread evenly over many
dimensions, none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored

#: Rows of a block, cells at most, references, and vectors of the sample that pivots come from, for each.
BLOCK, CELLS, REFERENCES, SAMPLE = 4096, 2048, 32, 20
#: Rows of a matrix that is compared at once.
TILE = 512
SLACK = 1e-6


class Block(NamedTuple):
    ids: np.ndarray
    v: np.ndarray
    extra: np.ndarray  # a row for each extra column


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences where there are few dimensions (so that they are the same whichever block a point is in)."""
    if a.shape[1] <= 8:
        return np.sqrt(sum((a[:, None, j] - b[None, :, j]) ** 2 for j in range(a.shape[1])))
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Index(NamedTuple):
    """``rows``: i, v, cell and extra columns, written; ``near`` and ``far`` have a row for each cell and a column for each reference."""

    rows: DataFrame
    extra: list[str]
    size: int
    blocks: np.ndarray  # of each cell
    near: np.ndarray
    far: np.ndarray

    def apart(self) -> np.ndarray:
        """A lower bound of the distances between any two cells."""
        out = np.zeros((len(self.blocks), len(self.blocks)))
        for j in range(self.near.shape[1]):
            gap = self.near[:, j][:, None] - self.far[:, j][None, :]
            np.maximum(out, np.maximum(gap, gap.T), out=out)
        return np.maximum(out * (1 - SLACK) - SLACK, 0)

    def within(self) -> np.ndarray:
        """An upper bound of the distances between any two cells."""
        out = np.full((len(self.blocks), len(self.blocks)), np.inf)
        for j in range(self.near.shape[1]):
            np.minimum(out, self.far[:, j][:, None] + self.far[:, j][None, :], out=out)
        return out * (1 + SLACK) + SLACK

    def _packed(self, rows: DataFrame | None) -> DataFrame:
        """block, cell, ids, v, extra: a row for each block."""
        first, extra = self._first(), self.extra
        x = (self.rows if rows is None else rows).select("i", "cell", F.pmod(F.xxhash64("i"), F.get(F.array(*map(F.lit, self.blocks.tolist())), F.col("cell"))).cast("int").alias("salt"), "v", *[F.col(c).cast("double").alias(c) for c in extra])

        def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches([*batches]).combine_chunks()
            column = lambda c: t[c].combine_chunks()
            kept = [np.asarray(column(c)) for c in extra]
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array([int(first[key[0].as_py()]) + key[1].as_py()], pa.int32()), pa.array([key[0].as_py()], pa.int32()), one(np.asarray(column("i")), pa.int64()), one(np.asarray(column("v").flatten()), pa.float64()), one(np.concatenate([np.zeros(0), *kept]), pa.float64())], ["block", "cell", "ids", "v", "extra"])

        return x.groupBy("cell", "salt").applyInArrow(pack, "block int, cell int, ids array<long>, v array<double>, extra array<double>")

    def _first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.blocks)])

    def _meet(self, wanted: np.ndarray, rows: DataFrame | None) -> DataFrame:
        """own, other, ids, v, extra: each block (``own``) for each block (``other``) of the cells that it meets."""
        first, wanted = self._first(), wanted | wanted.T

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    own, cell = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                    others = np.concatenate([np.zeros(0, np.int64), *[np.arange(first[c], first[c + 1]) for c in np.flatnonzero(wanted[cell])]])
                    for k in range(0, len(others), 8):
                        o = others[k : k + 8]
                        at = pa.array(np.full(len(o), r))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), own, np.int32)), pa.array(o.astype(np.int32)), *[batch.column(c).take(at) for c in (2, 3, 4)]], ["own", "other", "ids", "v", "extra"])

        return self._packed(rows).mapInArrow(meet, "own int, other int, ids array<long>, v array<double>, extra array<double>")

    def pairs(self, wanted: np.ndarray, run: Callable[[Block, Block | None], Iterator[dict]], schema: str, rows: DataFrame | None = None) -> DataFrame:
        """What ``run`` has for each pair of blocks of ``wanted`` cells (a symmetric matrix), each once; the second is None for a block and itself.

        ``rows`` stands for ``self.rows`` if extra columns have changed.
        """
        size, extra = self.size, len(self.extra)
        names = [x.split()[0] for x in schema.split(", ")]

        def compare(table: pa.Table) -> pa.Table:
            found = [b for _, b in sorted(((table["own"][r].as_py(), _block(table, r, size, extra)) for r in range(table.num_rows)), key=lambda x: x[0])]
            p, q = table["p"][0].as_py(), table["q"][0].as_py()
            out = [*run(found[0], None if p == q else found[1])] if p == q or len(found) == 2 else []
            return pa.table({n: np.concatenate([o[n] for o in out]) if out else [] for n in names}, schema=_arrow(schema))

        met = self._meet(wanted, rows).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
        return met.groupBy("p", "q").applyInArrow(compare, schema)

    def each(self, wanted: np.ndarray, run: Callable[[Block, Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``run`` has for each block and those of ``wanted`` cells, which come one after the other, the block itself among them."""
        size, extra = self.size, len(self.extra)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((b["to"][r].as_py(), b["own"][r].as_py(), _block(b, r, size, extra)) for b in batches for r in range(b.num_rows))
            for _, group in groupby(rows, key=lambda x: x[0]):
                # The block itself comes first, and once more among the others.
                yield from run(next(group)[2], (b for _, _, b in group))

        met = self._meet(wanted, None).withColumnRenamed("other", "to")
        itself = self._packed(None).select(F.col("block").alias("own"), F.col("block").alias("to"), "ids", "v", "extra")
        both = itself.withColumn("turn", F.lit(0)).unionByName(met.withColumn("turn", F.lit(1)))
        return both.repartition("to").sortWithinPartitions("to", "turn", "own").mapInArrow(stream, schema)


def _block(table: pa.Table | pa.RecordBatch, r: int, size: int, extra: int) -> Block:
    ids = np.asarray(table["ids"][r].values)
    return Block(ids, np.asarray(table["v"][r].values).reshape(len(ids), size), np.asarray(table["extra"][r].values).reshape(extra, len(ids)))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def build(points: DataFrame, extra: list[str] | None = None, block: int = BLOCK, cells: int = CELLS) -> Index | None:
    """An index of ``points`` (i long, v array<double>, all of one length, and extra columns); None of none.

    Rows with a null id or vector are left out.
    """
    extra = extra or []
    d = points.where("i is not null and v is not null").select(F.col("i").cast("long").alias("i"), F.col("v").cast("array<double>").alias("v"), *extra)
    n = d.count()
    if not n:
        return None
    k = max(1, min(cells, -(-n // block)))
    share = min(1.0, max(200, SAMPLE * k) / n)
    sample = np.array([r["v"] for r in d.where(F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").collect()]) if k > 1 else np.zeros((0, 0))
    pivots = _pivots(sample, k) if len(sample) else np.array([d.first()["v"]])
    size, references = pivots.shape[1], pivots[:REFERENCES]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten()).reshape(-1, size)
            cell = np.concatenate([np.zeros(0, np.int32), *[distances(v[t : t + TILE], pivots).argmin(axis=1).astype(np.int32) for t in range(0, len(v), TILE)]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    rows = stored(d.mapInArrow(assign, d.withColumn("cell", F.lit(0)).schema))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(references)
        count, lo, hi = np.zeros(len(pivots), np.int64), np.full((len(pivots), m), np.inf), np.zeros((len(pivots), m))
        for b in batches:
            cell, far = np.asarray(b.column(0)), distances(np.asarray(b.column(1).flatten()).reshape(-1, size), references)
            np.add.at(count, cell, 1)
            np.minimum.at(lo, cell, far)
            np.maximum.at(hi, cell, far)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, m).astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(at))), pa.array(np.repeat(count[at], m)), pa.array(lo[at].ravel()), pa.array(hi[at].ravel())], ["cell", "r", "n", "lo", "hi"])

    blocks, near, far = np.ones(len(pivots), np.int64), np.zeros((len(pivots), len(references))), np.zeros((len(pivots), len(references)))
    for c, r, m, lo, hi in rows.select("cell", "v").mapInArrow(bounds, "cell int, r int, n long, lo double, hi double").groupBy("cell", "r").agg(F.sum("n"), F.min("lo"), F.max("hi")).collect():
        blocks[c], near[c, r], far[c, r] = max(1, -(-m // (2 * block))), lo, hi
    return Index(rows, extra, size, blocks, near, far)


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` distinct centres of a sample at most, moved to their cells' means a few times; the first ones lie far apart."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(7).permutation(len(sample))]
    at, gap = [0], distances(sample, sample[:1])[:, 0]
    while len(at) < min(k, len(sample), REFERENCES):
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[at[-1:]])[:, 0])
    rest = [i for i in range(len(sample)) if i not in set(at)][: max(0, k - len(at))]
    centres = sample[at + rest]
    for _ in range(3):
        home = np.concatenate([distances(sample[t : t + TILE], centres).argmin(axis=1) for t in range(0, len(sample), TILE)])
        n = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(index: Index, k: int, cosine: bool = False, finish: Callable[[Block, list[np.ndarray]], pa.RecordBatch] | None = None, schema: str | None = None) -> DataFrame:
    """i, near: the ``k`` nearest others of each vector (fewer if there are no more), as structs d, j and the extra columns, nearest first (of several that are as far as the last one any).

    d is the distance; with ``cosine`` (of unit vectors) the negative cosine. A
    first pass over each block by itself bounds the reach of a cell: the largest
    distance of any of its vectors to its k-th neighbour. Cells further apart
    than the reach of both don't meet. ``finish`` makes something else of a
    block and its neighbours (row in the block, d, j, extra columns; nearest
    first), so that long lists needn't leave the task.
    """
    fields = ["d double", "j long", *[f"{c} double" for c in index.extra]]
    kinds = [pa.float64(), pa.int64(), *[pa.float64()] * len(index.extra)]

    def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(a @ b.T) if cosine else distances(a, b)

    def lists(a: Block, others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        best = [np.full((len(a.ids), k), np.inf), np.zeros((len(a.ids), k), np.int64), *[np.zeros((len(a.ids), k)) for _ in a.extra]]
        for b in others:
            own = np.array_equal(a.ids, b.ids)
            for t in range(0, len(a.ids), TILE):
                far, rows = measured(a.v[t : t + TILE], b.v), slice(t, t + TILE)
                if own:
                    far[np.arange(len(far)), np.arange(t, t + len(far))] = np.inf
                if not (far.min(axis=1) < best[0][rows].max(axis=1)).any():
                    continue
                both = np.hstack([best[0][rows], far])
                at = np.argpartition(both, k - 1, axis=1)[:, :k]
                for i, new in enumerate((far, b.ids, *b.extra)):
                    best[i][rows] = np.take_along_axis(np.hstack([best[i][rows], np.broadcast_to(new, far.shape)]), at, axis=1)
        x, y = np.nonzero(np.isfinite(best[0]))
        best = [x, *[c[x, y] for c in best]]
        order = np.lexsort((best[2], best[1], best[0]))
        best = [c[order] for c in best]
        yield finish(a, best) if finish is not None else as_lists(a, best)

    def as_lists(a: Block, best: list[np.ndarray]) -> pa.RecordBatch:
        x = best[0]
        rows = np.unique(x)
        near = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(best[1:], kinds, strict=True)], [f.split()[0] for f in fields])
        ends = np.append(np.searchsorted(x, rows), len(x)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a.ids[rows]), pa.ListArray.from_arrays(pa.array(ends), near)], ["i", "near"])

    cells = len(index.blocks)
    wanted = np.ones((cells, cells), bool)
    if cells > 1:

        def bound(a: Block, b: Block | None) -> Iterator[dict]:
            if b is None:
                # The k-th of the block's own; a block of fewer has no bound.
                worst = max((float(np.partition(far, k, axis=1)[:, k].max()) for t in range(0, len(a.ids), TILE) for far in [measured(a.v[t : t + TILE], a.v)]), default=0.0) if len(a.ids) > k else np.inf
                yield {"i": a.ids[:1], "d": np.array([worst])}

        own = index.pairs(np.eye(cells, dtype=bool), bound, "i long, d double").join(index.rows.select("i", "cell"), "i").groupBy("cell").agg(F.max("d").alias("d"))
        reach = np.zeros(cells)
        for c, worst in own.collect():
            reach[c] = (np.sqrt(max(0.0, 2 + 2 * worst)) if cosine else worst) * (1 + SLACK) + SLACK if np.isfinite(worst) else np.inf
        wanted = index.apart() <= np.maximum(reach[:, None], reach[None, :])
    return index.each(wanted, lists, schema or f"i long, near array<struct<{', '.join(f.replace(' ', ': ') for f in fields)}>>")
