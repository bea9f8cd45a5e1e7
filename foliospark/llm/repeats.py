"""Suffix-array dedup: bytes of every string of MIN_BYTES bytes that starts anywhere else too.

Strings of that length can be equal only if they have the same minimiser (their
K-byte piece with the least hash, the leftmost of equal ones), so the windows of
all documents fall into groups by minimiser, and only within a group is anything
compared:

1. Each document's windows are cut into stretches that share one minimiser. A
   stretch whose minimiser occurs once only can't repeat.
2. A stretch that occurs twice as it stands repeats whole: the inside of long
   copies is settled by counting hashes.
3. The rest, the stretches at the ends of copies and one of each repeated
   stretch beside them, are fetched as bytes and compared by a suffix array: on
   the Burrows-Wheeler transform of a bounded block of whole groups, intervals
   are extended backwards, breadth first, which finds the common prefixes by
   increasing length; it stops at the minimum length. What is still together
   then has a longer common prefix, that is, repeats.
4. A group too large for a block (one very common passage among many different
   neighbours) has its windows counted over the cluster: by 128 bits of hash
   first, and those that meet so by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole
from .common import small as within
from .encode import tidy

MIN_BYTES, K = 200, 40
#: Bytes of stretches that one suffix array is built of, and thus of a group that is compared so.
BLOCK = 2 << 20
_RND = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of a buffer, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASES[0]) -> None:
        n = len(data)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.sums = np.zeros(n + 1, np.uint64)
        powers = np.full(n, base, np.uint64)
        self.inverse = np.full(n + 1, inverse, np.uint64)
        if n:
            powers[0] = 1
        self.inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        np.cumsum(_RND[data] * powers, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by minima from both ends of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def stretches(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first window, one after the last, minimiser's hash, hash of the stretch's bytes) of documents that lie one after another in ``data``, up to ``ends``.

    Windows start at positions relative to ``data``; those that cross the end of
    a document don't count.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data)
    if n < length:
        return none
    hashes = Hashes(data)
    starts = np.arange(n - k + 1)
    pieces = hashes.of(starts, starts + k)
    # The hash's high bits, and the position for ties. Positions wrap far beyond any window's size.
    wrap = 24
    if n >> wrap:
        raise ValueError("more bytes at once than positions can tell apart")
    marked = (pieces >> np.uint64(wrap) << np.uint64(wrap)) | starts.astype(np.uint64)
    least = (_sliding_min(marked, length - k + 1) & np.uint64((1 << wrap) - 1)).astype(np.int64)
    windows = np.arange(len(least))
    doc = np.searchsorted(ends, windows, side="right")
    inside = windows + length <= ends[doc]
    first = np.flatnonzero(inside & np.append(True, (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])))
    if not len(first):
        return none
    breaks = np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1]))
    edges = np.append(np.flatnonzero(breaks), len(least))
    last = edges[np.searchsorted(edges, first, side="right")]
    at = least[first]
    body = hashes.of(first, last - 1 + length)
    return doc[first], first, last, pieces[at], _mix(body + (at - first).astype(np.uint64))


# --- suffix array, Burrows-Wheeler transform, interval expansion ------------


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (0 to 511) or more: seven at a time in one word, then by doubling the ranks."""
    n, done = len(data), 7
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.append(data.astype(np.int64), np.zeros(done, np.int64))
    key = np.zeros(n, np.int64)
    for i in range(done):
        key = (key << 9) | padded[i : i + n]
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
        if done >= depth or rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: max(0, n - done)] = rank[done:] + 1
        key = rank * (n + 2) + second
        done *= 2


def long_common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in ``order`` shares its first ``length`` symbols with the one before it.

    Breadth-first backward extension (after Beller, Gog, Ohlebusch and
    Schnattinger): a round holds the intervals of all strings w whose common
    prefix value, |w|, is new at the interval's end. Extending each by every
    symbol before its suffixes gives the intervals of the next length, of
    which only those that end at an unset border are kept. After round
    ``length`` - 1 the borders still unset have longer common prefixes.
    """
    n = len(data)
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    if n < 2:
        return unset[:n]
    bwt = data[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    # Where the suffix that starts one symbol earlier stands.
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)
    symbols, counts = np.unique(bwt, return_counts=True)
    spread = by_symbol + np.repeat(np.arange(len(symbols)), counts) * (n + 1)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        parts = []
        width = hi - lo
        single = width == 1
        if single.any():
            x = back[lo[single]]
            parts.append((x, x + 1))
        narrow = ~single & (width <= 256)
        if narrow.any():
            # Their suffixes one by one; those that one symbol leads back from stand side by side.
            w, first = width[narrow], lo[narrow]
            ends = np.cumsum(w)
            at = np.arange(ends[-1]) + np.repeat(first - (ends - w), w)
            which = np.repeat(np.arange(len(w)), w)
            to = np.sort(which * n + back[at])
            own, to = to // n, to % n
            # by_symbol[to] is the suffix that was extended; bwt of it the symbol.
            c = bwt[by_symbol[to]]
            new = np.append(True, (own[1:] != own[:-1]) | (c[1:] != c[:-1]))
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(to)) - 1
            parts.append((to[start], to[stop] + 1))
        wide = width > 256
        for c in range(len(symbols)) if wide.any() else ():
            x = np.searchsorted(spread, lo[wide] + c * (n + 1))
            y = np.searchsorted(spread, hi[wide] + c * (n + 1))
            parts.append((x[y > x], y[y > x]))
        lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        fresh = unset[hi]
        lo, hi = lo[fresh], hi[fresh]
        unset[hi] = False
    return unset[:n]


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its windows of ``length`` bytes start anywhere else in the parts too."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for i, p in enumerate(parts):
        data[ends[i] - 1 - len(p) : ends[i] - 1] = np.frombuffer(p, np.uint8).astype(np.int64) + 1
        data[ends[i] - 1] = 0
    # Ends of parts sort first; strings that span one are told apart by their start below.
    order = suffix_array(data, length)
    same = long_common_prefixes(data, order, length)
    hit = same.copy()
    hit[:-1] |= same[1:]
    room = np.repeat(ends - 1, sizes + 1) - np.arange(len(data)) >= length
    # Neighbours in a run of equal strings are all whole windows, or none is: an end inside would be part of the common prefix.
    flags = np.zeros(len(data), bool)
    flags[order[hit]] = True
    flags &= room
    return [flags[e - 1 - s : max(e - 1 - s, e - length)] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


# --- over the cluster --------------------------------------------------------

STRETCH = "doc_id long, text_hash long, first long, last long, piece long, body long"


def _buffers(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[int], np.ndarray, np.ndarray, int]]:
    """Runs of rows whose bytes come to about ``most``: (batch, row numbers, bytes, ends, offset of the first row's bytes). Longer texts come in overlapping pieces."""
    overlap = MIN_BYTES - 1
    for batch in batches:
        texts = batch.column(column)
        rows, held, size = [], [], 0
        for i, t in enumerate(texts):
            b = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and len(t.as_buffer()) else np.zeros(0, np.uint8)
            if len(b) > most:
                for at in range(0, len(b) - overlap, most):
                    piece = b[at : at + most + overlap]
                    yield batch, [i], piece, np.array([len(piece)]), at
                continue
            rows.append(i)
            held.append(b)
            size += len(b)
            if size >= most:
                yield batch, rows, np.concatenate(held), np.cumsum([len(x) for x in held]), 0
                rows, held, size = [], [], 0
        if rows:
            yield batch, rows, np.concatenate(held), np.cumsum([len(x) for x in held]), 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def document_stretches(docs: DataFrame, length: int = MIN_BYTES, k: int = K) -> DataFrame:
    """A row for each stretch: doc_id, text_hash, windows [first, last), piece and body hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, data, ends, offset in _buffers(batches, 2):
            doc, first, last, piece, body = stretches(data, ends, length, k)
            begin = (np.append(0, ends[:-1]) - offset)[doc]
            at = pa.array(np.array(rows, np.int64)[doc])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(first - begin), pa.array(last - begin), _signed(piece), _signed(body)], [x.split()[0] for x in STRETCH.split(", ")]
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), whole("text").cast("binary").alias("text"))
    return d.where(F.octet_length("text") >= length).mapInArrow(tidy(run), STRETCH)


def _compare(length: int):
    """Stretches of whole groups, in the order of their pieces, to the windows in them that repeat."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([h[4] for h in held], length)
        out: list[list] = [[], [], [], []]
        for (doc, h, first, _, _), flags in zip(held, found, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for column, value in zip(out, (doc, h, first + a, first + b), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "text_hash", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now = 0, None
        for batch in batches:
            for piece, *row in zip(*(batch.column(i).to_pylist() for i in (4, 0, 1, 2, 3, 5)), strict=True):
                if piece != now and size >= BLOCK // 16:
                    yield settle(held)
                    held, size = [], 0
                now = piece
                held.append(tuple(row))
                size += len(row[-1])
        if held:
            yield settle(held)

    return run


def _windows(length: int, whole_bytes: bool):
    """A row for each window of a stretch: doc_id, text_hash, first, two hashes, and its bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column(5)[row].as_buffer(), np.uint8)
                at = np.arange(len(data) - length + 1)
                h1, h2 = (Hashes(data, b).of(at, at + length) for b in _BASES)
                n = len(at)
                same = lambda c: pa.array([batch.column(c)[row].as_py()] * n, pa.int64())
                columns = [same(0), same(1), pa.array(at + batch.column(2)[row].as_py()), _signed(h1), _signed(h2)]
                if whole_bytes:
                    columns.append(pa.array([data[i : i + length].tobytes() for i in at], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "first", "h1", "h2", *(["w"] if whole_bytes else [])])

    return run


def _counted(large: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, first, last): windows of ``large`` that occur twice in it, byte for byte."""
    schema = "doc_id long, text_hash long, first long, h1 long, h2 long"
    twice = large.mapInArrow(_windows(length, False), schema).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    likely = large.mapInArrow(_windows(length, True), schema + ", w binary").join(within(cut(twice), F.lit(32)), ["h1", "h2"])
    real = likely.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return likely.join(within(cut(real), F.lit(length + 32)), "w").select("doc_id", "text_hash", "first", (F.col("first") + 1).alias("last"))


def _merged(windows: DataFrame, key: list[str], length: int) -> DataFrame:
    """``key``, spans: the bytes that the windows [first, last) cover, as sorted, disjoint [start, end) ranges."""
    ranges = windows.select(*key, "first", (F.col("last") + (length - 1)).alias("end"))
    order = Window.partitionBy(*key).orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = ranges.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("first")).cast("int"))
    spans = parts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "run").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    return spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = MIN_BYTES, k: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, spans): sorted, disjoint [start, end) byte ranges of each document that has repeated strings.

    Equal rows are occurrences of their own, so that a row that is repeated as
    a whole is all repeated strings. Null and empty texts have none, and null
    ids are ids like others.
    """
    d = docs.select("doc_id", "text")
    key = ["doc_id", "text_hash"]
    # The stretches are made twice, which is cheaper than to keep them all: most of their minimisers occur once.
    found = document_stretches(d, length, k)
    often = cut(found.groupBy("piece").agg(F.count("*").alias("total"), F.min("body").alias("b0"), F.max("body").alias("b1")).where("total > 1").select("piece", (F.col("b0") != F.col("b1")).alias("open")))
    members = cut(found.join(within(often, F.lit(40)), "piece"))
    bodies = members.groupBy("piece", "body").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct("doc_id", "text_hash", "first", "last")).alias("one"))
    # Sides that are joined are written first: broadcast if small, and else only read, so that the rows of one piece can be split.
    again = cut(bodies.where("n > 1").select("piece", "body"))
    settled = members.join(within(again, F.lit(32)), ["piece", "body"]).select(*key, "first", "last")
    one = cut(bodies.where("open").select("piece", "one.*"))
    sizes = cut(one.groupBy("piece").agg(F.sum(F.col("last") - F.col("first") + (length - 1)).alias("bytes")))
    wanted = cut(one.join(within(sizes, F.lit(32)), "piece").groupBy(*key).agg(F.collect_list(F.struct("first", "last", "piece", "bytes")).alias("parts")))
    wanted = within(wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "parts"), 64 + 40 * F.size("parts"))
    texts = d.withColumn("_hash", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")))
    texts = texts.select("doc_id", F.col("_h").alias("text_hash"), whole("text").cast("binary").alias("b"), F.explode("parts").alias("p"))
    # Of rows that are repeated as a whole one will do: the others' stretches are settled above.
    fetched = texts.select(*key, "p.first", "p.last", "p.piece", F.substring("b", F.col("p.first").cast("int") + 1, (F.col("p.last") - F.col("p.first")).cast("int") + (length - 1)).alias("bytes"), F.col("p.bytes").alias("size"))
    fetched = cut(fetched.dropDuplicates([*key, "first"]))
    small = fetched.where(F.col("size") <= block).drop("size").repartition("piece").sortWithinPartitions("piece")
    compared = small.mapInArrow(tidy(_compare(length)), "doc_id long, text_hash long, first long, last long")
    windows = settled.unionByName(compared)
    large = fetched.where(F.col("size") > block).drop("size")
    if not large.isEmpty():
        windows = windows.unionByName(_counted(large, length))
    return _merged(windows, key, length)


def cut_repeats(docs: DataFrame, length: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for each row of ``docs``; kept may cut a character in two.

    Null and empty texts have no bytes, and null ids are ids like others. Texts
    are read whole. Rows that are repeated as a whole repeat one another and
    lose all from MIN_BYTES bytes on; of equal stretches none stays, as strings
    are judged on the input. An empty table gives an empty one; other
    columns play no part.
    """
    spans = cut(repeated_spans(docs, length).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "spans"))
    d = docs.select("doc_id", F.xxhash64("text").alias("_hash"), whole("text").cast("binary").alias("b"))
    j = d.join(within(spans, 64 + 24 * F.size("spans")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    n = F.octet_length("b")
    s = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(s, lambda x: x["end"]))
    ends = F.concat(F.transform(s, lambda x: x["start"]), F.array(n.cast("bigint")))
    pieces = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.hex(F.substring(F.col("b"), x["s"].cast("int") + 1, (x["e"] - x["s"]).cast("int"))))
    kept = F.when(F.col("spans").isNull(), F.col("b")).otherwise(F.unhex(F.array_join(pieces, "")))
    removed = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return j.select("doc_id", n.cast("bigint").alias("n_bytes"), removed.alias("n_removed"), F.size(s).cast("bigint").alias("n_spans"), kept.alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)
), rep AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, p FROM w JOIN rep USING (k)),
runs AS (
  SELECT doc_id, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit)
), spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT s.doc_id, s.a, s.b, substr(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0))) AS before
  FROM spans s JOIN d ON d.doc_id = s.doc_id
), t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(before, '' ORDER BY a) AS kept FROM gaps GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
