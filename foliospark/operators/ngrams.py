"""Character n-grams of texts, counted over Arrow batches, and the singular directions of their weights.

A row of counts is an id with two packed columns, the numbers of its n-grams in
order (``f``) and a value for each (``v``), so that passes over them cost Spark
no work for each entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..plans.stored import stored

#: Bytes of texts, and entries of rows, that a task works on at once.
TEXTS, ENTRIES = 1 << 20, 1 << 20
#: Words that are cut at once, and entries of the table of steps between beginnings of n-grams; a larger one is searched.
WORDS, TABLE = 100_000, 1 << 24
NUMBER, COUNT, WEIGHT = "<u4", "<u4", "<f8"
#: Repeated ids that may be broadcast.
REPEATED = 100_000


def _slices(batch: pa.RecordBatch, size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes of the column t, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = np.flatnonzero(np.diff(ends // size, prepend=0, append=-1)) if len(ends) else np.zeros(0, np.int64)
    begin = 0
    for end in at:
        if end > begin:
            yield batch.slice(begin, end - begin)
            begin = int(end)
    if begin < len(batch):
        yield batch.slice(begin)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and word number of each word between runs of ASCII blanks (Java's \\s), and the distinct words."""
    parts = pc.ascii_split_whitespace(texts)
    coded = pc.list_flatten(parts).dictionary_encode()
    row, code = pc.list_parent_indices(parts).to_numpy(), coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    there = code != empty if empty >= 0 else slice(None)
    return row[there], code[there], coded.dictionary


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, n, lo, hi: how often a word is in a part of the rows id, t; two different ids that have it, or one twice."""
    for part in (p for b in batches for p in _slices(b, 4 * TEXTS)):
        ids = part.column("id").dictionary_encode(null_encoding="encode")
        row, code, words = words_of(part.column("t"))
        id_ = ids.indices.to_numpy()[row]
        lo, hi = np.full(len(words), len(ids.dictionary)), np.full(len(words), -1)
        np.minimum.at(lo, code, id_)
        np.maximum.at(hi, code, id_)
        found = np.flatnonzero(hi >= 0)
        n = np.bincount(code, minlength=len(words))[found]
        columns = [words.take(pa.array(found)), pa.array(n), ids.dictionary.take(pa.array(lo[found])), ids.dictionary.take(pa.array(hi[found]))]
        yield pa.RecordBatch.from_arrays(columns, ["w", "n", "lo", "hi"])


def _padded(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, each between two blanks, and where each word begins (and the last one ends)."""
    joined = pc.binary_join_element_wise("", words, "", " ")
    ends = np.frombuffer(joined.buffers()[1], "<i4")[len(joined)] if len(joined) else 0
    data = str(memoryview(joined.buffers()[2])[:ends], "utf-8") if ends else ""
    return np.frombuffer(data.encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2)])


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct key is, and the keys' numbers in order."""
    if keys.max(initial=0) >= TABLE:
        return np.unique(keys, return_index=True, return_inverse=True)[1:]
    there = np.zeros(int(keys.max(initial=0)) + 1, bool)
    there[keys] = True
    of = (np.cumsum(there) - 1)[keys]
    one = np.zeros(int(there.sum()) if len(keys) else 0, np.int64)
    one[of] = np.arange(len(keys))
    return one, of


def gram_counts(sizes: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """gram, n, lo, hi of rows w, n, lo, hi: the n-grams of about WORDS words at once, each word with a blank around it."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        letters, begin = _padded(table["w"].combine_chunks())
        length = np.diff(begin)
        word, end = np.repeat(np.arange(len(length)), length), np.repeat(begin[1:], length)
        ids = pa.chunked_array([*table["lo"].chunks, *table["hi"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode")
        two, n = ids.indices.to_numpy().reshape(2, -1), table["n"].to_numpy()
        least, most = two.min(0), two.max(0)
        at, code = np.unique(letters, return_inverse=True)
        base, name = len(at), code.astype(np.int64)
        for k in range(1, sizes[1] + 1):
            start = np.flatnonzero(np.arange(len(letters)) + k <= end)
            if k > 1:  # a beginning's number and the next letter's make a new number
                name = np.concatenate([name[: len(letters) - k + 1] * base + code[k - 1 :], np.zeros(k - 1, np.int64)])
            first, of = _numbered(name[start])
            name = np.zeros(len(letters), np.int64)
            name[start] = of
            if k < sizes[0] or not len(first):
                continue
            lo, hi = np.full(len(first), len(ids.dictionary)), np.full(len(first), -1)
            np.minimum.at(lo, of, least[word[start]])
            np.maximum.at(hi, of, most[word[start]])
            total = np.bincount(of, n[word[start]], len(first)).astype(np.int64)
            grams = [letters[i : i + k].tobytes().decode("utf-32-le") for i in start[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(total), ids.dictionary.take(pa.array(lo)), ids.dictionary.take(pa.array(hi))], ["gram", "n", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= WORDS:
                yield from counted(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from counted(pa.Table.from_batches(held))

    return run


class Finder:
    """The n-grams of a list in words, letter by letter through the tree of their beginnings."""

    def __init__(self, names: list[str]) -> None:
        letters = sorted(set("".join(names)))
        self.code = np.zeros(0x110000, np.int32)  # 0: a letter of no n-gram
        self.code[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        self.width, self.depth = len(letters) + 1, max(map(len, names), default=0)
        # Node 0 leads nowhere, node 1 is the root.
        nodes, steps = {"": 1}, {}
        for gram in names:
            for k in range(1, len(gram) + 1):
                if gram[:k] not in nodes:
                    nodes[gram[:k]] = len(nodes) + 1
                    steps[nodes[gram[: k - 1]] * self.width + int(self.code[ord(gram[k - 1])])] = nodes[gram[:k]]
        self.name = np.full(len(nodes) + 1, -1, np.int32)
        self.name[[nodes[g] for g in names]] = np.arange(len(names))
        self.named = sorted({len(g) for g in names})
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int32)
        self.table = None
        if (len(nodes) + 1) * self.width <= TABLE:
            self.table = np.zeros((len(nodes) + 1) * self.width, np.int32)
            self.table[self.keys] = self.to

    def _next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[node * np.int32(self.width) + code]
        key = node.astype(np.int64) * self.width + code
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.to[place], 0).astype(np.int32)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's n-grams begin (and the last ones end), and the n-grams, as often as they occur in a word with a blank around it.

        No n-gram has two blanks in a row, so that none goes from a word to the next.
        """
        letters, begin = _padded(words)
        if not self.named:
            return np.zeros(len(begin), np.int64), np.zeros(0, np.int64)
        code = self.code[letters]
        node, found = np.ones(len(code), np.int32), np.full((len(code), len(self.named)), -1, np.int32)
        for k in range(1, min(self.depth, len(code)) + 1):
            node = self._next(node[: len(code) - k + 1], code[k - 1 :])
            if k in self.named:
                found[: len(node), self.named.index(k)] = self.name[node]
        there = np.flatnonzero(found.ravel() >= 0)
        return np.searchsorted(there, begin * len(self.named)), found.ravel()[there].astype(np.int64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... for ``size`` numbers, of each range in turn."""
    return np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)


def packed(ids: pa.Array, row: np.ndarray, f: np.ndarray, v: np.ndarray, kind: str) -> pa.RecordBatch:
    """Rows of those of ``ids`` that have entries; ``row`` is in order."""
    n = np.bincount(row, minlength=len(ids))
    there = np.flatnonzero(n)
    ends = np.concatenate([[0], np.cumsum(n[there])])

    def column(x: np.ndarray, kind: str) -> pa.Array:
        x = np.ascontiguousarray(x, dtype=kind)
        return pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((ends * x.itemsize).astype("<i4")), pa.py_buffer(x)])

    return pa.RecordBatch.from_arrays([ids.take(pa.array(there)), column(f, NUMBER), column(v, kind)], ["id", "f", "v"])


def _raw(column: pa.Array, kind: str) -> np.ndarray:
    if not len(column):
        return np.zeros(0, kind)
    begin, end = np.frombuffer(column.buffers()[1], "<i4")[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], np.uint8)[begin:end].view(kind) if end > begin else np.zeros(0, kind)


def entries(batch: pa.RecordBatch, kind: str, idf: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, sizes of rows, f and v, about ENTRIES of them at once; with ``idf`` v are counts and made l2-normalised weights."""
    size = pc.binary_length(batch.column("f")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    f, v = _raw(batch.column("f"), NUMBER), _raw(batch.column("v"), kind)
    ends = np.concatenate([[0], np.cumsum(size)])
    cuts = [*np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, ENTRIES))), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if ends[b] > ends[a]:
            n, g, x = size[a:b], f[ends[a] : ends[b]].astype(np.int64), v[ends[a] : ends[b]]
            if idf is not None:
                x = x * idf[g]
                x = x / np.repeat(np.sqrt(np.bincount(np.repeat(np.arange(b - a), n), x * x, b - a)), n)
            yield int(a), n, g, x


def _row_counts(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, most = Finder(names), len(names)
        for part in (p for b in batches for p in _slices(b)):
            row, code, words = words_of(part.column("t"))
            begin, grams = find(words)
            both, n = np.unique(row.astype(np.int64) * max(len(words), 1) + code, return_counts=True)
            row, code = np.divmod(both, max(len(words), 1))
            size = begin[code + 1] - begin[code]
            keys, times = np.repeat(row, size) * most + grams[_spread(begin[code], size)], np.repeat(n, size)
            if len(part) * most <= 8 * len(keys):  # most rows have a good part of the n-grams
                sums = np.bincount(keys, times, len(part) * most)
                keys = np.flatnonzero(sums)
                times = sums[keys]
            else:
                keys, at = np.unique(keys, return_inverse=True)
                times = np.bincount(at, times)
            row, f = np.divmod(keys, max(most, 1))
            yield packed(part.column("id"), row, f, times, COUNT)

    return run


def _flat(kind: str, idf: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row id, f, v for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, f, v in entries(batch, kind, idf):
                ids = batch.column("id").slice(a, len(n)).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(f.astype("i4")), pa.array(v.astype("i8" if kind == COUNT else "f8") if idf is None else v)], ["id", "f", "v"])

    return run


def _pack(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed rows of rows id, f, v with arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, v = b.column("f"), b.column("v")
            yield packed(b.column("id"), pc.list_parent_indices(f).to_numpy(), pc.list_flatten(f).to_numpy(), pc.list_flatten(v).to_numpy(), kind)

    return run


def gathered(flat: DataFrame, kind: str) -> DataFrame:
    """Packed rows of rows id, f, v, dealt by id."""
    e = flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("e"))
    e = e.select("id", F.transform("e", lambda s: s["f"]).alias("f"), F.transform("e", lambda s: s["v"]).alias("v"))
    return e.mapInArrow(_pack(kind), _schema(flat.schema["id"].dataType, "f binary, v binary"))


def _schema(id_: DataType, others: str) -> str:
    return f"id {id_.simpleString()}, {others}"


def counts(texts: DataFrame, sizes: tuple[int, int], features: int, least: int) -> tuple[list[str], np.ndarray, DataFrame]:
    """Of rows id, t: the ``features`` most frequent n-grams in ``least`` ids or more, in how many ids each is, and packed counts of each id."""
    kind = texts.schema["id"].dataType
    if least <= 2:
        # Words are counted over all texts before they are cut; of the ids, two that differ are enough to know.
        without, some = (F.col("lo").isNull() | F.col("hi").isNull()), (F.col("lo").isNotNull() | F.col("hi").isNotNull())
        two = f"n long, lo {kind.simpleString()}, hi {kind.simpleString()}"
        both = [F.sum("n").alias("n"), F.min(F.least("lo", "hi")).alias("lo"), F.max(F.greatest("lo", "hi")).alias("hi"), F.max(without).alias("no"), F.max(some).alias("some")]
        words = texts.mapInArrow(word_counts, f"w string, {two}").groupBy("w").agg(*both)
        # A null stands for itself where there are ids as well.
        words = words.select("w", "n", F.when(~F.col("no"), F.col("lo")).alias("lo"), "hi")
        found = words.mapInArrow(gram_counts(sizes), f"gram string, {two}").groupBy("gram").agg(*both)
        if least == 2:
            found = found.where((F.col("lo") < F.col("hi")) | (F.col("no") & F.col("some")))
    else:
        cut = lambda k: F.transform(F.sequence(F.lit(1), F.length("w") - k + 1), lambda i: F.substr(F.col("w"), i, F.lit(k)))
        grams = F.flatten(F.array(*[F.when(F.length("w") >= k, cut(k)).otherwise(F.array().cast("array<string>")) for k in range(sizes[0], sizes[1] + 1)]))
        padded = F.concat(F.lit(" "), "w", F.lit(" ")).alias("w")
        words = texts.select("id", F.explode(F.split("t", r"\s+")).alias("w")).where("w <> ''").groupBy("id", padded).agg(F.count("*").alias("n"))
        cuts = words.select("id", "n", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.sum("n").alias("n"))
        found = cuts.groupBy("gram").agg(F.count("*").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= least)
    names = sorted(r["gram"] for r in found.orderBy(F.desc("n"), "gram").limit(features).select("gram").collect())
    rows = stored(texts.mapInArrow(_row_counts(names), _schema(kind, "f binary, v binary")))
    again = stored(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("again")))
    n = again.count()
    if n:  # several rows of an id are one text
        again, same = F.broadcast(again) if n <= REPEATED else again.hint("merge"), F.col("id").eqNullSafe(F.col("again"))
        parts = rows.join(again, same, "left_semi").mapInArrow(_flat(COUNT), _schema(kind, "f int, v long"))
        rows = rows.join(again, same, "left_anti").unionByName(gathered(parts.groupBy("id", "f").agg(F.sum("v").alias("v")), COUNT))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(names), np.int64)
        for b in batches:
            n += np.bincount(_raw(b.column("f"), NUMBER), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype="i4")), pa.array(n)], ["f", "n"])

    in_ids = np.zeros(len(names), np.int64)
    for r in rows.select("f").mapInArrow(seen, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        in_ids[r["f"]] = r["n"]
    return names, in_ids, rows


def weights(texts: DataFrame, sizes: tuple[int, int], features: int, least: int) -> tuple[list[str], np.ndarray, DataFrame]:
    """The n-grams, the logarithmic weight of each, and packed counts, to be weighted by ``entries``."""
    names, in_ids, rows = counts(texts, sizes, features, least)
    return names, np.log((texts.count() + 1) / (in_ids + 1)) + 1, rows


def flat_weights(names: list[str], idf: np.ndarray, rows: DataFrame) -> DataFrame:
    """id, gram, weight."""
    d = rows.mapInArrow(_flat(COUNT, idf), _schema(rows.schema["id"].dataType, "f int, v double"))
    return d.select("id", F.get(F.split(F.lit("\n".join(names)), "\n"), F.col("f")).alias("gram"), F.col("v").alias("weight"))


# --- singular directions ----------------------------------------------------------

#: Directions multiplied in one pass, rows made dense at once, and stripes of a product that are added up over the cluster.
BLOCK, DENSE, STRIPES = 96, 256, 32


def _product(rows: DataFrame, kind: str, idf: np.ndarray | None, q: np.ndarray) -> np.ndarray:
    """X'X q for the rows X, in one pass."""
    size, width = q.shape
    sent = rows.sparkSession.sparkContext.broadcast(q)
    edges = np.unique(np.linspace(0, size, STRIPES + 1).astype(int))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, out, x = sent.value, np.zeros((size, width)), np.zeros((DENSE, size))
        for batch in batches:
            for _, n, f, v in entries(batch, kind, idf):
                ends = np.concatenate([[0], np.cumsum(n)])
                for a in range(0, len(n), DENSE):
                    b = min(a + DENSE, len(n))
                    g, w = f[ends[a] : ends[b]], v[ends[a] : ends[b]]
                    row = np.repeat(np.arange(b - a), n[a:b])
                    if 2 * len(g) < size:  # few n-grams: only their columns
                        columns, at = np.unique(g, return_inverse=True)
                        d = np.zeros((b - a, len(columns)))
                        d[row, at] = w
                        out[columns] += d.T @ (d @ q[columns])
                    else:
                        d = x[: b - a]
                        d[row, g] = w
                        out += d.T @ (d @ q)
                        d[row, g] = 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edges) - 1, dtype="i4")), pa.array([out[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["s", "z"])

    def added(t: pa.Table) -> pa.Table:
        z = sum(np.frombuffer(x, WEIGHT) for x in t["z"].to_pylist())
        return pa.table({"s": t["s"].slice(0, 1).cast(pa.int32()), "z": pa.array([z.tobytes()], pa.binary())})

    out = np.zeros((size, width))
    for r in rows.select("f", "v").mapInArrow(multiplied, "s int, z binary").groupBy("s").applyInArrow(added, "s int, z binary").collect():
        out[edges[r["s"]] : edges[r["s"] + 1]] = np.frombuffer(r["z"], WEIGHT).reshape(-1, width)
    sent.destroy()
    return out


def directions(multiply: Callable[[np.ndarray], np.ndarray], size: int, k: int, block: int = BLOCK, exact: float = 1e-9) -> np.ndarray:
    """The first ``k`` eigenvectors of a symmetric matrix given by its product with a block, by block Lanczos with whole reorthogonalisation.

    It ends when all residuals are within ``exact`` of the largest eigenvalue, or
    when the matrix has no more to give; directions of no weight are left out.
    """
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(size, min(size, max(block, 1)))))[0]
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    while True:
        z = multiply(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, z])
        t = basis.T @ image
        e, y = np.linalg.eigh((t + t.T) / 2)
        e, y = e[::-1][:k], y[:, ::-1][:, :k]
        found = basis @ y
        left = np.linalg.norm(image @ y - found * e, axis=0).max(initial=0) > exact * max(e[0], 0)
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        q = u[:, s > 1e-11 * max(e[0], 0)][:, : size - basis.shape[1]]
        if not q.shape[1] or (len(e) == k and not left):
            return found[:, e > 1e-14 * e[0]]
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]


def turned(rows: DataFrame, size: int, k: int, kind: str, idf: np.ndarray | None = None) -> DataFrame:
    """id, point array<double>: the rows along their first ``k`` singular directions."""
    turn = directions(lambda q: _product(rows, kind, idf, q), size, max(1, min(k, size - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, f, v in entries(batch, kind, idf):
                ends = np.concatenate([[0], np.cumsum(n)])
                points = np.array([v[i:j] @ turn[f[i:j]] for i, j in zip(ends, ends[1:], strict=False)]).reshape(-1, turn.shape[1])
                whole = np.arange(len(n) + 1, dtype="i4") * turn.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, len(n)), pa.ListArray.from_arrays(pa.array(whole), pa.array(points.ravel()))], ["id", "point"])

    return rows.mapInArrow(run, _schema(rows.schema["id"].dataType, "point array<double>"))
