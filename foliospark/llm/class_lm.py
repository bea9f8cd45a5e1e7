"""LM scoring with a class-based bigram model (Brown et al.).

    P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))

Exchange clustering assigns words to classes. The core, every word that makes up
1 / CORE of the training tokens or more, is exchanged until no word moves. Each
other word of the vocabulary, however rare, then joins the class with the
largest gain in the same likelihood, to first order, from all its own
neighbours that are in the core. The vocabulary, its counts and its classes stay
distributed and grow with the corpus; tasks hold the HEAD most frequent words as
a cache, and whatever it doesn't hold is joined, so results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_floor, cut, in_training, unused
from .encode import Tally, blank_words, encoded, tidy

#: At most CORE words can make up 1 / CORE of the tokens each, whatever the corpus.
CORE, HEAD, CLASSES = 4096, 200_000, 64
#: The end of a text; words have no blanks, so none is equal to it.
END = " "
#: Stands for a neighbour outside the core, and for a word that tasks don't hold.
NONE = 255


class Lexicon(NamedTuple):
    """What was learnt about words: ``table`` (word, c, class) has all of them, ``words``, ``counts`` and ``classes`` the cache."""

    table: DataFrame
    words: pa.Array
    counts: np.ndarray
    classes: np.ndarray
    end: tuple[int, int]  # the end's count and class
    tokens: np.ndarray  # by class
    types: np.ndarray  # by class
    unseen: int  # the class that words belong to that no training text has
    discount: float
    n: int
    v: int

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def emission(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(w | class): c / C; in the class of unseen words (c - d) / C, and d T / C for all of them together."""
        own = cls == self.unseen
        rest = self.discount * self.types[self.unseen]
        return np.log10(np.where(c > 0, c - self.discount * own, rest) / self.tokens[cls])


def exchange(bigrams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Classes of the items (Kneser and Ney's exchange algorithm): ``bigrams`` has rows (a, b, n).

    Each item in turn, most frequent first, goes to the class that makes
    sum n(c, d) log n(c, d) - sum n(c) log n(c) [left and right] the largest,
    until none moves. Every move raises the sum, so this ends.
    """
    size = len(counts)
    k = max(1, min(k, size))
    classes = np.empty(size, np.int64)
    order = np.argsort(-counts, kind="stable")
    classes[order] = np.arange(size) % k
    if k == 1 or not len(bigrams):
        return classes
    a, b, n = bigrams[:, 0], bigrams[:, 1], bigrams[:, 2].astype(np.float64)
    right, left = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    right_at, left_at = np.searchsorted(a[right], np.arange(size + 1)), np.searchsorted(b[left], np.arange(size + 1))
    own = np.zeros(size)
    np.add.at(own, a[a == b], n[a == b])
    table = np.zeros((k, k))
    np.add.at(table, (classes[a], classes[b]), n)
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    moved = True
    while moved:
        moved = False
        for w in order:
            after, before = right[right_at[w] : right_at[w + 1]], left[left_at[w] : left_at[w + 1]]
            after, before = after[b[after] != w], before[a[before] != w]
            r = np.bincount(classes[b[after]], weights=n[after], minlength=k)
            f = np.bincount(classes[a[before]], weights=n[before], minlength=k)
            s, c = own[w], classes[w]
            table[c, :] -= r
            table[:, c] -= f
            table[c, c] -= s
            # w's neighbours stay in their rows and columns, whichever class w joins.
            rows, columns, diagonal = table.sum(axis=1) + f, table.sum(axis=0) + r, np.diag(table)
            # What changes if w joins class x: row x, column x, and the cell where both meet.
            rs, fs = np.flatnonzero(r), np.flatnonzero(f)
            gain = (xlogx(table[:, rs] + r[rs]) - xlogx(table[:, rs])).sum(axis=1) + (xlogx(table[fs] + f[fs, None]) - xlogx(table[fs])).sum(axis=0)
            gain += xlogx(diagonal + r + f + s) - xlogx(diagonal + r) - xlogx(diagonal + f) + xlogx(diagonal)
            gain -= xlogx(rows + r.sum() + s) - xlogx(rows) + xlogx(columns + f.sum() + s) - xlogx(columns)
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-6 * max(1.0, abs(gain[c])):
                best = int(c)
            table[best, :] += r
            table[:, best] += f
            table[best, best] += s
            moved |= best != c
            classes[w] = best
    return classes


def votes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after)[neighbour's class, x]: what one such neighbour adds to the likelihood, to first order, if a word joins class x."""
    t = table + 0.1
    after = np.log(t / t.sum(axis=1, keepdims=True)).T
    before = np.log(t / t.sum(axis=0, keepdims=True))
    none = np.zeros((1, len(table)))  # a neighbour outside the core
    return np.concatenate([before, none]), np.concatenate([after, none])


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): how often each word, and the end, occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in encoded(batch.column(0), blank_words):
                n = np.append(np.bincount(e.codes, minlength=len(e.words)), len(e.ends)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([e.words, pa.array([END])]), pa.array(n)], ["word", "n"])

    return train.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _framed(ids: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids with ``end`` before and after them, and whether an id is one of those ends."""
    n = len(ends)
    at = np.arange(len(ids)) + 2 * np.repeat(np.arange(n), np.diff(ends, prepend=0)) + 1
    out, frame = np.full(len(ids) + 2 * n, end, ids.dtype), np.ones(len(ids) + 2 * n, bool)
    out[at] = ids
    frame[at] = False
    return out, frame


def _core_bigrams(train: DataFrame, core: pa.Array) -> np.ndarray:
    """(item, next item, n) of core words side by side; item len(core) is the end, which stands before the first word too."""
    shared = train.sparkSession.sparkContext.broadcast(core)
    size = len(core) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for e in encoded(batch.column(0), blank_words):
                ids, frame = _framed(e.places(shared.value)[e.codes], e.ends, size - 1)
                a, b = ids[:-1], ids[1:]
                # An end is followed by the next row's beginning: that is no bigram.
                keep = (a >= 0) & (b >= 0) & ~(frame[:-1] & frame[1:] & (np.cumsum(frame)[:-1] % 2 == 0))
                tally.add(a[keep] * size + b[keep])
        keys, n = tally.sums()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    rows = train.select("text").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # (CORE + 1)^2 rows at most
    key, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("key", "n"))
    return np.stack([key // size, key % size, n], axis=1) if len(key) else np.zeros((0, 3), np.int64)


def _neighbours(train: DataFrame, core: pa.Array, core_class: np.ndarray) -> DataFrame:
    """(word, n, seen): of each word outside the core, n occurrences and the classes before and after each, two bytes an occurrence; a word has several rows."""
    shared = train.sparkSession.sparkContext.broadcast((core, np.append(core_class, NONE).astype(np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, cls = shared.value
        end = int(cls[-2])  # the last item is the end
        for batch in batches:
            for e in encoded(batch.column(0), blank_words):
                of_word = cls[e.places(core)]  # place -1 is NONE
                of_token = of_word[e.codes]
                seq, frame = _framed(of_token, e.ends, end)
                at = np.flatnonzero(~frame)
                rare = of_token == NONE
                codes, at = e.codes[rare], at[rare]
                order = np.argsort(codes, kind="stable")
                pairs = np.stack([seq[at - 1], seq[at + 1]], axis=1)[order]
                n = np.bincount(codes, minlength=len(e.words))
                some = np.flatnonzero(n)
                offsets = np.append(0, np.cumsum(2 * n[some])).astype(np.int32)
                seen = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs))])
                yield pa.RecordBatch.from_arrays([e.words.take(pa.array(some)), pa.array(n[some].astype(np.int64)), seen], ["word", "n", "seen"])

    return train.select("text").mapInArrow(tidy(run), "word string, n long, seen binary")


def _placed(neighbours: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, c, class) of each word outside the core."""
    k = len(table)
    shared = neighbours.sparkSession.sparkContext.broadcast((*votes(table), 1e-6 * np.log1p(table.sum(axis=1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after, likely = shared.value  # without a neighbour that tells: the largest class
        held: tuple[str, int, np.ndarray] | None = None

        def out(words: pa.Array, n: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
            gain = cells[:, : k + 1] @ before + cells[:, k + 1 :] @ after + likely
            return pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64)), pa.array(gain.argmax(axis=1).astype(np.int32))], ["word", "c", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.column(0).dictionary_encode()
            group, words = np.asarray(d.indices).astype(np.int64), d.dictionary
            sizes = np.asarray(pc.binary_length(batch.column(2))).astype(np.int64) // 2
            data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
            data[data == NONE] = k
            of = np.repeat(group, sizes) * (2 * k + 2)
            g = len(words)
            cells = (np.bincount(of + data[:, 0], minlength=g * (2 * k + 2)) + np.bincount(of + data[:, 1] + k + 1, minlength=g * (2 * k + 2))).reshape(g, -1).astype(np.float64)
            n = np.bincount(group, weights=np.asarray(batch.column(1)), minlength=g)
            if held is not None:
                if words[0].as_py() == held[0]:
                    n[0] += held[1]
                    cells[0] += held[2]
                else:
                    yield out(pa.array([held[0]]), np.array([held[1]]), held[2][None])
            held = (words[g - 1].as_py(), n[-1], cells[-1])
            if g > 1:
                yield out(words.slice(0, g - 1), n[:-1], cells[:-1])
        if held is not None:
            yield out(pa.array([held[0]]), np.array([held[1]]), held[2][None])

    return neighbours.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(run), "word string, c long, class int")


def lexicon(train: DataFrame, core: int = CORE, head: int = HEAD, k: int = CLASSES) -> Lexicon | None:
    """Learns words, counts and classes from the column text of ``train``; None if it has no rows. ``k`` is under 255."""
    counts = cut(word_counts(train))
    n, v, once, twice = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    if not n:
        return None
    frequent = counts.where((F.col("c") * core >= n) & (F.col("word") != END)).toArrow()  # ``core`` rows at most
    order = pc.sort_indices(frequent, [("c", "descending"), ("word", "ascending")])
    words = frequent.column("word").take(order).combine_chunks()
    end = counts.where(F.col("word") == END).first()["c"]
    sizes = np.append(np.asarray(frequent.column("c").take(order).combine_chunks()), end)
    bigrams = _core_bigrams(train, words)
    classes = exchange(bigrams, sizes, k)
    table = np.zeros((int(classes.max()) + 1,) * 2)
    np.add.at(table, (classes[bigrams[:, 0]], classes[bigrams[:, 1]]), bigrams[:, 2])
    spark = train.sparkSession
    own = spark.createDataFrame(pa.table({"word": pa.concat_arrays([words.cast(pa.string()), pa.array([END])]), "c": sizes.astype(np.int64), "class": classes.astype(np.int32)}))
    placed = cut(_placed(_neighbours(train, words, classes), table).unionByName(own))
    kinds = placed.groupBy("class").agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    tokens, types, singles = (np.zeros(len(table)) for _ in range(3))
    for r in kinds:
        tokens[r["class"]], types[r["class"]], singles[r["class"]] = r["tokens"], r["types"], r["once"]
    least = count_floor(placed, "c", head)
    top = placed.where((F.col("c") >= least) & (F.col("word") != END)).toArrow()  # ``head`` rows at most
    # Unseen words go where most words are that were seen once; without any, to the class with most words.
    unseen = int((singles if singles.any() else types).argmax())
    discount = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
    arrays = [top.column(c).combine_chunks() for c in ("word", "c", "class")]
    return Lexicon(placed, arrays[0], np.asarray(arrays[1]), np.asarray(arrays[2]), (int(end), int(classes[-1])), np.maximum(tokens, 1), np.maximum(types, 1), unseen, discount, int(n), int(v))


CODED = "n_tokens long, n_known long, base double, emitted double, classes binary"


def coded(docs: DataFrame, lex: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` and CODED of each row of ``docs``: its words' sums, and its classes in a row, the end's last.

    Tasks code the words that they hold; a text's other words, each once, are
    joined with the whole lexicon and meet the text's codes again by its row
    number, in one sort.
    """
    spark = docs.sparkSession
    rid, k, word, cls, c = (unused(docs, x) for x in ("rid", "k", "word", "cls", "c"))
    d = docs.select(*keep, F.monotonically_increasing_id().alias(rid), "text")
    shared = spark.sparkContext.broadcast(lex._replace(table=None))
    own_types = [(f.name, f.dataType.simpleString()) for f in d.schema if f.name != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in own_types) + f", {k} int, {word} string, n_tokens long, n_known long, base double, emitted double, classes binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Lexicon = shared.value
        held_c, held_class = np.append(m.counts, 0), np.append(m.classes, NONE).astype(np.uint8)
        for batch in batches:
            for e in encoded(batch.column(batch.num_columns - 1), blank_words):
                rows = batch.slice(e.first, len(e.ends))
                place = e.places(m.words)
                of_token, held = held_class[place][e.codes], place[e.codes] >= 0
                row, size = e.rows, len(e.ends)
                n_held = np.bincount(row[held], minlength=size)
                safe = np.where(place >= 0, place, 0)
                sums = [np.bincount(row[held], weights=np.where(place >= 0, f, 0.0)[e.codes[held]], minlength=size) for f in (m.base(held_c[safe]), m.emission(np.maximum(held_c[safe], 1), np.where(place >= 0, held_class[place], 0).astype(np.int64)))]
                ends = np.diff(e.ends, prepend=0)
                # The end is a token too.
                seq = np.full(len(e.codes) + size, m.end[1], np.uint8)
                seq[np.arange(len(e.codes)) + row] = of_token
                one = np.array([m.end[0]]), np.array([m.end[1]])
                sums = [sums[0] + m.base(one[0]), sums[1] + m.emission(*one)]
                binary = lambda data, lengths: pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                # A row's other words by their first place, and which of them stands at each place.
                other, orow = e.codes[~held], row[~held]
                pairs, which = np.unique(orow * len(e.words) + other, return_inverse=True)
                prow, pword = pairs // max(1, len(e.words)), pairs % max(1, len(e.words))
                start = np.searchsorted(prow, np.arange(size))
                places = (which - start[orow]).astype("<i4")
                nothing = pa.nulls(size, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], pa.array(np.full(size, -1, np.int32)), nothing, pa.array(ends + 1), pa.array(n_held + 1), pa.array(sums[0]), pa.array(sums[1]), binary(seq, ends + 1), binary(places, 4 * np.bincount(orow, minlength=size))],
                    [*[n for n, _ in own_types], k, word, "n_tokens", "n_known", "base", "emitted", "classes", "places"],
                )
                if len(pairs):
                    t, at = len(pairs), batch.schema.get_field_index(rid)
                    empty = [pa.nulls(t, x.type) if i != at else rows.column(at).take(pa.array(prow)) for i, x in enumerate(rows.columns[:-1])]
                    yield pa.RecordBatch.from_arrays(
                        [*empty, pa.array((np.arange(t) - start[prow]).astype(np.int32)), e.words.take(pa.array(pword)), *[pa.nulls(t, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())]],
                        [*[n for n, _ in own_types], k, word, "n_tokens", "n_known", "base", "emitted", "classes", "places"],
                    )

    facts = ["n_tokens", "n_known", "base", "emitted", "classes", "places"]
    told = d.mapInArrow(tidy(run), schema)
    own = told.where(F.col(k) < 0).select(*keep, rid, k, F.lit(None).cast("long").alias(c), F.lit(None).cast("int").alias(cls), *facts)
    return _filled(own, told, lex, keep, (rid, k, word, cls, c), facts)


def _filled(own: DataFrame, told: DataFrame, lex: Lexicon, keep: list[str], names: tuple[str, ...], facts: list[str]) -> DataFrame:
    rid, k, word, cls, c = names
    learnt = lex.table.select(F.col("word").alias(word), F.col("c").alias(c), F.col("class").alias(cls))
    # An own row has a key of its own in the join, so that such rows never meet in one task.
    key = F.coalesce(F.col(word), F.concat(F.lit(END + END), F.col(rid).cast("string")))
    rows = told.withColumn(word, key).join(learnt.hint("shuffle_hash"), word, "left").select(*keep, rid, k, c, cls, *facts)
    shared = own.sparkSession.sparkContext.broadcast(lex._replace(table=None, words=None, counts=None, classes=None))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keep).schema) + ", " + CODED
    columns = [*keep, rid, k, c, cls, *facts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Lexicon = shared.value

        def settle(t: pa.Table) -> pa.RecordBatch:
            col = lambda x: t.column(x).combine_chunks()
            first = np.flatnonzero(np.asarray(col(k)) < 0)
            counts = np.asarray(pc.fill_null(col(c), 0))
            kinds = np.where(counts > 0, np.asarray(pc.fill_null(col(cls), 0)), m.unseen).astype(np.int64)
            mine = t.take(pa.array(first)).combine_chunks()
            seq = np.frombuffer(b"".join(mine.column("classes").to_pylist()), np.uint8).copy()
            places = np.frombuffer(b"".join(mine.column("places").to_pylist()), "<i4")
            sizes = np.asarray(pc.binary_length(mine.column("places").combine_chunks())) // 4
            doc = np.repeat(np.arange(len(first)), sizes)
            at = first[doc] + 1 + places
            seq[seq == NONE] = kinds[at]
            sums = [np.bincount(doc, weights=w, minlength=len(first)) for w in (counts[at] > 0, m.base(counts[at]), m.emission(counts[at], kinds[at]))]
            lengths = np.asarray(mine.column("n_tokens").combine_chunks())
            classes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(seq)])
            n, known, base, emitted = (np.asarray(mine.column(x).combine_chunks()) for x in facts[:4])
            return pa.RecordBatch.from_arrays([*[mine.column(x).combine_chunks() for x in keep], pa.array(n), pa.array(known + sums[0].astype(np.int64)), pa.array(base + sums[1]), pa.array(emitted + sums[2]), classes], [*keep, *[x.split()[0] for x in CODED.split(", ")]])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.select(columns)
            last = np.flatnonzero(np.asarray(batch.column(k)) < 0)
            # The last text's words may go on in the next batch.
            if len(last) and (held or last[-1] > 0):
                held.append(batch.slice(0, last[-1]))
                yield settle(pa.Table.from_batches(held))
                held = [batch.slice(last[-1])]
            else:
                held.append(batch)
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.repartition(rid).sortWithinPartitions(rid, k).mapInArrow(tidy(run), schema)


def _previous(classes: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, where each text begins) of all tokens; the end stands before the first. No text is without tokens."""
    sizes = np.asarray(pc.binary_length(classes)).astype(np.int64)
    now = np.frombuffer(b"".join(classes.to_pylist()), np.uint8).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    before = np.append(end, now[:-1]) if len(now) else now
    before[start] = end
    return before, now, start


def transitions(train: DataFrame, lex: Lexicon) -> np.ndarray:
    """log10 P(class | class before), from the column classes of ``train``."""
    k, end = len(lex.tokens), lex.end[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * k, np.int64)
        for batch in batches:
            before, now, _ = _previous(batch.column(0), end)
            sums += np.bincount(before * k + now, minlength=k * k)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["key", "n"])

    table = np.zeros(k * k)
    for r in train.select("classes").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # k^2 rows at most
        table[r["key"]] = r["n"]
    table = table.reshape(k, k)
    single = (lex.tokens + 1) / (lex.tokens.sum() + k)
    # Backed off to the class's own share by the number of different classes that follow (Witten and Bell).
    kinds = np.maximum((table > 0).sum(axis=1, keepdims=True), 1)
    return np.log10((table + kinds * single) / (table.sum(axis=1, keepdims=True) + kinds))


def score_documents(docs: DataFrame, training: Column | None = None, keep: list[str] | None = None, core: int = CORE, head: int = HEAD, k: int = CLASSES) -> DataFrame:
    """``keep`` (doc_id), held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of ``docs``.

    Learns from the rows where ``training`` is true (crc32(doc_id) mod 7 isn't
    2). Null and empty texts are one token, the end. Equal texts have equal
    scores, repeated rows stay repeated, ties between classes go to the one
    with the smaller number, and other columns, whatever their names, play no
    part. Without training texts both scores are 0 and perplexity is null: what
    can be said then is unknown. An empty table gives an empty one.
    """
    keep = ["doc_id"] if keep is None else keep
    training = in_training(F.col("doc_id"), 7, 2) if training is None else training
    d = docs.select(*keep, (~training).alias("held_out"), "text")
    lex = lexicon(d.where("not held_out").select("text"), core, head, k)
    keep = [*keep, "held_out"]
    if lex is None:
        return _unlearnt(d, keep)
    c = cut(coded(d, lex, keep))
    table, end = transitions(c.where("not held_out"), lex), lex.end[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, now, start = _previous(batch.column(batch.num_columns - 1), end)
            steps = np.add.reduceat(table[before, now], start) if len(start) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(steps)], [*batch.schema.names[:-1], "steps"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema if f.name != "classes")
    out = c.mapInArrow(tidy(run), types + ", steps double")
    score = F.col("emitted") + F.col("steps")
    return out.select(*keep, "n_tokens", "n_known", F.lit(lex.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def _unlearnt(d: DataFrame, keep: list[str]) -> DataFrame:
    """Token counts of texts by a model that has learnt nothing."""
    at = d.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in encoded(batch.column(at), blank_words):
                rows = batch.slice(e.first, len(e.ends))
                yield pa.RecordBatch.from_arrays([*[x for i, x in enumerate(rows.columns) if i != at], pa.array(np.diff(e.ends, prepend=0) + 1)], [*keep, "n_tokens"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    zero = F.lit(0).cast("long")
    return d.mapInArrow(tidy(run), types + ", n_tokens long").select(*keep, "n_tokens", zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("perplexity"))


def query(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
