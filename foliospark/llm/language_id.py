"""Language ID: known words first, then ever shorter character n-grams.

A known word is scored by its log frequency in each language; an unseen one by
the n-grams that make it up, at each place the longest that is known, from
LONGEST characters down to one. Words, n-grams (by 64-bit hashes) and their counts
stay distributed and grow with the corpus: the tasks hold the MODEL_WORDS and
MODEL_GRAMS most frequent ones as a cache, and what it doesn't hold is joined, so
that results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_floor, cut, in_training, small, unused
from .encode import encoded, letter_words, tidy

MODEL_WORDS, MODEL_GRAMS, LONGEST = 200_000, 500_000, 4
SMOOTHING = 0.5


class Model(NamedTuple):
    """Log frequencies by language: of the held words, and of the held n-grams by their sorted keys (the last row of ``gram_logs`` is for unseen ones)."""

    langs: list[str]
    words: pa.Array
    word_logs: np.ndarray
    gram_keys: np.ndarray
    gram_logs: np.ndarray
    longest: int
    all_words: bool  # whether ``words`` are all there are
    all_grams: bool


class Trained(NamedTuple):
    """The model, and what tasks don't hold: known words (word, v array<float>), and all n-grams (key, v array<float>)."""

    model: Model
    words: DataFrame | None = None
    grams: DataFrame | None = None


def training_counts(train: DataFrame, langs: list[str]) -> DataFrame:
    """(word, l, n) over whole texts: how often each word occurs in language number l."""
    order, size = pa.array(langs, pa.string()), len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.asarray(pc.index_in(batch.column(0), value_set=order)).astype(np.int64)
            for e in encoded(batch.column(1), letter_words):
                keys, n = np.unique(e.codes * size + lang[e.first + e.rows], return_counts=True)
                yield pa.RecordBatch.from_arrays([e.words.take(pa.array(keys // size)), pa.array((keys % size).astype(np.int32)), pa.array(n)], ["word", "l", "n"])

    d = train.where("lang is not null").select("lang", "text")
    return d.mapInArrow(tidy(run), "word string, l int, n long").groupBy("word", "l").agg(F.sum("n").alias("n"))


def _keys(words: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where each word begins, where it ends, keys[n - 1, place], whether there is one): hashed n-grams of ``^word$`` at each place with room for them."""
    framed = pc.binary_join_element_wise("^", words, "$", "")
    sizes = np.asarray(pc.utf8_length(framed)).astype(np.int64)
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(framed.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    room = np.repeat(ends, sizes) - np.arange(len(points))
    keys, there = np.zeros((longest, len(points)), np.int64), np.zeros((longest, len(points)), bool)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (points[n - 1 :] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        keys[n - 1, : len(h)] = (h * np.uint64(0x94D049BB133111EB) + np.uint64(n)).view(np.int64)
        there[n - 1, : len(h)] = room[: len(h)] >= n
    return ends - sizes, ends, keys, there


def _gram_counts(counts: DataFrame, size: int, longest: int) -> DataFrame:
    """(key, length, l, n) of all n-grams of (word, l, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, keys, there = _keys(batch.column(0), longest)
            l, n = (np.repeat(np.asarray(batch.column(i)).astype(np.int64), hi - lo) for i in (1, 2))
            for k, (key, some) in enumerate(zip(keys, there, strict=True), 1):
                distinct, number = np.unique(key[some], return_inverse=True)
                sums = np.bincount(number * size + l[some], weights=n[some], minlength=len(distinct) * size).astype(np.int64)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(distinct[at // size]), pa.array(np.full(len(at), k, np.int32)), pa.array((at % size).astype(np.int32)), pa.array(sums[at])], ["key", "length", "l", "n"])

    rows = counts.select("word", "l", "n").mapInArrow(tidy(run), "key long, length int, l int, n long")
    return rows.groupBy("key", "length", "l").agg(F.sum("n").alias("n"))


def train_model(docs: DataFrame, words: int = MODEL_WORDS, longest: int = LONGEST, grams: int = MODEL_GRAMS) -> Trained:
    """Learns from the text and non-null lang of ``docs``; tasks hold ``words`` words and ``grams`` n-grams at most."""
    langs = sorted(r["lang"] for r in docs.select("lang").where("lang is not null").distinct().collect())  # as many as there are languages
    size = len(langs)
    counts = cut(training_counts(docs, langs))
    totals = np.zeros(size)
    for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect():
        totals[r["l"]] = r["n"]
    if not totals.any():
        return Trained(Model([], pa.array([], pa.string()), np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros((1, 0)), longest, True, True))
    by_word = counts.groupBy("word").agg(F.collect_list(F.struct("l", "n")).alias("c"), F.sum("n").alias("all"))  # as many as there are languages
    by_word = cut(by_word)
    distinct = by_word.count()
    norm = np.log(totals + SMOOTHING * (distinct + 1))
    least = count_floor(by_word, "all", words)
    held = by_word.where(F.col("all") >= least).select("word", F.col("c.l").alias("l"), F.col("c.n").alias("n")).toArrow()  # ``words`` rows at most
    logs = (_logs(held, size) - norm).astype(np.float32)
    by_gram = cut(_gram_counts(counts, size, longest).groupBy("key", "length").agg(F.collect_list(F.struct("l", "n")).alias("c"), F.sum("n").alias("all")))
    sums = np.zeros((longest, size))
    for k, l, n in by_gram.select("length", F.explode("c").alias("x")).groupBy("length", "x.l").agg(F.sum("x.n").alias("n")).select("length", "l", "n").collect():
        sums[k - 1, l] = n
    for k, n in by_gram.groupBy("length").count().collect():
        sums[k - 1] += SMOOTHING * (n + 1)
    n_grams = by_gram.count()
    few = by_gram.where(F.col("all") >= count_floor(by_gram, "all", grams)).orderBy("key") if n_grams > grams else by_gram
    own = few.select("key", "length", F.col("c.l").alias("l"), F.col("c.n").alias("n")).toArrow()  # ``grams`` rows at most
    own = own.sort_by("key")
    gram_logs = np.vstack([_logs(own, size) - np.log(sums)[np.asarray(own.column("length").combine_chunks()) - 1], np.log(SMOOTHING) - np.log(sums[:1])]).astype(np.float32)
    model = Model(langs, held.column("word").combine_chunks(), logs, np.asarray(own.column("key").combine_chunks()), gram_logs, longest, held.num_rows == distinct, n_grams == own.num_rows)
    of = F.array(*[F.lit(float(x)) for x in norm])
    count = lambda i: F.aggregate("c", F.lit(SMOOTHING), lambda a, x: a + F.when(x["l"] == i, x["n"]).otherwise(0))
    rest = by_word.where(F.col("all") < least).select("word", F.transform(of, lambda x, i: (F.log(count(i)) - x).cast("float")).alias("v"))
    norms = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in np.log(sums)])
    other = by_gram.select("key", F.transform(F.get(norms, F.col("length") - 1), lambda x, i: (F.log(count(i)) - x).cast("float")).alias("v"))
    return Trained(model, rest, other)


def _logs(rows: pa.Table, size: int) -> np.ndarray:
    """Log counts, smoothed, from lists of languages and counts."""
    out = np.full((rows.num_rows, size), SMOOTHING)
    sizes = np.asarray(pc.list_value_length(rows.column("l")).combine_chunks())
    flat = lambda c: np.asarray(rows.column(c).combine_chunks().flatten())
    out[np.repeat(np.arange(rows.num_rows), sizes), flat("l")] += flat("n")
    return np.log(out)


def by_grams(words: pa.Array, model: Model) -> np.ndarray:
    """Log frequencies of each word by language, from the longest known n-grams that make it up, left to right; all n-grams are held."""
    lo, hi, keys, there = _keys(words, model.longest)
    at = np.searchsorted(model.gram_keys, keys)
    known = there & (np.append(model.gram_keys, 0)[at] == keys) & (at < len(model.gram_keys))
    return _backed_off(lo, hi, np.where(known, at, -1), model.gram_logs)


def _backed_off(lo: np.ndarray, hi: np.ndarray, row: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Sums of ``logs`` over each word. ``row``[n - 1, place]: that of the n-gram there, or -1; where none is known the last row counts, and one character is passed."""
    use, step = np.full(row.shape[1], len(logs) - 1), np.ones(row.shape[1], np.int64)
    for n, r in enumerate(row, 1):
        use[r >= 0], step[r >= 0] = r[r >= 0], n
    total = np.zeros((len(lo), logs.shape[1]))
    which, at = np.arange(len(lo)), lo.copy()
    while len(which):
        total[which] += logs[use[at]]
        at = at + step[at]
        going = at < hi[which]
        which, at = which[going], at[going]
    return total


def gram_scores(words: DataFrame, trained: Trained) -> DataFrame:
    """word, v array<float>: what ``by_grams`` has for the distinct words of the one column of ``words``, with the n-grams' counts joined."""
    longest, unseen = trained.model.longest, trained.model.gram_logs[-1:]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, keys, there = _keys(batch.column(0), longest)
            of = np.repeat(np.arange(len(lo)), hi - lo)
            k, at = np.nonzero(there)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[at])), pa.array((at - lo[of[at]]).astype(np.int32)), pa.array((k + 1).astype(np.int32)), pa.array(keys[k, at])], ["word", "place", "length", "key"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1)).astype(np.int64)
            hi = np.cumsum(size)
            found = batch.column(2).flatten()
            of = np.repeat(np.arange(len(size)), np.asarray(pc.list_value_length(batch.column(2))).astype(np.int64))
            place, length, v = (found.field(i) for i in range(3))
            row = np.full((longest, int(size.sum())), -1)
            row[np.asarray(length) - 1, (hi - size)[of] + np.asarray(place)] = np.arange(len(found))
            logs = np.vstack([np.asarray(v.flatten()).reshape(len(found), unseen.shape[1]), unseen])
            total = _backed_off(hi - size, hi, row, logs).astype(np.float32)
            ends = pa.array(np.arange(len(size) + 1, dtype=np.int32) * unseen.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["word", "v"])

    distinct = cut(words.toDF("word").distinct())
    joined = distinct.mapInArrow(tidy(spread), "word string, place int, length int, key long").join(trained.grams.hint("shuffle_hash"), "key")
    lists = joined.groupBy("word").agg(F.collect_list(F.struct("place", "length", "v")).alias("found"))  # four for each letter of the word
    whole = distinct.join(lists, "word", "left").select("word", (F.length("word") + 2).alias("size"), F.coalesce("found", F.array().cast("array<struct<place:int,length:int,v:array<float>>>")).alias("found"))
    return whole.mapInArrow(tidy(sums), "word string, v array<float>")


def _sums(row: np.ndarray, logs: np.ndarray, code: np.ndarray, size: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of logs[code] (times ``weight``) by row."""
    of = lambda v: v if weight is None else v * weight
    return np.stack([np.bincount(row, weights=of(logs[code, i].astype(np.float64)), minlength=size) for i in range(logs.shape[1])], axis=1).astype(np.float64)


def languages(docs: DataFrame, trained: Trained, keep: list[str]) -> DataFrame:
    """``keep``, lang_pred and score for each row of ``docs``, from its column text."""
    model = trained.model
    if not model.langs:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    size = len(model.langs)
    rid, word, whole, tf, count, top = (unused(docs, x) for x in ("rid", "word", "whole", "tf", "n", "top"))
    d = docs.select(*keep, F.monotonically_increasing_id().alias(rid), F.col("text").alias(whole))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = [(f.name, f.dataType.simpleString()) for f in d.schema if f.name != whole]
    s = [unused(docs, f"s{i}") for i in range(size)]
    floats = ", ".join(f"{x} double" for x in s)
    own_schema = ", ".join(f"`{n}` {t}" for n, t in types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = [*[n for n, _ in types], word, tf, count, *s]
        for batch in batches:
            for e in encoded(batch.column(batch.num_columns - 1), letter_words):
                rows, row, n = batch.slice(e.first, len(e.ends)), e.rows, len(e.ends)
                place = e.places(m.words)
                logs = np.zeros((len(e.words), size), np.float32)
                logs[place >= 0] = m.word_logs[place[place >= 0]]
                all_known = m.all_words and m.all_grams
                if all_known and (place < 0).any():
                    logs[place < 0] = by_grams(e.words.filter(pa.array(place < 0)), m)
                told = np.ones(len(e.words), bool) if all_known else place >= 0
                sums = _sums(row, logs, e.codes, n)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array(np.diff(e.ends, prepend=0)), *[pa.array(sums[:, i]) for i in range(size)]], names)
                other = ~told[e.codes]
                if other.any():
                    keys, often = np.unique(row[other] * len(e.words) + e.codes[other], return_counts=True)
                    t, at = len(keys), rows.schema.get_field_index(rid)
                    empty = [pa.nulls(t, x.type) if i != at else x.take(pa.array(keys // len(e.words))) for i, x in enumerate(rows.columns[:-1])]
                    yield pa.RecordBatch.from_arrays([*empty, e.words.take(pa.array(keys % len(e.words))), pa.array(often.astype(np.int32)), pa.nulls(t, pa.int64()), *[pa.nulls(t, pa.float64())] * size], names)

    told = d.mapInArrow(tidy(run), f"{own_schema}, {word} string, {tf} int, {count} long, {floats}")
    if not (model.all_words and model.all_grams):
        told = _with_others(told, trained, keep, (rid, word, tf, count), s, shared)
    told = told.withColumn(top, F.greatest(*s) if size > 1 else F.col(s[0]))
    share = 1 / sum((F.exp(F.col(x) - F.col(top)) for x in s), F.lit(0.0))
    best = F.coalesce(*[F.when(F.col(x) == F.col(top), F.lit(lang)) for x, lang in zip(s, model.langs, strict=True)])
    return told.select(*keep, F.when(F.col(count) > 0, best).otherwise("und").alias("lang_pred"), F.when(F.col(count) > 0, share).otherwise(0.0).alias("score"))


def _with_others(told: DataFrame, trained: Trained, keep: list[str], names: tuple[str, ...], s: list[str], shared) -> DataFrame:
    """Own rows with the sums of the words that tasks don't hold: known ones are joined, what is left is scored by n-grams."""
    (rid, word, tf, count), size = names, len(s)
    known = trained.words.select(F.col("word").alias(word), "v")
    asked = told.where(F.col(word).isNotNull()).select(rid, word, tf).join(known.hint("shuffle_hash"), word, "left")
    if not trained.model.all_grams:
        asked = cut(asked)
        unseen = cut(gram_scores(asked.where("v is null").select(word), trained)).select(F.col("word").alias(word), F.col("v").alias("w"))
        asked = asked.join(unseen.hint("shuffle_hash"), word, "left").withColumn("v", F.coalesce("v", "w")).drop("w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            v = batch.column(3)
            unseen = np.asarray(pc.is_null(v))
            logs = np.zeros((batch.num_rows, size))
            if (~unseen).any():
                logs[~unseen] = np.asarray(v.drop_null().flatten()).reshape(-1, size)
            if unseen.any():
                w = batch.column(0).filter(pa.array(unseen)).dictionary_encode()
                logs[unseen] = by_grams(w.dictionary, m)[np.asarray(w.indices)]
            logs *= np.asarray(batch.column(2))[:, None]
            # A batch's rows of one text are summed before they are sent on.
            ids, which = np.unique(np.asarray(batch.column(1)), return_inverse=True)
            sums = _sums(which, logs, np.arange(batch.num_rows), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(sums[:, i].astype(np.float32)) for i in range(size)]], [rid, *s])

    more = asked.select(word, rid, tf, "v").mapInArrow(tidy(run), f"{rid} long, " + ", ".join(f"{x} float" for x in s))
    own = told.where(F.col(word).isNull()).select(rid, count, *s, *keep)
    x = own.unionByName(more.select(rid, *[F.col(c).cast("double").alias(c) for c in s]), allowMissingColumns=True)
    return x.groupBy(rid).agg(F.max(count).alias(count), *[F.sum(c).alias(c) for c in s], *[F.max(c).alias(c) for c in keep])


def predict(docs: DataFrame, trained: Trained) -> DataFrame:
    """All columns of ``docs``, with lang_pred and score after them (columns of ``docs`` named so are replaced).

    Texts that are null or have no letter are ``und`` with score 0; so are all
    if no language could be learnt. Of equally likely languages the first by
    name counts. Repeated rows stay repeated.
    """
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    d = docs.select(*own)
    if trained.model.all_words and trained.model.all_grams:
        return languages(d, trained, own)
    key, h = unused(d, "key"), unused(d, "hash")
    said = languages(d.select(F.col("doc_id").alias(key), F.xxhash64("text").alias(h), "text"), trained, [key, h]).dropDuplicates([key, h])
    return d.join(said, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h))).select(*own, "lang_pred", "score")


def keep_known(docs: DataFrame, trained: Trained) -> DataFrame:
    """``docs``, columns as they are, without the rows whose language is ``und``."""
    key, h = unused(docs, "key"), unused(docs, "hash")
    said = languages(docs.select(F.col("doc_id").alias(key), F.xxhash64("text").alias(h), "text"), trained, [key, h])
    rejected = cut(said.where("lang_pred = 'und'").select(key, h).distinct())
    return docs.join(small(rejected, F.lit(32)), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``, learnt from those whose crc32(doc_id) mod 3 isn't 1.

    A null lang isn't learnt from, and a null doc_id counts as the empty text.
    Long texts and long words are scored whole. Other columns play no part. The
    rest is as ``predict`` has it; an empty table gives an empty one.
    """
    trained = train_model(docs.where(in_training(F.col("doc_id"), 3, 1)).select("text", "lang"))
    return languages(docs.select("doc_id", (~in_training(F.col("doc_id"), 3, 1)).alias("held_out"), "text"), trained, ["doc_id", "held_out"])


def query(docs: DataFrame) -> DataFrame:
    return identify(docs)
