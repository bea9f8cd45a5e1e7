"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is web text at
large. A linear scorer minimises the non-negative unbiased risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with logistic loss, so that its sigmoid is a probability. The class prior is
estimated from the positives and the unlabelled texts alone. All rows take part
in both: their features are made once in the tasks and stay there, and each step
sums up its gradient and curvature over the cluster.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_training, small
from .encode import tidy

MARKS = np.frombuffer(b"\t\n !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", np.uint8)
N_FEATURES = len(MARKS) + 15


def features(text: str | None) -> np.ndarray:
    """Rates of marks and of kinds of letters, words and lines; nothing that names a word or a language."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, len(data))
    h = np.bincount(data, minlength=256) / n
    w = text.split()
    k = max(1, len(w))
    lengths = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1, np.int64)
    lines = text.split("\n")
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    shouted = sum(x.isupper() and len(x) > 1 for x in w)
    capital = sum(x[0].isupper() for x in w)
    common = Counter(w).most_common(1)
    rest = [
        h[65:91].sum() ** 0.5,
        h[97:123].sum(),
        h[128:].sum() ** 0.5,
        h[:9].sum() ** 0.5,
        np.log1p(len(data)) / 10,
        np.log1p(len(w)) / 10,
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(lengths.max()),
        len(set(w)) / k,
        shouted / k,
        capital / k,
        (common[0][1] if common else 0) / k,
        1 - len(set(lines)) / len(lines),
        np.log1p(line_lengths.mean()) / 10,
    ]
    return np.concatenate([np.sqrt(h[MARKS]), rest]).astype(np.float32)


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(whether positive, features) of a batch."""
    return np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(bool), np.asarray(batch.column(1).flatten()).reshape(-1, N_FEATURES).astype(np.float64)


def _totals(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the vector ``of``(positive, x), which has ``size`` numbers: as many rows come back, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(*_rows(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(tidy(run), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _design(centre: np.ndarray, scale: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - centre) / scale, -6, 6), np.ones((len(x), 1))])


class _Fit:
    """Newton's method on means over the positives and over all rows, which are the unlabelled set.

    The ridge follows a rule, not labels: as many units, over the number of
    positives, as there are features.
    """

    def __init__(self, rows: DataFrame, ridge: float = float(N_FEATURES)) -> None:
        self.rows = rows
        t = _totals(rows, lambda p, x: np.concatenate([[p.sum(), len(p)], x.sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * N_FEATURES)
        self.n_pos, self.n = t[:2]
        self.ridge = ridge / max(1, self.n_pos)
        self.centre = t[2 : 2 + N_FEATURES] / max(1, self.n)
        self.scale = np.sqrt(np.maximum(t[2 + N_FEATURES :] / max(1, self.n) - self.centre**2, 0)) + 1e-3

        self.design = partial(_design, self.centre, self.scale)

    def minimise(self, prior: float | None, steps: int = 25) -> np.ndarray:
        """Weights, the bias last. Without ``prior``, positives are told from all rows, both with the same weight."""
        d, design, n, n_pos = N_FEATURES + 1, self.design, self.n, self.n_pos
        # Weights of the means E_pos[loss(g)], E_all[loss(-g)], E_pos[loss(-g)].
        a, b, c = (0.5, 0.5, 0.0) if prior is None else (prior, 1.0, -prior)
        w = np.zeros(d)
        w[-1] = 0.0 if prior is None else np.log(prior / (1 - prior))
        lengths = np.array([0.0, 1.0, 0.5, 0.2, 0.05, 0.01])
        before = np.inf
        for _ in range(steps):
            def slopes(p: np.ndarray, x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                z = design(x)
                s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                g = b * (z.T @ s) / n + (z[p].T @ (a * (s[p] - 1) + c * s[p])) / n_pos
                # The logistic loss has the same curvature on both sides, so that a + c counts for the positives.
                v = s * (1 - s)
                h = b * (z * v[:, None]).T @ z / n + (a + c) * (z[p] * v[p, None]).T @ z[p] / n_pos
                return np.concatenate([g, h.ravel()])

            t = _totals(self.rows, slopes, d + d * d)
            penalty = np.append(np.full(d - 1, self.ridge), 0.0)
            step = -np.linalg.solve(t[d:].reshape(d, d) + np.diag(penalty + 1e-9), t[:d] + penalty * w)
            tried = w[:, None] + step[:, None] * lengths

            def losses(p: np.ndarray, x: np.ndarray, tried: np.ndarray = tried) -> np.ndarray:
                g = design(x) @ tried
                return np.concatenate([np.logaddexp(0, -g[p]).sum(axis=0) / n_pos, np.logaddexp(0, g).sum(axis=0) / n, np.logaddexp(0, g[p]).sum(axis=0) / n_pos])

            pos, unl, turned = _totals(self.rows, losses, 3 * len(lengths)).reshape(3, -1)
            negative = b * unl + c * turned
            risk = a * pos + np.maximum(0, negative) + (penalty[:, None] * tried**2).sum(axis=0) / 2
            # Where what stands for the negatives would fall under 0, the step is shortened to where it doesn't.
            risk = np.where((negative >= 0) | (lengths == 0), risk, np.inf)
            best = int(risk.argmin())
            w = tried[:, best]
            if best == 0 or before - risk[best] < 1e-7:
                break
            before = risk[best]
        return w

    def prior(self, bins: int = 2000, confidence: float = 0.1) -> float:
        """The share of positives in the unlabelled set, by best-bin estimation.

        Above any threshold of a score lie q_p of the positives and q_u of all
        rows, of which prior * q_p at least are positives; the least q_u / q_p,
        with allowance for chance, is the estimate.
        """
        w, design = self.minimise(None), self.design

        def histogram(p: np.ndarray, x: np.ndarray) -> np.ndarray:
            at = np.minimum((bins / (1 + np.exp(-np.clip(design(x) @ w, -30, 30)))).astype(int), bins - 1)
            return np.concatenate([np.bincount(at[p], minlength=bins), np.bincount(at, minlength=bins)])

        pos, unl = _totals(self.rows, histogram, 2 * bins).reshape(2, bins)
        q_p, q_u = (np.cumsum(h[::-1]) / max(1, n) for h, n in ((pos, self.n_pos), (unl, self.n)))
        chance = np.sqrt(np.log(4 / confidence) / (2 * self.n)) + np.sqrt(np.log(4 / confidence) / (2 * self.n_pos))
        some = q_p > 0
        at = np.argmin((q_u[some] + chance) / q_p[some])
        return float(np.clip(q_u[some][at] / q_p[some][at], 0.02, 0.98))


def _feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and x array<float>, from whole texts."""
    own = [*keep, "text"]
    d = docs.select(*own)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(len(keep))]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], [*keep, "x"])

    return d.mapInArrow(tidy(run), types + "x array<float>")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from ``docs`` and the labels 1 among ``labels``; None if no document has one. Labels 0 are used for nothing.

    A document is positive if any of its labels is 1; all of ``docs`` are the
    unlabelled set.
    """
    positive = cut(labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()).withColumn("p", F.lit(True))
    marked = docs.select("doc_id", "text").join(small(positive, F.lit(24)), "doc_id", "left")
    rows = cut(_feature_rows(marked.select(F.coalesce("p", F.lit(False)).alias("p"), "text"), ["p"]))
    fit = _Fit(rows)
    if not fit.n_pos:
        return None
    prior = fit.prior()
    w = fit.minimise(prior)
    return Model(fit.centre, fit.scale, w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` and score for each row, from its whole text; 0.5 if nothing could be learnt."""
    own = [*keep, "text"]
    d = docs.select(*own)
    if model is None:
        return d.select(*keep, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([features(t.as_py()) for t in b.column(len(keep))]) if b.num_rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(shared.value.score(x).astype(np.float64))], [*keep, "score"])

    return d.mapInArrow(tidy(run), types + "score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``, learnt where crc32(doc_id) mod 3 isn't 1.

    Null texts are scored as empty ones, long ones whole; rows stay as they are
    repeated, equal texts have equal scores, and a score of 0.5 counts as 1.
    Without a label 1 to learn from all scores are 0.5; an empty table gives an
    empty one. Other columns play no part.
    """
    model = train(docs.where(in_training(F.col("doc_id"), 3, 1)), labels.where(in_training(F.col("doc_id"), 3, 1)))
    held = (~in_training(F.col("doc_id"), 3, 1)).alias("held_out")
    return score(docs.select("doc_id", held, "text"), model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
