"""Toxicity: a linear classifier on hashed character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (``SIZES``) of the whole lower-cased text, hashed to ``BUCKETS``.  Each is
scaled by the log ratio of its smoothed frequencies in toxic and other training texts, counted on the executors; buckets
in fewer than ``LEAST_DOCS`` training texts or with a ratio under ``LEAST_RATIO`` are left out.  A logistic regression
with an L1 term is fitted on the scaled features.  Training reads a bounded sample (``PER_CLASS`` rows of each label, those with
the smallest hash of doc_id); ids, languages, sources and labels are never features.

Null and empty texts have no n-grams and get the score of the bias alone.  Repeated rows get equal scores.  Without labels
of both classes every score is next to 0.  Rows with a null doc_id are never trained on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import PACKED, crc_class, texts_of

SIZES = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
PER_CLASS = 6_000
LEAST_DOCS, LEAST_RATIO = 4, 0.7
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def hashed_grams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, in order, repeats included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    out, h = [], np.zeros(len(codes), dtype=np.uint64)
    for j in range(max(SIZES)):
        if len(codes) <= j:
            break
        h = (h[: len(codes) - j] + codes[j:] + np.uint64(1)) * _FACTOR
        h ^= h >> np.uint64(29)
        if j + 1 in SIZES:
            out.append(((h * _FACTOR) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


@dataclass
class Linear:
    """weight: of each bucket, most of them 0; bias."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        used = self.weight != 0
        for i, t in enumerate(texts):
            g = hashed_grams(t or "")
            out[i] = self.bias + self.weight[np.unique(g[used[g]])].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratio of every bucket; 0 for buckets that are rare or tell little."""
    ratio = np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((neg + smooth) / (n_neg + 2 * smooth))
    return np.where((pos + neg >= LEAST_DOCS) & (np.abs(ratio) >= LEAST_RATIO), ratio, 0.0)


def fit(grams: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 200, l1: float = 6e-4) -> Linear:
    """grams: each text's distinct buckets.  Proximal gradient steps with momentum on the mean logistic loss, classes weighted evenly."""
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(BUCKETS), -np.inf)
    chosen = np.flatnonzero(ratio)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    col = place[np.concatenate(grams)]
    row = np.repeat(np.arange(len(y)), [len(g) for g in grams])[col >= 0]
    col = col[col >= 0]
    scale = ratio[chosen]
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    n = len(y)
    w, b, w_old, b_old, t = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0, 1.0
    ones = np.ones(len(chosen))
    for _ in range(12):  # the largest eigenvalue of X'SX/4, by power iteration, gives the step
        v = np.bincount(row, (ones * scale)[col], n) * share
        ones = np.bincount(col, v[row], len(chosen)) * scale
        top = np.linalg.norm(ones)
        ones = ones / max(top, 1e-12)
    step = 1 / max(top / 4 + 0.25, 1e-6)
    for _ in range(rounds):
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t_new
        wy, by, t = w + k * (w - w_old), b + k * (b - b_old), t_new
        z = by + np.bincount(row, (wy * scale)[col], n)
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * share
        g = np.bincount(col, err[row], len(chosen)) * scale
        w_old, b_old = w, b
        w = wy - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = by - step * err.sum()
    weight = np.zeros(BUCKETS)
    weight[chosen] = w * scale
    return Linear(weight, float(b))


def training_texts(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held: tuple[int, int] | None = (3, 1), doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(y, text) of at most ``per_class`` labelled ids of each label, held-out ids excluded; the ids chosen are broadcast.

    The ids with the smallest hashes are taken.  An id that is labelled more than once is toxic if one label says so, and
    one that has several texts counts with one of them.
    """
    rows = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held:
        rows = rows.where(crc_class("id", held[0]) != held[1])
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    pick = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
    return texts_of(docs, pick(1).unionByName(pick(0)), doc_id, text)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **options) -> Linear:
    """Counts buckets by label first; then only the buckets whose ratio tells something leave the executors."""
    texts = training_texts(docs, labels, per_class, **options)

    def count(batches):
        totals = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                totals[y, np.unique(hashed_grams(t or ""))] += 1
                totals[y, BUCKETS] += 1
        some = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[1, some]), pa.array(totals[0, some])], ["bucket", "pos", "neg"])

    sums = texts.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    counts[:, sums["bucket"].to_numpy()] = sums["pos"].to_numpy(), sums["neg"].to_numpy()
    ratio = log_ratios(counts[0, :BUCKETS], counts[1, :BUCKETS], counts[0, BUCKETS], counts[1, BUCKETS])
    tells = ratio != 0

    def features(batches):
        for b in batches:
            grams = [hashed_grams(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(g[tells[g]]).tobytes() for g in grams], pa.binary())], ["y", "x"])

    got = texts.mapInArrow(features, "y int, x binary").orderBy("y", "x").toArrow()
    grams = [np.frombuffer(v, dtype=np.int32) for v in got["x"].to_pylist()]
    return fit(grams, got["y"].to_numpy().astype(float), ratio)


def score(docs: DataFrame, model: Linear, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with ``score``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], [PACKED, "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(PACKED), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, rows.select(PACKED).schema.add("score", "double")).select(*[F.col(f"{PACKED}.`{c}`") for c in keep], "score")
