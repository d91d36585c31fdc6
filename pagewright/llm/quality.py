"""Quality rules: document statistics, base rules, and boosted trees over the statistics.

Statistics cover whole texts.  The trees learn ``labels.quality`` from a bounded sample of labelled rows (``SAMPLE``
rows, those with the smallest hash of doc_id) and are shipped as numpy node arrays; scores may only fall as a
constrained statistic rises.  A document is kept unless a base rule fails or the trees' probability of good quality is
under ``THRESHOLD``.

Null and empty texts have no words, so they fail the base rules.  Repeated rows are judged alike, null doc_ids too.
Without usable labels, or with one class of them only, the base rules alone decide.  Other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.boosting import Forest, constant, fit
from pagewright.llm.common import PACKED, TEXTS, packed_texts, texts_in, texts_of, unpacked

SAMPLE = 20_000
THRESHOLD = 0.3
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees and the direction in which the probability of good quality may move with each.
FEATURES = [("log_words", 0), ("chars_per_word", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("distinct_share", 0), ("words_per_line", 0), ("bare_symbol_share", -1), ("stopped_line_share", 0), ("digit_share", 0), ("upper_share", 0), ("long_word_share", 0)]


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice, every occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(0xD1342543DE82EF95) + ids[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    same[same] = (windows[order[1:][same]] == windows[order[:-1][same]]).all(axis=1)
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(data: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text."""
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64)
    chars = len(data.translate(None, BLANKS + CONTINUED))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(ids) if len(seen) < n else 0
    bare = sum(data.count(b" %c " % s) for s in SYMBOLS)
    stopped = sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for x in lines)
    digits = len(data) - len(data.translate(None, b"0123456789"))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    long = sum(len(w) > 24 for w in seen) / len(seen)
    return [n, chars, symbols, dup, repeat], [float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n, len(seen) / n, n / len(lines), bare / n, stopped / len(lines), digits / chars, upper / chars, long]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled ids; the sample is what is broadcast and what is collected.

    The ids with the smallest hashes are taken.  An id that is labelled more than once has its mean label, and one that
    has several texts counts with one of them.
    """
    chosen = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{quality}`").cast("double").alias("y")).where("id is not null and y is not null")
    chosen = chosen.groupBy("id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                rows = [statistics(t or b"")[1] for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])
        pa.default_memory_pool().release_unused()

    got = texts_of(docs, chosen, doc_id, text).mapInArrow(run, "y double, x array<double>").orderBy("y", "x").toPandas()
    if not len(got):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array(got["x"].tolist()), (got["y"].to_numpy() > 0.5).astype(float)


def learn(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE) -> Forest:
    if labels is None:
        return constant(1.0)
    x, y = training_rows(docs, labels, sample)
    if not len(y) or y.min() == y.max():
        return constant(1.0)
    return fit(x, y, [s for _, s in FEATURES])


def judge(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row, packed in one column, with COUNTS, ``base_failed``, ``probability`` and ``kept``."""

    rows, place = packed_texts(docs, text)

    def run(batches):
        for b in batches:
            counts, p = [np.zeros((0, len(COUNTS)), dtype=np.int64)], [np.zeros(0)]
            for texts in texts_in(b, place):
                found = [statistics(t or b"") for t in texts]
                counts.append(np.array([c for c, _ in found], dtype=np.int64))
                p.append(forest.probability(np.array([f for _, f in found], dtype=float)))
            counts, p = np.concatenate(counts), np.concatenate(p)
            failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], [PACKED, *COUNTS, "base_failed", "probability", "kept"])
        pa.default_memory_pool().release_unused()

    schema = rows.select(PACKED).schema
    for c in COUNTS:
        schema.add(c, "long")
    schema.add("base_failed", "boolean").add("probability", "double").add("kept", "boolean")
    return rows.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame | None, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns of docs."""
    return unpacked(judge(docs, learn(docs, labels), text).where("kept"), docs.columns)
