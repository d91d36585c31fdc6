"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

Words are runs of the bytes outside ``ascii_nonword_bytes`` after lower-casing A-Z.  A window is ``WINDOW`` consecutive
words of an item; an item of fewer words, but not none, is one window.  A window is the set of its ``SHINGLE``-word
shingles, and an occurrence contains them all, so of a window's shingles in order of rarity a prefix of one is necessary:
the rarest, by document frequency over the whole corpus.  Only document shingles that equal such a prefix give candidates;
the shingle's place in the window bounds where the window can start and end (position and length), and what is left is
verified word for word.

The benchmark's distinct rows travel to the workers in blocks of about ``BLOCK_BYTES`` of text (a longer item is a block of
its own size): one if it is that small, else as many as it takes, each a narrow step over the documents, which are neither
shuffled nor collected.

Null and empty texts have no words and no hits; items without words match nothing; a null item_id counts as an empty
name; item rows with equal ids are one item; repeated documents are judged alike; an empty benchmark hits nothing, and no
documents give no rows.  Texts are read whole, however long; other columns are kept, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import PACKED, packed_texts, texts_in, unpacked
from pagewright.llm.words import WordHasher, ascii_nonword_bytes, groups, mix

WINDOW, SHINGLE = 13, 3
BLOCK_BYTES = 16 << 20
MASK_BITS = 20
_U = np.uint64


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, ends of texts ignored."""
    n = max(len(hashes) - width + 1, 0)
    out = np.full(n, _U(width))
    for j in range(width):
        out = out * _U(0xD1342543DE82EF95) + hashes[j : j + n]
    return mix(out)


@dataclass
class Windows:
    """Windows of a block of items: first word in ``hash`` and length, item, and shingle width; ``words`` for verification."""

    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    width: np.ndarray
    hash: np.ndarray
    words: list[bytes]
    names: list[str]


def windows_of(items: list[tuple[str, bytes]], width: int = WINDOW, shingle: int = SHINGLE) -> Windows:
    w = WordHasher(ascii_nonword_bytes())([t for _, t in items])
    n = np.diff(w.first)
    many = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), many)
    start = np.repeat(w.first[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    size = np.minimum(n, width)[item]
    return Windows(start, size, item, np.minimum(size, shingle), w.hash, [w.buffer[s:e].lower() for s, e in zip(w.start, w.end)], [n for n, _ in items])


def shingle_table(win: Windows) -> dict[int, np.ndarray]:
    """Sorted distinct shingles of the windows, by shingle width."""
    out = {}
    for k in np.unique(win.width):
        h = rolled(win.hash, int(k))
        start, count = win.start[win.width == k], win.length[win.width == k] - k + 1
        used = np.zeros(len(h), dtype=bool)
        for j in range(int(count.max())):
            used[start[count > j] + j] = True
        out[int(k)] = np.unique(h[used])
    return out


class Sought:
    """Membership of document shingles in a sorted table, a bit mask first."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.zeros(1 << MASK_BITS, dtype=bool)
        self.mask[table >> _U(64 - MASK_BITS)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h, and places in the table, of what is in it."""
        at = np.flatnonzero(self.mask[h >> _U(64 - MASK_BITS)])
        place = np.minimum(np.searchsorted(self.table, h[at]), len(self.table) - 1)
        good = self.table[place] == h[at]
        return at[good], place[good]


def document_frequencies(docs: DataFrame, tables: dict[int, np.ndarray], text: str) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the tables occurs: partial counts by task, summed by shingle."""

    def run(batches):
        hasher = WordHasher(ascii_nonword_bytes())
        seek = {k: Sought(t) for k, t in tables.items()}
        counts = {k: np.zeros(len(t), dtype=np.int64) for k, t in tables.items()}
        for b in batches:
            for texts in groups(b.column(0).cast(pa.binary()).to_pylist()):
                w = hasher(texts)
                for k in tables:
                    at, place = seek[k](rolled(w.hash, k))
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    whole = at + k <= w.first[doc + 1]
                    pairs = np.unique(doc[whole] * len(tables[k]) + place[whole])
                    counts[k] += np.bincount(pairs % len(tables[k]), minlength=len(tables[k]))
        for k, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(some), pa.array(c[some])], ["width", "place", "n"])

    out = {k: np.zeros(len(t), dtype=np.int64) for k, t in tables.items()}
    if tables:
        rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "width int, place long, n long")
        for r in rows.groupBy("width", "place").agg(F.sum("n").alias("n")).toArrow().to_pylist():
            out[r["width"]][r["place"]] = r["n"]
    return out


def prefixes(win: Windows, tables: dict[int, np.ndarray], df: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By width: the sorted prefix shingles, bounds of each one's windows, those windows, and the shingle's place in them."""
    out = {}
    for k, table in tables.items():
        h = rolled(win.hash, k)
        # The rank of every distinct shingle by rarity, then by hash; 2**62 ranks nothing.
        rank = np.empty(len(table), dtype=np.int64)
        rank[np.lexsort((table, df[k]))] = np.arange(len(table))
        at = rank[np.minimum(np.searchsorted(table, h), len(table) - 1)]
        which = np.flatnonzero(win.width == k)
        start, count = win.start[which], win.length[which] - k + 1
        best, offset = np.full(len(which), 1 << 62), np.zeros(len(which), dtype=np.int64)
        for j in range(int(count.max())):
            here = np.where(count > j, at[np.minimum(start + j, len(at) - 1)], 1 << 62)
            offset[here < best] = j
            best = np.minimum(best, here)
        rare = h[start + offset]
        order = np.argsort(rare, kind="stable")
        keys, first = np.unique(rare[order], return_index=True)
        out[k] = keys, np.append(first, len(order)), which[order], offset[order]
    return out


def mark_block(rows: DataFrame, place: int | None, win: Windows, prefix: dict, last: bool) -> DataFrame:
    """rows (packed, n_words, spans, items) with texts at ``place`` after looking for one block's windows; the last adds n_hit.

    spans: word offsets, start and end in turn, of all occurrences; items: names of the items that occur.
    """

    def occurrences(texts: list[bytes], hasher: WordHasher, seek: dict[int, Sought]):
        w = hasher(texts)
        found: list[tuple[int, int, int]] = []
        for k, (_, bounds, which, offset) in prefix.items():
            at, place = seek[k](rolled(w.hash, k))
            many = bounds[place + 1] - bounds[place]
            at = np.repeat(at, many)
            entry = np.repeat(bounds[place], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            doc = np.searchsorted(w.first, at, side="right") - 1
            window, start = which[entry], at - offset[entry]
            inside = (start >= w.first[doc]) & (start + win.length[window] <= w.first[doc + 1])
            doc, window, start = doc[inside], window[inside], start[inside]
            for j in range(WINDOW):
                more = win.length[window] > j
                same = ~more
                same[more] = w.hash[start[more] + j] == win.hash[win.start[window[more]] + j]
                doc, window, start = doc[same], window[same], start[same]
            found += zip(doc.tolist(), window.tolist(), start.tolist())
        spans: list[list[int]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for d, i, s in found:
            a, n = win.start[i], int(win.length[i])
            if all(w.buffer[w.start[s + j] : w.end[s + j]].lower() == win.words[a + j] for j in range(n)):
                spans[d] += (s - int(w.first[d]), s - int(w.first[d]) + n)
                items[d].add(win.names[win.item[i]])
        return np.diff(w.first).tolist(), spans, items

    def run(batches):
        hasher = WordHasher(ascii_nonword_bytes())
        seek = {k: Sought(p[0]) for k, p in prefix.items()}
        for b in batches:
            words, spans, items = [], [], []
            for some in texts_in(b, place):
                for texts in groups(some):
                    for out, got in zip((words, spans, items), occurrences(texts, hasher, seek)):
                        out += got
            old_spans, old_items = b.column("spans").to_pylist(), b.column("items").to_pylist()
            spans = [a + s for a, s in zip(old_spans, spans)]
            items = [sorted({*a, *s}) for a, s in zip(old_items, items)]
            out = dict(zip(b.schema.names, b.columns)) | {"n_words": pa.array(words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            if last:
                out.pop("__text", None)
                out["n_hit"] = pa.array([covered(s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
        pa.default_memory_pool().release_unused()

    schema = (rows.drop("__text") if last else rows).schema
    return rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("n_hit", T.LongType())]) if last else schema)


def covered(spans: list[int]) -> int:
    """Words inside at least one span."""
    total, reach = 0, 0
    for s, e in sorted(zip(spans[0::2], spans[1::2])):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every row, packed, with n_words, n_hit, spans, items and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("name"), F.col(f"`{item_text}`").cast("string").alias("t"))
    items = items.distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    rows, place = packed_texts(docs, text, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("name", "t"), F.lit(n_blocks)) == k).orderBy("name", "t").toArrow().to_pylist()
        win = windows_of([(r["name"], (r["t"] or "").encode()) for r in part])
        tables = shingle_table(win)
        rows = mark_block(rows, place, win, prefixes(win, tables, document_frequencies(docs, tables, text)), k == n_blocks - 1)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows that aren't contaminated, with the columns of docs."""
    return unpacked(find_contamination(docs, benchmark, text).where("not contaminated"), docs.columns)

