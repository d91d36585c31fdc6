"""Vectorised word hashing over whole texts.

A group of documents is laid end to end in one byte buffer, separated by a
blank, and every word gets a 64-bit hash from differences of one running
polynomial sum; no Python object is made for a word.  Words are maximal runs of
bytes that are not separators.  Texts are always read whole: a single text that
is longer than a group simply makes a larger group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

GROUP_BYTES = 1 << 20
_U = np.uint64


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) | _U(1)


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and leaves every other byte alone."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def blank_bytes() -> np.ndarray:
    r"""True for the bytes 0x20 and 0x09-0x0D, the separators of ``[^\x20\x09-\x0D]+``."""
    t = np.zeros(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def ascii_nonword_bytes() -> np.ndarray:
    r"""True for the separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after lower-casing."""
    t = np.zeros(256, dtype=bool)
    t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers (the finaliser of MurmurHash3); overwrites x."""
    s = _U(33)
    t = x >> s
    x ^= t
    x *= _U(0xFF51AFD7ED558CCD)
    np.right_shift(x, s, out=t)
    x ^= t
    x *= _U(0xC4CEB9FE1A85EC53)
    np.right_shift(x, s, out=t)
    x ^= t
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, GROUP_BYTES + GROUP_BYTES // 8)
        for name, base in (("up", self.base), ("down", self.inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))


class Words:
    """Words of a group of texts: ``start``/``end`` byte offsets in ``buffer``, ``hash``, and ``first[d]:first[d+1]``, the words of text d."""

    __slots__ = ("buffer", "end", "first", "hash", "offset", "start")


class WordHasher:
    def __init__(self, separators: np.ndarray, lower: bool = True):
        low = lower_table() if lower else np.arange(256, dtype=np.uint8)
        self.low, self.gap = low, separators[low]
        self.code = _table(11)[low]
        self.powers = Powers(0x9E3779B97F4A7C15)

    def __call__(self, texts: list[bytes]) -> Words:
        w = Words()
        data = b" ".join([b"", *texts, b""])
        buf = np.frombuffer(data, dtype=np.uint8)
        n = len(buf)
        self.powers.reach(n + 1)
        gap = self.gap[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        w.buffer, w.start, w.end = data, edge[0::2], edge[1::2]
        run = self.code[buf]
        run *= self.powers.up[:n]
        np.cumsum(run, out=run)
        h = run[w.end - 1] - run[w.start - 1]
        h *= self.powers.down[w.start]
        w.hash = mix(h)
        length = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        w.offset = np.concatenate(([0], np.cumsum(length + 1))) + 1
        w.first = np.searchsorted(w.start, w.offset)
        return w


def each(column) -> Iterator[bytes | None]:
    """The values of an Arrow column of strings as bytes, one at a time."""
    for x in column.cast("binary"):
        yield x.as_py()


def groups(texts: Iterable[bytes | None], size: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``size`` bytes together; None counts as empty."""
    out, held = [], 0
    for t in texts:
        t = t or b""
        out.append(t)
        held += len(t) + 1
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the texts' bounds in them.

    A text with fewer words than ``width``, but not none, has one run: its whole sequence.
    """
    count = np.diff(first)
    full = np.maximum(count - width + 1, 0)
    n = max(len(hashes) - width + 1, 0)
    roll = np.zeros(n, dtype=np.uint64)
    factor = _U(0xD1342543DE82EF95)
    for j in range(width):
        roll *= factor
        roll += hashes[j : j + n]
    out_first = np.concatenate(([0], np.cumsum(np.where(count > 0, np.maximum(full, 1), 0))))
    out = np.empty(out_first[-1], dtype=np.uint64)
    long = np.flatnonzero(full)
    if len(long):
        length = full[long]
        shift = np.repeat(first[long] - (np.cumsum(length) - length), length)
        at = np.repeat(out_first[long] - (np.cumsum(length) - length), length)
        walk = np.arange(length.sum())
        out[at + walk] = roll[shift + walk]
    for d in np.flatnonzero((count > 0) & (count < width)):
        h = _U(int(count[d]))
        for x in hashes[first[d] : first[d + 1]]:
            with np.errstate(over="ignore"):
                h = h * factor + x
        out[out_first[d]] = h
    return mix(out), out_first
