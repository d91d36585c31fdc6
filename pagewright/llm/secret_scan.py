"""Secret scan of whole texts: keyword prefilter, anchored patterns near its hits, checksum validation.

One Aho-Corasick pass over the lower-cased bytes reports where a keyword of any kind begins; a kind's pattern is tried
only there, anchored at the hit.  A run of hexadecimal digits has no keyword: every sixth byte is probed, any 24 bytes
hold four probes, and a run is grown only from four probes in a row that hit.

Base kinds (``assign``, ``access``, ``hex``) give leftmost non-overlapping matches per kind, as scanning with the
pattern alone would; matches that are too short use up their text and are then dropped.  The other kinds are tokens that
carry a checksum (CRC-32 in base 62, double SHA-256 in base 58, bech32), and only those whose checksum holds count.

Offsets are code points, ends exclusive.  Null and empty texts have no spans; rows are independent, so repeated rows and
null ids give rows of their own; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import PACKED

#: Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "crc_token", "wallet_key", "bech32_key"]
BASE_KINDS = 3
#: Keywords, lower case, by kind.
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "crc_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"],
    "wallet_key": ["xprv"],
    "bech32_key": ["age-secret-key-1", "nsec1"],
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


PATTERNS = {
    "assign": re.compile(rb"""(?:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join([*map(_any_case, KEYWORDS["assign"][:4]), _any_case("api") + "_?" + _any_case("key")]).encode()),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "crc_token": re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "wallet_key": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"),
    "bech32_key": re.compile(rb"(?:AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}|nsec1[02-9ac-hj-np-z]{58})(?![A-Za-z0-9])"),
}
HEX = re.compile(rb"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Bytes between probes for hexadecimal runs: any 24 bytes hold four probes.
PROBE = MIN_HEX // 4


def crc_token_holds(body: str) -> bool:
    """The last six base-62 digits are the CRC-32 of those before."""
    n = 0
    for c in body[-6:]:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body[:-6].encode())


def wallet_key_holds(text: str) -> bool:
    """Base 58, the last four bytes being the double SHA-256 of those before."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    try:
        raw = n.to_bytes(82, "big")
    except OverflowError:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(text: str) -> bool:
    prefix, _, data = text.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= g if top >> i & 1 else 0
    return state == 1


VALID = {"crc_token": lambda m: crc_token_holds(m[1].decode()), "wallet_key": lambda m: wallet_key_holds(m[0].decode()), "bech32_key": lambda m: bech32_holds(m[0].decode())}


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


def automaton(keywords: dict[str, list[str]] = KEYWORDS) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in keywords.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def hex_runs(data: bytes, codes: np.ndarray, hexes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of at least MIN_HEX digits, found from four probes in a row that hit."""
    out, done = [], 0
    hit = hexes[codes[PROBE - 1 :: PROBE]]
    for p in np.flatnonzero(hit[:-3] & hit[1:-2] & hit[2:-1] & hit[3:]) * PROBE + PROBE - 1:
        p = int(p)
        if p < done:
            continue
        start = p
        while start > done and hexes[codes[start - 1]]:
            start -= 1
        end = HEX.match(data, p).end()
        if end - start >= MIN_HEX:
            out.append((start, end))
        done = end
    return out


def scan(data: bytes, machine: ahocorasick.Automaton, hexes: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and then kind as listed."""
    found, last = [], dict.fromkeys(KINDS, 0)
    for end, (kind, n) in machine.iter(data.lower().decode("latin-1")):
        start = end - n + 1
        if start < last[kind] or not (m := PATTERNS[kind].match(data, start)):
            continue
        if kind in VALID:
            if not VALID[kind](m):
                continue
        elif kind == "assign":
            last[kind] = m.end()
            if m.end() - m.start(1) < MIN_ASSIGN:
                continue
        elif kind == "access":
            last[kind] = m.end()
            if m.end() - start < MIN_ACCESS:
                continue
        last[kind] = m.end()
        found.append((kind, start, m.end()))
    found += [("hex", *r) for r in hex_runs(data, np.frombuffer(data, np.uint8), hexes)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same spans in code points."""
    if not spans or data.isascii():
        return spans
    codes = np.frombuffer(data, np.uint8)
    before = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
    return [(k, int(before[s]), int(before[e])) for k, s, e in spans]


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with ``spans``: an array of (kind, start, end)."""

    def run(batches):
        machine = automaton()
        hexes = np.zeros(256, dtype=bool)
        hexes[list(b"0123456789abcdef")] = True
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            spans = [code_points(t, scan(t, machine, hexes)) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(("kind", "start", "end"), x)) for x in s] for s in spans], kind)], [PACKED, "spans"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias(PACKED), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = rows.select(PACKED).schema.add("spans", SPANS)
    return rows.mapInArrow(run, schema).select(*[F.col(f"{PACKED}.`{c}`") for c in keep], "spans")
