"""Token ids in binary files: documents compressed one by one with a shared zstandard dictionary.

Format of a file, integers little-endian::

    "PWID" u32 version, u32 bytes per id, 32 bytes SHA-256 of the dictionary
    a zstandard frame for each document: its ids, all of the same width
    index: for each document i64 doc_id, u8 whether it is null, u64 offset, u32 length, u64 ids
    u64 offset of the index, u64 documents, "PWID"

A reader takes the index from the end of the file and can decompress any single document; the dictionary lies beside the
files under its hash.  Documents are stored in ascending doc_id order, nulls first, ties by a hash of the text; files
are named in that order, and ``start`` counts the ids of all documents before.

Encoding: a text is cut where something else is followed by an ASCII blank and between ASCII letters, digits and marks, which
are always boundaries of the byte-level pre-tokenizer, so equal pieces have equal ids wherever they stand; a bounded table
holds the ids of pieces seen, and ids of a text are gathered from it.  The strings of added tokens in a text become those
tokens, as the library has it.  Texts are never cut short; a very long one makes a group, and a frame, of its own.
Null and empty texts have the end id alone; repeated rows are documents of their own; an empty table makes no file.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import types
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.blobs import open_fs
from pagewright.llm.common import scratch, stored
from pagewright.llm.words import each, groups, mix

MAGIC, VERSION = b"PWID", 1
HEAD = "<4sII32s"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u8")])
TAIL = "<QQ4s"
END_ID = 2
#: The dictionary is trained on at most so many documents, those with the smallest hash of doc_id, and so many characters of each.
SAMPLE, DICTIONARY_BYTES, SAMPLE_CHARS = 2_000, 64 << 10, 8 << 10
LEVEL = 3
#: The table of known pieces has so many slots, of which half may be used, and at most so many ids.
SLOTS, TABLE_IDS = 1 << 21, 1 << 23
#: Pieces of more bytes than fit two words are kept in a dictionary; longer ones than LONGEST aren't kept.
SHORT, LONGEST = 15, 256
GROUP_BYTES = 1 << 20
FILE_BYTES = 64 << 20
_U = np.uint64
#: Classes of bytes: others, ASCII blanks, letters, digits, and marks without the apostrophe.
OTHER, BLANK, LETTER, DIGIT, MARK = range(5)


def byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.uint8)
    out[33:127] = MARK
    out[[0x20, 9, 10, 11, 12, 13]] = BLANK
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[39] = OTHER
    return out


def cut_table() -> np.ndarray:
    """Whether the pre-tokenizer always cuts between bytes of two classes, at 8 * first + second."""
    out = np.zeros(64, dtype=bool)
    for a in range(5):
        for b in range(5):
            out[8 * a + b] = (a != BLANK and b == BLANK) or (a != b and min(a, b) >= LETTER)
    return out


def kept_by_process() -> dict:
    """A dictionary that lives as long as the Python worker."""
    return sys.modules.setdefault("__pagewright_kept__", types.ModuleType("__pagewright_kept__")).__dict__


CLASS, CUT = byte_classes(), cut_table()
#: Pieces that are one pre-token: letters, digits or marks, one blank before them or none.
ONE_TOKEN = re.compile(" ?(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9]+|[!\"#-&(-/:-@\\[-`{-~]+)")


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others as the letters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + other.index(b)) for b in range(256)}


BYTE_LETTERS = byte_letters()
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def after_wide_blank(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is a blank outside ASCII, in UTF-8."""
    x, y, z = (buf[at - k].astype(np.uint32) if k <= 2 else buf[np.maximum(at - k, 0)].astype(np.uint32) for k in (1, 2, 3))
    three = (z << 16) | (y << 8) | x
    wide = (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
    wide |= (three >= 0xE28080) & (three <= 0xE2808A)
    for c in (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080):
        wide |= three == c
    return wide


def starts_of(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in texts laid end to end; ``bounds`` are the texts' bounds."""
    c = CLASS[buf]
    cut = np.empty(len(buf), dtype=bool)
    cut[:1] = True
    cut[1:] = CUT[(c[:-1] << 3) | c[1:]]
    doubtful = np.flatnonzero(cut[2:] & (buf[1:-1] >= 0x80)) + 2
    if len(doubtful):
        cut[doubtful[after_wide_blank(buf, doubtful)]] = False
    cut[bounds[:-1][bounds[:-1] < len(buf)]] = True
    return np.flatnonzero(cut)


class Table:
    """Ids of pieces: a hash table of numpy arrays whose keys are the pieces' own bytes, so that equal keys are equal pieces.

    A piece's first eight bytes are one word of its key; the other holds the next seven and the length, which is never 0.
    """

    def __init__(self, slots: int):
        self.slots = slots
        self.low, self.high = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.uint64)
        self.entry = np.zeros(self.slots, dtype=np.int32)
        self.start, self.count, self.ids, self.n, self.n_ids = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int32), np.zeros(4096, dtype=np.uint32), 0, 0
        self.long: dict[bytes, int] = {}

    def add(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """New entries, for ids one after another and how many each has."""
        while self.n + len(count) > len(self.start):
            self.start, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        new = np.arange(self.n, self.n + len(count))
        self.count[new] = count
        self.start[new] = self.n_ids + np.cumsum(count) - count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(count), self.n_ids + len(ids)
        return new

    def spot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low + high * _U(0x9E3779B97F4A7C15)) & _U(self.slots - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entries of keys, -1 for unknown ones."""
        out = np.full(len(low), -1, dtype=np.int64)
        at, spot = np.arange(len(low)), self.spot(low, high)
        while len(at):
            there = self.high[spot]
            hit = (there == high[at]) & (self.low[spot] == low[at])
            out[at[hit]] = self.entry[spot[hit]]
            on = ~hit & (there != 0)
            at, spot = at[on], (spot[on] + 1) & (self.slots - 1)
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        """Puts distinct unknown keys in; the table grows if they don't fit."""
        while 2 * (np.count_nonzero(self.high) + len(low)) > self.slots:
            used = np.flatnonzero(self.high)
            old = self.low[used], self.high[used], self.entry[used]
            self.slots *= 2
            self.low, self.high, self.entry = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.int32)
            self._place(*old)
        self._place(low, high, entry)

    def _place(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        at, spot = np.arange(len(low)), self.spot(low, high)
        while len(at):
            free = np.flatnonzero(self.high[spot] == 0)
            _, first = np.unique(spot[free], return_index=True)
            put = free[first]
            self.low[spot[put]], self.high[spot[put]], self.entry[spot[put]] = low[at[put]], high[at[put]], entry[at[put]]
            left = np.ones(len(at), dtype=bool)
            left[put] = False
            at, spot = at[left], (spot[left] + 1) & (self.slots - 1)


class Encoder:
    """Ids of texts by the tokenizers library, each kind of piece encoded once as long as a bounded table holds it.

    Texts laid end to end are cut into pieces, pieces are looked up all at once, and only unknown ones are encoded.  Texts
    that contain an added token, and all texts of a tokenizer that isn't plainly byte-level, are encoded as a whole.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.table = slots, Table(slots)
        cutter = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and type(cutter).__name__ == "ByteLevel" and not cutter.add_prefix_space and cutter.use_regex
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    @classmethod
    def of_process(cls, path: str):
        kept = kept_by_process()
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _direct(self, piece: str) -> list[int]:
        """Ids of a piece that is one pre-token."""
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))]

    def _known(self, pieces: list[bytes]) -> np.ndarray:
        """New entries for unknown pieces; those that are one pre-token go to the tokenizer's model without its other steps."""
        texts = [p.decode() for p in pieces]
        single = [ONE_TOKEN.fullmatch(t) is not None for t in texts]
        rest = iter(self._whole([t for t, s in zip(texts, single) if not s]))
        ids = [self._direct(t) if s else next(rest) for t, s in zip(texts, single)]
        return self.table.add(np.array(list(chain.from_iterable(ids)), dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64))

    def _entries(self, data: bytes, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of the pieces of texts laid end to end, and the pieces' starts."""
        t = self.table
        start = starts_of(buf, bounds)
        size = np.diff(np.append(start, len(buf)))
        words = np.ndarray(len(buf) + 1, dtype="<u8", buffer=data, strides=(1,))
        low = words[start] & KEEP[np.minimum(size, 8)]
        high = np.zeros(len(start), dtype=np.uint64)
        two = np.flatnonzero(size > 8)
        high[two] = words[np.minimum(start[two] + 8, len(buf))] & KEEP[np.minimum(size[two] - 8, 7)]
        high |= np.minimum(size, 255).astype(np.uint64) << _U(56)
        short = size <= SHORT
        if short.all():
            entry = t.find(low, high)
        else:
            entry = np.full(len(start), -1, dtype=np.int64)
            entry[short] = t.find(low[short], high[short])
        new = np.flatnonzero(short & (entry < 0))
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            head = np.concatenate(([True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])))
            first = order[head]
            made = self._known([data[a:b] for a, b in zip(start[first].tolist(), (start[first] + size[first]).tolist())])
            t.insert(low[first], high[first], made)
            entry[order] = made[np.cumsum(head) - 1]
        long = np.flatnonzero(~short)
        if len(long):
            pieces = [data[a:b] for a, b in zip(start[long].tolist(), (start[long] + size[long]).tolist())]
            unknown = list({p: None for p in pieces if p not in t.long})
            made = dict(zip(unknown, self._known(unknown).tolist()))
            t.long.update((p, e) for p, e in made.items() if len(p) <= LONGEST)
            entry[long] = [made[p] if p in made else t.long[p] for p in pieces]
        return entry, start

    def __call__(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, each followed by ``end``, and the texts' bounds in them."""
        if 2 * self.table.n > self.most or self.table.n_ids > TABLE_IDS:
            self.table = Table(self.most)
        whole = [not self.plain or any(a in x for a in self.added) for x in texts]
        apart = dict(zip(np.flatnonzero(whole).tolist(), self._whole([x.decode() for x, w in zip(texts, whole) if w])))
        bounds = np.concatenate(([0], np.cumsum([0 if w else len(x) for x, w in zip(texts, whole)]))).astype(np.int64)
        data = b"".join([*(x for x, w in zip(texts, whole) if not w), b"\0" * 8])
        buf = np.frombuffer(data, dtype=np.uint8)[: bounds[-1]]
        entry, start = self._entries(data, buf, bounds) if len(buf) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        t = self.table
        more = [*apart.values(), [] if end is None else [end]]
        last = t.add(np.array(list(chain.from_iterable(more)), dtype=np.uint32), np.array([len(x) for x in more], dtype=np.int64))
        first = np.searchsorted(start, bounds)
        # Every text's pieces, its own entry if it is encoded apart, and the end.
        extra = np.full((len(texts), 2), last[-1])
        used = np.tile([False, end is not None], (len(texts), 1))
        for k, i in enumerate(apart):
            extra[i, 0], used[i, 0] = last[k], True
        line = np.insert(entry, np.repeat(first[1:], used.sum(axis=1)), extra[used])
        n = t.count[line].astype(np.int64)
        done = np.cumsum(n)
        walk = np.repeat(t.start[line] - (done - n), n) + np.arange(done[-1] if len(done) else 0)
        ends = first[1:] + np.cumsum(used.sum(axis=1))
        return t.ids[walk], np.concatenate(([0], np.concatenate(([0], done))[ends]))


def width_of(path: str) -> int:
    """Bytes that every id of the tokenizer and the end id fit in."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), END_ID + 1) <= 1 << 16 else 4


def train(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


class FileWriter:
    def __init__(self, folder: str, stem: str, dictionary: bytes, width: int):
        self.fs, self.folder = open_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.stem, self.width, self.digest = stem, width, hashlib.sha256(dictionary).digest()
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(dict_data=shared)
        self.k, self.out = 0, None

    def add(self, doc_id: int | None, data: bytes | memoryview):
        """Appends a document's serialised ids; returns the file's (name, documents, ids) once it is full."""
        if self.out is None:
            self.name, self.index = f"{self.stem}-{self.k:04d}.ids", []
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.out.write(struct.pack(HEAD, MAGIC, VERSION, self.width, self.digest))
            self.at = struct.calcsize(HEAD)
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.at, len(frame), len(data) // self.width))
        self.at += len(frame)
        return self.close() if self.at >= FILE_BYTES else None

    def close(self):
        if self.out is None:
            return None
        index = np.array(self.index, dtype=ENTRY)
        self.out.write(index.tobytes())
        self.out.write(struct.pack(TAIL, self.at, len(index), MAGIC))
        self.out.close()
        self.out, self.k = None, self.k + 1
        return self.name, len(index), int(index["ids"].sum())


class FileReader:
    """Random access to the documents of a file."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        fs, root = open_fs(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        at, n, magic = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        head, version, self.width, digest = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        if head != MAGIC or magic != MAGIC or version != VERSION:
            raise ValueError(f"{name} is no id file")
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), dtype=ENTRY)
        if dictionary is None:
            with fs.open_input_stream(f"{root}/dictionary-{digest.hex()}", compression=None) as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name} was written with another dictionary")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        e = self.index[i]
        return np.frombuffer(self.unpack.decompress(self.file.read_at(int(e["length"]), int(e["offset"]))), dtype=f"<u{self.width}")

    def doc_id(self, i: int) -> int | None:
        e = self.index[i]
        return None if e["null"] else int(e["doc_id"])


def store_dictionary(folder: str, dictionary: bytes) -> None:
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{hashlib.sha256(dictionary).hexdigest()}", compression=None) as f:
        f.write(dictionary)


def sample_pieces(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text): a piece of at most SAMPLE_CHARS characters, from a hashed place, of a text of each of ``sample`` doc_ids at most.

    The doc_ids with the smallest hashes are taken; of an id's texts the one with the smallest hash, so reruns agree.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("wanted"))
    at = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1).cast("long"), F.char_length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    piece = F.struct(F.xxhash64("text").alias("hash"), F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("text"))
    chosen = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["wanted"]), "left_semi").select("doc_id", piece.alias("piece"))
    return chosen.groupBy("doc_id").agg(F.min("piece").alias("piece")).select(F.col("piece.text").alias("text"))


def learn_dictionary(docs: DataFrame, tokenizer: str, width: int, sample: int = SAMPLE) -> bytes:
    """docs: doc_id, text."""

    def run(batches):
        encode = Encoder.of_process(tokenizer)
        for b in batches:
            for texts in groups(each(b.column(0)), GROUP_BYTES):
                ids, bounds = encode(texts, END_ID)
                data = memoryview(ids.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([bytes(data[width * x : width * y]) for x, y in pairwise(bounds.tolist())], pa.binary())], ["data"])

    return train(sorted(r["data"] for r in sample_pieces(docs, sample).mapInArrow(run, "data binary").toArrow().to_pylist()))


def write_files(docs: DataFrame, folder: str, tokenizer: str, dictionary: bytes, width: int) -> DataFrame:
    """Writes the files and returns (file, docs, ids), unmaterialised.  docs: doc_id, text."""

    def write(batches):
        task = TaskContext.get()
        encode = Encoder.of_process(tokenizer)
        out = FileWriter(folder, f"docs-{task.partitionId():06d}-{task.taskAttemptId():08d}", dictionary, width)
        full = []
        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for texts in groups(each(b.column(1)), GROUP_BYTES):
                ids, bounds = encode(texts, END_ID)
                data = memoryview(ids.astype(f"<u{width}").tobytes())
                for x, y in pairwise(bounds.tolist()):
                    full.append(out.add(next(doc_ids), data[width * x : width * y]))
        full = [x for x in [*full, out.close()] if x]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in full], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "docs", "ids"])

    keyed = docs.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return dealt.mapInArrow(write, "file string, docs long, ids long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of files (file, before): before counts the ids of earlier files."""

    def read(batches):
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = FileReader(folder, name)
                rows = []
                for i in range(len(f.index)):
                    ids = f.ids(i)
                    rows.append((f.doc_id(i), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                for at in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at : at + 8192])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Encodes, writes and reads back docs; the documents' rows, and the folder of the files."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    top = scratch(spark, "ids")
    width = width_of(tokenizer)
    dictionary = learn_dictionary(docs, tokenizer, width)
    store_dictionary(f"{top}/files", dictionary)
    written = stored(write_files(docs, f"{top}/files", tokenizer, dictionary, width), f"{top}/written")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = written.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))
    n = max(1, written.count())
    return read_files(files.repartitionByRange(n, "file").select("file", "before"), f"{top}/files"), f"{top}/files"
