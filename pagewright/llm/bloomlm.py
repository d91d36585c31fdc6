"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text (runs without ASCII blanks, A-Z lower case) and one end mark; a token is known by a 64-bit
hash.  N-grams of ``ORDER`` tokens and fewer, the first of a text after a start mark, are counted over all training
documents.  A count c is quantised to level 1 + floor(log(c) / log(BASE)), and the filter holds the pairs (n-gram, 1) to
(n-gram, level); a probe asks for level 1, 2, ... until one is missing and takes the middle of the last level as the
count.  Probabilities are Dirichlet-smoothed: (count + PRIOR * lower order) / (history's count + PRIOR).

The filter has ``BITS_PER_ITEM`` bits for each pair whatever the corpus.  It lies in the shared folder in blocks, one for
each bucket of n-gram hashes, and is neither broadcast nor read as a whole: texts to score are cut into chunks of about
``FLUSH`` tokens, whose distinct n-grams are written there by range of buckets; a task for each range reads the range's
blocks and n-grams and sends the levels back to the chunks.

``base_score`` is exact: of the tokens' counts the largest (at most ``FREQUENT`` tokens, 12 bytes each) are broadcast, and
all other tokens of a document are looked up by a join.

Null and empty texts are an end mark alone.  Repeated rows are scored, and counted, each for itself.  A null doc_id is in
no remainder class, so its row is trained on.  Without training documents every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blobs import RollingWriter, open_fs
from pagewright.llm.common import crc_class, drop, scratch, stored
from pagewright.llm.words import WordHasher, blank_bytes, each, groups, mix

ORDER = 2
BASE = 1.5
PRIOR = 4.0
PROBES = 4
BITS_PER_ITEM = 12
FREQUENT, TOP = 1 << 20, 1024
KEY_BITS = 40
FLUSH = 1 << 20
#: Blocks that one task probes have about so many bytes; there are 64 ranges of them at least, or as many as buckets.
RANGE_BYTES, RANGE_BITS = 16 << 20, 6
#: Training text for each bucket of n-gram hashes.
BUCKET_BYTES = 4 << 20
ASK_BYTES = 64 << 20
START, END = 0x5851F42D4C957F2D, 0x14057B7EF767814F
_U = np.uint64


def extended(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start mark, tokens and end mark of every text in one array, and the texts' bounds in it."""
    count = np.diff(first)
    bounds = np.concatenate(([0], np.cumsum(count + 2)))
    out = np.empty(bounds[-1], dtype=np.uint64)
    out[bounds[:-1]], out[bounds[1:] - 1] = _U(START), _U(END)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], count) + np.repeat(bounds[:-1], count) + 1
    out[place] = hashes
    return out, bounds


def grams(seq: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each place of seq, and whether they lie in one text."""
    h = np.full(len(seq), _U(n))
    at = np.arange(len(seq)) - np.repeat(bounds[:-1], np.diff(bounds))
    for j in range(n - 1, -1, -1):
        back = np.zeros(len(seq), dtype=np.uint64)
        back[j:] = seq[: len(seq) - j]
        h = h * _U(0xD1342543DE82EF95) + back
    return mix(h), at >= n - 1


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.asarray(level, dtype=float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def split_key(h: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, from the first bits of a hash, and the next KEY_BITS bits."""
    if not bucket_bits:
        return np.zeros(len(h), dtype=np.int64), h >> _U(64 - KEY_BITS)
    return (h >> _U(64 - bucket_bits)).astype(np.int64), (h << _U(bucket_bits)) >> _U(64 - KEY_BITS)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    n = len(sorted_values)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n])) if n else np.zeros(1, dtype=np.int64)


def cells(data: bytes, bounds: np.ndarray) -> pa.Array:
    """Binary values that follow one another in data, without a Python object for each."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def spots(key: np.ndarray, level: int, block_bits: int) -> list[np.ndarray]:
    """Bits of (key, level) inside its block."""
    x = mix(key + _U((level * 0x9E3779B97F4A7C15) % 2**64))
    step = (x >> _U(32)) | _U(1)
    return [((x + _U(i) * step) % _U(block_bits)).astype(np.int64) for i in range(PROBES)]


def pack5(key: np.ndarray) -> bytes:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack5(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel().astype(np.uint64)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed weights."""
    order = np.argsort(keys, kind="stable") if weights is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    if weights is None:
        return keys[edge], np.diff(np.append(edge, len(keys)))
    return keys[edge], np.add.reduceat(weights[order], edge) if len(edge) else weights[:0]


def count_grams(docs: DataFrame, bucket_bits: int) -> DataFrame:
    """(bucket, kind, keys, counts): what each task has counted, packed by bucket of the hash.

    kind 0: tokens, 8-byte hashes; kind 1: n-grams of all orders, 5-byte keys.  Counts take 4 bytes.
    """

    def run(batches):
        hasher = WordHasher(blank_bytes())
        held: dict[int, list] = {0: [], 1: []}
        n_held = 0

        def flush():
            for kind, parts in held.items():
                h, c = tally(np.concatenate(parts)) if parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
                parts.clear()
                bucket, key = split_key(h, bucket_bits)
                edge = runs(bucket)
                keys, size = (h.astype("<u8").tobytes(), 8) if kind == 0 else (pack5(key), 5)
                out = pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(np.full(len(edge) - 1, kind, dtype=np.int32)), cells(keys, size * edge), cells(c.astype("<u4").tobytes(), 4 * edge)], ["bucket", "kind", "keys", "counts"])
                for at in range(0, out.num_rows, 256):
                    yield out.slice(at, 256)

        for b in batches:
            for texts in groups(each(b.column(0))):
                w = hasher(texts)
                seq, bounds = extended(w.hash, w.first)
                is_start = np.zeros(len(seq), dtype=bool)
                is_start[bounds[:-1]] = True
                held[0].append(seq[~is_start])
                for n in range(1, ORDER + 1):
                    h, inside = grams(seq, bounds, n)
                    held[1].append(h[inside])
                n_held += len(seq)
                if n_held >= FLUSH:
                    yield from flush()
                    n_held = 0
        yield from flush()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "bucket long, kind int, keys binary, counts binary")


def block_of(key: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The filter's block for the keys of a bucket and their levels, as bytes."""
    flags = np.zeros(-(-max(1024, int(level.sum()) * BITS_PER_ITEM) // 8) * 8, dtype=bool)
    for j in range(1, int(level.max()) + 1):
        for s in spots(key[level >= j], j, len(flags)):
            flags[s] = True
    return np.packbits(flags, bitorder="little")


def block_levels(block: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Levels of the keys of a bucket, by repeated probes of its block."""
    out = np.zeros(len(key), dtype=np.uint8)
    alive, j = np.arange(len(key)), 1
    while len(alive) and j < 256:
        hit = np.ones(len(alive), dtype=bool)
        for at in spots(key[alive], j, 8 * len(block)):
            hit &= (block[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        alive = alive[hit]
        out[alive] = j
        j += 1
    return out


def merged(partial: DataFrame, folder: str) -> DataFrame:
    """One row for each bucket and kind: tokens with summed counts, or where the filter's block lies: file, at and size.

    A task has the rows of its buckets sorted, by Spark, and holds one bucket at a time.
    """
    names, types = ["bucket", "kind", "keys", "counts", "file", "at", "size"], (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        task = TaskContext.get()
        out = RollingWriter(folder, f"blocks-{task.partitionId():06d}-{task.taskAttemptId():08d}", ".bits", ASK_BYTES)
        held: list[tuple[bytes, bytes]] = []

        def finished(kind: int, bucket: int):
            read = (lambda d: np.frombuffer(d, dtype="<u8")) if kind == 0 else unpack5
            keys, counts = tally(np.concatenate([read(k) for k, _ in held]), np.concatenate([np.frombuffer(c, dtype="<u4") for _, c in held]).astype(np.int64))
            held.clear()
            row: list = [bucket, kind, None, None, None, None, None]
            if kind == 0:
                row[2:4] = keys.astype("<u8").tobytes(), counts.astype("<i8").tobytes()
            else:
                data = block_of(keys, np.minimum(levels(counts), 255)).tobytes()
                row[4:] = *out.append(data), len(data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        now = None
        for b in batches:
            keys, counts = b.column("keys"), b.column("counts")
            for i, one in enumerate(zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist())):
                if now is not None and one != now:
                    yield finished(*now)
                now = one
                held.append((keys[i].as_py(), counts[i].as_py()))
        if now is not None:
            yield finished(*now)
        out.close()
        pa.default_memory_pool().release_unused()

    dealt = partial.repartition("bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(run, "bucket long, kind int, keys binary, counts binary, file string, at long, size long")


def token_counts(tables: DataFrame) -> DataFrame:
    """(token, n) from the merged buckets."""

    def run(batches):
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, c = np.frombuffer(keys, dtype="<i8"), np.frombuffer(counts, dtype="<i8")
                for at in range(0, len(h), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 16)]), pa.array(c[at : at + (1 << 16)])], ["token", "n"])

    return tables.where("kind = 0").select("keys", "counts").mapInArrow(run, "token long, n long")


def probed(asks: DataFrame, blocks: DataFrame, folder: str, bucket_bits: int, range_bits: int) -> DataFrame:
    """(chunk, range, levels, file, index_at, index_size) of every chunk's n-grams in a range of buckets.

    asks: chunk, range, file, start and lengths of the range's keys, by bucket; blocks: bucket, file, at, size.
    """
    width = 1 << (bucket_bits - range_bits)
    spot = blocks.select(F.lit(None).cast("long").alias("chunk"), F.shiftright("bucket", bucket_bits - range_bits).cast("int").alias("range"), "file", F.col("bucket").alias("index_at"), F.col("size").alias("index_size"), F.col("at").alias("start"), F.lit(None).cast("binary").alias("lengths"))

    def run(table: pa.Table) -> pa.Table:
        first = table["range"][0].as_py() * width
        fs, root = open_fs(folder)
        is_block = pc.is_null(table["chunk"])
        blocks = {}
        for bucket, file, at, size in zip(*(table.filter(is_block)[c].to_pylist() for c in ("index_at", "file", "start", "index_size"))):
            with fs.open_input_file(f"{root}/{file}") as f:
                blocks[bucket - first] = np.frombuffer(f.read_at(size, at), dtype=np.uint8)
        table = table.filter(pc.invert(is_block))
        found: list[bytes] = []
        held: list[np.ndarray] = []

        def answer():
            distinct, where = np.unique(np.concatenate(held), return_inverse=True)
            edge = np.searchsorted(distinct, np.arange(width + 1, dtype=np.uint64) << _U(KEY_BITS))
            level = np.zeros(len(distinct), dtype=np.uint8)
            for k, block in blocks.items():
                s = slice(edge[k], edge[k + 1])
                level[s] = block_levels(block, distinct[s] & _U((1 << KEY_BITS) - 1))
            found.extend(x.tobytes() for x in np.split(level[where], np.cumsum([len(x) for x in held])[:-1]))
            held.clear()

        for name, start, lengths in zip(*(table[c].to_pylist() for c in ("file", "start", "lengths"))):
            n = np.frombuffer(lengths, dtype="<i4")
            with fs.open_input_file(f"{root}/{name}") as f:
                key = unpack5(f.read_at(5 * int(n.sum()), start))
            held.append(np.repeat(np.arange(width, dtype=np.uint64) << _U(KEY_BITS), n) | key)
            if sum(map(len, held)) >= FLUSH:
                answer()
        if held:
            answer()
        return table.select(["chunk", "range", "file", "index_at", "index_size"]).append_column("levels", pa.array(found, pa.binary()))

    # The rows are few and small, the n-grams that they point to aren't: a partition for each range, which nothing merges.
    return asks.unionByName(spot).repartitionByRange(1 << range_bits, "range").groupBy("range").applyInArrow(run, "chunk long, range int, file string, index_at long, index_size long, levels binary")


def chunk_scores(answers: DataFrame, folder: str, n_docs: int, n_train: int, scale: float) -> DataFrame:
    """(row, score) of every text from the levels of its chunk's n-grams."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        count = level_count(np.frombuffer(b"".join(table["levels"].to_pylist()), dtype=np.uint8).astype(np.int64))
        name, at, size = (table[c][0].as_py() for c in ("file", "index_at", "index_size"))
        fs, root = open_fs(folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read_at(size, at)), dtype="<i4")
        length, where = data[1 : 1 + data[0]], data[1 + data[0] :]
        bounds = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
        done = 0
        for n in range(1, ORDER + 1):
            inside = place >= max(1, n - 1)
            cn = np.zeros(len(place))
            cn[inside] = count[where[done : done + inside.sum()]]
            done += inside.sum()
            if n == 1:
                cn = np.minimum(cn, n_train)
                cn[bounds[:-1]] = n_docs
                p, history = (cn + 1) / scale, cn
                continue
            context = np.zeros(len(place))
            context[1:] = history[:-1]
            cn = np.minimum(cn, context)
            p = np.where(inside & (context > 0), (cn + PRIOR * p) / (context + PRIOR), p)
            history = np.where(inside, cn, 0)
        score = np.add.reduceat(np.log10(p[place > 0]), bounds[:-1] - np.arange(len(length)))
        return pa.table({"row": pa.array(table["chunk"][0].as_py() + np.arange(len(length))), "score": pa.array(score)})

    return answers.groupBy("chunk").applyInArrow(run, "row long, score double")


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Sorted hashes and counts of the tokens that occur at least so often that there are at most ``most``, and that bound.

    The bound is None, and there are no such tokens, where already those that occur ``TOP`` times or more are too many.
    """
    level = F.when(F.col("n") < TOP, F.col("n")).otherwise(F.lit(TOP))
    seen, bound = 0, None
    for r in sorted(counts.groupBy(level.alias("n")).count().collect(), key=lambda r: -r["n"]):
        seen += r["count"]
        if seen > most:
            break
        bound = r["n"]
    if bound is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), None
    got = counts.where(F.col("n") >= bound).toArrow()
    h, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], bound


def bits_for(n_bytes: int) -> int:
    """Buckets for so much training text, as a power of two: by the text alone, however its rows lie in files."""
    return max(RANGE_BITS, int(np.ceil(np.log2(max(1, n_bytes / BUCKET_BYTES)))))


def scores(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learning from train."""
    spark = docs.sparkSession
    top = scratch(spark, "lm")
    train = train.select(F.col(f"`{text}`").cast("string").alias("text"))
    bucket_bits = bits_for(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    folder = f"{top}/files"
    tables = stored(merged(count_grams(train, bucket_bits), folder), f"{top}/tables")
    counts = stored(token_counts(tables), f"{top}/counts")
    n_train, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_docs = counts.where(F.col("token") == int(np.uint64(END).astype(np.int64))).agg(F.max("n")).first()[0] or 0
    blocks = stored(tables.where("kind = 1").select("bucket", "file", "at", "size"), f"{top}/blocks")
    n_filter = blocks.agg(F.sum("size")).first()[0] or 0
    range_bits = min(bucket_bits, max(RANGE_BITS, int(np.ceil(np.log2(max(1, n_filter / RANGE_BYTES))))))
    known, known_n, bound = frequent_tokens(counts)
    sent = spark.sparkContext.broadcast((known.tobytes(), known_n.tobytes()))
    del known, known_n
    drop(spark, f"{top}/tables")
    scale = float(n_train + vocabulary + 1)

    def run(batches):
        task = TaskContext.get()
        hasher = WordHasher(blank_bytes())
        known, known_n = np.frombuffer(sent.value[0], dtype=np.uint64), np.frombuffer(sent.value[1], dtype=np.int64)
        asks = RollingWriter(folder, f"asks-{task.partitionId():06d}-{task.taskAttemptId():08d}", ".keys", ASK_BYTES)
        row = task.partitionId() << 33
        ids, hashes, lengths = [], [], []

        def chunk():
            nonlocal row
            seq, bounds = extended(np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))))
            n_here = len(bounds) - 1
            out: list = [None] * 11
            inner = np.ones(len(seq), dtype=bool)
            inner[bounds[:-1]] = False
            doc = np.repeat(np.arange(n_here), np.diff(bounds))
            token, where = np.unique(seq[inner], return_inverse=True)
            owner = doc[inner]
            place = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
            found = known[place] == token if len(known) else np.zeros(len(token), dtype=bool)
            c = np.where(found, known_n[place] if len(known) else 0, 0)
            base = np.where(found, np.log10((c + 1) / scale), 0.0)
            first = bounds[:-1] - np.arange(n_here)
            out[0] = pa.array(np.diff(bounds) - 1)
            out[1] = pa.array(np.add.reduceat(found[where].astype(np.int64), first))
            out[2] = pa.array(np.add.reduceat(base[where], first))
            rest = ~found[where]
            pair, n = np.unique(owner[rest] * len(token) + where[rest], return_counts=True)
            edge = np.searchsorted(pair, np.arange(n_here + 1) * len(token))
            out[3:5] = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x)) for x in (token[pair % len(token)].view(np.int64), n.astype(np.int32))]
            out[5] = pa.array(row + np.arange(n_here))

            h = [x[inside & inner] for x, inside in (grams(seq, bounds, n) for n in range(1, ORDER + 1))]
            h, where = np.unique(np.concatenate(h), return_inverse=True)
            bucket, key = split_key(h, bucket_bits)
            edge = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1))
            index = np.concatenate(([n_here], np.diff(bounds), where)).astype("<i4").tobytes()
            index = zstandard.ZstdCompressor(level=1).compress(index)
            file, at = asks.append(pack5(key) + index)
            step = 1 << (bucket_bits - range_bits)
            size = np.diff(edge).astype("<i4")
            head = [file, at + 5 * len(h), len(index), (at + 5 * edge[:-1:step]).tolist(), [size[k : k + step].tobytes() for k in range(0, len(size), step)]]
            for k, (x, t) in enumerate(zip(head, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())))):
                out[6 + k] = pa.array([x, *[None] * (n_here - 1)], t)
            out = [pa.concat_arrays(ids), *out]
            row += n_here
            for x in (ids, hashes, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_known", "base", "rare", "times", "row", "file", "index_at", "index_size", "starts", "lengths"])

        for b in batches:
            done = 0
            for texts in groups(each(b.column(1))):
                w = hasher(texts)
                ids.append(b.column(0).slice(done, len(texts)))
                hashes.append(w.hash)
                lengths.append(np.diff(w.first))
                done += len(texts)
                if sum(map(len, hashes)) + sum(map(len, lengths)) >= FLUSH:
                    yield chunk()
        if ids:
            yield chunk()
        asks.close()
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, rare array<bigint>, times array<int>, row long, file string, index_at long, index_size long, starts array<bigint>, lengths array<binary>")
    rows = stored(rows, f"{top}/rows")
    asks = rows.where("file is not null").select(F.col("row").alias("chunk"), "file", "index_at", "index_size", F.posexplode(F.arrays_zip("starts", "lengths")).alias("range", "a")).select("chunk", "range", "file", "index_at", "index_size", F.col("a.starts").alias("start"), "a.lengths")
    scored = chunk_scores(probed(asks, blocks, folder, bucket_bits, range_bits), folder, n_docs, int(n_train), scale)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    looked = rare.join(counts if bound is None else counts.where(F.col("n") < bound), "token", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    more = looked.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(scale))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = rows.select("row", "doc_id", "n_tokens", "n_known", "base").join(more, "row", "left").join(scored, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def held_out(doc_id: str = "doc_id"):
    """Rows that the models aren't trained on: crc32(doc_id as text) mod 7 is 2."""
    return F.coalesce(crc_class(doc_id, 7) == 2, F.lit(False))
