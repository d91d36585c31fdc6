"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

A document's set holds the hashes of its distinct ``WIDTH``-word shingles; words are runs without ASCII blanks, A-Z lower
case.  Documents with equal sets form a class, and only one row a class goes on.  A signature uses two permutations of
the 64-bit integers: the first scatters the set, the second is shifted circularly by 0, 1, 2 ... places to give one
coordinate each.  ``BANDS`` bands of ``ROWS`` coordinates make the buckets in which candidates meet.

Within a bucket no product of all pairs is made:

1. every member is compared with one hub of its bucket, and what is linked is contracted to components;
2. in buckets of at most ``SMALL`` members, pairs whose ends still lie in different components are compared;
3. in larger ones, members outside the bucket's largest component are compared with all members of like set size, block
   against block, and only links that join two components leave a block.

So every pair that shares a bucket is either compared on full sets or already connected.  Two documents of similarity s
share a bucket with probability 1 - (1 - s**4)**32, which is 0.999995 at 0.75.

Null and empty texts, and texts of blanks, have no set and are linked with nothing.  Repeated rows are copies.  Null
doc_ids come last when a component is named; a component of null ids only has a null id.  Texts are read whole, however
long; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import drop, packed, scratch, small, stored, unpacked
from pagewright.llm.graph import relabelled
from pagewright.llm.words import WordHasher, blank_bytes, groups, mix, shingles

WIDTH, ROWS, BANDS = 5, 4, 32
PERCENT = 75
SMALL, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 20
#: Sizes of sets in one band differ by this factor at most; it is just over 4/3, by which sets that are alike may differ.
BAND = 1.34
#: Buckets with more members than HOT are joined by broadcast, if they are few enough.
HOT = 256
CHUNK = 1 << 15
_U = np.uint64


def sets_of(hasher: WordHasher, texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    w = hasher(texts)
    s, first = shingles(w.hash, w.first, width)
    return [np.unique(s[first[i] : first[i + 1]]) for i in range(len(texts))]


def circulant(sets: list[np.ndarray], count: int = ROWS * BANDS) -> np.ndarray:
    """Signatures of sets that aren't empty: the least value of the second permutation, shifted by each coordinate, over the first one's values."""
    out = np.empty((len(sets), count), dtype=np.uint64)
    start = 0
    while start < len(sets):
        end, held = start, 0
        while end < len(sets) and (end == start or held + len(sets[end]) <= CHUNK):
            held += len(sets[end])
            end += 1
        base = mix(np.concatenate(sets[start:end]) ^ _U(0xA0761D6478BD642F))
        bounds = np.cumsum([0, *(len(s) for s in sets[start : end - 1])])
        x, t = np.empty_like(base), np.empty_like(base)
        for k in range(count):
            np.add(base, _U(k), out=x)
            x *= _U(0xE7037ED1A0B428DB)
            np.right_shift(x, _U(32), out=t)
            x ^= t
            x *= _U(0x8EBC6AF09C88C6E3)
            out[start:end, k] = np.minimum.reduceat(x, bounds)
        start = end
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for every band, the band's number included."""
    n, count = signature.shape
    bands = signature.reshape(n, count // rows, rows)
    key = np.broadcast_to(np.arange(count // rows, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), n (set size), d1 and d2 (the set's digest) and keys (of the bands)."""

    def run(batches):
        hasher = WordHasher(blank_bytes())
        for b in batches:
            n, d1, d2, keys, bounds = [], [], [], [], [0]
            for texts in groups(b.column(2).cast(pa.binary()).to_pylist()):
                sets = sets_of(hasher, texts)
                full = [s for s in sets if len(s)]
                if full:
                    keys.append(band_keys(circulant(full)).ravel())
                for s in sets:
                    n.append(len(s))
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    d1.append(digest[0])
                    d2.append(digest[1])
                    bounds.append(bounds[-1] + (BANDS if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], ["doc_id", "key", "n", "d1", "d2", "keys"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, d1 long, d2 long, keys array<long>")


class Candidates:
    """The texts of classes that share a bucket, fetched once, and exact verification of pairs of them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, nodes: DataFrame, repeats: bool, folder: str, doc_id: str, text: str):
        self.classes, self.folder = classes, folder
        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("least.doc_id").alias("wanted_id"), F.col("least.key").alias("wanted_key"))
        docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
        found = docs.join(wanted, (F.col("key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("node", "text")
        self.texts = stored(found.dropDuplicates(["node"]) if repeats else found, f"{folder}/texts")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are alike; sizes are compared before any text is joined."""
        for c in ("a", "b"):
            pairs = pairs.join(self.classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}")), c)
        pairs = stored(pairs.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b"), f"{self.folder}/{name}-pairs")

        def verify(batches):
            hasher = WordHasher(blank_bytes())
            for t in batches:
                for lo in range(0, t.num_rows, 512):
                    part = t.slice(lo, 512)
                    data, place = [], {}
                    ends = [[place.setdefault(x, len(place)) for x in part.column(c).cast(pa.binary()).to_pylist()] for c in (2, 3)]
                    data = list(place)
                    sets = [s for g in groups(data) for s in sets_of(hasher, g)]
                    yield part.select(["a", "b"]).filter(pa.array([alike(sets[i], sets[j]) for i, j in zip(*ends)], pa.bool_()))

        ends = [self.texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b")]
        both = pairs.join(ends[0], "a").join(ends[1], "b")
        return stored(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), f"{self.folder}/{name}-links")


def by_key(rows: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """rows (key, ...) joined with buckets (key, size, ...), which are stored.

    Buckets of more than ``HOT`` members, which are few, go to the rows by broadcast; only other rows are shuffled.
    """
    hot = buckets.where(F.col("size") > HOT)
    sent = small(hot)
    rest = rows.join(small(hot.select("key")), "key", "left_anti")
    return rows.join(sent, "key", how).unionByName(rest.join(buckets.where(F.col("size") <= HOT), "key", how))


def _rooted(members: DataFrame, labels: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """members with their components, and the buckets that still hold more than one."""
    m = members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    open_ = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("size").alias("size")).where("lo <> hi").select("key", "size")
    return m, stored(open_, path)


def _small_pairs(rows: DataFrame) -> DataFrame:
    """Pairs across components in buckets of at most SMALL members."""
    listed = rows.groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("m"))
    pairs = F.expr("flatten(transform(m, x -> transform(filter(m, y -> y.node > x.node and y.root <> x.root), y -> struct(x.node as a, y.node as b))))")
    return listed.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _block_links(rows: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Links that join components of large buckets: members outside the largest component against all members, in blocks.

    rows: key, node, root, n.  Sets whose sizes differ by more than a third can't be alike, so members meet in bands of
    sizes only: a member is in its own band, a stray in that and the two beside it.  Blocks are bounded by documents and
    by shingles.
    """
    counts = rows.groupBy("key", "root").count()
    main = stored(counts.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main")), f"{folder}/mains")
    spot = F.xxhash64("node", F.lit(7))
    rows = rows.join(small(main), "key").withColumn("spot", spot).withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))))
    strays = rows.where("root <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    blocks = lambda name: F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name)
    cut = stored(rows.groupBy("key", "band").agg(blocks("nm")).join(strays.groupBy("key", "band").agg(blocks("ns")), ["key", "band"]), f"{folder}/cut")
    every = rows.join(small(cut), ["key", "band"]).select("key", "band", F.pmod("spot", "nm").cast("int").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("sb"), F.lit(0).alias("role"), "node", "root")
    strays = strays.join(small(cut), ["key", "band"]).select("key", "band", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), F.pmod("spot", "ns").cast("int").alias("sb"), F.lit(1).alias("role"), "node", "root")
    dealt = every.unionAll(strays).join(texts, "node")

    def compare(block: pa.Table) -> pa.Table:
        hasher = WordHasher(blank_bytes())
        role, node = block["role"].to_numpy(), block["node"].to_numpy()
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        root = block["root"].to_pylist()
        sets = [s for g in groups(block["text"].cast(pa.binary()).to_pylist()) for s in sets_of(hasher, g)]
        size = np.array([len(s) for s in sets])
        own, sought = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        a, b = [], []
        if len(own) and len(sought):
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            bounds = np.concatenate(([0], np.cumsum(size)))
            flat = np.concatenate([code[bounds[i] : bounds[i + 1]] for i in own])
            first = np.concatenate(([0], np.cumsum(size[own])))[:-1]
            mark = np.zeros(int(code.max()) + 1, dtype=np.int32)
            for i in sought:
                mine = code[bounds[i] : bounds[i + 1]]
                mark[mine] = 1
                both = np.add.reduceat(mark[flat], first)
                mark[mine] = 0
                for j in own[100 * both >= PERCENT * (size[own] + size[i] - both)]:
                    x, y = find(root[i]), find(root[j])
                    if x != y:
                        parent[x] = y
                        a.append(node[i])
                        b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "band", "mb", "sb").applyInArrow(compare, "a long, b long")


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n, component_id and keeper (the text hash of the component's document that stays) of every row."""
    spark: SparkSession = docs.sparkSession
    top = scratch(spark, "neardup")
    sig = stored(signatures(docs, doc_id, text), f"{top}/signatures")
    repeats = not sig.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("least")
    classes = sig.where("n > 0").groupBy("d1", "d2").agg(least, F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), f"{top}/classes")
    banded = classes.select("node", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(buckets.select("key", F.when(F.col("key") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("hub"), "size"), f"{top}/buckets")
    members = stored(by_key(banded, buckets), f"{top}/members")
    drop(spark, f"{top}/buckets")

    known = Candidates(docs, classes, members.select("node").distinct(), repeats, top, doc_id, text)
    stars = members.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    stars = stored(stars, f"{top}/stars")
    labels = relabelled(None, known.linked(stars, "star"), f"{top}/graph-1")

    rows, open_ = _rooted(members.where(F.col("size") <= SMALL), labels, f"{top}/open-1")
    more = _small_pairs(rows.join(open_, "key", "left_semi")).join(stars, ["a", "b"], "left_anti")
    labels = relabelled(labels, known.linked(more, "rest"), f"{top}/graph-2")

    rows, open_ = _rooted(members.where(F.col("size") > SMALL), labels, f"{top}/open-2")
    rows = by_key(rows, open_, "left_semi").join(classes.select("node", "n"), "node")
    rows = stored(rows, f"{top}/large")
    if not rows.isEmpty():
        links = stored(_block_links(rows, known.texts, top), f"{top}/block-links")
        labels = relabelled(labels, links, f"{top}/graph-3")

    rooted = classes.select("d1", "d2", "node", "least").join(labels, "node", "left").select("d1", "d2", "least", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, f"{top}/rooted")
    heads = stored(rooted.groupBy("root").agg(F.min("least").alias("head")), f"{top}/heads")
    found = stored(rooted.join(heads, "root").select("d1", "d2", F.col("head.doc_id").alias("component_id"), F.col("head.key").alias("keeper")), f"{top}/found")
    drop(spark, *(f"{top}/{x}" for x in ("members", "stars", "graph-1", "graph-2", "graph-3", "large", "texts", "open-1", "open-2", "mains", "cut", "rooted", "heads")))
    out = sig.select("doc_id", "key", "n", "d1", "d2").join(found, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "key", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("key")).otherwise(F.col("keeper")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of every component: that with the smallest doc_id, and one row of it if the row is repeated.

    Documents without words all stay.
    """
    marked = components_of(docs, doc_id, text)
    stay = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("keeper"))).groupBy("doc_id", "key").agg(F.max("n").alias("__n")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__n")
    rows = packed(docs, F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_key"), F.col(f"`{doc_id}`").cast("long").alias("row_id"))
    out = rows.join(stay, F.col("row_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    if not marked.where("n > 0").groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        blank = out.where("__n = 0")
        out = out.where("__n > 0").dropDuplicates(["__id", "__key"]).unionByName(blank)
    return unpacked(out, docs.columns)
