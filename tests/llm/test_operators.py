"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pagewright.llm import bloomlm, boosting, decontam, idfiles, mixing, neardup, quality, queries, secret_scan, sharding, toxicity, warc, words
from pagewright.llm.common import PACKED

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def sample(seed=0, n=60):
    """Rows with near copies, exact copies, nulls, empties, blanks and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 6, 40, 90]))]
        for copy in range(r.choice([1, 1, 3])):
            t = list(base)
            for _ in range(r.randint(0, 2) if copy else 0):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(t) + r.choice(["", ".\nTail line", "  "]), "en", r.choice(["a", "b", None, "ü"]), 1))
    rows += [(10_001, None, None, None, None), (10_002, "", "en", "a", 0), (10_003, " \n\t ", "en", "a", 4), (None, "one two three four five six", "en", "b", 1)]
    return rows + [rows[0], rows[1], rows[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def written(spark, tmp, **tables):
    for name, df in tables.items():
        df.coalesce(2).write.mode("overwrite").parquet(f"{tmp}/{name}.parquet")
    return str(tmp)


# 1


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/ b\r\nx", "same"), (3, None, "same"), (7, "http://c", None), (8, "http://d", ""), (9, "http://e", "é" * 3000), (5, "http://a", "same"), (None, "http://n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back, folder = warc.deduplicated_archives(spark, pages)
    got = back.toPandas()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got.itertuples():
        by[r.payload_digest].append(r)
    for payload in ("same", "", "é" * 3000):
        sha = warc.digest_of(payload.encode())
        ids = [i for i, _, h in rows if (h or "") == payload]
        want = min(i for i in ids if i is not None)
        assert len(by[sha]) == len(ids)
        assert [r.page_id for r in by[sha] if r.record_type == "response"] == [want]
        assert all(r.refers_to == want for r in by[sha] if r.record_type == "revisit")
        assert {r.payload_bytes for r in by[sha]} == {len(payload.encode())}
    fresh = set(got.record_id)
    assert len(fresh) == len(rows) and set(got.refers_to_record.dropna()) <= fresh
    large, _ = warc.deduplicated_archives(spark, pages, min_bytes=5)
    assert large.where("record_type = 'revisit'").count() == 0
    none, _ = warc.deduplicated_archives(spark, pages.limit(0))
    assert none.count() == 0


# 2

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_secret_scan(spark):
    r = random.Random(1)
    parts = ["password", "PassWD=", "secret: ", "token='", "api_key = ", "APIKEY:", "AKIA", "A" * 16, "abcdef012345", "f" * 24, "é", " ", '"', "=", ":", "xyz_123", "\n", "ſecret=abcdef", "0" * 30, "secretoken=aaaaaaaa", "g"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)]
    body = "A" * 30
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = secret_scan.BASE62[d] + digits
    texts += [None, "", f"key ghp_{body}{digits} end", f"key ghp_{body}000000 end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in secret_scan.scan_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in secret_scan.KINDS[:3]] == base_spans(t or ""), t
    extra = [s[0] for s in got[len(texts) - 2] if s[0] not in secret_scan.KINDS[:3]]
    assert extra == ["crc_token"] and not [s for s in got[len(texts) - 1] if s[0] == "crc_token"]
    assert secret_scan.bech32_holds("A12UEL5L") and not secret_scan.bech32_holds("A12UEL5X")


# 3


def counts(t):
    w = BLANK.findall(t or "")
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(hit)


def test_quality_counts(spark, docs, empty):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) + r.choice(["", "\nx y\nx y\n x y", " #*\x85\xa0|"]) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t, True, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, n_words int")
    forest = boosting.constant(1.0)
    for x in quality.judge(df, forest).collect():
        want = counts(x[PACKED]["text"])
        assert tuple(x[c] for c in quality.COUNTS) == want
        assert x["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and x["kept"] == (not x["base_failed"])
    assert quality.filter_quality(df, None).columns == df.columns
    assert quality.filter_quality(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert quality.filter_quality(df, labels).count() <= df.count()


def test_boosting():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (r.random(3000) < 0.05)).astype(float)
    f = boosting.fit(x, y, [1, 0, -1])
    assert ((f.probability(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97
    for j, sign in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(f.margin(grid).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-9).all()
    assert boosting.fit(x, np.ones(3000), [0, 0, 0]).probability(x[:2]).min() > 0.99


# 4


def shingle_set(t):
    w = BLANK.findall(ascii_lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates(spark, docs, empty):
    rows = docs.collect()
    sets = [shingle_set(r["text"]) for r in rows]
    root = components(sets)
    name = {}
    for r, k in zip(rows, root):
        ids = [x for x in (name.get(k), r["doc_id"]) if x is not None]
        name[k] = min(ids) if ids else None
    want = collections.Counter((r["doc_id"], len(s), name[k] if s else r["doc_id"]) for r, s, k in zip(rows, sets, root))
    marked = neardup.components_of(docs)
    assert collections.Counter((r["doc_id"], r["n"], r["component_id"]) for r in marked.collect()) == want
    left = neardup.drop_near_duplicates(docs.withColumnRenamed("n_chars", "component_id"))
    assert left.columns == ["doc_id", "text", "lang", "source", "component_id"]
    blank = sum(not s for s in sets)
    assert left.count() == len({k for k, s in zip(root, sets) if s}) + blank
    assert neardup.drop_near_duplicates(empty).count() == 0


def test_large_bucket(spark, monkeypatch):
    """A cloud of near copies in one bucket, many of them far from the hub: blocks find what the hub misses."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t) for _, t in rows]
    root = components(sets)
    first = {}
    for i, k in enumerate(root):
        first.setdefault(k, i)
    got = {x["doc_id"]: x["component_id"] for x in neardup.components_of(df).collect()}
    assert got == {i: first[k] for i, k in enumerate(root)}


def test_circulant_estimates():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.concatenate((a[:3000], np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))))
    s = neardup.circulant([a, b], 1024)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - truth) < 0.06


# 5


def test_bloom_lm(spark, docs, empty):
    train = docs.where(~bloomlm.held_out())
    tokens = lambda t: [*BLANK.findall(ascii_lower(t)), None]
    c, pairs = collections.Counter(), collections.Counter()
    for r in train.collect():
        w = tokens(r["text"])
        c.update(w)
        pairs.update(zip(["<", *w], w))
    total, scale = sum(c.values()), sum(c.values()) + len(c) + 1
    want = collections.Counter()
    for r in docs.collect():
        w = tokens(r["text"])
        want[r["doc_id"], len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / scale) for x in w), 6)] += 1
    got = bloomlm.scores(docs, train).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert bloomlm.scores(empty, empty).count() == 0
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in bloomlm.scores(docs, empty).collect())


def test_rare_tokens_are_joined(spark, docs, monkeypatch):
    whole = {(r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in bloomlm.scores(docs, docs).collect()}
    monkeypatch.setattr(bloomlm.frequent_tokens, "__defaults__", (5,))
    assert {(r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in bloomlm.scores(docs, docs).collect()} == whole


def test_too_many_frequent_tokens_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(0, "a b c d e f " * 1100), (1, "a g")], "doc_id long, text string")
    found = lambda: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in bloomlm.scores(rows, rows).collect())
    whole = found()
    monkeypatch.setattr(bloomlm.frequent_tokens, "__defaults__", (5,))
    assert found() == whole and [n for _, n, _ in whole] == [6601, 3]


def exact_scores(rows):
    """Scores without a filter: every count is exact but for taking the middle of its level."""
    c, pairs = collections.Counter(), collections.Counter()
    texts = {r["doc_id"]: [*BLANK.findall(ascii_lower(r["text"])), None] for r in rows}
    for w in texts.values():
        c.update(w)
        pairs.update(zip(["<", *w], w))
    near = lambda n: float(bloomlm.level_count(bloomlm.levels(np.array([n])))[0])
    scale = sum(c.values()) + len(c) + 1.0
    out = {}
    for d, w in texts.items():
        s, before = 0.0, None
        for k, x in enumerate(w):
            context = float(len(texts)) if k == 0 else near(c[before])
            p = (near(c[x]) + 1) / scale
            n = min(near(pairs["<" if k == 0 else before, x]), context)
            s += math.log10((n + bloomlm.PRIOR * p) / (context + bloomlm.PRIOR))
            before = x
        out[d] = s
    return out


def test_filter_grows_with_pairs(spark, monkeypatch):
    r = random.Random(3)
    rows = spark.createDataFrame([(i, " ".join(f"{r.randrange(1 << 40):x}" for _ in range(300))) for i in range(400)], "doc_id long, text string").cache()
    monkeypatch.setattr(bloomlm, "MOST_BITS", 1 << 14, raising=False)
    monkeypatch.setattr(bloomlm, "FLUSH", 20_000)
    want = exact_scores(rows.collect())
    got = {x["doc_id"]: x["score"] for x in bloomlm.scores(rows, rows).collect()}
    assert got.keys() == want.keys() and all(s < 0 for s in got.values())
    assert max(abs(got[d] / want[d] - 1) for d in want) < 0.02


def test_block_has_its_bits():
    key = np.unique(np.random.default_rng(1).integers(0, 2**40, 200_000, dtype=np.uint64))
    inside, outside = key[::2], key[1::2]
    level = np.full(len(inside), 3)
    block = bloomlm.block_of(inside, level)
    assert 8 * len(block) >= bloomlm.BITS_PER_ITEM * level.sum()
    assert (bloomlm.block_levels(block, inside) >= 3).all() and (bloomlm.block_levels(block, outside) > 0).mean() < 0.01


def test_quantised_counts():
    n = np.arange(1, 5000)
    near = bloomlm.level_count(bloomlm.levels(n)) / n
    assert near.min() > 0.6 and near.max() < 1.6 and (np.diff(bloomlm.levels(n)) >= 0).all()
    assert bloomlm.unpack5(bloomlm.pack5(np.array([0, 2**40 - 1, 77], dtype=np.uint64))).tolist() == [0, 2**40 - 1, 77]


# 6


def test_token_files(spark, docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = ["".join(r.choice("ab'é .,\n\t!sS-1² ́_中ß\x1c\x85\xa0|<>") for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|> b", "it's l'eau, don't", "  two  blanks\n\n x "]
    texts += ["x" * 300 + " " + "y" * 300, "\xa0 a", "a\xa0 b", "", "a\u2003 b\u3000\n c", "0x1F-a_b'c 'd"] + ["".join(r.choice(["the ", "cat", " 12", "é", "\u2003", "\u1680", " ", "'s", "Ωμέγα", "\n", "<|endoftext|>"]) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    encode = idfiles.Encoder(path, 64)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        ids, bounds = encode([t.encode() for t in some], 7 if at % 80 else None)
        for t, x, y in zip(some, bounds, bounds[1:]):
            assert ids[x:y].tolist() == whole.encode(t, add_special_tokens=False).ids + ([7] if at % 80 else []), t
    other = idfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids, bounds = other([b"Some WORDS here", b""], 7)
    assert ids.tolist() == [*other.tokenizer.encode("Some WORDS here", add_special_tokens=False).ids, 7, 7] and bounds[-1] == len(ids)
    rows = sorted(docs.collect(), key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0))
    back, folder = idfiles.encoded(docs, path)
    got = sorted(map(tuple, back.collect()), key=lambda x: x[1])
    assert [g[0] for g in got] == [x["doc_id"] for x in rows]
    start = 0
    want = collections.Counter()
    for x in rows:
        ids = [*whole.encode(x["text"] or "", add_special_tokens=False).ids, 2]
        want[x["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((d, n, c) for d, _, n, c in got) == want
    for _, s, n, _ in got:
        assert s == start
        start += n
    name = sorted(p for p in __import__("os").listdir(folder.removeprefix("file://")) if p.endswith(".ids"))[0]
    reader = idfiles.FileReader(folder, name)
    assert reader.ids(0)[-1] == 2
    with pytest.raises(ValueError):
        idfiles.FileReader(folder, name, b"another dictionary")
    assert idfiles.encoded(empty, path)[0].count() == 0


# 7


def hits(text, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w = pattern.findall(ascii_lower(text))
    covered, found = [False] * len(w), set()
    for name, t in items:
        q = pattern.findall(ascii_lower(t))
        for i in range(max(len(q) - 12, 1 if q else 0)):
            win = q[i : i + 13]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    covered[s : s + len(win)] = [True] * len(win)
                    found.add("" if name is None else str(name))
    return len(w), sum(covered), sorted(found)


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    r = random.Random(7)
    v = ["the", "of", "a", "ab", "é", "x1", "zz", "Q"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([1, 2, 5, 13, 20, 30])))) for i in range(12)] + [(77, None), (78, "..."), (None, "solo"), (3, "again zz ab")]
    texts = []
    for _ in range(120):
        w = [r.choice(v) for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            w[r.randint(0, len(w)) : 0] = (r.choice(items)[1] or "").upper().split()
        texts.append(r.choice([" ", ", ", "\n"]).join(w))
    texts += [None, "", "solo"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for x in decontam.find_contamination(docs, bench).collect():
        n, hit, found = hits(x[PACKED]["text"], items)
        assert (x["n_words"], x["n_hit"], sorted(x["items"]), x["contaminated"]) == (n, hit, found, hit > 0 and 20 * hit >= n)
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontam.drop_contaminated(docs.limit(0), bench).count() == 0


# 8


def test_toxicity(spark, empty):
    r = random.Random(8)
    v = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [r.choice(v) for _ in range(60)] + (["zzqxw", "wqyyz"] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(None, "abc"), (9001, None), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, lab)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002]
    none = toxicity.learn(docs, lab.limit(0))
    assert all(x["score"] < 1e-9 for x in toxicity.score(docs, none).collect())
    assert toxicity.score(empty, model).count() == 0


# 9


def test_sharding(spark, docs, empty):
    many = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = sharding.shard(many).toPandas()
    n = got.groupby("shard").size()
    assert len(n) == 16 and n.min() > 1000 and n.max() < 1500
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) == {16} and abs(len(moved) - 20_000 / 17) < 200
    odd = sharding.shard(docs.withColumnRenamed("lang", "shard")).collect()
    texts = collections.Counter((x["doc_id"], len((x["text"] or "").encode()) + 1, zlib.crc32((x["text"] or "").encode())) for x in docs.collect())
    assert collections.Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in odd) == texts
    assert sharding.shard(empty).count() == 0


def test_weights_move_only_their_subtree(spark):
    many = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    before = sharding.tree(16)
    after = sharding.tree(16, weights=[1.0] * 15 + [0.5])
    both = many.select("doc_id", sharding.descend(many["doc_id"], before).alias("a"), sharding.descend(many["doc_id"], after).alias("b")).where("a <> b").toPandas()
    assert len(both) and not ((both.a < 8) & (both.b < 8)).any()
    assert [x.shard for x in sharding.leaves(sharding.grown(before))] == list(range(17))


# 10


def water(sizes, weights, total):
    """Targets by repeated resharing."""
    bound = {k: 2 * s for k, s in sizes.items()}
    full = set()
    while True:
        rest = total - sum(bound[k] for k in full)
        open_ = [k for k in sizes if k not in full]
        w = sum(weights[k] for k in open_)
        over = {k for k in open_ if rest * weights[k] / w > bound[k]}
        if not over:
            return {k: bound[k] if k in full else rest * weights[k] / w for k in sizes}
        full |= over


def test_mix(spark, docs, empty):
    got = mixing.mix_report(docs).toPandas()
    rows = docs.collect()
    size = collections.Counter()
    for x in rows:
        size[x["source"]] += len(BLANK.findall(x["text"] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = water(size, weights, 1.5 * sum(size.values()))
    for s in names:
        g = got[got.source.isna() if s is None else got.source == s]
        assert g.source_size.iloc[0] == size[s] and abs(g.target.iloc[0] - want[s]) < 1e-6
        assert abs(g.taken.sum() - want[s]) <= 100
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix_report(docs.repartition(5)).toPandas()
    key = lambda d: collections.Counter(zip(d.doc_id.fillna(-1), d["size"], d.taken))
    assert key(got) == key(again)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == got.copies.sum()
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0


# shared


def test_words_and_shingles():
    texts = [b"Aa bB\tc", b"", b"  x  ", "é ß".encode(), b"a b c d e f"]
    w = words.WordHasher(words.blank_bytes())(texts)
    assert np.diff(w.first).tolist() == [3, 0, 1, 2, 6]
    assert [w.buffer[s:e] for s, e in zip(w.start[:3], w.end[:3])] == [b"Aa", b"bB", b"c"]
    s, first = words.shingles(w.hash, w.first, 5)
    assert np.diff(first).tolist() == [1, 0, 1, 1, 2] and len(set(s.tolist())) == 5
    one = words.WordHasher(words.blank_bytes())([b"bb"]).hash[0]
    assert one == w.hash[1]


def test_all_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
