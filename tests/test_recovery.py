"""Decisions are those of difflib, in far less time, and pages go to Python as arrays."""

import difflib
import random
import time

from pagewright.operators import matching

LETTERS = "eeeeettttaaaooinshrdlucmfwypvbgk     "


def changed(rng, x, n):
    x = list(x)
    for _ in range(n):
        x[rng.randrange(len(x))] = rng.choice("abé?XYZ ")
    return "".join(x).strip()


def texts(seed, n):
    rng = random.Random(seed)
    lines = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(100, 500))).strip() for _ in range(n)]
    return lines, [changed(rng, x, len(x) // 3) for x in lines]


def by_difflib(native, ocr):
    out = [[o, t, y, "native"] for o, t, y in native]
    for _, new, y in ocr:
        alike = [x for x in out if x[1] and abs(x[2] - y) < 40 and (len(x[1]) >= 8 and x[1].lower() in new.lower() or difflib.SequenceMatcher(None, new.lower(), x[1].lower()).ratio() >= 0.55)]
        if not alike:
            out.append([1000 + len(out), new, y, "added"])
            continue
        alike[0][1:] = [new, y, "replaced"]
        for x in alike[1:]:
            x[1] = ""
    return [(x[0], x[1], x[3]) for x in out if x[1]]


def test_ratios_are_those_of_difflib():
    rng = random.Random(7)
    lines, others = texts(1, 40)
    few = ["".join(rng.choice("abé"[:k]) for _ in range(n)) for k in (1, 2, 3) for n in (0, 1, 5, 199, 200, 250)]
    for a, b in [*zip(lines, others), *zip(lines, lines[1:]), *[(a, b) for a in few for b in few], *[(a, changed(rng, a, 9)) for a in few if a]]:
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        for least in (0.55, ratio, ratio + 1e-9, rng.random()):
            assert matching.ratio_reaches(a, b, least) == (ratio >= least)


def test_long_lines_take_little_time():
    lines, others = texts(2, 40)
    native, ocr = ([(i, t, 8.0 * i) for i, t in enumerate(x)] for x in (lines, others))
    frame = matching.pd.DataFrame([(1, 1, o, s, t, y) for s, x in (("native", native), ("ocr", ocr)) for o, t, y in x], columns=["doc_id", "page", "ord", "source", "text", "y0"])
    began = time.perf_counter()
    want = by_difflib(native, ocr)
    between = time.perf_counter()
    got = matching.recovered_lines(frame)
    assert list(zip(got.ord, got.text, got.origin)) == want
    assert time.perf_counter() - between < (between - began) / 3


def test_recovery_of_pages(spark):
    lines, others = texts(3, 30)
    pages = [(d, 1, o, s, t, 24.0 * o) for d in (1, 2) for s, x in (("native", lines), ("ocr", others[d:])) for o, t in enumerate([*x, "  ", None])]
    df = spark.createDataFrame(pages, "doc_id long, page int, ord int, source string, text string, y0 double")
    rows = matching.line_recovery(df).collect()
    for d in (1, 2):
        want = by_difflib(*([(o, t, 24.0 * o) for o, t in enumerate(x)] for x in (lines, others[d:])))
        assert sorted((r["ord"], r["text"], r["origin"]) for r in rows if r["doc_id"] == d) == sorted((o if o < 1000 else o + 2, t, w) for o, t, w in want)
