"""Golden reading orders, spacing decisions and comparisons."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import spacing
from pagewright.operators import diff, layout, matching
from pagewright.sources import docx, mtef

SCHEMA = "doc_id long, page int, ord int, id string, type string, source string, text string, x0 double, y0 double, x1 double, y1 double"


def ordered(spark, items):
    rows = [(1, 1, i, name, kind, "native", text, *map(float, box)) for i, (name, kind, text, box) in enumerate(items)]
    e = spark.createDataFrame(rows, SCHEMA)
    o = layout.reading_order(e).join(e, ["doc_id", "page", "ord"]).orderBy("reading_order")
    return [r["id"] for r in o.collect()]


def test_single_column(spark):
    items = [(f"p{y}", "text", f"Paragraph at {y}", (50, y, 550, y + 30)) for y in (50, 100, 150)]
    assert ordered(spark, items) == ["p50", "p100", "p150"]


def test_two_and_three_columns(spark):
    two = [(f"{c}{y}", "text", f"Some body text {c}", (x, y, x + 200, y + 20)) for y in (100, 130, 160) for c, x in (("a", 50), ("b", 350))]
    assert ordered(spark, two) == ["a100", "a130", "a160", "b100", "b130", "b160"]
    three = [(f"{c}{y}", "text", f"Body {c}", (x, y, x + 130, y + 20)) for y in (100, 130) for c, x in (("a", 50), ("b", 230), ("c", 410))]
    assert ordered(spark, three) == ["a100", "a130", "b100", "b130", "c100", "c130"]


def test_table_and_form_are_row_wise(spark):
    table = [(f"{c}{y}", "table", c, (x, y, x + 100, y + 20)) for y in (100, 130, 160) for c, x in (("n", 50), ("g", 200), ("t", 350))]
    assert ordered(spark, table) == [i[0] for i in table]
    form = [(f"{k}{y}", "text", t, (x, y, x + 100, y + 20)) for y in (100, 130) for k, t, x in (("l", "Name:", 50), ("v", "________", 200))]
    assert ordered(spark, form) == ["l100", "v100", "l130", "v130"]


def test_mixed_page(spark):
    items = [("title", "text", "A Title Across", (50, 40, 550, 70))]
    items += [(f"{c}{y}", "text", "Body of a column here", (x, y, x + 220, y + 20)) for y in (120, 145, 170) for c, x in (("a", 50), ("b", 330))]
    items += [("footer", "text", "Page 1", (250, 750, 350, 765))]
    assert ordered(spark, items) == ["title", "a120", "a145", "a170", "b120", "b145", "b170", "footer"]


def test_blank_and_boxless_come_last(spark):
    e = spark.createDataFrame([(1, 1, 0, "n", "text", "native", "no box", None, None, None, None), (1, 1, 1, "b", "text", "native", " ", 0.0, 0.0, 9.0, 9.0), (1, 1, 2, "t", "text", "native", "text", 0.0, 50.0, 9.0, 60.0)], SCHEMA)
    got = {r["ord"]: r["reading_order"] for r in layout.reading_order(e).collect()}
    assert got == {2: 1, 1: 2, 0: 3}


MERGES = [
    (["Contributing", "Writers"], "Contributing Writers"), (["word", ","], "word,"), (["(", "word"], "(word"), (["item", "]"], "item]"), (["don", "'t"], "don't"),
    (["state-", "of", "-the", "-art"], "state-of-the-art"), (["100", "px"], "100px"), (["100", "meters"], "100 meters"), (["3.", "14"], "3.14"), (["1", "st"], "1st"),
    (["U.", "S.", "A."], "U.S.A."), (["UNITED", "STATES"], "UNITED STATES"), (["super", "script"], "superscript"), (["every", "body"], "everybody"), (["Existing ", "space"], "Existing space"), (["Line\n", "break"], "Line\nbreak"),
    (["Chapter", "5"], "Chapter 5"), (["a", "+"], "a +"), (["The", "quick"], "The quick"),
]


def test_merges(spark):
    rows = [(k, i, f, None, None) for k, (parts, _) in enumerate(MERGES) for i, f in enumerate(parts)]
    df = spark.createDataFrame(rows, "k long, ord int, fragment string, coord_gap double, font_size double")
    got = {r["k"]: r["merged"] for r in spacing.merge_fragments(df, ["k"], "ord").collect()}
    assert [got[k] for k in range(len(MERGES))] == [m for _, m in MERGES]


def test_gaps_decide(spark):
    df = spark.createDataFrame([("in", "to", 3.0, 10.0), ("in", "to", 0.1, 10.0)], "a string, b string, gap double, size double").withColumn("p", spacing.boundary_parts(F.col("a"), F.col("b")))
    assert [r["s"] for r in df.select(spacing.needs_space(F.col("p"), F.col("gap"), F.col("size")).alias("s")).collect()] == [True, False]


def compared(spark, orig, ext):
    pages = spark.createDataFrame([(1, 1, orig, ext)], "doc_id long, page int, orig array<string>, ext array<string>")
    found = diff.mismatches(diff.line_pairs(pages)).orderBy("number")
    words = pages.select("doc_id", "page", F.flatten(F.transform("orig", diff.split_words)).alias("orig_words"), F.flatten(F.transform("ext", diff.split_words)).alias("ext_words"))
    return [r.asDict(True) for r in found.collect()], diff.page_accuracy(words, found).first()


@pytest.mark.parametrize(
    "orig, ext, kinds, status",
    [
        (["a b"], ["a b"], [], "PASS"),
        (["Total 500 items"], ["Total 600 items"], [("NUMBER_MISMATCH", "HIGH")], "ERROR"),
        (["one two", "three four", "five six"], ["one two", "five six"], [("MISSING_TEXT", "HIGH")], "ERROR"),
        (["Check Accessibility now"], ["Check Accessibilty now"], [("CHARACTER_MISMATCH", "MEDIUM")], "ERROR"),
        (["Hello world"], ["hello world"], [("CHARACTER_MISMATCH", "LOW")], "ERROR"),
        ([], ["x"], [("EXTRA_TEXT", "MEDIUM")], "ERROR"),
        ([], [], [], "PASS"),
        (["left right"], ["left", "right"], [], "PASS"),
    ],
)
def test_comparison(spark, orig, ext, kinds, status):
    found, page = compared(spark, orig, ext)
    assert [(m["diff_type"], m["severity"]) for m in found] == kinds
    assert page["status"] == status


def test_character_positions(spark):
    found, _ = compared(spark, ["Accessibility"], ["Accessibilty"])
    assert found[0]["char_diffs"] == [{"kind": "missing_char", "char": "i", "position": 11}]
    found, _ = compared(spark, ["price 5 and 7"], ["price 5"])
    assert [m["difference"] for m in found] == ["Missing: '7'", "Missing word: 'and'", "Missing word: '7'"]


def test_equations_and_documents():
    assert mtef.decode(mtef.fraction_record("a+b", "c")) == "(a + b)/c"
    assert mtef.decode(b"") is None and mtef.decode(b"\x05\x01") is None and mtef.decode(bytes(40)) is None
    got = [mtef.decode(mtef.record(mtef.template(s, *slots))) for s, slots in [(0, ("x",)), (1, ("i", "n")), (2, ("12",)), (3, ("2",)), (4, ("y",)), (10, ("3", "x")), (13, ("p", "q")), (28, ("≤",)), (29, ("a1", "b"))]]
    assert got == ["(x)", "_i^n", "_12", "^2", "√(y)", "√(x)", "p q", "^{≤}", "_a1^b"]
    assert mtef.decode(mtef.record(b"".join(bytes([mtef.CHAR, 0, 131, ord(c), 0]) for c in "a+-b"))) == "a - b"
    assert matching.format_fraction("x^{2}", "y") == "x^2/y"
    assert [matching.format_fraction(*p) for p in [("-x", "y"), ("(a)+(b)", "(c+1)"), ("a=b", "- 2")]] == ["(-x)/y", "((a)+(b))/(c+1)", "(a=b)/(-2)"]
    items = list(docx.items_of(docx.written("one\n\n<two> & three")))
    assert [i[2] for i in items] == ["one", "", "<two> & three"]


def page_of(rows, columns):
    import pandas as pd

    return pd.DataFrame([(1, 1, *r) for r in rows], columns=["doc_id", "page", *columns])


def test_lines_read_again():
    native = [(1, "native", "Harcourt Publ", 10.0), (2, "native", "shing Company", 14.0), (3, "native", "far below", 90.0)]
    ocr = [(1, "ocr", "HARCOURT PUBL shing company", 12.0), (2, "ocr", "far below", 20.0), (3, "ocr", "  ", 20.0)]
    got = matching.recovered_lines(page_of(native + ocr, ["ord", "source", "text", "y0"]))
    assert list(zip(got.ord, got.text, got.origin)) == [(1, "HARCOURT PUBL shing company", "replaced"), (3, "far below", "native"), (1003, "far below", "added")]


def test_lines_on_baselines():
    g = page_of([(1, "a =", 0.0, 10.0, 20.0), (2, "b", 300.0, 12.0, 310.0), (3, "c", 600.0, 11.0, 610.0), (4, "d ", 620.0, 17.0, 630.0), (5, "e", 700.0, 18.0, 710.0), (6, "f", 0.0, 18.5, 9.0)], ["ord", "text", "x0", "y0", "x1"])
    assert matching.baseline_lines(g).text.tolist() == ["a =   b", "c d e", "f"]
    assert matching.verified_lines(g).text.tolist() == ["a = b", "c d ", "e", "f"]


def test_report_rows(spark, sf_dir):
    """Every report has its sections with captions and blank rows; as many page and mismatch rows as there are."""
    from pagewright.plans import registry

    rows = registry.queries()["k06_report_csv"](spark, sf_dir).where("doc_id < 5").orderBy("doc_id", "section", "place").collect()
    for d in {r["doc_id"] for r in rows}:
        mine = [r for r in rows if r["doc_id"] == d]
        heads = [r["c0"] for r in mine if r["c0"] is None or r["c0"].isupper()]
        assert [h for h in heads if h] == ["ORIGINALITY & EXTRACTION ACCURACY VERIFICATION REPORT", "SUMMARY METRICS", "PAGE-WISE RESULTS", "DETAILED MISMATCHES"]
        assert heads.count(None) == 3 and mine[1]["c1"] == f"report_{d}"
        pages = [r for r in mine if r["section"] == 3 and r["place"] > 1]
        assert sum(int(r["c6"]) for r in pages) == len([r for r in mine if r["section"] == 4 and r["place"] > 1])
        assert str(len(pages)) == next(r["c1"] for r in mine if r["c0"] == "Total Pages")
