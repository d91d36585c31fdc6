"""Queries on whole pages and whole texts."""

import pytest

from pagewright.plans import registry

#: Lines that share their first 30 letters; the last is part of the one before.
LINES = [f"The same first thirty characters of line {i} and more" for i in range(10, 29)] + ["same first thirty characters of line 28"]


@pytest.fixture
def page(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(LINES))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_every_line_is_highlighted(spark, page):
    got = sorted((r["line"], r["ord"], r["score"]) for r in registry.queries()["j18_highlight"](spark, page).collect())
    assert got == [(i, i, 100.0) for i in range(1, 21)]


def test_whole_texts_are_mentions(spark, page):
    assert sorted(r["ord"] for r in registry.queries()["j20_first_mentions"](spark, page).collect()) == list(range(1, 20))


def test_deep_tree(spark):
    """A chain of 150 nodes, many roots, a cycle, and a node whose parent is missing."""
    from pagewright.sources import structure

    chain = [(1, i, i - 1 if i else None, "P" if i % 2 else "Div", 7 if i == 3 else None) for i in range(150)]
    roots = [(2, i, None, "H1", i) for i in range(500)]
    broken = [(3, 1, 2, "P", 1), (3, 2, 1, "P", 1), (3, 3, 2, "P", 1), (3, 4, 99, "P", 1)]
    got = {(r["doc_id"], r["xref"]): (r["tag"], r["page"], r["depth"]) for r in structure.struct_tree(spark.createDataFrame(chain + roots + broken, "doc_id long, xref long, parent long, tag string, page long"), {"H1": "Title"}).collect()}
    want = {(1, i): ("P", 7 if i >= 3 else None, i) for i in range(1, 150, 2)} | {(2, i): ("Title", i, 0) for i in range(500)}
    assert got == want


def test_formula_signs(spark):
    from pagewright.functions import text

    df = spark.createDataFrame([("5 × 3",), ("± 2",), ("a ÷ b",), ("plain words here",)], "t string")
    assert [r[0] for r in df.select(text.is_formula(df.t)).collect()] == [True, True, True, False]


def test_storage_without_setting(spark):
    """Without spark.checkpoint.dir a local session has a folder of its own; a bare path is in the default file system."""
    from pagewright import storage

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value

    class Session:
        sparkContext = spark.sparkContext

    session = Session()
    session.conf = Conf(None)
    assert storage.shared_folder(session, "x").startswith("file:///") and storage.shared_folder(session, "x") != storage.shared_folder(session, "x")
    session.conf = Conf("/shared/ckpt")
    assert storage.shared_folder(session, "x").startswith("file:///shared/ckpt/pagewright-x-")
    session.conf = Conf("hdfs://name:9000/ckpt")
    assert storage.shared_folder(session, "x").startswith("hdfs://name:9000/ckpt/pagewright-x-")
