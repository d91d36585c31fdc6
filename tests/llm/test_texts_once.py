"""Texts go to Python workers once, and a stage's rows pass through as few workers as there are blocks."""

import pytest
from pagewright.llm import boosting, common, decontam, quality

WORDS = " ".join(f"word{i}" for i in range(30))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, WORDS, "a"), (2, None, "b"), (3, "few words", "c"), (4, f"{WORDS} {WORDS}", "d")], "doc_id long, text string, lang string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_sends_texts_once(docs):
    judged = quality.judge(docs, boosting.constant(1.0))
    assert plan(judged).count("MapInArrow") == 1 and "__text" not in plan(judged)
    assert {r[common.PACKED]["doc_id"]: (r["n_words"], r["kept"]) for r in judged.collect()} == {1: (30, True), 2: (0, False), 3: (2, False), 4: (60, False)}


def test_decontamination_is_one_pass(spark, docs):
    bench = spark.createDataFrame([(7, WORDS)], "item_id long, text string")
    found = decontam.find_contamination(docs, bench)
    assert plan(found).count("MapInArrow") == 1 and found.columns == [common.PACKED, "n_words", "spans", "items", "n_hit", "contaminated"]
    assert {r[common.PACKED]["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in found.collect()} == {1: (30, 30, True), 2: (0, 0, False), 3: (2, 0, False), 4: (60, 60, True)}


def test_texts_that_are_no_strings(spark):
    docs = spark.createDataFrame([(1, 12345), (2, None)], "doc_id long, text long")
    assert [r["n_words"] for r in quality.judge(docs, boosting.constant(1.0)).orderBy(f"{common.PACKED}.doc_id").collect()] == [1, 0]
    found = decontam.find_contamination(docs, spark.createDataFrame([(7, "12345")], "item_id long, text string"))
    assert sorted((r[common.PACKED]["doc_id"], r["n_hit"]) for r in found.collect()) == [(1, 1), (2, 0)]
