"""Queries against their SQL on lines where ASCII's classes and bounds differ from Unicode's."""

import duckdb
import pytest
from compare import rows
from pagewright.plans import registry

LINES = ["EAURÉ!! ET", "UPAÉ.!!", "VCHECKÉ", "Showé", "12stéle", "World!.\r", "shell..\r", " nbsp ", "\x0bvt\x0b", "Upper rightdé", "éyesd", "éupper left.", "a:b  c\td", ". ÉT", "Fromathable hethly.", "LEÇON 3 vite", "a\rb\rc\rd\re", "éab/cd x", "éx = 3", "x y", ""]
TEXTS = ["\n".join(LINES[k:] + LINES[:k]) for k in range(len(LINES))] + [*LINES, None] + ["Fromathable a\n" * 25]
NAMES = ["f11_clean_leading", "f12_clean_ocr", "p02_two_pass_filter", "f16_classify", "a01_statistics", "a02_tagging_summary", "w05_single_h1"]


@pytest.mark.parametrize("name", NAMES)
def test_classes_of_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    assert rows(got) == rows(want)
