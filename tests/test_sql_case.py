"""Queries against their SQL on letters whose cases differ between Java and SQL, and on lines that Java's stack must not follow."""

import duckdb
import pytest
from compare import rows
from pagewright.plans import registry

CASES = ["Fıgure 3", "FİG. 3", "figure 3", "Illuſtration 2: x", "Sectıon 3", "SECTİON 3", "ſection 3", "Part ı", "part İV", "part iv", "Unİté 4", "UNITÉ 4", "LEÇON 3", "Kapıtel 3"]
LONG = ["1" + ".1" * 20_000 + end for end in (") x", " x", "", ".2) ", ". x", "..")]
NAMES = ["a01_statistics", "a02_tagging_summary", "w05_single_h1"]


def same_as_sql(spark, tmp_path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).fetchdf()
    return rows(got) == rows(want)


@pytest.mark.parametrize("name", NAMES)
def test_letters_of_any_case(spark, tmp_path, name):
    assert same_as_sql(spark, tmp_path, name, [*CASES, "\n".join(CASES), "\n".join(CASES[::-1])])


@pytest.mark.parametrize("name", NAMES)
def test_long_numbers(spark, tmp_path, name):
    assert same_as_sql(spark, tmp_path, name, [*LONG, "\n".join(LONG)])
