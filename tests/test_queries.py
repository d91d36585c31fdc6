"""Every query with SQL against DuckDB, and every other one for rows and a stable schema."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, rows  # noqa: E402
from pagewright.plans import registry  # noqa: E402

OWN = registry.queries()
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    got = OWN[name](spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL) - {"k06_report_csv", "k05_report_json"}))
def test_runs(spark, sf_dir, name):
    df = OWN[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry_has_all():
    assert set(OWN) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
