"""Some registered queries against their SQL; ``python -m checks.compare`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "redact_counts", "sensitive_paths", "detect_changes", "pack_batches", "parse_documents",
    "kb_query", "overview_areas", "usage_rollup", "merge_facts"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())
