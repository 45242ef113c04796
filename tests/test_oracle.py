"""Every query that has SQL gives what DuckDB gives for it."""

import os

import duckdb
import pytest

from colophon import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return int(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    want = sorted(repr([plain(v) for _, v in sorted(zip(columns, row, strict=True))]) for row in want.fetchall())
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect())
    assert got == want
    assert got or name == "near_dup_pairs_contain"  # the smallest tables have none


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
