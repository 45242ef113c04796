"""Queries equal their SQL on texts without words, without letters, of very long words, and on missing texts."""

import shutil
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colophon import catalogue

from test_oracle import SF, plain

TEXTS = (None, "", "...", "ÖÄÜ éé", "12345 67890 " * 6, "x" * 400 + " word", "tail. &amp; more", "title title", "did iv Kenya courts", "0 1 2", "working paper in china")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for f in Path(SF).glob("*.parquet"):
        if f.stem != "documents":
            shutil.copy(f, at / f.name)
    ids = range(60 * len(TEXTS))
    texts = [TEXTS[i // 60] for i in ids]
    rows = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": [f"src{i % 20}" for i in ids], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(rows), at / "documents.parquet")
    return str(at)


def same_as_sql(spark, name, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    want = sorted(repr([plain(v) for v in row]) for row in want.fetchall())
    got = sorted(repr([plain(row[c]) for c in columns]) for row in catalogue.queries()[name](spark, sf).collect())
    assert got == want


def test_note_records(spark, odd):
    same_as_sql(spark, "note_records", odd)


def test_provider_cascade(spark, odd):
    same_as_sql(spark, "provider_cascade", odd)


def test_page_titles(spark, odd):
    same_as_sql(spark, "page_titles", odd)


def test_merged_headers(spark, odd):
    same_as_sql(spark, "merged_headers", odd)
