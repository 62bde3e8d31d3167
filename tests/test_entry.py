"""The catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
CHEAP = [
    "corpus_sniff_scan", "detect_format", "container_rescue", "batch_limits", "route_files", "pdf_flavour", "quality_warnings",
    "convert_callouts", "rewrite_image_paths", "clean_pages", "html_to_markdown", "heading_slugs", "job_status", "job_detail",
    "bundle_names", "file_state", "time_limit_breaches", "counter_drift", "unreferenced_outputs",
]


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_same_rows_as_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        [d[0] for d in result.description], result.fetchall())
