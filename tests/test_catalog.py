"""Every registered query of the engine against its SQL twin."""

from decimal import Decimal

import duckdb
import pytest

from tidemark.plans import catalog, catalog_evidence  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    return str(float(x)) if isinstance(x, (float, Decimal)) else str(x)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in found.collect())
    expected = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in expected.fetchall())


def test_documents_are_parsed_once(spark):
    """Filters stay above the columns read from JSON, so each of the two tables of documents is parsed once a row."""
    plan = catalog.QUERIES["missing_hook_states"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 2
