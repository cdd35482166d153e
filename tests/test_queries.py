"""Every registered query against its check SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from logharbor.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    cols = sorted(frame.columns)
    cells = frame[cols].astype(object).where(frame[cols].notna(), None)
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in cells.itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = plain(entry.queries()[name](spark, SF).toPandas())
    want = plain(db.execute(entry.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 164
