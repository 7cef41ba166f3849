"""Every registered query of the library against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from inkgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(repr, pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.oracle_sql():
        assert rows(got) == rows(db.execute(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
