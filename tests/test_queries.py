"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, oracle, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = oracle.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    rows = got.select(*(f"`{c}`" for c in columns)).toArrow()
    assert sorted(map(repr, zip(*(want[c].to_pylist() for c in columns)))) == sorted(map(repr, zip(*(rows[c].to_pylist() for c in columns))))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "lang", "final_score"] and df.count() > 0
