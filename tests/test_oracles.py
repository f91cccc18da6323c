"""Every query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.plans import catalog, oracles

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf, name, run, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = run(spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert ours == theirs, name


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, sf, name):
    same(spark, sf, name, catalog.queries()[name], oracles.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(entry.queries())


def test_extraction_grows_with_the_table(spark, sf):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert catalog.queries()["extract_middle"](spark, sf).count() >= n // 2 - 1
    assert catalog.queries()["extract_middle_from_ring"](spark, sf).count() >= n // 4 - 1
