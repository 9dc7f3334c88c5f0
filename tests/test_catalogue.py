"""Every query with SQL gives the rows that the SQL gives."""

import math

import duckdb
import pytest

from vecloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"kmeans_sweep", "hdbscan_reduced", "hdbscan_sweep"}  # test_golden.py runs these


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else str(v)

    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees_with_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = plain(tuple(r[c] for c in cols) for r in df.collect())
    want = plain(con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - SLOW))
def test_runs_without_sql(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_flagship_counts(spark, sf):
    got = {r["status"]: r["n"] for r in catalogue.flagship(spark, sf).collect()}
    assert got == {"auto_merge": 118, "ask_user": 229, "new_cluster": 153}
