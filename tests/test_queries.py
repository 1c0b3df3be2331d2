"""Every query with SQL against DuckDB on the smallest tables; the others against plain Python."""

import duckdb
import numpy as np
import pytest
from brevier.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)

    def plain(v):
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9))
        return "null" if v is None else str(v)

    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, db, name):
    ours = plans.queries()[name](spark, SF).toPandas()
    theirs = db.execute(plans.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_digest_is_ranked_and_distinct(spark):
    got = plans.queries()["daily_brief_select"](spark, SF).toPandas()
    assert list(got["position"]) == list(range(1, len(got) + 1))
    assert got["id"].is_unique


def test_chunks_hold_all_words(spark):
    got = plans.queries()["sentence_chunks"](spark, SF).toPandas()
    assert got["chunk"].str.len().max() <= 1500
