"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from linkloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"gbt_matcher_oof", "stacker", "pruner_cascade", "country_transfer"}


def rows(frame):
    def cell(v):
        return "null" if v is None or v != v else repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert rows(got) == rows(con.execute(catalogue.ORACLES[name]).df())
    else:
        assert len(got) and got.columns.is_unique and got[got.columns[0]].notna().all()


def test_whole_texts_are_read(spark, con):
    """Nothing that text queries return stops before the text does."""
    n = con.execute("SELECT max(len(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) FROM documents").fetchone()[0]
    longest = catalogue.QUERIES["leet_fix"](spark, SF).selectExpr("max(size(split(fixed, ' ')))").first()[0]
    assert n - 2 <= longest <= n
    plain = catalogue.QUERIES["translit_docs"](spark, SF).selectExpr("max(length(plain))").first()[0]
    assert plain >= con.execute("SELECT max(length(text)) FROM documents").fetchone()[0]
