"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import duckdb
import pytest

from latticework.plans import catalog, engine_queries, fact_queries, source_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(values):
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = con.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in got.fetchall()]
    assert rows([[r[c] for c in cols] for r in df.collect()]) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
