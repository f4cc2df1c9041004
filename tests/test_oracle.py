"""Every registered query of the analytics against its SQL, at the smallest scale."""

import duckdb
import pytest

import folioscope.plans.books
import folioscope.plans.streams  # noqa: F401
from folioscope.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    f = lambda v: round(float(v), 6) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)) else v
    return sorted((tuple(f(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in result.fetchall()]
    assert plain(got) == plain(want)
