"""Every query of the engine that has SQL gives the rows of its SQL."""

import math

import duckdb
import pytest

from strandlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else (f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    mine = registry.queries()[name](spark, SF)
    theirs = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    assert _rows(mine.columns, [tuple(r) for r in mine.collect()]) == _rows(names, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1
