"""Every query of the engine's own operators against its SQL."""

import math

import duckdb
import pytest

from tidemark.plans import catalog_more, catalog_store  # noqa: F401  register further queries
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, bool | int) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        assert got == table([c[0] for c in want.description], want.fetchall())


def test_cycles_where_events_reach_the_planted_ids(spark, tmp_path):
    ids = [*range(20), *range(999_980, 1_000_020), *range(1_999_980, 2_000_020)]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["supersede_cycles"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(ORACLE_SQL["supersede_cycles"]).fetchall()) and len(got) == 15
