"""Each query against its SQL on the smallest tables."""

import random
from pathlib import Path

import duckdb
import pytest

from motionlake.operators import series
from motionlake.plans import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(round(v[i], 4) + 0.0 if isinstance(v[i], float) else v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


def test_ewma_of_a_hot_key_is_summed_in_parts(spark):
    rng = random.Random(2)
    events = [(1 if i % 3 else i, i // 2, i, rng.random() if i % 997 else None) for i in range(6000)] + [(2, 1, 1, None), (4, 1, 1, 2.0), (4, 2, 2, None)]
    want = {}
    for user, _, _, x in sorted(events, key=lambda e: e[:3]):
        a = want.get(user)
        want[user] = x if a is None else None if x is None else 0.85 * a + 0.15 * x
    rng.shuffle(events)
    got = series.ewma(spark.createDataFrame(events, "u long, ts long, e long, x double"), "u", ["ts", "e"], "x", 0.85)
    assert "collect_list(struct(ts" not in got._jdf.queryExecution().analyzed().toString()
    assert {r.u: r.ewma for r in got.collect()} == pytest.approx(want)
