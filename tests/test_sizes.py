"""Queries on rows that small tables seldom have, against their SQL."""

import math
import random

import duckdb
import pandas as pd
import pytest

from orbitloom import catalog
from orbitloom.operators import joins

#: events as (event_id, seconds, user_id, event_type, value, k).
HARD = {
    "h17_bands": [(i, i, 0, "view", v, k) for i, (v, k) in enumerate([(2.1, 7), (4.2, 7), (5.1, 17), (10.2, 17), (2.1, 8), (6.9, 23)])],
    # the clock of the lock wraps at a multiple of 540,000 seconds: half a second before it is the second itself, a quarter is not
    "w21_ionosphere_arcs": [(8 * i, 1706400000 + s, 0, "view", 3.5 + i, 1 + 3 * i) for i, s in enumerate([-900.0, -600.0, -0.4, 1.0, 600.0, 539999.4, 539999.6, 540000.2])],
    # every station has two values in turn, whose mean is exactly the limit 9 or 14: the last digit of the sum decides
    "w14_fixed_position": [(i, i // 60 * 20000, i % 60, "view", ((9, 14)[i % 2] * 100 + (i // 60 % 2 * 2 - 1) * (i % 60) * 13) / 100, 1) for i in range(60 * 24)],
    "b1_page_beyond_end": [(i, i // 7, i % 5, "error", 1.0, 1) for i in range(100_003)],
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_hard_rows(spark, tmp_path, name):
    made = duckdb.connect()
    made.execute("create table rows (event_id bigint, s double, user_id bigint, event_type varchar, value double, k bigint)")
    given = pd.DataFrame(HARD[name], columns=["event_id", "s", "user_id", "event_type", "value", "k"])
    made.execute("insert into rows select * from given")
    made.execute(f"copy (select event_id, make_timestamp(cast(s * 1000000 as bigint)) as ts, user_id, event_type, value, '{{\"k\": ' || k || '}}' as props from rows) to '{tmp_path}/events.parquet' (format parquet)")
    made.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = made.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows) if name != "b1_page_beyond_end" else [tuple(r) for r in rows]
    text = lambda rows: [str(r) for r in plain(rows)]
    assert text(got.select(*columns).collect()) == text(want.fetchall())


def test_grants_make_no_pair_twice(spark):
    plan = catalog.QUERIES["j14_export_grants"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join Inner") == 2


def test_pairs_of_grants_are_made_by_many_tasks(spark):
    """One small file of observations: its pairs are not left to the task or two that read it."""
    found = catalog.QUERIES["j14_export_grants"](spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_neighbours_shuffle_no_pairs(spark, monkeypatch):
    """A full cube dealt to several groups, equal gaps and repeated ids: as by brute force, without a join or window of pairs."""
    monkeypatch.setattr(joins, "OWN", 8)
    rng = random.Random(4)
    rows = [(i % 190, *(float(rng.randrange(-6, 7)) for _ in "xyz")) for i in range(200)] + [(None, 0.0, 0.0, 0.0), (500, None, 0.0, 0.0), (501, 90.0, 0.0, 0.0)]
    got = joins.neighbours(spark.createDataFrame(rows, "id long, x double, y double, z double"), 3.0, 5)
    want = {}
    for a, *p in rows:
        near = [(math.dist(p, q), b) for b, *q in rows if None not in (a, b, *p, *q) and a != b and math.dist(p, q) <= 3]
        want[a] = want.get(a, []) + near
    assert {tuple(r) for r in got.collect()} == {(a, len(v), round(min(v)[0], 6), ",".join(str(b) for _, b in sorted(v)[:5])) for a, v in want.items() if v}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
