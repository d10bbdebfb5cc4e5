import __spark_entry__ as entry
from pyspark.sql import functions as F

from orbitloom.operators import epochs, history, joins, series
from orbitloom.streaming import state


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_dedup(spark, tmp_path):
    rows = spark.sql("select * from values ('a', 1L, timestamp'2024-01-01 00:00:00'), ('a', 1L, timestamp'2024-01-01 00:00:05'), ('a', null, timestamp'2024-01-01 00:00:06'), ('a', null, timestamp'2024-01-01 00:00:07') as t(session, seq, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = state.deduplicated(stream, ["session", "seq"], "ts", "7 days").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("kept").count() == 3


def test_debounce_by_hand(spark):
    rows = spark.sql("""select 's' as k, id as seq, timestamp_seconds(id * 30) as t,
      case when id between 3 and 4 then 'crit' when id >= 8 then 'warn' else 'ok' end as state from range(12)""")
    got = state.debounced(rows, "k", "t", "state", 60).select("old_value", "new_value").collect()
    assert [tuple(r) for r in got] == [("ok", "warn")]


def test_watermark_by_hand(spark):
    rows = spark.sql("select 'a' as k, * from values (1, true), (2, true), (3, false), (4, true) as t(seq, done)")
    assert series.watermark(rows, ["k"], "seq", "done").first()["watermark"] == 2


def times(spark, rows, columns="k string, seq long, s long, v string"):
    return spark.createDataFrame(rows, columns).selectExpr("*", "timestamp_seconds(s) as t")


def debounce(spark, states, step=15, dwell=60, **more):
    rows = times(spark, [("a", i, i * step, v) for i, v in enumerate(states) if v])
    return [(r["old_value"], r["new_value"]) for r in state.debounced(rows, "k", "t", "v", dwell, **more).collect()]


def test_debounce_seeds(spark):
    assert debounce(spark, ["crit", *["ok"] * 8]) == []  # an unconfirmed degradation that reverts seeds the healthy state silently
    assert debounce(spark, ["crit", "ok", *["crit"] * 5]) == [("ok", "crit")]
    assert debounce(spark, ["crit"] * 5) == [("unknown", "crit")]
    assert debounce(spark, [*["crit"] * 5, "ok", *["crit"] * 5]) == [("unknown", "crit")]
    assert debounce(spark, [*["ok"] * 2, *["warn"] * 5, *["ok"] * 5]) == [("ok", "warn"), ("warn", "ok")]


def test_debounce_holds(spark):
    # a gap as long as the dwell starts it anew, a shorter one does not
    assert debounce(spark, ["ok", "warn", None, None, None, "warn", "warn"]) == []
    assert debounce(spark, ["ok", "warn", None, None, "warn", "warn"]) == [("ok", "warn")]
    assert debounce(spark, ["ok", *["warn"] * 5, *["ok"] * 4], clear_s=30) == [("ok", "warn"), ("warn", "ok")]
    assert debounce(spark, ["ok", *["warn"] * 5, *["ok"] * 4], clear_s=90) == [("ok", "warn")]


def test_hold_serves_worst_of_recovery(spark):
    def shown(pairs):
        rows = times(spark, [("a", i, s, str(r)) for i, (s, r) in enumerate(pairs)]).selectExpr("*", "int(v) as rank")
        return [r["held_rank"] for r in state.held(rows, "k", "t", "rank", 300).orderBy("s").collect()]

    assert shown([(0, 2), (10, 1), (200, 0), (310, 0), (320, 0)]) == [2, 2, 2, 1, 1]
    assert shown([(0, 2), (400, 0), (500, 0), (700, 0)]) == [2, 2, 2, 0]
    assert shown([(0, 1), (10, 0), (20, 1), (330, 0), (629, 0), (630, 0)]) == [1, 1, 1, 1, 1, 0]
    assert shown([(i, 1 if i else 0) for i in range(200)]) == [0, *[1] * 199]


def test_silence_open_and_floor(spark):
    rows = times(spark, [("sv", 0, 0, "r0"), *[("x", 10 + i, i * 100, f"r{i % 4}") for i in range(80)]]).selectExpr("*", "timestamp_seconds(7900) as now")
    found = lambda df, least: [(r["k"], r["ends"]) for r in epochs.silences(df, "k", "t", 3600, "now", "v", 300, least).collect()]
    assert found(rows, 4) == [("sv", None)]
    assert found(rows.filter("v <> 'r3'"), 4) == [] and found(rows.filter("v <> 'r3'"), 3) == [("sv", None)]


def test_page_beyond_end_has_total(spark):
    events = times(spark, [("a", i, i, "") for i in range(7)]).withColumnRenamed("t", "time")
    assert [r["total"] for r in history.page(events, 5, 100).collect()] == [7]
    assert [(r["total"], r["seq"]) for r in history.page(events, 2, 5).orderBy("seq").collect()] == [(7, 0), (7, 1)]


def test_joins_keep_whole_rows(spark):
    left = times(spark, [("a", 1, 100, "l"), ("a", 1, 100, "l")]).drop("seq")
    right = times(spark, [("a", 5, 50, "x"), ("a", 6, 60, None), ("a", 7, 60, None), ("a", 9, 130, "z")])
    got = joins.as_of(left, right, "k", "t", ["seq", "v"]).collect()
    assert [(r["asof_seq"], r["asof_v"]) for r in got] == [(7, None)] * 2  # one right row, not a mix, and of equal times the larger
    near = joins.nearest(left.select("k", "t"), right.select("k", F.col("seq").alias("n"), F.col("t").alias("rt")), "k", "t", "rt", 60, ["n"], "n")
    assert [r["n"] for r in near.collect()] == [9, 9]


def test_nearest_rank_with_absent(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 2.0, 9.0, None)] + [("b", None), ("b", None)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in series.nearest_rank(rows, "k", "v", [50, 95], [2.0, 9.5]).collect()}
    assert got == {"a": (5, 2.0, 9.0, 9.0, 1, 80.0, 0.0), "b": (0, None, None, None, 2, None, None)}
