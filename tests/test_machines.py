"""Streams of several batches, restarted from their checkpoint, against the batch forms of the same rows."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from orbitloom.operators import checks, folds
from orbitloom.streaming import machines, state

SCHEMA = "subject long, time timestamp, seq long, state string, rank long, bad boolean, agc long"
T0 = datetime.datetime(2024, 1, 1)


def made():
    rng = random.Random(4)
    rows, at = [], 0
    for seq in range(400):
        at += rng.choice([0, 10, 60, 200, 900])
        level = rng.choice(["ok", "ok", "ok", "warn", "crit"]) if seq % 25 == 0 else None
        level = level or (rows[-1][3] if rows else "ok")
        rows.append((rng.randrange(4), T0 + datetime.timedelta(seconds=at), seq, level, {"ok": 0, "warn": 1, "crit": 2}[level], rng.choice([None, True, False, False, level != "ok"]), rng.choice([4000, 4010, 4600, 3000])))
    return rows


@pytest.fixture(scope="module")
def stream_spark(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, machines.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def streamed(spark, rows, **how):
    """What a machine gives for rows that come in four files out of order, the last two after a restart."""
    base = tempfile.mkdtemp(prefix="spark-")
    order = sorted(rows, key=lambda r: (r[1].timestamp() // 7200, random.Random(r[2]).random()))  # mixed within two hours
    size = -(-len(order) // 4)
    flush = [(-1, T0 + datetime.timedelta(days=days), 10_000 + days, "ok", 0, False, 0) for days in (400, 800)]  # moves the watermark on
    parts = [order[i * size : (i + 1) * size] for i in range(4)]

    def go(i, part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = machines.receipts(spark, f"{base}/in", SCHEMA, "time", "3 hours")
        out = machines.machine(source, ["subject"], "time", "seq", **how)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
        query.awaitTermination(120)
        assert query.exception() is None

    for i, part in enumerate([*parts, flush[:1], flush[1:]]):  # every run starts from the checkpoint of the one before
        go(i, part)
    return spark.read.parquet(f"{base}/out").filter("subject >= 0")


def test_debounce_and_restart(stream_spark):
    rows = made()
    found = streamed(stream_spark, rows, reads=["state"], step=machines.debounce(1800), outputs=machines.DEBOUNCE_OUT)
    assert found.count() == len(rows)
    got = sorted(tuple(r) for r in found.filter("new_value is not null").select("subject", "old_value", "new_value", "since").collect())
    batch = state.debounced(stream_spark.createDataFrame(rows, SCHEMA), "subject", "time", "state", 1800)
    assert got == sorted(tuple(r) for r in batch.select("subject", "old_value", "new_value", F.unix_micros("since")).collect()) and len(got) > 5


def test_hold(stream_spark):
    rows = made()
    found = streamed(stream_spark, rows, reads=["rank"], step=machines.hold(3000), outputs=machines.HOLD_OUT)
    batch = state.held(stream_spark.createDataFrame(rows, SCHEMA), "subject", "time", "rank", 3000)
    assert sorted(map(tuple, found.select("seq", "held_rank").collect())) == sorted(map(tuple, batch.select("seq", "held_rank").collect()))


def test_alarm(stream_spark):
    rows = made()
    found = streamed(stream_spark, rows, reads=["bad"], step=machines.alarm(600, 900, 5000), outputs=machines.ALARM_OUT)
    batch = checks.alarms(stream_spark.createDataFrame(rows, SCHEMA), "subject", "time", F.col("bad").isNotNull(), F.col("bad"), 600, 900, 5000)
    want = sorted(map(tuple, batch.select("seq", "alarm").collect()))
    times = {(r[0], r[1]) for r in rows}
    assert len(times) <= len(rows) and len({a for _, a in want}) == 2
    once = {s for s, _ in want}  # the batch form shows the first of repeated times
    assert sorted(t for t in map(tuple, found.select("seq", "alarm").collect()) if t[0] in once) == want


def test_expiry(stream_spark):
    rows = made()
    found = streamed(stream_spark, rows, reads=["state"], step=machines.expiry(), outputs=machines.EXPIRY_OUT, silent_s=2500)
    got = sorted((r.subject, r["at"]) for r in found.filter("fate = 'expired'").collect())
    want = []
    for subject in range(4):
        own = sorted(int(r[1].replace(tzinfo=datetime.timezone.utc).timestamp() * 1e6) for r in rows if r[0] == subject)
        want += [(subject, a) for a, b in zip(own, [*own[1:], 1 << 62]) if b - a > 2500 * folds.SECOND]
    assert got == sorted(want)


def test_a_fold_with_a_learned_level(stream_spark):
    rows = made()
    step = folds.agc_baseline(least=1, warm_up=2, minute_s=1800)
    found = streamed(stream_spark, rows, reads=["agc"], step=step, outputs=folds.AGC_OUT)
    df = stream_spark.createDataFrame(rows, SCHEMA).withColumn("at", F.unix_micros("time"))
    batch = folds.folded(df, ["subject"], ["at", "seq"], ["at", "agc"], step, folds.AGC_OUT)
    assert sorted(map(tuple, found.select("seq", "baseline", "departure").collect()), key=str) == sorted(map(tuple, batch.select("seq", "baseline", "departure").collect()), key=str)
