"""Scans and sinks that fail loudly or write."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from orbitloom.operators import scope
from orbitloom.sources import scans, sinks


def test_missing_column_is_named(spark):
    rows = spark.range(1)
    with pytest.raises(ValueError, match="a, b"):
        scans.typed(rows, {"b": "int", "id": "long", "a": "int"})
    assert scans.typed(rows, {"id": "long"}, {"late": ("int", 7)}).collect() == [(0, 7)]


def test_limit_is_loud(spark):
    rows = spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, id) as received, id from range(5)")
    with pytest.raises(ValueError, match="more than 3"):
        scans.replay(rows, "received", "2024-01-01", "2024-01-05", 3)
    assert [r.id for r in scans.replay(rows, "received", "2024-01-01", "2024-01-05", 4).orderBy("id").collect()] == [0, 1, 2, 3]
    assert scans.replay(rows, "received", "2024-01-01", id=2).count() == 1


def test_append_once(spark):
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/receipts"
    batch = lambda *rows: spark.createDataFrame(rows, "source string, seq long, place long, day string")
    put = lambda rows, name: sinks.append_receipts(rows, path, ["source", "seq"], ["place"], name, "day")
    stored = lambda: sorted((r.source or "", r.seq or -1, r.place) for r in spark.read.parquet(path).collect())
    put(batch(("a", 1, 1, "d1"), ("a", 1, 2, "d1"), (None, 5, 3, "d1"), (None, 5, 4, "d1")), "one")
    put(batch(("a", 1, 5, "d2"), ("a", 2, 6, "d2")), "two")
    want = [("", 5, 3), ("", 5, 4), ("a", 1, 1), ("a", 2, 6)]
    assert stored() == want
    put(batch(("a", 1, 5, "d2"), ("a", 2, 6, "d2")), "two")  # the batch is repeated after a lost driver
    assert stored() == want


def test_append_under_names_like_numbers(spark):
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/receipts"
    batch = spark.createDataFrame([("a", 1, 1, "01"), ("a", 2, 2, "1")], "source string, seq long, place long, day string")
    for name in ("1", "01", "1.0", "1"):
        sinks.append_receipts(batch, path, ["source", "seq"], ["place"], name, "day")
    stored = spark.read.schema("source string, seq long, place long, batch string, day string").parquet(path).collect()
    assert sorted((r.seq, r.batch, r.day) for r in stored) == [(1, "1", "01"), (2, "1", "1")]


def test_append_reads_claims_since(spark):
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/receipts"
    batch = lambda day: spark.createDataFrame([("a", 1, 1, day)], "source string, seq long, place long, day string")
    put = lambda day, name, since: sinks.append_receipts(batch(day), path, ["source", "seq"], ["place"], name, "day", since)
    put("2024-01-01", "one", None)
    put("2024-01-05", "two", "2024-01-01")
    assert spark.read.parquet(path).count() == 1  # claimed within the horizon
    put("2024-01-09", "three", "2024-01-02")
    assert spark.read.parquet(path).count() == 2  # the claim was older than the horizon


def test_append_to_broken_table_fails(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(folder + "/receipts/batch=one/day=d")
    with open(folder + "/receipts/batch=one/day=d/part-0.parquet", "w") as f:
        f.write("no parquet")
    batch = spark.createDataFrame([("a", 1, 1, "d")], "source string, seq long, place long, day string")
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.append_receipts(batch, "file://" + folder + "/receipts", ["source", "seq"], ["place"], "two", "day")


def test_rewrite_and_retention(spark):
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/days"
    rows = spark.sql("select date_add(date'2024-01-01', cast(id % 10 as int)) as day, id % 3 as source, id from range(60)")
    sinks.rewrite(rows, path, "day", ["source"], ["id"])
    back = spark.read.parquet(path)
    assert back.count() == 60
    kept = sinks.retained(back, "day", F.lit("2024-01-10").cast("date"), 4)
    assert kept.count() == 30 and "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().toString()
    assert sinks.retained(back, "day", F.lit("2024-01-10").cast("date"), None).count() == 60


def test_almanac_block(spark):
    row = "select 7 as sv, 63 as health, 0.0123 as e, 319488 as toa, 0.01d as inclination, -8.0e-9d as node_rate, 5153.5d as sqrt_a, -1.5d as node, 0.5d as perigee, 0.0d as anomaly, 1e-5d as af0, 0.0d as af1, 2200 as week, 1000000 as at"
    text = spark.sql(row).select(sinks.almanac_text(F.lit(1000000))).first()[0].split("\n")
    assert text[0] == "******** Week 152 almanac for PRN-07 ********" and text[2] == "Health:                     063"
    assert text[6] == "Rate of Right Ascen(r/s):   -0.8000000000E-008" and text[10] == "Mean Anom(rad):             0.0000000000E+000"
    assert text[8] == "Right Ascen at Week(rad):   -0.1500000000E+001" and text[13] == "week:                       152" and text[14] == ""


def test_pages(spark):
    rows = spark.range(10)
    got = scope.page(rows, [F.col("id")], 4, 8).collect()
    assert [(r.id, r.has_more) for r in got] == [(8, False), (9, False)]
    assert [r.has_more for r in scope.page(rows, [F.col("id")], 4).collect()] == [True] * 4
    assert scope.page(rows, [F.col("id")], 0).count() == 1
    with pytest.raises(ValueError):
        scope.page(rows, [F.col("id")], 4, -1)


def test_scopes_fail_closed(spark):
    row = spark.sql("select cast(null as string) as collector, '' as organization, cast(null as array<string>) as collections, cast(null as boolean) as public")
    asked = [scope.allows("operator", F.lit("c")), scope.allows("organization", F.lit("")), scope.allows("collection", F.lit("g")), scope.allows("public"), scope.allows("other", F.lit("x")), scope.allows("operator")]
    assert list(row.select(*asked).first()) == [False] * 6
