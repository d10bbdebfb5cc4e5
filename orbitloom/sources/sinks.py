"""Writes: receipts with their claims, feed snapshots, retention, ledger prunes, time lines, almanac text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEEK_S = 604800


def fresh(receipts: DataFrame, ledger: DataFrame | None, key: list[str], order: list[str]) -> DataFrame:
    """Receipts whose key is not yet claimed, the first of each key; rows without a full key always pass."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    keyed = receipts.filter(whole)
    if ledger is not None:
        keyed = keyed.join(ledger.select(*key), key, "left_anti")
    columns = [c for c in receipts.columns if c not in key]
    first = keyed.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(*key, "_row.*")
    return first.select(*receipts.columns).unionByName(receipts.filter(~whole))


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Rows written so far; None only where nothing is there, so that a table that cannot be read is an error. The schema keeps partition
    values what they were: names like 01 would be read back as numbers."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path)


def append_receipts(receipts: DataFrame, path: str, key: list[str], order: list[str], batch: str, partition: str, since: object = None) -> None:
    """Appends a batch of receipts that were not stored before.

    The stored rows are the claims, so one write both stores and claims. Each batch owns the directories of its name, which
    a repeat of the batch (after a lost driver) overwrites: it is compared with the other batches only. With since, claims are kept from that
    value of the partition column on (K6): older partitions are not read, and what they hold may be stored again."""
    spark = receipts.sparkSession
    columns = [*receipts.schema.fields, T.StructField("batch", T.StringType())]
    before = _stored(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in columns]))
    if before is not None:
        before = before.filter(F.col("batch") != batch)
        if since is not None:
            before = before.filter(F.col(partition) >= F.lit(since))
    rows = fresh(receipts, before, key, order).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", partition).parquet(path)


def snapshot(feeds: dict[str, DataFrame], audience: Column, at: Column) -> DataFrame:
    """One row per row of each feed: time, audience, endpoint, and the row as JSON."""
    parts = [rows.select(at.alias("time"), audience.alias("audience"), F.lit(name).alias("endpoint"), F.to_json(F.struct(*rows.columns)).alias("data")) for name, rows in feeds.items()]
    done = parts[0]
    for p in parts[1:]:
        done = done.unionByName(p)
    return done


def retained(rows: DataFrame, day: str, now: Column, keep_days: int | None) -> DataFrame:
    """Rows no older than so many days; None keeps all (events and their evidence). day is the partition column, so that older files are not read."""
    return rows if keep_days is None else rows.filter(F.col(day) >= F.date_sub(now, keep_days))


def rewrite(rows: DataFrame, path: str, day: str, cluster: list[str], order: list[str]) -> None:
    """Writes rows by day, clustered and sorted inside each file, so that row groups skip on the cluster columns."""
    rows.repartition(day, *cluster).sortWithinPartitions(day, *cluster, *order).write.mode("overwrite").partitionBy(day).parquet(path)


def pruned(claims: DataFrame, sessions: DataFrame, key: list[str], cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Claims seen since the cutoff, and sessions first seen since it or with a claim left."""
    kept = claims.filter(F.col("seen_at") >= cutoff)
    used = sessions.join(kept.select(*key).distinct().withColumn("_used", F.lit(True)), key, "left")
    return kept, used.filter((F.col("first_seen") >= cutoff) | F.col("_used")).drop("_used")


def timeline(changes: DataFrame, events: DataFrame, time: str) -> DataFrame:
    """Assessment changes and events as JSON lines, each with its kind."""
    lines = lambda rows, kind: rows.select(F.col(time).alias("at"), F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns)).alias("line"))
    return lines(changes, "assessment").unionByName(lines(events, "event"))


def scientific(value: Column) -> Column:
    """A number as 0.xxxxxxxxxxE+nnn."""
    exponent = (F.floor(F.log10(F.abs(value))) + 1).cast("int")
    text = F.format_string("%.10fE%s%03d", value / F.pow(F.lit(10.0), exponent), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent))
    return F.when(value == 0, "0.0000000000E+000").otherwise(text)


def almanac_text(now: Column) -> Column:
    """The YUMA block of a row with sv, health, e, toa, inclination (offset), node_rate, sqrt_a, node, perigee, anomaly, af0, af1, week (full) and at (Unix seconds of week and toa)."""
    line = lambda label, value: F.concat(F.lit(label.ljust(28)), value)
    number = lambda c, d: F.format_string(f"%.{d}f", c.cast("double"))
    two = F.lpad(F.col("sv").cast("string"), 2, "0")
    health = F.col("health").bitwiseAND(31) + F.when(F.shiftright("health", 5) != 0, 32).otherwise(0)
    made = F.pmod(F.col("week") + F.floor((F.col("toa") + now - F.col("at")) / WEEK_S), F.lit(1024))
    return F.concat_ws(
        "\n", F.concat(F.lit("******** Week "), made.cast("string"), F.lit(" almanac for PRN-"), two, F.lit(" ********")),
        line("ID:", two), line("Health:", F.lpad(health.cast("string"), 3, "0")), line("Eccentricity:", scientific(F.col("e"))), line("Time of Applicability(s):", number(F.col("toa"), 4)),
        line("Orbital Inclination(rad):", number(0.30 * math.pi + F.col("inclination"), 10)), line("Rate of Right Ascen(r/s):", scientific(F.col("node_rate"))), line("SQRT(A)  (m 1/2):", number(F.col("sqrt_a"), 6)),
        line("Right Ascen at Week(rad):", scientific(F.col("node"))), line("Argument of Perigee(rad):", scientific(F.col("perigee"))), line("Mean Anom(rad):", scientific(F.col("anomaly"))),
        line("Af0(s):", scientific(F.col("af0"))), line("Af1(s/s):", scientific(F.col("af1"))), line("week:", F.pmod(F.col("week"), F.lit(1024)).cast("string")), F.lit(""),
    )
