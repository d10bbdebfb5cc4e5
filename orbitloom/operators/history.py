"""Event history: search, resume, summary, current conditions, visibility, sinks' sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(events: DataFrame, types: list[str] | None = None, min_severity: int = 0, since=None, until=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events of the given types and at least the severity (clamped to 0..2) in the closed time window, newest first, with the total before paging."""
    found = events.filter(F.col("severity") >= max(0, min(2, min_severity)))
    if types:
        found = found.filter(F.col("type").isin(types))
    if since is not None:
        found = found.filter(F.col("time") >= F.lit(since).cast("timestamp"))
    if until is not None:
        found = found.filter(F.col("time") <= F.lit(until).cast("timestamp"))
    total = found.groupBy("audience").agg(F.count("*").alias("total"))
    if limit is None:
        return found.join(total, "audience")
    newest = found.orderBy(F.desc("time"), F.desc("seq")).offset(offset).limit(limit)
    return newest.join(total, "audience")


def page(events: DataFrame, limit: int, offset: int = 0, deepest: int = 100_000) -> DataFrame:
    """A page of events (1 to 500, at most `deepest` from the newest), newest first, beside the total of all; a page beyond the end is one row with the total and nulls."""
    total = events.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    skipped = max(0, min(deepest, offset))
    reached = events.join(F.broadcast(total.filter(F.col("total") > skipped).select("_one"))).drop("_one")  # one row or none: nothing is sorted for a page beyond the end
    newest = reached.orderBy(F.desc("time"), F.desc("seq")).offset(skipped).limit(max(1, min(500, limit))).withColumn("_one", F.lit(1))
    return total.join(newest, "_one", "left").drop("_one")


def resume(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Of each audience: events after its cursor (audience, last_seq), first of them, and whether the cursor is no longer kept."""
    last = F.col("last_seq")
    return events.join(cursors, "audience").groupBy("audience").agg(F.count_if(F.col("seq") > last).alias("waiting"), F.min(F.when(F.col("seq") > last, F.col("seq"))).alias("next_seq"), (~F.max(F.col("seq") == last)).alias("gap"))


def summary(events: DataFrame) -> DataFrame:
    """Counts by audience and type and over both, with critical and warning counts and the last critical time, in one pass."""
    return events.groupingSets([("audience", "type"), ("audience",), ()], "audience", "type").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") >= 2).alias("critical"), F.count_if(F.col("severity") >= 1).alias("warning"), F.max(F.when(F.col("severity") >= 2, F.col("time"))).alias("last_critical")
    )


def current_conditions(events: DataFrame) -> DataFrame:
    """Latest event of each (audience, subject, type) by sequence, beside the audience's cursor; partial aggregates only."""
    latest = events.groupBy("audience", "subject", "type").agg(F.max_by(F.struct("seq", "time", "severity", "value"), "seq").alias("e"))
    cursor = events.groupBy("audience").agg(F.max("seq").alias("cursor"))
    return latest.join(cursor, "audience").select("audience", "subject", "type", "e.seq", "e.time", "e.severity", F.round("e.value", 6).alias("value"), "cursor")


def fan_out(rows: DataFrame, organization: str, collections: Column) -> DataFrame:
    """One row per private audience of a receipt: its organization unless unassigned, and each of its collections."""
    own = F.when(F.col(organization) != "local-unassigned", F.concat(F.lit("org:"), F.col(organization)))
    return rows.withColumn("private_audience", F.explode(F.array_compact(F.array_union(F.array(own), F.transform(collections, lambda c: F.concat(F.lit("col:"), c))))))


def clamp_visibility(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Events not before the audience's boundary (audience, start), with the number that the boundary hides."""
    joined = events.join(boundaries, "audience")
    return joined.groupBy("audience").agg(F.count_if(F.col("time") >= F.col("start")).alias("visible"), F.count_if(F.col("time") < F.col("start")).alias("hidden"), F.min(F.when(F.col("time") >= F.col("start"), F.col("time"))).alias("effective_start"))


def with_sequence(fresh: DataFrame, last: DataFrame) -> DataFrame:
    """Dense sequence numbers per audience after the last ones (audience, last_seq), in order of time and key."""
    order = Window.partitionBy("audience").orderBy("time", "seq")
    return fresh.join(last, "audience", "left").withColumn("audience_seq", F.coalesce("last_seq", F.lit(0)) + F.row_number().over(order)).drop("last_seq")


def dedupe_across_audiences(events: DataFrame) -> DataFrame:
    """One row for each (time, type, value) wherever it was sent: that with the smallest sequence."""
    return events.groupBy("time", "type", "value").agg(F.min("seq").alias("seq"), F.count_distinct("audience").alias("audiences"))
