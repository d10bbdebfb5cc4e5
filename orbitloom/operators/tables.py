"""Tables and the roles that their columns play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an audience's event history: subject, type, sequence, time, severity, body."""
    severity = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), F.col("user_id").alias("subject"), (F.col("user_id") % 4).alias("audience"),
        F.col("event_type").alias("type"), severity.alias("severity"), "value", F.col("props").alias("body"),
    )


def with_state(events: DataFrame, warn: float = 8.0, crit: float = 15.0) -> DataFrame:
    """events with the level of their value."""
    return events.withColumn("state", F.when(F.col("value") >= crit, "crit").when(F.col("value") >= warn, "warn").otherwise("ok"))


#: The same roles for SQL.
STREAM_SQL = """stream as (select event_id as seq, ts as time, user_id as subject, user_id % 4 as audience, event_type as type,
 case event_type when 'error' then 2 when 'purchase' then 1 else 0 end as severity, value, props as body,
 case when value >= 15 then 'crit' when value >= 8 then 'warn' else 'ok' end as state from events)"""
