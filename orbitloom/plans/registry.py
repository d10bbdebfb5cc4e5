"""How modules of queries register a query beside its SQL, and the roles of the tables that these queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.operators.tables import STREAM_SQL, table

#: events as satellite observations, for SQL: constellation, satellite, signal, station, Unix seconds.
OBS_SQL = """obs as (select event_id as seq, ts as time, epoch_us(ts) / 1e6 as unix, user_id as station, event_id % 8 as gnss, (event_id * 7 + user_id) % 70 as sv,
 cast(json_extract(props, '$.k') as bigint) % 9 as sig, cast(json_extract(props, '$.k') as bigint) as k, event_type as type, value from events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as satellite observations."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("unix"), F.col("user_id").alias("station"),
        (F.col("event_id") % 8).alias("gnss"), ((F.col("event_id") * 7 + F.col("user_id")) % 70).alias("sv"), (k % 9).alias("sig"), k.alias("k"), F.col("event_type").alias("type"), "value",
    )


def registry() -> tuple[dict, dict, object]:
    """Queries, their SQL, and the decorator that fills both."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text.replace("$STREAM", STREAM_SQL).replace("$OBS", OBS_SQL)
            return f

        return add

    return queries, sql, query
