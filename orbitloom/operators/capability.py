"""What stations deliver against what they declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows after which a signal counts as demonstrated, seconds of silence after which it is lost, seconds in which a live station was heard.
DEMONSTRATED, LOST_S, ALIVE_S = 10, 900, 300


def report(seen: DataFrame, declared: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One row per station, gnss and sig seen or declared: count, last_seen (null if only declared), declared, has_declared, and
    station_last_seen, which telemetry can raise. Stations with telemetry alone have no rows.

    seen: station, gnss, sig, count, last_seen; declared: station, gnss, sig; telemetry: station, last_seen; times in seconds, keys unique but for telemetry's."""
    both = seen.join(declared.distinct().withColumn("declared", F.lit(True)), ["station", "gnss", "sig"], "full_outer").withColumn("declared", F.coalesce("declared", F.lit(False)))
    heard = both.groupBy("station").agg(F.max("last_seen").alias("_nav"), F.max("declared").alias("has_declared"))
    other = telemetry.groupBy("station").agg(F.max("last_seen").alias("_rf"))
    live = heard.join(other, "station", "left").select("station", "has_declared", F.greatest("_nav", "_rf").alias("station_last_seen"))
    return both.join(live, "station")


def lost(reported: DataFrame, now: Column, demonstrated: int = DEMONSTRATED, lost_s: float = LOST_S, alive_s: float = ALIVE_S) -> DataFrame:
    """State of each seen signal: lost if demonstrated and silent while its station is alive; null (the state before holds) while it is not."""
    alive = F.coalesce(now - F.col("station_last_seen") <= alive_s, F.lit(False))
    gone = (F.col("count") >= demonstrated) & (now - F.col("last_seen") > lost_s)
    return reported.filter("last_seen is not null").select("station", "gnss", "sig", F.when(alive, F.when(gone, "lost").otherwise("present")).alias("state"), (now - F.col("last_seen")).alias("unseen_s"))


def impossible(reported: DataFrame) -> DataFrame:
    """State of each station that declares signals: impossible if it delivers others, which are listed in order."""
    name = F.concat_ws(":", F.col("gnss").cast("string"), F.col("sig").cast("string"))
    listed = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("declared"), name))), ",")
    found = reported.filter("has_declared").groupBy("station").agg(listed.alias("signals"))
    return found.select("station", F.when(F.col("signals") != "", "impossible").otherwise("ok").alias("state"), "signals")
