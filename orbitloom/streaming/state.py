"""Debounce and recovery hold over ordered states, and exactly-once appends of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitloom.operators import series


def debounced(rows: DataFrame, key: str, time: str, state: str, dwell_s: float, healthy: str | None = "ok", tie: str = "seq", clear_s: float | None = None) -> DataFrame:
    """Confirmed transitions (key, old_value, new_value, since, held_until).

    A state is confirmed once it was seen without change for the dwell (clear_s for the healthy one, if given); a gap as
    long as its dwell starts it anew. A healthy first state is taken silently; another one leaves the state 'unknown'
    until it is confirmed, and a healthy row before that is taken silently at once. Without a healthy state the first one is taken."""
    w = series.ordered(key, time, tie)
    dwell = F.when(F.col(state) == healthy, F.lit(clear_s)).otherwise(F.lit(dwell_s)) if healthy and clear_s is not None else F.lit(dwell_s)
    gap = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    cut = F.coalesce((F.lag(state).over(w) != F.col(state)) | (gap >= dwell), F.lit(False))
    split = rows.withColumns({"_cut": cut.cast("int"), "_dwell": dwell}).withColumn("segment", F.sum("_cut").over(w))
    whole = Window.partitionBy(key)
    split = split.withColumns({"since": F.min(time).over(Window.partitionBy(key, "segment")), "_well": F.min(F.when(F.col(state) == healthy, F.col(time))).over(whole), "_first": F.min_by(state, F.struct(time, tie)).over(whole)})
    long = (F.unix_micros(time) - F.unix_micros("since")) / 1e6 >= F.col("_dwell")
    stays = split.groupBy(key, "segment", state, "since", "_well", "_first").agg(F.max(time).alias("held_until"), F.min(F.when(long, F.col(time))).alias("_confirmed"))
    confirmed = stays.filter("_confirmed is not null")
    seed = F.when(F.col("_well") <= F.col("_confirmed"), F.lit(healthy)).otherwise(F.lit("unknown")) if healthy else F.col("_first")
    old = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy("since", "segment")), seed)
    return confirmed.withColumn("old_value", old).filter(F.col("old_value") != F.col(state)).select(key, "old_value", F.col(state).alias("new_value"), "since", "held_until")


def fold(items: Column, start: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]], run: int = 64) -> Column:
    """What step(state, item) -> (state, output) puts out for each item of an array, in order; outputs are gathered in runs, then joined."""

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.array_append(acc["out"], out).alias("out"))

    def part(acc: Column, first: Column) -> Column:
        got = F.aggregate(F.slice(items, first, F.lit(run)), F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return F.struct(got["state"].alias("state"), F.concat(acc["out"], got["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.size(items), F.lit(run)), F.struct(start.alias("state"), empty.alias("out")), part, lambda acc: acc["out"])


def held(rows: DataFrame, key: str, time: str, rank: str, hold_s: int, worst: int = 2, tie: str = "seq") -> DataFrame:
    """rows with the rank that a recovery hold shows (higher is worse): worse at once; better only hold_s after the recovery
    began, at the worst rank seen since then, and each step down begins anew; an equal rank ends the recovery.

    A row of the worst rank settles the state, so histories are folded in stretches that begin with such rows."""
    w = series.ordered(key, time, tie)
    stretch = F.sum((F.col(rank) == worst).cast("int")).over(w)
    columns = rows.columns
    item = F.struct(F.unix_micros(time).alias("_at"), F.col(tie).alias("_tie"), F.col(rank).cast("int").alias("_rank"), F.struct(*columns).alias("_row"))
    grouped = rows.withColumn("_stretch", F.coalesce(stretch, F.lit(0))).groupBy(key, "_stretch").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(F.lit(None).cast("int").alias("served"), F.lit(None).cast("long").alias("since"), F.lit(None).cast("int").alias("floor"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        settled = state["served"].isNull() | (x["_rank"] >= state["served"])
        since = F.coalesce(state["since"], x["_at"])
        floor = F.greatest(state["floor"], x["_rank"])  # nulls are skipped
        done = x["_at"] - since >= hold_s * 1_000_000
        served = F.when(settled, x["_rank"]).when(done, floor).otherwise(state["served"])
        over = settled | done
        after = F.struct(served.alias("served"), F.when(~over, since).alias("since"), F.when(~over, floor).alias("floor"))
        return after, served

    shown = grouped.withColumn("_held", fold(F.col("_items"), start, F.array().cast("array<int>"), step))
    each = shown.select(F.explode(F.arrays_zip(F.col("_items._row").alias("row"), F.col("_held").alias("held"))).alias("_x"))
    return each.select("_x.row.*", F.col("_x.held").alias("held_rank"))


def deduplicated(stream: DataFrame, key: list[str], time: str, horizon: str) -> DataFrame:
    """A stream without repeats of a key within the horizon; rows without a full key always pass."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    marked = stream.withColumn("_once", F.when(whole, F.lit("")).otherwise(F.uuid()))
    return marked.withWatermark(time, horizon).dropDuplicatesWithinWatermark([*key, "_once"]).drop("_once")


def live(rows: DataFrame, stamp: str, now: str, late_s: float = 60.0, ahead_s: float = 1.0) -> DataFrame:
    """rows with the reason for which they stay out of live results ('unstamped', 'future', 'late'), else null; all are kept for the store."""
    lag = (F.unix_micros(now) - F.unix_micros(stamp)) / 1e6
    return rows.withColumn("rejected", F.when(F.col(stamp).isNull(), "unstamped").when(lag < -ahead_s, "future").when(lag > late_s, "late"))
