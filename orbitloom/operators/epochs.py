"""Windows over epochs: trailing baselines, trapezoid steps, changeovers, silences, deferrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(key: str, time: str, first_s: float, last_s: float):
    """Frame of rows whose time is between first_s and last_s seconds before the row's."""
    return Window.partitionBy(key).orderBy(F.unix_micros(time)).rangeBetween(int(-first_s * 1e6), int(-last_s * 1e6))


def baseline_departure(rows: DataFrame, key: str, time: str, value: str, window_s: float, least: int) -> DataFrame:
    """rows with the median of the window before them (without themselves), if it has enough samples, and the departure from it."""
    w = trailing(key, time, window_s, 1e-6)
    base = F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w))
    return rows.withColumn("baseline", base).withColumn("departure", F.col(value) - F.col("baseline"))


def trapezoid_residual(rows: DataFrame, key: str, time: str, bias: str, drift: str, tie: str = "seq") -> DataFrame:
    """rows with the step of the bias less the trapezoid of the drift over the time since the row before."""
    w = Window.partitionBy(key).orderBy(time, tie)
    dt = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    step = F.col(bias) - F.lag(bias).over(w) - dt * (F.col(drift) + F.lag(drift).over(w)) / 2
    return rows.withColumn("residual", step)


def silences(rows: DataFrame, key: str, time: str, seconds: float, now: Column | str, receiver: str, live_s: float, least: int, tie: str = "seq") -> DataFrame:
    """Stretches of more than so many seconds without a row of the key, with their end (null if still open at now).

    A silence counts only if at least so many receivers were live when it was noticed (seconds after its begin, now at the
    latest): heard in the same or the previous slot of live_s seconds. now is a column of rows (one value)."""
    at = F.unix_micros(time) / 1e6
    slot = F.floor(at / live_s)
    heard = rows.select(F.explode(F.array(slot, slot + 1)).alias("_slot"), receiver).groupBy("_slot").agg(F.count_distinct(receiver).alias("_live")).filter(F.col("_live") >= least)
    after = F.lead(time).over(Window.partitionBy(key).orderBy(time, tie))
    stretches = rows.select(key, F.col(time).alias("begins"), after.alias("ends"), F.col(now).alias("_now") if isinstance(now, str) else now.alias("_now"))
    begins, until = F.unix_micros("begins") / 1e6, F.unix_micros(F.coalesce("ends", "_now")) / 1e6
    found = stretches.filter(until - begins > seconds).withColumn("_slot", F.floor((F.unix_micros("begins") / 1e6 + seconds) / live_s))
    return found.join(heard, "_slot", "left_semi").select(key, "begins", "ends")


def deferrals(rows: DataFrame, key: str, time: str, arms: Column, completes: Column, at_once_s: float, tie: str = "seq") -> DataFrame:
    """Of each arming row what came of it before the next one: immediate, completed, superseded or unresolved, with the lag in seconds."""
    w = Window.partitionBy(key).orderBy(time, tie)
    numbered = rows.withColumns({"_arm": arms, "_done": completes}).withColumn("_n", F.sum(F.col("_arm").cast("int")).over(w)).filter("_n > 0")
    each = numbered.groupBy(key, "_n").agg(F.min(F.when(F.col("_arm"), F.struct(time, tie))).alias("_at"), F.min(F.when(F.col("_done"), F.col(time))).alias("_end"))
    last = F.col("_n") == F.max("_n").over(Window.partitionBy(key))
    lag = (F.unix_micros("_end") - F.unix_micros(F.col("_at")[time])) / 1e6
    outcome = F.when(lag <= at_once_s, "immediate").when(lag.isNotNull(), "completed").when(last, "unresolved").otherwise("superseded")
    return each.select(key, F.col("_at")[tie].alias(tie), outcome.alias("outcome"), lag.alias("lag_s"))
