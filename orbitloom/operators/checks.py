"""Verdicts over epochs of one station: bases some time ago, means, line fits, simultaneous drops, alarms, stale rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitloom.functions import grades
from orbitloom.operators.epochs import trailing
from orbitloom.operators.series import ordered, with_segments


def from_base(rows: DataFrame, key: str, time: str, values: list[str], least_s: float, most_s: float) -> DataFrame:
    """rows with base: time and values of the newest row of the key that is least_s to most_s seconds old, else null."""
    return rows.withColumn("base", F.last(F.struct(time, *values)).over(trailing(key, time, most_s, least_s)))


def adjusted(residual: Column, whole: float, tolerance: float) -> Column:
    """A residual without the whole steps (whole milliseconds) that a receiver jumps by, where it is near one."""
    steps = F.round(residual / whole)
    return F.when((steps != 0) & (F.abs(residual - steps * whole) <= tolerance), residual - steps * whole).otherwise(residual)


def bias_drift(rows: DataFrame, key: str, time: str, bias: str, drift: str, whole: float, tolerance: float, least_s: float, most_s: float, tie: str = "seq") -> DataFrame:
    """rows with departure: the sum of step residuals (less whole jumps) since the base least_s to most_s ago; null without one."""
    w = ordered(key, time, tie)
    dt = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    step = F.col(bias) - F.lag(bias).over(w) - dt * (F.col(drift) + F.lag(drift).over(w)) / 2
    summed = rows.withColumn("_r", F.coalesce(adjusted(step, whole, tolerance), F.lit(0.0))).withColumn("_sum", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    based = from_base(summed, key, time, ["_sum"], least_s, most_s)
    return based.withColumn("departure", F.col("_sum") - F.col("base._sum")).drop("_r", "_sum", "base")


def mean_offset(rows: DataFrame, key: str, time: str, value: str, window_s: float, gap_s: float, least: int) -> DataFrame:
    """rows with the number of epochs of the window in the row's unbroken run, and their mean if there are enough.

    Values are summed from the row itself back in time, as the SQL's join meets them: a sum at a limit depends on the order in its last digit."""
    runs = with_segments(rows, key, time, gap_s)
    w = Window.partitionBy(key, "segment").orderBy(F.unix_micros(time).desc()).rangeBetween(0, int(window_s * 1e6))
    return runs.withColumn("epochs", F.count(value).over(w)).withColumn("mean", F.when(F.col("epochs") >= least, F.avg(value).over(w))).drop("segment")


def line_residual(rows: DataFrame, key: str, time: str, phase: str, period: float, youngest_s: float, oldest_s: float, least: int, tie: str = "seq") -> DataFrame:
    """rows with fitted (samples in the window) and residual of the unwrapped phase from the line through them, carried on to now."""
    w = ordered(key, time, tie)
    raw = F.col(phase) - F.lag(phase).over(w)
    step = F.coalesce(raw - F.lit(period) * F.rint(raw / period), F.first(phase).over(w))
    whole = rows.withColumn("_step", step).withColumn("_phase", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    timed = whole.withColumn("_x", F.unix_micros(time) / 1e6 - F.min(F.unix_micros(time) / 1e6).over(Window.partitionBy(key)))
    frame = trailing(key, time, oldest_s, youngest_s)
    n, slope = F.count("_x").over(frame), F.covar_pop("_phase", "_x").over(frame) / F.var_pop("_x").over(frame)
    fit = F.avg("_phase").over(frame) + slope * (F.col("_x") - F.avg("_x").over(frame))
    usable = (n >= least) & (F.var_pop("_x").over(frame) > 0)
    return timed.withColumn("fitted", n).withColumn("residual", F.when(usable, F.col("_phase") - fit)).drop("_step", "_phase", "_x")


def simultaneous_drop(levels: DataFrame, key: str, time: str, signal: str, level: str, least_s: float, most_s: float, signals: int, every: float, inconsistent: float, unassured: float) -> DataFrame:
    """One row per snapshot (key, time): how the signals also in the oldest snapshot least_s to most_s ago fell since.

    levels: one row per key, time and signal. All signals must drop by every; the median decides; too few signals or no
    older snapshot: unavailable."""
    snaps = levels.select(key, time).distinct()
    based = snaps.withColumn("_then", F.first(time).over(trailing(key, time, most_s, least_s)))
    now = levels.join(based, [key, time])
    then = levels.select(key, F.col(time).alias("_then"), signal, F.col(level).alias("_was"))
    drops = now.join(then, [key, "_then", signal], "left").withColumn("_drop", F.when(F.col(level) > 0, F.col("_was") - F.col(level)))
    found = drops.groupBy(key, time).agg(F.count("_drop").alias("signals"), F.min("_drop").alias("least_drop"), F.median("_drop").alias("median_drop"))
    all_fell = F.col("least_drop") >= every
    state = F.when(F.col("signals") < signals, "unavailable").when(all_fell & (F.col("median_drop") >= unassured), "unassured").when(all_fell & (F.col("median_drop") >= inconsistent), "inconsistent").otherwise("assured")
    return found.withColumn("state", state)


def alarms(rows: DataFrame, key: str, time: str, valid: Column, bad: Column, onset_s: float, clear_s: float, gap_s: float, tie: str = "seq") -> DataFrame:
    """rows with alarm: set or cleared once its condition lasted without an unknown row or a longer gap; kept through unknown rows.

    Repeats of a time keep the first row's result. The last confirmed condition decides, so windows say all."""
    w = ordered(key, time, tie)
    want = F.when(valid, bad.cast("int"))
    marked = rows.withColumn("_want", want).withColumn("_again", F.col(time).eqNullSafe(F.lag(time).over(w)))
    first = marked.filter(~F.col("_again"))
    gap = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    cut = F.coalesce(~F.col("_want").eqNullSafe(F.lag("_want").over(w)) | (gap > gap_s), F.lit(True))
    runs = first.withColumn("_cut", cut.cast("int")).withColumn("_run", F.sum("_cut").over(w))
    began = F.min(F.unix_micros(time)).over(Window.partitionBy(key, "_run"))
    held = (F.unix_micros(time) - began) / 1e6 >= F.when(F.col("_want") == 1, F.lit(onset_s)).otherwise(F.lit(clear_s))
    sure = runs.withColumn("_sure", F.when(held, F.col("_want")))
    shown = F.coalesce(F.last("_sure", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1
    return sure.withColumn("alarm", shown).drop("_want", "_again", "_cut", "_run", "_sure")


def not_stale(rows: DataFrame, key: str, order: list[str], stamp: str) -> DataFrame:
    """Rows whose stamp is not older than any that was applied before them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(stamp).over(w)
    return rows.withColumn("_newest", newest).filter(F.col("_newest").isNull() | (F.col(stamp) >= F.col("_newest"))).drop("_newest")


def departed_since(rows: DataFrame, key: str, time: str, away: Column, tie: str = "seq") -> DataFrame:
    """Rows that are away, with the time at which the run of such rows began."""
    w = ordered(key, time, tie)
    split = rows.withColumn("_away", F.coalesce(away, F.lit(False))).withColumn("_run", F.sum((~F.col("_away")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return split.filter("_away").withColumn("since", F.min(time).over(Window.partitionBy(key, "_run"))).drop("_away", "_run")


def survey(rows: DataFrame, key: str, time: str, good: Column, gap_s: float, least: int, least_s: float, tie: str = "seq") -> DataFrame:
    """Unbroken runs of good epochs (x, y, z, accuracy, satellites) that are long enough: mean place, dispersion, worst accuracy, fewest satellites."""
    runs = with_segments(rows.filter(good), key, time, gap_s)
    found = runs.groupBy(key, "segment").agg(F.count("*").alias("n"), F.min(time).alias("begins"), F.max(time).alias("ends"), *[F.avg(c).alias(c) for c in "xyz"], F.sqrt(sum(F.var_pop(c) for c in "xyz")).alias("dispersion"), F.max("accuracy").alias("accuracy"), F.min("satellites").alias("satellites"))
    return found.filter((F.col("n") >= least) & ((F.unix_micros("ends") - F.unix_micros("begins")) / 1e6 >= least_s))


def in_session(rows: DataFrame, key: str, kind: str, session: str, order: list[str]) -> DataFrame:
    """Latest row of each key and kind within the key's latest session."""
    latest = F.max_by(session, F.struct(*order)).over(Window.partitionBy(key))
    return rows.withColumn("_s", latest).filter(F.col(session).eqNullSafe(F.col("_s"))).drop("_s").transform(lambda d: newest(d, [key, kind], order))


def newest(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Row of each key that is last by the order columns; partial aggregation, no sort."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(*key, "_best.*")


def quorum(rows: DataFrame, keys: list[str], valid: Column, bad: Column, least: int, least_bad: int, percent: int) -> DataFrame:
    """Modelled and anomalous entries of each key, whether there are enough, and whether too many are bad."""
    counted = rows.groupBy(*keys).agg(F.count_if(valid).alias("modeled"), F.count_if(valid & bad).alias("anomalous"))
    enough = F.col("modeled") >= least
    return counted.withColumn("valid", enough).withColumn("bad", enough & (F.col("anomalous") >= least_bad) & (F.col("anomalous") * 100 >= percent * F.col("modeled")))


def joint_verdict(remote_valid: Column, remote_bad: Column, local_valid: Column, local_bad: Column) -> dict[str, Column]:
    """Joint validity and badness of two assessments of one entry, and their conflict."""
    joint = remote_valid & local_valid
    return {"joint_valid": joint, "joint_bad": joint & remote_bad & local_bad, "conflict": joint & (remote_bad != local_bad)}


def fixed_position(value: Column, accuracy: Column, mean: Column, sigmas: tuple[float, float], inconsistent: tuple[float, float], unassured: tuple[float, float], mean_limits: tuple[float, float]) -> Column:
    """Worse of an instantaneous offset against bands that scale with its accuracy and of a mean offset against plain ones."""
    at_once = grades.graded(value, grades.scaled_limit(accuracy, sigmas[0], *inconsistent), grades.scaled_limit(accuracy, sigmas[1], *unassured))
    over = F.when(mean > mean_limits[1], "unassured").when(mean > mean_limits[0], "inconsistent").otherwise("assured")
    return grades.worst(at_once, over)
