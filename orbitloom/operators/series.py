"""Windows over ordered histories: islands, segments, M of N, flatlines, compaction, watermarks, regressions, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: str, *by: str):
    return Window.partitionBy(key).orderBy(*by)


def with_segments(rows: DataFrame, key: str, time: str, gap_s: float, *breaks: Column, tie: str = "seq") -> DataFrame:
    """rows with a segment number, raised where the gap to the row before is over gap_s or a break holds."""
    w = ordered(key, time, tie)
    late = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6 > gap_s
    cut = late
    for b in breaks:
        cut = cut | b
    return rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("segment", F.sum("_cut").over(w)).drop("_cut")


def segments(rows: DataFrame, key: str, time: str, value: str, gap_s: float) -> DataFrame:
    """One row per segment: begin, end, number and mean of the values."""
    return with_segments(rows, key, time, gap_s).groupBy(key, "segment").agg(F.min(time).alias("begins"), F.max(time).alias("ends"), F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def m_of_n(rows: DataFrame, key: str, time: str, bad: Column, available: Column, m: int = 3, n: int = 4, tie: str = "seq") -> DataFrame:
    """rows with verdict: 'candidate' if at least m of the last n available ones are bad, 'clear', or 'warming' below m; an
    unavailable row clears the window ('unavailable')."""
    w = ordered(key, time, tie)
    marked = rows.withColumns({"_ok": available, "_bad": bad}).withColumn("_island", F.sum((~F.col("_ok")).cast("int")).over(w))
    inside = Window.partitionBy(key, "_island", "_ok").orderBy(time, tie).rowsBetween(-(n - 1), 0)
    counted = marked.withColumns({"_n": F.count("*").over(inside), "_bads": F.sum(F.col("_bad").cast("int")).over(inside)})
    verdict = F.when(~F.col("_ok"), "unavailable").when(F.col("_n") < m, "warming").when(F.col("_bads") >= m, "candidate").otherwise("clear")
    return counted.withColumn("verdict", verdict).drop("_ok", "_bad", "_island", "_n", "_bads")


def runs(rows: DataFrame, key: str, time: str, value: str, tie: str = "seq") -> DataFrame:
    """Runs of an unchanged value: begin, end, number."""
    w = ordered(key, time, tie)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | F.lag(tie).over(w).isNull()
    islands = rows.withColumn("_new", changed.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return islands.groupBy(key, "_run", value).agg(F.min(time).alias("begins"), F.max(time).alias("ends"), F.count("*").alias("n")).drop("_run")


def flatlines(rows: DataFrame, key: str, time: str, value: str, least: int, seconds: float) -> DataFrame:
    """Runs of one value over at least so many reports and seconds."""
    return runs(rows, key, time, value).filter((F.col("n") >= least) & ((F.unix_micros("ends") - F.unix_micros("begins")) / 1e6 >= seconds))


def compacted(rows: DataFrame, key: str, time: str, state: str, tie: str = "seq") -> DataFrame:
    """Only rows whose state differs from the row before, with that state."""
    w = ordered(key, time, tie)
    return rows.withColumn("before", F.lag(state).over(w)).filter(~F.col(state).eqNullSafe(F.col("before")))


def watermark(receipts: DataFrame, key: list[str], seq: str, resolved: str) -> DataFrame:
    """Highest sequence below the first unresolved one of each key."""
    return receipts.groupBy(*key).agg(F.coalesce(F.min(F.when(~F.col(resolved), F.col(seq))) - 1, F.max(seq)).alias("watermark"), F.count("*").alias("received"))


def regression(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Residual variance of y over x for each prefix set of keys (all of them, all but the last), flat x falling back to the mean model."""
    return rows.groupingSets([tuple(keys), tuple(keys[:-1])], *keys).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")).filter(F.col("n") >= least).select(
        *keys, "n", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("sxx") > 1e-9, (F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / F.col("n")).otherwise(F.col("syy") / F.col("n")), 4).alias("residual")
    )


def nearest_rank(rows: DataFrame, key: str, value: str, percents: list[int], shares: list[float] | None = None) -> DataFrame:
    """Nearest-rank percentiles (rank = floor(n * p / 100 + 0.5), from 1 to n) and the largest value; with shares, also how many values are
    absent (null, not counted in n) and which percent of n reaches each of the limits.

    Rows are counted per value before any sort, so a window sees each distinct value of a key once."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    there = F.when(F.col(value).isNotNull(), F.col("_c")).otherwise(0)
    order = Window.partitionBy(key).orderBy(F.asc_nulls_first(value))
    ranked = counted.withColumn("_r", F.sum(there).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum(there).over(Window.partitionBy(key)))
    at = {p: F.least(F.greatest(F.floor(F.col("_n") * p / 100 + 0.5), F.lit(1)), F.col("_n")) for p in percents}
    inside = lambda p: (F.col("_r") >= at[p]) & (F.col("_r") - there < at[p])
    more = [] if shares is None else [F.sum(F.when(F.col(value).isNull(), F.col("_c")).otherwise(0)).alias("absent")]
    more += [F.round(100 * F.sum(F.when(F.col(value) >= s, F.col("_c")).otherwise(0)) / F.nullif(F.sum(there), F.lit(0)), 6).alias(f"share{i}") for i, s in enumerate(shares or [], 1)]
    return ranked.groupBy(key).agg(F.sum(there).alias("n"), *[F.round(F.max(F.when(inside(p), F.col(value))), 6).alias(f"p{p}") for p in percents], F.round(F.max(value), 6).alias("largest"), *more)


def minute_medians(rows: DataFrame, key: str, time: str, value: str, least: int, most: int) -> DataFrame:
    """Median of each minute that has between least and most samples."""
    return rows.groupBy(key, F.date_trunc("minute", time).alias("minute")).agg(F.round(F.median(value), 6).alias("median"), F.count("*").alias("n")).filter(F.col("n").between(least, most))
