"""Fits of signal levels over elevation, for all satellites of a snapshot and for each constellation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SBAS = 1  # fixed value: the constellation whose satellites stand still


def fits(rows: DataFrame, keys: list[str], gnss: str, x: str, y: str) -> DataFrame:
    """Mean of y, population variance of the residual from its line over x (from the mean, where x is flat) and number of satellites:
    one row for all satellites of the keys (whole) and one for each constellation but SBAS. One pass; sums only are shuffled."""
    sums = rows.groupingSets([tuple(keys), (*keys, gnss)], *keys, gnss).agg(
        (F.grouping(gnss) == 1).alias("whole"), F.count(y).alias("sats"), F.avg(y).alias("mean"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    rest = F.when(F.col("sxx") > 1e-9, F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).otherwise(F.col("syy"))
    return sums.filter(F.col("whole") | (F.col(gnss) != SBAS)).select(*keys, gnss, "whole", "sats", "mean", (rest / F.nullif(F.col("sats"), F.lit(0))).alias("residual"))


def uniformity(rows: DataFrame, keys: list[str], gnss: str, x: str, y: str, least: int = 5, residual_below: float = 2.0, mean_above: float = 45.0) -> DataFrame:
    """One row per keys: unassured if the fit over all satellites or over one constellation is strong and too even, unavailable where
    no fit has enough satellites; with the whole fit and the lowest constellation that tripped."""
    each = fits(rows, keys, gnss, x, y).withColumn("_enough", F.col("sats") >= least)
    tripped = F.col("_enough") & (F.col("residual") < residual_below) & (F.col("mean") > mean_above)
    whole = lambda c: F.max(F.when(F.col("whole"), F.col(c)))
    found = each.withColumn("_trips", tripped).groupBy(*keys).agg(
        whole("sats").alias("sats"), whole("mean").alias("mean"), whole("residual").alias("residual"), F.min(F.when(F.col("_trips") & ~F.col("whole"), F.col(gnss))).alias("tripped_gnss"),
        F.max("_trips").alias("_trips"), F.max("_enough").alias("_enough"))
    state = F.when(~F.col("_enough"), "unavailable").when(F.col("_trips"), "unassured").otherwise("assured")
    return found.withColumn("state", state).withColumn("reason", F.when(~F.col("_enough"), "too_few_satellites").when(F.col("_trips"), "uniform_cn0")).drop("_trips", "_enough")
