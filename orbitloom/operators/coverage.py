"""Which cells of the earth see which satellites, and how well they are witnessed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def visible_cells(satellites: DataFrame, radius: Column, mask_deg: float, step: int) -> DataFrame:
    """satellites (lat, lon below them, in degrees) with each cell centre (cell_lat, cell_lon) that sees them above the mask, on a round earth.

    Each satellite makes only the rows of cells inside its cap, so no cross join: latitudes within the cap's angle, then
    longitudes whose angle is small enough."""
    mask = math.radians(mask_deg)
    cap = F.acos(F.lit(EARTH_M * math.cos(mask)) / radius) - mask  # angle at the earth's centre
    lats = F.transform(F.sequence(F.lit(0), F.lit(180 // step - 1)), lambda i: i * step - 90 + step / 2)
    lons = F.transform(F.sequence(F.lit(0), F.lit(360 // step - 1)), lambda i: i * step - 180 + step / 2)
    rows = satellites.withColumn("_cap", cap).withColumn("cell_lat", F.explode(F.filter(lats, lambda a: F.abs(F.radians(a - F.col("lat"))) <= F.col("_cap"))))
    sin = F.sin(F.radians("lat")) * F.sin(F.radians("cell_lat"))
    cos = F.cos(F.radians("lat")) * F.cos(F.radians("cell_lat"))
    return rows.withColumns({"_s": sin, "_c": cos}).withColumn("cell_lon", F.explode(F.filter(lons, lambda b: F.col("_s") + F.col("_c") * F.cos(F.radians(b - F.col("lon"))) >= F.cos("_cap")))).drop("_cap", "_s", "_c")


def cell_status(seen: DataFrame, cells: DataFrame, witnesses: Column, target: int, partial: float = 0.5, good: float = 0.8) -> DataFrame:
    """cells (cell_lat, cell_lon) with expected, missing and thin satellites and gap, thin, unknown (none above) or covered."""
    counted = seen.groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("expected"), F.count_if(witnesses == 0).alias("missing"), F.count_if((witnesses > 0) & (witnesses < target)).alias("thin"))
    known = cells.join(counted, ["cell_lat", "cell_lon"], "left").fillna(0, ["expected", "missing", "thin"])
    observed = F.col("expected") - F.col("missing")
    status = F.when(F.col("expected") == 0, "unknown").when(observed / F.col("expected") < partial, "gap").when((observed - F.col("thin")) / F.col("expected") < good, "thin").otherwise("covered")
    return known.withColumn("status", status)


def area_shares(cells: DataFrame) -> DataFrame:
    """Percent of the earth's area by status."""
    w = F.sum(F.cos(F.radians("cell_lat")))
    each = cells.groupBy("status").agg(w.alias("_w"), F.count("*").alias("cells"))
    whole = each.agg(F.sum("_w").alias("_all"))
    return each.join(F.broadcast(whole)).select("status", "cells", (100 * F.col("_w") / F.col("_all")).alias("percent"))  # one row, at most four statuses
