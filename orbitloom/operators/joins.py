"""As-of, nearest, interval, band and radius joins as equi joins on buckets, and set differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a cube that one group counts for.
OWN = 4096


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, payload: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (of equal times that with the largest tie, the first
    column of payload by default): one union, one shuffle, one running last value of the whole right row."""
    other = right.select(key, time, F.struct(*[F.col(c).alias(c) for c in payload], F.col(time).alias("_at")).alias("_right"), F.col(tie or payload[0]).alias("_tie")).withColumn("_side", F.lit(0))
    both = left.withColumn("_side", F.lit(1)).unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col(time), F.col("_side"), F.col("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_right", F.last("_right", ignorenulls=True).over(order))
    return filled.filter("_side = 1").select(*left.columns, *[F.col(f"_right.{c}").alias(f"asof_{c}") for c in payload], F.col("_right._at").alias("asof_time"))


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, before: int, after: int) -> DataFrame:
    """Pairs of one key with right_time in [left_time - before, left_time + after] seconds: time buckets as wide as the window
    make it an equi join, each left row going to the two or so buckets that its window touches."""
    width = before + after
    lo = F.floor((F.unix_micros(left_time) / 1e6 - before) / width)
    hi = F.floor((F.unix_micros(left_time) / 1e6 + after) / width)
    spread = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    other = right.withColumn("_bucket", F.floor(F.unix_micros(right_time) / 1e6 / width))
    apart = F.unix_micros(right_time) - F.unix_micros(left_time)
    return spread.join(other, [key, "_bucket"]).filter((apart >= -before * 1_000_000) & (apart <= after * 1_000_000)).drop("_bucket")


def evidence(triggers: DataFrame, samples: DataFrame, key: str, before: int, after: int, keep: int) -> DataFrame:
    """Newest samples of each trigger's window, at most keep (the feature), with a flag that there were more.

    triggers: (trigger, key, at); samples: (key, sample, sample_at)."""
    pairs = within(triggers, samples, key, "at", "sample_at", before, after)
    newest = F.row_number().over(Window.partitionBy("trigger").orderBy(F.desc("sample_at"), F.desc("sample")))
    ranked = pairs.withColumn("rank", newest).filter(F.col("rank") <= keep + 1)
    found = ranked.groupBy("trigger").agg(F.count_if(F.col("rank") <= keep).alias("samples"), F.max(F.col("rank") > keep).alias("truncated"), F.min(F.when(F.col("rank") <= keep, F.col("sample"))).alias("oldest_sample"))
    return triggers.join(found, "trigger", "left").select("trigger", key, F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("truncated", F.lit(False)).alias("truncated"), "oldest_sample")


def nearest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within_s: int, payload: list[str], tie: str) -> DataFrame:
    """The right row of the key nearest in time within a tolerance; of equally near ones that with the smaller tie column.

    Equal left rows each give one: they go through the join once, with their number."""
    counted = left.groupBy(*left.columns).agg(F.count("*").alias("_times"))
    pairs = within(counted, right, key, left_time, right_time, within_s, within_s)
    distance = F.abs(F.unix_micros(left_time) - F.unix_micros(right_time))
    best = pairs.groupBy(*left.columns, "_times").agg(F.min_by(F.struct(*payload, right_time), F.struct(distance.alias("d"), F.col(tie))).alias("n"))
    return best.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*left.columns, "n.*")


def neighbours(points: DataFrame, radius: float, keep: int) -> DataFrame:
    """Of each point (id, x, y, z): how many others lie within the radius, and the nearest keep of them (the feature).

    Points go to cubes as wide as the radius and to the 26 around; each cube counts for its own points in its task, so no pair
    is shuffled or sorted, only 27 copies of the points and one row of a point. The points of a full cube are dealt to several
    groups of about OWN, which hold its surroundings each."""
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    cells = ["cx", "cy", "cz"]
    homes = points.filter("id is not null and x is not null and y is not null and z is not null").select("id", "x", "y", "z", *cell)
    parts = homes.groupBy(*cells).agg(F.ceil(F.count("*") / OWN).cast("int").alias("parts"))
    own = homes.join(parts, cells).withColumn("part", F.pmod(F.xxhash64("id", "x", "y", "z"), "parts").cast("int")).drop("parts").withColumn("own", F.lit(True))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    moved = homes
    for c in cells:
        moved = moved.withColumn("_step", F.explode(steps)).withColumn(c, F.col(c) + F.col("_step")).drop("_step")
    around = moved.join(parts, cells).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("own", F.lit(False))
    kind = dict(points.dtypes)["id"]
    found = own.unionByName(around).groupBy(*cells, "part").applyInArrow(lambda group: _nearest(group, radius, keep), f"a {kind}, n long, gaps array<double>, ids array<{kind}>")
    # rows of one id count together, wherever they lie
    merged = found.groupBy("a").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("gaps", "ids")))).alias("near"))
    return merged.select("a", "n", F.round(F.col("near")[0]["gaps"], 6).alias("nearest_gap"), F.array_join(F.slice("near", 1, keep).getField("ids").cast("array<string>"), ",").alias("named"))


def _nearest(group: pa.Table, radius: float, keep: int) -> pa.Table:
    """Of each own point of a cube: how many of those around are within the radius, and gaps and ids of the nearest."""
    ids, mine = group.column("id").combine_chunks(), group.column("own").to_numpy(zero_copy_only=False)
    kinds = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    place = np.stack([group.column(c).to_numpy() for c in "xyz"])
    left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
    right = right[np.argsort(kinds[right], kind="stable")]  # of equal gaps the smaller id comes first
    at, n, gaps, near = [], [], [], []
    around, others = place[:, right], kinds[right]
    for i in left.tolist():
        d = place[:, i, None] - around
        gap = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        inside = np.flatnonzero((gap <= radius) & (others != kinds[i]))
        if not len(inside):
            continue
        best = inside
        if len(inside) > keep:
            best = inside[gap[inside] <= np.partition(gap[inside], keep - 1)[keep - 1]]
        best = best[np.argsort(gap[best], kind="stable")][:keep]
        at.append(i)
        n.append(len(inside))
        gaps.append(gap[best])
        near.append(right[best])
    cuts = pa.array(np.cumsum([0, *map(len, near)]), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(np.concatenate([np.zeros(0), *gaps])), ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *near]))))]
    return pa.table([ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], ["a", "n", "gaps", "ids"])


def band_pairs(rows: DataFrame, key: list[str], at: str, tolerance: Column | float, label: str, payload: str) -> DataFrame:
    """Pairs of rows with the same key, different labels (first smaller) and at no further apart than the tolerance."""
    a = rows.select(*key, F.col(at).alias("at_a"), F.col(label).alias("label_a"), F.col(payload).alias("payload_a"), F.explode(F.sequence(F.floor(F.col(at) / tolerance) - 1, F.floor(F.col(at) / tolerance) + 1)).alias("_bucket"))
    b = rows.select(*key, F.col(at).alias("at_b"), F.col(label).alias("label_b"), F.col(payload).alias("payload_b"), F.floor(F.col(at) / tolerance).alias("_bucket"))
    return a.join(b, [*key, "_bucket"]).filter((F.col("label_a") < F.col("label_b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= tolerance)).drop("_bucket")


def difference(observed: DataFrame, declared: DataFrame, key: str, item: str) -> DataFrame:
    """Of each key: items observed but not declared, and declared but not observed, sorted; keys of either side."""
    o, d = observed.select(key, item).distinct().withColumn("seen", F.lit(True)), declared.select(key, item).distinct().withColumn("said", F.lit(True))
    both = o.join(d, [key, item], "full_outer")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(item)))), ",")
    return both.groupBy(key).agg(listed(F.col("said").isNull()).alias("unexpected"), listed(F.col("seen").isNull()).alias("missing"))
