"""Pressure tendencies of stations against those of the stations around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitloom.functions.atmosphere import combined, log_pressure_rate, pressure_height

#: Edge of a group's cube in radii, its time in ages at which samples fall silent, and bits of a table of samples by neighbours.
EDGE, STRETCH, BITS = 4, 4, 1 << 18
FIGURES = ["region_rate", "region_spread", "region_sigma", "max_age", "max_gap"]


def tendencies(rows: DataFrame, window_s: int, skew_s: int) -> DataFrame:
    """rows (station, seq, time, pascal, sigma) that have an older sample nearest to window_s ago, skew_s off at most, with start, start_at,
    rate of the pressure's logarithm and its uncertainty a second. skew_s must be less than window_s; equally near ones: the smaller seq.

    One shuffle by station: the nearest one is the last before that time or the first after it, in two frames of the station's rows."""
    us, wide, skew = F.unix_micros("time"), window_s * 1_000_000, skew_s * 1_000_000
    by = Window.partitionBy("station").orderBy("_us")
    sample = [F.col("seq").alias("start"), F.col("time").alias("start_at"), F.col("pascal").alias("p"), F.col("sigma").alias("s")]
    known = rows.filter("station is not null and time is not null").withColumn("_us", us)
    old = F.min(F.struct((-F.col("_us")).alias("d"), *sample)).over(by.rangeBetween(-wide - skew, -wide))
    young = F.min(F.struct(F.col("_us").alias("d"), *sample)).over(by.rangeBetween(-wide, -wide + skew))
    aim = F.col("_us") - wide
    off = lambda side, d: F.struct(d.alias("d"), *[F.col(f"{side}.{c}").alias(c) for c in ("start", "start_at", "p", "s")])
    sides = known.withColumns({"_old": old, "_young": young}).withColumns({"_old": F.when(F.col("_old").isNotNull(), off("_old", aim + F.col("_old.d"))), "_young": F.when(F.col("_young").isNotNull(), off("_young", F.col("_young.d") - aim))})
    best = sides.withColumn("_best", F.least("_old", "_young")).select(*rows.columns, "_best.start", "_best.start_at", "_best.p", "_best.s")
    span = (F.unix_micros("time") - F.unix_micros("start_at")) / 1e6
    rated = best.withColumn("rate", log_pressure_rate(F.col("p"), F.col("pascal"), span)).filter("rate is not null")
    return rated.withColumn("rate_sigma", combined(F.col("s") / F.col("p"), F.col("sigma") / F.col("pascal")) / span).drop("p", "s")


def regional(rows: DataFrame, places: DataFrame, window_s: int, skew_s: int, radius: float, max_age_s: float, least: int) -> DataFrame:
    """Each sample with a tendency (station, seq, time, pascal, sigma, start, start_at, rate, rate_sigma) beside what its neighbours say: neighbours,
    region_rate (median), region_spread, region_sigma, max_age, max_gap; null figures and a reason with fewer than least of them.

    A neighbour counts with its newest sample up to then, if that is young enough, has a tendency, and the tendency began about when this one
    did. So a sample speaks from its time until its station's next one, max_age_s at most: samples go to the cubes of EDGE radii that they reach and to the
    stretches of STRETCH times max_age_s that they speak in, some three copies of each. A cube's task counts for its own samples in tables of
    bits, so no pair is shuffled, sorted or kept; the pairs it looks at grow with the density of speaking stations, as the medians demand."""
    after = F.lead("time").over(Window.partitionBy("station").orderBy(F.unix_micros("time"), "seq"))
    own = tendencies(rows.withColumn("_until", after), window_s, skew_s)
    most = int(max_age_s * 1_000_000)
    us, last = F.unix_micros("time"), F.unix_micros("time") + most
    stretch = lambda v: F.floor(v / F.lit(STRETCH * most))
    cube = lambda v: F.floor(v / (EDGE * radius) + 0.5)  # noqa: E731  flat tables lie in the middle of theirs
    until = F.least(last + 1, F.coalesce(F.unix_micros("_until"), last + 1))  # the next sample of the same time or a later one takes over
    placed = own.join(places.select("station", *[F.col(c).cast("double").alias(f"_{c}") for c in "xyz"]), "station")
    kept = [c for c in own.columns if c not in ("time", "start_at", "_until")]
    copies = placed.withColumns({"_at": us, "_end": until, "_began": F.unix_micros("start_at"), "_home": F.lit(True)}).drop("time", "start_at", "_until")
    for c in "xyz":
        reach = radius * (1 + 1e-9)
        copies = copies.withColumn(f"_c{c}", F.explode_outer(F.sequence(cube(F.col(f"_{c}") - reach), cube(F.col(f"_{c}") + reach)))).withColumn("_home", F.col("_home") & F.col(f"_c{c}").eqNullSafe(cube(F.col(f"_{c}"))))
    copies = copies.withColumn("_when", F.explode(F.sequence(stretch(F.col("_at")), stretch(F.greatest(F.col("_at"), F.col("_end") - 1))))).withColumn("_home", F.col("_home") & (F.col("_when") == stretch(F.col("_at"))))
    heard = ["station", "rate", "rate_sigma"]
    sent = copies.filter("_home or _at < _end").withColumns({c: F.when(F.col("_home"), F.col(c)) for c in kept if c not in heard})
    types = dict(own.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["_at long, _began long, neighbours long, region_rate double, region_spread double, region_sigma double, max_age double, max_gap double"])
    keys, tasks = ["_cx", "_cy", "_cz", "_when"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: tasks stay apart
    found = sent.repartition(tasks, *keys).groupBy(*keys).applyInArrow(lambda group: _region(group, kept, radius, most, least), schema)
    timed = found.withColumns({"time": F.timestamp_micros("_at"), "start_at": F.timestamp_micros("_began")})
    return timed.select(*[c for c in own.columns if c != "_until"], "neighbours", *FIGURES, F.when(F.col("neighbours") < least, "insufficient_neighbours").alias("reason"))


def _region(group: pa.Table, kept: list[str], radius: float, most: int, least: int) -> pa.Table:
    """Samples at home in a cube and stretch (kept, _at, _began) with the figures of their neighbours. Those that speak are sorted by their rates, so that the
    set bits of a sample's row are its neighbours in this order: least, median and largest rate are picked, not searched."""
    number = lambda c: group.column(c).to_numpy()
    at, end, began, rate, home = number("_at"), number("_end"), number("_began"), number("rate"), group.column("_home").to_numpy(zero_copy_only=False)
    sigma = pc.fill_null(group.column("rate_sigma"), -np.inf).to_numpy()  # null counts for nothing
    name = pc.rank(group.column("station").combine_chunks(), tiebreaker="dense").to_numpy()
    place, spot = np.unique(np.stack([number(f"_{c}").astype(np.float64) for c in "xyz"], axis=1), axis=0, return_inverse=True)
    spot = spot.ravel()
    speak = np.flatnonzero(at < end)
    speak = speak[np.argsort(rate[speak], kind="stable")]
    mine = np.flatnonzero(home)
    mine = mine[np.lexsort((at[mine], spot[mine]))]
    when = at[mine]
    # comparisons of times are comparisons of their ranks, which are half as wide
    orders = [np.sort(v[speak]) for v in (at, end, began)]
    ranks = [np.searchsorted(o, v[speak]).astype(np.int32) for o, v in zip(orders, (at, end, began), strict=True)]
    marks = [np.searchsorted(o, v, side=side).astype(np.int32)[:, None] for o, v, side in ((orders[0], when, "right"), (orders[1], when, "right"), (orders[2], began[mine] - most, "left"), (orders[2], began[mine] + most, "right"))]
    theirs = (*ranks, name[speak].astype(np.int32), rate[speak], sigma[speak], at[speak])
    my_name, their_spot = name[mine].astype(np.int32)[:, None], spot[speak]
    n, figures = np.zeros(len(mine), np.int64), np.full((len(FIGURES), len(mine)), np.nan)
    edges = np.flatnonzero(np.r_[True, np.diff(spot[mine]) != 0, True]) if len(mine) else np.zeros(1, np.int64)
    for first, past in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        d = place - place[spot[mine[first]]]
        gaps = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        near = np.flatnonzero((gaps <= radius)[their_spot])
        near_at, near_end, near_began, near_name, near_rate, near_sigma, near_time = (v[near] for v in theirs)
        near_gap = gaps[their_spot[near]]
        while first < past:
            few = (past - first) * len(near) <= BITS // 4
            stop = past if few else first + int(np.searchsorted(when[first:past], when[first] + most, side="right"))
            some = np.flatnonzero((near_at < marks[0][stop - 1]) & (near_end >= marks[1][first]))
            width = len(some)
            stop = min(stop, first + max(1, BITS // max(1, width)))
            rows, start = slice(first, stop), near_began[some]
            bits = near_at[some] < marks[0][rows]
            bits &= near_end[some] >= marks[1][rows]
            bits &= start >= marks[2][rows]
            bits &= start < marks[3][rows]
            bits &= near_name[some] != my_name[rows]
            flat = np.flatnonzero(bits)
            heads = np.searchsorted(flat, np.arange(stop - first + 1) * width)
            count = np.diff(heads)
            n[rows] = count
            full = np.flatnonzero(count)
            if len(full):
                size, heads = count[full], heads[full]
                pair = some[flat - np.repeat(full * width, size)]
                sorted_rate = near_rate[pair]
                middle, last = heads + size // 2, sorted_rate[heads + size - 1]
                middle = np.where(size % 2 == 1, sorted_rate[middle], 0.5 * sorted_rate[heads + (size - 1) // 2] + 0.5 * sorted_rate[middle])
                age = (when[first + full] - np.minimum.reduceat(near_time[pair], heads)) / 1e6
                figures[:, first + full] = middle, np.maximum(last - middle, middle - sorted_rate[heads]), np.maximum.reduceat(near_sigma[pair], heads), age, np.maximum.reduceat(near_gap[pair], heads)
            first = stop
    lacks = (n < least) | (n == 0)
    lists = [pa.array(v, mask=lacks | (v == -np.inf)) for v in figures]
    own = group.take(pa.array(mine))
    return pa.table([*[own.column(c) for c in (*kept, "_at", "_began")], pa.array(n), *lists], [*kept, "_at", "_began", "neighbours", *FIGURES])


def departures(context: DataFrame, kelvin: Column, max_spread_m: float, inconsistent_m: float, unassured_m: float) -> DataFrame:
    """context (of regional) with delta_m, the height that the pressure's own change stands for, spread_m, sigma_m and state: limits rise to three
    and six times the combined uncertainty; a region that disagrees with itself, or is missing, says nothing."""
    span = (F.unix_micros("time") - F.unix_micros("start_at")) / 1e6
    scale = F.abs(pressure_height(F.lit(1.0), kelvin))
    sized = context.withColumns({
        "delta_m": pressure_height((F.col("rate") - F.col("region_rate")) * span, kelvin), "spread_m": scale * F.col("region_spread") * span, "sigma_m": scale * combined(F.col("rate_sigma"), F.col("region_sigma")) * span,
    })
    off = combined(F.col("sigma_m"), F.col("spread_m"))
    low = F.greatest(F.lit(float(inconsistent_m)), 3 * off)
    high = F.greatest(F.lit(float(unassured_m)), 6 * off, low)
    size = F.abs("delta_m")
    incoherent = F.col("spread_m") > max_spread_m
    state = F.when(F.col("reason").isNotNull() | incoherent, "unavailable").when(size >= high, "unassured").when(size >= low, "inconsistent").otherwise("assured")
    why = F.coalesce(F.col("reason"), F.when(incoherent, "region_incoherent").when(size >= low, "pressure_departure"))
    return sized.withColumns({"state": state, "reason": why})
