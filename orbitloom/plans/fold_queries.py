"""Queries over the folds, each with SQL that steps the same rule row by row.

`events` plays the stations' inputs: rows lie hours apart, so limits that the survey gives in seconds or minutes are days here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.operators import folds
from orbitloom.plans.registry import observations, registry

QUERIES, SQL, query = registry()
_DAY = 86400
#: Rows of a key in their order, for SQL that steps through them.
_STEPS = "row_number() over (partition by grp order by tm, seq) as i"


def _stations(spark: SparkSession, sf_dir: str, groups: int = 25) -> DataFrame:
    return observations(spark, sf_dir).withColumns({"grp": F.col("station") % groups, "at": F.unix_micros("time")})


@query(f"""with recursive $OBS, r as (select *, {_STEPS} from (select station % 25 as grp, epoch_us(time) as tm, seq, cast(floor(value * 100) as bigint) as agc from obs)),
 f as (select grp, seq, i, agc, null::double as baseline, null::bigint as moved, null::bigint as above, tm as start, [agc] as now, []::struct(s bigint, m double)[] as minutes from r where i = 1
 union all
 select grp, seq, i, agc, baseline6, moved6, above3, start5, case when learns and len(now5) < 600 then list_append(now5, agc) else now5 end, minutes5 from
 (select *, case when closes and len(minutes5) > 0 then case when baseline3 is not null then baseline3 + greatest(-drift, least(drift, aim - baseline3)) when len(minutes5) >= 3 then aim end else baseline3 end as baseline6,
   case when closes and len(minutes5) > 0 and (baseline3 is not null or len(minutes5) >= 3) then tm else moved3 end as moved6 from
 (select *, list_median([x.m for x in minutes5]) as aim, 2.0 * (tm - moved3) / 3600000000 as drift from
 (select *, case when closes then [x for x in case when len(now3) >= 2 then list_append(minutes3, {{'s': start4, 'm': list_median(now3)}}) else minutes3 end if tm - x.s <= 604800000000] else minutes3 end as minutes5,
   case when closes then [] else now3 end as now5, case when closes then tm else start4 end as start5 from
 (select *, learns and tm - start4 >= 86400000000 as closes from
 (select *, case when learns then coalesce(case when not anew then start end, tm) else start end as start4, case when anew then null else baseline end as baseline3, case when anew then null else moved end as moved3,
   case when anew then null else above2 end as above3, case when anew then []::bigint[] else now end as now3, case when anew then [] else minutes end as minutes3 from
 (select *, case when away < -400 then false when away > 400 then tm - above2 >= 172800000000 else true end as learns, away > 400 and tm - above2 >= 172800000000 as anew from
 (select *, case when away > 400 then coalesce(above, tm) end as above2 from
 (select n.grp, n.seq, n.i, n.tm, n.agc, f.baseline, f.moved, f.above, f.start, f.now, f.minutes, case when f.baseline is null then 0 else n.agc - f.baseline end as away from f join r n on n.grp = f.grp and n.i = f.i + 1)))))))))
 select seq, baseline, baseline - agc as departure from f""")  # fmt: skip
def t2_agc_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet level of each station's gain and the departure from it; what it accepts decides what it learns."""
    rows = _stations(spark, sf_dir).select("grp", "at", "seq", F.floor(F.col("value") * 100).cast("long").alias("agc"))
    step = folds.agc_baseline(least=2, warm_up=3, minute_s=_DAY, window_s=7 * _DAY, drift=2.0, relearn_s=2 * _DAY)
    return folds.folded(rows, ["grp"], ["at", "seq"], ["at", "agc"], step, folds.AGC_OUT).select("seq", "baseline", "departure")


@query("""with recursive $OBS, v as (select sv as grp, sig % 2 as bin, seq, cast(floor(unix / 86164) as bigint) - (case when k % 17 = 0 then 3 else 0 end) as cycle,
   cast(30 + floor(value / 3) + (case when k % 11 = 0 then 20 else 0 end) as bigint) as level from obs),
 r as (select *, row_number() over (partition by grp, bin order by seq) as i from v where level between 1 and 99),
 f as (select grp, bin, seq, i, cycle, level <= 99 and level > 0 as admitted, 0::bigint as support, null::bigint as expected, null::bigint as spread, level as total, 1::bigint as n, []::bigint[] as past from r where i = 1
 union all
 select grp, bin, seq, i, case when stale then had else cycle end, admitted, case when not stale then len(past2) end, case when not stale then expected2 end, case when not stale then spread2 end,
   case when stale then total when admitted then total2 + level else total2 end, case when stale then n when admitted then n2 + 1 else n2 end, case when stale then past else past2 end from
 (select *, not stale and (expected2 is null or abs(level - expected2) < greatest(4 * spread2, 6)) as admitted from
 (select *, case when expected2 is not null then cast(floor(list_median([abs(x - expected2) for x in past2]) + 0.5) as bigint) end as spread2 from
 (select *, case when len(past2) >= 3 then cast(floor(list_median(past2) + 0.5) as bigint) end as expected2 from
 (select *, case when fresh and n > 0 then list_append(past, (total + n // 2) // n)[-8:] else past end as past2, case when fresh then 0 else total end as total2, case when fresh then 0 else n end as n2 from
 (select n.grp, n.bin, n.seq, n.i, n.cycle, n.level, f.cycle as had, n.cycle < f.cycle as stale, n.cycle > f.cycle as fresh, f.total, f.n, f.past from f join r n on n.grp = f.grp and n.bin = f.bin and n.i = f.i + 1))))))
 select seq, admitted, support, expected, spread from f union all select seq, false, null, null, null from v where level not between 1 and 99""")  # fmt: skip
def t6_power_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received levels by cell and cycle, and whether each may train the reference that judges the next cycles."""
    cycle = F.floor(F.col("unix") / 86164).cast("long") - F.when(F.col("k") % 17 == 0, 3).otherwise(0)
    level = (30 + F.floor(F.col("value") / 3) + F.when(F.col("k") % 11 == 0, 20).otherwise(0)).cast("long")
    rows = observations(spark, sf_dir).select("sv", (F.col("sig") % 2).alias("bin"), "seq", cycle.alias("cycle"), level.alias("level"))
    return folds.folded(rows, ["sv", "bin"], ["seq"], ["cycle", "level"], folds.power_cell(), folds.POWER_OUT).select("seq", *folds.POWER_OUT)


_PLACES = "select station % 25 as grp, epoch_us(time) as tm, seq, value * 1000 as x, (k % 7) * 500.0 as y, cast(k as double) as z, 1.0 + k % 5 as accuracy, type <> 'error' as usable, case when station % 25 = 3 then 0.0 else 0.05 end as max_speed from obs"
_BOUND_STEP = """f as (select grp, seg, seq, i, case when max_speed <= 0 then 'unavailable' when not usable then 'unavailable' else 'unavailable' end as state, case when max_speed <= 0 then 'no_max_speed' when not usable then 'no_3d_fix' else 'reference_reset' end as reason,
   case when max_speed > 0 and usable then {'tm': tm, 'x': x, 'y': y, 'z': z, 'a': accuracy} end as ref from r where i = 1
 union all
 select grp, seg, seq, i, state, reason, case when reason = 'reference_reset' or state = 'assured' then {'tm': tm, 'x': x, 'y': y, 'z': z, 'a': accuracy} else ref end from
 (select *, case when reason0 is not null then 'unavailable' when distance > bound then 'unassured' else 'assured' end as state, case when reason0 is not null then reason0 when distance > bound then 'motion_bound' end as reason from
 (select n.*, f.ref, case when n.max_speed <= 0 then 'no_max_speed' when not n.usable then 'no_3d_fix' when f.ref is null or n.tm - f.ref.tm > 259200000000 then 'reference_reset' end as reason0,
   sqrt((n.x - f.ref.x) ** 2 + (n.y - f.ref.y) ** 2 + (n.z - f.ref.z) ** 2) as distance, n.max_speed * ((n.tm - f.ref.tm) / 1000000) + 3 * (n.accuracy + f.ref.a) + 10 as bound
   from f join r n on n.grp = f.grp and n.seg = f.seg and n.i = f.i + 1)))"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _stations(spark, sf_dir).select(
        "grp", "at", "seq", "k", (F.col("value") * 1000).alias("x"), ((k % 7) * 500.0).alias("y"), k.cast("double").alias("z"), (1.0 + k % 5).alias("accuracy"), (F.col("type") != "error").alias("usable"),
        F.when(F.col("grp") == 3, 0.0).otherwise(0.05).alias("max_speed"),
    )


_PLACE_READS = ["at", "x", "y", "z", "accuracy", "usable", "max_speed"]


@query(f"with recursive $OBS, r as (select *, 0 as seg, {_STEPS} from ({_PLACES})), {_BOUND_STEP} select seq, state, reason from f")
def t8_motion_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs against what the station can have travelled since the last accepted one."""
    return folds.folded(_places(spark, sf_dir), ["grp"], ["at", "seq"], _PLACE_READS, folds.motion_bound(3 * _DAY), folds.BOUND_OUT).select("seq", "state", "reason")


_LIVES = f"""l as (select *, sum((why is not null)::int) over (partition by grp order by tm, seq) as seg from (select *, case when k % 41 = 0 then 'relocation' when up < lag(up) over w then 'restart' when tm - lag(tm) over w > 86400000000 then 'gap' end as why from
 (select p.*, o.k, (epoch_us(o.time) // 1000000) % 432000 as up from ({_PLACES}) p join obs o using (seq)) window w as (partition by grp order by tm, seq)))"""


@query(f"with recursive $OBS, {_LIVES}, r as (select *, row_number() over (partition by grp, seg order by tm, seq) as i from l), {_BOUND_STEP}, "
       "b as (select grp, seg, arg_min(why, (tm, seq)) as began from l group by all), s as (select f.grp, f.seg, arg_max(f.state, (l.tm, l.seq)) as state, max(l.tm) as until, count(*) as n from f join l using (seq) group by all) "
       "select * from (select s.grp, s.seg as segment, state, until, n, lead(began) over (partition by s.grp order by s.seg) as ended_by from s join b on b.grp = s.grp and b.seg = s.seg) where ended_by is not null")  # fmt: skip
def t11_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of stations (gap, restart, relocation): the motion bound starts anew in each, and its last verdict is kept when the segment ends."""
    up = F.floor(F.col("at") / 1_000_000) % 432000
    rows = _places(spark, sf_dir).withColumns({"since_start": up.cast("long"), "relocated": F.col("k") % 41 == 0})
    lived = folds.lifecycle(rows, "grp", ["at", "seq"], _DAY)
    checked = folds.folded(lived, ["grp", "segment"], ["at", "seq"], _PLACE_READS, folds.motion_bound(3 * _DAY), folds.BOUND_OUT)
    return folds.snapshots(checked, "grp", ["at", "seq"]).select("grp", "segment", "state", "until", "n", "ended_by")


@query(f"""with recursive $OBS, r as (select *, {_STEPS} from (select station % 25 as grp, seq as tm, seq, ((epoch_us(time) // 1000) - (case when k % 13 = 0 then 30000000 when k % 19 = 0 then 300000000 else 0 end)) % 604800000 as tow from obs)),
 f as (select grp, seq, i, tow as last, 0::bigint as clock, 0::bigint as segment, true as accepted, 'start' as event from r where i = 1
 union all
 select grp, seq, i, case when accepted then tow else last end, case when accepted and d > 0 then clock + d else clock end, case when event in ('gap', 'time_reset') then segment + 1 else segment end, accepted, event from
 (select *, not (d <= 0 and d >= -50000000) as accepted, case when d = 0 then 'repeat' when d < 0 and d >= -50000000 then 'reordered' when d < 0 then 'time_reset' when d > 50000000 then 'gap' end as event from
 (select *, case when raw > 302400000 then raw - 604800000 when raw < -302400000 then raw + 604800000 else raw end as d from
 (select n.grp, n.seq, n.i, n.tow, f.last, f.clock, f.segment, n.tow - f.last as raw from f join r n on n.grp = f.grp and n.i = f.i + 1))))
 select seq, accepted, case when accepted then clock end as clock, case when accepted then segment end as segment, event from f""")  # fmt: skip
def w23_epoch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs in the order of receipt on a clock that wraps each week, with late and repeated ones and resets."""
    tow = (F.floor(F.unix_micros("time") / 1000).cast("long") - F.when(F.col("k") % 13 == 0, 30_000_000).when(F.col("k") % 19 == 0, 300_000_000).otherwise(0)) % 604_800_000
    rows = observations(spark, sf_dir).select((F.col("station") % 25).alias("grp"), "seq", tow.alias("tow"))
    return folds.folded(rows, ["grp"], ["seq"], ["tow"], folds.epoch_order(gap_ms=50_000_000), folds.EPOCH_OUT).select("seq", *folds.EPOCH_OUT)


@query("""with recursive $OBS, e as (select station % 25 as grp, type, epoch_us(time) as tm, seq, k % 2 = 0 as stored, epoch_us(min(time) over ()) + 432000000000 as warm from obs),
 s as (select *, row_number() over (partition by grp, type order by tm, seq) as i from e where stored and tm >= warm),
 c as (select grp, type, list({'tm': tm, 'seq': seq} order by tm, seq) as replays from e where not stored group by all),
 f as (select grp, type, 0::bigint as i, null::bigint as stored_seq, null::bigint as replay_seq, replays as unused from c
 union all
 select grp, type, i, seq, took.seq, case when took is null then unused else [x for x in unused if x.seq <> took.seq] end from
 (select n.grp, n.type, n.i, n.seq, f.unused, [x for x in f.unused if abs(x.tm - n.tm) <= 43200000000][1] as took from f join s n on n.grp = f.grp and n.type = f.type and n.i = f.i + 1)),
 m as (select stored_seq, replay_seq from f where replay_seq is not null)
 select 'matched' as outcome, replay_seq, stored_seq from m
 union all select 'missing_in_replay', null, seq from s where seq not in (select stored_seq from m)
 union all select 'missing_in_store', seq, null from e where not stored and tm >= warm and seq not in (select replay_seq from m)""")  # fmt: skip
def j21_compared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed and stored events matched one to one by station and type within half a day, after five days of warm-up."""
    events = _stations(spark, sf_dir).select("grp", "type", "at", "seq", (F.col("k") % 2 == 0).alias("stored"))
    warm = events.agg(F.min("at")).first()[0] + 5 * _DAY * folds.SECOND
    return folds.compared(events.filter(~F.col("stored")), events.filter("stored"), ["grp", "type"], _DAY // 2, warm)


_READINGS = """select station % 25 as grp, epoch_us(time) as tm, seq, case when k % 10 <> 0 then 15 + (value % 12) end as temperature, case when k % 10 <> 1 then 40.0 + (k * 7) % 60 end as humidity,
 case when k % 10 <> 2 then 101000 + (k % 20) * 60.0 end as pressure, type <> 'error' as healthy, k % 23 = 0 as heater from obs"""
_JUDGED = {"temperature": ("3", "6", "3", "8"), "humidity": ("15", "30", "20", "60"), "pressure": ("300", "600", "250", "800")}


def _judges(points: str, reason: str, use: str) -> str:
    """For SQL: the marks of each measure against the median of points."""
    one = "case when {use} and {c} is not null and len([x.{c} for x in {p} if x.{c} is not null]) > 0 then abs({c} - list_median([x.{c} for x in {p} if x.{c} is not null])) end as {c}_{r}"
    return ", ".join(one.format(use=use, c=c, p=points, r=reason) for c in _JUDGED)


def _mark(reason: str, first: int) -> str:
    return ", ".join(f"case when {c}_{reason} >= {v[first + 1]} then 3 when {c}_{reason} >= {v[first]} then 2 else 0 end as {c}_{reason}_m" for c, v in _JUDGED.items())


_MARKS = [f"{c}_{r}_m" for r in ("change", "sustained") for c in _JUDGED]
_RATES = [f"{c}_rate_m" for c in _JUDGED]


@query(f"""with recursive $OBS, r as (select *, {_STEPS} from ({_READINGS})),
 f as (select grp, seq, 0::bigint as i, tm, 'x' as state, 'x' as reasons, false as learned, false as anomalous, []::struct(s bigint, temperature double, humidity double, pressure double)[] as past,
   null::struct(s bigint, temperature double, humidity double, pressure double) as last from r where i = 1
 union all
 select grp, seq, i, tm, case when nothing then 'unavailable' else ['assured', 'unavailable', 'inconsistent', 'unassured'][verdict + 1] end, case when nothing then 'no_value' else reasons end, not nothing and learned,
   case when nothing or not counts then anomalous else not learned end, case when nothing then past0 when learned then list_append([x for x in past if tm - x.s <= 604800000000], now) else past end, case when nothing then last else now end from
 (select *, counts and (verdict = 0 or verdict = 1 and dew = 0) as learned from
 (select *, healthy and not heater as counts, greatest(had, {", ".join(_RATES)}) as verdict, concat_ws(',', case when dew > 0 then 'dew_point_spread' end, {", ".join(f"case when {m} > 0 then '{m[:-2]}' end" for m in _MARKS)},
   case when not ready and not lasting then 'warm_up' end, {", ".join(f"case when {m} > 0 then '{m[:-2]}' end" for m in _RATES)}) as reasons from
 (select *, {_mark("rate", 2)}, case when not ready and not lasting then (case when dew > 0 then dew else 1 end) else greatest(dew, {", ".join(_MARKS)}) end as had from
 (select *, {_mark("change", 0)}, {_mark("sustained", 0)} from
 (select *, {_judges("near", "change", "ready")}, {_judges("far", "sustained", "lasting")},
   {", ".join(f"case when tm - last.s between 3600000000 and 43200000000 then abs({c} - last.{c}) / ((tm - last.s) / 3600000000) end as {c}_rate" for c in _JUDGED)} from
 (select *, len(near) >= 4 and tm - near[1].s >= 86400000000 as ready, len(far) >= 4 as lasting from
 (select *, [x for x in past if tm - x.s <= 259200000000] as near, [x for x in past if tm - x.s >= 345600000000] as far from
 (select *, case when anomalous then past0 else [x for x in past0 if tm - x.s <= 604800000000] end as past, temperature is null and humidity is null and pressure is null as nothing,
   {{'s': tm, 'temperature': temperature, 'humidity': humidity, 'pressure': pressure}} as now,
   case when spread <= 0.5 then 3 when spread <= 2 then 2 else 0 end as dew from
 (select *, temperature - 243.04 * gamma / (17.625 - gamma) as spread from
 (select n.*, f.past as past0, f.last, f.anomalous, case when n.humidity > 0 then ln(n.humidity / 100) + 17.625 * n.temperature / (243.04 + n.temperature) end as gamma from f join r n on n.grp = f.grp and n.i = f.i + 1)))))))))))
 select seq, state, reasons, learned from f where i > 0""")  # fmt: skip
def t5_environment_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings against references that only good readings of healthy, unheated sensors train (with the whole environment check)."""
    k = F.col("k")
    rows = _stations(spark, sf_dir).select(
        "grp", "at", "seq", F.when(k % 10 != 0, 15 + F.col("value") % 12).alias("temperature"), F.when(k % 10 != 1, 40.0 + (k * 7) % 60).alias("humidity"), F.when(k % 10 != 2, 101000 + (k % 20) * 60.0).alias("pressure"),
        (F.col("type") != "error").alias("healthy"), (k % 23 == 0).alias("heater"),
    )
    limits = {c: [tuple(map(float, v[i : i + 2])) for i in (0, 2)] for c, v in _JUDGED.items()}
    step = folds.environment_change({c: v[0] for c, v in limits.items()}, {c: v[1] for c, v in limits.items()}, least=4, age_s=_DAY, base_s=3 * _DAY, lasting_s=4 * _DAY, keep_s=7 * _DAY, rate_s=(3600, _DAY // 2))
    return folds.folded(rows, ["grp"], ["at", "seq"], ["at", *folds.MEASURES, "healthy", "heater"], step, folds.ENVIRONMENT_OUT).select("seq", *folds.ENVIRONMENT_OUT)
