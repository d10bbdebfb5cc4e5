"""Verdicts on motion, levels, capabilities, pressure and clocks, and changeovers of elements. `events` plays the epochs, so windows are days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.functions import gnsstime, grades
from orbitloom.operators import capability, changeovers, levels, motion, pressure
from orbitloom.operators.tables import event_stream, table
from orbitloom.plans.registry import observations, registry

QUERIES, SQL, query = registry()
_DAY = 86400
_MOVES = """m as (select *, epoch_us(time) as us, value * 10 as x, (seq * 13 % 997)::double as y, (seq * 29 % 991)::double as z, (seq % 7 - 3) * 4e-3 as vx, (seq % 5 - 2) * 4e-3 as vy, (seq % 11 - 5) * 2e-3 as vz, (1 + seq % 4) * 1e-3 as a, seq % 17 <> 0 as ok,
 radians(subject % 120 - 60.0::double) as la, radians(subject * 7 % 360.0::double) as lo from stream)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as epochs of a receiver: place, velocity, speed accuracy, the direction up, and whether the fix is usable."""
    k = F.col("seq")
    lat, lon = F.radians(F.col("subject") % 120 - 60.0), F.radians(F.col("subject") * 7 % 360.0)
    return event_stream(spark, sf_dir).select(
        "seq", "subject", "time", "value", (F.col("value") * 10).alias("x"), (k * 13 % 997).cast("double").alias("y"), (k * 29 % 991).cast("double").alias("z"), ((k % 7 - 3) * 4e-3).alias("vx"), ((k % 5 - 2) * 4e-3).alias("vy"), ((k % 11 - 5) * 2e-3).alias("vz"),
        ((1 + k % 4) * 1e-3).alias("s_acc"), (k % 17 != 0).alias("ok"), (F.cos(lat) * F.cos(lon)).alias("ux"), (F.cos(lat) * F.sin(lon)).alias("uy"), F.sin(lat).alias("uz"),
    )




@query(f"""with $STREAM, {_MOVES}, g as (select * from m where ok), s as (select *, (us - lag(us) over w) / 1e6 as dt, (vx + lag(vx) over w) * dt / 2 as ix, (vy + lag(vy) over w) * dt / 2 as iy, (vz + lag(vz) over w) * dt / 2 as iz from g window w as (partition by subject order by us, seq)),
 b as (select e.seq, arg_max(p.seq, p.us) as base from g e join g p on e.subject = p.subject and e.us - p.us between 86400000000 and 172800000000 group by 1), j as (select e.*, p.us as bus, (e.us - p.us) / 1e6 as span, (e.x - p.x) / span as dx, (e.y - p.y) / span as dy, (e.z - p.z) / span as dz from g e join b using (seq) join g p on p.seq = b.base),
 i as (select j.seq, sum(case when s.us > bus then s.ix end) / any_value(span) as rx, sum(case when s.us > bus then s.iy end) / any_value(span) as ry, sum(case when s.us > bus then s.iz end) / any_value(span) as rz, sqrt(avg(s.a * s.a)) as ra from j join s on s.subject = j.subject and s.us between bus and j.us group by 1),
 f as (select m.seq, m.ok, span, ra, sqrt((dx - rx) ** 2 + (dy - ry) ** 2 + (dz - rz) ** 2) as res, sqrt(dx * dx + dy * dy + dz * dz) as ds, sqrt(rx * rx + ry * ry + rz * rz) as rs from m left join j using (seq) left join i using (seq))
 select seq, case when res is null then 'unavailable' when res > least(greatest(6 * ra, 1e-2), 4e-2) then 'unassured' when res > least(greatest(3 * ra, 4e-3), 2e-2) then 'inconsistent' else 'assured' end as state, case when not ok then 'no_3d_fix' when res is null then 'no_base_epoch' when res > least(greatest(3 * ra, 4e-3), 2e-2) then 'velocity_residual' end as reason,
 round(span, 3) as interval_s, round(res * 1000, 3) as residual_mm, round(ds * 1000, 3) as derived_mm, round(rs * 1000, 3) as reported_mm, round(ra * 1000, 3) as acc_mm from f""")
def w15_position_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way since a base one to two days ago against the integral of the velocity, and its state."""
    done = motion.position_velocity(_moves(spark, sf_dir), "subject", "time", F.col("ok"), _DAY, _DAY, (3, 6), (4e-3, 2e-2), (1e-2, 4e-2))
    mm = lambda c, n: F.round(F.col(c) * 1000, 3).alias(n)
    return done.select("seq", "state", "reason", F.round("interval_s", 3).alias("interval_s"), mm("residual", "residual_mm"), mm("derived_speed", "derived_mm"), mm("reported_speed", "reported_mm"), mm("rms_s_acc", "acc_mm"))


@query(f"with $STREAM, {_MOVES}, s as (select *, sqrt(vx * vx + vy * vy + vz * vz) as speed from m), v as (select *, case when not ok then 'unavailable' when speed > least(greatest(6 * a, 1e-2), 15e-3) then 'unassured' when speed > least(greatest(3 * a, 5e-3), 1e-2) then 'inconsistent' else 'assured' end as verdict from s) select seq, case when ok then round(speed * 1000, 3) end as speed_mm, verdict as state, case verdict when 'unavailable' then 'no_3d_fix' when 'assured' then null else 'speed' end as reason from v")
def p2_stationary_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed of fixed stations."""
    found = motion.stationary_velocity(F.col("ok"), [F.col(f"v{c}") for c in "xyz"], F.col("s_acc"), (3, 6), (5e-3, 1e-2), (1e-2, 15e-3))
    return _moves(spark, sf_dir).select("seq", F.round(found["speed"] * 1000, 3).alias("speed_mm"), found["state"].alias("state"), found["reason"].alias("reason"))


@query("with $STREAM, o as (select seq, sqrt((value - 50) ** 2 + (seq % 90 - 45) ** 2) as h, abs(seq % 40 - 20) as v, 3 * sqrt((1 + seq % 25) ** 2 + 4) as hu, 3 * sqrt((seq % 9 / 2) ** 2 + 1) as vu from stream) select seq, round(h, 3) as horizontal, v::double as vertical, case when hu > 60 or vu > 12 then 'unavailable' when h - hu > 60 or v - vu > 12 then 'unassured' else 'assured' end as state, case when hu > 60 or vu > 12 then 'insufficient_accuracy' else concat_ws(',', case when h - hu > 60 then 'horizontal_error' end, case when v - vu > 12 then 'vertical_error' end) end as reasons from o")
def p5_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of fixed stations from their surveyed places (P5)."""
    k = F.col("seq")
    found = motion.displacement(F.col("value") - 50, k % 90 - 45, (k % 40 - 20).cast("double"), 1 + k % 25, (k % 9) / 2, 2, 1, 60, 12)
    return event_stream(spark, sf_dir).select("seq", F.round(found["horizontal"], 3).alias("horizontal"), *[found[c].alias(c) for c in ("vertical", "state", "reasons")])


@query(f"""with $STREAM, {_MOVES}, g as (select *, cos(la) * cos(lo) as ux, cos(la) * sin(lo) as uy, sin(la) as uz, (us - lag(us) over w) / 1e6 as gap, case when gap > 0 and gap <= 86400 then gap end as dt, lag(a) over w as pa, vx - lag(vx) over w as dx, vy - lag(vy) over w as dy, vz - lag(vz) over w as dz, (vx + lag(vx) over w) / 2 as mx, (vy + lag(vy) over w) / 2 as my, (vz + lag(vz) over w) / 2 as mz from m where ok window w as (partition by subject order by us, seq)),
 h as (select *, mx * ux + my * uy + mz * uz as mu, mx - ux * mu as hx, my - uy * mu as hy, mz - uz * mu as hz, sqrt(hx * hx + hy * hy + hz * hz) as hn, dx * ux + dy * uy + dz * uz as du, (dx * hx + dy * hy + dz * hz) / hn as dh, sqrt(greatest(dx * dx + dy * dy + dz * dz - du * du - dh * dh, 0)) / dt as turn, sqrt(dx * dx + dy * dy + dz * dz) / dt as acc, sqrt(vx * vx + vy * vy + vz * vz) as speed, 3 * (a + pa) / dt as unc from g),
 t as (select seq, a, concat_ws(',', case when 3 * a <= 6e-3 and speed - 3 * a > 6e-3 then 'reported_speed' end, case when 3 * a <= 4e-3 and abs(vz) - 3 * a > 4e-3 then 'vertical_speed' end, case when unc <= 5e-7 and acc - unc > 5e-7 then 'acceleration' end, case when hn > 3 * (a + pa) and unc <= 4e-7 and turn - unc > 4e-7 then 'lateral_acceleration' end) as names,
 3 * a > 6e-3 or 3 * a > 4e-3 or dt is null or unc > 5e-7 or (hn > 3 * (a + pa) and unc > 4e-7) or (hn <= 3 * (a + pa) and speed > 3 * a) as missing from h)
 select seq, case when a > 35e-4 then 'unavailable' when names <> '' then 'unassured' when missing then 'unavailable' else 'assured' end as state, case when a > 35e-4 then 'insufficient_accuracy' when names = '' and missing then 'no_window,insufficient_accuracy' else names end as reasons from t union all select seq, 'unavailable', 'no_3d_fix,insufficient_accuracy' from m where not ok""")
def p5_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds and accelerations of moving stations against what they can do (P5)."""
    rows = _moves(spark, sf_dir).withColumn("down", F.col("vz"))
    return motion.kinematics(rows, "subject", "time", F.col("ok"), 6e-3, 4e-3, 5e-7, 4e-7, 35e-4, _DAY).select("seq", "state", "reasons")


_LEVELS = "l as (select time::date::varchar as day, station % 3 as grp, gnss, k as x, 44 + gnss * 0.5::double + k * 0.01::double + value * case when gnss % 3 = 0 and station % 3 = day(time) % 3 then 0.001::double else 0.2::double end as y from obs)"
_FIT = "count(*) as sats, avg(y) as mean, (regr_syy(y, x) - case when regr_sxx(y, x) > 1e-9 then regr_sxy(y, x) ** 2 / regr_sxx(y, x) else 0 end) / count(*) as res"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k = F.col("gnss"), F.col("k")
    y = 44 + g * 0.5 + k * 0.01 + F.col("value") * F.when((g % 3 == 0) & (F.col("station") % 3 == F.dayofmonth("time") % 3), 0.001).otherwise(0.2)
    return observations(spark, sf_dir).select(F.to_date("time").cast("string").alias("day"), (F.col("station") % 3).alias("grp"), "gnss", k.alias("x"), y.alias("y"))


@query(f"with $OBS, {_LEVELS}, f as (select day, grp, gnss, {_FIT} from l where gnss <> 1 group by all union all select day, grp, null, {_FIT} from l group by all) select day, grp, gnss, sats, round(mean, 6) as mean, round(res, 4) as residual from f where sats >= 5")
def a8_level_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of the level over elevation for all satellites and for each constellation but SBAS."""
    found = levels.fits(_levels(spark, sf_dir), ["day", "grp"], "gnss", "x", "y").filter("sats >= 5")
    return found.select("day", "grp", "gnss", "sats", F.round("mean", 6).alias("mean"), F.round("residual", 4).alias("residual"))


@query(f"with $OBS, {_LEVELS}, c as (select day, grp, gnss, {_FIT} from l where gnss <> 1 group by all), w as (select day, grp, {_FIT} from l group by all), p as (select day, grp, min(gnss) filter (where sats >= 12 and res < 2 and mean > 45) as tripped, max(sats) as most from c group by all), v as (select w.*, tripped, case when w.sats < 12 and coalesce(most, 0) < 12 then 'unavailable' when tripped is not null or (w.sats >= 12 and res < 2 and mean > 45) then 'unassured' else 'assured' end as state from w left join p using (day, grp)) "
       "select day, grp, sats, round(mean, 6) as mean, round(res, 4) as residual, tripped as tripped_gnss, state, case state when 'unavailable' then 'too_few_satellites' when 'unassured' then 'uniform_cn0' end as reason from v")
def p9_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether levels are strong and too even, over all or one constellation."""
    found = levels.uniformity(_levels(spark, sf_dir), ["day", "grp"], "gnss", "x", "y", 12)
    return found.select("day", "grp", "sats", F.round("mean", 6).alias("mean"), F.round("residual", 4).alias("residual"), "tripped_gnss", "state", "reason")


_CAPS = "o as (select station % 15 as station, gnss, sig, floor(unix)::bigint as sec, type, seq from obs), n as (select max(sec) as now from o), s as (select station, gnss, sig, count(*) as count, max(sec) as last_seen from o where type <> 'error' group by all), d as (select distinct station, gnss, sig from o where seq % 3 = 0 and station < 12), t as (select station, max(sec) as rf from o where type = 'error' group by 1), l as (select station, max(last_seen) as nav from s group by 1)"


def _capabilities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = observations(spark, sf_dir).select((F.col("station") % 15).alias("station"), "gnss", "sig", F.floor("unix").alias("at"), "type", "seq")
    seen = rows.filter("type <> 'error'").groupBy("station", "gnss", "sig").agg(F.count("*").alias("count"), F.max("at").alias("last_seen"))
    declared = rows.filter("seq % 3 = 0 and station < 12").select("station", "gnss", "sig")
    telemetry = rows.filter("type = 'error'").select("station", F.col("at").alias("last_seen"))
    return capability.report(seen, declared, telemetry), F.broadcast(rows.agg(F.max("at").alias("now")))  # one row


@query(f"with $OBS, {_CAPS} select coalesce(s.station, d.station) as station, coalesce(s.gnss, d.gnss) as gnss, coalesce(s.sig, d.sig) as sig, count, last_seen, d.sig is not null as declared, greatest((select nav from l where l.station = coalesce(s.station, d.station)), (select rf from t where t.station = coalesce(s.station, d.station))) as station_last_seen from s full join d on s.station = d.station and s.gnss = d.gnss and s.sig = d.sig")
def j13_capability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals seen or declared by each station, and when the station was last heard by any means."""
    return _capabilities(spark, sf_dir)[0].drop("has_declared")


@query(f"with $OBS, {_CAPS} select s.station, gnss, sig, case when now - greatest(nav, rf) <= 7200 then case when count >= 8 and now - last_seen > 259200 then 'lost' else 'present' end end as state, now - last_seen as unseen_s from s join l using (station) left join t using (station), n")
def p22_signal_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrated signals gone silent on live stations."""
    found, now = _capabilities(spark, sf_dir)
    return capability.lost(found.join(now), F.col("now"), 8, 3 * _DAY, 7200)


@query(f"with $OBS, {_CAPS}, x as (select s.station, string_agg(gnss || ':' || sig, ',' order by gnss || ':' || sig) as names from s anti join d using (station, gnss, sig) group by 1) select station, case when names is null then 'ok' else 'impossible' end as state, coalesce(names, '') as signals from (select distinct station from d) left join x using (station)")
def p22_impossible_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals delivered but not declared (P22). A seen signal is one of at most some hundred of its station."""
    return capability.impossible(_capabilities(spark, sf_dir)[0])


_SETS = ("ev as (select seq, subject, epoch_us(time) as us, epoch_us(time) // 172800000000 as iss from stream), ch as (select *, lag(iss) over w as old, lag(us) over w as old_us from ev window w as (partition by subject order by us, seq)), cs as (select * from ch where old <> iss), "
         "sd as (select seq, subject, us, 1 as new, iss as s, iss from cs union all select seq, subject, us, 0, old, iss from cs), "
         "e1 as (select *, [0, 2, 3, 5, 7][1 + subject % 5] as g, subject % 5 = 2 and subject % 9 < 5 as geo, case when subject % 5 in (1, 2) then 3.986004418e14::double else 3.986005e14::double end as mu, case when subject % 5 = 2 then 7.292115e-5::double else 7.2921151467e-5::double end as we, 5153.5::double + subject % 7 * 0.01::double as sa, 0.001::double * (1 + subject % 20) as e, s % 84 * 7200.0::double as toe, iss % 84 * 7200.0::double as aim, (s % 50)::double as crs, (subject * 5 % 628) / 100.0::double as w, (subject * 3 % 628) / 100.0::double as o0 from sd), "
         "e2 as (select *, aim - toe - 604800 * floor((aim - toe) / 604800 + 0.5) as tk from e1), x0 as (select *, (subject % 628) / 100.0::double + 1.4585e-4 * toe + sqrt(mu) / (sa * sa * sa) * tk as m, m as x from e2), "
         + ", ".join(f"x{i} as (select * exclude (x), x - (x - e * sin(x) - m) / (1 - e * cos(x)) as x from x{i - 1})" for i in range(1, 13)) + ", "
         "p as (select *, atan2(sqrt(1 - e * e) * sin(x), cos(x) - e) + w as u, sa * sa * (1 - e * cos(x)) + crs * sin(2 * u) as r, o0 + (-8e-9::double - case when geo then 0 else we end) * tk - we * toe as n, r * (cos(u) * cos(n) - sin(u) * cos(0.95::double) * sin(n)) as px, r * (cos(u) * sin(n) + sin(u) * cos(0.95::double) * cos(n)) as py, r * sin(u) * sin(0.95::double) as pz, cos(radians(5)) * py - sin(radians(5)) * pz as ty, "
         "subject % 50 * 1e-6 + s % 13 * 1e-9 + subject % 7 * 1e-11 * tk + case when g in (2, 3) then -4.442807309e-10 else -4.442807633e-10 end * e * sa * sin(x) as clk from x12), "
         "q as (select seq, new, case when geo then cos(we * tk) * px + sin(we * tk) * ty else px end as x, case when geo then cos(we * tk) * ty - sin(we * tk) * px else py end as y, case when geo then sin(radians(5)) * py + cos(radians(5)) * pz else pz end as z, clk from p)")


@query(f"with $STREAM, {_SETS}, k as (select *, us - old_us < 129600000000 and abs((iss - old) * 7200 - 604800 * floor((iss - old) * 7200 / 604800 + 0.5)) < 14400 as ok from cs) select k.seq, k.subject, iss as issue, old as old_issue, case when ok then round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 2) end as orbit_m, case when ok then round(abs(a.clk - b.clk) * 1e9, 3) end as clock_ns from k join q a on a.seq = k.seq and a.new = 1 join q b on b.seq = k.seq and b.new = 0")
def w8_changeovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of orbit and clock at changeovers of Keplerian sets."""
    s, k = F.col("issue"), F.col("subject")
    one = lambda v: F.lit(float(v))
    rows = event_stream(spark, sf_dir).withColumn("issue", F.floor(F.unix_micros("time") / 172800000000)).select(
        "seq", "subject", "time", "issue", F.element_at(F.array(*[F.lit(g) for g in (0, 2, 3, 5, 7)]), (k % 5 + 1).cast("int")).alias("gnss"), (k % 9 + 1).alias("sv"), (7200.0 * (s % 84)).alias("toe"), (7200.0 * (s % 84)).alias("toc"), (5153.5 + k % 7 * 0.01).alias("sqrt_a"), (0.001 * (1 + k % 20)).alias("e"),
        (k % 628 / 100.0 + 1.4585e-4 * 7200.0 * (s % 84)).alias("m0"), one(0.95).alias("i0"), (k * 3 % 628 / 100.0).alias("omega0"), (k * 5 % 628 / 100.0).alias("omega"), one(-8e-9).alias("omega_dot"), (s % 50).cast("double").alias("crs"), (k % 50 * 1e-6 + s % 13 * 1e-9).alias("af0"), (k % 7 * 1e-11).alias("af1"), one(0).alias("af2"),
    )
    found = changeovers.kepler(rows, ["subject"], "time", "issue", 1.5 * _DAY)
    return found.select("seq", "subject", "issue", "old_issue", F.round("orbit_m", 2).alias("orbit_m"), F.round("clock_ns", 3).alias("clock_ns"))


def _glonass_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("iss"), F.col("subject")
    rows = observations(spark, sf_dir).withColumnRenamed("station", "subject").withColumn("iss", F.floor(F.unix_micros("time") / 172800000000))
    p = F.radians(k * 7 % 360 + s % 48 * 16.0)
    state = [25500 * F.cos(p), 25500 * F.sin(p) * 0.43, 25500 * F.sin(p) * 0.9, -F.sin(p) * 3.2, F.cos(p) * 1.4, F.cos(p) * 2.9]
    tau = F.when(F.col("k") % 3 != 0, k % 9 * 1e-6 + s % 7 * 1e-9)
    return rows.select("seq", "subject", "time", (s % 48 * 1800).alias("tb"), F.array(*state).alias("state"), F.array(F.lit(0.0), F.lit(1e-9), F.lit(-1e-9)).alias("pull"), tau.alias("tau"), F.when(tau.isNotNull(), k % 5 * 1e-12).alias("gamma"))


@query()
def w9_glonass_changeovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of orbit and clock at changeovers of integrated sets (W9; orbits are tested against plain Python, w9_glonass_clocks has SQL)."""
    found = changeovers.glonass(_glonass_rows(spark, sf_dir), "subject", "time", 1.5 * _DAY)
    return found.select("seq", "subject", "tb", "step_s", F.round("orbit_m", 2).alias("orbit_m"), F.round("clock_ns", 3).alias("clock_ns"), F.col("clock_at").cast("timestamp").alias("clock_at"))


@query("""with $OBS, r as (select seq, station as subject, epoch_us(time) as us, epoch_us(time) // 172800000000 as iss, case when k % 3 <> 0 then station % 9 * 1e-6 + (epoch_us(time) // 172800000000) % 7 * 1e-9 end as tau from obs), c as (select *, lag(iss) over w as old, lag(us) over w as old_us from r window w as (partition by subject order by us, seq)), h as (select * from c where old % 48 <> iss % 48),
 f as (select h.seq, min(n.us) filter (where n.us >= h.us and n.iss = h.iss) as done, max(o.tau) filter (where o.iss = h.old) as was from h join r n on n.subject = h.subject and n.tau is not null and n.iss = h.iss left join r o on o.subject = h.subject and o.iss = h.old and o.tau is not null group by 1),
 g as (select h.*, done, was, ((iss % 48 - old % 48) * 1800 + 43200) % 86400 as d0, (d0 + 86400) % 86400 - 43200 as step from h left join f using (seq))
 select seq, subject, iss % 48 * 1800 as tb, step as step_s, case when done is not null and was is not null and abs(step) <= 3600 and us - old_us < 129600000000 then round(abs(subject % 9 * 1e-6 + iss % 7 * 1e-9 - (was - subject % 5 * 1e-12 * step)) * 1e9, 3) end as clock_ns, case when done is not null and was is not null and abs(step) <= 3600 and us - old_us < 129600000000 then (done - us) / 1e6 end as lag_s from g""")
def w9_glonass_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of the clock at changeovers of GLONASS sets, with the wait for the clock where the new set lacked it."""
    found = changeovers.glonass(_glonass_rows(spark, sf_dir), "subject", "time", 1.5 * _DAY)
    lag = (F.unix_micros("clock_at") - F.unix_micros("time")) / 1e6
    return found.select("seq", "subject", "tb", F.col("step_s").cast("long").alias("step_s"), F.round("clock_ns", 3).alias("clock_ns"), lag.alias("lag_s"))


_REGION = """st as (select seq, subject as a, epoch_us(time) as us, value + 100000 as p, 5.0::double + seq % 5 as s from stream), pl as (select c_custkey as a, (c_custkey * 37 % 101) * 4000.0::double as x, (c_custkey * 53 % 97) * 4000.0::double as y from customer),
 pr as (select e.seq, b.seq as start, b.us as bus, (e.us - b.us) / 1e6 as dt, ln(e.p / b.p) / dt as rate, sqrt((b.s / b.p) ** 2 + (e.s / e.p) ** 2) / dt as rs, row_number() over (partition by e.seq order by abs(e.us - b.us - 43200000000), b.seq) as r from st e join st b on e.a = b.a and e.us - b.us between 21600000000 and 64800000000),
 tn as (select st.*, start, bus, dt, rate, rs from st join pr using (seq) where r = 1), own as (select tn.* from tn join pl using (a)), nb as (select l.a, o.a as b, sqrt((l.x - o.x) ** 2 + (l.y - o.y) ** 2) as gap from pl l join pl o on l.a <> o.a and sqrt((l.x - o.x) ** 2 + (l.y - o.y) ** 2) <= 40000),
 ask as (select own.seq, own.us, own.bus as began, nb.b, gap from own join nb on nb.a = own.a), met as (select ask.seq, gap, (ask.us - st.us) / 1e6 as age, tn.rate, tn.rs, abs(tn.bus - began) as apart from ask asof join st on st.a = ask.b and ask.us >= st.us left join tn on tn.seq = st.seq),
 ct as (select seq, count(*) as n, median(rate) as rr, max(rs) as rsg, max(age) as ma, max(gap) as mg from met where rate is not null and age <= 43200 and apart <= 43200000000 group by 1), sp as (select seq, max(abs(rate - rr)) as spread from met join ct using (seq) where rate is not null and age <= 43200 and apart <= 43200000000 group by 1),
 rg as (select own.*, coalesce(n, 0) as n, case when n >= 2 then rr end as rr, case when n >= 2 then spread end as spread, case when n >= 2 then rsg end as rsg, case when n >= 2 then ma end as ma, case when n >= 2 then mg end as mg from own left join ct using (seq) left join sp using (seq))"""


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select(F.col("subject").alias("station"), "seq", "time", (F.col("value") + 100000).alias("pascal"), (5.0 + F.col("seq") % 5).alias("sigma"))
    k = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(k.alias("station"), ((k * 37 % 101) * 4000.0).alias("x"), ((k * 53 % 97) * 4000.0).alias("y"), F.lit(0.0).alias("z"))
    return pressure.regional(rows, places, _DAY // 2, _DAY // 4, 40000.0, _DAY // 2, 2)


@query(f"with $STREAM, {_REGION} select seq, a as station, start, n as neighbours, round(rate * 1e9, 3) as rate, round(rr * 1e9, 3) as region_rate, round(spread * 1e9, 3) as region_spread, round(rsg * 1e9, 3) as region_sigma, round(ma, 3) as max_age, round(mg, 3) as max_gap, case when n < 2 then 'insufficient_neighbours' end as reason from rg")
def j9_regional_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure tendencies of each station's neighbours."""
    nano = lambda c: F.round(F.col(c) * 1e9, 3).alias(c)
    return _region(spark, sf_dir).select("seq", "station", "start", "neighbours", *[nano(c) for c in ("rate", "region_rate", "region_spread", "region_sigma")], F.round("max_age", 3).alias("max_age"), F.round("max_gap", 3).alias("max_gap"), "reason")


@query(f"with $STREAM, {_REGION}, d as (select *, 287.05::double / 9.80665::double * (280.0::double + seq % 15) as sc, -sc * (rate - rr) * dt as delta, sc * spread * dt as spr, sc * sqrt(rs * rs + rsg * rsg) * dt as sg, sqrt(sg * sg + spr * spr) as off, greatest(0.5, 3 * off) as lo, greatest(1.5, 6 * off, lo) as hi from rg) "
       "select seq, round(delta, 3) as delta_m, round(spr, 3) as spread_m, round(sg, 3) as sigma_m, case when n < 2 or spr > 25 then 'unavailable' when abs(delta) >= hi then 'unassured' when abs(delta) >= lo then 'inconsistent' else 'assured' end as state, case when n < 2 then 'insufficient_neighbours' when spr > 25 then 'region_incoherent' when abs(delta) >= lo then 'pressure_departure' end as reason from d")
def p16_pressure_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a station's pressure departs from its region's (P16, the regional part)."""
    done = pressure.departures(_region(spark, sf_dir), 280.0 + F.col("seq") % 15, 25, 0.5, 1.5)
    return done.select("seq", *[F.round(c, 3).alias(c) for c in ("delta_m", "spread_m", "sigma_m")], "state", "reason")


@query("with $OBS, n as (select seq, value, k, unix - 315964800 + 18 - 619315200 as now from obs) select seq, round(value + k * 1e-6 * (now - ((floor(now / 604800) - seq % 20) * 604800 + seq % 168 * 3600)), 3) as offset_ns from n")
def h11_galileo_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of Galileo from GPS time now."""
    rows = observations(spark, sf_dir)
    now = gnsstime.system_seconds(F.lit(2), F.col("unix"))
    week = F.pmod(gnsstime.week(now) - F.col("seq") % 20, F.lit(64))
    offset = gnsstime.galileo_gps_offset(F.col("value") * 1e-9, F.col("k") * 1e-15, F.col("seq") % 168 * 3600, week, F.col("unix"))
    return rows.select("seq", F.round(offset, 3).alias("offset_ns"))


@query("with $OBS, r as (select seq, (seq % 9 - 3) * 0.7::double as lag, seq % 10 = 0 as direct, seq % 4 <> 0 as stamped, seq % 3 = 0 as net, (seq % 13 - 6) * 0.4::double as u from obs), s as (select *, case when direct then 0 when not stamped or lag < -1 then null when lag <= 2 then lag when net then 0 end as mark, coalesce(direct or (stamped and lag >= -1 and lag <= 2), false) as own from r) "
       "select seq, round(u - mark, 3) as offset_s, own as local_clock, case when mark is null or seq % 23 = 0 then 'unavailable' when abs(u - mark) > 1.55 then 'unassured' when abs(u - mark) > 0.55 then 'inconsistent' else 'assured' end as state from s")
def p7_utc_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC of solutions against the clock that can be trusted for each."""
    k = F.col("seq")
    local: Column = F.when(k % 10 != 0, F.col("unix") + (k % 9 - 3) * 0.7)
    stamp, own = gnsstime.utc_reference(F.col("unix"), local, k % 4 != 0, k % 3 == 0)
    rows = observations(spark, sf_dir).select("seq", (F.col("unix") + (k % 13 - 6) * 0.4 - stamp).alias("offset"), own.alias("local_clock"))
    state = F.when(k % 23 == 0, "unavailable").otherwise(grades.graded(F.abs("offset"), F.lit(0.55), F.lit(1.55)))
    return rows.select("seq", F.round("offset", 3).alias("offset_s"), "local_clock", state.alias("state"))
