"""Scalar functions over rows of the given tables, each with independently written SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitloom.functions import atmosphere, geodesy, gnsstime, grades, signals
from orbitloom.operators.tables import event_stream, table
from orbitloom.plans.registry import observations, registry

QUERIES, SQL, query = registry()
_R = F.round


@query("with $OBS, s as (select *, unix - 315964800 + 18 - case gnss when 0 then 0 when 5 then 0 when 2 then 619315200 when 7 then 619315200 when 3 then 820108814 end as sys from obs) select seq, cast(floor(sys / 604800) as bigint) as week, cast(round(1e6 * (sys - 604800 * floor(sys / 604800))) as bigint) as tow_us, cast(round(case when sys is not null then 1e6 * unix end) as bigint) as back_us from s")
def h2_system_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week, time of week and back to Unix seconds."""
    rows = observations(spark, sf_dir).withColumn("at", gnsstime.system_seconds(F.col("gnss"), F.col("unix")))
    week, tow = gnsstime.week(F.col("at")), gnsstime.time_of_week(F.col("at"))
    return rows.select("seq", week.alias("week"), _R(tow * 1e6).cast("long").alias("tow_us"), _R(gnsstime.to_unix(F.col("gnss"), week, tow) * 1e6).cast("long").alias("back_us"))


@query("with $OBS, s as (select seq, k, unix - 315964800 + 18 as sys from obs), w as (select seq, sys, k, cast(floor(sys / 604800) as bigint) as week, sys / 604800 as about from s), c as (select *, (week % 1024 + k % 3 - 1 + 1024) % 1024 as sent from w), "
       "f as (select c.*, sent + 1024 * n.i as full_week from c, (select unnest(range(0, 4)) as i) n where abs(sent + 1024 * n.i - round(about)) < 512) select seq, cast(full_week as bigint) as full_week, full_week <> week and not (full_week = week - 1 and sys - 604800 * week < 14400) as mismatch from f")
def h3_full_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truncated week (right, or one too low or high) made whole and compared."""
    rows = observations(spark, sf_dir).withColumn("at", F.col("unix") - gnsstime.GPS_EPOCH_UNIX + gnsstime.LEAP_S)
    sent = (gnsstime.week(F.col("at")) % 1024 + F.col("k") % 3 - 1 + 1024) % 1024
    full = rows.withColumn("full_week", gnsstime.full_week(sent, 10, F.col("at")))
    return full.select("seq", "full_week", gnsstime.week_mismatch(F.col("full_week"), F.col("at")).alias("mismatch"))


@query("select o_orderkey, cast((epoch(o_orderdate) + o_orderkey * 37 + 10800) % 86400 as bigint) as second, datediff('day', make_date(year(m) - (year(m) - 1996) % 4, 1, 1), m::date) + 1 as day from (select *, o_orderdate + to_seconds(cast(o_orderkey * 37 + 10800 as bigint)) as m from orders)")
def h4_moscow_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLONASS second of the day and day of four years."""
    unix = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 + F.col("o_orderkey") * 37
    return table(spark, sf_dir, "orders").select("o_orderkey", gnsstime.moscow_second(unix).cast("long").alias("second"), gnsstime.four_year_day(unix).alias("day"))


@query("select p_partkey, cast(case when d > 302400 then d - 604800 when d < -302400 then d + 604800 else d end as bigint) as delta from (select p_partkey, p_partkey * 6007 % 604800 - p_size * 12101 % 604800 as d from part)")
def h1_week_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds of the week apart."""
    return table(spark, sf_dir, "part").select("p_partkey", gnsstime.week_delta(F.col("p_partkey") * 6007 % 604800, F.col("p_size") * 12101 % 604800).cast("long").alias("delta"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((c * 7) % 179 - 89.0).alias("lat"), ((c * 13) % 359 - 179.0).alias("lon"), F.col("c_acctbal").alias("h"))


@query("select c_custkey, round((c_custkey * 7) % 179 - 89.0, 6) as lat, round((c_custkey * 13) % 359 - 179.0, 6) as lon, round(c_acctbal, 3) as h from customer")
def h5_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to earth-fixed metres and back: the SQL gives the places themselves."""
    rows = _places(spark, sf_dir)
    lat, lon, h = geodesy.to_geodetic(*geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    return rows.select("c_custkey", _R(lat, 6).alias("lat"), _R(lon, 6).alias("lon"), _R(h, 3).alias("h"))


_SAT = "p as (select c_custkey, radians((c_custkey * 7) % 179 - 89.0) as lat, radians((c_custkey * 13) % 359 - 179.0) as lon, c_acctbal as h, radians((c_custkey * 11) % 111 - 55.0) as slat, radians((c_custkey * 17) % 359 - 179.0) as slon from customer), n as (select *, 6378137.0 / sqrt(1 - 0.00669437999014131699 * sin(lat) * sin(lat)) as n from p), e as (select *, (n + h) * cos(lat) * cos(lon) as x, (n + h) * cos(lat) * sin(lon) as y, (n * (1 - 0.00669437999014131699) + h) * sin(lat) as z, 26560000.0 * cos(slat) * cos(slon) as sx, 26560000.0 * cos(slat) * sin(slon) as sy, 26560000.0 * sin(slat) as sz from n)"


@query(f"with {_SAT}, d as (select *, sx - x as dx, sy - y as dy, sz - z as dz from e), u as (select *, (cos(lat) * cos(lon) * dx + cos(lat) * sin(lon) * dy + sin(lat) * dz) as up, sqrt(dx * dx + dy * dy + dz * dz) as far from d) select c_custkey, round(far, 2) as metres, round(degrees(asin(up / far)), 6) as elevation, round(degrees(slon), 6) as sub_lon from u")
def h6_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and elevation of a satellite seen from a place, and the longitude below it."""
    c = F.col("c_custkey")
    rows = _places(spark, sf_dir).withColumns({"slat": F.radians((c * 11) % 111 - 55.0), "slon": F.radians((c * 17) % 359 - 179.0)})
    sat = (26560000.0 * F.cos("slat") * F.cos("slon"), 26560000.0 * F.cos("slat") * F.sin("slon"), 26560000.0 * F.sin("slat"))
    here = geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    _, elevation = geodesy.azimuth_elevation(F.col("lat"), F.col("lon"), *[s - p for s, p in zip(sat, here)])
    return rows.select("c_custkey", _R(geodesy.distance(sat, here), 2).alias("metres"), _R(elevation, 6).alias("elevation"), _R(geodesy.sub_point(*sat)[1], 6).alias("sub_lon"))


@query(f"with {_SAT}, w as (select a.c_custkey, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d from e a join e b on b.c_custkey = a.c_custkey + 1) select c_custkey, round(d, 2) as metres from w")
def h7_surveyed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres to the customer with the next number."""
    a, b = _places(spark, sf_dir), _places(spark, sf_dir).select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("h").alias("h2"))
    far = geodesy.surveyed_distance((F.col("lat"), F.col("lon"), F.col("h")), (F.col("lat2"), F.col("lon2"), F.col("h2")))
    return a.join(b, "c_custkey").select("c_custkey", _R(far, 2).alias("metres"))


@query("with $OBS, c as (select seq, gnss, k, unix - 315964800 + 18 as now from obs), f as (select seq, case gnss when 6 then 0.0::double when 2 then -4.442807309e-10::double when 3 then -4.442807309e-10::double when 1 then 0.0::double when 4 then 0.0::double else -4.442807633e-10::double end as f, k * 60.0 as dt, k / 5000.0 as e, k * 0.06 as ea, now from c) "
       "select seq, round(1e9 * (1e-5 * dt / 60 + 1e-11 * dt + 1e-16 * dt * dt + f * e * 5153.7 * sin(ea) - 5e-9), 3) as clock_ns, round(case when now >= 2295 * 604800.0 + 4 * 86400 then 19 else 18 end + 1e-9 + 1e-14 * (now - 2294 * 604800.0), 6) as utc_s from f")
def h10_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock correction of a satellite, and a broadcast offset from UTC across a leap second."""
    rows = observations(spark, sf_dir)
    lit, dt, k = (lambda v: F.lit(float(v))), F.col("k") * 60.0, F.col("k")
    clock = signals.clock_offset(F.col("gnss"), dt, 1e-5 * dt / 60, lit(1e-11), lit(1e-16), k / 5000.0, lit(5153.7), k * 0.06, lit(5e-9))
    now = F.col("unix") - gnsstime.GPS_EPOCH_UNIX + gnsstime.LEAP_S
    utc = gnsstime.utc_offset(lit(1e-9), lit(1e-14), lit(0), now, lit(2294 * 604800), lit(18), lit(19), lit(2295), lit(3))
    return rows.select("seq", _R(clock * 1e9, 3).alias("clock_ns"), _R(utc, 6).alias("utc_s"))


@query("with $OBS, a as (select seq, radians((station * 7) % 179 - 89.0) as lat, radians((station * 13) % 359 - 179.0) as lon, radians(k * 3.6) as az, radians(k * 0.9 - 5) as el, (unix - 315964800 + 18) - 604800 * floor((unix - 315964800 + 18) / 604800) as tow from obs), "
       "b as (select *, greatest(el, 0) / pi() as e, lat / pi() as pu, lon / pi() as lu from a), c as (select *, 0.0137 / (e + 0.11) - 0.022 as psi from b), d as (select *, least(greatest(pu + psi * cos(az), -0.416), 0.416) as ph from c), g as (select *, lu + psi * sin(az) / cos(ph * pi()) as la from d), "
       "h as (select *, ph + 0.064 * cos((la - 1.617) * pi()) as m, 43200 * la + tow - 86400 * floor((43200 * la + tow) / 86400) as t from g), i as (select *, greatest(1.2e-8::double + 1.5e-8::double * m - 6e-8::double * m * m - 1.2e-7::double * m * m * m, 0) as amp, greatest(90000 + 98000 * m - 65000 * m * m - 390000 * m * m * m, 72000) as per from h), "
       "j as (select *, 2 * pi() * (t - 50400) / per as x, 1 + 16 * (0.53 - e) * (0.53 - e) * (0.53 - e) as f from i), l as (select *, f * (5e-9::double + case when abs(x) < 1.57 then amp * (1 - x * x / 2 + x * x * x * x / 24) else 0 end) as s from j) "
       "select seq, round(s * 1e9, 3) as delay_ns, round(s * 1e9 * (1575.42 / 1176.45) * (1575.42 / 1176.45), 3) as delay_l5_ns, round(s * 299792458 * sqrt(1 - (6371.0 / 6721.0 * cos(greatest(el, 0))) * (6371.0 / 6721.0 * cos(greatest(el, 0)))) / (40.308e16::double / (1575.42e6::double * 1575.42e6::double)), 4) as vtec from l")
def h12_ionosphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcast delay on L1 and L5, and its vertical electron content."""
    rows, s = observations(spark, sf_dir), F.col("station")
    lat, lon, az, el = F.radians((s * 7) % 179 - 89.0), F.radians((s * 13) % 359 - 179.0), F.radians(F.col("k") * 3.6), F.radians(F.col("k") * 0.9 - 5)
    lits = lambda *v: [F.lit(float(x)) for x in v]
    tow = gnsstime.time_of_week(F.col("unix") - gnsstime.GPS_EPOCH_UNIX + gnsstime.LEAP_S)
    done = rows.withColumn("d", signals.broadcast_delay(lits(1.2e-8, 1.5e-8, -6e-8, -1.2e-7), lits(90000, 98000, -65000, -390000), lat, lon, az, el, tow))
    tec = signals.vertical_tec(F.col("d") * 299792458, F.lit(signals.L1_HZ), F.greatest(el, F.lit(0.0)))
    return done.select("seq", _R(F.col("d") * 1e9, 3).alias("delay_ns"), _R(signals.scaled_delay(F.col("d"), F.lit(1176.45e6)) * 1e9, 3).alias("delay_l5_ns"), _R(tec, 4).alias("vtec"))


@query("with $OBS select seq, round(case when n < 0 or n > 14 then null when n <= 6 then sqrt(2.0 ** (2 + n)) else 2.0 ** (n - 2) end, 6) as ura, round(case when n - 8 <= 6 then sqrt(2.0 ** (2 + n - 8)) else 2.0 ** (n - 10) end, 6) as ura_ed, "
       "round(case when s > 125 then null when s >= 100 then 2 + (s - 100) * 0.16 when s >= 75 then 1 + (s - 75) * 0.04 when s >= 50 then 0.5 + (s - 50) * 0.02 else s / 100.0 end, 4) as sisa, cast(list_extract([1, 2, 2.5, 4, 5, 7, 10, 12, 14, 16, 32, 64, 128, 256, 512], case when n <= 14 then n + 1 end) as double) as ft from (select seq, k % 16 as n, k * 3 % 256 as s from obs)")
def h13_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of four kinds of accuracy indices."""
    rows = observations(spark, sf_dir).select("seq", (F.col("k") % 16).alias("n"), (F.col("k") * 3 % 256).alias("s"))
    n = F.col("n")
    return rows.select("seq", _R(signals.user_range_accuracy(n), 6).alias("ura"), _R(signals.user_range_accuracy(n - 8, -15), 6).alias("ura_ed"), _R(signals.signal_in_space_accuracy(F.col("s")), 4).alias("sisa"), signals.glonass_accuracy(n).alias("ft"))


@query("with $OBS, f (g, s, hz) as (values (0,0,1575420000.0),(0,3,1227600000.0),(0,4,1227600000.0),(0,6,1176450000.0),(0,7,1176450000.0),(1,0,1575420000.0),(2,0,1575420000.0),(2,1,1575420000.0),(2,3,1176450000.0),(2,4,1176450000.0),(2,5,1207140000.0),(2,6,1207140000.0),(3,0,1561098000.0),(3,1,1561098000.0),(3,2,1207140000.0),(3,3,1207140000.0),(3,5,1575420000.0),(3,6,1575420000.0),(3,7,1176450000.0),(3,8,1176450000.0),(5,0,1575420000.0),(5,1,1575420000.0),(5,4,1227600000.0),(5,5,1227600000.0),(5,8,1176450000.0),(5,9,1176450000.0)) "
       "select seq, cast(case when gnss = 6 and sig = 0 then 1602000000 + (k % 14 - 7) * 562500 when gnss = 6 and sig = 2 then 1246000000 + (k % 14 - 7) * 437500 else hz end as double) as hz, coalesce(nullif(substr('GSEC_JRI', cast(gnss + 1 as int), 1), '_'), '?') || lpad(sv::varchar, 2, '0') || '@' || sig as name from obs left join f on gnss = g and sig = s")
def h15_signal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier and name."""
    g, s = F.col("gnss"), F.col("sig")
    return observations(spark, sf_dir).select("seq", signals.frequency(g, s, F.col("k") % 14).alias("hz"), signals.name(g, F.col("sv"), s).alias("name"))


@query("with $OBS, l as (select seq, value, k * 0.1 as acc, value * 2 as v2 from obs), b as (select *, case when 3 * acc < 2 then 2.0 when 3 * acc > 20 then 20.0 else 3 * acc end as i, case when 6 * acc < 4 then 4.0 when 6 * acc > 40 then 40.0 else 6 * acc end as u from l), c as (select *, case when value > u then 0 when value > i then 1 else 3 end as r1, case when v2 >= 60 then 0 when v2 >= 20 then 1 else 3 end as r2 from b) select seq, ['unassured', 'inconsistent', 'unavailable', 'assured'][1 + least(r1, r2)] as state from c")
def h17_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worse of a scaled and a plain band. Accuracies are decimals: as doubles, three tenths of 7 are more than 2.1."""
    acc = F.col("k") * F.lit(Decimal("0.1"))
    scaled = grades.graded(F.col("value"), grades.scaled_limit(acc, 3, 2, 20), grades.scaled_limit(acc, 6, 4, 40))
    return observations(spark, sf_dir).select("seq", grades.worst(scaled, grades.graded_from(F.col("value") * 2, 20, 60)).alias("state"))


@query("with $STREAM, n as (select *, case when value >= 30 then 1 when value < 20 then 0 end as x from stream) select seq, case when value >= 60 then 'crit' when value >= 30 then 'warn' else 'ok' end as jump, concat_ws('+', case when severity >= 1 then 'dif' end, case when value > 25 then 'sif' end, case when audience = 0 then 'aif' end) as flags, coalesce((select arg_max(m.x, (m.time, m.seq)) from n m where m.subject = n.subject and m.x is not null and (m.time, m.seq) <= (n.time, n.seq)), 0) = 1 as degraded from n")
def h18_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump band, raised flags, and a state that is left lower than it is entered."""
    order = Window.partitionBy("subject").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    flags = grades.raised(dif=F.col("severity") >= 1, sif=F.col("value") > 25, aif=F.col("audience") == 0)
    return event_stream(spark, sf_dir).select("seq", grades.jump_band(F.col("value"), 30, 60).alias("jump"), flags.alias("flags"), grades.hysteresis(F.col("value"), 30, 20, order).alias("degraded"))


@query("with $OBS, a as (select seq, k % 45 - 5.0 as c, least(k + 1.0, 100) as rh, 95000 + 10 * value as p1, 95000 + k * 20.0 as p2 from obs), m as (select *, 17.625 * c / (243.04 + c) as q from a), d as (select *, ln(rh / 100) + q as g, rh / 100 * 610.94 * exp(q) as e from m), w as (select *, 0.622 * e / (p1 - e) as r from d), v as (select *, (c + 273.15) * (1 + 0.61 * r / (1 + r)) as tv from w) select seq, round(243.04 * g / (17.625 - g), 4) as dew, round(tv, 4) as tv, round(ln(p2) - ln(p1), 6) as change, round(287.05 / 9.80665 * tv * (ln(p1) - ln(p2)), 3) as height, round(sqrt(9 + rh * rh), 6) as rss from v")
def h19_moist_air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dew point, virtual temperature, pressure height and combined uncertainty."""
    c, rh, p1, p2 = F.col("k") % 45 - 5.0, F.least(F.col("k") + 1.0, F.lit(100.0)), 95000 + 10 * F.col("value"), 95000 + F.col("k") * 20.0
    change, tv = atmosphere.log_pressure_rate(p1, p2, F.lit(1.0)), atmosphere.virtual_temperature(c, rh, p1)
    return observations(spark, sf_dir).select("seq", _R(atmosphere.dew_point(c, rh), 4).alias("dew"), _R(tv, 4).alias("tv"), _R(change, 6).alias("change"), _R(atmosphere.pressure_height(change, tv), 3).alias("height"), _R(atmosphere.combined(F.lit(3.0), rh), 6).alias("rss"))


@query("select conv_id, turn, substr(x, 1, 256) as shown from (select conv_id, turn, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g') as x from conversations where length(text) = strlen(text))")
def h22_shown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts of plain ASCII turns (other alphabets: tests)."""
    return table(spark, sf_dir, "conversations").filter(F.length("text") == F.octet_length("text")).select("conv_id", "turn", grades.shown(F.col("text")).alias("shown"))


_SUN = "j as (select o_orderkey, epoch(o_orderdate) / 86400.0 - 10957.5 as n from orders), t as (select *, n / 36525 as t from j), m as (select *, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) as m, radians(125.04 - 1934.136 * t) as w from t), l as (select *, radians(280.46646 + t * (36000.76983 + 0.0003032 * t) + sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289 - 0.00569 - 0.00478 * sin(w)) as l, radians(23.439291111 - t * (46.815 + t * (0.00059 - t * 0.001813)) / 3600 + 0.00256 * cos(w)) as e, radians(280.46061837 + 360.98564736629 * n + 0.000387933 * t * t - t * t * t / 38710000) as g from m)"


@query(f"with {_SUN} select o_orderkey, round(cos(l) * cos(g) + cos(e) * sin(l) * sin(g), 5) as x, round(cos(e) * sin(l) * cos(g) - cos(l) * sin(g), 5) as y, round(sin(e) * sin(l), 5) as z from l")
def h24_sun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of the sun (the SQL rotates the ecliptic vector instead of going through angles)."""
    unix = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "orders").select("o_orderkey", *[_R(c, 5).alias(n) for c, n in zip(geodesy.sun_direction(unix), "xyz")])


@query("with a as (select p_partkey, p_size * 0.1::double as m0, 5153.0 + p_size * 0.01::double as s, p_size * 0.05::double - 1 as o, (p_partkey * 86400.0::double - 3024000) as d from part), w as (select *, 604800 * round(d / 604800) as dt from a where abs(d / 604800 - round(d / 604800)) < 0.49), x as (select *, m0 + sqrt(3.986005e14::double / (s * s * s * s * s * s)) * dt as m, o + (-8e-9::double - 7.2921151467e-5::double) * dt as n from w) select p_partkey, round(m - 2 * pi() * round(m / (2 * pi())), 5) as m, round(n - 2 * pi() * round(n / (2 * pi())), 5) as n from x")
def h25_whole_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Almanacs referred to the nearest whole week."""
    size, d = F.col("p_size"), F.col("p_partkey") * 86400.0 - 3024000
    rows = table(spark, sf_dir, "part").filter(F.abs(d / 604800 - F.round(d / 604800)) < 0.49)
    m, n = geodesy.whole_week_shift(d, F.lit(0.0), size * 0.1, 5153.0 + size * 0.01, size * 0.05 - 1, F.lit(-8e-9))
    return rows.select("p_partkey", _R(m, 5).alias("m"), _R(n, 5).alias("n"))
