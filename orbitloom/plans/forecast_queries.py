"""Forecasts of what stations should hear. `customer` plays the stations, `part` the orbits, `lineitem` who heard them, a hundred of each to an audience."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.operators import forecast
from orbitloom.operators.tables import table
from orbitloom.plans.registry import registry

QUERIES, SQL, query = registry()
_NOW = 1800000000
_SYSTEMS = (0, 2, 3, 5)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as stations."""
    k = F.col("c_custkey")
    some = F.when(k % 3 == 0, F.array(F.lit("0:0"), F.lit("3:0"))).otherwise(F.array(*[F.lit(f"{g}:{s}") for g in _SYSTEMS for s in (0, 1)]))
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 100).alias("audience"), k.alias("observer"), (k * 37 % 1600 / 10.0 - 80).alias("lat"), (k * 53 % 3600 / 10.0 - 180).alias("lon"), (k % 50 * 10.0).alias("height"),
        (5.0 + k % 26).alias("mask"), (k % 2 == 0).alias("per_signal"), some.alias("signals"),
    )


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as orbits of four constellations, two signals to a satellite."""
    k = F.col("p_partkey")
    w = k % 100
    rows = table(spark, sf_dir, "part").select(
        F.floor(k / 100).alias("audience"), F.element_at(F.array(*[F.lit(g) for g in _SYSTEMS]), (w % 4 + 1).cast("int")).alias("gnss"), (10 + F.floor(w / 8)).alias("sv"), (F.floor(w / 4) % 2).alias("sig"),
        (k % 13 != 0).alias("healthy"), F.when(k % 31 != 0, F.lit(2e7)).alias("pos_x"), F.lit(1e6).alias("pos_y"), F.lit(1e6).alias("pos_z"), (_NOW - k % 9 * 16).alias("pos_at"),
        F.when(k % 17 == 0, _NOW - 255600 + 150).otherwise(_NOW - k % 10 * 28800).alias("eph_at"), F.when(k % 7 != 0, _NOW - k % 50 * 6000).alias("eph_recv_at"),
        (k * 3600 % 604800).cast("double").alias("toe"), (5153.0 + k % 7).alias("sqrt_a"), (0.001 * (1 + k % 20)).alias("e"), (k % 628 / 100.0).alias("m0"), (0.9 + k % 10 / 100.0).alias("i0"),
        (k * 3 % 628 / 100.0).alias("omega0"), (k * 5 % 628 / 100.0).alias("omega"), F.lit(-8e-9).alias("omega_dot"),
    )
    return rows


def witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as satellites heard by stations, some too long ago or in the future."""
    k = F.col("l_partkey")
    w, audience = k % 100, F.floor(k / 100)
    return table(spark, sf_dir, "lineitem").select(
        audience.alias("audience"), F.element_at(F.array(*[F.lit(g) for g in _SYSTEMS]), (w % 4 + 1).cast("int")).alias("gnss"), (10 + F.floor(w / 8)).alias("sv"), (F.floor(w / 4) % 2).alias("sig"),
        (audience * 100 + F.col("l_suppkey") % 20).alias("source"), (_NOW + 20 - F.col("l_orderkey") % 900).alias("at"),
    )


_NEWTON = ", ".join(f"x{i} as (select * exclude (x), x - (x - e * sin(x) - m) / (1 - e * cos(x)) as x from x{i - 1})" for i in range(1, 13))
_SQL = f"""with s as (select c_custkey as observer, c_custkey // 100 as audience, c_custkey * 37 % 1600 / 10 - 80 as lat, c_custkey * 53 % 3600 / 10 - 180 as lon, c_custkey % 50 * 10 as h, 5 + c_custkey % 26 as mask, c_custkey % 2 = 0 as per, c_custkey % 3 = 0 as few from customer),
 o as (select *, case when sig = 1 and g in (2, 3) then 0 else sig end as band from (select p_partkey as k, p_partkey // 100 as audience, [0, 2, 3, 5][1 + p_partkey % 100 % 4] as g, 10 + p_partkey % 100 // 8 as sv, p_partkey % 100 // 4 % 2 as sig,
 case when p_partkey % 17 = 0 then {_NOW} - 255600 + 150 else {_NOW} - p_partkey % 10 * 28800 end as made, case when p_partkey % 7 <> 0 then {_NOW} - p_partkey % 50 * 6000 end as got, p_partkey * 3600 % 604800 as toe, 5153.0::double + p_partkey % 7 as sa, 0.001::double * (1 + p_partkey % 20) as e, p_partkey % 628 / 100 as m0, 0.9::double + p_partkey % 10 / 100 as i0,
 p_partkey * 3 % 628 / 100 as o0, p_partkey * 5 % 628 / 100 as om from part where p_partkey % 13 <> 0 and p_partkey % 31 <> 0 and p_partkey % 9 * 16 <= 120)),
 w as (select l_partkey as k, count(distinct src) as n, any_value(src) as src from (select l_partkey, l_partkey // 100 * 100 + l_suppkey % 20 as src, {_NOW} + 20 - l_orderkey % 900 as ut from lineitem) where ut between {_NOW} - 60 and {_NOW} group by 1),
 i as (select o.*, t.i, {_NOW} + t.i * 10 as ut from o, range(31) as t(i)), j as (select *, (ut - 315964800 + 18 - case g when 2 then 619315200 when 3 then 820108814 else 0 end) % 604800 as tow, case when g in (2, 3) then 3.986004418e14::double else 3.986005e14::double end as mu, case when g = 3 then 7.292115e-5::double else 7.2921151467e-5::double end as we,
 ut - made <= 255600 and coalesce(ut - got, 0) <= 255600 as live from i), c as (select *, (tow - toe) - 604800 * floor((tow - toe) / 604800 + 0.5) as tk from j), x0 as (select *, m0 + sqrt(mu) / (sa * sa * sa) * tk as m, m as x from c), {_NEWTON},
 u as (select *, atan2(sqrt(1 - e * e) * sin(x), cos(x) - e) + om as arg, sa * sa * (1 - e * cos(x)) as r, o0 + (-8e-9::double - we) * tk - we * toe as nd from x12), p as (select k, i, live, r * (cos(arg) * cos(nd) - sin(arg) * cos(i0) * sin(nd)) as x, r * (cos(arg) * sin(nd) + sin(arg) * cos(i0) * cos(nd)) as y, r * sin(arg) * sin(i0) as z from u),
 a as (select *, 6378137 / sqrt(1 - 0.0066943799901413165::double * sin(radians(lat)) ** 2) as n, cos(radians(lat)) * cos(radians(lon)) as ux, cos(radians(lat)) * sin(radians(lon)) as uy, sin(radians(lat)) as uz from s),
 b as (select *, (n + h) * ux as px, (n + h) * uy as py, (n * (1 - 0.0066943799901413165::double) + h) * uz as pz from a),
 q as (select b.observer, b.audience, o.g, o.sv, case when per then band end as signal, o.k, p.i, coalesce(live and degrees(asin(((x - px) * ux + (y - py) * uy + (z - pz) * uz) / sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2))) >= mask + 2, false) as up
 from b join o on b.audience = o.audience and (not few or (o.g in (0, 3) and o.band = 0)) join w on w.k = o.k and (w.n > 1 or w.src <> b.observer) join p on p.k = o.k),
 v as (select observer, audience, g, sv, signal, k, {" + ".join(f"case when bool_and(up) filter (i between {6 * t} and {6 * t + 6}) then {1 << t} else 0 end" for t in range(5))} as slots from q group by all),
 f as (select audience, observer, g, sv, signal, bit_or(slots) as slots from v where slots > 0 group by all)"""


@query(_SQL + " select audience, observer, g as gnss, sv, signal, slots from f")
def p27_reception_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each station should hear in each of the next five minutes."""
    found = forecast.expected(sites(spark, sf_dir), orbits(spark, sf_dir), witnesses(spark, sf_dir), F.lit(_NOW))
    return found.select("audience", "observer", "gnss", "sv", "signal", "slots")


@query(_SQL + ", n as (select audience, observer, count(*) as n from f group by all) select audience, observer, coalesce(n, 0) as n_entries, coalesce(n, 0) <= 12 as available, coalesce(case when n <= 12 then (select string_agg(concat_ws(':', f.g, f.sv, coalesce(f.signal, -1), f.slots), ',' order by f.g, f.sv, f.signal nulls first) from f where f.observer = s.observer) end, '') as entries from s left join n using (audience, observer)")
def p27_forecast_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecasts as stations get them; those of more than twelve entries are unavailable."""
    places = sites(spark, sf_dir)
    found = forecast.forecasts(places, forecast.expected(places, orbits(spark, sf_dir), witnesses(spark, sf_dir), F.lit(_NOW)), F.lit(_NOW), 12)
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["gnss"], e["sv"], F.coalesce(e["signal"], F.lit(-1)), e["slots"])), ",")
    return found.select("audience", "observer", "n_entries", "available", text.alias("entries"))
