"""Checks, alarms, picks, quorums, matches and coverage over the given tables, each with independently written SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitloom.functions import grades
from orbitloom.functions.atmosphere import log_pressure_rate
from orbitloom.operators import checks, coverage, joins, scope, series
from orbitloom.operators.epochs import deferrals
from orbitloom.operators.tables import event_stream, table, with_state
from orbitloom.plans.queries import said, t
from orbitloom.plans.registry import observations, registry

QUERIES, SQL, query = registry()
_DEALS = 16  # fixed value: tasks that the observations of one nation or segment are dealt to
_DAY = 86400


@query("with $STREAM, n as (select max(time) as now from stream) select count(distinct subject) as live from stream, n where type in ('view', 'error') and time >= now - interval 12 hour")
def a3_live_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations heard by either kind within twelve hours of the newest row."""
    events = event_stream(spark, sf_dir)
    now = F.broadcast(events.agg(F.max("time").alias("now")))  # one row
    heard = events.filter("type = 'view'").unionByName(events.filter("type = 'error'"))
    return heard.join(now, F.col("time") >= F.expr("now - interval 12 hours")).agg(F.count_distinct("subject").alias("live"))


@query("with $STREAM, n as (select max(time) as now from stream) select subject, round((epoch_us(any_value(now)) - epoch_us(max(time) filter (where type <> 'signup'))) / 1e6, 3) as public_age, round((epoch_us(any_value(now)) - epoch_us(max(time))) / 1e6, 3) as private_age from stream, n group by 1")
def a4_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each station's newest row, for the public (without board rows) and in private."""
    events = event_stream(spark, sf_dir)
    now = F.broadcast(events.agg(F.unix_micros(F.max("time")).alias("now")))  # one row
    last = events.groupBy("subject").agg(F.max(F.when(F.col("type") != "signup", F.unix_micros("time"))).alias("p"), F.max(F.unix_micros("time")).alias("q"))
    return last.join(now).select("subject", F.round((F.col("now") - F.col("p")) / 1e6, 3).alias("public_age"), F.round((F.col("now") - F.col("q")) / 1e6, 3).alias("private_age"))


@query("with $OBS, c as (select gnss, time::date::varchar as day, count(*) filter (where k % 4 <> 0) as modeled, count(*) filter (where k % 4 <> 0 and value > 12) as anomalous from obs group by all) select *, modeled >= 20 as valid, modeled >= 20 and anomalous >= 5 and anomalous * 100 >= 30 * modeled as bad from c")
def a12_power_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power anomalies by constellation and day."""
    rows = observations(spark, sf_dir).withColumn("day", F.to_date("time").cast("string"))
    return checks.quorum(rows, ["gnss", "day"], F.col("k") % 4 != 0, F.col("value") > 12, 20, 5, 30)


_GRID = "s as (select s_suppkey, (s_suppkey * 37) % 111 - 55.0 as lat, (s_suppkey * 53) % 360 - 180.0 as lon, case when s_acctbal > 3000 then s_suppkey % 3 + 1 else 0 end as w from supplier), g as (select a.i * 10 - 85.0 as cell_lat, b.i * 10 - 175.0 as cell_lon from (select unnest(range(0, 18)) as i) a, (select unnest(range(0, 36)) as i) b), v as (select s_suppkey, w, cell_lat, cell_lon from s, g where sin(radians(lat)) * sin(radians(cell_lat)) + cos(radians(lat)) * cos(radians(cell_lat)) * cos(radians(cell_lon - lon)) >= cos(acos(6371000.0 * cos(radians(10)) / 26560000.0) - radians(10)))"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sats = table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 37) % 111 - 55.0).alias("lat"), ((k * 53) % 360 - 180.0).alias("lon"), F.when(F.col("s_acctbal") > 3000, k % 3 + 1).otherwise(0).alias("w"))
    return coverage.visible_cells(sats, F.lit(26560000.0), 10, 10)


@query(f"with {_GRID} select s_suppkey, cell_lat, cell_lon from v")
def j20_visible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that see each satellite."""
    return _seen(spark, sf_dir).select("s_suppkey", "cell_lat", "cell_lon")


_STATUS = f"{_GRID}, c as (select g.cell_lat, g.cell_lon, count(s_suppkey) as expected, count(*) filter (where w = 0) as missing, count(*) filter (where w = 1) as thin from g left join v using (cell_lat, cell_lon) group by all), z as (select *, case when expected = 0 then 'unknown' when (expected - missing) / expected < 0.5 then 'gap' when (expected - missing - thin) / expected < 0.8 then 'thin' else 'covered' end as status from c)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(18 * 36).select((F.floor(F.col("id") / 36) * 10 - 85.0).alias("cell_lat"), (F.col("id") % 36 * 10 - 175.0).alias("cell_lon"))
    return coverage.cell_status(_seen(spark, sf_dir), grid, F.col("w"), 2)


@query(f"with {_STATUS} select cell_lat, cell_lon, expected, missing, thin, status from z")
def p30_coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each cell."""
    return _cells(spark, sf_dir).select("cell_lat", "cell_lon", "expected", "missing", "thin", "status")


@query(f"with {_STATUS} select status, count(*) as cells, round(100 * sum(cos(radians(cell_lat))) / (select sum(cos(radians(cell_lat))) from z), 4) as percent from z group by 1")
def a14_coverage_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the earth's area by status."""
    return coverage.area_shares(_cells(spark, sf_dir)).withColumn("percent", F.round("percent", 4))


@query("with $STREAM, n as (select *, sum(case when type = 'error' then 1 else 0 end) over (partition by subject order by time, seq) as k from stream), g as (select subject, k, min(time) filter (where type = 'error') as a, min(time) filter (where type = 'purchase') as b, k = max(k) over (partition by subject) as last from n where k > 0 group by subject, k), o as (select case when epoch_us(b) - epoch_us(a) <= 3600000000 then 'immediate' when b is not null then 'completed' when last then 'unresolved' else 'superseded' end as outcome, (epoch_us(b) - epoch_us(a)) / 1e6 as lag from g), r as (select *, row_number() over (partition by outcome order by lag) as r, count(lag) over (partition by outcome) as n from o) "
       "select outcome, count(*) as cases, round(max(lag) filter (where r = least(greatest(cast(floor(n * 0.5 + 0.5) as bigint), 1), n)), 3) as p50, round(max(lag) filter (where r = least(greatest(cast(floor(n * 0.95 + 0.5) as bigint), 1), n)), 3) as p95 from r group by 1")
def a16_outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and nearest-rank lags of each outcome (lags are counted first, so that equal ones are one entry)."""
    each = deferrals(event_stream(spark, sf_dir), "subject", "time", F.col("type") == "error", F.col("type") == "purchase", 3600)
    lags = each.groupBy("outcome", "lag_s").agg(F.count("*").alias("n"))
    up = Window.partitionBy("outcome").orderBy("lag_s")
    ranked = lags.filter("lag_s is not null").withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("outcome"))})
    at = lambda p: F.least(F.greatest(F.floor(F.col("all") * p + 0.5), F.lit(1)), F.col("all"))
    rank = ranked.groupBy("outcome").agg(*[F.round(F.min(F.when(F.col("upto") >= at(p), F.col("lag_s"))), 3).alias(c) for c, p in (("p50", 0.5), ("p95", 0.95))])
    return lags.groupBy("outcome").agg(F.sum("n").alias("cases")).join(rank, "outcome", "left")


@query("with $OBS, r as (select station, seq, time, value as x, k * 1.0 as y, value - k as z, value / 10 as accuracy, sig + 4 as satellites from obs where type <> 'signup' and value < 40), c as (select *, case when epoch_us(time) - epoch_us(lag(time) over w) > 129600000000 then 1 else 0 end as cut from r window w as (partition by station order by time, seq)), s as (select *, sum(cut) over (partition by station order by time, seq) as seg from c) "
       "select station, count(*) as n, round(avg(x), 4) as x, round(avg(y), 4) as y, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 4) as dispersion, round(max(accuracy), 4) as accuracy, min(satellites) as satellites from s group by station, seg having count(*) >= 10 and epoch_us(max(time)) - epoch_us(min(time)) >= 259200000000")
def a18_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey candidates of each station."""
    rows = observations(spark, sf_dir).withColumns({"x": F.col("value"), "y": F.col("k").cast("double"), "z": F.col("value") - F.col("k"), "accuracy": F.col("value") / 10, "satellites": F.col("sig") + 4})
    done = checks.survey(rows, "station", "time", (F.col("type") != "signup") & (F.col("value") < 40), 1.5 * _DAY, 10, 3 * _DAY)
    return done.select("station", "n", *[F.round(c, 4).alias(c) for c in ("x", "y", "dispersion", "accuracy")], "satellites")


@query("with $OBS, r as (select station % 10 as source, case when gnss = 4 then 'constellation' when gnss = 0 and sv not between 1 and 32 then 'number' when value > 50 then 'range' end as reason from obs) select source, reason, count(*) as n from r where reason is not null group by all")
def a20_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected receipts by source and first reason."""
    g = F.col("gnss")
    reason = F.when(g == 4, "constellation").when((g == 0) & ~scope.signals.number_in_range(g, F.col("sv")), "number").when(F.col("value") > 50, "range")
    rows = observations(spark, sf_dir).select((F.col("station") % 10).alias("source"), reason.alias("reason"))
    return rows.filter("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query("with $STREAM select subject, time::date::varchar as day, round(median(value) filter (where type <> 'error'), 4) as median, round(case when count(value) filter (where type <> 'error') >= 2 then max(value) filter (where type <> 'error') - min(value) filter (where type <> 'error') end, 4) as spread from stream group by all")
def a22_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the healthy readings of a station's day, and their spread if there are two."""
    fine = F.when(F.col("type") != "error", F.col("value"))
    rows = event_stream(spark, sf_dir).groupBy("subject", F.to_date("time").cast("string").alias("day"))
    return rows.agg(F.round(F.median(fine), 4).alias("median"), F.round(F.when(F.count(fine) >= 2, F.max(fine) - F.min(fine)), 4).alias("spread"))


@query("with $OBS, w as (select gnss, sv, station % 20 as source, max(epoch_us(time)) as tm from obs group by all) select gnss, sv, count(*) as witnesses, string_agg(source, ',' order by tm desc, source desc) as sources from w group by all")
def a23_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources (at most as many as the fleet has) that witnessed each satellite, newest first."""
    newest = observations(spark, sf_dir).groupBy("gnss", "sv", (F.col("station") % 20).alias("source")).agg(F.max("time").alias("at"))
    listed = F.sort_array(F.collect_list(F.struct("at", "source")), asc=False)
    return newest.groupBy("gnss", "sv").agg(F.count("*").alias("witnesses"), F.array_join(F.transform(listed, lambda x: x["source"].cast("string")), ",").alias("sources"))


@query("with $OBS, h as (select gnss, sv, sig, k % 4 as code, station % 3 as level from obs) select gnss, sv, string_agg(distinct sig::varchar, ',' order by sig::varchar) as signals, case when bool_or(code = 3) then 'Do not use' when bool_or(code = 2 or level = 2) then 'Not OK' when bool_or(level = 1) then 'Warning' when bool_and(code = 1) then 'OK' when bool_or(code = 1) then 'Partly known' else 'Unknown' end as health from h group by all")
def a24_satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each satellite, and its worst health label."""
    rows = observations(spark, sf_dir).select("gnss", "sv", F.col("sig").cast("string").alias("sig"), (F.col("k") % 4).alias("code"), (F.col("station") % 3).alias("level"))
    c, v = F.col("code"), F.col("level")
    label = F.when(F.bool_or(c == 3), "Do not use").when(F.bool_or((c == 2) | (v == 2)), "Not OK").when(F.bool_or(v == 1), "Warning").when(F.bool_and(c == 1), "OK").when(F.bool_or(c == 1), "Partly known").otherwise("Unknown")
    return rows.groupBy("gnss", "sv").agg(F.array_join(F.array_sort(F.collect_set("sig")), ",").alias("signals"), label.alias("health"))


@query("with $STREAM, a as (select * from stream where subject % 2 = 0), b as (select * from stream where subject % 2 = 1), p as (select a.seq, b.seq as partner, round(abs(a.value - b.value), 4) as apart, row_number() over (partition by a.seq order by abs(epoch_us(a.time) - epoch_us(b.time)), b.seq) as r from a join b on b.subject = a.subject + 1 and abs(epoch_us(a.time) - epoch_us(b.time)) <= 7200000000) select seq, partner, apart, case when apart > 24 then 'unassured' when apart > 12 then 'inconsistent' else 'assured' end as state from p where r = 1")
def j7_baseline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partner epoch nearest in time for the first station of each pair, once, and the state of their baseline."""
    rows = event_stream(spark, sf_dir).withColumn("pair", F.floor(F.col("subject") / 2))
    a = rows.filter("subject % 2 = 0").select("pair", "seq", "time", "value")
    b = rows.filter("subject % 2 = 1").select("pair", F.col("seq").alias("partner"), F.col("time").alias("at"), F.col("value").alias("other"))
    found = joins.nearest(a, b, "pair", "time", "at", 7200, ["partner", "other"], "partner").withColumn("apart", F.round(F.abs(F.col("value") - F.col("other")), 4))
    return found.select("seq", "partner", "apart", grades.graded(F.col("apart"), F.lit(12.0), F.lit(24.0)).alias("state"))


@query("with $OBS, p as (select gnss, sv, station % 4 as iod, sig, arg_max(value, (time, seq)) as v from obs group by all), d as (select a.gnss, a.sv, a.iod, a.sig as s1, b.sig as s2, round(abs(a.v - b.v), 4) as d from p a join p b on a.gnss = b.gnss and a.sv = b.sv and a.iod = b.iod and a.sig < b.sig) select gnss, sv, iod, max(d) as worst, arg_max(s1 || '/' || s2, (d, -s1, -s2)) as pair, max(d) > 20 as divergent from d group by all")
def j11_cross_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst difference of two signals of one satellite with equal issue; signals are first reduced to one row each (nine at most)."""
    latest = observations(spark, sf_dir).withColumn("iod", F.col("station") % 4).groupBy("gnss", "sv", "iod", "sig").agg(F.max_by("value", F.struct("time", "seq")).alias("v"))
    a, b = latest.withColumnsRenamed({"sig": "s1", "v": "v1"}), latest.withColumnsRenamed({"sig": "s2", "v": "v2"})
    pairs = a.join(b, ["gnss", "sv", "iod"]).filter("s1 < s2").withColumn("d", F.round(F.abs(F.col("v1") - F.col("v2")), 4))
    return pairs.groupBy("gnss", "sv", "iod").agg(F.max("d").alias("worst"), F.max_by(F.concat_ws("/", F.col("s1").cast("string"), F.col("s2").cast("string")), F.struct("d", -F.col("s1"), -F.col("s2"))).alias("pair")).withColumn("divergent", F.col("worst") > 20)


@query("select c_custkey, s_suppkey as peer, case when c_acctbal < 0 then 'retention' when s_acctbal < 1000 then 'peer' end as reason from customer join supplier on s_suppkey % 2 = 0 and (s_nationkey = c_nationkey or (s_suppkey % 10 = 0 and c_mktsegment = 'BUILDING'))")
def j14_export_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations beside each export grant that names their nation or segment: an equi join by nation and one by segment that leaves the first one's
    pairs out, so no pair is made twice or shuffled. A nation or segment has many observations: they are dealt to _DEALS tasks, grants go to each."""
    deal = F.pmod(F.xxhash64("c_custkey"), F.lit(_DEALS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small file of observations makes many pairs, whichever join is chosen
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", deal.alias("deal")).repartition(tasks, "deal", "c_nationkey")
    k = F.col("s_suppkey")
    grants = table(spark, sf_dir, "supplier").filter(k % 2 == 0).select(k, "s_nationkey", "s_acctbal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALS - 1).cast("long"))).alias("deal"))
    same = F.col("s_nationkey") == F.col("c_nationkey")
    nation = rows.join(grants, (rows["deal"] == grants["deal"]) & same)
    named = grants.filter(k % 10 == 0).withColumn("segment", F.lit("BUILDING"))
    segment = rows.join(named, (rows["deal"] == named["deal"]) & (F.col("c_mktsegment") == F.col("segment")) & ~F.coalesce(same, F.lit(False))).drop("segment")
    both = nation.unionAll(segment)
    return both.select("c_custkey", k.alias("peer"), F.when(F.col("c_acctbal") < 0, "retention").when(F.col("s_acctbal") < 1000, "peer").alias("reason"))


@query("with $OBS, f as (select distinct station, gnss, time::date::varchar as day from obs where k % 3 <> 0), m as (select station, gnss, time::date::varchar as day, count(*) as heard from obs where type = 'view' group by all) select station, gnss, day, coalesce(heard, 0) as heard, heard is null as missing from f left join m using (station, gnss, day)")
def j15_reception_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast entries against what the station heard in the slot."""
    rows = observations(spark, sf_dir).withColumn("day", F.to_date("time").cast("string"))
    keys = ["station", "gnss", "day"]
    heard = rows.filter("type = 'view'").groupBy(*keys).agg(F.count("*").alias("heard"))
    done = rows.filter("k % 3 <> 0").select(*keys).distinct().join(heard, keys, "left")
    return done.select(*keys, F.coalesce("heard", F.lit(0)).alias("heard"), F.col("heard").isNull().alias("missing"))


@query("with $OBS, m as (select gnss, sig, median(value) as expected from obs group by all), d as (select gnss, sig, any_value(expected) as expected, median(abs(value - expected)) as mad from obs join m using (gnss, sig) group by all), c as (select seq, abs(value - expected) >= greatest(2 * mad, 6) as r, abs(value - expected - 1) >= greatest(2 * mad, 6) as l, k % 5 <> 0 as rv, k % 7 <> 0 as lv from obs join d using (gnss, sig)) select seq, r as remote_bad, l as local_bad, rv and lv as joint_valid, rv and lv and r and l as joint_bad, rv and lv and r <> l as conflict from c")
def j16_power_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received power against the cell's median and spread (J16), joined with a second assessment."""
    rows = observations(spark, sf_dir)
    middle = rows.groupBy("gnss", "sig").agg(F.median("value").alias("expected"))
    spread = rows.join(middle, ["gnss", "sig"]).groupBy("gnss", "sig", "expected").agg(F.median(F.abs(F.col("value") - F.col("expected"))).alias("mad"))
    limit = F.greatest(2 * F.col("mad"), F.lit(6.0))
    both = rows.join(spread, ["gnss", "sig"])
    remote, local = F.abs(F.col("value") - F.col("expected")) >= limit, F.abs(F.col("value") - F.col("expected") - 1) >= limit
    verdict = checks.joint_verdict(F.col("k") % 5 != 0, remote, F.col("k") % 7 != 0, local)
    return both.select("seq", remote.alias("remote_bad"), local.alias("local_bad"), *[c.alias(n) for n, c in verdict.items()])


@query("with $STREAM, p as (select a.seq, b.seq as start, a.value as v2, b.value as v1, (epoch_us(a.time) - epoch_us(b.time)) / 1e6 as age from stream a join stream b on a.subject = b.subject and epoch_us(a.time) - epoch_us(b.time) between 21600000000 and 64800000000), r as (select *, row_number() over (partition by seq order by abs(age - 43200), start) as r from p) select seq, start, round(ln((v2 + 1000) / (v1 + 1000)) / age * 1e9, 3) as rate from r where r = 1")
def j22_pressure_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older sample whose age is nearest to half a day (within six hours), and the rate of the logarithm since."""
    rows = event_stream(spark, sf_dir)
    ends = rows.select("subject", "seq", "time", F.col("value").alias("v2"), F.expr("time - interval 12 hours").alias("aim"))
    starts = rows.select("subject", F.col("seq").alias("start"), F.col("time").alias("at"), F.col("value").alias("v1"))
    best = joins.nearest(ends, starts, "subject", "aim", "at", 21600, ["start", "v1"], "start")
    rate = log_pressure_rate(F.col("v1") + 1000, F.col("v2") + 1000, (F.unix_micros("time") - F.unix_micros("at")) / 1e6)
    return best.select("seq", "start", F.round(rate * 1e9, 3).alias("rate"))


@query("with $OBS, r as (select *, row_number() over (partition by gnss, sv, station % 5 order by k % 2 desc, k % 7 desc, time desc, seq desc) as r from obs where value < 60) select gnss, sv, station % 5 as source, seq from r where r = 1")
def w4_almanac_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best almanac of each satellite and source: exact weeks before resolved ones, then newer references, then newer receipts; those outside validity are ignored."""
    rows = observations(spark, sf_dir).filter("value < 60").withColumns({"source": F.col("station") % 5, "exact": F.col("k") % 2, "toa": F.col("k") % 7})
    return checks.newest(rows.select("gnss", "sv", "source", "seq", "exact", "toa", "time"), ["gnss", "sv", "source"], ["exact", "toa", "time", "seq"]).select("gnss", "sv", "source", "seq")


@query("with $OBS, l as (select gnss, sv, sig, max(time) as tm, arg_max(value, (time, seq)) as v from obs group by all), r as (select *, row_number() over (partition by gnss, sv order by sig) as r from l where tm >= timestamp '2024-01-20') select gnss, sv, sig, round(v, 6) as value from r where r = 1")
def w5_primary_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest signal of each satellite with a fresh position."""
    latest = observations(spark, sf_dir).groupBy("gnss", "sv", "sig").agg(F.max("time").alias("at"), F.max_by("value", F.struct("time", "seq")).alias("value"))
    return checks.newest(latest.filter("at >= '2024-01-20'"), ["gnss", "sv"], [-F.col("sig")]).select("gnss", "sv", "sig", F.round("value", 6).alias("value"))


@query("with $OBS, r as (select *, row_number() over (partition by gnss, sv, station % 5 order by time desc, k desc, sig, seq desc) as r from obs where time >= timestamp '2024-01-15') select gnss, sv, station % 5 as source, sig, seq from r where r = 1")
def w6_best_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest delay of each satellite and source, then the newest epoch, then the lowest signal."""
    rows = observations(spark, sf_dir).filter("time >= '2024-01-15'").select("gnss", "sv", (F.col("station") % 5).alias("source"), "sig", "seq", "time", "k")
    return checks.newest(rows, ["gnss", "sv", "source"], [F.col("time"), F.col("k"), -F.col("sig"), F.col("seq")]).select("gnss", "sv", "source", "sig", "seq")


@query("with $STREAM, l as (select seq, subject, value, lag(value) over (partition by subject order by time, seq) as before from stream) select seq, subject, round(before - value, 4) as fell from l where before - value >= 10")
def w10_changeovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at which a served age fell by at least ten."""
    fell = F.lag("value").over(Window.partitionBy("subject").orderBy("time", "seq")) - F.col("value")
    return event_stream(spark, sf_dir).withColumn("fell", fell).filter("fell >= 10").select("seq", "subject", F.round("fell", 4).alias("fell"))


@query("with $STREAM, s as (select *, epoch_us(time) as us, value - lag(value) over w - (epoch_us(time) - epoch_us(lag(time) over w)) / 1e6 * (severity * 1e-4::double + lag(severity) over w * 1e-4::double) / 2 as r from stream window w as (partition by subject order by time, seq)), a as (select *, case when round(r / 20) <> 0 and abs(r - 20 * round(r / 20)) <= 2 then r - 20 * round(r / 20) else coalesce(r, 0) end as x from s), b as (select a.seq, max(p.us) as base from a left join a p on p.subject = a.subject and a.us - p.us between 86400000000 and 172800000000 group by 1) "
       "select a.seq, round(case when b.base is not null then (select sum(x) from a p where p.subject = a.subject and p.us > b.base and p.us <= a.us) end, 3) as departure from a join b using (seq)")
def w12_bias_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the step residuals, less whole jumps, since a base one to two days ago."""
    rows = event_stream(spark, sf_dir).withColumn("drift", F.col("severity") * F.lit(1e-4))
    return checks.bias_drift(rows, "subject", "time", "value", "drift", 20.0, 2.0, _DAY, 2 * _DAY).select("seq", F.round("departure", 3).alias("departure"))


@query("with $STREAM, p as (select a.seq, a.value as v2, b.value as v1, (epoch_us(a.time) - epoch_us(b.time)) / 1e6 as dt, row_number() over (partition by a.seq order by b.time desc, b.seq desc) as r from stream a join stream b on a.subject = b.subject and epoch_us(a.time) - epoch_us(b.time) between 86400000000 and 172800000000) select s.seq, case when r is null then 'unavailable' when abs(v2 - v1) / dt > 2e-4 then 'unassured' when abs(v2 - v1) / dt > 1e-4 then 'inconsistent' else 'assured' end as state, round(abs(v2 - v1) / dt * 1e6, 3) as rate from stream s left join (select * from p where r = 1) p using (seq)")
def w13_drift_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate over a base one to two days ago, and its state."""
    rows = checks.from_base(event_stream(spark, sf_dir), "subject", "time", ["value"], _DAY, 2 * _DAY)
    rate = F.abs(F.col("value") - F.col("base.value")) / ((F.unix_micros("time") - F.unix_micros("base.time")) / 1e6)
    return rows.select("seq", grades.graded(rate, F.lit(1e-4), F.lit(2e-4)).alias("state"), F.round(rate * 1e6, 3).alias("rate"))


@query("with $STREAM, c as (select *, case when epoch_us(time) - epoch_us(lag(time) over w) > 129600000000 then 1 else 0 end as cut from stream window w as (partition by subject order by time, seq)), s as (select *, sum(cut) over (partition by subject order by time, seq) as seg from c), m as (select a.seq, any_value(a.value) as value, any_value(a.severity) as acc, count(*) as n, avg(b.value) as mean from s a join s b on a.subject = b.subject and a.seg = b.seg and epoch_us(a.time) - epoch_us(b.time) between 0 and 432000000000 group by 1), "
       "g as (select seq, n, case when n >= 6 then mean end as mean, value, greatest(least(3.0 * acc, 30), 10) as i, greatest(least(6.0 * acc, 60), 25) as u from m) select seq, n as epochs, round(mean + 1e-7, 4) as mean, case when value > u or mean > 14 then 'unassured' when value > i or mean > 9 then 'inconsistent' else 'assured' end as state from g")
def w14_fixed_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instantaneous and mean offset of a fixed station."""
    rows = checks.mean_offset(event_stream(spark, sf_dir), "subject", "time", "value", 5 * _DAY, 1.5 * _DAY, 6)
    state = checks.fixed_position(F.col("value"), F.col("severity").cast("double"), F.col("mean"), (3, 6), (10, 30), (25, 60), (9, 14))
    return rows.select("seq", "epochs", F.round(F.col("mean") + 1e-7, 4).alias("mean"), state.alias("state"))


@query("with $STREAM, r as (select seq, subject, time, epoch_us(time) / 1e6 / 86400 as d, value as v, value - lag(value) over (partition by subject order by time, seq) as s from stream), u as (select seq, subject, d - first_value(d) over w as d, sum(coalesce(s - 10 * round_even(s / 10, 0), v)) over w as ph from r window w as (partition by subject order by time, seq)), f as (select a.seq, a.d, a.ph, count(b.seq) as n, regr_slope(b.ph, b.d) as m, avg(b.d) as md, avg(b.ph) as mp from u a left join u b on a.subject = b.subject and a.d - b.d between 1 and 6 group by all) select seq, n as fitted, round(case when n >= 4 then ph - mp - m * (d - md) end, 3) as residual from f")
def w16_phase_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual of an unwrapped phase from the line through samples one to six days old."""
    done = checks.line_residual(event_stream(spark, sf_dir), "subject", "time", "value", 10.0, _DAY, 6 * _DAY, 4)
    return done.select("seq", "fitted", F.round("residual", 3).alias("residual"))


@query("with $STREAM, l as (select type, time::date as tm, subject % 12 as signal, round(avg(value) + any_value(day(time)) % 4 * 6, 6) as level from stream group by all), s as (select distinct type, tm from l), b as (select s.type, s.tm, min(p.tm) as was from s left join s p on p.type = s.type and s.tm - p.tm between 3 and 5 group by all), d as (select b.type, b.tm, p.level - n.level as d from b join l n on n.type = b.type and n.tm = b.tm left join l p on p.type = b.type and p.tm = b.was and p.signal = n.signal), g as (select type, tm, count(d) as signals, min(d) as least, median(d) as med from d group by all) "
       "select type, tm::varchar as day, signals, round(med, 4) as median_drop, case when signals < 6 then 'unavailable' when least >= -6 and med >= 3 then 'unassured' when least >= -6 and med >= 1 then 'inconsistent' else 'assured' end as state from g")
def w17_simultaneous_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop of all signals of a day's snapshot since the oldest one three to five days ago."""
    day = F.to_date("time")
    levels = event_stream(spark, sf_dir).groupBy("type", day.cast("timestamp").alias("at"), (F.col("subject") % 12).alias("signal")).agg(F.round(F.avg("value") + F.first(F.dayofmonth("time")) % 4 * 6, 6).alias("level"))
    done = checks.simultaneous_drop(levels, "type", "at", "signal", "level", 3 * _DAY, 5 * _DAY, 6, -6.0, 1.0, 3.0)
    return done.select("type", F.date_format("at", "yyyy-MM-dd").alias("day"), "signals", F.round("median_drop", 4).alias("median_drop"), "state")


@query(f"with $STREAM, r as (select *, sum(case when state = 'ok' then 1 else 0 end) over (partition by subject order by time, seq) as run from stream) select seq, {t('min(time) over (partition by subject, run)')} as since from r where state <> 'ok'")
def w22_departed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows away from the baseline, with the begin of their run."""
    return checks.departed_since(with_state(event_stream(spark, sf_dir)), "subject", "time", F.col("state") != "ok").select("seq", said("since"))


@query("with $STREAM, s as (select *, subject || '-' || (seq // 4000) as session from stream), l as (select subject, arg_max(session, (time, seq)) as session from s group by 1) select subject, type, max(seq) as seq from s join l using (subject, session) group by all")
def w25_board_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each kind within a station's latest session."""
    rows = event_stream(spark, sf_dir).withColumn("session", F.concat_ws("-", F.col("subject").cast("string"), F.floor(F.col("seq") / 4000).cast("string"))).select("subject", "type", "session", "time", "seq")
    return checks.in_session(rows, "subject", "type", "session", ["time", "seq"]).select("subject", "type", "seq")


@query("with recursive $STREAM, r as (select seq, subject, epoch_us(time) / 1e6 as tm, case when type = 'signup' then -1 when value > 8 then 1 else 0 end as want, row_number() over (partition by subject order by time, seq) as i from stream), "
       "f as (select subject, seq, tm, i, want, case when want >= 0 and want <> 0 then tm end as since, 0 as alarm from r where i = 1 union all select n.subject, n.seq, n.tm, n.i, n.want, "
       "case when n.want < 0 or n.want = f.alarm then null when n.tm - coalesce(case when n.tm - f.tm <= 86400 and f.want = n.want then f.since end, n.tm) >= (case when n.want = 1 then 43200 else 86400 end) then null else coalesce(case when n.tm - f.tm <= 86400 and f.want = n.want then f.since end, n.tm) end, "
       "case when n.want >= 0 and n.want <> f.alarm and n.tm - coalesce(case when n.tm - f.tm <= 86400 and f.want = n.want then f.since end, n.tm) >= (case when n.want = 1 then 43200 else 86400 end) then n.want else f.alarm end from f join r n on n.subject = f.subject and n.i = f.i + 1) select seq, alarm = 1 as alarm from f")
def t7_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarm of a station with different dwells for onset and clear, kept through unknown rows (the SQL steps the machine row by row)."""
    known = F.col("type") != "signup"
    return checks.alarms(event_stream(spark, sf_dir), "subject", "time", known, F.col("value") > 8, 43200, 86400, 86400).select("seq", "alarm")


@query("with $OBS, o as (select seq, station, epoch_us(time) - k * 3600000000 as stamp from obs), s as (select *, max(stamp) over (partition by station order by seq rows between unbounded preceding and 1 preceding) as m from o) select seq, station from s where m is null or stamp >= m")
def t12_stale_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts in order whose stamp is not older than what was applied."""
    rows = observations(spark, sf_dir).withColumn("stamp", F.unix_micros("time") - F.col("k") * 3600000000)
    return checks.not_stale(rows, "station", ["seq"], "stamp").select("seq", "station")


@query("with $STREAM, n as (select max(time) as now from stream), l as (select subject, type, max(time) as tm from stream group by all) select subject, type, case when now - tm <= case type when 'view' then interval 12 hour when 'error' then interval 1 day else interval 3 day end then 'kept' else 'expired' end as fate from l, n")
def t10_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each kind that outlive its age limit."""
    events = event_stream(spark, sf_dir)
    now = F.broadcast(events.agg(F.max("time").alias("now")))  # one row
    limit = F.when(F.col("type") == "view", _DAY // 2).when(F.col("type") == "error", _DAY).otherwise(3 * _DAY)
    latest = events.groupBy("subject", "type").agg(F.max("time").alias("at")).join(now)
    return latest.select("subject", "type", F.when((F.unix_micros("now") - F.unix_micros("at")) / 1e6 <= limit, "kept").otherwise("expired").alias("fate"))


@query("with $OBS, v as (select gnss, case when seq % 5 <> 0 then floor(value * 2) / 2 end as value from obs), r as (select *, row_number() over (partition by gnss order by value) as k, count(value) over (partition by gnss) as n from v where value is not null) select v.gnss, count(v.value) as n, any_value(r50.value) as p50, any_value(r95.value) as p95, max(v.value) as largest, count(*) - count(v.value) as absent, round(100 * count(*) filter (where v.value >= 10) / count(v.value), 6) as share1, round(100 * count(*) filter (where v.value >= 25.5) / count(v.value), 6) as share2 from v join r r50 on r50.gnss = v.gnss and r50.k = least(greatest(floor(r50.n * 50 / 100 + 0.5), 1), r50.n) join r r95 on r95.gnss = v.gnss and r95.k = least(greatest(floor(r95.n * 95 / 100 + 0.5), 1), r95.n) group by 1")
def a15_discontinuities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps by constellation: percentiles, the largest, absent ones and the shares that reach two limits."""
    rows = observations(spark, sf_dir).select("gnss", F.when(F.col("seq") % 5 != 0, F.floor(F.col("value") * 2) / 2).alias("value"))
    return series.nearest_rank(rows, "gnss", "value", [50, 95], [10, 25.5])
