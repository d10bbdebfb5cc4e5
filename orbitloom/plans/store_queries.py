"""Scans, sinks, scopes and pages over the given tables, each with independently written SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitloom.operators import scope
from orbitloom.operators.joins import within
from orbitloom.operators.series import compacted
from orbitloom.operators.tables import event_stream, table, with_state
from orbitloom.plans.queries import said, t
from orbitloom.plans.registry import observations, registry
from orbitloom.sources import scans, sinks

QUERIES, SQL, query = registry()


@query(f"select event_id, {t('ts')} as ts, user_id, round(value, 6) as value, 0 as decoder_ver, null::varchar as remark from events")
def s1_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required columns typed, late ones by default."""
    rows = scans.typed(table(spark, sf_dir, "events"), {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "value": "double"}, {"decoder_ver": ("int", 0), "remark": ("string", None)})
    return rows.withColumn("ts", said("ts")).withColumn("value", F.round("value", 6))


@query("with $OBS select seq, gnss, station from obs where time >= timestamp '2024-01-05' and time < timestamp '2024-01-20' and gnss = 2")
def s2_replay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of one constellation in a half-open window, no more than a limit that fails loudly."""
    rows = observations(spark, sf_dir).select("seq", "gnss", "station", "time")
    return scans.replay(rows, "time", "2024-01-05", "2024-01-20", 1_000_000_000, gnss=2).select("seq", "gnss", "station")


_BUNDLES = "b as (select subject, audience, seq, time as event_time, time - interval 12 hour as window_start, time + interval 1 hour as window_end from stream where type = 'error'), s as (select b.audience, b.seq, b.event_time, m.seq as sample, m.time as sample_time, m.type as origin from b join stream m on m.subject = b.subject and m.type <> 'error' and m.time between b.window_start and b.window_end)"


def _bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = event_stream(spark, sf_dir)
    heads = events.filter("type = 'error'").select("subject", "audience", "seq", F.col("time").alias("event_time"))
    others = events.filter("type <> 'error'").select("subject", F.col("seq").alias("sample"), F.col("time").alias("sample_time"), F.col("type").alias("origin"))
    return heads, within(heads, others, "subject", "event_time", "sample_time", 43200, 3600).drop("subject")


@query(f"with $STREAM, {_BUNDLES} select s.audience, s.seq, b.subject, s.sample, s.origin from s join b on b.audience = s.audience and b.seq = s.seq and b.event_time = s.event_time")
def j1_evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied samples joined to the event that they explain."""
    heads, samples = _bundles(spark, sf_dir)
    return scans.evidence_inputs(heads, samples, ["audience", "seq", "event_time"]).select("audience", "seq", "subject", "sample", "origin")


@query(f"with $STREAM, {_BUNDLES} select sample, origin from s where seq = (select min(seq) from s)")
def s4_evidence_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the earliest event with evidence."""
    heads, samples = _bundles(spark, sf_dir)
    one = samples.agg(F.min("seq").alias("seq"))
    return scans.evidence_inputs(heads, samples, ["audience", "seq", "event_time"]).join(F.broadcast(one), "seq").select("sample", "origin")  # one row


@query(f"with $STREAM select seq, {t('time')} as time, type from stream where subject = 7 and type in ('error', 'view') and time >= timestamp '2024-01-03' and time <= timestamp '2024-01-25'")
def s5_station_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one station."""
    found = scans.station_events(event_stream(spark, sf_dir), "subject", "time", "type", 7, ["error", "view"], "2024-01-03", "2024-01-25")
    return found.select("seq", said("time"), "type")


@query("with $OBS, r as (select *, case when k % 10 = 0 then null else 's' || (station % 7) end as session, seq % 2500 as number from obs), d as (select min(seq) as seq from r where session is not null and number >= 500 group by session, number union all select seq from r where session is null) select seq from d")
def k1_unclaimed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that no claim holds, once each; those without a session always."""
    rows = observations(spark, sf_dir).select("seq", F.when(F.col("k") % 10 != 0, F.concat(F.lit("s"), F.col("station") % 7)).alias("session"), (F.col("seq") % 2500).alias("number"))
    claims = rows.filter("number < 500 and session is not null").select("session", "number").distinct()
    return sinks.fresh(rows, claims, ["session", "number"], ["seq"]).select("seq")


@query("select endpoint, audience, data from (select 'nation' as endpoint, 'aud' || (n_nationkey % 3) as audience, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as data from nation union all select 'supplier', 'aud' || (s_suppkey % 3), '{\"s_suppkey\":' || s_suppkey || '}' from supplier)")
def k3_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds as rows of JSON by audience."""
    nation, supplier = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select("s_suppkey")
    by = lambda c: F.concat(F.lit("aud"), F.col(c) % 3)
    at = F.lit("2024-01-01").cast("timestamp")
    return sinks.snapshot({"nation": nation}, by("n_nationkey"), at).unionByName(sinks.snapshot({"supplier": supplier}, by("s_suppkey"), at)).select("endpoint", "audience", "data")


@query("select type, count(*) as n, min(day)::varchar as oldest from (select event_type as type, ts::date as day from events) where type = 'error' or day >= date '2024-01-23' group by 1")
def k5_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of the last week; events (errors) are kept for ever."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("ts").cast("date").alias("day"))
    now = F.lit("2024-01-30").cast("date")
    kept = sinks.retained(rows.filter("type <> 'error'"), "day", now, 7).unionByName(sinks.retained(rows.filter("type = 'error'"), "day", now, None))
    return kept.groupBy("type").agg(F.count("*").alias("n"), F.min("day").cast("string").alias("oldest"))


@query("with $OBS, k as (select station % 60 as source, gnss as session, seq from obs where time >= timestamp '2024-01-28'), s as (select station % 60 as source, gnss as session, min(time) as first_seen from obs group by all) select source, session, first_seen >= timestamp '2024-01-28' as young from s where first_seen >= timestamp '2024-01-28' or exists (select 1 from k where k.source = s.source and k.session = s.session)")
def k6_ledger_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that stay in the ledger."""
    rows = observations(spark, sf_dir).select((F.col("station") % 60).alias("source"), F.col("gnss").alias("session"), F.col("time").alias("seen_at"))
    sessions = rows.groupBy("source", "session").agg(F.min("seen_at").alias("first_seen"))
    cutoff = F.lit("2024-01-28").cast("timestamp")
    _, kept = sinks.pruned(rows, sessions, ["source", "session"], cutoff)
    return kept.select("source", "session", (F.col("first_seen") >= cutoff).alias("young"))


@query("with $STREAM, l as (select *, lag(state) over (partition by subject order by time, seq) as before from stream) select 'assessment' as kind, '{\"kind\":\"assessment\",\"seq\":' || seq || ',\"state\":\"' || state || '\"}' as line from l where before is distinct from state union all select 'event', '{\"kind\":\"event\",\"seq\":' || seq || ',\"type\":\"error\"}' from stream where type = 'error'")
def k7_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes and error events as JSON lines."""
    events = event_stream(spark, sf_dir)
    changes = compacted(with_state(events), "subject", "time", "state").select("time", "seq", "state")
    lines = sinks.timeline(changes.drop("time").withColumn("at", F.lit(0)), events.filter("type = 'error'").select("seq", "type").withColumn("at", F.lit(0)), "at")
    return lines.select("kind", F.regexp_replace("line", ',"at":0', "").alias("line"))


@query("select p_partkey, '******** Week ' || ((2200 + p_partkey % 60 + cast(floor((61440 * (p_size % 9) + p_size * 86400 - 300000) / 604800.0) as bigint)) % 1024) || ' almanac for PRN-' || lpad((p_partkey % 32 + 1)::varchar, 2, '0') || ' ********' as head, 'Health:                     ' || lpad((p_size % 32 + case when p_size >= 32 then 32 else 0 end)::varchar, 3, '0') as health, 'SQRT(A)  (m 1/2):           ' || printf('%.6f', 5153.0::double + p_size) as axis, 'week:                       ' || ((2200 + p_partkey % 60) % 1024) as week from part")
def k8_almanac_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Almanac blocks; some of their lines beside the SQL's (whole blocks: tests)."""
    zero = F.lit(0.0)
    p, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (p % 32 + 1).alias("sv"), size.alias("health"), (size / 5000).alias("e"), (61440 * (size % 9)).alias("toa"), zero.alias("inclination"), zero.alias("node_rate"), (size + 5153.0).alias("sqrt_a"),
        zero.alias("node"), zero.alias("perigee"), zero.alias("anomaly"), zero.alias("af0"), zero.alias("af1"), (p % 60 + 2200).alias("week"), (-size * 86400 + 300000).alias("at"),
    )
    lines = rows.select("p_partkey", F.split(sinks.almanac_text(F.lit(0)), "\n").alias("l"))
    return lines.select("p_partkey", F.col("l")[0].alias("head"), F.col("l")[2].alias("health"), F.col("l")[7].alias("axis"), F.col("l")[13].alias("week"))


@query(f"with $STREAM select seq as id, {t('time')} as time, type, severity from stream where audience = 0")
def b2_public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the public audience under their public name."""
    return event_stream(spark, sf_dir).filter("audience = 0").select(F.col("seq").alias("id"), said("time"), "type", "severity")


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), k % 20).alias("collector"), seg.alias("organization"), F.when(k % 11 != 0, F.array(F.concat(F.lit("g"), k % 4), F.concat(F.lit("g"), k % 6))).alias("collections"), (F.col("c_acctbal") > 0).alias("public"))


@query("select c_custkey, c_custkey % 20 = 3 as operator, c_mktsegment = 'BUILDING' as organization, c_custkey % 11 <> 0 and (c_custkey % 4 = 1 or c_custkey % 6 = 1) as collection, c_acctbal > 0 as public, false as nameless from customer")
def b4_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which audiences may use a row."""
    ask = {"operator": scope.allows("operator", F.lit("c3")), "organization": scope.allows("organization", F.lit("BUILDING")), "collection": scope.allows("collection", F.lit("g1")), "public": scope.allows("public"), "nameless": scope.allows("organization", F.lit(""))}
    return _contexts(spark, sf_dir).select("c_custkey", *[c.alias(n) for n, c in ask.items()])


@query("with $STREAM, f as (select * from stream where subject = 5 and type = 'view' and time between timestamp '2024-01-01' and timestamp '2024-01-31' and strlen(body) <= 65536), p as (select seq, row_number() over (order by time, seq) as place, count(*) over () as n from f) select seq, place, n > 5 as has_more from p where place <= 5")
def b5_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of one station's history of a kind."""
    rows = scans.station_events(event_stream(spark, sf_dir), "subject", "time", "type", 5, ["view"], "2024-01-01", "2024-01-31")
    return scope.page(rows, [F.col("time"), F.col("seq")], 5).select("seq", F.col("place").cast("long").alias("place"), "has_more")


_CANON = "case when gnss = 0 and sig in (4, 7) then sig - 1 when gnss = 2 and sig in (1, 4, 6) then sig - 1 when gnss = 3 and sig in (1, 3, 6) then sig - 1 when gnss = 3 and sig = 7 then 8 when gnss = 5 and sig in (5, 9) then sig - 1 else sig end"


@query(f"with $OBS, c as (select *, gnss || ':' || ({_CANON}) as band from obs) select seq, case when k % 3 = 0 then 'o' || (station % 30) else 'anonymous' end as source, case when k % 3 = 0 then round(value, 6) end as value, null::bigint as k, band in ('0:0', '2:0', '3:8') as named from c where type <> 'signup' and station % 5 <> 0 and k % 3 <> 2 and (band in ('0:0', '2:0', '3:8') or station % 7 = 0)")
def b6_public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as the public may have them."""
    k, s = F.col("k"), F.col("station")
    rows = observations(spark, sf_dir).withColumns({
        "board": F.col("type") == "signup", "public": s % 5 != 0, "use": F.when(k % 3 == 0, "attributed").when(k % 3 == 1, "anonymous").otherwise("private"), "grants": F.when(s % 7 != 0, F.array(F.lit("0:0"), F.lit("2:0"), F.lit("3:8"))),
        "source": F.concat(F.lit("x"), s), "observer": F.concat(F.lit("o"), s % 30), "declared": F.array(F.lit("0:0")), "band": scope.selector(F.col("gnss"), F.col("sig")),
    })
    return scope.public_rows(rows, ["k"], ["value"]).select("seq", "source", F.round("value", 6).alias("value"), "k", F.col("band").isin("0:0", "2:0", "3:8").alias("named"))


@query("select p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size % 3 || ':0', p_size % 4 || ':0', p_partkey % 5 || ':2'], lambda x: x in ('0:0', '1:0', '3:2', '2:0')))), ',') as granted, array_to_string(list_sort(list_distinct([p_size % 3 || ':0', p_size % 4 || ':0', p_partkey % 5 || ':2'])), ',') as declared, case when p_size % 4 in (1, 2) then p_size % 4 || ':0' else '' end as both_name from part")
def b8_signal_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared signals inside a grant (B8), each once and sorted (U6), and those named by two policies."""
    declared = F.array(*[F.concat((c % m).cast("string"), F.lit(t_)) for c, m, t_ in ((F.col("p_size"), 3, ":0"), (F.col("p_size"), 4, ":0"), (F.col("p_partkey"), 5, ":2"))])
    one = F.array(F.concat((F.col("p_size") % 4).cast("string"), F.lit(":0")))
    lits = lambda *v: F.array(*[F.lit(x) for x in v])
    rows = table(spark, sf_dir, "part").withColumn("d", declared)
    return rows.select("p_partkey", F.array_join(scope.granted_only(F.col("d"), lits("0:0", "1:0", "3:2", "2:0")), ",").alias("granted"), F.array_join(scope.granted_only(F.col("d"), F.lit(None).cast("array<string>")), ",").alias("declared"), F.array_join(scope.both_allow(one, lits("1:0", "2:0")), ",").alias("both_name"))


@query("with $OBS select seq, coalesce(gnss = 6 or (gnss = 0 and sv between 1 and 32) or (gnss = 1 and sv >= 120) or (gnss = 2 and sv between 1 and 36) or (gnss = 3 and sv between 1 and 63) or (gnss = 5 and sv between 1 and 10) or (gnss = 7 and sv between 1 and 14), false) as valid, value > 0.5 and value <= 100 and k <> 50 as sane, k % 2 = 0 and k % 3 <> 0 and k % 5 <> 0 as carrier from obs")
def b10_valid_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellite numbers in range (B10); observations within bounds, carriers demoted, not dropped."""
    k, v = F.col("k"), F.col("value")
    tow = F.when(k == 50, F.lit(604800.0)).otherwise(k * 60.0)
    sane = scope.sane(tow, F.when(v > 0.5, v * 1e7).otherwise(F.lit(-1.0)), v * 10.0)
    return observations(spark, sf_dir).select("seq", scope.signals.number_in_range(F.col("gnss"), F.col("sv")).alias("valid"), sane.alias("sane"), scope.carrier_valid(k % 2 == 0, k % 3 != 0, k % 5 == 0, v).alias("carrier"))


@query("with $OBS, a as (select seq, gnss, (k - 10) * 3000 as age, station % 2 = 0 as late, case when k >= 5 then (k - 10) * 60 end as fetched from obs) select seq, case when age >= (case when gnss = 6 then -900 else -7200 end) and age <= (case when gnss = 6 then 1800 else 14400 end) then 'fit' when late and age > 0 and age <= (case when gnss = 6 then 172800 else 259200 end) then 'coast' else 'none' end as orbit, case when fetched is null then 'unavailable' when fetched < 0 or fetched > 2100 then 'delayed' else 'current' end as catalogue from a")
def b13_reference_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reference orbits may place a satellite, and how current the catalogue is."""
    k = F.col("k")
    return observations(spark, sf_dir).select("seq", scope.orbit_status(F.col("gnss"), (k - 10) * 3000, F.col("station") % 2 == 0).alias("orbit"), scope.catalogue_status(F.when(k >= 5, (k - 10) * 60)).alias("catalogue"))


@query("with $OBS select seq, gnss, sv from obs where gnss in (0, 2, 3, 6) and sig = 0 and k >= 12")
def b16_power_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may train power: satellite level, configured constellations, elevation (k) at least 2 degrees over the mask of 10."""
    return observations(spark, sf_dir).filter(F.col("gnss").isin(0, 2, 3, 6) & (F.col("sig") == 0) & F.col("k").isNotNull() & (F.col("k") >= 10 + 2)).select("seq", "gnss", "sv")


@query("with $STREAM, r as (select subject, type, seq, row_number() over (partition by subject, type order by time desc, seq desc) as place, count(*) over (partition by subject, type) as n from stream) select subject, type, seq, place, n > 4 as overflow from r where place <= 4")
def l4_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest four of each subject and type, with a flag that there are more."""
    done = scope.top_n(event_stream(spark, sf_dir).select("subject", "type", "time", "seq"), ["subject", "type"], [F.desc("time"), F.desc("seq")], 4)
    return done.select("subject", "type", "seq", F.col("place").cast("long").alias("place"), "overflow")


@query("with $STREAM, o as (select *, case when seq % 5 = 0 then null else seq * 7 % 10007 end as receipt from stream) select seq, row_number() over (partition by subject order by receipt nulls first, case when receipt is null then time end nulls first, seq) as place from o")
def l1_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each receipt of a station: those without a number first, by their stamps."""
    rows = event_stream(spark, sf_dir).withColumn("receipt", F.when(F.col("seq") % 5 != 0, F.col("seq") * 7 % 10007))
    order = scans.receipt_order("receipt", "time", "seq")
    return rows.select("seq", F.row_number().over(Window.partitionBy("subject").orderBy(*order, "seq")).cast("long").alias("place"))


@query("with $STREAM, e as (select *, time::date as tick from stream where type <> 'view') select seq, row_number() over (partition by tick order by subject, type, body, seq) as place from e")
def l5_tick_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of an event within its tick, by subject, type and message."""
    rows = event_stream(spark, sf_dir).filter("type <> 'view'")
    return rows.select("seq", F.row_number().over(Window.partitionBy(F.to_date("time")).orderBy("subject", "type", "body", "seq")).cast("long").alias("place"))
