"""Queries over the given tables, built from the operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.functions import geodesy as G
from orbitloom.operators import history, joins, series
from orbitloom.operators.tables import STREAM_SQL, event_stream, table, with_state
from orbitloom.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$STREAM", STREAM_SQL)
        return f

    return add


def said(c: str | Column, name: str | None = None) -> Column:
    """A time as text, the same in every session time zone."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or str(c))


_T = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def t(c: str) -> str:
    return _T.format(c)


@query(f"with $STREAM, f as (select * from stream where severity >= 1 and type in ('error','purchase')) select audience, seq, {t('time')} as time, subject, type, severity, count(*) over (partition by audience) as total from f")
def b1_event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.search(event_stream(spark, sf_dir), ["error", "purchase"], 1)
    return found.select("audience", "seq", said("time"), "subject", "type", "severity", "total")


@query(f"with $STREAM, f as (select * from stream where severity >= 1), p as (select * from f order by time desc, seq desc limit 50 offset 100) select n.total, p.audience, p.seq, {t('p.time')} as time, p.severity from (select count(*) as total from f) n left join p on true")
def b1_event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page(history.search(event_stream(spark, sf_dir), None, 1).drop("total"), 50, 100).select("total", "audience", "seq", said("time"), "severity")


@query("with $STREAM, f as (select * from stream where severity >= 1) select count(*) as total, null::bigint as seq from f")
def b1_page_beyond_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_stream(spark, sf_dir).filter("severity >= 1")
    end = max(100_000, found.count())  # no fixed offset lies beyond the end of every table
    return history.page(found, 50, end, end).select("total", "seq")


@query("with $STREAM, c as (select audience, max(seq) - 100 as last_seq from stream group by 1) select audience, count(*) filter (where seq > last_seq) as waiting, min(seq) filter (where seq > last_seq) as next_seq, not bool_or(seq = last_seq) as gap from stream join c using (audience) group by 1")
def b3_event_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    return history.resume(events, events.groupBy("audience").agg((F.max("seq") - 100).alias("last_seq")))


@query("with f as (select event_id, 'org:o' || (user_id % 5) as private_audience from events where user_id % 5 <> 0 union all select event_id, 'col:c' || (user_id % 3) from events union all select event_id, 'col:' || event_type from events) select private_audience, count(*) as n, min(event_id) as first_id from f group by 1")
def b14_audience_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    organization = F.when(F.col("user_id") % 5 == 0, "local-unassigned").otherwise(F.concat(F.lit("o"), (F.col("user_id") % 5).cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", organization.alias("organization"), F.array(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")), F.col("event_type")).alias("collections"))
    return history.fan_out(rows, "organization", F.col("collections")).groupBy("private_audience").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"with $STREAM, b as (select audience, min(time) + interval 10 day as start from stream group by 1) select audience, count(*) filter (where time >= start) as visible, count(*) filter (where time < start) as hidden, {t('min(time) filter (where time >= start)')} as effective_start from stream join b using (audience) group by 1")
def b15_visibility_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    bounds = events.groupBy("audience").agg((F.min("time") + F.expr("interval 10 days")).alias("start"))
    return history.clamp_visibility(events, bounds).select("audience", "visible", "hidden", said("effective_start"))


@query(f"with $STREAM select audience, type, count(*) as n, count(*) filter (where severity >= 2) as critical, count(*) filter (where severity >= 1) as warning, {t('max(time) filter (where severity >= 2)')} as last_critical from stream group by grouping sets ((audience, type), (audience), ())")
def a1_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summary(event_stream(spark, sf_dir)).select("audience", "type", "n", "critical", "warning", said("last_critical"))


@query(f"with $STREAM, l as (select *, row_number() over (partition by audience, subject, type order by seq desc) as r, max(seq) over (partition by audience) as cursor from stream) select audience, subject, type, seq, {t('time')} as time, severity, round(value, 6) as value, cursor from l where r = 1")
def w2_current_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_conditions(event_stream(spark, sf_dir)).withColumn("time", said("time"))


@query("with $STREAM, l as (select audience, count(*) as last_seq from stream where type = 'view' group by 1) select seq, audience, coalesce(last_seq, 0) + row_number() over (partition by audience order by time, seq) as audience_seq from stream left join l using (audience) where type <> 'view'")
def k2_dense_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    last = events.filter("type = 'view'").groupBy("audience").agg(F.count("*").alias("last_seq"))
    return history.with_sequence(events.filter("type <> 'view'"), last).select("seq", "audience", "audience_seq")


@query(f"with $STREAM select {t('time')} as time, type, round(value, 6) as value, min(seq) as seq, count(distinct audience) as audiences from stream group by time, type, value")
def u4_event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dedupe_across_audiences(event_stream(spark, sf_dir)).select(said("time"), "type", F.round("value", 6).alias("value"), "seq", "audiences")


@query(f"with $STREAM, v as (select subject, time as vt, seq as vs from stream where type = 'view') select p.seq, p.subject, (select vs from v where v.subject = p.subject and v.vt <= p.time order by vt desc, vs desc limit 1) as asof_seq, (select {t('max(vt)')} from v where v.subject = p.subject and v.vt <= p.time) as asof_time from stream p where type = 'purchase'")
def j5_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    done = joins.as_of(events.filter("type = 'purchase'").select("seq", "subject", "time"), events.filter("type = 'view'").select("seq", "subject", "time"), "subject", "time", ["seq"])
    return done.select("seq", "subject", "asof_seq", said("asof_time"))


@query("with $STREAM, p as (select e.seq as trigger, e.subject, s.seq as sample, row_number() over (partition by e.seq order by s.time desc, s.seq desc) as r from stream e join stream s on s.subject = e.subject and s.type <> 'error' and s.time between e.time - interval 2 hour and e.time + interval 1 hour where e.type = 'error') select e.seq as trigger, e.subject, count(sample) filter (where r <= 5) as samples, coalesce(bool_or(r > 5), false) as truncated, min(sample) filter (where r <= 5) as oldest_sample from (select * from stream where type = 'error') e left join p on p.trigger = e.seq group by 1, 2")
def j3_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    triggers = events.filter("type = 'error'").select(F.col("seq").alias("trigger"), "subject", F.col("time").alias("at"))
    samples = events.filter("type <> 'error'").select("subject", F.col("seq").alias("sample"), F.col("time").alias("sample_at"))
    return joins.evidence(triggers, samples, "subject", 7200, 3600, 5)


@query("with $STREAM select count(*) as pending, e.audience from stream e where type = 'error' and not exists (select 1 from stream s where s.subject = e.subject and s.time::date = e.time::date and s.type = 'purchase') group by 2")
def j2_pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    dated = events.withColumn("day", F.to_date("time"))
    captured = dated.filter("type = 'purchase'").select("subject", "day").distinct()
    return dated.filter("type = 'error'").join(captured, ["subject", "day"], "left_anti").groupBy("audience").agg(F.count("*").alias("pending"))


@query("with $STREAM, n as (select p.seq, p.subject, v.seq as near_seq, row_number() over (partition by p.seq order by abs(epoch_us(p.time) - epoch_us(v.time)), v.seq) as r from stream p join stream v on v.subject = p.subject and v.type = 'view' and abs(epoch_us(p.time) - epoch_us(v.time)) <= 7200000000 where p.type = 'purchase') select seq, subject, near_seq from n where r = 1")
def j6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    left = events.filter("type = 'purchase'").select("seq", "subject", "time")
    right = events.filter("type = 'view'").select("subject", F.col("seq").alias("near_seq"), F.col("time").alias("near_time"))
    return joins.nearest(left, right, "subject", "time", "near_time", 7200, ["near_seq"], "near_seq").select("seq", "subject", "near_seq")


@query("with p as (select vec_id as id, embedding[1]::double * 30000 as x, embedding[2]::double * 30000 as y, embedding[3]::double * 30000 as z from embeddings), d as (select a.id as a, b.id as b, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) as gap from p a join p b on a.id <> b.id), k as (select *, row_number() over (partition by a order by gap, b) as r from d where gap <= 2000) select a, count(*) as n, round(min(gap), 6) as nearest_gap, string_agg(b::varchar, ',' order by r) filter (where r <= 8) as named from k group by a")
def j8_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[(F.col("embedding")[i].cast("double") * 30000).alias(c) for i, c in enumerate("xyz")])
    return joins.neighbours(points, 2000.0, 8)


@query("with $STREAM, r as (select subject, type, epoch_us(time) / 1e6 as at, seq from stream) select a.subject, a.seq as payload_a, b.seq as payload_b, a.type as label_a, b.type as label_b from r a join r b on a.subject = b.subject and a.type < b.type and abs(a.at - b.at) <= 1800")
def j10_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("subject", "type", "seq", (F.unix_micros("time") / 1e6).alias("at"))
    return joins.band_pairs(rows, ["subject"], "at", 1800.0, "type", "seq").select("subject", "payload_a", "payload_b", "label_a", "label_b")


@query("with o as (select distinct user_id, event_type from events), d as (select u.user_id, t.event_type from (select distinct user_id from events) u, (select distinct event_type from events) t where (u.user_id + length(t.event_type)) % 3 <> 0), b as (select coalesce(o.user_id, d.user_id) as user_id, o.event_type as seen, d.event_type as said from o full join d on o.user_id = d.user_id and o.event_type = d.event_type) select user_id, coalesce(string_agg(seen, ',' order by seen) filter (where said is null), '') as unexpected, coalesce(string_agg(said, ',' order by said) filter (where seen is null), '') as missing from b group by 1")
def j12_capability_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    kinds = events.select("event_type").distinct()
    declared = events.select("user_id").distinct().join(F.broadcast(kinds)).filter((F.col("user_id") + F.length("event_type")) % 3 != 0)
    return joins.difference(events, declared, "user_id", "event_type")


@query(f"select user_id, event_type, {t('min(ts)')} as first_seen, {t('max(ts)')} as last_seen, count(*) as frames from events group by 1, 2")
def a5_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(said(F.min("ts"), "first_seen"), said(F.max("ts"), "last_seen"), F.count("*").alias("frames"))


@query("with $STREAM, l as (select max(time) as now from stream) select count(distinct subject) filter (where time >= now - interval 1 day) as live, count(distinct subject) as known, count(*) as rows_seen, count(distinct type) as types from stream, l")
def a2_global_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    newest = events.agg(F.max("time").alias("now"))
    recent = F.when(F.col("time") >= F.col("now") - F.expr("interval 1 day"), F.col("subject"))
    return events.join(F.broadcast(newest)).agg(F.count_distinct(recent).alias("live"), F.count_distinct("subject").alias("known"), F.count("*").alias("rows_seen"), F.count_distinct("type").alias("types"))


@query("with r as (select user_id, event_type, event_id % 90 as x, value as y from events), g as (select user_id, event_type, count(*) as n, avg(y) as mean, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy from r group by grouping sets ((user_id, event_type), (user_id)) having count(*) >= 5) select user_id, event_type, n, round(mean, 6) as mean, round(case when sxx > 1e-9 then (syy - sxy * sxy / sxx) / n else syy / n end, 4) as residual from g")
def a7_regression_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 90).alias("x"), F.col("value").alias("y"))
    return series.regression(rows, ["user_id", "event_type"], "x", "y")


@query("with r as (select l_returnflag as kind, l_extendedprice as value, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey * 10 + l_linenumber) as k, count(*) over (partition by l_returnflag) as n from lineitem) select kind, max(n) as n, round(max(value) filter (where k = least(greatest(floor(n * 50 / 100 + 0.5), 1), n)), 6) as p50, round(max(value) filter (where k = least(greatest(floor(n * 95 / 100 + 0.5), 1), n)), 6) as p95, round(max(value), 6) as largest from r group by 1")
def a15_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return series.nearest_rank(rows, "kind", "value", [50, 95])


@query("select user_id, date_trunc('day', ts)::date::varchar as day, coalesce(min(event_id) filter (where event_type = 'error') - 1, max(event_id)) as watermark, count(*) as received from events group by 1, 2")
def a19_receipt_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_id", (F.col("event_type") != "error").alias("resolved"))
    return series.watermark(rows, ["user_id", "day"], "event_id", "resolved")


@query(f"select ts::date::varchar as day, count(*) as rows_seen, {t('min(ts)')} as first_at, {t('max(ts)')} as last_at from events group by 1")
def a21_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("rows_seen"), said(F.min("ts"), "first_at"), said(F.max("ts"), "last_at"))


@query(f"select event_type, {t('date_trunc(chr(104) || chr(111) || chr(117) || chr(114), ts)')} as hour, round(median(value), 6) as median, count(*) as n from events group by event_type, date_trunc(chr(104) || chr(111) || chr(117) || chr(114), ts) having count(*) between 3 and 600".replace("chr(104) || chr(111) || chr(117) || chr(114)", "'hour'"))
def a9_period_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("at")).agg(F.round(F.median("value"), 6).alias("median"), F.count("*").alias("n"))
    return rows.filter(F.col("n").between(3, 600)).select("event_type", said("at", "hour"), "median", "n")


@query(f"select o_custkey, max(o_orderdate)::varchar is not null as has, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as latest_key, {t('max(o_orderdate)')} as epoch from orders group by 1")
def w3_latest_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg((F.max("o_orderdate").isNotNull()).alias("has"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_key"), said(F.max("o_orderdate"), "epoch"))


@query("with $STREAM, i as (select *, type <> 'signup' as ok, sum(case when type = 'signup' then 1 else 0 end) over (partition by subject order by time, seq) as island from stream), w as (select *, count(*) over v as n, sum(case when state = 'crit' then 1 else 0 end) over v as bads from i window v as (partition by subject, island, ok order by time, seq rows between 3 preceding and current row)) select seq, subject, case when not ok then 'unavailable' when n < 3 then 'warming' when bads >= 3 then 'candidate' else 'clear' end as verdict from w")
def w7_m_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_state(event_stream(spark, sf_dir))
    return series.m_of_n(rows, "subject", "time", F.col("state") == "crit", F.col("type") != "signup").select("seq", "subject", "verdict")


_RUNS = "r as (select *, case when state is not distinct from lag(state) over w and lag(seq) over w is not null then 0 else 1 end as fresh from stream window w as (partition by subject order by time, seq)), k as (select *, sum(fresh) over (partition by subject order by time, seq) as run from r)"


@query(f"with $STREAM, {_RUNS}, g as (select subject, state, run, min(time) as b, max(time) as e, count(*) as n from k group by 1, 2, 3) select subject, state, {t('b')} as begins, {t('e')} as ends, n from g where n >= 3 and epoch_us(e) - epoch_us(b) >= 1800000000")
def w18_flatlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.flatlines(with_state(event_stream(spark, sf_dir)), "subject", "time", "state", 3, 1800)
    return found.select("subject", "state", said("begins"), said("ends"), "n")


@query(f"with $STREAM, c as (select *, case when (epoch_us(time) - epoch_us(lag(time) over (partition by subject order by time, seq))) / 1e6 > 21600 then 1 else 0 end as cut from stream), s as (select *, sum(cut) over (partition by subject order by time, seq) as segment from c) select subject, segment, {t('min(time)')} as begins, {t('max(time)')} as ends, count(*) as n, round(avg(value), 6) as mean from s group by 1, 2")
def w20_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.segments(event_stream(spark, sf_dir), "subject", "time", "value", 21600).select("subject", "segment", said("begins"), said("ends"), "n", "mean")


@query("with $STREAM, l as (select seq, subject, state, lag(state) over (partition by subject order by time, seq) as before from stream) select * from l where state is distinct from before")
def w24_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.compacted(with_state(event_stream(spark, sf_dir)), "subject", "time", "state").select("seq", "subject", "state", "before")


@query("with recursive $STREAM, r as (select subject, state, time, epoch_us(time) as us, row_number() over (partition by subject order by time, seq) as i from stream), "
       "m as (select subject, i, case when state = 'ok' then 'ok' else 'unknown' end as cur, case when state = 'ok' then null else state end as prov, time as since, us as since_us, us as last_us, null::varchar as old_value, null::varchar as new_value from r where i = 1 "
       "union all select r.subject, r.i, case when m.cur = 'unknown' and r.state = 'ok' then 'ok' when r.state = m.prov and r.us - m.last_us < 7200000000 and r.us - m.since_us >= 7200000000 then r.state else m.cur end, "
       "case when r.state = m.cur or (m.cur = 'unknown' and r.state = 'ok') or (r.state = m.prov and r.us - m.last_us < 7200000000 and r.us - m.since_us >= 7200000000) then null else r.state end, "
       "case when r.state = m.prov and r.us - m.last_us < 7200000000 then m.since else r.time end, case when r.state = m.prov and r.us - m.last_us < 7200000000 then m.since_us else r.us end, r.us, "
       "case when r.state <> m.cur and not (m.cur = 'unknown' and r.state = 'ok') and r.state = m.prov and r.us - m.last_us < 7200000000 and r.us - m.since_us >= 7200000000 then m.cur end, "
       "case when r.state <> m.cur and not (m.cur = 'unknown' and r.state = 'ok') and r.state = m.prov and r.us - m.last_us < 7200000000 and r.us - m.since_us >= 7200000000 then r.state end "
       "from m join r on r.subject = m.subject and r.i = m.i + 1) "
       f"select subject, old_value, new_value, {t('since')} as since from m where new_value is not null")
def t3_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = state.debounced(with_state(event_stream(spark, sf_dir)), "subject", "time", "state", 7200)
    return done.select("subject", "old_value", "new_value", said("since"))


@query("with recursive $STREAM, r as (select seq, subject, epoch_us(time) as us, case state when 'crit' then 2 when 'warn' then 1 else 0 end as rank, row_number() over (partition by subject order by time, seq) as i from stream), "
       "m as (select seq, subject, i, rank, rank as served, null::bigint as began, null::integer as floor from r where i = 1 "
       "union all select r.seq, r.subject, r.i, r.rank, case when r.rank >= m.served then r.rank when m.began is not null and r.us - m.began >= 18000000000 then greatest(m.floor, r.rank) else m.served end, "
       "case when r.rank >= m.served or (m.began is not null and r.us - m.began >= 18000000000) then null when m.began is null then r.us else m.began end, "
       "case when r.rank >= m.served or (m.began is not null and r.us - m.began >= 18000000000) then null when m.began is null then r.rank else greatest(m.floor, r.rank) end "
       "from m join r on r.subject = m.subject and r.i = m.i + 1) select seq, subject, rank, served as held_rank from m")
def t4_recovery_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("state") == "crit", 2).when(F.col("state") == "warn", 1).otherwise(0)
    return state.held(with_state(event_stream(spark, sf_dir)).withColumn("rank", rank), "subject", "time", "rank", 18000).select("seq", "subject", "rank", "held_rank")


@query("with r as (select l_orderkey, l_linenumber, epoch_us(o_orderdate) / 1e6 as now, epoch_us(l_shipdate) / 1e6 as stamp from lineitem join orders on l_orderkey = o_orderkey) select case when stamp is null then 'unstamped' when now - stamp < -86400 * 60 then 'future' when now - stamp > 60 then 'late' else 'live' end as label, count(*) as n from r group by 1")
def t1_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("stamp")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("now")), "l_orderkey")
    return state.live(rows, "stamp", "now", 60, 86400 * 60).groupBy(F.coalesce("rejected", F.lit("live")).alias("label")).agg(F.count("*").alias("n"))


@query("with c as (select c_custkey, (c_custkey % 179) - 89.0 as lat, (c_custkey * 7 % 360) - 180.0 as lon, c_acctbal as h from customer), n as (select *, 6378137.0 / sqrt(1 - (1/298.257223563)*(2-1/298.257223563) * sin(radians(lat))**2) as n from c) select c_custkey, round((n + h) * cos(radians(lat)) * cos(radians(lon)), 3) as x, round((n + h) * cos(radians(lat)) * sin(radians(lon)), 3) as y, round((n * (1 - (1/298.257223563)*(2-1/298.257223563)) + h) * sin(radians(lat)), 3) as z from n")
def h5_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    x, y, z = G.to_ecef(F.col("c_custkey") % 179 - F.lit(89.0), F.col("c_custkey") * 7 % 360 - F.lit(180.0), F.col("c_acctbal"))
    return c.select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


_KEPLER = (
    "e0 as (select p_partkey as k, 5153.0 + p_partkey % 7 as sa, 0.001 * (1 + p_partkey % 20) as e, (p_partkey % 628) / 100.0 as m0, 0.9 + (p_partkey % 10) / 100.0 as i0, (p_partkey * 3 % 628) / 100.0 as o0, (p_partkey * 5 % 628) / 100.0 as w, -8e-9 as od, 7200.0 * (p_partkey % 12) as toe, 43200.0 as t from part), "
    "e1 as (select *, (t - toe) - 604800 * floor((t - toe) / 604800 + 0.5) as tk from e0), e2 as (select *, m0 + sqrt(3.986005e14 / (sa*sa*sa*sa*sa*sa)) * tk as m from e1), "
    "x0 as (select *, m as x from e2), " + ", ".join(f"x{i} as (select * exclude (x), x - (x - e * sin(x) - m) / (1 - e * cos(x)) as x from x{i - 1})" for i in range(1, 16)) + ", "
    "u as (select *, atan2(sqrt(1 - e*e) * sin(x), cos(x) - e) + w as u, sa*sa * (1 - e * cos(x)) as r, o0 + (od - 7.2921151467e-5) * tk - 7.2921151467e-5 * toe as n from x15) "
)


@query(f"with {_KEPLER} select k as p_partkey, round(r*cos(u)*cos(n) - r*sin(u)*cos(i0)*sin(n), 2) as x, round(r*cos(u)*sin(n) + r*sin(u)*cos(i0)*cos(n), 2) as y, round(r*sin(u)*sin(i0), 2) as z from u")
def h8_kepler(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y, z = G.kepler_position(F.lit(43200.0), 7200.0 * (k % 12), 5153.0 + k % 7, 0.001 * (1 + k % 20), k % 628 / 100.0, 0.9 + k % 10 / 100.0, k * 3 % 628 / 100.0, k * 5 % 628 / 100.0, F.lit(-8e-9))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(z, 2).alias("z"))


@query("select event_id, cast(floor(event_id * 977 / 86164.0) as bigint) as cycle, cast(floor((event_id * 977 % 86164) / 300.0) as bigint) as bin, round(value, 6) as value from events")
def h20_sidereal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle, bin_ = G.sidereal_cycle(F.col("event_id") * 977)
    return table(spark, sf_dir, "events").select("event_id", cycle.cast("long").alias("cycle"), bin_.cast("long").alias("bin"), F.round("value", 6).alias("value"))


@query("with c as (select floor(event_id * 977 / 86164.0) as cycle, floor((event_id * 977 % 86164) / 300.0) as bin, value from events), m as (select bin, cycle, floor(avg(value) + 0.5) as level from c group by 1, 2), d as (select bin, median(level) as reference, count(*) as cycles from m group by 1 having count(*) >= 3), a as (select bin, median(abs(level - reference)) as mad from m join d using (bin) group by 1) select cast(bin as bigint) as bin, round(reference, 6) as reference, round(mad, 6) as mad, cycles from d join a using (bin)")
def a10_sidereal_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle, bin_ = G.sidereal_cycle(F.col("event_id") * 977)
    levels = table(spark, sf_dir, "events").groupBy(bin_.cast("long").alias("bin"), cycle.alias("cycle")).agg(F.floor(F.avg("value") + 0.5).cast("double").alias("level"))
    gathered = levels.groupBy("bin").agg(F.median("level").alias("reference"), F.count("*").alias("cycles"), F.collect_list("level").alias("levels")).filter("cycles >= 3")
    spread = gathered.select("bin", "reference", "cycles", F.explode("levels").alias("level")).groupBy("bin", "reference", "cycles").agg(F.median(F.abs(F.col("level") - F.col("reference"))).alias("mad"))
    return spread.select("bin", F.round("reference", 6).alias("reference"), F.round("mad", 6).alias("mad"), "cycles")


@query("with c as (select cast(floor(event_id * 977 / 86164.0) as bigint) as cycle, cast(floor((event_id * 977 % 86164) / 300.0) as bigint) as bin, value from events), m as (select bin, cycle, cast(floor(avg(value) + 0.5) as bigint) as level, row_number() over (partition by bin order by cycle) as i from c group by 1, 2), h as (select a.bin, a.cycle, b.level from m a join m b on a.bin = b.bin and b.i between a.i - 8 and a.i - 1), r as (select *, row_number() over (partition by bin, cycle order by level) as i, count(*) over (partition by bin, cycle) as n from h), e as (select bin, cycle, n, cast(floor((max(level) filter (i = (n + 1) // 2) + max(level) filter (i = n // 2 + 1) + 1) / 2.0) as bigint) as reference from r where n >= 3 group by 1, 2, 3), d as (select bin, cycle, n, reference, abs(level - reference) as apart, row_number() over (partition by bin, cycle order by abs(level - reference)) as i from r join e using (bin, cycle, n)) select bin, cycle, reference, cast(floor((max(apart) filter (i = (n + 1) // 2) + max(apart) filter (i = n // 2 + 1) + 1) / 2.0) as bigint) as mad, n as support from d group by 1, 2, 3, n")
def a10_sidereal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle, bin_ = G.sidereal_cycle(F.col("event_id") * 977)
    levels = table(spark, sf_dir, "events").groupBy(bin_.cast("long").alias("bin"), cycle.cast("long").alias("cycle")).agg(F.floor(F.avg("value") + 0.5).alias("level"))
    middle = "cast(floor((element_at({0}, cast((support + 1) div 2 as int)) + element_at({0}, cast(support div 2 + 1 as int)) + 1) / 2) as bigint)"
    before = levels.withColumn("history", F.expr("array_sort(collect_list(level) over (partition by bin order by cycle rows between 8 preceding and 1 preceding))"))
    found = before.withColumn("support", F.size("history").cast("long")).filter("support >= 3").withColumn("reference", F.expr(middle.format("history")))
    return found.withColumn("apart", F.expr("array_sort(transform(history, x -> abs(x - reference)))")).select("bin", "cycle", "reference", F.expr(middle.format("apart")).alias("mad"), "support")


@query("with d as (select distinct session, seq from (select 's' || (user_id % 7) as session, event_id as seq from events union all select 's' || (user_id % 7), event_id from events where event_id % 10 = 0)) select session, count(*) as stored, max(seq) as last_seq from d group by 1")
def k1_replayed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session"), F.col("event_id").alias("seq"))
    replayed = receipts.unionAll(receipts.filter("seq % 10 = 0"))
    return replayed.dropDuplicates(["session", "seq"]).groupBy("session").agg(F.count("*").alias("stored"), F.max("seq").alias("last_seq"))
