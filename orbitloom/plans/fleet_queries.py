"""Fleet queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.operators import epochs, fleet
from orbitloom.operators.tables import STREAM_SQL, event_stream, table, with_state
from orbitloom.plans.queries import said, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace("$STREAM", STREAM_SQL)
        return f

    return add


@query("with $STREAM select subject, seq, row_number() over (partition by subject order by time, origin, seq) as place, origin from (select *, case when type = 'error' then 'rf' else 'board' end as origin from stream)")
def s3_station_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    both = events.filter("type = 'error'").withColumn("origin", F.lit("rf")).unionByName(events.filter("type <> 'error'").withColumn("origin", F.lit("board")))
    return both.selectExpr("subject", "seq", "row_number() over (partition by subject order by time, origin, seq) as place", "origin")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, round(cast(json_extract(props, '$.k') as bigint) * 1e-7, 9) as degrees, cast(json_extract(props, '$.k') as bigint) > 0 as valid from events")
def s8_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return rows.select("event_id", "k", F.round(F.col("k") * F.lit(1e-7), 9).alias("degrees"), (F.col("k") > 0).alias("valid"))


@query("select event_id, 'value' as sensor, round(value, 6) as reading from events union all select event_id, 'k', round(cast(json_extract(props, '$.k') as double), 6) from events")
def s9_sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k double")["k"])
    each = rows.select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("sensor"), F.round(n, 6).alias("reading")) for n in ("value", "k")])).alias("s"))
    return each.select("event_id", "s.*")


@query("with $STREAM select seq, case when audience = 2 then null else subject end as subject, case when audience = 2 then null else round(value, 6) end as value, type, audience = 2 as redacted from stream where audience <> 3 and type <> 'signup'")
def b7_public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).filter("audience <> 3 and type <> 'signup'").withColumn("redacted", F.col("audience") == 2)
    shown = lambda c: F.when(~F.col("redacted"), c)
    return rows.select("seq", shown(F.col("subject")).alias("subject"), shown(F.round("value", 6)).alias("value"), "type", "redacted")


@query("select c_custkey, concat_ws(',', case when n_nationkey % 4 = 0 then 'disabled' end, case when n_regionkey = 2 then 'organization' end, case when c_acctbal < 0 then 'retention' end, case when c_mktsegment = 'BUILDING' then 'purpose' end) as reasons, case when n_nationkey % 3 = 0 then 'named' else 'anonymous' end as attribution from customer join nation on c_nationkey = n_nationkey")
def b9_export_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    reasons = fleet.deny_reasons({"disabled": F.col("n_nationkey") % 4 == 0, "organization": F.col("n_regionkey") == 2, "retention": F.col("c_acctbal") < 0, "purpose": F.col("c_mktsegment") == "BUILDING"})
    return rows.select("c_custkey", reasons.alias("reasons"), F.when(F.col("n_nationkey") % 3 == 0, "named").otherwise("anonymous").alias("attribution"))


@query("select user_id, bool_or(event_type = 'view') as views, bool_or(event_type = 'error') as errors, bool_or(event_type = 'signup') as signups from events where event_type in ('view', 'error', 'signup') group by 1")
def j18_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return fleet.roster({"views": events.filter("event_type = 'view'"), "errors": events.filter("event_type = 'error'"), "signups": events.filter("event_type = 'signup'")}, "user_id")


@query("select p.event_id, p.user_id from events p where event_type = 'purchase' and exists (select 1 from events w where w.event_type = 'view' and w.ts::date = p.ts::date and hour(w.ts) = hour(p.ts) and w.user_id <> p.user_id)")
def j23_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("slot", F.date_trunc("hour", "ts"))
    return fleet.witnessed_elsewhere(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'").select("slot", F.col("user_id").alias("w")), "slot", "w", "user_id").select("event_id", "user_id")


@query("select coalesce(c_custkey, o_custkey) as custkey, case when o_custkey is not null then 'observed' else 'roster' end as origin, coalesce(total, c_acctbal) as position from customer full join (select o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as total from orders group by 1) on c_custkey = o_custkey")
def j19_almanac_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("total"))
    both = table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    return both.select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.when(F.col("o_custkey").isNotNull(), "observed").otherwise("roster").alias("origin"), F.coalesce("total", "c_acctbal").alias("position"))


@query(f"select user_id, {t('max(ts)')} as last_seen, count(distinct event_type) as kinds from events group by 1")
def a4_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(said(F.max("ts"), "last_seen"), F.count_distinct("event_type").alias("kinds"))


@query("with $STREAM, e as (select type, time::date::varchar as day, subject, min(case state when 'crit' then 0.0::double when 'warn' then 0.5 else 1 end) as w from stream group by all) select type, day, count(*) as witnesses, round(sum(w), 6) as trust from e group by all")
def a6_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = with_state(event_stream(spark, sf_dir)).withColumn("day", F.to_date("time").cast("string"))
    return fleet.corroboration(votes, ["type", "day"], "subject", F.when(F.col("state") == "crit", 0.0).when(F.col("state") == "warn", 0.5).otherwise(1.0))


_DECLARED = "select u.user_id, u.day, k.event_type from (select distinct user_id, ts::date::varchar as day from events) u, (select distinct event_type from events) k where (u.user_id + length(k.event_type)) % 3 <> 0"


@query(f"with x as ({_DECLARED}), o as (select distinct user_id, ts::date::varchar as day, event_type, 1 as seen from events), c as (select user_id, day, count(*) as expected, count(seen) as observed from x left join o using (user_id, day, event_type) group by all) select *, expected - observed >= 2 and 100 * (expected - observed) >= 60 * expected as bad from c")
def a11_reception_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type")
    kinds = F.explode(F.array(*[F.lit(k) for k in ("signup", "error", "click", "view", "purchase")]))  # the fixed list of signals
    declared = events.select("user_id", "day").distinct().withColumn("event_type", kinds).filter((F.col("user_id") + F.length("event_type")) % 3 != 0)
    return fleet.deficit(declared, events, ["user_id", "day"], "event_type", 2, 60)


@query("with $STREAM, g as (select subject, time::date::varchar as day, round(sum(case state when 'crit' then 2 when 'warn' then 1 else 0 end * (1 + severity)) / sum(1 + severity)::double, 6) as mean_level, string_agg(distinct case when state = 'crit' then type end, ',' order by case when state = 'crit' then type end) as u, count(distinct case when state = 'crit' then type end) as n from stream group by all) select subject, day, mean_level, coalesce(u, '') as unassured, case when n >= 2 then 'unassured' when n = 1 then 'inconsistent' else 'assured' end as state from g")
def a13_station_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_state(event_stream(spark, sf_dir)).select("subject", F.to_date("time").cast("string").alias("day"), F.when(F.col("state") == "crit", 2).when(F.col("state") == "warn", 1).otherwise(0).alias("level"), "type", (1 + F.col("severity")).alias("weight"))
    return fleet.fused(rows, ["subject", "day"], "level", "type", "weight")


@query("with $STREAM, n as (select *, sum(case when type = 'error' then 1 else 0 end) over (partition by subject order by time, seq) as k from stream), g as (select subject, k, min(seq) filter (where type = 'error') as seq, min(time) filter (where type = 'error') as a, min(time) filter (where type = 'purchase') as b, k = max(k) over (partition by subject) as last from n where k > 0 group by subject, k) select subject, seq, case when epoch_us(b) - epoch_us(a) <= 3600000000 then 'immediate' when b is not null then 'completed' when last then 'unresolved' else 'superseded' end as outcome, (epoch_us(b) - epoch_us(a)) / 1e6 as lag_s from g")
def w11_deferral_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.deferrals(event_stream(spark, sf_dir), "subject", "time", F.col("type") == "error", F.col("type") == "purchase", 3600)


@query("select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type not in ('click', 'view', 'error')) as other from events group by 1")
def a17_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(kind == k).alias(k) for k in ("click", "view", "error")], F.count_if(~kind.isin("click", "view", "error")).alias("other"))


@query("with $STREAM, n as (select max(time) as now from stream), l as (select subject, time as b, lead(time) over (partition by subject order by time, seq) as e, now from stream, n), "
       "g as (select subject, b, e, floor((epoch_us(b) / 1e6 + 43200) / 7200) as slot from l where epoch_us(coalesce(e, now)) - epoch_us(b) > 43200000000), "
       "s as (select distinct floor(epoch_us(time) / 1e6 / 7200) as slot, seq % 10 as receiver from stream) "
       f"select subject, {t('b')} as begins, {t('e')} as ends from g where (select count(distinct receiver) from s where s.slot in (g.slot, g.slot - 1)) >= 4")
def t9_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent subjects, open ones too, while at least four of ten receivers are live."""
    events = event_stream(spark, sf_dir).withColumn("receiver", F.col("seq") % 10)
    now = events.agg(F.max("time").alias("now"))
    rows = events.join(F.broadcast(now))  # one row
    return epochs.silences(rows, "subject", "time", 43200, "now", "receiver", 7200, 4).select("subject", said("begins"), said("ends"))


@query("with $STREAM, r as (select seq, subject, value, epoch_us(time) as us from stream), b as (select seq, subject, value, count(value) over w as n, median(value) over w as m from r window w as (partition by subject order by us range between 86400000000 preceding and 1 preceding)) select seq, subject, round(case when n >= 4 then m end, 4) as baseline, round(case when n >= 4 then value - m end, 4) as departure from b")
def w19_baseline_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = epochs.baseline_departure(event_stream(spark, sf_dir), "subject", "time", "value", 86400, 4)
    return done.select("seq", "subject", F.round("baseline", 4).alias("baseline"), F.round("departure", 4).alias("departure"))


@query("with $STREAM select seq, subject, round(value - lag(value) over w - (epoch_us(time) - epoch_us(lag(time) over w)) / 1e6 * (severity * 0.001::double + lag(severity) over w * 0.001::double) / 2, 4) as residual from stream window w as (partition by subject order by time, seq)")
def w12_trapezoid_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).withColumn("drift", F.col("severity") * F.lit(0.001))
    return epochs.trapezoid_residual(rows, "subject", "time", "value", "drift").select("seq", "subject", F.round("residual", 4).alias("residual"))


@query("with $STREAM, u as (select subject, type, seq, value from stream where seq % 3 <> 0 union all select subject, type, seq, value + 1 from stream where seq % 3 = 0) select subject, type, max(seq) as seq, round(arg_max(value, seq), 6) as value from u group by all")
def k4_checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("subject", "type", "seq", "value")
    done = fleet.newest_wins(rows.filter("seq % 3 <> 0"), rows.filter("seq % 3 = 0").withColumn("value", F.col("value") + 1), ["subject", "type"], "seq")
    return done.withColumn("value", F.round("value", 6))


@query("with $STREAM, s as (select subject, seq, cast(sum(strlen(body)) over (partition by subject order by time, seq) as bigint) as spent from stream) select * from s where spent <= 256")
def l3_byte_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.byte_page(event_stream(spark, sf_dir), "subject", ["time", "seq"], F.col("body"), 256).select("subject", "seq", "spent")
