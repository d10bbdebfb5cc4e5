"""Queries over sets assembled from fragments. `events` plays the fragments, so rows lie hours apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.operators import assembly
from orbitloom.plans.registry import observations, registry

QUERIES, SQL, query = registry()
_DAY = 86400
_FRAGMENTS = """fragments as (select seq, gnss as grp, sv % 10 as sv, epoch_us(time) as tm, KINDS as kind, ((epoch_us(time) // 1000000) // 432000) % 200 + (case when ISSUE1 then 256 * (k % 4) else 0 end) + (case when k % 7 = 0 then 1 else 0 end) as issue,
 case when k % 17 = 0 then 99 else sv % 10 end as named_sv, (epoch_us(time) // 1000000) % 604800 as sow from obs)"""


def _fragments(spark: SparkSession, sf_dir: str, kind: F.Column, low: bool) -> DataFrame:
    seconds, k = F.floor(F.unix_micros("time") / 1_000_000), F.col("k")
    rows = observations(spark, sf_dir).withColumn("kind", kind)
    issue = F.floor(seconds / 432000) % 200 + (F.when(F.col("kind") == 1, 256 * (k % 4)).otherwise(0) if low else 0) + F.when(k % 7 == 0, 1).otherwise(0)
    return rows.select("seq", F.col("gnss").alias("grp"), (F.col("sv") % 10).alias("sv"), F.unix_micros("time").alias("tm"), "kind", issue.cast("long").alias("issue"),
                       F.when(k % 17 == 0, 99).otherwise(F.col("sv") % 10).alias("named_sv"), (seconds % 604800).cast("long").alias("sow"))


def _asof(kinds: dict[str, str]) -> str:
    """SQL: the newest fragment of each name at or before each row."""
    joins = " ".join(f"asof left join (select grp, sv, (tm::hugeint * 1000000 + seq) as o, seq as {n}_seq, issue as {n}_issue, named_sv as {n}_sv, sow as {n}_sow from fragments where {cond}) {n} on {n}.grp = f.grp and {n}.sv = f.sv and f.o >= {n}.o" for n, cond in kinds.items())
    return f"a as (select f.*, {', '.join(f'{n}_seq, {n}_issue, {n}_sv, {n}_sow' for n in kinds)} from (select *, (tm::hugeint * 1000000 + seq) as o from fragments where kind in (KINDLIST)) f {joins})"


def _sets(kinds: str, kind_list: str, parts: dict[str, str], fits: str, issue: str, seqs: str, clock: str = "null::bigint", low: bool = False) -> str:
    fragments = _FRAGMENTS.replace("KINDS", kinds).replace("ISSUE1", f"({kinds}) = 1" if low else "false")
    return (f"with $OBS, {fragments}, {_asof(parts).replace('KINDLIST', kind_list)}, m as (select *, {issue} as set_issue from a where {fits}), "
            f"n as (select *, lag(set_issue) over (partition by grp, sv order by tm, seq) as had from m) select grp, sv, tm, seq, set_issue as issue, {seqs} as seqs, {clock} as clock_seq from n where had is null or had <> set_issue")  # fmt: skip


def _listed(sets: DataFrame) -> DataFrame:
    return sets.select("grp", "sv", "tm", "seq", "issue", F.concat_ws(",", F.col("seqs").cast("array<string>")).alias("seqs"), "clock_seq")


_KEY, _ORDER = ["grp", "sv"], ["tm", "seq"]


@query(_sets("1 + seq % 5", "1, 2, 3", {"a1": "kind = 1", "a2": "kind = 2", "a3": "kind = 3"}, "a2_issue = a3_issue and a2_issue = a1_issue & 255", "a2_issue", "concat_ws(',', a1_seq, a2_seq, a3_seq)", low=True))
def w26_lnav_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ephemeris sets of subframes 1 to 3 whose issues agree (the first by its low eight bits), at each change."""
    return _listed(assembly.assembled(_fragments(spark, sf_dir, 1 + F.col("seq") % 5, True), _KEY, _ORDER, assembly.FAMILIES["lnav"]))


@query(_sets("1 + (seq // 8) % 6", "1, 2, 3, 4", {"a1": "kind = 1", "a2": "kind = 2", "a3": "kind = 3", "a4": "kind = 4"}, "a1_issue = a2_issue and a1_issue = a3_issue and a1_issue = a4_issue and a4_sv = sv", "a2_issue", "concat_ws(',', a1_seq, a2_seq, a3_seq, a4_seq)"))
def w27_inav_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of I/NAV words 1 to 4 of one issue whose word 4 names the satellite."""
    return _listed(assembly.assembled(_fragments(spark, sf_dir, 1 + F.floor(F.col("seq") / 8) % 6, False), _KEY, _ORDER, assembly.FAMILIES["inav"]))


@query(_sets("case seq % 5 when 0 then 10 when 1 then 11 when 2 then 30 when 3 then 33 else 12 end", "10, 11, 30, 31, 32, 33, 34, 35, 36, 37", {"a10": "kind = 10", "a11": "kind = 11", "c": "kind between 30 and 37"}, "a10_issue = a11_issue and a10_sv = sv and a11_sv = sv",
             "a11_issue", "concat_ws(',', a10_seq, a11_seq)", "case when c_issue = set_issue and c_sv = sv then c_seq end"))
def w27_cnav_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of CNAV messages 10 and 11 of one time of ephemeris; the newest clock message joins if its time of clock is the same."""
    kind = F.element_at(F.array(*map(F.lit, (10, 11, 30, 33, 12))), (F.col("seq") % 5 + 1).cast("int"))
    return _listed(assembly.assembled(_fragments(spark, sf_dir, kind, False), _KEY, _ORDER, assembly.FAMILIES["cnav"]))


@query("""with $OBS, st as (select seq, station % 5 as relay, gnss as sat, epoch_us(time) as tm, 1 + (seq * 3 + k) % 5 as number, (epoch_us(time) // 1000000) // 172800 as tb, cast(k * 0.5 as double) as tau, (epoch_us(time)::hugeint * 1000000 + seq) as o from obs),
 a as (select f.*, s1.seq as q1, s1.tm as t1, s2.seq as q2, s2.tm as t2, s2.tb as tb2, s3.seq as q3, s3.tm as t3, s4.tm as t4, s4.tau as tau4 from (select * from st where number <= 4) f
  asof left join (from st where number = 1) s1 on s1.relay = f.relay and s1.sat = f.sat and f.o >= s1.o asof left join (from st where number = 2) s2 on s2.relay = f.relay and s2.sat = f.sat and f.o >= s2.o
  asof left join (from st where number = 3) s3 on s3.relay = f.relay and s3.sat = f.sat and f.o >= s3.o asof left join (from st where number = 4) s4 on s4.relay = f.relay and s4.sat = f.sat and f.o >= s4.o),
 m as (select relay, sat, tm, seq, o, concat_ws(',', q1, q2, q3) as seqs, tb2 as tb, case when greatest(t1, t2, t3, t4) - least(t1, t2, t3, t4) <= 172800000000 then tau4 end as tau from a where greatest(t1, t2, t3) - least(t1, t2, t3) <= 172800000000 and t1 is not null and t2 is not null and t3 is not null),
 b as (select x.o, x.sat, max(y.o) as broken from m x left join (select *, lag(tb) over (partition by sat order by o) as had from m) y on y.sat = x.sat and y.o <= x.o and y.had <> y.tb group by all),
 c as (select m.o, m.sat, arg_max(p.tau, p.o) as clock from m join b using (o, sat) join m p on p.sat = m.sat and p.o <= m.o and (b.broken is null or p.o >= b.broken) and p.tau is not null group by all)
 select sat, relay, tm, seq, seqs, tb, clock, clock is not null and tau is null as carried from m left join c using (o, sat)""")  # fmt: skip
def w28_coherent_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLONASS sets whose strings 1 to 3 lie within one window of one relay, with string 4 or the clock of the sets before within one tb."""
    seconds = F.floor(F.unix_micros("time") / 1_000_000)
    rows = observations(spark, sf_dir).select("seq", (F.col("station") % 5).alias("relay"), F.col("gnss").alias("sat"), F.unix_micros("time").alias("tm"), F.unix_micros("time").alias("at"), (1 + (F.col("seq") * 3 + F.col("k")) % 5).alias("number"),
                                              F.floor(seconds / 172800).cast("long").alias("tb"), (F.col("k") * 0.5).alias("tau"))
    sets = assembly.coherent(rows, ["relay", "sat"], ["sat"], ["tm", "seq"], 2 * _DAY)
    return sets.withColumn("seqs", F.concat_ws(",", F.col("seqs").cast("array<string>")))


@query("with $OBS, p as (select seq, station % 40 as relay, epoch_us(time) as tm, 6 + k % 10 as page from obs), l as (select *, lag(seq) over w as bs, lag(page) over w as bp, lag(tm) over w as bt from p window w as (partition by relay order by tm, seq)) "
       "select relay, bs as first_seq, seq as second_seq, page from l where bp % 2 = 0 and page - bp = 1 and tm - bt between 0 and 28800000000")  # fmt: skip
def w29_adjacent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Almanac records of two consecutive pages of one relay, eight hours apart at most."""
    rows = observations(spark, sf_dir).select("seq", (F.col("station") % 40).alias("relay"), F.unix_micros("time").alias("tm"), (6 + F.col("k") % 10).alias("page"))
    return assembly.adjacent(rows, ["relay"], ["tm", "seq"], "page", "tm", 28800)


@query("with $OBS, m as (select seq, station, epoch_us(time) as tm, (epoch_us(time) // 1000000) // 86400 as tow, case when k % 4 = 0 then value end as position, case when k % 4 = 1 then value end as clock, case when k % 4 = 2 then type end as status, k % 4 = 3 as fin from obs), "
       "f as (select station, tow, min(tm::hugeint * 100000 + seq) as fin_o from m where fin group by all), r as (select m.* from m left join f using (station, tow) where fin_o is null or tm::hugeint * 100000 + seq <= fin_o) "
       "select station, tow, min(tm) as arrived, arg_min(position, tm::hugeint * 100000 + seq) as position, arg_min(clock, tm::hugeint * 100000 + seq) as clock, arg_min(status, tm::hugeint * 100000 + seq) as status from r group by all")  # fmt: skip
def w30_solution_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, clock and status messages of one station and time of week as one row; what follows its end marker is dropped."""
    k, value = F.col("k") % 4, F.col("value")
    rows = observations(spark, sf_dir).select("seq", "station", F.unix_micros("time").alias("at"), F.floor(F.floor(F.unix_micros("time") / 1_000_000) / 86400).cast("long").alias("tow"), F.when(k == 0, value).alias("position"),
                                              F.when(k == 1, value).alias("clock"), F.when(k == 2, F.col("type")).alias("status"), (k == 3).alias("fin"))
    return assembly.solution_epochs(rows, ["station"], ["at", "seq"], "tow", ["position", "clock", "status"], F.col("fin"))


@query("with $OBS, p as (select seq, sv, epoch_us(time) as tm, k % 9 = 0 as flag from obs) select x.seq, exists (select 1 from p y where y.sv = x.sv and y.flag and (y.tm, y.seq) <= (x.tm, x.seq) and x.tm - y.tm < 43200000000) as held from p x")
def w31_recency_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of satellites whose last do-not-use message is less than half a day old."""
    rows = observations(spark, sf_dir).select("seq", "sv", F.unix_micros("time").alias("tm"), (F.col("k") % 9 == 0).alias("flag"))
    return assembly.latched(rows, ["sv"], ["tm", "seq"], "tm", F.col("flag"), _DAY // 2).select("seq", "held")


@query("""with recursive $OBS, p as (select seq, gnss as grp, unix as tm, value as code, value * 0.9 + k / 10.0 as phase, k % 29 <> 0 as has_phase, (cast(unix as bigint) // 600) % 900 as lock_ms, (k % 31 = 0) as half_cycle, k % 37 = 0 as slip, 1575.42e6 as f1, case when gnss = 5 then 1575.42e6 else 1227.6e6 end as f2 from obs),
 r as (select *, row_number() over (partition by grp order by tm, seq) as i from p),
 f as (select *, 1 as arc, case when has_phase then 1 else 0 end as n, case when has_phase then code - phase end as mean from r where i = 1
 union all
 select seq, grp, tm, code, phase, has_phase, lock_ms, half_cycle, slip, f1, f2, i, arc2, case when has_phase then n0 + 1 else n0 end, case when has_phase then coalesce(mean0 + (code - phase - mean0) / (n0 + 1), code - phase) else mean0 end from
 (select *, case when cut then 0 else had_n end as n0, case when cut then null else had_mean end as mean0, case when cut then had_arc + 1 else had_arc end as arc2 from
 (select n.*, f.arc as had_arc, f.n as had_n, f.mean as had_mean, not f.has_phase or not n.has_phase or n.slip or n.half_cycle <> f.half_cycle or n.lock_ms < f.lock_ms or n.tm < f.tm or n.tm - f.tm > 3600 as cut from f join r n on n.grp = f.grp and n.i = f.i + 1)))
 select seq, arc, n, case when has_phase and n >= 10 and f1 <> f2 then round((phase + mean) / ((f1 / f2) ** 2 - 1), 6) end as slant from f""")  # fmt: skip
def w21_ionosphere_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of dual-frequency pairs and their levelled slant delays, with every cause of a break."""
    k = F.col("k")
    rows = observations(spark, sf_dir).select("seq", F.col("gnss").alias("grp"), F.col("unix").alias("at"), F.col("value").alias("code"), (F.col("value") * 0.9 + k / 10).alias("phase"), (k % 29 != 0).alias("has_phase"),
                                              (F.floor(F.rint("unix") / 600) % 900).alias("lock_ms"), (k % 31 == 0).alias("half_cycle"), (k % 37 == 0).alias("slip"),
                                              F.lit(1575.42e6).alias("f1"), F.when(F.col("gnss") == 5, 1575.42e6).otherwise(1227.6e6).alias("f2"))
    return assembly.arcs(rows, ["grp"], ["at", "seq"], 3600).select("seq", "arc", "n", F.round("slant", 6).alias("slant"))
