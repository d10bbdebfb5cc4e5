"""Navigation files written from `part` (forty records to a file, some broken), read back as a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.operators.tables import table
from orbitloom.plans.registry import registry
from orbitloom.sources import navigation

QUERIES, SQL, query = registry()
_HEAD = f"{'     3.05':20}N: GNSS NAV DATA    M: MIXED            RINEX VERSION / TYPE\n{'':60}END OF HEADER\n"
_PARTS = """p as (select p_partkey as k, p_partkey // 40 as file, substr('GEC', 1 + p_partkey % 3, 1) as letter, 1 + p_partkey * 7 % 30 as sv, p_partkey * 37 % 84 * 7200 as toe, p_partkey // 40 % 5 = 0 and p_partkey % 11 = 0 as lacking, p_partkey // 40 % 7 = 3 and p_partkey % 13 = 0 as off from part),
 g as (select *, case when lacking then 'missing_field' when off then 'week_disagrees' end as problem from p)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as texts of files: sqrt_a is blank or the week wrong in some records."""
    k = F.col("p_partkey")
    toe = k * 37 % 84 * 7200
    day, second = F.floor(toe / 86400), toe % 86400
    number = lambda c: F.format_string("%19.12e", c.cast("double"))
    week = F.when(F.substring("letter", 1, 1) == "C", 940).otherwise(2296) - F.when((F.floor(k / 40) % 7 == 3) & (k % 13 == 0), 10).otherwise(0)
    root = F.when((F.floor(k / 40) % 5 == 0) & (k % 11 == 0), " " * 19).otherwise(number(5153 + k % 7))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.lit("GEC"), (k % 3 + 1).cast("int"), F.lit(1)).alias("letter"))
    zero = number(F.lit(0))
    line = lambda *v: F.concat(F.lit("\n    "), *v)
    text = F.concat(
        F.format_string("%s%02d 2024 01 %02d %02d %02d %02d", "letter", 1 + k * 7 % 30, 7 + day, F.floor(second / 3600), F.floor(second / 60) % 60, second % 60), zero, zero, zero,
        line(zero, number(k % 50), zero, number(k % 628 / 100)), line(zero, number((1 + k % 20) / 1000), zero, root), line(number(toe), zero, number(k * 3 % 628 / 100), zero),
        line(number(0.9 + k % 10 / 100), number(k % 99), number(k * 5 % 628 / 100), zero), line(zero, zero, number(week), zero), line(zero), line(zero, zero), F.lit("\n"),
    )
    of = rows.select(F.floor(k / 40).cast("string").alias("file"), "p_partkey", text.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))), lambda r: r["t"]), "")
    return of.groupBy("file").agg(F.concat(F.lit(_HEAD), joined).alias("text"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.parsed(navigation.records(_files(spark, sf_dir)))


@query(f"""with {_PARTS}, ok as (select * from g where file not in (select file from g where problem is not null)), r as (select *, toe + case letter when 'C' then 940 else 2296 end * 604800::bigint + case letter when 'C' then 820108814 else 0 end + 315964800 - 18 as epoch, letter || lpad(sv::varchar, 2, '0') as name, k % 40 as pos, file::varchar as ft from ok),
 b as (select *, row_number() over (partition by name order by epoch desc, pos, ft desc) as rn from r) select name, ft as file, epoch::double as epoch_unix, 5153.0::double + k % 7 as sqrt_a, (1 + k % 20) / 1000 as e, k % 628 / 100 as m0, k * 5 % 628 / 100 as omega, (k % 50)::double as crs, toe::double as toe from b where rn = 1""")
def s6_navigation_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest orbit of each satellite in the files that are whole."""
    kept = navigation.catalogue(navigation.whole_files(_catalogue(spark, sf_dir)))
    return kept.select("name", "file", "epoch_unix", "sqrt_a", "e", "m0", "omega", F.col("crs"), "toe")


@query(f"with {_PARTS} select file::varchar as file, string_agg(distinct problem, ',' order by problem) as problems from g where problem is not null group by 1")
def s6_refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with unusable records, and why."""
    return navigation.refused(_catalogue(spark, sf_dir))
