"""Fleet views: scopes and projections, rosters, corroboration, fusion, deficits, upserts and byte-bounded pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deny_reasons(rules: dict[str, Column]) -> Column:
    """Names of all rules that hold, in the order given, comma-joined; empty if none does."""
    return F.concat_ws(",", *[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def roster(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per id of any source, with a flag for each source that has it."""
    tagged = [df.select(key, *[F.lit(n == name).alias(n) for n in sources]) for name, df in sources.items()]
    return reduce(DataFrame.unionAll, tagged).groupBy(key).agg(*[F.bool_or(n).alias(n) for n in sources])


def witnessed_elsewhere(orbits: DataFrame, heard: DataFrame, key: str, source: str, site: str) -> DataFrame:
    """Orbits that another source than the row's own site heard; smallest and largest source of a key decide, so no pairs are made."""
    ends = heard.groupBy(key).agg(F.min(source).alias("_least"), F.max(source).alias("_most"))
    return orbits.join(ends, key).filter((F.col("_least") != F.col(site)) | (F.col("_most") != F.col(site))).drop("_least", "_most")


def corroboration(votes: DataFrame, key: list[str], source: str, weight: Column) -> DataFrame:
    """Distinct sources of each key and the sum of their weights, the smallest weight of each source counting."""
    each = votes.groupBy(*key, source).agg(F.min(weight).alias("_w"))
    return each.groupBy(*key).agg(F.count("*").alias("witnesses"), F.round(F.sum("_w"), 6).alias("trust"))


def fused(levels: DataFrame, key: list[str], level: str, domain: str, weight: str) -> DataFrame:
    """Weighted mean level, the domains at the worst level, and the final state: 2 needs two domains, 1 needs one, else 0."""
    worst = F.array_sort(F.collect_set(F.when(F.col(level) == 2, F.col(domain))))
    done = levels.groupBy(*key).agg(F.round(F.sum(F.col(level) * F.col(weight)) / F.sum(weight), 6).alias("mean_level"), worst.alias("_worst"))
    state = F.when(F.size("_worst") >= 2, "unassured").when(F.size("_worst") == 1, "inconsistent").otherwise("assured")
    return done.select(*key, "mean_level", F.array_join("_worst", ",").alias("unassured"), state.alias("state"))


def deficit(expected: DataFrame, observed: DataFrame, key: list[str], item: str, least: int, percent: int) -> DataFrame:
    """Of each key: expected items, those observed, and whether too many are missing in number and in percent."""
    seen = observed.select(*key, item).distinct().withColumn("_seen", F.lit(1))
    joined = expected.join(seen, [*key, item], "left")
    missing = F.col("expected") - F.col("observed")
    counted = joined.groupBy(*key).agg(F.count("*").alias("expected"), F.count("_seen").alias("observed"))
    return counted.withColumn("bad", (missing >= least) & (100 * missing >= percent * F.col("expected")))


def newest_wins(old: DataFrame, new: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """The row with the latest stamp of each key over both tables, partially aggregated before the shuffle."""
    both = old.unionByName(new)
    return both.groupBy(*key).agg(F.max_by(F.struct(*[c for c in both.columns if c not in key]), stamp).alias("_r")).select(*key, "_r.*")


def byte_page(rows: DataFrame, key: str, order: list[str], body: Column, budget: int) -> DataFrame:
    """The first rows of each key whose bodies together fit the budget of bytes (the page is the feature)."""
    spent = F.sum(F.octet_length(body)).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("spent", spent).filter(F.col("spent") <= budget)
