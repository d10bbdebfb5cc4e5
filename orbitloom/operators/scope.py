"""Who may see which row: audience scopes, public projections, signal grants, sanity filters, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitloom.functions import signals


def allows(kind: str, who: Column | None = None) -> Column:
    """Whether an audience may use a row with collector, organization, collections and public (eligible); unknown kinds and empty names: never."""
    named = F.lit(False) if who is None else F.coalesce(who != "", F.lit(False))
    rule = {
        "public": F.col("public"),
        "operator": named & (F.col("collector") == who) if who is not None else F.lit(False),
        "organization": named & (F.col("organization") == who) if who is not None else F.lit(False),
        "collection": named & F.array_contains("collections", who) if who is not None else F.lit(False),
    }.get(kind, F.lit(False))
    return F.coalesce(rule, F.lit(False))


def selector(gnss: Column, signal: Column) -> Column:
    """gnss:signal in the canonical space."""
    return F.concat_ws(":", gnss.cast("string"), signals.canonical(gnss, signal).cast("string"))


def granted(grants: Column, gnss: Column, signal: Column) -> Column:
    """Whether a grant list (null: everything) holds the signal."""
    return grants.isNull() | F.array_contains(grants, selector(gnss, signal))


def granted_only(declared: Column, grants: Column) -> Column:
    """Declared canonical signals inside the grant, each once, sorted."""
    kept = F.when(grants.isNull(), declared).otherwise(F.array_intersect(declared, grants))
    return F.array_sort(F.array_distinct(kept))


def public_rows(rows: DataFrame, private: list[str], measured: list[str]) -> DataFrame:
    """Rows (board, public, use, grants, gnss, sig, source, observer, declared) as the public may have them: no board rows, only eligible
    policies and granted signals; columns in private are blank; anonymous rows lose the source and the measured columns."""
    ok = ~F.col("board") & F.col("public") & F.col("use").isin("anonymous", "attributed") & granted(F.col("grants"), F.col("gnss"), F.col("sig"))
    named = F.col("use") == "attributed"
    shown = {c: F.lit(None).cast(rows.schema[c].dataType) for c in private} | {c: F.when(named, F.col(c)) for c in measured}
    return rows.filter(F.coalesce(ok, F.lit(False))).withColumns({**shown, "source": F.when(named, F.col("observer")).otherwise("anonymous"), "declared": granted_only(F.col("declared"), F.col("grants"))}).drop("board", "public", "grants", "observer")


def sane(tow: Column, range_m: Column, doppler: Column) -> Column:
    """Whether an observation is finite and within bounds."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return finite(tow) & (tow >= 0) & (tow < 604800) & finite(range_m) & (range_m > 0) & (range_m <= 1e9) & finite(doppler) & (F.abs(doppler) <= 1e6)


def carrier_valid(valid: Column, half_cycle: Column, reset: Column, cycles: Column) -> Column:
    """Whether the carrier may be used; a row stays without it."""
    return valid & half_cycle & ~reset & cycles.isNotNull() & ~F.isnan(cycles) & (F.abs(cycles) <= 1e10)


def orbit_status(gnss: Column, age_s: Column, delayed: Column) -> Column:
    """fit inside the fit window, coast beyond it while the catalogue is delayed and the limit is not reached, else none (6: GLONASS)."""
    low, high = F.when(gnss == 6, -900).otherwise(-7200), F.when(gnss == 6, 1800).otherwise(14400)
    limit = F.when(gnss == 6, 172800).otherwise(259200)
    return F.when(age_s.between(low, high), "fit").when(delayed & (age_s > high) & (age_s <= limit), "coast").otherwise("none")


def catalogue_status(age_s: Column) -> Column:
    """current up to 35 minutes after the fetch, delayed later or before it, unavailable without one."""
    return F.when(age_s.isNull(), "unavailable").when(age_s.between(0, 2100), "current").otherwise("delayed")


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0, most: int = 500, deepest: int = 100_000) -> DataFrame:
    """size rows from offset in order, with has_more: one row further is read. Sizes go to 1..most; deeper offsets are an error."""
    if not 0 <= offset <= deepest:
        raise ValueError(f"offset {offset} is not in 0..{deepest}")
    size = max(1, min(size, most))
    top = rows.orderBy(*order).offset(offset).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order))  # at most most + 1 rows
    return top.withColumn("place", place).withColumn("has_more", F.max("place").over(Window.partitionBy()) > size).filter(F.col("place") <= size)


def top_n(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each key (the feature) with place and overflow: Spark keeps n + 1 a key before the shuffle."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).filter(F.col("place") <= n + 1)
    return ranked.withColumn("overflow", F.max("place").over(w) > n).filter(F.col("place") <= n)


def both_allow(receipt: Column, current: Column) -> Column:
    """Sorted signals that the policy at receipt and the current one both name; null if either is null."""
    return F.array_sort(F.array_intersect(receipt, current))
