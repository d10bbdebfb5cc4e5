"""Sets put together from fragments that arrive one by one, by windows over each relay's or satellite's receipts.

The newest fragment of each kind so far is carried along in one sorted pass; nothing is joined with itself. Families of
messages differ in the kinds they need, in what must agree, and in the kinds that may carry a clock: see FAMILIES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_S = 604_800


@dataclass(frozen=True)
class Family:
    """kinds: fragments that make a set. low_bits: kinds whose issue counts by its 8 low bits. named: kinds whose own satellite number must be
    the satellite's. equal: whether issues must agree. apart: for kinds sent one after the other, seconds of week between neighbours.
    near_s: most seconds of week between the kinds. clock: kinds of which the newest gives the clock if its time of clock is the issue."""

    kinds: tuple[int, ...]
    low_bits: tuple[int, ...] = ()
    named: tuple[int, ...] = ()
    equal: bool = True
    apart: int | None = None
    near_s: int | None = None
    clock: tuple[int, ...] = ()
    clock_near_s: int | None = None


#: The message families' rules.
FAMILIES = {
    "lnav": Family((1, 2, 3), low_bits=(1,)),
    "inav": Family((1, 2, 3, 4), named=(4,)),
    "fnav": Family((1, 2, 3, 4), named=(1,)),
    "cnav": Family((10, 11), named=(10, 11), clock=(30, 31, 32, 33, 34, 35, 36, 37)),
    "d1": Family((1, 2, 3), equal=False, apart=6),
    "bcnav2": Family((10, 11), named=(10, 11), equal=False, near_s=3, clock=(30, 34), clock_near_s=600),
}


def wrapped(a: Column, b: Column, period: int = WEEK_S) -> Column:
    """b - a on a clock with this period, within half of it."""
    half = period // 2
    return F.pmod(b - a + half, F.lit(period)) - half


def assembled(fragments: DataFrame, key: list[str], order: list[str], family: Family, sv: str = "sv") -> DataFrame:
    """A row for each new set: key..., order..., issue, seqs of its fragments, clock_seq (null without a coherent clock).

    fragments: key..., order..., seq, kind, issue (of a clock kind: its time of clock), named_sv, sow. A set is new when its
    issue is not that of the key's set before; where issues need not agree, that of the second kind counts. Other kinds pass by."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    body = F.struct("seq", "issue", "named_sv", "sow")
    of = {k: F.last(F.when(F.col("kind") == k, body), ignorenulls=True).over(w).alias(f"_f{k}") for k in family.kinds}
    used = fragments.filter(F.col("kind").isin([*family.kinds, *family.clock]))
    clock = [F.last(F.when(F.col("kind").isin(list(family.clock)), body), ignorenulls=True).over(w).alias("_clock")] if family.clock else []
    rows = used.select(*used.columns, *of.values(), *clock)
    parts = {k: F.col(f"_f{k}") for k in family.kinds}
    issue = {k: p["issue"].bitwiseAND(255) if k in family.low_bits else p["issue"] for k, p in parts.items()}
    first, *others = family.kinds
    fits = F.lit(True)
    for k in family.kinds:
        fits = fits & parts[k].isNotNull()
    for k in family.named:
        fits = fits & (parts[k]["named_sv"] == F.col(sv))
    for a, b in zip(family.kinds, others):
        if family.equal:
            fits = fits & (issue[a] == issue[b])
        if family.apart is not None:
            fits = fits & (wrapped(parts[a]["sow"], parts[b]["sow"]) == family.apart)
        if family.near_s is not None:
            fits = fits & (F.abs(wrapped(parts[a]["sow"], parts[b]["sow"])) <= family.near_s)
    found = rows.filter(F.coalesce(fits, F.lit(False))).withColumn("_issue", issue[others[0]])
    fine = F.lit(False)
    if family.clock:
        fine = F.col("_clock")["issue"] == F.col("_issue") if family.clock_near_s is None else F.abs(wrapped(parts[first]["sow"], F.col("_clock")["sow"])) <= family.clock_near_s
        fine = fine & (F.col("_clock")["named_sv"] == F.col(sv))
    clock_seq = F.when(fine, F.col("_clock")["seq"]) if family.clock else F.lit(None).cast("long")
    plain = Window.partitionBy(*key).orderBy(*order)
    found = found.withColumn("_new", ~F.col("_issue").eqNullSafe(F.lag("_issue").over(plain)) | F.lag("_issue").over(plain).isNull())
    return found.filter("_new").select(*key, *order, F.col("_issue").alias("issue"), F.array(*[p["seq"] for p in parts.values()]).alias("seqs"), clock_seq.alias("clock_seq"))


def coherent(strings: DataFrame, relay: list[str], satellite: list[str], order: list[str], window_s: float = 8) -> DataFrame:
    """Sets of GLONASS strings 1 to 3 of one relay within window_s, at each of its strings 1 to 4 that leaves them so: seqs, tb, and the clock.

    strings: relay..., satellite..., order..., seq, at (microseconds of the feeder), number, tb (string 2), tau (string 4). String 4 counts if the
    four lie within the window. A set without it takes over the satellite's known clock of the sets before, within one tb."""
    w = Window.partitionBy(*relay).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    body = F.struct("at", "seq", "tb", "tau")
    rows = strings.filter(F.col("number").between(1, 4))
    rows = rows.select(*rows.columns, *[F.last(F.when(F.col("number") == n, body), ignorenulls=True).over(w).alias(f"_s{n}") for n in (1, 2, 3, 4)])
    at = [F.col(f"_s{n}")["at"] for n in (1, 2, 3)]
    low, high = F.least(*at), F.greatest(*at)
    span = int(window_s * 1e6)
    whole = F.col("_s1").isNotNull() & F.col("_s2").isNotNull() & F.col("_s3").isNotNull() & (high - low <= span)
    with_clock = F.greatest(high, F.col("_s4")["at"]) - F.least(low, F.col("_s4")["at"]) <= span
    sets = rows.filter(whole).withColumns({"tb": F.col("_s2")["tb"], "tau": F.when(F.col("_s4").isNotNull() & with_clock, F.col("_s4")["tau"]), "seqs": F.array(*[F.col(f"_s{n}")["seq"] for n in (1, 2, 3)])})
    s = Window.partitionBy(*satellite).orderBy(*order)
    island = F.sum(F.coalesce((F.col("tb") != F.lag("tb").over(s)).cast("int"), F.lit(0))).over(s.rowsBetween(Window.unboundedPreceding, 0))
    kept = Window.partitionBy(*satellite, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sets = sets.withColumn("_island", island).withColumn("clock", F.last("tau", ignorenulls=True).over(kept))
    columns = list(dict.fromkeys([*satellite, *relay, *order]))
    return sets.select(*columns, "seqs", "tb", "clock", (F.col("clock").isNotNull() & F.col("tau").isNull()).alias("carried"))


def adjacent(pages: DataFrame, relay: list[str], order: list[str], number: str, at: str, most_s: float = 8) -> DataFrame:
    """Pairs of pages n (n even) and n + 1 of one relay, the second 0 to most_s after the first: first_seq, second_seq. A page that comes between takes the first one's place."""
    w = Window.partitionBy(*relay).orderBy(*order)
    before = F.lag(F.struct("seq", number, at)).over(w)
    rows = pages.withColumn("_before", before)
    gap = (F.col(at) - F.col("_before")[at]) / 1e6
    fits = (F.col("_before")[number] % 2 == 0) & (F.col(number) == F.col("_before")[number] + 1) & gap.between(0, most_s)
    return rows.filter(fits).select(*relay, F.col("_before")["seq"].alias("first_seq"), F.col("seq").alias("second_seq"), number)


def solution_epochs(messages: DataFrame, key: list[str], order: list[str], tow: str, payloads: list[str], end: Column | None = None) -> DataFrame:
    """Messages of one time of week merged into one row: key..., tow, arrived (the earliest `at`), the first value of each payload.

    An epoch closes with the next time of week or an end marker; messages that repeat the epoch just closed by a marker are dropped."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.coalesce(F.col(tow) != F.lag(tow).over(w), F.lit(True))
    rows = messages.withColumn("_epoch", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if end is not None:
        rows = rows.withColumn("_end", F.coalesce(end, F.lit(False))).withColumn("_closed", F.coalesce(F.max("_end").over(Window.partitionBy(*key, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).filter(~F.col("_closed"))
    first = [F.min_by(F.col(p), F.when(F.col(p).isNotNull(), F.struct(*order))).alias(p) for p in payloads]
    return rows.groupBy(*key, "_epoch", tow).agg(F.min("at").alias("arrived"), *first).drop("_epoch")


def latched(rows: DataFrame, key: list[str], order: list[str], at: str, flag: Column, hold_s: float, name: str = "held") -> DataFrame:
    """rows with whether the last one with the flag (this one included) is less than hold_s ago."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(flag, F.col(at))).over(w)
    return rows.withColumn(name, F.coalesce(F.col(at) - last < int(hold_s * 1e6), F.lit(False)))


def arcs(pairs: DataFrame, key: list[str], order: list[str], gap_s: float = 5, least: int = 10) -> DataFrame:
    """Dual-frequency pairs with their arc, the pairs in it so far, and the slant delay at the first frequency once there are `least`.

    pairs: key..., order..., at (seconds), code and phase (geometry-free, metres), has_phase, lock_ms, half_cycle, slip, f1, f2. An arc breaks where phase is
    missing before or now, at a slip, a change of the half-cycle state, a fall of the lock time, a step back in time and a gap over gap_s. Phase is
    levelled on code by the running mean of their difference within the arc."""
    w = Window.partitionBy(*key).orderBy(*order)
    was = {c: F.lag(c).over(w) for c in ("at", "has_phase", "lock_ms", "half_cycle")}
    step = F.col("at") - was["at"]
    breaks = ~was["has_phase"] | ~F.col("has_phase") | F.col("slip") | (F.col("half_cycle") != was["half_cycle"]) | (F.col("lock_ms") < was["lock_ms"]) | (step < 0) | (step > gap_s)
    rows = pairs.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("arc", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")
    inside = Window.partitionBy(*key, "arc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.col("has_phase")
    rows = rows.withColumns({"n": F.count_if(usable).over(inside), "_mean": F.avg(F.when(usable, F.col("code") - F.col("phase"))).over(inside)})
    gamma = F.pow(F.col("f1") / F.col("f2"), 2)
    slant = F.when(usable & (F.col("n") >= least) & (F.col("f1") != F.col("f2")), (F.col("phase") + F.col("_mean")) / (gamma - 1))
    return rows.withColumn("slant", slant).drop("_mean")
