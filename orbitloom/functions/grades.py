"""States of measurements against bands, and cleaning of shown texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States from worst to best.
STATES = ["unassured", "inconsistent", "unavailable", "assured"]


def scaled_limit(accuracy: Column, sigmas: float, low: float, high: float) -> Column:
    """So many sigmas, but within the limits."""
    return F.least(F.greatest(accuracy * sigmas, F.lit(float(low))), F.lit(float(high)))


def graded(value: Column, inconsistent: Column, unassured: Column) -> Column:
    """A state for a value strictly above its limits."""
    return F.when(value > unassured, "unassured").when(value > inconsistent, "inconsistent").when(value.isNotNull(), "assured").otherwise("unavailable")


def graded_from(value: Column, inconsistent: float, unassured: float) -> Column:
    """A state for a value that reaches its limits."""
    return F.when(value >= unassured, "unassured").when(value >= inconsistent, "inconsistent").when(value.isNotNull(), "assured").otherwise("unavailable")


def rank(state: Column) -> Column:
    """0 for the worst state."""
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state) - 1


def worst(*states: Column) -> Column:
    """The worst of some states."""
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.least(*[rank(s) for s in states]) + 1).cast("int"))


def jump_band(value: Column, warn: float, severe: float) -> Column:
    """ok, warn or crit of a jump."""
    return F.when(value >= severe, "crit").when(value >= warn, "warn").otherwise("ok")


def raised(**flags: Column) -> Column:
    """Names of the raised flags in order, joined by '+'; empty if all are clear."""
    return F.concat_ws("+", *[F.when(on, F.lit(n)) for n, on in flags.items()])


def hysteresis(value: Column, enter: float, leave: float, order) -> Column:
    """Whether a value that enters at one limit has not yet fallen below the other: the last crossing decides. order: a window up to the row."""
    return F.coalesce(F.last(F.when(value >= enter, F.lit(True)).when(value < leave, F.lit(False)), ignorenulls=True).over(order), F.lit(False))


def shown(text: Column, most: int = 256) -> Column:
    """A text without control, format and replacement characters, cut to so many UTF-8 bytes at a whole character."""
    clean = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\x{FFFD}]", "")
    head = F.substring(clean, 1, most)  # no character takes less than a byte
    lengths = F.transform(F.sequence(F.lit(0), F.length(head)), lambda n: F.struct(F.octet_length(F.substring(head, F.lit(1), n)).alias("bytes"), n.alias("n")))
    fits = F.array_max(F.transform(F.filter(lengths, lambda x: x["bytes"] <= most), lambda x: x["n"]))
    return F.when(F.octet_length(head) <= most, head).otherwise(F.substring(head, F.lit(1), fits))
