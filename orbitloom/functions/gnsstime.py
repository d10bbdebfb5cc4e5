"""System times, weeks, leap seconds and GLONASS days as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the GPS epoch, of a week, and of each system's epoch after the GPS epoch (by constellation id:
# 0 GPS, 2 Galileo, 3 BeiDou, 5 QZSS, 7 NavIC); the leap seconds in force; the grace of a week number after a rollover.
GPS_EPOCH_UNIX = 315964800
WEEK_S = 604800
EPOCH_GPS_S = {0: 0, 2: 619315200, 3: 820108814, 5: 0, 7: 619315200}
LEAP_S = 18
ROLLOVER_GRACE_S = 14400
MOSCOW_S = 10800
# Seconds that a row may be late to be live, and that an observer's clock may be ahead.
LIVE_S, LEAD_S = 2, 1


def system_seconds(gnss: Column, unix: Column, leap: int = LEAP_S) -> Column:
    """Seconds since the epoch of a constellation's continuous time; null for those without one."""
    epoch = F.create_map(*[F.lit(v) for pair in EPOCH_GPS_S.items() for v in pair])
    return unix - GPS_EPOCH_UNIX + leap - F.try_element_at(epoch, gnss.cast("int"))


def week(seconds: Column) -> Column:
    """Whole weeks of system_seconds."""
    return F.floor(seconds / WEEK_S)


def time_of_week(seconds: Column) -> Column:
    """Seconds into the week, from 0, of system_seconds."""
    return F.pmod(seconds, F.lit(WEEK_S))


def to_unix(gnss: Column, weeks: Column, tow: Column, leap: int = LEAP_S) -> Column:
    """Unix seconds of a week and time of week."""
    epoch = F.create_map(*[F.lit(v) for pair in EPOCH_GPS_S.items() for v in pair])
    return weeks * WEEK_S + tow + F.try_element_at(epoch, gnss.cast("int")) + GPS_EPOCH_UNIX - leap


def week_delta(a: Column, b: Column, period: int = WEEK_S) -> Column:
    """a - b of whole seconds of the week, taken to half a period around zero."""
    d = (a - b) % period
    return F.when(d > period // 2, d - period).when(d < -(period // 2), d + period).otherwise(d)


def full_week(truncated: Column, bits: int, seconds: Column) -> Column:
    """The week with these low bits that is nearest to an approximate instant (system_seconds)."""
    span = 1 << bits
    about = seconds / WEEK_S
    guess = F.round(about / span) * span + truncated
    off = guess - F.round(about)
    return F.when(off > span // 2, guess - span).when(off < -(span // 2), guess + span).otherwise(guess).cast("long")


def week_mismatch(broadcast: Column, seconds: Column) -> Column:
    """Whether a full broadcast week is not the current one; a lag by one week is granted shortly after the rollover."""
    lags = (broadcast == week(seconds) - 1) & (time_of_week(seconds) < ROLLOVER_GRACE_S)
    return (broadcast != week(seconds)) & ~lags


def moscow_second(unix: Column) -> Column:
    """Whole second of the GLONASS day (UTC + 3 h)."""
    return F.pmod(F.floor(unix) + MOSCOW_S, F.lit(86400))


def four_year_day(unix: Column) -> Column:
    """Day within the four years that begin with a leap year, from 1, on GLONASS time."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((unix + MOSCOW_S) / 86400).cast("int"))
    return F.datediff(day, F.make_date(F.year(day) - (F.year(day) - 1996) % 4, F.lit(1), F.lit(1))) + 1


def utc_offset(a0: Column, a1: Column, a2: Column, now: Column, reference: Column, leap: Column, next_leap: Column, leap_week: Column, leap_day: Column) -> Column:
    """Broadcast offset from UTC in seconds at a system time: polynomial and leap seconds, the next ones from the end of their day on."""
    dt = now - reference
    return F.when(now >= leap_week * WEEK_S + (leap_day + 1) * 86400, next_leap).otherwise(leap) + a0 + a1 * dt + a2 * dt * dt


def galileo_gps_offset(a0: Column, a1: Column, t0: Column, week0: Column, unix: Column, leap: int = LEAP_S) -> Column:
    """Nanoseconds between Galileo and GPS time at an instant, from the broadcast offset, rate, reference second and 6-bit reference week."""
    now = system_seconds(F.lit(2), unix, leap)
    then = full_week(week0, 6, now) * WEEK_S + t0
    return (a0 + a1 * (now - then)) * 1e9


def utc_reference(received: Column, local: Column, stamped: Column, network: Column) -> tuple[Column, Column]:
    """The instant (Unix seconds) that a solution's UTC is held against, null if none can be trusted, and whether it is the collector's own clock.

    local: the collector's clock at receipt, null for a connection whose received is that clock already; stamped: the observer stamped the row;
    network: the stamp comes from a clock that does not follow the satellites. A row at most LIVE_S old counts as live."""
    lag = local - received
    live = local.isNull() | (stamped & (lag >= -LEAD_S) & (lag <= LIVE_S))
    stamp = F.when(local.isNull(), received).when(~stamped | (lag < -LEAD_S), None).when(lag <= LIVE_S, local).when(network, received)
    return stamp, F.coalesce(live, F.lit(False))
