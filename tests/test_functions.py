"""Scalar functions on cases by hand."""

from pyspark.sql import functions as F

from orbitloom.functions import atmosphere, gnsstime, grades, signals


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_weeks(spark):
    # GPS week 2048 began on 2019-04-07 00:00:00 GPS time, 18 s before that UTC second
    at = gnsstime.system_seconds(F.lit(0), F.lit(1554595182))
    assert one(spark, gnsstime.week(at), gnsstime.time_of_week(at), gnsstime.full_week(F.lit(0), 10, at)) == (2048, 0, 2048)
    galileo = gnsstime.system_seconds(F.lit(2), F.lit(1554595182))
    assert one(spark, gnsstime.week(galileo), gnsstime.system_seconds(F.lit(6), F.lit(0))) == (1024, None)
    assert one(spark, gnsstime.week_delta(F.lit(6), F.lit(604794)), gnsstime.four_year_day(F.lit(1704067200.0))) == (12, 1)
    assert one(spark, gnsstime.week_mismatch(F.lit(2047), at), gnsstime.week_mismatch(F.lit(2047), at + 14400)) == (False, True)


def test_accuracies(spark):
    assert one(spark, signals.user_range_accuracy(F.lit(15)), signals.user_range_accuracy(F.lit(-16), -15), signals.signal_in_space_accuracy(F.lit(126)), signals.glonass_accuracy(F.lit(15))) == (None,) * 4
    assert one(spark, signals.user_range_accuracy(F.lit(6)), signals.signal_in_space_accuracy(F.lit(125)), signals.glonass_accuracy(F.lit(14))) == (16.0, 6.0, 512.0)


def test_names(spark):
    assert one(spark, signals.name(F.lit(0), F.lit(5), F.lit(0)), signals.name(F.lit(5), F.lit(3)), signals.letter(F.lit(4))) == ("G05@0", "J03", "?")
    assert one(spark, signals.canonical(F.lit(2), F.lit(1)), signals.canonical(F.lit(6), F.lit(2)), signals.frequency(F.lit(6), F.lit(0), F.lit(7)), signals.frequency(F.lit(4), F.lit(0), F.lit(0))) == (0, 2, 1602e6, None)


def test_states(spark):
    assert one(spark, grades.worst(F.lit("assured"), F.lit("unavailable")), grades.worst(F.lit("unavailable"), F.lit("inconsistent"))) == ("unavailable", "inconsistent")
    assert one(spark, grades.graded(F.lit(2.0), F.lit(2.0), F.lit(4.0)), grades.graded_from(F.lit(4.0), 2, 4), grades.graded(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0))) == ("assured", "unassured", "unavailable")


def test_shown_texts(spark):
    got = one(spark, grades.shown(F.lit("a‮b\u0007c�")), grades.shown(F.lit("é" * 200)), grades.shown(F.lit("")), grades.shown(F.lit(None).cast("string")))
    assert got == ("abc", "é" * 128, "", None)


def test_air(spark):
    dew, dry = one(spark, atmosphere.dew_point(F.lit(20.0), F.lit(100.0)), atmosphere.virtual_temperature(F.lit(20.0), F.lit(None).cast("double"), F.lit(1e5)))
    assert abs(dew - 20) < 1e-9 and abs(dry - 293.15) < 1e-9
    assert one(spark, atmosphere.log_pressure_rate(F.lit(0.0), F.lit(1.0), F.lit(1.0)), atmosphere.combined(F.lit(3.0), F.lit(4.0))) == (None, 5.0)
