"""Navigation files: broadcast records against precise places, broken ones, and reading by several tasks."""

import math
import tempfile

from pyspark.sql import functions as F

from orbitloom.functions import gnsstime, orbits
from orbitloom.sources import navigation

# Broadcast records of 10 January 2024, and precise places of two of their satellites at half past twelve of GPS time.
HEAD = "     3.05           N: GNSS NAV DATA    M: MIXED            RINEX VERSION / TYPE\n                                                            END OF HEADER\n"
G05 = """G05 2024 01 10 12 00 00-1.574293710291e-04-1.477928890381e-12 0.000000000000e+00
     3.800000000000e+01-1.787500000000e+02 4.180888436499e-09 3.070734965626e+00
    -9.324401617050e-06 5.774090415798e-03 5.723908543587e-06 5.153794351578e+03
     3.024000000000e+05 5.587935447693e-08-7.568817821586e-01-5.029141902924e-08
     9.694621079767e-01 2.741250000000e+02 1.235315548011e+00-7.893185925733e-09
    -1.714357124141e-10 1.000000000000e+00 2.296000000000e+03 0.000000000000e+00
     2.000000000000e+00 0.000000000000e+00-1.117587089539e-08 3.800000000000e+01
     2.952180000000e+05 4.000000000000e+00                                      
"""  # noqa: W291
C11 = """C11 2024 01 10 12 00 00 3.509763628240e-04 1.904698621050e-11-1.097754699640e-18
     1.900000000000e+01 1.710937500000e+02 3.307280618660e-09 1.278790328050e+00
     8.458271622660e-06 2.237519482150e-03 1.111067831520e-06 5.282638473510e+03
     3.024000000000e+05 5.401670932770e-08-2.294270989230e+00-9.872019290920e-08
     9.850746198780e-01 3.503906250000e+02-1.644071238190e+00-6.858142812030e-09
     3.400141629550e-10                    9.400000000000e+02                   
     2.000000000000e+00 0.000000000000e+00 3.400000059270e-09 1.900000000000e-09
     3.049500000000e+05 1.800000000000e+01                                      
"""  # noqa: W291
R09 = """R09 2024 01 10 12 15 00 1.636147499084e-04 2.728484105319e-12 3.024000000000e+05
     5.836779296875e+03 6.836509704590e-02 2.793967723846e-09 0.000000000000e+00
    -2.454274658203e+04-5.588130950928e-01 2.793967723846e-09-2.000000000000e+00
    -4.034110839844e+03 3.479768753052e+00-1.862645149231e-09 0.000000000000e+00
"""
NOON = 1704888000  # 12:00 UTC of that day
PLACES = {"G05": (14412808.052, 5559840.190, -21791820.530, 8), "C11": (23058546.809, 15469428.441, -2758626.850, 10), "R09": (5830691.877, -24858159.659, -936999.923, 20)}


def parsed(spark, *texts):
    files = spark.createDataFrame([(f"f{i:02}", t) for i, t in enumerate(texts)], "file string, text string")
    return navigation.parsed(navigation.records(files))


def test_against_precise_places(spark):
    found = navigation.catalogue(parsed(spark, HEAD + G05 + C11, HEAD.replace("\n", "\r\n") + R09.replace("\n", "\r\n") + R09.replace("R09", "R27")))
    at = NOON + 1800 - gnsstime.LEAP_S
    tow = gnsstime.time_of_week(gnsstime.system_seconds(F.col("gnss"), F.lit(at)))
    rows = orbits.with_kepler(found.withColumn("tow", tow.cast("double")), "tow")
    moved = orbits.integrated([F.col(c) for c in ("gx", "gy", "gz", "gvx", "gvy", "gvz")], [F.col(c) for c in ("gax", "gay", "gaz")], at - F.col("epoch_unix"))
    got = {r.name: r for r in rows.withColumn("moved", F.when(F.col("gnss") == 6, moved)).collect()}
    assert sorted(got) == sorted(PLACES)
    for name, (x, y, z, most) in PLACES.items():
        r = got[name]
        mine = r.moved or (r.position.x, r.position.y, r.position.z)
        assert math.dist(mine, (x, y, z)) < most
    assert got["G05"].epoch_unix == NOON - 18 and got["C11"].epoch_unix == NOON - 4 and got["R09"].epoch_unix == NOON + 900


def test_broken_files(spark):
    good = HEAD + G05
    cases = {
        "not_navigation_3": good.replace("3.05", "2.11"), "missing_header": None, "unfinished_header": good.replace("END OF HEADER", ""), "no_records": HEAD + "\n  \n", "number": good.replace("5.153794351578e+03", "NaN              "),
        "missing_field": good.replace("5.153794351578e+03", "                  "), "week_disagrees": good.replace("2.296000000000e+03", "1.296000000000e+03"), "calendar": good.replace("2024 01 10 12", "2024 02 31 12"), "incomplete": good[: good.rindex("     2.952180")],
        "satellite": good.replace("G05", "G33"), "unsupported": good.replace("G05", "X05"), "week": good.replace("3.024000000000e+05", "6.048000000000e+05"), "orbit": good.replace("5.153794351578e+03", "1.153794351578e+03"), "oversized": good + "     1.0\n" * 2, "short_epoch": HEAD + "G05 2024\n",
    }
    rows = parsed(spark, *cases.values())
    assert {r.file: r.problems for r in navigation.refused(rows).collect()} == {f"f{i:02}": name for i, name in enumerate(cases)}
    assert navigation.whole_files(rows).count() == 0 and navigation.catalogue(rows).count() == 0


def test_latest_and_outside(spark):
    older = G05.replace("12 00 00", "10 00 00").replace("3.024000000000e+05", "2.952000000000D+05")
    sbas = "S27 2024 01 10 12 00 00 0.0\n" + "     0.0\n" * 3
    rows = parsed(spark, HEAD + G05 + older + sbas, HEAD + older + C11[:400])
    assert sorted((r.name, r.file, r.number) for r in navigation.catalogue(rows).collect()) == [("G05", "f00", 1)]
    assert {(r.name, r.problem) for r in rows.collect()} == {("G05", None), ("S27", "outside"), ("C11", "incomplete")}
    assert {r.file for r in navigation.whole_files(rows).collect()} == {"f00"}


def test_read_folder_by_several_tasks(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for i in range(6):
        with open(f"{folder}/day{i}.rnx", "w") as f:
            f.write(HEAD + "".join(G05.replace("G05", f"G{sv:02}") for sv in range(1, 33)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # far less than a file: no record may be lost where a split would fall
    try:
        files = navigation.read(spark, "file://" + folder)
        assert files.rdd.getNumPartitions() > 1
        rows = navigation.parsed(navigation.records(files))
        assert rows.agg(F.count_if(F.col("problem").isNull())).first()[0] == 6 * 32
        assert navigation.catalogue(rows).count() == 32
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
