"""Navigation records of RINEX 3 text files as typed orbits. Daily files are read whole, one row a file, so no record is ever cut by a split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.functions import gnsstime, orbits

# Systems by letter (constellation, largest satellite number), the letters left out beside them with their number of lines, and the
# fields by place (three of the first line, four of each other) that become columns; fields a record cannot lack; largest week;
# distances from the earth's centre that an orbit can have.
SYSTEMS = {"G": (0, 32), "E": (2, 36), "C": (3, 63), "J": (5, 10), "R": (6, 24)}
OUTSIDE = {"S": 4, "I": 8}
KEPLER = {
    "crs": 4, "delta_n": 5, "m0": 6, "cuc": 7, "e": 8, "cus": 9, "sqrt_a": 10, "toe": 11, "cic": 12, "omega0": 13, "cis": 14, "i0": 15, "crc": 16, "omega": 17, "omega_dot": 18, "i_dot": 19, "week": 21,
}
STATE = {"gx": 3, "gvx": 4, "gax": 5, "gy": 7, "gvy": 8, "gay": 9, "gz": 11, "gvz": 12, "gaz": 13}
NEAREST_M, FARTHEST_M = 2e7, 5e7
MOST_WEEK, MOST_LINES, HEADER_LINES, AGREE_S = 12000, 9, 1000, 86400


def _by(values: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("letter"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files (file, text) of a folder or pattern; compressed ones are opened by their suffix."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def records(files: DataFrame) -> DataFrame:
    """One row per record of files (file, text): file, number (from 1), lines, problem. A file whose head is not that of RINEX 3 navigation data,
    or without records, is one row with number 0 and the problem; a null text counts as empty.

    A record begins where a line after the head begins with anything but a blank; blank lines are left out."""
    lines = F.split(F.translate(F.coalesce("text", F.lit("")), "\r", ""), "\n")
    whole = files.select("file", lines.alias("_l"))
    head = F.array_position(F.transform(F.slice("_l", 2, HEADER_LINES), lambda s: F.contains(s, F.lit("END OF HEADER"))), F.lit(True))
    version = F.trim(F.substring(F.col("_l")[0], 1, 9)).try_cast("double")
    bad = (
        F.when((F.length(F.col("_l")[0]) < 21), "missing_header").when(version.isNull() | (version < 3) | (version >= 4) | (F.substring(F.col("_l")[0], 21, 1) != "N"), "not_navigation_3").when(F.col("_h") == 0, "unfinished_header")
    )
    cut = whole.withColumn("_h", head).withColumn("problem", bad)
    body = F.filter(F.slice("_l", (F.col("_h") + 2).cast("int"), F.greatest(F.size("_l"), F.lit(1))), lambda s: F.trim(s) != "")
    # a line that goes on with a record joins it by a line break, one that begins a record by a mark that texts cannot hold
    joined = F.array_join(F.transform(body, lambda s: F.concat(F.when(F.substring(s, 1, 1) == " ", "\n").otherwise("\u0001"), F.translate(s, "\u0001", ""))), "")
    each = F.filter(F.split(joined, "\u0001"), lambda s: s != "")
    found = cut.select("file", F.when(F.col("problem").isNull() & (F.size(each) == 0), "no_records").otherwise(F.col("problem")).alias("problem"), F.when(F.col("problem").isNull(), each).alias("_e"))
    rows = found.select("file", "problem", F.posexplode_outer("_e").alias("_n", "_t"))
    return rows.select("file", F.coalesce(F.col("_n") + 1, F.lit(0)).alias("number"), F.split("_t", "\n").alias("lines"), "problem")


def _distance(f: Callable[[int], Column]) -> Column:
    """Metres from the earth's centre at toe; null for elements out of range."""
    at = {c: f(i) for c, i in KEPLER.items()}

    def bent(ea: Column) -> Column:
        turn = F.atan2(F.sqrt(1 - at["e"] * at["e"]) * F.sin(ea), F.cos(ea) - at["e"]) + at["omega"]
        return orbits.let(2 * turn, lambda u: at["sqrt_a"] * at["sqrt_a"] * (1 - at["e"] * F.cos(ea)) + at["crs"] * F.sin(u) + at["crc"] * F.cos(u))

    newton = lambda x, _: x - (x - at["e"] * F.sin(x) - at["m0"]) / (1 - at["e"] * F.cos(x))
    eccentric = F.aggregate(F.sequence(F.lit(1), F.lit(15)), at["m0"], newton)
    return F.when((at["sqrt_a"] > 0) & (at["e"] >= 0) & (at["e"] < orbits.MOST_ECCENTRIC), orbits.let(eccentric, bent))


def parsed(rows: DataFrame, leap: int = gnsstime.LEAP_S) -> DataFrame:
    """records() with name, gnss, sv, epoch_unix (UTC of toe or of the state), elements (as functions.orbits takes them), and problem: what makes
    a record unusable, or 'outside' for satellites out of scope (letters S and I, GLONASS slots above the last); null for good ones.

    Fixed-width fields with D or e exponents. A blank field is absent; a field that is no finite number spoils its record."""
    first = F.col("lines")[0]
    number = F.substring(first, 2, 2)
    split = rows.withColumns({"letter": F.substring(first, 1, 1), "name": F.substring(first, 1, 3), "_sv": F.when(number.rlike("^[0-9]{2}$"), number.cast("int")), "_n": F.size("lines"), "_head": F.substring(first, 4, 20)})
    cells = lambda s, start, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.trim(F.substring(s, start + 19 * i, F.lit(19))))
    all_ = F.flatten(F.transform("lines", lambda s, k: F.when(k == 0, cells(s, 24, 3)).otherwise(cells(s, 5, 4))))
    read_ = lambda s: F.when(s.rlike("^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$"), s.try_cast("double"))
    values = split.withColumn("_s", F.transform(all_, lambda s: F.translate(s, "Dd", "ee"))).withColumn("_f", F.transform("_s", read_))
    odd = F.exists(F.arrays_zip("_s", "_f"), lambda p: (p["_s"] != "") & (p["_f"].isNull() | (F.abs(p["_f"]) == float("inf"))))
    part = F.regexp_extract_all("_head", F.lit("[0-9]+"), F.lit(0))
    n = lambda i: F.get(part, F.lit(i)).try_cast("int")
    day = F.try_to_timestamp(F.concat_ws("-", F.lpad(n(0).cast("string"), 4, "0"), F.lpad(n(1).cast("string"), 2, "0"), F.lpad(n(2).cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    known = F.col("_head").rlike("^( *[0-9]+){6} *$") & (F.size(part) == 6) & n(0).between(1980, 2200) & n(3).between(0, 23) & n(4).between(0, 59) & n(5).between(0, 59)
    stamp = F.when(known, F.unix_date(day) * F.lit(86400).cast("long") + n(3) * 3600 + n(4) * 60 + n(5))
    f = lambda i: F.get("_f", F.lit(i))
    glonass = F.col("letter") == "R"
    typed = values.withColumns({"gnss": _by({k: g for k, (g, _) in SYSTEMS.items()}), "_most": _by({k: m for k, (_, m) in SYSTEMS.items()}), "_odd": odd, "_stamp": stamp})
    typed = typed.withColumn("_offset", F.when(F.col("letter") == "C", leap - 14).otherwise(leap))
    toe = F.when(F.col("letter") == "C", gnsstime.to_unix(F.lit(3), f(21), f(11), leap)).otherwise(gnsstime.to_unix(F.lit(0), f(21), f(11), leap))
    lacks = lambda fields: F.array_contains(F.array(*[f(i).isNull() for i in fields]), F.lit(True))
    far = F.when(glonass, 1000 * F.sqrt(f(3) * f(3) + f(7) * f(7) + f(11) * f(11))).otherwise(_distance(f))
    wrong = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_n") > MOST_LINES, "oversized").when(F.length(first) < 23, "short_epoch")
        .when(F.coalesce(_by(OUTSIDE) == F.col("_n"), F.lit(False)), "outside").when(F.col("gnss").isNull(), "unsupported").when(glonass & F.coalesce(F.col("_sv") > F.col("_most"), F.lit(False)), "outside")
        .when(F.col("_sv").isNull() | ~F.col("_sv").between(1, F.col("_most")), "satellite").when(F.when(glonass, ~F.col("_n").isin(4, 5)).otherwise(F.col("_n") != 8), "incomplete")
        .when(F.col("_stamp").isNull(), "calendar").when(F.col("_odd"), "number").when(F.when(glonass, lacks(STATE.values())).otherwise(lacks([*range(4, 20), 21])), "missing_field")
        .when(~glonass & ((f(21) != F.floor(f(21))) | ~f(21).between(0, MOST_WEEK) | (f(11) < 0) | (f(11) >= gnsstime.WEEK_S)), "week")
        .when(~glonass & (F.abs(toe - (F.col("_stamp") - F.col("_offset"))) > AGREE_S), "week_disagrees")
        .when(~F.coalesce((far > NEAREST_M) & (far < FARTHEST_M), F.lit(False)), "orbit")
    )
    good = typed.withColumn("problem", wrong)
    fine = F.col("problem").isNull()
    elements = [F.when(fine & ~glonass, f(i)).alias(c) for c, i in KEPLER.items()] + [F.when(fine & glonass, f(i)).alias(c) for c, i in STATE.items()]
    epoch = F.when(fine, F.when(glonass, F.col("_stamp").cast("double")).otherwise(toe.cast("double")))
    return good.select("file", "number", "name", "gnss", F.col("_sv").alias("sv"), epoch.alias("epoch_unix"), *elements, "problem")


def catalogue(rows: DataFrame) -> DataFrame:
    """Latest orbit of each satellite by epoch; of equal epochs that of the first record, then of the last file by name."""
    kept = [c for c in rows.columns if c not in ("name", "problem")]
    # the condition sits in the order, not in a filter that would be pushed into the parsing and double it
    order = F.when(F.col("problem").isNull(), F.struct("epoch_unix", (-F.col("number")).alias("n"), "file"))
    return rows.groupBy("name").agg(F.max_by(F.struct(*kept), order).alias("o")).filter("o is not null").select("name", "o.*")


def refused(rows: DataFrame) -> DataFrame:
    """Files (file, problems) with a record that is unusable, as a reader that takes files whole or not at all would refuse them."""
    found = F.collect_set(F.when(F.col("problem") != "outside", F.col("problem")))
    return rows.groupBy("file").agg(F.array_join(F.array_sort(found), ",").alias("problems")).filter("problems <> ''")


def whole_files(rows: DataFrame) -> DataFrame:
    """Records of files without an unusable record: a broken file gives nothing."""
    return rows.join(refused(rows).select("file"), "file", "left_anti")
