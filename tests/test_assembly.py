"""Assembly of sets, strings, pages and arcs by hand."""

from orbitloom.operators import assembly

FRAGMENTS = "grp long, sv long, tm long, seq long, kind long, issue long, named_sv long, sow long"
S = 1_000_000


def sets(spark, family, rows):
    df = spark.createDataFrame([(1, 7, i, i, *row) for i, row in enumerate(rows)], FRAGMENTS)
    found = assembly.assembled(df, ["grp", "sv"], ["tm", "seq"], assembly.FAMILIES[family])
    return [(r.issue, list(r.seqs), r.clock_seq) for r in found.orderBy("tm").collect()]


def test_lnav_sets_need_one_issue(spark):
    rows = [(1, 256 + 5, 7, 0), (2, 5, 7, 6), (3, 5, 7, 12), (5, 0, 7, 18), (2, 5, 7, 36), (2, 6, 7, 66), (3, 6, 7, 72), (1, 6, 7, 90)]
    assert sets(spark, "lnav", rows) == [(5, [0, 1, 2], None), (6, [7, 5, 6], None)]  # again and in between there is no new set


def test_cnav_clock_only_of_the_same_time(spark):
    rows = [(10, 100, 7, 0), (30, 90, 7, 1), (11, 100, 7, 2), (11, 200, 7, 3), (33, 200, 7, 4), (10, 200, 7, 5), (10, 300, 8, 6), (11, 300, 7, 7)]
    assert sets(spark, "cnav", rows) == [(100, [0, 2], None), (200, [5, 3], 4)]


def test_d1_subframes_follow_each_other_over_the_week(spark):
    rows = [(1, 0, 7, 604_794), (2, 1, 7, 0), (3, 2, 7, 6), (1, 0, 7, 24), (2, 3, 7, 30), (3, 4, 7, 42)]
    assert sets(spark, "d1", rows) == [(1, [0, 1, 2], None)]


def test_bcnav2_pairs_within_three_seconds(spark):
    assert sets(spark, "bcnav2", [(10, 1, 7, 604_798), (11, 1, 7, 1), (10, 1, 7, 20), (30, 0, 7, 21)]) == [(1, [0, 1], None)]


def test_strings_of_one_frame(spark):
    schema = "relay long, sat long, tm long, seq long, at long, number long, tb long, tau double"
    rows = [(1, 0), (2, 2), (3, 4), (4, 6), (1, 30), (2, 32), (3, 34), (1, 60), (2, 90), (3, 92)]
    df = spark.createDataFrame([(1, 3, i, i, second * S, n, 9, 0.5 if n == 4 else None) for i, (n, second) in enumerate(rows)], schema)
    found = assembly.coherent(df, ["relay", "sat"], ["sat"], ["tm", "seq"]).orderBy("tm").collect()
    assert [(list(r.seqs), r.clock, r.carried) for r in found] == [([0, 1, 2], None, False), ([0, 1, 2], 0.5, False), ([4, 5, 6], 0.5, True)]


def test_pages_of_two_frames_do_not_pair(spark):
    rows = [(6, 0), (7, 2), (8, 4), (10, 6), (11, 15), (12, 20), (12, 21), (13, 22), (7, 23)]
    df = spark.createDataFrame([(1, i, second * S, page) for i, (page, second) in enumerate(rows)], "relay long, seq long, tm long, page long")
    found = assembly.adjacent(df, ["relay"], ["tm", "seq"], "page", "tm").collect()
    assert sorted((r.first_seq, r.second_seq) for r in found) == [(0, 1), (6, 7)]


def test_arcs_break_on_every_cause(spark):
    good = {"has_phase": True, "lock_ms": 1000, "half_cycle": False, "slip": False}
    changes = {12: {"slip": True}, 13: {"half_cycle": True}, 15: {"lock_ms": 10}, 16: {"has_phase": False}, 18: {"at": 30.0}, 20: {"at": 29.0}}
    rows, at = [], 0.0
    for i in range(22):
        row = good | {"half_cycle": i in (13, 14), "lock_ms": 1000 if i < 15 else 10} | changes.get(i, {})
        at = row.pop("at", at + 1)
        rows.append((1, i, at, 5.0 + i % 2, 1.0, row["has_phase"], row["lock_ms"], row["half_cycle"], row["slip"], 1575.42e6, 1227.6e6))
    df = spark.createDataFrame(rows, "grp long, seq long, at double, code double, phase double, has_phase boolean, lock_ms long, half_cycle boolean, slip boolean, f1 double, f2 double")
    found = assembly.arcs(df, ["grp"], ["seq"]).orderBy("seq").collect()
    starts = [r.seq for a, r in zip([None, *found], found) if a is None or a.arc != r.arc]
    assert starts == [0, 12, 13, 15, 16, 17, 18, 20]
    assert [r.slant is not None for r in found[:13]] == [False] * 9 + [True] * 3 + [False]
    assert abs(found[9].slant - (1.0 + 4.5) / ((1575.42 / 1227.6) ** 2 - 1)) < 1e-9
