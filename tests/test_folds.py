"""Folds by hand, and cut into stretches that hand their states on."""

import json
import random
import time
from statistics import median

import pytest
from pyspark.sql import functions as F

from orbitloom.operators import folds

S = folds.SECOND


def run(step, rows):
    state: dict = {}
    return [step(state, row) for row in rows]


def epoch(second, north, speed=30.0, usable=True):
    return {"at": second * S, "x": 0.0, "y": north, "z": 0.0, "accuracy": 1.0, "usable": usable, "max_speed": speed}


def test_motion_bound_by_hand():
    rows = [epoch(0, 0)] + [epoch(i, 20 * i) for i in range(1, 6)] + [epoch(6, 2100), epoch(10, 2180), epoch(80, 2200)]
    assert [x["state"] for x in run(folds.motion_bound(), rows)] == ["unavailable"] + ["assured"] * 5 + ["unassured"] * 2 + ["assured"]
    found = run(folds.motion_bound(), [epoch(0, 0, 0), epoch(1, 0), epoch(2, 0, usable=False), epoch(602, 0), epoch(603, 0)])
    assert [x.get("reason") for x in found] == ["no_max_speed", "reference_reset", "no_3d_fix", "reference_reset", None]


def gains(pairs):
    return [{"at": second * S, "agc": agc} for second, agc in pairs]


def test_quiet_drift_stays_and_jamming_never_teaches():
    clear = [(s, 4000) for s in range(661)]
    assert run(folds.agc_baseline(), gains([*clear, (661, 3700)]))[-1] == {"baseline": 4000.0, "departure": 300.0}
    jammed = run(folds.agc_baseline(), gains(clear + [(s, 3000) for s in range(661, 40_000)]))
    assert jammed[-1] == {"baseline": 4000.0, "departure": 1000.0}
    assert run(folds.agc_baseline(), gains(clear[:600]))[-1]["baseline"] is None  # warming up


def test_baseline_moves_slowly_and_restarts_when_it_was_learned_under_interference():
    clear = [(s, 4000) for s in range(661)]
    drifted = run(folds.agc_baseline(), gains(clear + [(s, 4300) for s in range(661, 661 + 3600)]))
    assert 4000 < drifted[-1]["baseline"] <= 4150.1  # 150 an hour
    above = run(folds.agc_baseline(), gains(clear + [(s, 4900) for s in range(661, 661 + 2400)]))
    assert above[800]["baseline"] == 4000 and above[661 + 950]["baseline"] is None and above[-1]["baseline"] == 4900


def test_only_accepted_levels_train():
    levels = [(c, v) for c in range(4) for v in (40, 41)] + [(4, 70), (4, 41), (3, 41), (5, 0), (5, 40)]
    found = run(folds.power_cell(), [{"cycle": c, "level": v} for c, v in levels])
    assert [x["admitted"] for x in found] == [True] * 8 + [False, True, False, False, True]
    assert found[-1] == {"support": 5, "expected": 41, "spread": 0, "admitted": True}  # 70 is not in the reference


def test_week_wraps_and_time_resets():
    week = 604_800_000
    tows = [week - 2000, week - 1000, 0, week - 1000, 0, 1000, 60_000, 5_000, 6_000, None]
    found = run(folds.epoch_order(), [{"tow": t} for t in tows])
    assert [x.get("event") for x in found] == ["start", None, None, "reordered", "repeat", None, "gap", "time_reset", None, None]
    assert [x.get("clock") for x in found] == [0, 1000, 2000, None, None, 3000, 62_000, 62_000, 63_000, None]


def reading(minute, temperature, healthy=True, heater=False):
    return {"at": minute * folds.MINUTE, "temperature": temperature, "humidity": 50.0, "pressure": 101_000.0, "healthy": healthy, "heater": heater}


def test_bad_readings_do_not_train():
    rows = [reading(5 * i, 20.0) for i in range(8)] + [reading(60 + 5 * i, 40.0) for i in range(20)] + [reading(200, 20.0), reading(230, 29.0, heater=True)]
    found = run(folds.environment_change(), rows)
    assert [x["state"] for x in found[:6]] == ["unavailable"] * 6 and found[7]["state"] == "assured"
    assert all(x["state"] == "unassured" and not x["learned"] for x in found[8:28])  # forty degrees never become usual
    assert found[28]["learned"] and found[29] == {"state": "inconsistent", "reasons": "temperature_change", "learned": False}


def test_references_are_the_medians_of_what_was_learned():
    rng = random.Random(5)
    step, state, learned, at = folds.environment_change(base_s=600, lasting_s=900, keep_s=1500, age_s=60), {}, [], 0
    for i in range(3000):
        at += rng.choice([0, 1, 3, 400 if i % 500 == 0 else 2]) * S
        row = reading(0, rng.choice([None, 20.0 + rng.randrange(60) / 10]), rng.random() < 0.95) | {"at": at}
        anomalous = state.get("anomalous")
        found = step(state, row)
        if found["learned"] or not anomalous:
            learned = [x for x in learned if x[0] >= at - 1500 * S]
        if found["learned"]:
            learned.append((at, row["temperature"]))
        for points, old in ((state["near"], False), (state["far"], True)):  # far is as of the row, near as after it
            known = [t for x, t in learned if t is not None and (x <= at - 900 * S if old else x >= at - 600 * S)]
            own = points.get("temperature", {"n": 0})
            assert own["n"] == len(known) and (not known or folds._known_median(own) == median(known))
        if i % 400 == 0:
            state = json.loads(json.dumps(state))


def test_a_long_window_costs_no_pass_over_it():
    began = time.process_time()
    found = run(folds.environment_change(), [reading(i / 100, 20.0 + i % 30 / 10) for i in range(8000)])
    assert found[-1]["learned"] and time.process_time() - began < 5


def test_one_to_one_by_hand(spark):
    minute = 60 * S
    at = 20 * minute
    columns = "sv string, type string, value string, at long, seq long"
    replayed = spark.createDataFrame([("s", "spoofing", "suspected", at, 1), ("s", "assurance", "unassured", at + 10 * S, 2), ("s", "jamming", "crit", minute, 3), ("other", "spoofing", "suspected", at, 4)], columns)
    stored = spark.createDataFrame([("s", "spoofing", "suspected", at + 20 * S, 1), ("s", "antenna", "fault", at + 5 * minute, 2)], columns)
    found = folds.compared(replayed.filter("sv = 's'"), stored, ["sv", "type", "value"], 30, 10 * minute).collect()
    assert sorted(map(tuple, found), key=str) == [("matched", 1, 1), ("missing_in_replay", None, 2), ("missing_in_store", 2, None)]


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_greedy_match(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = sorted((rng.randrange(40), rng.random() < 0.5, i) for i in range(rng.randrange(1, 14)))
        left, want = [(t, i) for t, stored, i in rows if not stored], set()
        for t, stored, i in rows:
            if stored and (near := [x for x in left if abs(x[0] - t) <= 4]):
                left.remove(near[0])
                want.add((near[0][1], i))
        found = run(folds.one_to_one(4, 0), [{"at": t * S, "stored": stored, "seq": i} for t, stored, i in rows])
        assert {(x["partner"], i) if stored else (i, x["partner"]) for (_, stored, i), x in zip(rows, found) if x.get("partner") is not None} == want


def test_stretches_hand_their_states_on(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), s * 20 * S, s, rng.choice([4000, 4010, 3990, 4600, 2000]), s % 2) for s in range(3000)]
    rows += [(9, 0, 9000, 4000, 1)]  # a key of the first stretch only
    df = spark.createDataFrame(rows, "grp long, at long, seq long, agc long, more long")
    step = folds.agc_baseline(minute_s=120, least=2, relearn_s=60)
    how = (["grp"], ["at", "seq"], ["at", "agc"], step, folds.AGC_OUT)
    whole = {r.seq: tuple(r) for r in folds.folded(df, *how).collect()}
    handed, got = None, {}
    for low in range(0, 3000, 1000):
        part = df.filter((F.col("at") >= low * 20 * S) & (F.col("at") < (low + 1000) * 20 * S))
        done = folds.folded(part, *how, states=handed, keep=True)
        got |= {r.seq: tuple(r)[:-1] for r in done.collect()}
        handed = spark.createDataFrame(folds.states(done, ["grp"], handed).collect(), "grp long, _state string")
    assert got == whole and len(whole) == 3001
    assert {r.grp for r in handed.collect()} >= {1, 2, 3, 9}


def test_empty_table(spark):
    df = spark.createDataFrame([], "grp long, at long, agc long")
    assert folds.folded(df, ["grp"], ["at"], ["at", "agc"], folds.agc_baseline(), folds.AGC_OUT, keep=True).count() == 0
