"""Folds over ordered histories whose state decides what the next row may change.

Windows cannot say what depends on earlier decisions (a reference that learns only what it accepts). folded() sorts each
key's rows on disk and lets a small step function see them one by one, in Arrow batches, with nothing but the state in memory; a
history may be cut into bounded stretches that hand their states on, and the same steps run in streams
(streaming/machines.py). A step takes (state, row), both dicts, changes state in place and returns its outputs; states are
JSON values. Times (`at`) are microseconds.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import partial
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Step = Callable[[dict, dict], dict]
_KINDS = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
SECOND, MINUTE, HOUR = 10**6, 60 * 10**6, 3600 * 10**6


def folded(rows: DataFrame, key: list[str], order: list[str], reads: list[str], step: Step, outputs: dict[str, str], states: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """rows with the outputs of step for each, in the order of each key.

    reads: the columns that step sees. keep: adds _state, the state after a key's last row (null in others), which states() turns
    into the argument `states` of the fold over the rows that follow."""
    columns, follows = rows.columns, states is not None
    if follows:
        named = states.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(key)], F.col("_state").alias("_handed"))
        same = [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(key)]
        rows = rows.join(named, same, "left").select(*columns, "_handed")
    kinds = outputs | ({"_state": "string"} if keep else {})
    schema = StructType([f for f in rows.schema.fields if f.name != "_handed"] + StructType.fromDDL(", ".join(f"{n} {k}" for n, k in kinds.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, held, begun = None, {}, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in key)))
            handed = batch.column("_handed").to_pylist() if follows else None
            seen = zip(*(batch.column(c).to_pylist() for c in reads))
            done: list[dict] = []
            after: list[str | None] = [None] * len(names)
            if held is not None:  # the last row of the batch before, now that it is known whether its key goes on
                yield joined(*held[:2], [held[2] if names[0] != current else None])
            for i, (name, values) in enumerate(zip(names, seen)):
                if name != current or not begun:
                    if keep and i:
                        after[i - 1] = json.dumps(state)
                    current, state, begun = name, json.loads(handed[i]) if handed and handed[i] else {}, True
                done.append(step(state, dict(zip(reads, values))))
            last = len(names) - 1 if keep else len(names)
            if last:
                yield joined(batch.slice(0, last), done[:last], after[:last])
            held = (batch.slice(last), done[last:], json.dumps(state)) if keep else None
        if held is not None:
            yield joined(*held[:2], [held[2]])

    def joined(batch: pa.RecordBatch, done: list[dict], after: list) -> pa.RecordBatch:
        made = [pa.array([x.get(n) for x in done], _KINDS[k]) for n, k in outputs.items()] + ([pa.array(after, pa.string())] if keep else [])
        return pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + made, [*columns, *kinds])

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def states(done: DataFrame, key: list[str], before: DataFrame | None = None) -> DataFrame:
    """The states that a fold with keep left, and those of keys that had no rows in it."""
    left = done.filter("_state is not null").select(*key, "_state")
    if before is None:
        return left
    same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in key]
    return left.unionByName(before.select(*key, "_state").alias("old").join(left.alias("new"), same, "left_anti"))


def _agc(state: dict, row: dict, band: float, least: int, most: int, warm_up: int, minute_s: float, window_s: float, drift: float, relearn_s: float) -> dict:
    at, agc = row["at"], row["agc"]
    if agc is None:
        return {}
    base = state.get("baseline")
    away = 0 if base is None else agc - base
    learns = away >= -band
    if away > band:
        learns = at - state.setdefault("above", at) >= relearn_s * SECOND
        if learns:
            state.clear()
    else:
        state.pop("above", None)
    if learns:
        start, now = state.setdefault("start", at), state.setdefault("now", [])
        if at - start >= minute_s * SECOND:
            minutes = state.setdefault("minutes", [])
            if len(now) >= least:
                minutes.append([start, median(now)])
            now = state["now"] = []
            state["start"] = at
            state["minutes"] = minutes = [m for m in minutes if at - m[0] <= window_s * SECOND]
            if minutes:
                aim, base = median(m[1] for m in minutes), state.get("baseline")
                if base is not None:
                    limit = drift * (at - state["moved"]) / HOUR
                    state["baseline"], state["moved"] = base + max(-limit, min(limit, aim - base)), at
                elif len(minutes) >= warm_up:
                    state["baseline"], state["moved"] = aim, at
        if len(now) < most:
            now.append(agc)
    base = state.get("baseline")
    return {"baseline": None if base is None else float(base), "departure": None if base is None else float(base - agc)}


def agc_baseline(band: float = 400, least: int = 3, most: int = 600, warm_up: int = 10, minute_s: float = 60, window_s: float = 21600, drift: float = 150, relearn_s: float = 900) -> Step:
    """Quiet level of a receiver's gain (at, agc): median of the medians of quiet minutes.

    Samples more than `band` below it never teach; above, only once they last for relearn_s, and then all is learned anew. A
    minute needs `least` samples and keeps `most`; the first level takes warm_up minutes, later it moves by `drift` an hour."""
    return partial(_agc, band=band, least=least, most=most, warm_up=warm_up, minute_s=minute_s, window_s=window_s, drift=drift, relearn_s=relearn_s)


AGC_OUT = {"baseline": "double", "departure": "double"}


def _power(state: dict, row: dict, days: int, support: int, least: int, times: int) -> dict:
    cycle, level = row["cycle"], row["level"]
    if cycle is None or level is None or not 0 < level <= 99 or cycle < state.get("cycle", cycle):
        return {"admitted": False}
    past = state.setdefault("past", [])
    if cycle > state.setdefault("cycle", cycle):
        if state["count"]:
            past.append((state["sum"] + state["count"] // 2) // state["count"])
            del past[:-days]
        state.update(cycle=cycle, sum=0, count=0)
    state.setdefault("sum", 0)
    state.setdefault("count", 0)
    out: dict = {"support": len(past)}
    fine = True
    if len(past) >= support:
        out["expected"] = expected = _middle(past)
        out["spread"] = spread = _middle([abs(x - expected) for x in past])
        fine = abs(level - expected) < max(times * spread, least)
    fine = fine and state["count"] < 65535
    if fine:
        state["sum"], state["count"] = state["sum"] + level, state["count"] + 1
    return out | {"admitted": fine}


def _middle(values: list[int]) -> int:
    """Median of whole numbers, halves rounded up."""
    v = sorted(values)
    n = len(v) // 2
    return v[n] if len(v) % 2 else (v[n - 1] + v[n] + 1) // 2


def power_cell(days: int = 8, support: int = 3, least: int = 6, times: int = 4) -> Step:
    """Level of a cell of the sky in each cycle (cycle, level): a sample joins its cycle's mean only if the reference, median and
    absolute deviation of the `days` cycles before, made of admitted samples, accepts it; an older cycle never returns."""
    return partial(_power, days=days, support=support, least=least, times=times)


POWER_OUT = {"admitted": "boolean", "support": "long", "expected": "long", "spread": "long"}


def _bound(state: dict, row: dict, max_age_s: float, sigmas: float, margin: float) -> dict:
    if row["max_speed"] is None or row["max_speed"] <= 0:
        return {"state": "unavailable", "reason": "no_max_speed"}
    if not row["usable"]:
        return {"state": "unavailable", "reason": "no_3d_fix"}
    here = [row[c] for c in ("at", "x", "y", "z", "accuracy")]
    ref = state.get("ref")
    if ref is None or here[0] - ref[0] > max_age_s * SECOND:
        state["ref"] = here
        return {"state": "unavailable", "reason": "reference_reset"}
    elapsed, distance = (here[0] - ref[0]) / SECOND, math.dist(here[1:4], ref[1:4])
    out = {"distance": distance, "bound": row["max_speed"] * elapsed + sigmas * (here[4] + ref[4]) + margin}
    if distance > out["bound"]:
        return out | {"state": "unassured", "reason": "motion_bound"}
    state["ref"] = here
    return out | {"state": "assured"}


def motion_bound(max_age_s: float = 600, sigmas: float = 3, margin: float = 10) -> Step:
    """Distance from the last accepted epoch (at, x, y, z, accuracy, usable, max_speed) against what the station can travel; an epoch
    beyond the bound does not become the reference."""
    return partial(_bound, max_age_s=max_age_s, sigmas=sigmas, margin=margin)


BOUND_OUT = {"state": "string", "reason": "string", "distance": "double", "bound": "double"}


def _epochs(state: dict, row: dict, week_ms: int, gap_ms: int) -> dict:
    tow = row["tow"]
    if tow is None:
        return {"accepted": False}
    if "tow" not in state:
        state.update(tow=tow, clock=0, segment=0)
        return {"accepted": True, "clock": 0, "segment": 0, "event": "start"}
    d = (tow - state["tow"] + week_ms // 2) % week_ms - week_ms // 2
    if d == -(week_ms // 2) and tow > state["tow"]:
        d = week_ms // 2
    if -gap_ms <= d <= 0:
        return {"accepted": False, "event": "repeat" if d == 0 else "reordered"}
    event = None
    if d < 0:
        event, state["segment"] = "time_reset", state["segment"] + 1
    else:
        state["clock"] += d
        if d > gap_ms:
            event, state["segment"] = "gap", state["segment"] + 1
    state["tow"] = tow
    return {"accepted": True, "clock": state["clock"], "segment": state["segment"], "event": event}


def epoch_order(week_ms: int = 604_800_000, gap_ms: int = 10_000) -> Step:
    """Epochs (tow) in the order of receipt on a clock that wraps each week: repeats and small steps back are dropped, a larger step
    back means that the receiver's time was set anew; that and a gap begin a new segment. clock runs on over wraps."""
    return partial(_epochs, week_ms=week_ms, gap_ms=gap_ms)


EPOCH_OUT = {"accepted": "boolean", "clock": "long", "segment": "long", "event": "string"}


def _pairing(state: dict, row: dict, tolerance_s: float, warm_end: int) -> dict:
    at, stored = row["at"], row["stored"]
    if stored and at < warm_end:
        return {}
    mine, others = ("s", "r") if stored else ("r", "s")
    for side in "rs":
        state[side] = [x for x in state.get(side, []) if at - x[0] <= tolerance_s * SECOND]
    if state[others]:
        return {"partner": state[others].pop(0)[1]}
    state[mine].append([at, row["seq"]])
    return {}


def one_to_one(tolerance_s: float, warm_end: int) -> Step:
    """Events of both sides (at, seq, stored) matched in the order of time: each stored one takes the earliest replayed one within the
    tolerance that none before it took. The later of a pair names its partner; what waits is as long as the tolerance."""
    return partial(_pairing, tolerance_s=tolerance_s, warm_end=warm_end)


def compared(replayed: DataFrame, stored: DataFrame, key: list[str], tolerance_s: float, warm_end: int) -> DataFrame:
    """outcome (matched, missing_in_store, missing_in_replay), replay_seq and stored_seq of events (key..., at, seq) from warm_end on.

    A replayed event of the warm-up can be matched, but is not missed."""
    both = replayed.select(*key, "at", "seq", F.lit(False).alias("stored")).unionByName(stored.select(*key, "at", "seq", F.lit(True).alias("stored")))
    done = folded(both, key, ["at", "stored", "seq"], ["at", "seq", "stored"], one_to_one(tolerance_s, warm_end), {"partner": "long"})
    # every event of a pair, once for each side; what no pair has is missed
    own, other = F.struct("stored", "seq"), F.struct((~F.col("stored")).alias("stored"), F.col("partner").alias("seq"))
    named = done.select("at", own.alias("own"), "partner", F.explode(F.when(F.col("partner").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("of"))
    found = named.groupBy("of").agg(F.max(F.when(F.col("partner").isNotNull(), F.when(F.col("own") == F.col("of"), F.col("partner")).otherwise(F.col("own.seq")))).alias("partner"),
                                    F.max(F.when(F.col("own") == F.col("of"), F.col("at"))).alias("at"))
    stored_side = F.col("of.stored")
    found = found.filter((F.col("partner").isNotNull() & stored_side) | (F.col("partner").isNull() & (F.col("at") >= warm_end)))
    outcome = F.when(F.col("partner").isNotNull(), "matched").when(stored_side, "missing_in_replay").otherwise("missing_in_store")
    return found.select(outcome.alias("outcome"), F.when(stored_side, F.col("partner")).otherwise(F.col("of.seq")).alias("replay_seq"), F.when(stored_side, F.col("of.seq")).alias("stored_seq"))


#: Severity; an unavailable verdict gives way to a bad one only.
_RANK = {"assured": 0, "unavailable": 1, "inconsistent": 2, "unassured": 3}
MEASURES = ("temperature", "humidity", "pressure")


def dew_spread(temperature: float, humidity: float) -> float:
    """Temperature minus dew point, by the Magnus form."""
    gamma = math.log(humidity / 100) + 17.625 * temperature / (243.04 + temperature)
    return temperature - 243.04 * gamma / (17.625 - gamma)


#: Values of a block of a sorted half; dropped samples that at most wait before they are cut off their list.
_BLOCK = 512


def _last(block: list) -> float:
    return block[-1]


def _add(half: list[list], value: float) -> None:
    """Adds a value to sorted blocks."""
    if not half:
        half.append([value])
        return
    at = min(bisect_left(half, value, key=_last), len(half) - 1)
    block = half[at]
    insort(block, value)
    if len(block) > _BLOCK:
        half[at : at + 1] = [block[: _BLOCK // 2], block[_BLOCK // 2 :]]


def _take(half: list[list], value: float) -> None:
    """Takes a value out of sorted blocks that hold it."""
    at = bisect_left(half, value, key=_last)
    block = half[at]
    del block[bisect_left(block, value)]
    if not block:
        del half[at]


def _counted(known: dict, values: dict, more: int) -> None:
    """Adds the values to what is known of each measure or takes them out: lower and upper half of all values, the lower as
    large or one larger, so that the median is at their ends and a change costs no pass over them (no value: the largest)."""
    for c, value in values.items():
        own = known.setdefault(c, {"n": 0, "low": [], "high": [], "lower": 0})
        value = value if value == value else math.inf
        low, high = own["low"], own["high"]
        below = bool(low) and value <= low[-1][-1]
        (_add if more > 0 else _take)(low if below else high, value)
        own["n"] += more
        own["lower"] += more if below else 0
        while own["lower"] != (own["n"] + 1) // 2:
            grows = own["lower"] < (own["n"] + 1) // 2
            moved = high[0][0] if grows else low[-1][-1]
            _take(high if grows else low, moved)
            _add(low if grows else high, moved)
            own["lower"] += 1 if grows else -1


def _known_median(own: dict) -> float:
    return own["low"][-1][-1] if own["n"] % 2 else (own["low"][-1][-1] + own["high"][0][0]) / 2


def _aged(state: dict, at: int, base: float, lasting: float, keep: float | None) -> None:
    """Moves on the ends of the samples that are near, far and (with keep) kept: each sample enters and leaves each once."""
    past, near, far = state["past"], state["near"], state["far"]
    while keep is not None and state["kept"] < len(past) and past[state["kept"]][0] < at - keep:
        i = state["kept"]
        if i < state["old"]:
            _counted(far, past[i][1], -1)
        if i >= state["new"]:
            _counted(near, past[i][1], -1)
            state["new"] = i + 1
        state["kept"] = i + 1
    while state["new"] < len(past) and past[state["new"]][0] < at - base:
        _counted(near, past[state["new"]][1], -1)
        state["new"] += 1
    while state["old"] < len(past) and past[state["old"]][0] <= at - lasting:
        if state["old"] >= state["kept"]:
            _counted(far, past[state["old"]][1], 1)
        state["old"] += 1
    if (gone := state["kept"]) > _BLOCK and 2 * gone > len(past):
        del past[:gone]
        state.update(kept=0, new=state["new"] - gone, old=max(0, state["old"] - gone))


def _environment(state: dict, row: dict, bands: dict, rates: dict, dew: tuple, least: int, age_s: float, base_s: float, lasting_s: float, keep_s: float, rate_s: tuple) -> dict:
    at, verdict, reasons = row["at"], "assured", []
    now = {c: row[c] for c in MEASURES if row[c] is not None}
    if not now:
        return {"state": "unavailable", "reasons": "no_value", "learned": False}

    def judged(had: str, value: float, limits: tuple, reason: str) -> str:
        found = "unassured" if value >= limits[1] else "inconsistent" if value >= limits[0] else "assured"
        if found == "assured":
            return had
        reasons.append(reason)
        return max(had, found, key=_RANK.__getitem__)

    if "temperature" in now and now.get("humidity", 0) > 0:  # a small spread is bad
        verdict = judged(verdict, -dew_spread(now["temperature"], now["humidity"]), (-dew[0], -dew[1]), "dew_point_spread")
    at_once = verdict != "assured"
    if "past" not in state:  # samples in the order of time; those from new on are near, those from kept to old far
        state.update(past=[], kept=0, new=0, old=0, near={}, far={})
    past, ends = state["past"], (base_s * SECOND, lasting_s * SECOND)
    _aged(state, at, *ends, None if state.get("anomalous") else keep_s * SECOND)
    ready = len(past) - state["new"] >= least and at - past[state["new"]][0] >= age_s * SECOND
    lasting = state["old"] - state["kept"] >= least
    for points, reason in ([(state["near"], "change")] if ready else []) + ([(state["far"], "sustained")] if lasting else []):
        for c in now:
            if c in points and points[c]["n"]:
                verdict = judged(verdict, abs(now[c] - _known_median(points[c])), bands[c], f"{c}_{reason}")
    if not ready and not lasting:
        verdict = verdict if at_once else "unavailable"
        reasons.append("warm_up")
    before = state.get("last")
    if before is not None and rate_s[0] * SECOND <= at - before[0] <= rate_s[1] * SECOND:
        for c in now:
            if c in before[1]:
                verdict = judged(verdict, abs(now[c] - before[1][c]) / ((at - before[0]) / HOUR), rates[c], f"{c}_rate")
    state["last"] = [at, now]
    learned = bool(row["healthy"]) and not row["heater"] and (verdict == "assured" or verdict == "unavailable" and not at_once)
    if row["healthy"] and not row["heater"]:
        state["anomalous"] = not learned
    if learned:
        _aged(state, at, *ends, keep_s * SECOND)
        past.append([at, now])
        _counted(state["near"], now, 1)
    return {"state": verdict, "reasons": ",".join(reasons), "learned": learned}


def environment_change(change: dict | None = None, rate: dict | None = None, dew: tuple = (2, 0.5), least: int = 6, age_s: float = 1200, base_s: float = 21600, lasting_s: float = 43200, keep_s: float = 86400, rate_s: tuple = (30, 900)) -> Step:
    """Temperature, humidity and pressure (at, healthy, heater) against medians of the last base_s and of what is lasting_s to keep_s old, against
    the sample before (per hour), and the distance to the dew point; pairs are the limits of inconsistent and unassured.

    Only samples of healthy sensors without a running heater that were not judged bad become part of what later ones are
    compared with; while the last was bad, old ones are not dropped either."""
    bands = {"temperature": (8, 15), "humidity": (20, 40), "pressure": (800, 1600)} | (change or {})
    rates = {"temperature": (6, 12), "humidity": (20, 40), "pressure": (300, 600)} | (rate or {})
    return partial(_environment, bands=bands, rates=rates, dew=dew, least=least, age_s=age_s, base_s=base_s, lasting_s=lasting_s, keep_s=keep_s, rate_s=rate_s)


ENVIRONMENT_OUT = {"state": "string", "reasons": "string", "learned": "boolean"}


def lifecycle(rows: DataFrame, key: str, order: list[str], gap_s: float, since_start: str = "since_start", relocated: str = "relocated") -> DataFrame:
    """rows with segment and why it began: a gap in at, a restart (the time since the receiver's start fell) or a relocation.

    Checks that depend on an unbroken history are folded by (key, segment), so that all of them start anew together."""
    w = Window.partitionBy(key).orderBy(*order)
    known = F.last(F.col(since_start), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    why = F.when(F.col(relocated), "relocation").when(F.col(since_start) < known, "restart").when(F.col("at") - F.lag("at").over(w) > int(gap_s * SECOND), "gap")
    begun = rows.withColumn("_why", why)
    segment = F.sum(F.col("_why").isNotNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return begun.withColumn("segment", segment).withColumn("began", F.first("_why").over(Window.partitionBy(key, "segment").orderBy(*order))).drop("_why")


def snapshots(checked: DataFrame, key: str, order: list[str], verdict: str = "state") -> DataFrame:
    """What a check said last in each segment that is over, with the reason for which the next one began."""
    last = checked.groupBy(key, "segment").agg(F.max_by(verdict, F.struct(*order)).alias(verdict), F.max("at").alias("until"), F.count("*").alias("n"), F.min("began").alias("began"))
    w = Window.partitionBy(key).orderBy("segment")
    return last.withColumn("ended_by", F.lead("began").over(w)).filter("ended_by is not null").drop("began")
