"""Live receipts as a stream, and state machines over them by transformWithState, with event-time timers.

receipts() reads a folder that feeders write to; machine() runs a step (operators/folds.py) for each key. Rows wait in the
state until the watermark has passed them and are then applied in the order of time and tie, so a stream gives what the
fold of the same rows gives, whatever batches they came in, as long as none is later than the watermark. A timer at the
first waiting row applies it when no other row of the key comes. With silent_s, a key whose last applied row is that old is told
to the step once (row None) and its state goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from orbitloom.operators.folds import SECOND, Step

#: Timers need this state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PANDAS = {"double": "float64", "long": "Int64", "string": "object", "boolean": "boolean"}


def receipts(spark: SparkSession, folder: str, schema: StructType | str, time: str, late: str, files: int | None = None) -> DataFrame:
    """The stream of receipts that arrive as parquet files in a folder, with a watermark on their time."""
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder).withWatermark(time, late)


class _Machine(StatefulProcessor):
    def __init__(self, names: list[str], reads: list[str], step: Step, outputs: dict[str, str], silent_s: float | None):
        self.names, self.reads, self.step, self.outputs, self.silent_s = names, reads, step, outputs, silent_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, row string")
        self.folded = handle.getValueState("folded", "state string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch[["at", "seq", *self.reads]].to_dict("records"):
                plain = {c: None if pd.isna(row[c]) else getattr(row[c], "item", lambda v=row[c]: v)() for c in self.reads}
                self.waiting.appendValue((int(row["at"]), int(row["seq"]), json.dumps(plain)))
        return self._applied(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._applied(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _applied(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[:2])
        ready, left = [x for x in rows if x[0] < watermark], [x for x in rows if x[0] >= watermark]
        held = self.folded.get() if self.folded.exists() else None
        state, last = (json.loads(held[0]), held[1]) if held else ({}, None)
        out = []

        def silence(until: int) -> None:
            nonlocal state, last
            if self.silent_s is not None and last is not None and until - last > self.silent_s * SECOND:
                out.append((last, None, self.step(state, None)))
                state, last = {}, None

        for at, seq, row in ready:
            silence(at)
            out.append((at, seq, self.step(state, json.loads(row) | {"at": at})))
            last = at
        silence(watermark)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        if last is None:
            self.folded.clear()
        else:
            self.folded.update((json.dumps(state), last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_ = [left[0][0]] if left else []
        if self.silent_s is not None and last is not None:
            next_.append(last + int(self.silent_s * SECOND))
        if next_:
            self.handle.registerTimer(min(next_) // 1000 + 1)
        if out:
            made = {name: [value] * len(out) for name, value in zip(self.names, key)} | {"at": [x[0] for x in out], "seq": pd.array([x[1] for x in out], "Int64")}
            yield pd.DataFrame(made | {n: pd.array([x[2].get(n) for x in out], _PANDAS[k]) for n, k in self.outputs.items()})

    def close(self) -> None:
        pass


def machine(stream: DataFrame, key: list[str], time: str, tie: str, reads: list[str], step: Step, outputs: dict[str, str], silent_s: float | None = None) -> DataFrame:
    """key..., at, seq and the outputs of step for each row of a stream with a watermark on its time."""
    kinds = StructType([f for f in stream.schema.fields if f.name in key] + StructType.fromDDL("at long, seq long, " + ", ".join(f"{n} {k}" for n, k in outputs.items())).fields)
    kinds = StructType(sorted(kinds.fields[: len(key)], key=lambda f: key.index(f.name)) + kinds.fields[len(key) :])
    columns = dict.fromkeys([*key, time, *(c for c in reads if c != "at")])
    rows = stream.select(*columns, F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("seq"))
    process = _Machine(key, [c for c in reads if c != "at"], step, outputs, silent_s)
    return rows.groupBy(*key).transformWithStateInPandas(process, kinds, "append", "EventTime")


def _debounce(state: dict, row: dict | None, dwell_s: float, healthy: str | None, clear_s: float) -> dict:
    if row is None:
        return {}
    at, new = row["at"], row["state"]
    dwell = (clear_s if new == healthy else dwell_s) * SECOND
    first = "shown" not in state
    if first:
        state["shown"] = new if healthy is None or new == healthy else "unknown"
    if state["shown"] == "unknown" and new == healthy:
        state["shown"] = new
    if state.get("seen") != new or at - state["last"] >= dwell:
        state["since"] = at
    state["seen"], state["last"] = new, at
    if new != state["shown"] and at - state["since"] >= dwell:
        old, state["shown"] = state["shown"], new
        return {"old_value": old, "new_value": new, "since": state["since"]}
    return {}


def debounce(dwell_s: float, healthy: str | None = "ok", clear_s: float | None = None) -> Step:
    """T3 of rows (at, state): a confirmed transition at the row that confirms it, else nulls (streaming.state.debounced is the same by windows)."""
    return partial(_debounce, dwell_s=dwell_s, healthy=healthy, clear_s=dwell_s if clear_s is None else clear_s)


DEBOUNCE_OUT = {"old_value": "string", "new_value": "string", "since": "long"}


def _hold(state: dict, row: dict | None, hold_s: float) -> dict:
    if row is None:
        return {}
    at, rank = row["at"], row["rank"]
    if "served" not in state or rank >= state["served"]:
        state.clear()
        state["served"] = rank
        return {"held_rank": rank}
    since, floor = state.setdefault("since", at), max(state.get("floor", rank), rank)
    if at - since >= hold_s * SECOND:
        state.clear()
        state["served"] = floor
    else:
        state["floor"] = floor
    return {"held_rank": state["served"]}


def hold(hold_s: float) -> Step:
    """T4 of rows (at, rank): worse at once, better only after the hold."""
    return partial(_hold, hold_s=hold_s)


HOLD_OUT = {"held_rank": "long"}


def _alarm(state: dict, row: dict | None, onset_s: float, clear_s: float, gap_s: float) -> dict:
    if row is None:
        return {}
    at, want = row["at"], row["bad"]
    if at == state.get("last"):  # a repeat of a time changes nothing
        return {"alarm": state["alarm"]}
    alarm = state.get("alarm", False)
    if want is None or want == alarm:
        state.update(since=None)
    else:
        unbroken = state.get("want") == want and state.get("since") is not None and at - state["last"] <= gap_s * SECOND
        since = state["since"] if unbroken else at
        if at - since >= (onset_s if want else clear_s) * SECOND:
            alarm, since = want, None
        state["since"] = since
    state.update(alarm=alarm, last=at, want=want)
    return {"alarm": alarm}


def alarm(onset_s: float, clear_s: float, gap_s: float) -> Step:
    """T7 of rows (at, bad, null where unknown): the alarm after each row."""
    return partial(_alarm, onset_s=onset_s, clear_s=clear_s, gap_s=gap_s)


ALARM_OUT = {"alarm": "boolean"}


def _last_seen(state: dict, row: dict | None) -> dict:
    return {"fate": "kept" if row is not None else "expired"}


def expiry() -> Step:
    """T10 with silent_s of machine(): each row is kept, and a key that was silent too long expires once."""
    return _last_seen


EXPIRY_OUT = {"fate": "string"}
