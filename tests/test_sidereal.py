"""References of sidereal bins against a plain loop over the 8 cycles before each."""

import math

from orbitloom import catalog


def middle(v):
    v = sorted(v)
    return v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2 - 1] + v[len(v) // 2] + 1) // 2


def test_last_eight_cycles(spark, tmp_path):
    rows = [(i, float(i * i % 37)) for i in range(88 * 60)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    cells = {}
    for i, v in rows:
        cells.setdefault((i * 977 % 86164 // 300, i * 977 // 86164), []).append(v)
    want, history = [], {}
    for b, c in sorted(cells):
        past = history.setdefault(b, [])
        if len(past) >= 3:
            last = past[-8:]
            m = middle(last)
            want.append((b, c, m, middle([abs(x - m) for x in last]), len(last)))
        past.append(math.floor(sum(cells[b, c]) / len(cells[b, c]) + 0.5))
    assert max(map(len, history.values())) > 9
    got = catalog.QUERIES["a10_sidereal_history"](spark, str(tmp_path)).collect()
    assert sorted((r["bin"], r["cycle"], r["reference"], r["mad"], r["support"]) for r in got) == want
