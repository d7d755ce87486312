"""The store of bars: what upserts touch, which rows win, what range loads read."""

import datetime as dt
import random
from pathlib import Path

from tickloom.sources.store import BarStore

SCHEMA = "symbol string, bar_start timestamp, load int, close double"
HOUR = dt.timedelta(hours=1)


def bar(day, hour, symbol="a", load=1, close=1.0):
    return (symbol, dt.datetime(2024, 1, day, hour), load, close)


def stored(store):
    return sorted((r.symbol, r.bar_start, r.load, r.close) for r in store.bars().collect())


def stamps(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_only_touched_sessions_are_written(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"), SCHEMA).create()
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert stored(store) == [] and store.upsert(df([])) == []
    store.upsert(df([bar(d, h) for d in (1, 2, 3) for h in range(5)] + [("a", None, 1, 9.0)]))
    before = stamps(tmp_path / "s")
    days = store.upsert(df([bar(2, 1, load=2, close=5.0), bar(2, 9, "b", 2), bar(2, 9, "b", 2), bar(4, 0, load=2)]))
    assert days == [dt.date(2024, 1, 2), dt.date(2024, 1, 4)]
    after = stamps(tmp_path / "s")
    assert {f for f in before if "01-02" not in f} == {f for f in after if f in before} and all(after[f] == before[f] for f in before if f in after)
    assert stored(store) == sorted([bar(d, h) for d in (1, 2, 3) for h in range(5) if (d, h) != (2, 1)] + [bar(2, 1, load=2, close=5.0), bar(2, 9, "b", 2), bar(4, 0, load=2)])
    store.upsert(df([bar(2, 1, load=1, close=7.0), bar(4, 0, load=2, close=8.0)]))
    assert [r for r in stored(store) if r[1].day in (2, 4) and r[0] == "a" and r[1].hour < 2] == [bar(2, 0), bar(2, 1, load=2, close=5.0), bar(4, 0, load=2, close=8.0)]
    store.create()
    assert len(stored(store)) == 17


def test_random_loads(spark, tmp_path):
    draw, want = random.Random(2), {}
    store = BarStore(spark, str(tmp_path / "s"), SCHEMA, files=3).create()
    for load in range(1, 5):
        rows = [bar(*k[1:], k[0], load, draw.random()) for k in {(draw.choice("abc"), draw.randint(1, 5), draw.randint(0, 23)) for _ in range(60)}]
        store.upsert(spark.createDataFrame(rows, SCHEMA))
        want |= {r[:2]: r for r in rows}
    assert stored(store) == sorted(want.values())


def test_range_loads_read_their_sessions(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "s"), SCHEMA).create()
    store.upsert(spark.createDataFrame([bar(d, h) for d in range(1, 9) for h in range(24)], SCHEMA))
    got = store.load(dt.datetime(2024, 1, 3, 6), dt.datetime(2024, 1, 5), HOUR)
    assert sorted(r.bar_start for r in got.collect()) == [dt.datetime(2024, 1, 3, 6) + i * HOUR for i in range(42)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_date" in plan and len(got.inputFiles()) == 8
    assert {f.split("session_date=")[1][:10] for f in [r[0] for r in got.selectExpr("_metadata.file_path").distinct().collect()]} == {"2024-01-03", "2024-01-04"}
