"""Streams over files that come in several batches."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.streaming import stateful
from tickloom.streaming.stateful import VolumeSteps, rocks, volume_steps
from tickloom.streaming.ticks import counted, counters, decider, first_seen, landed, minute_bars, watched_bars

SCHEMA = "symbol long, ts timestamp, seq long, price double, cum long"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10, minute, second)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes one file a batch and drains what a stream makes of it."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run(make, batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            stream = make(spark.readStream.schema(SCHEMA).parquet(str(source)))
            with rocks(spark):
                query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
                query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(out))

    return run


def test_a_late_tick_changes_no_final_bar(feed):
    first = [(1, at(0, 5), 1, 10.0, 0), (1, at(0, 50), 2, 12.0, 0), (1, at(20), 3, 9.0, 0)]
    late = [(1, at(0, 55), 4, 99.0, 0), (1, at(40), 5, 8.0, 0), (1, at(40), 6, -1.0, 0)]
    got = feed(lambda s: minute_bars(s, "5 minutes"), [first, late]).orderBy("minute").select("open", "high", "low", "close", "n_ticks").collect()
    assert [tuple(r) for r in got] == [(10.0, 12.0, 10.0, 12.0, 2), (9.0, 9.0, 9.0, 9.0, 1)]


#: A tick so late that all before it is final.
END = (9, dt.datetime(2024, 1, 2), 99, 1.0, 0)


def test_volume_steps_go_on_from_batch_to_batch(feed):
    """Rows of a batch come in any order; unknown readings, and one that falls back."""
    batches = [[(1, at(1), 2, 1.0, 9), (2, at(1), 3, 1.0, 4), (1, at(0), 1, 1.0, 5)], [(1, at(3), 5, 1.0, 12), (1, at(2), 4, 1.0, 7), (1, at(2, 30), 6, 1.0, None)], [END]]
    got = feed(volume_steps, batches).orderBy("seq").collect()
    assert [(r.symbol, r.seq, r.step) for r in got] == [("1", 1, None), ("1", 2, 4), ("2", 3, None), ("1", 4, 0), ("1", 5, 3), ("1", 6, None)]


class Handle:
    """State of one key in memory, that counts what is asked of it."""

    def __init__(self):
        self.timers, self.maps, self.value, self.largest = set(), {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        outer = self

        class Value:
            exists = staticmethod(lambda: outer.value is not None)
            get = staticmethod(lambda: outer.value)
            update = staticmethod(lambda v: setattr(outer, "value", v))
            clear = staticmethod(lambda: setattr(outer, "value", None))

        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def containsKey(self, k):
        return k in self.maps

    def getValue(self, k):
        return self.maps[k]

    def updateValue(self, k, v):
        self.maps[k] = v
        self.largest = max(self.largest, len(v[0]))

    def removeKey(self, k):
        del self.maps[k]

    def keys(self):
        return list(self.maps)

    def exists(self):
        return bool(self.maps)

    def getCurrentWatermarkInMs(self):
        return 10**15


def test_a_million_ticks_of_a_symbol_in_one_batch():
    """Buckets and frames are bounded, whatever a batch brings and in whatever order; rows equal a plain running top."""
    rng, handle, p = np.random.default_rng(3), Handle(), VolumeSteps(60)
    p.init(handle)
    n = 1_000_000
    ts, cum = np.arange(n) * 36_000, np.cumsum(rng.integers(-1, 4, n)).astype(float)
    order = rng.permutation(n)
    for part in np.array_split(order, 50):
        assert list(p.handleInputRows(("a",), iter([pd.DataFrame({"at": ts[part], "seq": part, "cum": cum[part]})]), None)) == []
    assert handle.largest <= 24 * (60 * 10**6 // 36_000 + 1) and len(handle.timers) == 600
    frames = list(p.handleExpiredTimer(("a",), handle, None))
    assert max(map(len, frames)) <= stateful.FRAME and not handle.maps
    out = pd.concat(frames)
    top = np.maximum.accumulate(cum)
    assert out["seq"].tolist() == list(range(n)) and out["step"].isna().sum() == 1 and (out["step"].to_numpy(float)[1:] == np.diff(top)).all()


def test_deliveries_come_in_order(spark):
    rows = [(1, at(i % 60), i, 1.0, i) for i in range(50)]
    folder = landed(spark.createDataFrame(rows, SCHEMA), "ts", 4)
    files = sorted(Path(folder).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    own = [spark.read.parquet(str(f)).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first() for f in files]
    assert len(own) == 4 and sum(r["n"] for r in own) == 50 and all(x["b"] < y["a"] for x, y in zip(own, own[1:], strict=False))


def test_a_key_passes_once(feed):
    batches = [[(1, at(0), 1, 1.0, 0), (1, at(0), 1, 2.0, 0)], [(1, at(1), 1, 3.0, 0), (1, at(1), 2, 3.0, 0)]]
    got = feed(lambda s: first_seen(s, ["symbol", "seq"], "10 minutes"), batches)
    assert sorted(r.seq for r in got.select(F.col("seq")).collect()) == [1, 2]


def test_a_minute_counts_only_if_watched_from_its_start(feed, spark):
    since = spark.createDataFrame([(1, at(0, 30)), (2, at(1, 0))], "symbol long, since timestamp")
    rows = [(1, at(0, 40), 1, 5.0, 0), (1, at(1, 10), 2, 6.0, 0), (2, at(1, 0), 3, 7.0, 0), (3, at(1, 0), 4, 8.0, 0), (1, at(30), 5, 1.0, 0), (2, at(30), 6, 1.0, 0)]
    got = feed(lambda s: watched_bars(s, since, "5 minutes"), [rows]).select("symbol", "open").collect()
    assert sorted(tuple(r) for r in got) == [(1, 6.0), (2, 7.0)]


def test_counters_see_late_and_unknown(spark, tmp_path):
    source = tmp_path / "in"
    reports = []
    for rows in ([(1, at(0), 1, 1.0, None), (1, at(40), 2, 2.0, 3), (1, at(40), 5, -1.0, 3)], [(1, at(1), 3, 1.0, 4), (1, at(41), 4, 1.0, None)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        bars = minute_bars(counted(spark.readStream.schema(SCHEMA).parquet(str(source))), "5 minutes")
        query = bars.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        reports += [json.loads(p.json) if not isinstance(p, dict) else p for p in query.recentProgress]
    assert counters(reports) == {"n": 5, "no_price": 1, "unknown_volume": 2, "late": 1}


def test_a_silent_symbol_begins_anew(feed):
    """Whether its rows come in one batch or in several."""
    batches = [[(1, at(0), 1, 1.0, 5), (2, at(0), 2, 1.0, 5)], [(2, at(9), 3, 1.0, 6), (2, at(18), 4, 1.0, 7), (3, at(18), 7, 1.0, 1), (3, at(40), 8, 1.0, 2), (3, at(41), 9, 1.0, 5)], [(1, at(42), 5, 1.0, 9), (2, at(28), 6, 1.0, 9)], [END]]
    got = {r.seq: r.step for r in feed(lambda s: volume_steps(s, 10, "30 minutes"), batches).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 1, 5: None, 6: 2, 7: None, 8: None, 9: 3}


def test_decision_cycles(spark, tmp_path):
    """Context as of each cycle, from versions that come between batches; unknown inputs, ties, and a batch that runs twice."""
    kind = "symbol string, cycle timestamp, x double, y double"
    versions = lambda rows: spark.createDataFrame(rows, "symbol string, known_at timestamp, allowed boolean").write.mode("append").parquet(str(tmp_path / "context"))
    versions([(s, at(0), True) for s in "abc"] + [("d", at(9), True)])
    each = decider(str(tmp_path / "context"), str(tmp_path), ["x", "y"], F.col("x") - F.col("y"), 2)
    first = [("a", at(1), 1.0, 2.0), ("b", at(1), 3.0, 2.0), ("c", at(1), 9.0, None), ("d", at(1), 9.0, 1.0), ("a", at(2), 5.0, 5.0), ("c", at(2), 5.0, 1.0)]
    second = [("a", at(10), 1.0, 2.0), ("b", at(10), 9.0, 2.0), ("d", at(10), 9.0, 1.0), ("c", at(10), 4.0, 1.0)]
    each(spark.createDataFrame(first, kind), 0)
    versions([("b", at(9), False)])
    for _ in range(2):
        each(spark.createDataFrame(second, kind), 1)
    got = sorted((r.batch, r.cycle.minute, r.place, r.symbol, r.side, r.score, r.ready) for r in spark.read.parquet(str(tmp_path / "rows")).collect())
    assert got == [(0, 1, 1, "a", "SHORT", -1.0, 2), (0, 1, 2, "b", "LONG", 1.0, 2), (0, 2, 1, "c", "LONG", 4.0, 2), (1, 10, 1, "d", "LONG", 8.0, 3), (1, 10, 2, "c", "LONG", 3.0, 3)]
    each(spark.createDataFrame([], kind), 2)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5
