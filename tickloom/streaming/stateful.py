"""Streams whose operators keep typed state for each key and take its rows in order of time.

Rows wait in map state by bucket of time until the watermark has passed their
bucket; a timer then takes the bucket out, sorts it and folds it. A task holds one
bucket of one key at a time, and emits it in frames of bounded size, however many
rows a micro-batch brings. The state store must be RocksDB's (`rocks`).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom.operators.recursive import Average, Fold, exponential, smoothed, wilder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a frame that is emitted.
FRAME = 10_000


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session's state store while streams start and run; afterwards what it was."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


class InOrder(StatefulProcessor):
    """Folds the rows (ts, seq and `columns`) of a key in order of (ts, seq), bucket by bucket.

    Subclasses give `columns` (doubles; null is NaN), the schema of the state
    (`kept`), and `fold`: a new state and the values that rows emit. With idle
    seconds, the state of a key that was silent for longer is dropped, by a timer
    and, where rows come again, by their times alone, so that batches don't matter.
    """

    columns: tuple[str, ...] = ()
    kept = ""

    def __init__(self, bucket: float, idle: float | None = None) -> None:
        self.width, self.idle = int(bucket * 1e6), None if idle is None else int(idle * 1e6)
        self.row = np.dtype([("ts", "<i8"), ("seq", "<i8"), *[(c, "<f8") for c in self.columns]])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.state = handle.getValueState("state", f"at long, {self.kept}")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        """A row with the columns of the state: the key goes on from there."""
        for r in initialState[["at", *[c.split()[0] for c in self.kept.split(", ")]]].itertuples(index=False, name=None):
            self.state.update(tuple(None if x is None or x != x else x for x in r))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        for frame in rows:
            packed = np.empty(len(frame), self.row)
            packed["ts"], packed["seq"] = frame["at"], frame["seq"]
            for c in self.columns:
                packed[c] = frame[c].astype("float64")
            bucket = packed["ts"] // self.width
            for b in np.unique(bucket).tolist():
                held = self.waiting.getValue((b,)) if self.waiting.containsKey((b,)) else None
                if held is None:
                    self.handle.registerTimer(-(-(b + 1) * self.width // 1000))
                self.waiting.updateValue((b,), ((bytes(held[0]) if held else b"") + packed[bucket == b].tobytes(),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get() if self.state.exists() else None
        state = held
        for b in sorted(k[0] for k in self.waiting.keys()):
            if (b + 1) * self.width > passed:
                break
            rows = np.sort(np.frombuffer(bytes(self.waiting.getValue((b,))[0]), self.row), order=["ts", "seq"])
            self.waiting.removeKey((b,))
            for at in range(0, len(rows), FRAME):
                state, out = self._folded(key[0], state, rows[at : at + FRAME])
                yield out
        if state is None:
            return
        if self.idle is not None and state[0] + self.idle < passed and not self.waiting.exists():
            self.state.clear()
        elif state is not held:
            self.state.update(state)
            if self.idle is not None:
                self.handle.registerTimer((state[0] + self.idle) // 1000 + 1)

    def _folded(self, key, state: tuple | None, rows: np.ndarray) -> tuple[tuple, pd.DataFrame]:
        """Rows folded, the state dropped wherever the key was silent for too long before."""
        parts, at = [], 0
        if self.idle is not None:
            before = np.r_[rows["ts"][0] if state is None else state[0], rows["ts"][:-1]]
            cuts = np.flatnonzero(rows["ts"] - before > self.idle)
        else:
            cuts = ()
        for end in [*[c for c in cuts if c > 0], len(rows)]:
            if at in cuts:
                state = None
            kept, values = self.fold(None if state is None else state[1:], rows[at:end])
            state = (int(rows["ts"][end - 1]), *kept)
            parts.append(pd.DataFrame({"symbol": key, "seq": rows["seq"][at:end], **values}))
            at = end
        return state, parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)

    def fold(self, state: tuple | None, rows: np.ndarray) -> tuple[tuple, dict]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder, schema: str, late: str, initial: DataFrame | None = None) -> DataFrame:
    """What a processor makes of a stream of rows (symbol, ts, seq, its columns), `late` behind the newest. initial: states (symbol, at, those of the processor) of a table at rest."""
    timed = rows.select(F.col("symbol").cast("string").alias("symbol"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in processor.columns]).withWatermark("ts", late)
    return timed.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "EventTime", initial.groupBy("symbol") if initial is not None else None)


class VolumeSteps(InOrder):
    """How far each reading `cum` lies above the highest before it."""

    columns = ("cum",)
    kept = "top double"

    def fold(self, state, rows):
        top = np.fmax.accumulate(np.r_[np.nan if state is None or state[0] is None else state[0], rows["cum"]])
        step = np.where(np.isnan(rows["cum"]), np.nan, top[1:] - top[:-1])
        return (None if np.isnan(top[-1]) else float(top[-1]),), {"step": pd.Series(step).astype("Int64").array}


def volume_steps(ticks: DataFrame, idle_minutes: float | None = None, late: str = "0 minutes", bucket_minutes: float = 1) -> DataFrame:
    """(symbol, seq, step): how far each reading of (symbol, ts, seq, cum) lies above the highest before it in its symbol, in order of (ts, seq).

    The first reading's step is unknown (null), as are those of unknown readings;
    readings that fall back add 0. The highest reading is kept per symbol from
    batch to batch; with idle_minutes, that of a symbol which is silent for longer
    is dropped, and its next reading is a first one again. Rows come out once the
    watermark has passed their bucket; those behind the watermark are dropped.
    """
    idle = None if idle_minutes is None else idle_minutes * 60
    return in_order(ticks, VolumeSteps(bucket_minutes * 60, idle), "symbol string, seq long, step long", late)


#: Averages of bars that the stream keeps, by name: those of the batch queries.
def bar_averages(short: int, long: int, span: int) -> dict[str, Average]:
    return {"short": exponential("close", short), "long": exponential("close", long), "gain": wilder("gain", span), "loss": wilder("loss", span), "atr": wilder("tr", span)}


#: Session context that the stream keeps: what the first bar's step was, whether a volume was unknown, and the values so far.
_CONTEXT = ("first", "unknown", "s_open", "s_high", "s_low", "s_volume", "or_high", "or_low")


class BarFeatures(InOrder):
    """Averages, range, relative strength and session context of bars, as the batch operators define them.

    seq is the bar's step since the epoch (its session times `steps`, and its step
    in it), by which gaps are seen.
    """

    columns = ("open", "high", "low", "close", "volume")

    def __init__(self, bucket: float, averages: dict[str, Average], steps: int, opening: int, anchor: int) -> None:
        self.averages, self.steps, self.opening, self.anchor = averages, steps, opening, anchor
        self.kept = ", ".join(["seq long", "close double", *[f"n_{c} long, s_{c} double" for c in averages], *[f"{c} double" for c in _CONTEXT]])
        super().__init__(bucket)

    def fold(self, state, rows):
        seq, close, *rest = state or (None, None, *[0, 0.0] * len(self.averages), *[None] * len(_CONTEXT))
        folds = {c: Fold(a, (rest[2 * i], rest[2 * i + 1])) for i, (c, a) in enumerate(self.averages.items())}
        seen = dict(zip(_CONTEXT, rest[2 * len(self.averages) :], strict=True))
        out = []
        for r in rows:
            step = int(r["seq"]) % self.steps
            if seq is not None and int(r["seq"]) // self.steps == seq // self.steps and int(r["seq"]) != seq + 1:
                folds, close = {c: Fold(a) for c, a in self.averages.items()}, None
            if seq is None or int(r["seq"]) // self.steps != seq // self.steps:
                seen = dict.fromkeys(_CONTEXT) | {"first": float(step), "unknown": 0.0, "s_volume": 0.0}
            seq = int(r["seq"])
            o, h, x, c, v = (float(r[k]) for k in self.columns)
            change = None if close is None else c - close
            known = {
                "close": c, "tr": h - x if close is None else max(h - x, abs(h - close), abs(x - close)),
                "gain": None if change is None else max(change, 0.0), "loss": None if change is None else max(-change, 0.0),
            }
            values = {k: f(known[self.averages[k].column]) for k, f in folds.items()}
            close = c
            seen["s_open"] = o if seen["s_open"] is None else seen["s_open"]
            most = lambda name, value, pick: value if seen[name] is None else pick(seen[name], value)
            seen["s_high"], seen["s_low"] = most("s_high", h, max), most("s_low", x, min)
            if step < self.opening:
                seen["or_high"], seen["or_low"] = most("or_high", h, max), most("or_low", x, min)
            seen["unknown"] = max(seen["unknown"], float(v != v))
            seen["s_volume"] += 0.0 if v != v else v
            whole, over = seen["first"] <= self.anchor, step >= self.opening
            gain, loss = values.pop("gain"), values.pop("loss")
            rsi = None if gain is None else 50.0 if gain == loss == 0 else 100 * gain / (gain + loss)
            shown = {c: seen[c] if whole and (over or not c.startswith("or_")) else None for c in _CONTEXT[2:]}
            if seen["unknown"]:
                shown["s_volume"] = None
            out.append({**values, "rsi": rsi, "true_range": known["tr"], **shown})
        kept = (seq, close, *[x for f in folds.values() for x in f.state], *seen.values())
        frame = pd.DataFrame(out).astype("float64")
        return kept, {c: frame[c].to_numpy() for c in frame}


_FEATURES = ("short", "long", "atr", "rsi", "true_range", *_CONTEXT[2:])


def bar_features(bars: DataFrame, averages: dict[str, Average], steps: int, opening: int, anchor: int, late: str, bucket: float, initial: DataFrame | None = None) -> DataFrame:
    """Features of a stream of bars (symbol, ts, seq, open, high, low, close, volume); initial: states from `warmed`."""
    processor = BarFeatures(bucket, averages, steps, opening, anchor)
    schema = "symbol string, seq long, " + ", ".join(f"{c} double" for c in _FEATURES)
    return in_order(bars, processor, schema, late, initial)


def warmed(bars: DataFrame, averages: dict[str, Average], steps: int, opening: int) -> DataFrame:
    """The state of each symbol after bars at rest (symbol, session, hr, ts, seq, open, high, low, close, volume, previous_close, gap), by the parallel scan."""
    change = F.col("close") - F.col("previous_close")
    span = F.col("high") - F.col("low")
    up = lambda c: F.when(change.isNotNull(), F.greatest(c, F.lit(0.0)))
    wide = F.when(change.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - F.col("previous_close")), F.abs(F.col("low") - F.col("previous_close"))))
    scanned = smoothed(bars.withColumn("gain", up(change)).withColumn("loss", up(-change)).withColumn("tr", wide), ["symbol"], "session", "hr", averages, steps, states=True)
    kept = [x for c in averages for x in (f"n_{c}", f"s_{c}")]
    last = scanned.groupBy("symbol").agg(F.max_by(F.struct(F.unix_micros("ts").alias("at"), "seq", "close", *kept), "seq").alias("r"))
    early = lambda c: F.when(F.col("hr") < opening, F.col(c))
    days = bars.groupBy("symbol", "session").agg(
        F.min("hr").cast("double").alias("first"), F.max(F.col("volume").isNull().cast("double")).alias("unknown"), F.min_by("open", "hr").alias("s_open"), F.max("high").alias("s_high"), F.min("low").alias("s_low"),
        F.coalesce(F.sum("volume").cast("double"), F.lit(0.0)).alias("s_volume"), F.max(early("high")).alias("or_high"), F.min(early("low")).alias("or_low"))
    day = days.groupBy("symbol").agg(F.max_by(F.struct(*_CONTEXT), "session").alias("d"))
    return last.join(day, "symbol").select("symbol", "r.*", "d.*")
