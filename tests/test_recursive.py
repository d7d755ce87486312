"""Recursive averages by a parallel scan against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import recursive as rc


def loop(rows, averages):
    """(part, step) to the averages, folded row by row; rows: (part, step, gap, values)."""
    folds, out = {}, {}
    for part, step, gap, values in sorted(rows, key=lambda r: r[:2]):
        if gap or not folds:
            folds = {c: rc.Fold(a) for c, a in averages.items()}
        out[part, step] = [folds[c](values[a.column]) for c, a in averages.items()]
    return out


def compared(spark, rows, averages, steps):
    """rows: of one group each."""
    flat = [(g, p, s, gap, v["x"], v["y"]) for g, own in rows.items() for p, s, gap, v in own]
    df = spark.createDataFrame(flat, "g int, part int, step int, gap int, x double, y double").repartition(7)
    got = rc.smoothed(df, ["g"], "part", "step", averages, steps, places=True).collect()
    assert len(got) == len(flat)
    want = {(g, *k): v for g, own in rows.items() for k, v in loop(own, averages).items()}
    for r in got:
        for c, w in zip(averages, want[r["g"], r["part"], r["step"]], strict=True):
            assert (r[c] is None) == (w is None), (r, c, w)
            assert w is None or r[c] == pytest.approx(w, rel=1e-9, abs=1e-12)
    return got


AVERAGES = {"a": rc.exponential("x", 9), "b": rc.wilder("y", 14), "c": rc.Average("x", 3, 0.5), "d": rc.wilder("y", 2, hold=True), "e": rc.Average("y", 1, 0.999)}


def test_runs_over_parts(spark):
    """Gaps, unknown values, runs shorter than a seed, parts of one row, several groups; steps cut into blocks where powers need it."""
    draw, rows = random.Random(7), {}
    for g in range(4):
        own = []
        for part in sorted(draw.sample(range(60), 25)):
            for step in sorted(draw.sample(range(40), draw.choice([1, 2, 20, 40]))):
                gap = int(any(p == part for p, *_ in own) and draw.random() < 0.03)
                own.append((part, step, gap, {c: None if draw.random() < 0.1 else draw.gauss(0, 5) for c in "xy"}))
        rows[g] = own
    got = compared(spark, rows, AVERAGES, 40)
    for g, own in rows.items():
        mine = sorted((r["part"], r["step"], r["run"], r["place"]) for r in got if r["g"] == g)
        run = place = 0
        for (p, s, gap, _), r in zip(sorted(own, key=lambda r: r[:2]), mine, strict=True):
            run, place = (run + 1, 1) if gap else (run, place + 1)
            assert r == (p, s, run, place)
    compared(spark, {0: rows[0]}, {"e": rc.Average("y", 1, 0.999), "f": rc.Average("x", 5, 0.9)}, 1440)


def test_long_run(spark):
    """100,000 rows without a gap: finite and equal to the loop, half of the weight a row; the group's rows lie in many tasks."""
    draw = random.Random(1)
    rows = [(i // 1000, i % 1000, 0, {"x": 100 + draw.gauss(0, 1), "y": 0.0 if i > 40_000 else 1.0}) for i in range(100_000)]
    averages = {"half": rc.Average("x", 5, 0.5), "slow": rc.exponential("x", 50), "still": rc.wilder("y", 14)}
    compared(spark, {1: rows}, averages, 1000)
    df = spark.createDataFrame([(1, p, s, g, v["x"], v["y"]) for p, s, g, v in rows], "g int, part int, step int, gap int, x double, y double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = rc.smoothed(df, ["g"], "part", "step", averages, 1000).select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 4 and max(r["count"] for r in spread) < 60_000


def test_odd_averages(spark):
    with pytest.raises(ValueError, match="weight"):
        rc.Average("x", 3, 1.0)
    empty = spark.createDataFrame([], "g int, part int, step int, gap int, x double, y double")
    assert rc.smoothed(empty, ["g"], "part", "step", AVERAGES).collect() == []
    blank = spark.createDataFrame([(1, 1, i, 0, None, None) for i in range(20)], empty.schema)
    assert {r["a"] for r in rc.smoothed(blank, ["g"], "part", "step", AVERAGES).collect()} == {None}


def test_previous(spark):
    rows = [(1, 1, 3, 0, 5.0), (1, 1, 4, 0, None), (1, 2, 0, 0, 7.0), (1, 3, 2, 0, 8.0), (1, 3, 9, 1, 9.0), (2, 1, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "g int, part int, step int, gap int, x double")
    got = {(r["g"], r["part"], r["step"]): r["previous_x"] for r in rc.with_previous(df, ["g"], "part", "step", ["x"]).collect()}
    assert got == {(1, 1, 3): None, (1, 1, 4): 5.0, (1, 2, 0): None, (1, 3, 2): 7.0, (1, 3, 9): None, (2, 1, 1): None}
