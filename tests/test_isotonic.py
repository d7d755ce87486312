"""Isotonic fits against the min-max formula, and the choice among calibrations."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tickloom.operators.isotonic import interpolated, isotonic
from tickloom.plans.outcome_plans import chosen_calibration


def brute(points):
    """By definition: at each x, the greatest over starts of the least over ends of the means between."""
    xs = sorted({x for x, _ in points})
    t, w = (np.array([f([y for a, y in points if a == x]) for x in xs], float) for f in (sum, len))
    ct, cw = np.r_[0, np.cumsum(t)], np.r_[0, np.cumsum(w)]
    return {x: max(min((ct[b + 1] - ct[a]) / (cw[b + 1] - cw[a]) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize(("seed", "shape"), [(0, "noise"), (1, "rising"), (2, "falling"), (3, "steps")])
def test_isotonic(spark, seed, shape):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random(400), 2 if seed else 6)
    y = {"noise": rng.random(400) < 0.3, "rising": x, "falling": -x, "steps": rng.random(400) < np.floor(4 * x) / 5}[shape].astype(float)
    points = list(zip(x.tolist(), y.tolist(), strict=True))
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None)], "x double, y double").repartition(5)
    steps = sorted(map(tuple, isotonic(df, "x", "y").collect()))
    want = brute(points)
    assert sum(s[2] for s in steps) == 400 and all(a[3] < b[3] and a[1] < b[0] for a, b in zip(steps, steps[1:], strict=False))
    for v, w in want.items():
        assert next(s[3] for s in steps if s[0] <= v <= s[1]) == pytest.approx(w, abs=1e-12)
    ask = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 0.333, 0.5, 0.777, 1.0, 2.0]] + [(None,)], "x double")
    mapped = [r[0] for r in ask.select(interpolated([(a, b, v) for a, b, _, v in steps], F.col("x"))).collect()]
    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(spark.createDataFrame(points, "x double, y double"))
    assert mapped[-1] is None and mapped[:-1] == pytest.approx([model.predict(float(v)) for v in [-1.0, 0.0, 0.333, 0.5, 0.777, 1.0, 2.0]], abs=1e-9)


def test_isotonic_of_nothing(spark):
    assert isotonic(spark.createDataFrame([(None, 1.0)], "x double, y double"), "x", "y").collect() == []
    assert [tuple(r) for r in isotonic(spark.createDataFrame([(0.4, 1.0)] * 3, "x double, y double"), "x", "y").collect()] == [(0.4, 0.4, 3.0, 1.0)]


@pytest.mark.parametrize(("truth", "best"), [(lambda p: p, "raw"), (lambda p: 1 / (1 + np.exp(2 - 0.5 * np.log(p / (1 - p)))), "platt"), (lambda p: np.where(p < 0.5, 0.02, 0.9), "isotonic")])
def test_choice(spark, truth, best):
    rng = np.random.default_rng(5)
    p = rng.uniform(0.02, 0.98, 8_000)
    y = (rng.random(8_000) < truth(p)).astype(int)
    df = spark.createDataFrame([(float(a), int(b), i % 2) for i, (a, b) in enumerate(zip(p, y, strict=True))], "p double, y int, part int")
    maps, chosen, losses = chosen_calibration(df.where("part = 0"), df.where("part = 1"), "p", "y")
    assert set(maps) == {"raw", "platt", "isotonic"} and losses[chosen] == min(losses.values())
    assert chosen == best or losses[best] - losses[chosen] < 0.002
    one = df.where("part = 0 and y = 1")
    assert chosen_calibration(one, df, "p", "y")[1] == "raw" and chosen_calibration(df.limit(0), df.limit(0), "p", "y")[2] == {"raw": None}
