"""Ratios around events, and ranks with repeated rows, against plain loops."""

from itertools import combinations

import numpy as np
import pytest

from tickloom.plans.path_plans import EVENT_DAYS, event_ratios
from tickloom.plans.study_plans import average_ranks, rank_correlations


def plain(days, ex):
    """One side after the other, widest first."""

    def slope(own):
        if not own:
            return None
        x, y = (np.array([p[k] for _, pairs, _ in own for p in pairs]) for k in (0, 1))
        if (x.max() - x.min()) / np.median(x) < 0.01:
            return None
        a, c = np.polyfit(x, y, 1)
        return float(a) if all(max(abs(a * p + c - q) for p, q in pairs) <= allowed for _, pairs, allowed in own) else None

    before, after = [d for d in days if d[0] < ex], [d for d in days if d[0] >= ex]
    for w in EVENT_DAYS:
        left, right = slope(before[-w:]), slope(after[:w])
        if left is not None and right is not None:
            m = left / right
            return (w, None) if abs(m - 1) <= 0.005 else (w, m)
    return (None, None)


def test_event_ratios(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for symbol in range(6):
        price, days = 100.0, []
        for i in sorted(rng.choice(np.arange(3, 120), 60, replace=False).tolist()):
            price *= 1 + rng.normal(0, 0.0001 if symbol == 5 else 0.03)
            x = price * (1 + np.array([0, 0.01, -0.01, 0.005]) * (0.01 if symbol == 5 else 1))
            y = x * (1.0 if i >= 60 else (0.5, 1.0, 0.37, 2.0, 1.0, 0.5)[symbol]) + (3.0 if rng.random() < 0.04 else 0.0) * np.array([1, 0, 0, 0])
            days.append((i, list(zip(x.tolist(), y.tolist(), strict=True)), 0.02))
        rows += [(symbol, *d) for d in days]
        for ex in [1, 60, 61, 90, 119, 500, *[d[0] for d in days[10::9]]]:
            want[symbol, ex] = plain(days, ex)
    days = spark.createDataFrame(rows, "symbol int, idx int, pairs array<struct<x:double,y:double>>, allowed double")
    events = spark.createDataFrame([*want, *list(want)[:3]], "symbol int, ex int")
    got = {(r.symbol, r.ex): r for r in event_ratios(days, events, bucket=10).collect()}
    assert got.keys() == want.keys()
    for k, (width, measured) in want.items():
        r = got[k]
        assert r["width"] == width and r["measured"] == (None if measured is None else pytest.approx(measured, rel=1e-9)), (k, r)
        assert r["status"] == ("unresolved" if width is None else "unadjusted" if measured is None else "adjusted")
    assert {r["ratio"] for r in got.values()} >= {0.5, 2.0} and any(r["ratio"] == r["measured"] is not None for r in got.values())
    assert event_ratios(days.limit(0), events.limit(0)).collect() == []


def test_ranks_count_repeated_rows(spark):
    rng = np.random.default_rng(9)
    base = [(float(a), float(b), float(c)) for a, b, c in rng.integers(0, 30, (300, 3))]
    rows = base + base[:40] * 6 + [(1.0, None, 2.0)] * 3
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)

    def ranks(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    got = {(r.feature, r.v): r["rank"] for r in average_ranks(df, ("a", "b", "c"), 8).collect()}
    own = {n: [r[i] for r in rows if r[i] is not None] for i, n in enumerate("abc")}
    assert got == {(n, x): r for n, v in own.items() for x, r in zip(v, ranks(v), strict=True)}
    rho = rank_correlations(df, ("a", "b", "c"))
    for (i, a), (j, b) in combinations(enumerate("abc"), 2):
        both = [(got[a, r[i]], got[b, r[j]]) for r in rows if r[i] is not None and r[j] is not None]
        assert rho[a, b] == pytest.approx(np.corrcoef(*zip(*both, strict=True))[0, 1], abs=1e-12)
    assert set(rank_correlations(df.limit(0), ("a", "b")).values()) == {0.0}
