"""Successors, chains and first rows outside a band against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators.chains import first_outside, followed, next_at_or_after, numbered
from tickloom.plans.label_plans import sequential_moves
from tickloom.plans.path_plans import factor_segments
from tickloom.plans.select_plans import without_overlap


def walked(rows):
    """Moves of a share 0.01, one after the other."""
    out, base, ref = [], rows[0][3], rows[0][0]
    for step, high, low, close in rows[1:]:
        up, down = high >= base * 1.01, low <= base * 0.99
        if up or down:
            out.append((len(out) + 1, ref, step, up - down))
            base, ref = close, step
    return out


def test_next_at_or_after(spark):
    rows = [(g, a, a + d) for g, own in {1: [0, 3, 4, 90, 91, 500], 2: [7]}.items() for a in own for d in (random.Random(a).choice([1, 5, 87, 400]),)]
    df = spark.createDataFrame(rows, "g int, a int, w int")
    got = {(r.g, r.a): r["__to"] for r in next_at_or_after(df, ["g"], "w", df, "a", 10).collect()}
    assert got == {(g, a): min((x for h, x, _ in rows if h == g and x >= w), default=None) for g, a, w in rows}


def test_without_overlap(spark):
    draw = random.Random(4)
    rows = [(g, a, a + draw.randint(-1, 30)) for g in range(3) for a in (draw.randint(0, 300) for _ in range(80))] + [(1, None, 5), (1, 5, None), (1, 400, 401), (1, 400, 401)]
    want = set()
    for g in range(3):
        last = -1
        for a, b in sorted((a, b) for h, a, b in rows if h == g and a is not None and b is not None):
            if a >= last:
                want.add((g, a, b))
                last = max(b, a + 1)
    df = spark.createDataFrame([(*r, 9) for r in rows], "g int, a int, b int, n int")
    for width in (1, 16, 1000):
        got = [tuple(r) for r in without_overlap(df, ["g"], "a", "b", width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert without_overlap(df.limit(0), ["g"], "a", "b").collect() == []


@pytest.mark.parametrize("strict", [False, True])
def test_first_outside(spark, strict):
    draw = random.Random(6)
    rows = []
    for g, n in ((1, 1), (2, 7), (3, 300)):
        for i in range(n):
            x = float(draw.randint(0, 40))
            rows.append((g, i, x, x + draw.randint(0, 3), None if draw.random() < 0.1 else x - draw.randint(0, 40), None if draw.random() < 0.1 else x + draw.randint(0, 40)))
    df = spark.createDataFrame(rows, "g int, i int, low double, high double, floor double, ceil double")

    def crosses(r, s):
        return (r[4] is not None and (s[2] < r[4] or (not strict and s[2] == r[4]))) or (r[5] is not None and (s[3] > r[5] or (not strict and s[3] == r[5])))

    want = {r[:2]: min((s[1] for s in rows if s[0] == r[0] and s[1] > r[1] and crosses(r, s)), default=None) for r in rows}
    for fan in (3,):
        got = {(r.g, r.i): r["__to"] for r in first_outside(df, ["g"], "i", "low", "high", "floor", "ceil", strict, fan).collect()}
        assert got == want


def test_odd_chains(spark):
    links = spark.createDataFrame([(1, 0, 5), (1, 5, 6), (1, 6, None), (1, 7, 8), (2, 0, None), (3, 0, 99)], "g int, i int, to int")
    starts = links.where("i = 0").select("g", "i")
    assert sorted((r.g, r.i, r.n) for r in followed(links, ["g"], "i", "to", starts).collect()) == [(1, 0, 0), (1, 5, 1), (1, 6, 2), (2, 0, 0), (3, 0, 0), (3, 99, 1)]
    assert followed(links.limit(0), ["g"], "i", "to", starts.limit(0)).count() == 0
    assert first_outside(links.select("g", "i", *[F.lit(1.0).alias(c) for c in "lhfc"]).limit(0), ["g"], "i", "l", "h", "f", "c").count() == 0
    rows = spark.createDataFrame([(1, 5), (1, 70), (1, 71), (2, 3)], "g int, at int")
    assert sorted((r.g, r["at"], r.p) for r in numbered(rows, ["g"], "at", 10, "p").collect()) == [(1, 5, 0), (1, 70, 1), (1, 71, 2), (2, 3, 0)]


def test_one_long_group(spark):
    """100,000 rows of one group: the loop's moves and segments, by tasks that each see a part."""
    draw, x, rows = random.Random(8), 100.0, []
    for i in range(100_000):
        x *= 1 + draw.gauss(0, 0.002)
        rows.append((1, i, x * 1.001, x * 0.999, x))
    df = spark.createDataFrame(rows, "g int, i int, high double, low double, close double").repartition(8)
    got = sorted(tuple(r)[1:] for r in sequential_moves(df, ["g"], "i", 0.01, 5_000).collect())
    assert got == walked([r[1:] for r in rows]) and len(got) > 1_000
    want, first = [], None
    for _, i, _, _, c in rows:
        if first is None or c < first * 0.95 or c > first * 1.05:
            want.append([len(want) + 1, i, i, 0, c])
            first = c
        want[-1][2:4] = [i, want[-1][3] + 1]
    assert sorted(list(r)[1:] for r in factor_segments(df, ["g"], "i", "close", 0.05, 5_000).collect()) == want
    spans = df.select("g", "i", (F.col("i") + 1 + F.col("i") % 7).alias("to"))
    took, last = 0, -1
    for i in range(100_000):
        if i >= last:
            took, last = took + 1, i + 1 + i % 7
    assert without_overlap(spans, ["g"], "i", "to", 5_000).count() == took
