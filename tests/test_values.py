"""Operators against values worked out by hand, brute force and closed forms, with unknown inputs, ties, repeated rows and empty tables."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import options
from tickloom.plans import audit_plans, label_plans, option_plans, outcome_plans, rule_plans, select_plans, study_plans
from tickloom.sources import files

SF = "/root/testdata/sf0.001"


def one(df):
    return df.collect()[0]


def test_normal_and_prices():
    x = np.array([-9.0, -7.5, -3, -0.4, 0, 0.4, 2, 7.5])
    assert np.allclose(options.normal(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-7, atol=1e-300)
    rng = np.random.default_rng(1)
    f, k, t, v = rng.uniform(50, 200, 500), rng.uniform(50, 200, 500), rng.uniform(0.02, 2, 500), rng.uniform(0.05, 1.5, 500)
    call, put = options.price(f, k, t, v, np.ones(500, bool)), options.price(f, k, t, v, np.zeros(500, bool))
    assert np.allclose(call - put, np.exp(-options.RATE * t) * (f - k), atol=1e-9)
    got = options.solve(call, f, k, t, np.ones(500, bool))
    least = np.exp(-options.RATE * t) * np.maximum(f - k, 0)
    sure = call - least > 1e-6 * f
    assert np.allclose(got[sure], v[sure], atol=1e-5) and sure.mean() > 0.9


def test_implied_volatility_everywhere():
    """Round trips over deep, short and wild options; prices beyond the bounds have none."""
    rng = np.random.default_rng(2)
    n = 20_000
    f, k, t, v, call = rng.uniform(1, 500, n), rng.uniform(1, 500, n), rng.uniform(1e-3, 5, n), rng.uniform(0.01, 4.9, n), rng.random(n) < 0.5
    paid = options.price(f, k, t, v, call, 0.03)
    got = options.solve(paid, f, k, t, call, 0.03)
    worth = options.time_value(np.abs(np.log(f / k)), v * np.sqrt(t))
    sure = worth > 1e-6
    assert np.allclose(got[sure], v[sure], rtol=1e-5) and sure.mean() > 0.6
    found = np.isfinite(got)
    again = options.price(f[found], k[found], t[found], got[found], call[found], 0.03)
    assert np.allclose(again, paid[found], rtol=1e-9, atol=1e-9 * f[found].max())
    assert np.isnan(options.solve(np.array([600.0, -1, 5, 5, 5]), np.array([500.0, 100, 0, 100, 100]), np.array([500.0, 100, 100, -1, 100]), np.array([1.0, 1, 1, 1, 0]), np.ones(5, bool))).all()
    assert np.isnan(options.solve(paid[:50], f[:50], k[:50], t[:50], call[:50], 0.03, lowest=4.95)).all()


def test_implied_volatility_of_odd_rows(spark):
    rows = [(8.0, 100.0, 100.0, 0.25, True), (0.0, 100.0, 90.0, 0.25, True), (101.0, 100.0, 90.0, 0.25, True), (None, 100.0, 90.0, 0.25, True), (5.0, 100.0, 100.0, 0.0, False), (8.0, 100.0, 100.0, 0.25, True), (5.0, 100.0, 100.0, 0.25, None)]
    df = spark.createDataFrame(rows, "p double, f double, k double, t double, c boolean")
    col = options.implied_volatility(F.col("p"), F.col("f"), F.col("k"), F.col("t"), F.col("c"))
    got = [r["v"] for r in df.select(col.alias("v")).collect()]
    assert got[0] == got[5] and abs(float(options.price(*(np.array([x]) for x in (100.0, 100.0, 0.25, got[0])), np.array([True]))[0]) - 8) < 1e-9
    assert got[1:5] == [None] * 4 and got[6] is not None
    assert df.limit(0).select(col.alias("v")).count() == 0


def test_chain_of_all_options(spark):
    from tickloom.registry import QUERIES

    rows = QUERIES["l5_implied_volatility"](spark, SF).toPandas()
    known = rows[rows.implied_vol.notna()]
    back = options.price(*(known[c].to_numpy(float) for c in ("forward", "strike")), known.dte.to_numpy() / 365, known.implied_vol.to_numpy(float), (known.opt == "CE").to_numpy())
    assert len(known) > 50 and np.allclose(back, known.close.to_numpy(float), rtol=1e-6)


def test_interpolation(spark):
    p = spark.createDataFrame([(1, 90.0, 0.3), (1, 110.0, 0.2), (2, 100.0, 0.4), (3, 90.0, 0.5)], "g int, k double, v double")
    got = {r["g"]: r["at"] for r in option_plans.interpolated(p, ["g"], "k", "v", F.lit(100.0), "at").collect()}
    assert got == {1: 0.25, 2: 0.4, 3: None}


SNAP = {"ema9": 103.0, "ema21": 102.0, "ema50": 101.0, "adx14": 37.5, "macd_histogram": 0.5, "rsi14": 60.0, "atr14": 4.0, "close": 109.9, "rolling_high_20": 110.0, "rolling_low_20": 100.0, "volume_ratio_20": 2.25,
        "bollinger_percent_b_20": 1.25, "price_vs_vwap_sigma": -3.0, "opening_range_high": 108.0, "opening_range_low": 104.0}


@pytest.mark.parametrize(("rule", "change", "want"), [
    ("trend_continuation", {}, ("LONG", 0.375)), ("trend_continuation", {"rsi14": 80.0}, None), ("trend_continuation", {"adx14": 24.9}, None), ("trend_continuation", {"ema50": None}, None),
    ("trend_continuation", {"ema9": 100.0, "ema21": 100.5, "macd_histogram": -9.0}, ("SHORT", 0.75)), ("trend_continuation", {"atr14": 0.0}, ("LONG", 0.25)),
    ("range_breakout", {}, ("LONG", (0.75 + 0.5) / 2)), ("range_breakout", {"volume_ratio_20": None}, ("LONG", 0.75)), ("range_breakout", {"close": 100.3}, ("SHORT", (0.25 + 0.5) / 2)), ("range_breakout", {"close": 105.0}, None), ("range_breakout", {"atr14": 0.0}, None),
    ("band_mean_reversion", {}, None), ("band_mean_reversion", {"adx14": 19.0, "rsi14": 77.5}, ("SHORT", 0.5)), ("band_mean_reversion", {"adx14": 19.0, "rsi14": 15.0, "bollinger_percent_b_20": 0.0}, ("LONG", 0.5)),
    ("vwap_reversion", {}, ("LONG", 0.5)), ("vwap_reversion", {"price_vs_vwap_sigma": 9.0}, ("SHORT", 1.0)), ("vwap_reversion", {"price_vs_vwap_sigma": None}, None),
    ("opening_range_breakout", {}, ("LONG", 0.475)), ("opening_range_breakout", {"close": 103.0}, ("SHORT", 0.25)), ("opening_range_breakout", {"close": 106.0}, None), ("opening_range_breakout", {"atr14": 0.0}, None),
])
def test_rules(spark, rule, change, want):
    direction, score = rule_plans.RULES[rule]()
    row = SNAP | change
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row)).select(direction.alias("d"), score.alias("s"))
    got = one(df)
    assert (got["d"], got["s"]) == (None, None) if want is None else (got["d"] == want[0] and abs(got["s"] - want[1]) < 1e-12)


@pytest.mark.parametrize(("buy", "sell", "same"), [(100_000, 100_200, True), (20_000, 19_000, True), (100_000, 105_000, False)])
def test_charges(spark, buy, sell, same):
    b, s = Decimal(buy), Decimal(sell)
    brokerage = sum(min(Decimal(20), x * Decimal("0.0003")) for x in (b, s)) if same else Decimal(0)
    exchange, regulator = (b + s) * Decimal("0.000030700"), (b + s) * Decimal("0.000001")
    tax, stamp = (s * Decimal("0.00025"), b * Decimal("0.00003")) if same else ((b + s) * Decimal("0.001"), b * Decimal("0.00015"))
    want = brokerage + exchange + regulator + tax + stamp + (brokerage + exchange + regulator) * Decimal("0.18") + (0 if same else Decimal("15.34"))
    df = spark.createDataFrame([(float(buy), float(sell), same)], "b double, s double, x boolean")
    assert abs(one(df.select(rule_plans.charges(F.col("b"), F.col("s"), F.col("x"))["total"].alias("t")))["t"] - float(want)) < 1e-9


def test_sizes(spark):
    df = spark.createDataFrame([(99_999.0,), (100_000.0,), (250.0,), (3.3,)], "price double")
    z = rule_plans.sized(F.col("price"))
    got = df.select("price", *[c.alias(k) for k, c in z.items()]).collect()
    assert [r["shares"] for r in got] == [2, 1, 400, 30_304]
    for r in got:
        assert r["long_exit"] >= r["price"] * (1 + r["required"]) - 1e-6 and r["short_exit"] <= r["price"] * (1 - r["required"]) + 1e-6
        assert abs(r["long_exit"] / 0.05 - round(r["long_exit"] / 0.05)) < 1e-6 and r["long_exit"] - r["price"] * (1 + r["required"]) < 0.05


def test_slippage(spark):
    levels = [[(100.0, 10.0), (101.0, 10.0)], [(100.0, 10.0)], []]
    df = spark.createDataFrame([(x,) for x in levels], "levels array<struct<price:double,qty:double>>")
    got = [r["s"] for r in df.select(rule_plans.slippage("levels", F.lit(99.5), 1_500).alias("s")).collect()]
    assert abs(got[0] - (1_505 / 15 - 99.5) / 99.5 * 1e4) < 1e-9 and got[1:] == [None, None]


def test_picks_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), i, int(a), int(a + n), float(r)) for i, (d, a, n, r) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 40, 300), rng.integers(1, 9, 300), rng.random(300).round(1), strict=True))]
    df = spark.createDataFrame(rows, "day int, key long, entry long, exit long, rank double")
    want, alone = set(), set()
    for day in range(4):
        held, last = [], -1
        for r in sorted((r for r in rows if r[0] == day), key=lambda r: (r[2], r[4], r[3], r[1])):
            held = [e for e in held if e >= r[2]]
            if len(held) < 3:
                held.append(r[3])
                want.add(r[1])
        for _, _, a, b, _ in sorted((r for r in rows if r[0] == day), key=lambda r: (r[2], r[3])):
            if a >= last:
                alone.add((day, a, b))
                last = b
    got = select_plans.within_capacity(df, ["day"], "entry", "rank", "exit", "key", 3)
    assert {r["key"] for r in got.collect()} == want and select_plans.within_capacity(df.limit(0), ["day"], "entry", "rank", "exit", "key").count() == 0
    assert {tuple(r) for r in select_plans.without_overlap(df, ["day"], "entry", "exit").collect()} == alone


def test_ranks_of_unknown_scores(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", None), (1, "d", 5.0), (None, "e", 1.0)], "day int, name string, score double")
    got = {r["name"]: r["r"] for r in df.select("name", select_plans.first_ranks(["day"], F.col("score"), "name").alias("r")).collect()}
    assert got == {"a": 2, "b": 3, "c": None, "d": 1, "e": 1}


def test_files(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text('start_time,open,high,low,close,volume\n2024-01-02T09:15:00+05:30,10.05,10.1,10,10.1,\n2024-01-02T09:16:00+05:30,10.1,x,10,10.1,5\nnever,1,1,1,1,1\n"2024-01-02T09:17:00+05:30", 9.5 ,9.5,9.5,9.5,7.5\n')
    got = files.minute_bars(files.text_csv(spark, str(path))).collect()
    assert [r["bad"] for r in got] == [None, "price", "time", "volume"] and got[0]["volume"] is None and got[0]["open"] == Decimal("10.0500")
    assert got[0]["start_time"] == dt.datetime(2024, 1, 2, 3, 45) and got[0]["end_time"] - got[0]["start_time"] == dt.timedelta(minutes=1)
    assert files.minute_bars(files.text_csv(spark, str(path)).limit(0)).count() == 0


def test_derivative_files(spark):
    day = dt.date(2024, 7, 8)
    names = ["day", "TradDt", "FinInstrmTp", "TckrSymb", "OptnTp", "XpryDt", "StrkPric", *files._NEW.values(), *files._NEW_WHOLE.values()]
    base = dict.fromkeys(names, "1") | {"day": day, "TradDt": "2024-07-08", "FinInstrmTp": "STO", "TckrSymb": " AB ", "OptnTp": "CE", "XpryDt": "2024-07-25"}
    rows = [base, base | {"TradDt": "2024-07-05"}, base | {"FinInstrmTp": "XXX"}, base | {"OptnTp": ""}, base | {"ClsPric": "1,5"}, base | {"OpnIntrst": "1.5"}, base | {"FinInstrmTp": "IDF", "OptnTp": None, "OpnIntrst": None}]
    got = files.derivatives_new(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'date' if n == 'day' else 'string'}" for n in names))).collect()
    assert [r["bad"] for r in got] == [None, "session", "kind", "option", "number", "whole", None]
    assert (got[0]["symbol"], got[0]["kind"], got[0]["underlying"], got[0]["strike"]) == ("AB", "O", "S", 1.0) and (got[6]["strike"], got[6]["oi"], got[6]["underlying"]) == (None, 0, "I")
    old = ["day", "TIMESTAMP", "INSTRUMENT", "SYMBOL", "OPTION_TYP", "EXPIRY_DT", "STRIKE_PR", *files._OLD.values(), "VAL_INLAKH", *files._OLD_WHOLE.values()]
    base = dict.fromkeys(old, "2") | {"day": day, "TIMESTAMP": "2024-07-08", "INSTRUMENT": "FUTSTK", "OPTION_TYP": "XX", "EXPIRY_DT": "2024-07-25"}
    r = one(files.derivatives_old(spark.createDataFrame([tuple(base[n] for n in old)], ", ".join(f"{n} {'date' if n == 'day' else 'string'}" for n in old))))
    assert (r["bad"], r["option"], r["value"], r["last"], r["lot"]) == (None, "", 200_000.0, None, 0)


def test_expiries(spark):
    sessions = [dt.date(1995, 11, 1) + dt.timedelta(days=i) for i in range(150)]
    closed = {dt.date(1995, 11, 30), dt.date(1995, 11, 29)}
    df = spark.createDataFrame([(d,) for d in sessions if d.weekday() < 5 and d not in closed], "d date")
    got = sorted((r["due"], r["expiry"]) for r in option_plans.monthly_expiries(df, "d").collect())
    day = lambda m, d, y=1996: dt.date(y, m, d)
    assert got == [(day(11, 30, 1995), day(11, 28, 1995)), (day(12, 28, 1995), day(12, 28, 1995)), (day(1, 30), day(1, 30)), (day(2, 27), day(2, 27)), (day(3, 26), day(3, 26))]


def test_symbol_chains(spark):
    changes = spark.createDataFrame([("C", "B", dt.date(2020, 1, 1)), ("B", "A", dt.date(2010, 1, 1)), ("X", "Y", dt.date(2015, 1, 1)), ("Y", "X", dt.date(2014, 1, 1))], "new string, old string, changed date")
    names = spark.createDataFrame([("C",), ("X",), ("Z",)], "symbol string")
    at = lambda d: {r["symbol"]: r["listed_as"] for r in study_plans.symbols_as_of(names, changes, F.lit(d).cast("date"), 6).collect()}
    assert at("2021-01-01") == {"C": "C", "X": "X", "Z": "Z"} and at("2015-06-01")["C"] == "B" and at("2005-01-01")["C"] == "A"


def test_carried_totals(spark):
    bars = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 2, 2, 5.0), ("a", 1, 3, 7.0)], "symbol string, contract int, day int, oi double")
    spine = spark.createDataFrame([("a", d) for d in (1, 2, 3)], "symbol string, day int")
    assert sorted(tuple(r) for r in option_plans.carried_total(bars, spine, "symbol", "contract", "day", "oi").collect()) == [("a", 1, None), ("a", 2, 15.0), ("a", 3, 12.0)]


def test_build_up(spark):
    rows = [(0.01, 0.05, "long_buildup"), (-0.01, 0.05, "short_buildup"), (0.01, -0.05, "short_covering"), (-0.01, -0.05, "long_unwinding"), (0.001, 0.5, "neutral"), (None, 0.5, None), (0.5, None, None)]
    df = spark.createDataFrame(rows, "p double, o double, want string")
    assert [r["got"] for r in df.select(option_plans.build_up(F.col("p"), F.col("o")).alias("got")).collect()] == [r[2] for r in rows]


def test_breakout_by_hand(spark):
    bars = [("a", "d", h, o, hi, lo, c) for h, o, hi, lo, c in [(0, 10.0, 11.0, 9.0, 10.0), (1, 10.0, 10.5, 9.5, 10.0), (3, 12.0, 13.0, 11.5, 12.5), (5, 8.0, 9.0, 7.5, 8.5), (20, 9.0, 9.5, 8.0, 9.0)]]
    df = spark.createDataFrame(bars, "symbol string, session string, hr int, open double, high double, low double, close double")
    got = {(r["side"], r["stop"]): (r["trigger"], r["price"], r["exit_hr"], round(r["gross"], 9)) for r in label_plans.breakouts(df).collect()}
    # Long: the cross opens at 12 over the top of 11; the stop at the bottom of 9 gaps to the open of 8.
    assert got[(1, "opposite")] == (3, 12.0, 5, round(8 / 12 - 1, 9)) and got[(1, "none")] == (3, 12.0, 20, -0.25)
    assert got[(-1, "none")] == (5, 8.0, 20, round(-(9 / 8 - 1), 9))


def test_staged_rows(spark):
    rows = [("a", "d", 3, 1.0, 2.0, 0.5, 1.5, 4.0), ("a", "d", 3, 1.0, 2.0, 0.5, 1.6, 4.0), ("a", "d", 4, 1.0, 2.0, 0.5, None, 4.0), ("a", "d", 5, 1.0, 1.2, 0.5, 1.5, 4.0), ("a", "d", 6, 1.0, 9.0, 0.5, 1.5, None), ("a", "d", 1, 1.0, 2.0, 0.5, 1.5, 4.0), ("b", "d", 3, 1.0, 2.0, 0.5, 1.5, 4.0), ("a", "d", 7, 1.0, 2.0, 0.5, 1.5, -1.0)]
    df = spark.createDataFrame(rows, "symbol string, session string, hr int, open double, high double, low double, close double, volume double")
    daily = spark.createDataFrame([("a", "d", 2.0, 0.5)], "symbol string, session string, d_high double, d_low double")
    got = sorted((r["symbol"], r["hr"], r["close"] or 0, r["fault"]) for r in audit_plans.staged(df, daily, 2, 20).collect())
    assert [g[3] for g in got] == ["outside", None, "twice", "price", "order", "range", "volume", "no_daily"]


def test_models_against_numpy(spark):
    """The boosted probability orders later rows; the logistic map equals one that Newton's steps find."""
    from tickloom.registry import QUERIES

    x = outcome_plans._features(spark, SF).select("event_id", "later", "y", "p", "features").toPandas()
    q = QUERIES["l1_boosted_probability"](spark, SF).toPandas().merge(x[["event_id", "y"]], on="event_id")
    early = q[~q.later]
    assert len(q) == len(x) and q.probability.between(0, 1).all()
    good, bad = early[early.y == 1].probability.to_numpy(), early[early.y == 0].probability.to_numpy()
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.55
    p = x.p.clip(1e-6, 1 - 1e-6)
    z, y = np.c_[np.ones(len(x)), np.log(p / (1 - p))], x.y.to_numpy(float)
    fit = ~x.later.to_numpy()
    w = np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-z[fit] @ w))
        w += np.linalg.solve((z[fit] * (m * (1 - m))[:, None]).T @ z[fit], z[fit].T @ (y[fit] - m))
    loss = lambda q, y: float(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
    got = {r["later"]: r["calibrated"] for r in QUERIES["l2_platt_calibration"](spark, SF).collect()}
    for later in (True, False):
        own = x.later.to_numpy() == later
        assert abs(got[later] - loss(1 / (1 + np.exp(-z[own] @ w)), y[own])) < 1e-4


def test_walk_forward_knows_nothing_later(spark):
    from tickloom.plans import model_plans

    df = model_plans.rows(spark, SF)
    base = {r["event_id"]: r["q"] for r in model_plans.walk_forward(df).where("period = 1").collect()}
    turned = df.withColumn("label", F.when(F.col("period") >= 1, 1 - F.col("label")).otherwise(F.col("label")))
    again = {r["event_id"]: r["q"] for r in model_plans.walk_forward(turned).where("period = 1").collect()}
    assert base and base == again and model_plans.walk_forward(df.limit(0)).count() == 0
    dealt = model_plans.shuffled(df, "p", "session", "event_id", "x")
    key = lambda d: sorted((r["session"], r["p"]) for r in d.collect())
    assert key(dealt) == key(df) and dealt.join(df.select("event_id", F.col("p").alias("was")), "event_id").where("p <> was").count() > 100


def test_feature_overlap(spark):
    from tickloom.registry import QUERIES
    from tickloom.sources.fixtures import view

    d = view(spark, SF, "daily").select(*[F.col(c).cast("double").alias(c) for c in ("open", "volume", "n", "idx", "symbol")]).toPandas()
    for r in QUERIES["d27_feature_overlap"](spark, SF).collect():
        own, others = d[r["feature"]].to_numpy(), d.drop(columns=r["feature"]).to_numpy()
        design = np.c_[np.ones(len(d)), others]
        rest = own - design @ np.linalg.lstsq(design, own, rcond=None)[0]
        assert abs(r["r2"] - (1 - rest.var() / own.var())) < 1e-5 and abs(r["correlation"] - d.corr().loc[r["feature"], r["partner"]]) < 1e-5
    f = view(spark, SF, "daily").where("idx % 2 = 0").select(*study_plans.FEATURES).toPandas().astype(float)
    rho = f.rank().corr()
    kept = [r for r in QUERIES["d21_pruned_features"](spark, SF).collect()]
    names = [r["feature"] for r in kept if r["kept"]]
    assert all(abs(rho.loc[a, b]) <= 0.9 for a in names for b in names if a != b)
    assert all(abs(rho.loc[r["feature"], r["duplicates"]] - r["spearman"]) < 1e-5 for r in kept if not r["kept"])


def test_prefix_sums_and_quantiles(spark):
    from tickloom.operators import windows

    rng = np.random.default_rng(7)
    v = np.unique(rng.normal(size=900).round(3))
    m = rng.integers(0, 5, len(v))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, m, strict=True)], "v double, m long").repartition(7)
    got = {r["v"]: r["before"] for r in windows.prefix_sums(df, "v", "m", "before", 16).collect()}
    assert [got[float(a)] for a in v] == (np.cumsum(m) - m).tolist()
    x = rng.choice(v, 501)
    rows = spark.createDataFrame([(float(a),) for a in x] + [(None,)], "x double")
    r = one(windows.quantiles(rows, "x", {"a": 0.005, "b": 0.5, "c": 0.9, "d": 1.0}))
    assert np.allclose([r["a"], r["b"], r["c"], r["d"]], np.quantile(x, [0.005, 0.5, 0.9, 1.0]))
    assert tuple(one(windows.quantiles(rows.limit(0), "x", {"a": 0.5}))) == (None,) and windows.prefix_sums(df.limit(0), "v", "m", "b").count() == 0
    assert tuple(one(windows.quantiles(rows.where("x is not null").limit(1), "x", {"a": 0.5, "b": 0.9}))) == (rows.where("x is not null").first()["x"],) * 2


def test_grouped_quantiles(spark):
    """A group of a million values beside small, constant, null and unknown ones."""
    from tickloom.operators.windows import grouped_quantiles

    big = spark.range(1_000_000).select(F.lit("big").alias("g"), F.lit(1).alias("h"), ((F.col("id") * 7919) % 1_000_003).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    rows = [("one", 1, 5.0, None), ("two", 1, 1.0, 3.0), ("two", 1, 4.0, None), ("two", 2, -1.0, 2.0), ("none", 1, None, None), (None, 1, 2.0, 1.0), (None, 1, 3.0, 1.0), (None, None, 9.0, 1.0)]
    df = big.unionByName(spark.createDataFrame(rows, "g string, h int, x double, y double")).repartition(6)
    wanted = {"a": ("x", 0.0), "b": ("x", 0.5), "c": ("x", 0.999), "d": ("y", 0.25), "e": ("y", 1.0)}
    got = {(r.g, r.h): [r[k] for k in wanted] for r in grouped_quantiles(df, ["g", "h"], wanted).collect()}
    want = {(r.g, r.h): [r[k] for k in wanted] for r in df.groupBy("g", "h").agg(*[F.percentile(c, q).alias(k) for k, (c, q) in wanted.items()]).collect()}
    close = lambda a, b: a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))
    assert len(got) == len(want) == 7 and all(close(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))
    assert grouped_quantiles(df.limit(0), ["g"], wanted).collect() == []


def test_asof_over_buckets(spark):
    from tickloom.operators.joins import asof_join

    rng = np.random.default_rng(6)
    at = lambda n: [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 8 * 1440, n)]
    left = [(k, t, i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200).tolist(), at(200), strict=True))] + [(None, dt.datetime(2024, 1, 3), 999), (9, dt.datetime(2024, 1, 3), 998)]
    right = [(k, t, i, float(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 25).tolist(), at(25), strict=True))]
    right += [(k, t, i + 100, v + 100) for k, t, i, v in right[:5]]
    got = {r["id"]: r["v"] for r in asof_join(spark.createDataFrame(left, "k int, at timestamp, id int"), spark.createDataFrame(right, "k int, at timestamp, seq int, v double"), ["k"], "at", ["v"], ["seq"]).collect()}
    for k, t, i in left:
        own = [r for r in right if r[0] == k and k is not None and r[1] <= t]
        assert got[i] == (max(own, key=lambda r: (r[1], r[2]))[3] if own else None)
