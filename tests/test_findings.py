"""Inputs on which queries failed, or gave other rows than their SQL: zero prices, rows at thresholds, runs longer than any limit."""

import duckdb
import pytest

from tests.test_market_queries import SF, rows
from tickloom.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def with_tables(folder, **changed):
    """A folder with the tables at the smallest scale, some replaced by what a SELECT over them gives; and a connection that sees it."""
    c = duckdb.connect()
    for t in TABLES:
        sql = changed.get(t, "select * from {}").format(f"'{SF}/{t}.parquet'")
        c.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


def same(spark, folder, con, name):
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(con.execute(ORACLES[name]).df())


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events, four times as dense, of which some are worth nothing, whole hours too."""
    return with_tables(tmp_path_factory.mktemp("zeros"), events="select * replace (case when event_id % 5 = 0 or date_part('hour', ts) = 7 then 0.0 else value end as value, timestamp '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 4) as ts) from {}")


@pytest.mark.parametrize("name", ["c17_exclusions", "c21_matched_selection", "e25_stock_inputs", "j13_slot_accounting"])
def test_zero_prices(spark, zeros, name):
    same(spark, *zeros, name)


def test_opportunity_at_minute_zero_or_without_volatility(spark):
    """Rows that have a reason divide by nothing; others don't change."""
    from pyspark.sql import functions as F

    from tickloom.plans.rule_plans import _NEEDED, opportunity

    d = spark.createDataFrame([(0.0, 1.0), (10.0, 0.0), (10.0, 1.0)], "minutes double, atr14 double")
    other = {*_NEEDED, "close", "price_vs_vwap_sigma", "from_open", "in_range", "opening_range_high", "opening_range_low", "volume_ratio_20"} - {"atr14"}
    d = d.select("*", *[(F.col("atr14") / 100 if c == "atr_pct" else F.lit(1.0)).alias(c) for c in sorted(other)])
    reason, parts, reach, score = opportunity()
    got = d.select("minutes", "atr14", reason.alias("reason"), parts.alias("c"), reach.alias("reach"), score.alias("score")).collect()
    assert [r["reason"] for r in got] == ["outside_window", "no_volatility", None]
    assert [r["score"] == 0 for r in got] == [True, True, False]


def test_stop_at_its_very_price(spark, tmp_path):
    """A low of exactly a tenth of the entry is a stop: shares of the price are decimals."""
    events = "select * from (values (1, timestamp '2024-01-01 00:10:00', 1, 'click', 50.0::double, ''), (2, timestamp '2024-01-01 01:10:00', 1, 'click', 10.0::double, ''), (3, timestamp '2024-01-01 02:10:00', 1, 'click', 1.0::double, '')) t(event_id, ts, user_id, event_type, value, props)"
    folder, con = with_tables(tmp_path, events=events)
    assert con.execute(ORACLES["g7_bracket_over_sessions"]).df()["reason"].tolist().count("sl_gap") == 1
    same(spark, folder, con, "g7_bracket_over_sessions")


def test_unreadable_price_and_session(spark, tmp_path):
    """A row with neither a price nor a session (the 1147th multiple) counts as unreadable."""
    same(spark, *with_tables(tmp_path, lineitem="select * replace (timestamp '1995-03-01' as l_shipdate) from {} limit 1147", supplier="select * replace (0 as s_nationkey) from {}"), "j18_cash_self_check")


def test_quantiles_whatever_the_cuts(spark, monkeypatch):
    """Approximate quantiles that come out otherwise each time they are taken give the same exact ones."""
    import random

    from pyspark.sql import functions as F

    from tickloom.operators import windows
    from tickloom.plans.study_plans import average_ranks

    taken = F.percentile_approx
    moved = F.udf(lambda cuts: sorted(c + random.uniform(-40, 40) for c in cuts), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda c, *a: moved(taken(c, *a)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        d = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
        for _ in range(3):
            assert {r["g"]: r["m"] for r in windows.grouped_quantiles(d, ["g"], {"m": ("v", 0.5)}).collect()} == {0: 499.0, 1: 500.0}
            assert windows.quantiles(d, "v", {"m": 0.5}).first()["m"] == 499.5
            assert all(r["rank"] == r["v"] + 1 for r in average_ranks(d, ("v",)).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def one_day(tmp_path_factory):
    """All orders of one customer, on one of two days."""
    return with_tables(tmp_path_factory.mktemp("day"), orders="select * replace (7 as o_custkey, timestamp '1995-03-01' + to_days(cast(o_orderkey % 2 * 30 as int)) as o_orderdate) from {}")


def test_meetings_of_one_day(spark, one_day):
    """Counts come from running sums, not from pairs of trades and meetings."""
    same(spark, *one_day, "c6_known_meetings")
    assert "sequence(" not in plan_of(QUERIES["c6_known_meetings"](spark, one_day[0]))


def test_draws_order_few_rows(spark):
    """Only rows of the head of keys that a draw ends in are ordered."""
    assert "substring(" in plan_of(QUERIES["h16_breakout_summary"](spark, SF))


def test_segments_read_their_rows_once(spark):
    """What follows the numbering reads its rows at rest, not the given tables again."""
    assert "lineitem" not in plan_of(QUERIES["e38_factor_segments"](spark, SF))


def test_long_joined_parts(monkeypatch):
    """Joined parts above the limit of single scores are found by the search, all and with the same scores."""
    import random

    from tickloom.llm import secret_scan

    draw = random.Random(5)
    part = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    value = lambda: ".".join(part(8) for _ in range(40))
    text = lambda k: ".".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9))) for _ in range(k))
    model = secret_scan.FormatModel({"assign": [value()[:251] for _ in range(60)], "hex": [".".join(part(6) for _ in range(5)) for _ in range(60)]}, [text(2000)])
    runs = [text(draw.randint(1, 12)) + draw.choice("./=") + draw.choice([value(), value()[: draw.randint(1, 300)], ".".join(part(6) for _ in range(5))]) + draw.choice(["", ".", "/" + text(9), "=" + value()]) for _ in range(12)]
    for limit in (1, 30):
        monkeypatch.setattr(secret_scan, "LONGEST", 10**9)
        want = [secret_scan.inferred(r, model) for r in runs]
        monkeypatch.setattr(secret_scan, "LONGEST", limit)
        assert any(want) and [secret_scan.inferred(r, model) for r in runs] == want
