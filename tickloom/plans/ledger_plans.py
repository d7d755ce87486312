"""Costs, ledgers and ranked selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators.windows import grouped_quantiles, over
from tickloom.plans.feature_plans import r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

#: Fixed values of the intraday charge schedule: fractions of one leg's turnover, and the cap per leg.
BROKERAGE, CAP, TAX, EXCHANGE, REGULATOR, STAMP, GST = 0.0003, 20.0, 0.00025, 0.0000307, 0.000001, 0.00003, 0.18


def round_trip(n):
    """Charges of both legs of notional n."""
    brokerage = 2 * F.least(F.lit(CAP), n * BROKERAGE)
    exchange, regulator = 2 * n * EXCHANGE, 2 * n * REGULATOR
    return {"brokerage": brokerage, "tax": n * TAX, "exchange": exchange, "regulator": regulator, "stamp": n * STAMP, "gst": (brokerage + exchange + regulator) * GST}


_COST = f"""c as (select *, 2 * least({CAP}, entry_value * {BROKERAGE}) as brokerage, entry_value * {TAX} as tax, 2 * entry_value * {EXCHANGE} as exchange, 2 * entry_value * {REGULATOR} as regulator, entry_value * {STAMP} as stamp from x8),
 k as (select *, (brokerage + exchange + regulator) * {GST} as gst from c), n as (select *, brokerage + tax + exchange + regulator + stamp + gst as cost, gross - (brokerage + tax + exchange + regulator + stamp + gst) as net from k)"""


def ledger(spark, sf):
    x = view(spark, sf, "x8")
    parts = round_trip(F.col("entry_value"))
    total = sum(parts.values(), F.lit(0.0))
    return x.select("*", *[v.alias(k) for k, v in parts.items()], total.alias("cost"), (F.col("gross") - total).alias("net"))


@query(duck(f"with {_COST} select trade_id, round(brokerage, 5) as brokerage, round(gst, 6) as gst, round(cost, 5) as cost, round(net, 4) as net, round(cost / entry_value + 0.001, 9) as required_fraction from n"))
def h1_round_trip_costs(spark, sf):
    return ledger(spark, sf).select("trade_id", F.round("brokerage", 5).alias("brokerage"), r6("gst").alias("gst"), F.round("cost", 5).alias("cost"), F.round("net", 4).alias("net"), F.round(F.col("cost") / F.col("entry_value") + 0.001, 9).alias("required_fraction"))


@query(duck(f"""with {_COST} select side, rule, count(*) as trades, round(sum(net), 2) as net, round(sum(gross), 2) as gross, round(sum(cost), 2) as cost, round(sum(entry_value), 2) as turnover,
 round(avg(case when net > 0 then 1.0 else 0 end), 6) as hit_rate, round(sum(net) / count(distinct session), 4) as per_session from n group by grouping sets ((side, rule), (side))"""))
def h5_ledger_summary(spark, sf):
    n = ledger(spark, sf)
    aggs = [F.count("*").alias("trades"), F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("gross"), 2).alias("gross"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.sum("entry_value"), 2).alias("turnover"),
            r6(F.avg((F.col("net") > 0).cast("double"))).alias("hit_rate"), F.round(F.sum("net") / F.countDistinct("session"), 4).alias("per_session")]
    return n.rollup("side", "rule").agg(*aggs).where("side is not null")


_DAILY = """d as (select session, sum(net) as pnl from n group by session), e as (select *, sum(pnl) over (order by session) as cum from d), m as (select *, greatest(0, max(cum) over (order by session)) as peak from e)"""


@query(duck(f"with {_COST}, {_DAILY} select cast(cast(session as timestamp) as varchar) as session, round(pnl, 2) as pnl, round(cum, 2) as cumulative, round(peak - cum, 2) as drawdown from m"))
def h6_drawdown_curve(spark, sf):
    """Pre-aggregated to one row a session, of which there are a few thousand; the running sum is over those."""
    d = ledger(spark, sf).groupBy("session").agg(F.sum("net").alias("pnl"))
    w = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    e = d.withColumn("cum", F.sum("pnl").over(w))
    e = e.withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(w)))
    return e.select(F.col("session").cast("timestamp").cast("string").alias("session"), F.round("pnl", 2).alias("pnl"), F.round("cum", 2).alias("cumulative"), F.round(F.col("peak") - F.col("cum"), 2).alias("drawdown"))


@query(duck(f"""with {_COST}, d as (select session, sum(net) as pnl from n group by session) select cast(extract(year from session) as int) as year, cast(extract(quarter from session) as int) as quarter, count(*) as sessions,
 round(avg(pnl), 4) as mean, round(avg(pnl) / (stddev_samp(pnl) / sqrt(count(*))), 5) as t, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) as sharpe, round(avg(case when pnl > 0 then 1.0 else 0 end), 6) as positive, round(min(pnl), 2) as worst from d group by 1, 2"""))
def h9_session_statistics(spark, sf):
    d = ledger(spark, sf).groupBy("session").agg(F.sum("net").alias("pnl"))
    m, s = F.avg("pnl"), F.stddev_samp("pnl")
    return d.groupBy(F.year("session").alias("year"), F.quarter("session").alias("quarter")).agg(
        F.count("*").alias("sessions"), F.round(m, 4).alias("mean"), F.round(m / (s / F.sqrt(F.count("*"))), 5).alias("t"), F.round(m / s * F.sqrt(F.lit(252)), 5).alias("sharpe"),
        r6(F.avg((F.col("pnl") > 0).cast("double"))).alias("positive"), F.round(F.min("pnl"), 2).alias("worst"))


@query(duck("""with r as (select symbol, idx, close / lag(close) over (partition by symbol order by idx) - 1 as ret from daily), c as (select symbol, idx, ret, exp(sum(ln(1 + ret)) over (partition by symbol order by idx)) as curve from r where ret is not null),
 p as (select *, greatest(1, max(curve) over (partition by symbol order by idx)) as peak from c)
 select symbol, count(*) as n, round(power(max_by(curve, idx), 12.0 / count(*)) - 1, 6) as cagr, round(stddev_samp(ret) * sqrt(12), 6) as volatility, round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) as sharpe, round(max(1 - curve / peak), 6) as drawdown from p group by symbol"""))
def h10_return_statistics(spark, sf):
    w = Window.partitionBy("symbol").orderBy("idx")
    r = view(spark, sf, "daily").withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).where("ret is not null")
    run = over(["symbol"], ["idx"])
    c = r.withColumn("curve", F.exp(F.sum(F.log1p("ret")).over(run)))
    c = c.withColumn("peak", F.greatest(F.lit(1.0), F.max("curve").over(run)))
    return c.groupBy("symbol").agg(F.count("*").alias("n"), r6(F.max_by("curve", "idx") ** (12.0 / F.count("*")) - 1).alias("cagr"), r6(F.stddev_samp("ret") * F.sqrt(F.lit(12))).alias("volatility"),
                                   r6(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(12))).alias("sharpe"), r6(F.max(1 - F.col("curve") / F.col("peak"))).alias("drawdown"))


@query(duck(f"""with {_COST}, b as (select avg(case when net > 0 then 1.0 else 0 end) as base, count(*) filter (where net > 0) as won from n)
 select rule, round(count(*) / count(distinct session)::double, 6) as per_day, round(avg(case when net > 0 then 1.0 else 0 end), 6) as precision_, round(avg(case when net > 0 then 1.0 else 0 end) / any_value(base), 6) as lift,
 round(count(*) filter (where net > 0) / any_value(won)::double, 6) as recall from n, b group by rule"""))
def h12_rule_scorecard(spark, sf):
    n = ledger(spark, sf).withColumn("win", (F.col("net") > 0).cast("double"))
    base = n.agg(F.avg("win").alias("base"), F.sum("win").alias("won"))
    g = n.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("session").alias("d"), F.avg("win").alias("p"), F.sum("win").alias("w"))
    return g.crossJoin(F.broadcast(base)).select("rule", r6(F.col("n") / F.col("d")).alias("per_day"), r6("p").alias("precision_"), r6(F.col("p") / F.col("base")).alias("lift"), r6(F.col("w") / F.col("won")).alias("recall"))


@query(duck("""with c as (select *, cast(extract(month from session) as int) as month, cast(round(gross * 10000) as bigint) as units from x8)
 select symbol, month, count(*) as n, quantile_cont(units, 0.5)::double / 10000 as median, min(units) / 10000 as low, max(units) / 10000 as high, sum(units)::double / count(*) / 10000 as mean from c group by 1, 2"""))
def h13_distribution(spark, sf):
    """Median, extremes and mean of gross results, counted in whole ten-thousandths."""
    c = view(spark, sf, "x8").select("symbol", F.month("session").alias("month"), F.round(F.col("gross") * 10000).cast("bigint").alias("units"))
    money = lambda c: c.cast("double") / 10000
    q = grouped_quantiles(c, ["symbol", "month"], {"median": ("units", 0.5)})
    g = c.groupBy("symbol", "month").agg(F.count("*").alias("n"), money(F.min("units")).alias("low"), money(F.max("units")).alias("high"), (F.sum("units").cast("double") / F.count("*") / 10000).alias("mean"))
    return g.join(q, ["symbol", "month"]).withColumn("median", F.col("median") / 10000)


@query(duck("""with k as (select *, row_number() over (partition by session order by abs(gross / entry_value) desc, symbol, trade_id) as place, count(*) over (partition by session) as n from x8)
 select trade_id, cast(place as int) as place, n > 3 as truncated from k where place <= 3"""))
def f8_top_per_cycle(spark, sf):
    s = Window.partitionBy("session")
    k = view(spark, sf, "x8").withColumn("n", F.count("*").over(s))
    k = k.withColumn("place", F.row_number().over(s.orderBy(F.abs(F.col("gross") / F.col("entry_value")).desc(), "symbol", "trade_id")))
    return k.where("place <= 3").select("trade_id", "place", (F.col("n") > 3).alias("truncated"))


@query(duck("""with s as (select symbol, session, side, gross / entry_value as score, rule from x8) select symbol, cast(cast(session as timestamp) as varchar) as session, side, round(max(score), 9) as score,
 array_to_string(list_sort(list(distinct rule)), ',') as rules from s group by 1, 2, 3"""))
def f7_combined_signals(spark, sf):
    s = view(spark, sf, "x8").withColumn("score", F.col("gross") / F.col("entry_value"))
    return s.groupBy("symbol", F.col("session").cast("timestamp").cast("string").alias("session"), "side").agg(F.round(F.max("score"), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))


@query(duck("""with t as (select symbol, session as a, session + interval 5 day as b from x8), e as (select symbol, a as t0, 1 as step from t union all select symbol, b, -1 from t), g as (select symbol, t0, sum(step) as step from e group by 1, 2),
 r as (select *, sum(step) over (partition by symbol order by t0) as open_ from g) select symbol, cast(max(open_) as bigint) as peak, round(avg(open_), 6) as mean from r group by symbol"""))
def f19_concurrency(spark, sf):
    t = view(spark, sf, "x8").select("symbol", F.col("session").cast("timestamp").alias("a"))
    e = t.select("symbol", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("step")), F.struct(F.expr("a + interval 5 days").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("symbol", "e.*")
    g = e.groupBy("symbol", "at").agg(F.sum("step").alias("step"))
    r = g.withColumn("open_", F.sum("step").over(over(["symbol"], ["at"])))
    return r.groupBy("symbol").agg(F.max("open_").alias("peak"), r6(F.avg("open_")).alias("mean"))


@query(duck("""with a as (select distinct symbol, session from x8 where side = 'LONG'), b as (select distinct symbol, session from x8 where gross > 0)
 select 'left' as side, count(*) as n from (select * from a except select * from b) union all select 'right', count(*) from (select * from b except select * from a) union all select 'both', count(*) from (select * from a intersect select * from b)"""))
def f21_set_comparison(spark, sf):
    x = view(spark, sf, "x8")
    a, b = x.where("side = 'LONG'").select("symbol", "session").distinct(), x.where("gross > 0").select("symbol", "session").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count(a.exceptAll(b), "left").union(count(b.exceptAll(a), "right")).union(count(a.intersect(b), "both"))


@query(duck("""with p as (select symbol, session, sum(gross) as g, count(*) as n from x8 group by symbol, session), s as (select symbol, max(session) as last_, sum(n) as total from p group by symbol),
 j as (select x.symbol, x.series, x.market_cap, s.total from x9 x left join s on x.symbol = s.symbol)
 select symbol, case when market_cap < 0 then 'blocked' when total is null then 'stale' when total > 250 then 'limit' when series = 'BUILDING' then 'cooldown' end as reason from j"""))
def b25_suppression(spark, sf):
    totals = view(spark, sf, "x8").groupBy("symbol").agg(F.count("*").alias("total"))
    j = view(spark, sf, "x9").join(totals, "symbol", "left")
    reason = F.when(F.col("market_cap") < 0, "blocked").when(F.col("total").isNull(), "stale").when(F.col("total") > 250, "limit").when(F.col("series") == "BUILDING", "cooldown")
    return j.select("symbol", reason.alias("reason"))
