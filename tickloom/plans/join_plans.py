"""Joins in time and forward outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import divide
from tickloom.operators.joins import asof_join, first_touch, forward_window, interval_join, neighbour
from tickloom.plans.feature_plans import DAILY, DAY, KEY, daily_keyed, keyed, r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view


@query(duck(f"""select {DAILY}, case when lag(idx) over w = idx - 1 then lag(close) over w end as previous_close, case when lead(idx) over w = idx + 1 then lead(close) over w end as next_close
 from daily window w as (partition by symbol order by idx)"""))
def c1_neighbour_session(spark, sf):
    d = neighbour(view(spark, sf, "daily"), "symbol", "idx", ["close"], -1, "_before")
    return daily_keyed(neighbour(d, "symbol", "idx", ["close"], 1, "_after"), F.col("close_before").alias("previous_close"), F.col("close_after").alias("next_close"))


@query(duck(f"""with t as (select *, lead(open) over w as no, lead(close) over w as nc, lead(idx) over w as ni, lead(n) over w as nn from daily window w as (partition by symbol order by idx)),
 o as (select *, nc / no - 1 as oc, nc / close - 1 as cc, no / close - 1 as gap from t where ni = idx + 1 and nn % 11 <> 0)
 select {DAILY}, round(oc, 6) as open_close, round(cc, 6) as close_close, round(gap, 6) as gap, round(oc - avg(oc) over (partition by session), 6) as excess from o"""))
def c2_next_session_targets(spark, sf):
    d = neighbour(view(spark, sf, "daily"), "symbol", "idx", ["open", "close", "n"], 1, "_next").where("open_next is not null and n_next % 11 <> 0")
    d = d.select("*", (F.col("close_next") / F.col("open_next") - 1).alias("oc"), (F.col("close_next") / F.col("close") - 1).alias("cc"), (F.col("open_next") / F.col("close") - 1).alias("g"))
    market = d.groupBy("session").agg(F.avg("oc").alias("mkt"))
    return daily_keyed(d.join(market, "session"), r6("oc").alias("open_close"), r6("cc").alias("close_close"), r6("g").alias("gap"), r6(F.col("oc") - F.col("mkt")).alias("excess"))


@query(duck("""with e as (select symbol, ts, seq, price from x1 where price > 100), k as (select symbol, ts, price, row_number() over (partition by symbol, ts order by seq desc) as rn from e)
 select b.symbol, cast(b.bar_start as varchar) as bar_start, k.price as last_high_price, cast(k.ts as varchar) as seen_at
 from bars b asof left join (select * from k where rn = 1) k on b.symbol = k.symbol and b.bar_start >= k.ts"""))
def c3_asof_snapshot(spark, sf):
    ticks = view(spark, sf, "x1").where("price > 100").select("symbol", F.col("ts").cast("timestamp").alias("at"), "seq", "price").withColumn("seen", F.col("at"))
    bars = view(spark, sf, "bars").select("symbol", F.col("bar_start").cast("timestamp").alias("at"), "close")
    out = asof_join(bars, ticks, ["symbol"], "at", ["price", "seen"], ["seq"])
    return out.select("symbol", F.col("at").cast("string").alias("bar_start"), F.col("price").alias("last_high_price"), F.col("seen").cast("string").alias("seen_at"))


@query(duck("""with d as (select trade_id, symbol, cast(session as timestamp) as until_, cast(session as timestamp) - interval 40 day as after_ from x8),
 e as (select o_custkey % 50 as symbol, o_orderkey as filing_id, cast(o_orderdate as timestamp) as at from orders where o_orderstatus = 'F')
 select trade_id, count(*) as filings, min(filing_id) as first_filing from d join e on d.symbol = e.symbol and e.at > d.after_ and e.at <= d.until_ group by trade_id"""))
def c5_interval_filings(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    trades = view(spark, sf, "x8").select("trade_id", "symbol", F.col("session").cast("timestamp").alias("until"))
    trades = trades.withColumn("after", F.expr("until - interval 40 days"))
    filings = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'F'").select((F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderkey").alias("filing_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    # One row a symbol and day before the join, so that a trade meets forty at most.
    daily = filings.groupBy("symbol", "at").agg(F.count("*").alias("n"), F.min("filing_id").alias("filing_id"))
    found = interval_join(trades, daily, "symbol", "after", "until", "at", 40 * 86400)
    return found.groupBy("trade_id").agg(F.sum("n").alias("filings"), F.min("filing_id").alias("first_filing"))


@query(duck("""with t as (select symbol, subject, disseminated_at, filing_id, row_number() over (partition by symbol order by disseminated_at desc, filing_id desc) as rn from x6),
 c as (select symbol, count(*) as n, count(*) filter (where subject in ('purchase', 'error')) as material, count(distinct subject) as kinds from x6 group by symbol)
 select c.symbol, n, material, kinds, string_agg(cast(filing_id as varchar), ',' order by rn) as latest from c join t using (symbol) where rn <= 5 group by c.symbol, n, material, kinds"""))
def c8_filing_context(spark, sf):
    f = view(spark, sf, "x6")
    counts = f.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("subject").isin("purchase", "error")).alias("material"), F.countDistinct("subject").alias("kinds"))
    w = Window.partitionBy("symbol").orderBy(F.col("disseminated_at").desc(), F.col("filing_id").desc())
    top = f.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    top = top.groupBy("symbol").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "filing_id"))), lambda x: x["filing_id"].cast("string")), ",").alias("latest"))
    return counts.join(top, "symbol")


@query(duck(f"""with m as (select bar_start, avg(close / open - 1) as mkt, count(*) as n from bars group by bar_start)
 select {KEY}, round(close / open - 1, 6) as own, round(mkt, 6) as market, round(close / open - 1 - mkt, 6) as relative from bars join m using (bar_start)"""))
def c10_market_context(spark, sf):
    bars = view(spark, sf, "bars").withColumn("own_", F.col("close") / F.col("open") - 1)
    j = bars.join(bars.groupBy("bar_start").agg(F.avg("own_").alias("mkt")), "bar_start")
    return keyed(j, r6("own_").alias("own"), r6("mkt").alias("market"), r6(F.col("own_") - F.col("mkt")).alias("relative"))


@query(duck("""select coalesce(a.symbol, b.symbol) as symbol, cast(coalesce(a.bar_start, b.bar_start) as varchar) as bar_start,
 case when b.symbol is null then 'only_left' when a.symbol is null then 'only_right' when abs(a.close - b.close) > 0.000001 then 'different' else 'same' end as verdict,
 case when abs(a.close - b.close) > 0.000001 then 'close' else '' end as fields from bars a full join feed b on a.symbol = b.symbol and a.bar_start = b.bar_start"""))
def c11_feed_comparison(spark, sf):
    a, b = view(spark, sf, "bars"), view(spark, sf, "feed")
    names = ["open", "high", "low", "close"]
    both = a.select("symbol", "bar_start", F.struct(*names).alias("l")).join(b.select("symbol", "bar_start", F.struct(*names).alias("r")), ["symbol", "bar_start"], "full_outer")
    apart = F.array_compact(F.array(*[F.when(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) > 1e-6, F.lit(c)) for c in names]))
    verdict = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(F.size(apart) > 0, "different").otherwise("same")
    return both.select("symbol", F.col("bar_start").cast("string").alias("bar_start"), verdict.alias("verdict"), F.array_join(apart, ",").alias("fields"))


@query(duck("""with o as (select cast(unnest([-1, 0, 1]) as int) as shift), j as (select o.shift, a.symbol, abs(a.close - b.close) as gap from bars a cross join o
   join feed b on a.symbol = b.symbol and b.bar_start = a.bar_start + o.shift * interval 1 hour)
 select shift, symbol, count(*) as n, round(avg(gap), 6) as mean_gap, count(*) filter (where gap < 0.011) as agree from j group by shift, symbol"""))
def c12_clock_offset(spark, sf):
    a, b = view(spark, sf, "bars"), view(spark, sf, "feed").select("symbol", F.col("bar_start").cast("timestamp").alias("at"), F.col("close").alias("other"))
    shifted = a.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    shifted = shifted.withColumn("at", F.timestamp_seconds(F.unix_timestamp(F.col("bar_start").cast("timestamp")) + 3600 * F.col("shift")))
    gap = F.abs(F.col("close") - F.col("other"))
    return shifted.join(b, ["symbol", "at"]).groupBy("shift", "symbol").agg(F.count("*").alias("n"), r6(F.avg(gap)).alias("mean_gap"), F.count_if(gap < 0.011).alias("agree"))


@query(duck("""with j as (select a.symbol, a.close as x, b.close as y, abs(a.close / b.close - 1) * 10000 as bps from bars a join feed b on a.symbol = b.symbol and a.bar_start = b.bar_start)
 select symbol, round(median(x / y), 8) as factor, count(*) filter (where bps <= 1) as within_1, count(*) filter (where bps <= 20) as within_20, count(*) filter (where bps > 1000) as severe, count(*) as n from j group by symbol"""))
def c13_feed_agreement(spark, sf):
    j = view(spark, sf, "bars").join(view(spark, sf, "feed").select("symbol", "bar_start", F.col("close").alias("y")), ["symbol", "bar_start"])
    bps = F.abs(F.col("close") / F.col("y") - 1) * 10000
    return j.groupBy("symbol").agg(F.round(F.median(F.col("close") / F.col("y")), 8).alias("factor"), F.count_if(bps <= 1).alias("within_1"), F.count_if(bps <= 20).alias("within_20"), F.count_if(bps > 1000).alias("severe"), F.count("*").alias("n"))


@query(duck(f"""with bad as (select distinct symbol, session from bars where high / low > 1000) select {KEY}, close from bars b
 where not exists (select 1 from bad where bad.symbol = b.symbol and bad.session = b.session) and exists (select 1 from bars c where c.symbol = b.symbol and c.n_ticks > 3)"""))
def c17_exclusions(spark, sf):
    bars = view(spark, sf, "bars")
    bad, seen = bars.where(divide(F.col("high"), F.col("low")) > 1000).select(*DAY).distinct(), bars.where("n_ticks > 3").select("symbol").distinct()
    return keyed(bars.join(bad, DAY, "left_anti").join(seen, "symbol", "left_semi"), "close")


@query(duck("""with t as (select rule, symbol, avg(gross) as g from x8 group by rule, symbol), o as (select symbol, max_by(side, trade_id) as tag from x8 where trade_id % 3 = 0 group by symbol)
 select coalesce(o.tag, 'no_data') as tag, rule, count(*) as n, round(avg(g), 4) as mean_gross from t left join o on t.symbol = o.symbol + 10 group by 1, 2"""))
def c20_trades_by_component(spark, sf):
    x = view(spark, sf, "x8")
    t = x.groupBy("rule", "symbol").agg(F.avg("gross").alias("g"))
    tags = x.where("trade_id % 3 = 0").groupBy((F.col("symbol") + 10).alias("symbol")).agg(F.max_by("side", "trade_id").alias("tag"))
    return t.join(tags, "symbol", "left").groupBy(F.coalesce("tag", F.lit("no_data")).alias("tag"), "rule").agg(F.count("*").alias("n"), F.round(F.avg("g"), 4).alias("mean_gross"))


@query(duck("""with f as (select *, (close / open - 1) as a, (high / low) as b, close > open as fires from bars), k as (select *, sum(case when fires then 1 else 0 end) over (partition by bar_start) as quota,
 row_number() over (partition by bar_start order by a desc, symbol) as ra, row_number() over (partition by bar_start order by b desc, symbol) as rb from f)
 select symbol, cast(bar_start as varchar) as bar_start, fires, ra <= quota as by_change, rb <= quota as by_range from k where fires or ra <= quota or rb <= quota"""))
def c21_matched_selection(spark, sf):
    f = view(spark, sf, "bars").select("*", (divide(F.col("close"), F.col("open")) - 1).alias("a"), divide(F.col("high"), F.col("low")).alias("b"), (F.col("close") > F.col("open")).alias("fires"))
    at = Window.partitionBy("bar_start")
    quota = F.sum(F.col("fires").cast("int")).over(at)
    best = lambda c: F.row_number().over(at.orderBy(F.col(c).desc(), "symbol")) <= quota
    k = f.select("symbol", F.col("bar_start").cast("string").alias("bar_start"), "fires", best("a").alias("by_change"), best("b").alias("by_range"))
    return k.where("fires or by_change or by_range")


_AHEAD = """a as (select *, row_number() over (partition by symbol, session order by hr) as i from bars),
 j as (select a.symbol, a.session, a.hr, a.close, b.hr as step, b.open as bo, b.high as bh, b.low as bl, b.close as bc, b.i - a.i as k
   from a left join a b on a.symbol = b.symbol and a.session = b.session and b.i > a.i and b.i <= a.i + 4)"""


@query(duck(f"""with {_AHEAD} select {KEY}, cast(min(step) filter (where bh >= close * 1.5) as double) as up_step, cast(min(step) filter (where bl <= close * 0.5) as double) as down_step,
 round(max(bh) / close - 1, 6) as best, round(min(bl) / close - 1, 6) as worst, round(max_by(bc, step) / close - 1, 6) as last_return from j group by symbol, session, hr, close"""))
def g1_touch_labels(spark, sf):
    t = first_touch(forward_window(view(spark, sf, "bars"), DAY, "hr", 4), 0.5, 0.5)
    return keyed(t, F.col("up_step").cast("double").alias("up_step"), F.col("down_step").cast("double").alias("down_step"), r6("best").alias("best"), r6("worst").alias("worst"), r6("last_return").alias("last_return"))


@query(duck(f"""with {_AHEAD} select {KEY}, case when count(step) < 4 or max(step) <> hr + 4 then null else coalesce(bool_or(bh >= close * 1.5), false) end as touched from j group by symbol, session, hr, close"""))
def g2_touch_by_deadline(spark, sf):
    t = forward_window(view(spark, sf, "bars"), DAY, "hr", 4)
    whole = (F.size("ahead") == 4) & (F.element_at(F.col("ahead.step"), -1) == F.col("hr") + 4)
    return keyed(t, F.when(whole, F.exists("ahead", lambda a: a["high"] >= F.col("close") * 1.5)).alias("touched"))


@query(duck(f"""with {_AHEAD} select {KEY}, case when min(step) filter (where bh >= close * 1.5) < coalesce(min(step) filter (where bl <= close * 0.5), 99) then 'up'
 when min(step) filter (where bl <= close * 0.5) < coalesce(min(step) filter (where bh >= close * 1.5), 99) then 'down'
 when min(step) filter (where bh >= close * 1.5) is null then 'none'
 when min_by(bo, step) filter (where bh >= close * 1.5) >= close * 1.5 then 'up' when min_by(bo, step) filter (where bh >= close * 1.5) <= close * 0.5 then 'down' else 'unknown' end as outcome
 from j group by symbol, session, hr, close"""))
def g4_barrier_order(spark, sf):
    t = first_touch(forward_window(view(spark, sf, "bars"), DAY, "hr", 4), 0.5, 0.5)
    at = F.when(F.col("up_step").isNotNull(), F.element_at(F.filter("ahead", lambda a: a["step"] == F.col("up_step")), 1)["open"])
    none = F.lit(99)
    up, down = F.coalesce("up_step", none), F.coalesce("down_step", none)
    return keyed(t, F.when(up < down, "up").when(down < up, "down").when(F.col("up_step").isNull(), "none").when(at >= F.col("close") * 1.5, "up").when(at <= F.col("close") * 0.5, "down").otherwise("unknown").alias("outcome"))


@query(duck(f"""with {_AHEAD}, g as (select cast(unnest([1.1, 1.5, 2.0]) as double) as tp), s as (select cast(unnest([0.9, 0.5]) as double) as sl),
 t as (select g.tp, s.sl, j.symbol, session, hr, close, coalesce(min(step) filter (where bh >= close * tp), 99) as u, coalesce(min(step) filter (where bl <= close * sl), 99) as d, max_by(bc, step) as lc
   from j, g, s group by 1, 2, 3, 4, 5, 6)
 select tp, sl, count(*) as n, count(*) filter (where u < d) as wins, count(*) filter (where d <= u and d < 99) as losses,
 round(avg(case when u < d then tp - 1 when d < 99 then sl - 1 else lc / close - 1 end), 6) as mean_return from t group by tp, sl"""))
def g6_outcome_grid(spark, sf):
    t = forward_window(view(spark, sf, "bars"), DAY, "hr", 4)
    doubles = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    t = t.withColumn("tp", F.explode(doubles(1.1, 1.5, 2.0))).withColumn("sl", F.explode(doubles(0.9, 0.5)))
    least = lambda test: F.coalesce(F.array_min(F.transform(F.filter("ahead", test), lambda a: a["step"])), F.lit(99))
    t = t.withColumn("u", least(lambda a: a["high"] >= F.col("close") * F.col("tp"))).withColumn("d", least(lambda a: a["low"] <= F.col("close") * F.col("sl")))
    last = F.when(F.size("ahead") > 0, F.element_at("ahead", -1)["close"] / F.col("close") - 1)
    result = F.when(F.col("u") < F.col("d"), F.col("tp") - 1).when(F.col("d") < 99, F.col("sl") - 1).otherwise(last)
    return t.groupBy("tp", "sl").agg(F.count("*").alias("n"), F.count_if(F.col("u") < F.col("d")).alias("wins"), F.count_if((F.col("d") <= F.col("u")) & (F.col("d") < 99)).alias("losses"), r6(F.avg(result)).alias("mean_return"))


@query(duck(f"""with l as (select *, max_by(close, hr) over (partition by symbol, session) as lc, max(hr) over (partition by symbol, session) as lh from bars)
 select {KEY}, case when hr = lh then null when lc > close then 'LONG' when lc < close then 'SHORT' else 'FLAT' end as direction, case when hr < lh then round(lc / close - 1, 6) end as to_close from l"""))
def g15_hindsight_direction(spark, sf):
    day = Window.partitionBy(*DAY)
    b = view(spark, sf, "bars").withColumn("lc", F.max_by("close", "hr").over(day)).withColumn("lh", F.max("hr").over(day))
    open_ = F.col("hr") < F.col("lh")
    way = F.when(F.col("lc") > F.col("close"), "LONG").when(F.col("lc") < F.col("close"), "SHORT").otherwise("FLAT")
    return keyed(b, F.when(open_, way).alias("direction"), F.when(open_, r6(F.col("lc") / F.col("close") - 1)).alias("to_close"))
