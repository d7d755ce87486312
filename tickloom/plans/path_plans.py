"""Inputs of decisions: compact and wide stock rows, market rows, derived rows, paths; price bases and factors.

Spans are parameters in bars and sessions; the given bars are hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import divide, log, safe_divide
from tickloom.operators.chains import first_outside, followed, kept, next_at_or_after, numbered
from tickloom.operators.recursive import exponential, smoothed, wilder
from tickloom.operators.windows import full, over, segments, session_vwap
from tickloom.plans.feature_plans import _BY, _RUNS, _SEG, DAY, KEY, RUNS, _average_sql, averaged, bars_in_runs, keyed, r0, r6
from tickloom.plans.feature_plans import LONG as LONG_EMA
from tickloom.plans.feature_plans import SHORT as SHORT_EMA
from tickloom.plans.intake_plans import RATIOS
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

WHOLE = 24
BENCHMARK, SECOND = "click", "purchase"


#: Bars that a slope spans.
SLOPE = 5


@query(duck(f"""with recursive {_RUNS}, {_average_sql("q", "close", SHORT_EMA, f"2 / {SHORT_EMA + 1}.0", "e")}, {_average_sql("q", "close", LONG_EMA, f"2 / {LONG_EMA + 1}.0", "f")},
 j as (select q.*, e.v as short, f.v as long, lag(e.v, {SLOPE}) over w as short_before, lag(f.v, {SLOPE}) over w as long_before from q join e using {_BY} join f using {_BY} window w as (partition by q.symbol, q.run order by q.i))
 select {KEY}, round(short / nullif(short_before, 0) - 1, 6) + 0.0::double as slope_short, round(long / nullif(long_before, 0) - 1, 6) + 0.0::double as slope_long from j"""))
def e16_ema_slope(spark, sf):
    """Change of the averages over five bars of a run, which goes on over sessions: an equi join on the place in the run."""
    e = averaged(bars_in_runs(spark, sf), {"short": exponential("close", SHORT_EMA), "long": exponential("close", LONG_EMA)}, places=True)
    before = e.select("symbol", "run", (F.col("place") + SLOPE).alias("place"), F.col("short").alias("short_before"), F.col("long").alias("long_before"))
    slope = lambda c: r0(safe_divide(F.col(c), F.col(f"{c}_before")) - 1).alias(f"slope_{c}")
    return keyed(e.join(before, ["symbol", "run", "place"], "left"), slope("short"), slope("long"))


@query(duck(f"""with {_SEG}, g as (select *, max(gap) over (partition by symbol, session order by hr) as broken, min(hr) over (partition by symbol, session) as first_, max(high) over (partition by symbol, session order by hr) as top, row_number() over (partition by symbol, session, segment order by hr) as run from q)
 select {KEY}, case when broken = 0 and first_ = 0 then top end as session_high, run::int as run, case when run > 2 then round(avg(close) over (partition by symbol, session, segment order by hr rows 2 preceding), 6) end as mean_3 from g"""))
def e23_gap_reset(spark, sf):
    """A gap restarts all windows and hides the session's fields for the rest of it."""
    b = segments(view(spark, sf, "bars"), DAY, "hr")
    day, run = over(DAY, ["hr"]), Window.partitionBy(*RUNS).orderBy("hr")
    known = (F.max("gap").over(day) == 0) & (F.min("hr").over(day) == 0)
    last = over(RUNS, ["hr"], -2, 0)
    return keyed(b, F.when(known, F.max("high").over(day)).alias("session_high"), F.row_number().over(run).alias("run"), r6(full(F.avg("close").over(last), last, F.col("close"), 3)).alias("mean_3"))


def sessions_of(bars: DataFrame) -> DataFrame:
    """One row a symbol and session: place, open, high, low, close, volume, n, squares (of log returns)."""
    step = log(divide(F.col("close"), F.lag("close").over(Window.partitionBy(*DAY).orderBy("hr"))))
    d = bars.withColumn("step", step).groupBy(*DAY).agg(
        F.min_by("open", "hr").alias("d_open"), F.max("high").alias("d_high"), F.min("low").alias("d_low"), F.max_by("close", "hr").alias("d_close"), F.sum("n_ticks").alias("d_volume"), F.count("*").alias("n"), F.sum(F.col("step") ** 2).alias("squares"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("session")))


_DAYS = """st as (select *, ln(close / lag(close) over (partition by symbol, session order by hr)) as step from bars),
 dy as (select *, row_number() over (partition by symbol order by session) as place from (select symbol, session, min_by(open, hr) as d_open, max(high) as d_high, min(low) as d_low, max_by(close, hr) as d_close, sum(n_ticks) as d_volume, count(*) as n, sum(step * step) as squares from st group by 1, 2))"""


@query(duck(f"""with {_SEG}, {_DAYS}, z as (select 1),
 w as (select q.*, lag(close, 1) over r as c1, lag(close, 3) over r as c3, min(hr) over d as first_, first_value(open) over d as o, lag(volume) over h as v1, lag(volume, 2) over h as v2, lag(volume, 3) over h as v3 from q window r as (partition by symbol, session, segment order by hr), d as (partition by symbol, session order by hr), h as (partition by symbol, hr order by session)),
 y as (select *, ln(close / c1) as step from w), x as (select *, count(step) over r as steps, sum(step * step) over r as sq from y window r as (partition by symbol, session, segment order by hr rows 3 preceding)),
 p as (select *, lag(d_close) over s as pc, lag(d_close, 4) over s as pw, avg(case when n = {WHOLE} then squares end) over t as var, count(case when n = {WHOLE} then 1 end) over t as vn from dy window s as (partition by symbol order by session), t as (partition by symbol order by session rows between 3 preceding and 1 preceding)),
 m as (select session, hr, ln(close / c1) as bench from w where symbol = '{BENCHMARK}'), m2 as (select session, hr, ln(close / c1) as second from w where symbol = '{SECOND}'),
 vw as (select *, max(case when hr <> place_ or volume is null then 1 else 0 end) over r as unknown, sum(tp * volume) over r / nullif(sum(volume) over r, 0) as mean, sum(tp * tp * volume) over r / nullif(sum(volume) over r, 0) as square from (select *, (high + low + close) / 3 as tp, row_number() over (partition by symbol, session order by hr) - 1 as place_ from bars) window r as (partition by symbol, session order by hr)),
 vz as (select symbol, session, hr, case when unknown = 0 and square - mean * mean > 1e-9 then (close - mean) / sqrt(square - mean * mean) end as vwap_z from vw), l as (select session, hr, close as level_ from w where symbol = 'error')
 select x.symbol, cast(x.session as varchar) as session, x.hr, round(ln(close / c1), 6) as log_return, round(ln(c1 / c3), 6) as log_return_before, round(case when first_ = 0 then close / o - 1 end, 6) as day_return, round(case when first_ = 0 then o / p.pc - 1 end, 6) as gap,
 round(case when steps = 4 then sqrt(sq) end, 6) as volatility, round(p.pc / p.pw - 1, 6) as prior_return, round(case when vn = 3 then sqrt(var) end, 6) as prior_volatility, round(volume / ((v1 + v2 + v3) / 3), 6) as same_hour_volume, x.hr + 1 as from_open, round(bench, 6) as benchmark, round(second, 6) as second_benchmark, round(vwap_z, 5) + 0.0::double as vwap_z, level_ as level
 from x join vz using (symbol, session, hr) left join m2 on x.session = m2.session and x.hr = m2.hr join p on x.symbol = p.symbol and x.session = p.session left join m on x.session = m.session and x.hr = m.hr left join l on x.session = l.session and x.hr = l.hr"""))
def e24_compact_inputs(spark, sf):
    """The compact inputs of a decision: returns within unbroken runs, earlier sessions, the same hour's volume, benchmark and level of the same time."""
    b = view(spark, sf, "bars")
    q = segments(b, DAY, "hr")
    run, day, hour = Window.partitionBy(*RUNS).orderBy("hr"), over(DAY, ["hr"]), Window.partitionBy("symbol", "hr").orderBy("session")
    c1, c3 = F.lag("close").over(run), F.lag("close", 3).over(run)
    q = q.select("*", F.log(F.col("close") / c1).alias("step"), F.log(c1 / c3).alias("before"), F.min("hr").over(day).alias("first"), F.first("open").over(day).alias("o"), (sum(F.lag("volume", k).over(hour) for k in (1, 2, 3)) / 3).alias("usual"))
    four = over(RUNS, ["hr"], -3, 0)
    q = q.withColumn("rv", full(F.sqrt(F.sum(F.col("step") ** 2).over(four)), four, F.col("step"), 4))
    s, past = Window.partitionBy("symbol").orderBy("session"), over(["symbol"], ["session"], -3, -1)
    variance = F.when(F.col("n") == WHOLE, F.col("squares"))
    p = sessions_of(b).select(*DAY, F.lag("d_close").over(s).alias("pc"), F.lag("d_close", 4).over(s).alias("pw"), full(F.sqrt(F.avg(variance).over(past)), past, variance, 3).alias("pv"))
    at = lambda symbol, c, name: q.where(F.col("symbol") == symbol).select("session", "hr", F.col(c).alias(name))
    seen = over(DAY, ["hr"])
    z = session_vwap(b, DAY, "hr", "volume").withColumn("whole", F.max((F.col("hr") != F.row_number().over(seen) - 1).cast("int")).over(seen) == 0)
    z = z.select(*DAY, "hr", F.when(F.col("whole") & (F.col("vwap_dev") ** 2 > 1e-9), F.col("vwap_sigma")).alias("vwap_z"))
    j = q.join(z, [*DAY, "hr"]).join(p, DAY).join(at(BENCHMARK, "step", "bench"), ["session", "hr"], "left").join(at(SECOND, "step", "second"), ["session", "hr"], "left").join(at("error", "close", "level"), ["session", "hr"], "left")
    whole = lambda c: F.when(F.col("first") == 0, c)
    return keyed(j, r6(F.col("step")).alias("log_return"), r6(F.col("before")).alias("log_return_before"), r6(whole(F.col("close") / F.col("o") - 1)).alias("day_return"), r6(whole(F.col("o") / F.col("pc") - 1)).alias("gap"), r6(F.col("rv")).alias("volatility"),
                 r6(F.col("pc") / F.col("pw") - 1).alias("prior_return"), r6(F.col("pv")).alias("prior_volatility"), r6(F.col("volume") / F.col("usual")).alias("same_hour_volume"), (F.col("hr") + 1).alias("from_open"), r6(F.col("bench")).alias("benchmark"), r6(F.col("second")).alias("second_benchmark"), (F.round("vwap_z", 5) + 0.0).alias("vwap_z"), "level")


#: Sessions that daily inputs look back, and fewer for their shorter ones.
LOOK, SHORT = 5, 2
#: Sessions of the relative strength of daily closes.
RSI_DAYS = 5


def _log10(x: Column) -> Column:
    return F.when(x == 0, float("-inf")).otherwise(F.log10(x))


def stock_inputs(bars: DataFrame) -> DataFrame:
    """The wide inputs of a stock at each bar, null until enough sessions were seen; nothing after the bar is read."""
    day = over(DAY, ["hr"])
    lag = lambda k: F.lag("close", k).over(Window.partitionBy(*DAY).orderBy("hr"))
    volume, typical = F.col("n_ticks"), (F.col("high") + F.col("low") + F.col("close")) / 3
    x = bars.withColumn("sq", F.coalesce(log(divide(F.col("close"), lag(1))) ** 2, F.lit(0.0))).select(
        "*", F.first("open").over(day).alias("o"), F.max("high").over(day).alias("top"), F.min("low").over(day).alias("bottom"), F.sum(volume).over(day).alias("cum"), (F.sum(typical * volume).over(day) / F.sum(volume).over(day)).alias("vwap"),
        F.sqrt(F.sum("sq").over(over(DAY, ["hr"], -3, 0))).alias("rv"), F.sum("sq").over(day).alias("all_sq"), *[(divide(F.col("close"), lag(k)) - 1).alias(f"ret{k}") for k in (1, 3, 6)])
    s, past = Window.partitionBy("symbol").orderBy("session"), lambda n: over(["symbol"], ["session"], -n, -1)
    pc = F.lag("d_close").over(s)
    d = sessions_of(bars).withColumn("pc", pc).withColumn("tr", F.greatest("d_high", "pc") - F.least("d_low", "pc")).withColumn("rv_day", F.sqrt(safe_divide(F.col("squares"), F.col("n") - 1)))
    back = lambda k: divide(F.col("pc"), F.lag("d_close", k + 1).over(s)) - 1
    change = F.col("d_close") - F.col("pc")
    moves = d.withColumn("up", F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))).withColumn("down", F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))).withColumn("month", F.trunc("session", "month")).withColumn("day", F.dayofmonth("session")).withColumn("gap", F.lit(0))
    d = smoothed(moves, ["symbol"], "month", "day", {"g": wilder("up", RSI_DAYS), "l": wilder("down", RSI_DAYS)}, 32).withColumn("rsi_after", F.when(F.col("l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("g") / F.col("l"))))
    d = d.select(*DAY, "place", "pc", divide(F.avg("tr").over(past(LOOK)), F.col("pc")).alias("atr"), F.percentile("rv_day", 0.5).over(past(LOOK)).alias("hist_rv"), F.lag("rsi_after").over(s).alias("rsi"), back(1).alias("ret_d1"), back(SHORT).alias("ret_d2"), back(LOOK).alias("ret_d5"),
                 (divide(F.col("pc"), F.avg("d_close").over(past(SHORT))) - 1).alias("sma_s"), (divide(F.col("pc"), F.avg("d_close").over(past(LOOK))) - 1).alias("sma_l"), (divide(F.col("pc"), F.max("d_high").over(past(LOOK))) - 1).alias("from_high"),
                 (F.avg("d_volume").over(past(SHORT)) / F.avg("d_volume").over(past(LOOK))).alias("vol_trend"), _log10(F.avg(F.col("d_close") * F.col("d_volume")).over(past(LOOK))).alias("turnover"))
    hour = over(["symbol", "hr"], ["session"], -LOOK, -1)
    x = x.withColumn("usual", F.avg("cum").over(hour)).join(d, DAY).where(F.col("place") > LOOK)
    c, span = F.col("close"), F.col("top") - F.col("bottom")
    return x.select("symbol", "session", "hr", "ret1", "ret3", "ret6", (divide(c, F.col("o")) - 1).alias("ret_open"), (divide(F.col("o"), F.col("pc")) - 1).alias("gap"), (divide(c, F.col("vwap")) - 1).alias("vwap_dev"), (divide(c, F.col("top")) - 1).alias("dist_high"), (divide(c, F.col("bottom")) - 1).alias("dist_low"),
                    safe_divide(c - F.col("bottom"), span).alias("range_pos"), "rv", "rsi", safe_divide(F.col("rv"), F.col("hist_rv")).alias("rv_ratio"), (F.col("cum") / F.col("usual")).alias("rvol"), divide(divide(span, c), F.col("atr")).alias("range_atr"), (F.lit(WHOLE - 1) - F.col("hr")).alias("slot"), "atr", "hist_rv", "ret_d1", "ret_d2", "ret_d5",
                    "sma_s", "sma_l", "from_high", "vol_trend", "turnover", _log10(c).alias("log_price"), F.sqrt(safe_divide(F.col("all_sq"), F.col("hr"))).alias("rv_open"))


_WIDE = f"""wd0 as (select *, coalesce(power(ln(close / lag(close) over w), 2), 0) as sq from bars window w as (partition by symbol, session order by hr)),
 wd1 as (select *, first_value(open) over d as o, max(high) over d as top, min(low) over d as bottom, sum(n_ticks) over d as cum, sum((high + low + close) / 3 * n_ticks) over d / sum(n_ticks) over d as vwap, sqrt(sum(sq) over (partition by symbol, session order by hr rows 3 preceding)) as rv, sum(sq) over d as all_sq,
   close / lag(close, 1) over d - 1 as ret1, close / lag(close, 3) over d - 1 as ret3, close / lag(close, 6) over d - 1 as ret6 from wd0 window d as (partition by symbol, session order by hr)),
 d1 as (select *, lag(d_close) over (partition by symbol order by session) as pc, sqrt(squares / nullif(n - 1, 0)) as rv_day from dy), d2r as materialized (select symbol, place as i, 0 as run, case when pc is not null then greatest(d_close - pc, 0) end as up, case when pc is not null then greatest(pc - d_close, 0) end as down from d1),
 {_average_sql("d2r", "up", RSI_DAYS, f"1 / {RSI_DAYS}.0", "dg")}, {_average_sql("d2r", "down", RSI_DAYS, f"1 / {RSI_DAYS}.0", "dl")},
 d2 as (select d1.*, greatest(d_high, pc) - least(d_low, pc) as tr, case when dl.v = 0 then 100 else 100 - 100 / (1 + dg.v / dl.v) end as rsi_after from d1 join dg on d1.symbol = dg.symbol and place = dg.i join dl on d1.symbol = dl.symbol and place = dl.i),
 d3 as (select symbol, session, place, pc, avg(tr) over l / pc as atr, median(rv_day) over l as hist_rv, lag(rsi_after) over s as rsi, pc / lag(d_close, 2) over s - 1 as ret_d1, pc / lag(d_close, {SHORT + 1}) over s - 1 as ret_d2, pc / lag(d_close, {LOOK + 1}) over s - 1 as ret_d5, pc / avg(d_close) over h - 1 as sma_s, pc / avg(d_close) over l - 1 as sma_l, pc / max(d_high) over l - 1 as from_high,
   avg(d_volume) over h / avg(d_volume) over l as vol_trend, log10(avg(d_close * d_volume) over l) as turnover from d2 window s as (partition by symbol order by session), l as (partition by symbol order by session rows between {LOOK} preceding and 1 preceding), h as (partition by symbol order by session rows between {SHORT} preceding and 1 preceding)),
 wd2 as (select *, avg(cum) over (partition by symbol, hr order by session rows between {LOOK} preceding and 1 preceding) as usual from wd1),
 wide as (select symbol, session, hr, ret1, ret3, ret6, close / o - 1 as ret_open, o / pc - 1 as gap, close / vwap - 1 as vwap_dev, close / top - 1 as dist_high, close / bottom - 1 as dist_low, (close - bottom) / nullif(top - bottom, 0) as range_pos, rv, rsi, rv / nullif(hist_rv, 0) as rv_ratio, cum / usual as rvol, (top - bottom) / close / atr as range_atr, {WHOLE - 1} - hr as slot,
   atr, hist_rv, ret_d1, ret_d2, ret_d5, sma_s, sma_l, from_high, vol_trend, turnover, log10(close) as log_price, sqrt(all_sq / nullif(hr, 0)) as rv_open from wd2 join d3 using (symbol, session) where place > {LOOK})"""
_COLUMNS = ("rsi ret1 ret3 ret6 ret_open gap vwap_dev dist_high dist_low range_pos rv rv_ratio rvol range_atr atr hist_rv ret_d1 ret_d2 ret_d5 sma_s sma_l from_high vol_trend turnover log_price rv_open").split()


@query(duck(f"with recursive {_DAYS}, {_WIDE} select {KEY}, slot, {', '.join(f'round({c}, 7) + 0.0 as {c}' for c in _COLUMNS)} from wide"))
def e25_stock_inputs(spark, sf):
    x = stock_inputs(view(spark, sf, "bars"))
    return keyed(x, "slot", *[(F.round(c, 7) + 0.0).alias(c) for c in _COLUMNS])


def market_inputs(bars: DataFrame, index: str, fear: str) -> DataFrame:
    """(session, hr) rows of an index and a fear gauge: day and short return, level and its change, longer return and mean."""
    s, w = Window.partitionBy("symbol").orderBy("session"), Window.partitionBy(*DAY).orderBy("hr")
    d = sessions_of(bars).select(*DAY, F.lag("d_close").over(s).alias("pc"), F.lag("d_close", LOOK + 1).over(s).alias("p5"), F.avg("d_close").over(over(["symbol"], ["session"], -LOOK, -1)).alias("mean"))
    x = bars.withColumn("c3", F.lag("close", 3).over(w)).join(d, DAY)
    i = x.where(F.col("symbol") == index).select("session", "hr", (F.col("close") / F.col("pc") - 1).alias("index_day"), (F.col("close") / F.col("c3") - 1).alias("index_ret3"), (F.col("pc") / F.col("p5") - 1).alias("index_ret_d5"), (F.col("pc") / F.col("mean") - 1).alias("index_sma"))
    v = x.where(F.col("symbol") == fear).select("session", "hr", F.col("close").alias("fear"), (F.col("close") / F.col("pc") - 1).alias("fear_change"))
    return i.join(v, ["session", "hr"], "left")


_MARKET = f"""mk as (select x.*, lag(close, 3) over (partition by x.symbol, x.session order by hr) as c3, pc, p5, mean_ from bars x join (select symbol, session, lag(d_close) over s as pc, lag(d_close, {LOOK + 1}) over s as p5, avg(d_close) over (partition by symbol order by session rows between {LOOK} preceding and 1 preceding) as mean_ from dy window s as (partition by symbol order by session)) using (symbol, session)),
 market as (select i.session, i.hr, i.close / i.pc - 1 as index_day, i.close / i.c3 - 1 as index_ret3, i.pc / i.p5 - 1 as index_ret_d5, i.pc / i.mean_ - 1 as index_sma, v.close as fear, v.close / v.pc - 1 as fear_change from mk i left join mk v on i.session = v.session and i.hr = v.hr and v.symbol = 'error' where i.symbol = '{BENCHMARK}')"""
_MCOLUMNS = "index_day index_ret3 index_ret_d5 index_sma fear fear_change".split()


@query(duck(f"with {_DAYS}, {_MARKET} select cast(session as varchar) as session, hr, {', '.join(f'round({c}, 5) + 0.0 as {c}' for c in _MCOLUMNS)} from market"))
def e26_market_inputs(spark, sf):
    m = market_inputs(view(spark, sf, "bars"), BENCHMARK, "error")
    return m.select(F.col("session").cast("string").alias("session"), "hr", *[(F.round(c, 5) + 0.0).alias(c) for c in _MCOLUMNS])


#: A move, in shares of the price, that is set against the volatility of the bars left.
LOOK_MOVE = 0.5


@query(duck(f"""with recursive {_DAYS}, {_WIDE}, {_MARKET} select {KEY}, round((1 + gap) * (1 + ret_open) - 1 - index_day, 5) + 0.0 as rel_day, round(ret_d5 - index_ret_d5, 5) + 0.0 as rel_d5,
 round({LOOK_MOVE} / greatest(hist_rv * sqrt(slot), 1e-9), 4) as z_hist, round({LOOK_MOVE} / greatest(atr * sqrt(slot / {WHOLE}.0), 1e-9), 4) as z_atr from wide left join market using (session, hr) where slot > 0"""))
def e27_derived_inputs(spark, sf):
    """Returns relative to the index, and a move over volatility scaled to the bars left."""
    b = view(spark, sf, "bars")
    x = stock_inputs(b).join(market_inputs(b, BENCHMARK, "error"), ["session", "hr"], "left").where("slot > 0")
    z = lambda c, unit: F.round(LOOK_MOVE / F.greatest(F.col(c) * F.sqrt(F.col("slot") / unit), F.lit(1e-9)), 4)
    return keyed(x, (F.round((1 + F.col("gap")) * (1 + F.col("ret_open")) - 1 - F.col("index_day"), 5) + 0.0).alias("rel_day"), (F.round(F.col("ret_d5") - F.col("index_ret_d5"), 5) + 0.0).alias("rel_d5"), z("hist_rv", 1.0).alias("z_hist"), z("atr", float(WHOLE)).alias("z_atr"))


@query(duck(f"""with p0 as (select *, ln(close / coalesce(lag(close) over d, open)) as step, case when high > low then (2 * close - high - low) / (high - low) else 0 end as place, sign(close - open) * n_ticks as flow from bars window d as (partition by symbol, session order by hr))
 select {KEY}, round(sum(step) over l3, 6) + 0.0 as r3, round(sum(step) over d, 6) + 0.0 as r_open, round(sqrt(sum(step * step) over l3), 6) as rv3, round(avg(case when step > 0 then 1.0 else 0.0 end) over l3, 6) as up3, round(ln(close / max(high) over d), 6) + 0.0 as dist_high, round(ln(close / avg(close) over d), 6) + 0.0 as twap,
 round(sum(flow) over l3 / sum(n_ticks) over l3, 6) + 0.0 as imbalance3, round(avg(place) over l3, 6) + 0.0 as place3, round((sum(n_ticks) over l3 / count(*) over l3) / (sum(n_ticks) over d / count(*) over d), 6) as volume3
 from p0 window d as (partition by symbol, session order by hr), l3 as (partition by symbol, session order by hr rows 2 preceding)"""))
def e29_path_inputs(spark, sf):
    """The path so far: trailing log returns from the open, share of rising bars, place of closes in their bars, signed flow, time-weighted price."""
    b, d, last = view(spark, sf, "bars"), over(DAY, ["hr"]), over(DAY, ["hr"], -2, 0)
    spread = F.col("high") - F.col("low")
    before = F.coalesce(F.lag("close").over(Window.partitionBy(*DAY).orderBy("hr")), "open")
    b = b.select("*", F.log(F.col("close") / before).alias("step"), F.when(spread > 0, (2 * F.col("close") - F.col("high") - F.col("low")) / spread).otherwise(0.0).alias("place"), (F.signum(F.col("close") - F.col("open")) * F.col("n_ticks")).alias("flow"))
    z = lambda c: r6(c) + 0.0
    rate = lambda w: F.sum("n_ticks").over(w) / F.count("*").over(w)
    return keyed(b, z(F.sum("step").over(last)).alias("r3"), z(F.sum("step").over(d)).alias("r_open"), r6(F.sqrt(F.sum(F.col("step") ** 2).over(last))).alias("rv3"), r6(F.avg(F.when(F.col("step") > 0, 1.0).otherwise(0.0)).over(last)).alias("up3"), z(F.log(F.col("close") / F.max("high").over(d))).alias("dist_high"),
                 z(F.log(F.col("close") / F.avg("close").over(d))).alias("twap"), z(F.sum("flow").over(last) / F.sum("n_ticks").over(last)).alias("imbalance3"), z(F.avg("place").over(last)).alias("place3"), r6(rate(last) / rate(d)).alias("volume3"))


@query(duck("""with g as (select symbol, idx, close, open, open / lag(close) over (partition by symbol order by idx) - 1 as gap from daily), h as (select symbol, idx, case when abs(gap) <= 0.5 then gap end as gap, close / open - 1 as oc from g)
 select symbol, idx, case when count(gap) over w >= 4 then round(avg(gap) over w, 6) end as overnight, case when count(oc) over w >= 4 then round(avg(oc) over w, 6) end as intraday from h window w as (partition by symbol order by idx rows 5 preceding)"""))
def e32_tug_of_war(spark, sf):
    """Mean overnight gap (beyond a limit unknown) and mean return within sessions, over the last six, four of them known at least."""
    d = view(spark, sf, "daily")
    gap = F.col("open") / F.lag("close").over(Window.partitionBy("symbol").orderBy("idx")) - 1
    d = d.withColumn("g0", gap).select("symbol", "idx", F.when(F.abs("g0") <= 0.5, F.col("g0")).alias("gap"), (F.col("close") / F.col("open") - 1).alias("oc"))
    w = over(["symbol"], ["idx"], -5, 0)
    mean = lambda c: F.when(F.count(c).over(w) >= 4, r6(F.avg(c).over(w)))
    return d.select("symbol", "idx", mean("gap").alias("overnight"), mean("oc").alias("intraday"))


@query(duck("""with o as (select symbol, session, sum(n_ticks)::double as v from bars where hr < 3 group by 1, 2) select symbol, cast(session as varchar) as session, case when count(v) over w >= 3 and avg(v) over w > 0 then round(v / avg(v) over w, 6) end as rvol from o window w as (partition by symbol order by session rows between 6 preceding and 1 preceding)"""))
def e33_opening_volume(spark, sf):
    """Opening volume against up to six earlier sessions, three at least."""
    o = view(spark, sf, "bars").where("hr < 3").groupBy(*DAY).agg(F.sum("n_ticks").cast("double").alias("v"))
    w = over(["symbol"], ["session"], -6, -1)
    return o.select("symbol", F.col("session").cast("string").alias("session"), F.when((F.count("v").over(w) >= 3) & (F.avg("v").over(w) > 0), r6(F.col("v") / F.avg("v").over(w))).alias("rvol"))


FACTOR_TOLERANCE = 0.4


@query(duck(f"""with recursive d as (select symbol, idx, close / 1999 as ratio from daily), r as (select symbol, min(idx) as first_, 0 as n from d group by 1 union all
   select r.symbol, (select min(b.idx) from d b, d a where a.symbol = r.symbol and a.idx = r.first_ and b.symbol = r.symbol and b.idx > r.first_ and (b.ratio < a.ratio * {1 - FACTOR_TOLERANCE} or b.ratio > a.ratio * {1 + FACTOR_TOLERANCE})), r.n + 1 from r where r.first_ is not null),
 s as (select symbol, n, first_, lead(first_) over (partition by symbol order by n) as next_ from r where first_ is not null)
 select s.symbol, s.n + 1 as n, s.first_ as first_idx, max(d.idx) as last_idx, count(*) as samples, round(min_by(ratio, idx), 6) as ratio from s join d on d.symbol = s.symbol and d.idx >= s.first_ and (next_ is null or d.idx < next_) group by 1, 2, 3""").replace("with bars as", "with bars as").replace("with daily as", "with recursive daily as").replace(", recursive d as", ", d as"))
def e38_factor_segments(spark, sf):
    """Runs of a ratio that stay near their first value."""
    d = view(spark, sf, "daily").select("symbol", "idx", (F.col("close") / 1999).alias("ratio"))
    return factor_segments(d, ["symbol"], "idx", "ratio", FACTOR_TOLERANCE, 64).select("symbol", "n", "first_idx", "last_idx", "samples", r6("ratio").alias("ratio"))


def factor_segments(df: DataFrame, by: list[str], at: str, ratio: str, tolerance: float, width: float) -> DataFrame:
    """(by, n, first_<at>, last_<at>, samples, ratio) of the n-th segment: samples in order of `at` whose ratio is off the segment's first by a share of `tolerance` at most.

    A sample's successor is the first later one outside its band; the first sample
    leads to the first of each segment. Samples without a ratio are left out.
    """
    rows = kept(numbered(df.where(F.col(ratio).isNotNull()).select(*by, at, ratio), by, at, width, "place"))
    ends = [F.col(ratio) * (1 - tolerance), F.col(ratio) * (1 + tolerance)]
    linked = first_outside(rows.withColumn("below", F.least(*ends)).withColumn("above", F.greatest(*ends)), by, "place", ratio, ratio, "below", "above", strict=True)
    starts = followed(linked, by, "place", "__to", rows.groupBy(*by).agg(F.min("place").alias("place")))
    total = rows.groupBy(*by).agg((F.max("place") + 1).alias("__all"))
    s = linked.join(starts, [*by, "place"]).join(total, by).withColumn("__end", F.coalesce("__to", "__all"))
    last = rows.select(*by, (F.col("place") + 1).alias("__end"), F.col(at).alias(f"last_{at}"))
    return s.join(last, [*by, "__end"]).select(*by, (F.col("n") + 1).cast("int").alias("n"), F.col(at).alias(f"first_{at}"), f"last_{at}", (F.col("__end") - F.col("place")).cast("long").alias("samples"), ratio)


#: Slope and offset of a vendor's prices are fitted where a day's span is so large a share of its close.
LEAST_SPAN, MOST_OFF = 0.003, 2.0
_FIT = f"""pts as (select symbol, idx, unnest([open, high, low, close]) as x, unnest([open * (1 + symbol % 3) + 5 + idx % 7, high * (1 + symbol % 3) + 5, low * (1 + symbol % 3) + 5, close * (1 + symbol % 3) + 5]) as y, (high - low) / close as span, close from daily),
 fit as (select symbol, idx, case when any_value(span) >= {LEAST_SPAN} then regr_slope(y, x) else any_value(1.0 + symbol % 3) end as a, any_value(span) as span, avg(x) as mx, avg(y) as my from pts group by 1, 2),
 res as (select f.symbol, f.idx, a, my - a * mx as c, max(abs(a * x + my - a * mx - y)) as off from fit f join pts p on f.symbol = p.symbol and f.idx = p.idx group by all)"""


def fits(d: DataFrame) -> DataFrame:
    """(symbol, idx, a, c, off): the affine map of a day's official prices onto the vendor's, and its largest residual."""
    pairs = F.array(*[F.struct(F.col(o).alias("x"), F.col(v).alias("y")) for o, v in (("open", "v_open"), ("high", "v_high"), ("low", "v_low"), ("close", "v_close"))])
    p = d.select("symbol", "idx", ((F.col("high") - F.col("low")) / F.col("close")).alias("span"), (1.0 + F.col("symbol") % 3).alias("usual"), F.explode(pairs).alias("p")).select("symbol", "idx", "span", "usual", "p.x", "p.y")
    slope = F.when(F.first("span") >= LEAST_SPAN, F.regr_slope("y", "x")).otherwise(F.first("usual"))
    f = p.groupBy("symbol", "idx").agg(slope.alias("a"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.collect_list(F.struct("x", "y")).alias("ps")).withColumn("c", F.col("my") - F.col("a") * F.col("mx"))
    return f.select("symbol", "idx", "a", "c", F.array_max(F.transform("ps", lambda q: F.abs(F.col("a") * q["x"] + F.col("c") - q["y"]))).alias("off"))


def _vendor(spark, sf) -> DataFrame:
    d, a = view(spark, sf, "daily"), 1 + F.col("symbol") % 3
    return d.select("symbol", "idx", "open", "high", "low", "close", "volume", (F.col("open") * a + 5 + F.col("idx") % 7).alias("v_open"), *[(F.col(c) * a + 5).alias(f"v_{c}") for c in ("high", "low", "close")])


@query(duck(f"with {_FIT} select symbol, idx, round(a, 4) + 0.0 as slope, round(off, 3) as off, round(off, 6) <= {MOST_OFF} as fits from res"))
def e39_daily_affine_fit(spark, sf):
    """Residuals are rounded before they are judged, so that one at the limit fits."""
    return fits(_vendor(spark, sf)).select("symbol", "idx", (F.round("a", 4) + 0.0).alias("slope"), F.round("off", 3).alias("off"), (F.round("off", 6) <= MOST_OFF).alias("fits"))


@query(duck(f"""with {_FIT}, ok as (select d.*, a, c, off from daily d join res using (symbol, idx)), r as (select symbol, idx, case when round(off, 6) > {MOST_OFF} then 'residual' when a <= 0 then 'slope' end as reason, (close * (1 + symbol % 3) + 5 - c) / a * 2 as close, volume / 2 as volume from ok)
 select symbol, count(*) as days, count(*) filter (where reason = 'residual') as residual, round(sum(case when reason is null then close end), 1) as close, sum(case when reason is null then volume end) as volume from r group by symbol"""))
def e43_rebased_bars(spark, sf):
    """Vendor bars brought to the official basis, (price - c) / a times a factor, volume over it; days that don't fit go, with their reasons."""
    v = _vendor(spark, sf)
    j = v.join(fits(v), ["symbol", "idx"])
    good = F.col("reason").isNull()
    j = j.withColumn("reason", F.when(F.round("off", 6) > MOST_OFF, "residual").when(F.col("a") <= 0, "slope")).withColumn("basis", (F.col("v_close") - F.col("c")) / F.col("a") * 2)
    return j.groupBy("symbol").agg(F.count("*").alias("days"), F.count_if(F.col("reason") == "residual").alias("residual"), F.round(F.sum(F.when(good, F.col("basis"))), 1).alias("close"), F.sum(F.when(good, F.col("volume") / 2)).alias("volume"))


#: Days on either side of an event that are fitted together, the first of these that fits counting; the least span of their prices; how near to 1 a ratio is none, and to a whole-number one is that.
EVENT_DAYS, EVENT_SPAN, NEAR = (15, 10, 6, 3), 0.01, 0.005


def event_ratios(days: DataFrame, events: DataFrame, widths: tuple[int, ...] = EVENT_DAYS, bucket: float = 64) -> DataFrame:
    """(symbol, ex, status, width, measured, ratio) of events (symbol, ex): how the vendor's slope on official prices changes there.

    days: (symbol, idx, pairs, allowed), pairs being (x, y) of a day's official and
    vendor prices, allowed the largest residual. The days before and from ex on are
    fitted by their summed moments, each side as one; a side counts if its prices
    span enough and all its points fit. Of the widths, in order, the first counts
    at which both sides do. Each event meets its own few days by their places; no
    history is held.
    """
    d = numbered(days, ["symbol"], "idx", bucket, "place")
    events = events.select("symbol", "ex").distinct()
    from_ = next_at_or_after(events, ["symbol"], "ex", d, "idx", bucket)
    known = from_.join(d.select("symbol", F.col("idx").alias("__to"), F.col("place").alias("__p")), ["symbol", "__to"])
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(w).alias("width"), F.lit(side).alias("side"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, w in enumerate(widths) for side, low, high in (("left", -w, -1), ("right", 0, w - 1))]))
    asked = known.withColumn("s", sides).select("symbol", "ex", "s.order", "s.width", "s.side", F.explode(F.sequence(F.col("__p") + F.col("s.low"), F.col("__p") + F.col("s.high"))).alias("place"))
    key = ["symbol", "ex", "order", "width", "side"]
    near = asked.join(d.select("symbol", "place", "pairs", "allowed"), ["symbol", "place"])
    points = near.select(*key, "allowed", F.explode("pairs").alias("p")).select(*key, "allowed", "p.x", "p.y")
    fit = points.groupBy(*key).agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("c"), ((F.max("x") - F.min("x")) / F.median("x")).alias("span"))
    off = points.join(fit, key).groupBy(*key, "a", "span").agg(F.max(F.abs(F.col("a") * F.col("x") + F.col("c") - F.col("y")) - F.col("allowed")).alias("over"))
    good = off.where((F.col("span") >= EVENT_SPAN) & (F.col("over") <= 0))
    both = good.groupBy("symbol", "ex", "order", "width").agg(F.max(F.when(F.col("side") == "left", F.col("a"))).alias("l"), F.max(F.when(F.col("side") == "right", F.col("a"))).alias("r")).where("l is not null and r is not null")
    best = both.groupBy("symbol", "ex").agg(F.min_by(F.struct("width", (F.col("l") / F.col("r")).alias("m")), "order").alias("b"))
    near_ = F.array_min(F.transform(F.array(*map(F.lit, RATIOS)), lambda r: F.struct(F.abs(r / F.col("b.m") - 1).alias("error"), r.alias("real"))))
    status = F.when(F.col("b").isNull(), "unresolved").when(F.abs(F.col("b.m") - 1) <= NEAR, "unadjusted").otherwise("adjusted")
    out = events.join(best, ["symbol", "ex"], "left").withColumn("n", F.when(F.col("b").isNotNull(), near_)).withColumn("status", status)
    adjusted = F.col("status") == "adjusted"
    return out.select("symbol", "ex", "status", "b.width", F.when(adjusted, F.col("b.m")).alias("measured"), F.when(adjusted, F.when(F.col("n.error") <= NEAR, F.col("n.real")).otherwise(F.col("b.m"))).alias("ratio"))


#: The vendor's prices of the event query: twice the official ones from a symbol's 40th session on, an odd open now and then.
_SCALE = "(case when idx >= first_ + 40 then 2.0 else 1.0 end)"
_EVENTS = f"""f0 as (select *, min(idx) over (partition by symbol) as first_ from daily),
 dd as (select symbol, idx, unnest([open, high, low, close]) as x, unnest([open * {_SCALE} + 5 + case when idx % 9 = 0 then 40 else (idx % 3) * 0.05 end, high * {_SCALE} + 5, low * {_SCALE} + 5, close * {_SCALE} + 5]) as y, 0.135 + 0.0002 * (close * {_SCALE} + 5) as allowed from f0),
 pl as (select symbol, idx, row_number() over (partition by symbol order by idx) as place from daily), ev as (select symbol, idx as ex, place as p0 from pl join daily using (symbol, idx) where n % 11 = 0 or n % 7 = 0),
 ws as (select unnest([0, 1, 2, 3]) as ord, unnest({list(EVENT_DAYS)}) as width), sd as (select ev.*, ord, width, side from ev, ws, (select unnest(['left', 'right']) as side)),
 pt as (select s.symbol, ex, ord, width, side, x, y, allowed from sd s join pl on pl.symbol = s.symbol and pl.place between case when side = 'left' then p0 - width else p0 end and case when side = 'left' then p0 - 1 else p0 + width - 1 end join dd on dd.symbol = s.symbol and dd.idx = pl.idx),
 ft as (select symbol, ex, ord, width, side, regr_slope(y, x) as a, regr_intercept(y, x) as c, (max(x) - min(x)) / median(x) as span from pt group by all),
 gd as (select symbol, ex, ord, width, side, a from ft join pt using (symbol, ex, ord, width, side) where span >= {EVENT_SPAN} group by all having max(abs(a * x + c - y) - allowed) <= 0),
 bo as (select symbol, ex, ord, width, max(a) filter (where side = 'left') / max(a) filter (where side = 'right') as m from gd group by all having count(*) = 2), be as (select symbol, ex, arg_min(width, ord) as width, arg_min(m, ord) as m from bo group by all),
 rr as (select symbol, ex, arg_min(real, abs(real / m - 1)) as real, min(abs(real / m - 1)) as error from be, (select cast(unnest({RATIOS}) as double) as real) group by all)"""


@query(duck(f"""with {_EVENTS} select symbol, ex, case when m is null then 'unresolved' when abs(m - 1) <= {NEAR} then 'unadjusted' else 'adjusted' end as status, cast(width as double) as width, case when abs(m - 1) > {NEAR} then round(m, 5) end as measured,
 case when abs(m - 1) > {NEAR} then round(case when error <= {NEAR} then real else m end, 5) end as ratio from ev left join be using (symbol, ex) left join rr using (symbol, ex)"""))
def e39_event_ratios(spark, sf):
    """The vendor's adjustment at each event: slope before over slope after, snapped to a ratio of small whole numbers."""
    d = view(spark, sf, "daily")
    start = d.groupBy("symbol").agg(F.min("idx").alias("first"))
    a = F.when(F.col("idx") >= F.col("first") + 40, 2.0).otherwise(1.0)
    odd = F.when(F.col("idx") % 9 == 0, 40.0).otherwise(F.col("idx") % 3 * 0.05)
    pairs = F.array(*[F.struct(F.col(c).alias("x"), (F.col(c) * a + 5 + (odd if c == "open" else F.lit(0.0))).alias("y")) for c in ("open", "high", "low", "close")])
    days = d.join(start, "symbol").select("symbol", "idx", pairs.alias("pairs"), (0.135 + 0.0002 * (F.col("close") * a + 5)).alias("allowed"))
    events = d.where("n % 11 = 0 or n % 7 = 0").select("symbol", F.col("idx").alias("ex"))
    return event_ratios(days, events).withColumn("width", F.col("width").cast("double")).withColumn("measured", F.round("measured", 5)).withColumn("ratio", F.round("ratio", 5))


@query(duck("""with e as (select symbol, idx, close, lag(close) over w as before, lag(idx) over w as b_idx, 0.01 * (1 + n % 9) * lag(close) over w as amount from daily window w as (partition by symbol order by idx)), r as (select symbol, idx, close / (close + n % 5) as ratio from daily where n % 2 = 0),
 v as (select symbol, idx as ex, amount, amount / before as y, b_idx from e where before is not null and idx % 4 = 0),
 j as (select v.*, (select max_by(ratio, r.idx) from r where r.symbol = v.symbol and r.idx <= b_idx) as left_, (select min_by(ratio, r.idx) from r where r.symbol = v.symbol and r.idx >= ex) as right_ from v)
 select symbol, ex, round(y, 6) as dividend_yield, case when left_ is null or right_ is null then 'two_percent_rule' else 'ratio' end as evidence, case when left_ is null or right_ is null then y >= 0.02 else ln(left_ / right_) > -ln(1 - y) / 2 end as adjusted from j"""))
def e40_dividend_in_price(spark, sf):
    """Is a dividend already in the vendor's price? The change of the ratio over its day against half the yield; by its size where a side has no ratio."""
    d, w = view(spark, sf, "daily"), Window.partitionBy("symbol").orderBy("idx")
    ratio = F.when(F.col("n") % 2 == 0, F.col("close") / (F.col("close") + F.col("n") % 5))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("ratio", ratio).select("symbol", F.col("idx").alias("ex"), F.lag("close").over(w).alias("c1"), (0.01 * (1 + F.col("n") % 9) * F.lag("close").over(w)).alias("amount"), F.last("ratio", ignorenulls=True).over(before).alias("l"), F.first("ratio", ignorenulls=True).over(after).alias("r"))
    d = d.where("c1 is not null and ex % 4 = 0").withColumn("y", F.col("amount") / F.col("c1"))
    none = F.col("l").isNull() | F.col("r").isNull()
    return d.select("symbol", "ex", r6(F.col("y")).alias("dividend_yield"), F.when(none, "two_percent_rule").otherwise("ratio").alias("evidence"), F.when(none, F.col("y") >= 0.02).otherwise(F.log(F.col("l") / F.col("r")) > -F.log(1 - F.col("y")) / 2).alias("adjusted"))


@query(duck(f"""with {_DAYS}, b as (select symbol, session, lag(d_close) over s as c1, lag(d_close, 3) over s as c3, case when count(d_close) over l = {LOOK} then avg(d_close) over l end as mean_, case when count(d_close) over l = {LOOK} then max(d_high) over l end as top from dy window s as (partition by symbol order by session), l as (partition by symbol order by session rows between {LOOK} preceding and 1 preceding)),
 x as (select bars.symbol, session, hr, close / c1 * 100 - 100 as today, close / c3 * 100 - 100 as c3d, close / mean_ * 100 - 100 as vs_mean, close / greatest(top, max(high) over (partition by symbol, session order by hr)) * 100 - 100 as vs_high0, top from bars join b using (symbol, session))
 select x.symbol, cast(x.session as varchar) as session, x.hr, round(x.today, 4) + 0.0 as change_today, round(x.c3d, 4) + 0.0 as change_3d, round(x.vs_mean, 4) + 0.0 as vs_mean, round(case when x.top is not null then x.vs_high0 end, 4) + 0.0 as vs_high, round(x.c3d - i.c3d, 4) + 0.0 as vs_index_3d from x left join x i on i.symbol = '{BENCHMARK}' and x.session = i.session and x.hr = i.hr"""))
def e44_daily_inputs_now(spark, sf):
    """Daily inputs restated at the current price: changes, distance from a mean and from a high that counts today's, relative to the index."""
    b, s, w = view(spark, sf, "bars"), Window.partitionBy("symbol").orderBy("session"), over(["symbol"], ["session"], -LOOK, -1)
    d = sessions_of(b).select(*DAY, F.lag("d_close").over(s).alias("c1"), F.lag("d_close", 3).over(s).alias("c3"), full(F.avg("d_close").over(w), w, F.col("d_close"), LOOK).alias("mean"), full(F.max("d_high").over(w), w, F.col("d_close"), LOOK).alias("top"))
    pct = lambda base: F.col("close") / base * 100 - 100
    # A null top hides the distance; greatest alone would skip it.
    high = F.when(F.col("top").isNotNull(), F.greatest("top", "so_far"))
    x = b.withColumn("so_far", F.max("high").over(over(DAY, ["hr"]))).join(d, DAY).select(*DAY, "hr", pct(F.col("c1")).alias("today"), pct(F.col("c3")).alias("c3d"), pct(F.col("mean")).alias("m"), pct(high).alias("h"))
    i = x.where(F.col("symbol") == BENCHMARK).select("session", "hr", F.col("c3d").alias("i3"))
    z = lambda c: F.round(c, 4) + 0.0
    return keyed(x.join(i, ["session", "hr"], "left"), z("today").alias("change_today"), z("c3d").alias("change_3d"), z("m").alias("vs_mean"), z("h").alias("vs_high"), z(F.col("c3d") - F.col("i3")).alias("vs_index_3d"))
