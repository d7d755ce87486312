"""Bars from ticks, session features, indicators and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import centred_sigmoid, minutes_since_open, ramp, ratio_change, safe_divide, session_of, to_tick
from tickloom.operators.recursive import exponential, smoothed, wilder, with_previous
from tickloom.operators.windows import full, over, rolling, segments, session_context, session_vwap
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

DAY = ["symbol", "session"]


def r6(c):
    return F.round(c, 6)


def tied(c):
    """Rounded to six places, values half way between two going up in every engine."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def keyed(df, *columns):
    """The key of a bar, with times as text, and the columns named."""
    return df.select("symbol", F.col("session").cast("string").alias("session"), "hr", *columns)


KEY = "symbol, cast(session as varchar) as session, hr"
#: One row window text for DuckDB.
RUN = "partition by symbol, session order by hr rows between unbounded preceding and current row"


@query(duck("""select symbol, cast(date_trunc('minute', ts) as varchar) as minute, min_by(price, (ts, seq)) as open, max(price) as high, min(price) as low,
 max_by(price, (ts, seq)) as close, count(*) as n_ticks from x1 where price > 0 group by symbol, date_trunc('minute', ts)"""))
def d1_minute_bars(spark, sf):
    ticks = view(spark, sf, "x1").where("price > 0").withColumn("m", F.date_trunc("minute", "ts"))
    first = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.col("m").cast("string").alias("minute")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", first).alias("close"), F.count("*").alias("n_ticks"))


@query(duck("""with c as (select symbol, ts, seq, max(seq) over (partition by symbol, date_trunc('minute', ts)) as cum, date_trunc('minute', ts) as m from x1),
 g as (select symbol, m, max(cum) as cum from c group by symbol, m),
 p as (select *, lag(m) over w as pm, lag(cum) over w as pc from g window w as (partition by symbol order by m))
 select symbol, cast(m as varchar) as minute, case when m = pm + interval 1 minute and cum >= pc then cast(cum - pc as double) end as volume from p"""))
def d2_cumulative_volume(spark, sf):
    last = view(spark, sf, "x1").groupBy("symbol", F.date_trunc("minute", "ts").alias("m")).agg(F.max("seq").alias("cum"))
    w = Window.partitionBy("symbol").orderBy("m")
    follows = (F.unix_timestamp("m") - F.unix_timestamp(F.lag("m").over(w)) == 60) & (F.col("cum") >= F.lag("cum").over(w))
    return last.select("symbol", F.col("m").cast("string").alias("minute"), F.when(follows, F.col("cum") - F.lag("cum").over(w)).cast("double").alias("volume"))


@query(duck("""with c as (select symbol, ts, seq, cast(ts as date) as d, greatest(0, user_id) as cum from x1),
 m as (select *, max(cum) over (partition by symbol, d order by ts, seq rows between unbounded preceding and current row) as top from c),
 g as (select symbol, d, date_trunc('minute', ts) as m, max(top) as top from m group by all)
 select symbol, cast(m as varchar) as minute, top - coalesce(lag(top) over (partition by symbol, d order by m), 0) as volume from g"""))
def d3_monotone_volume(spark, sf):
    ticks = view(spark, sf, "x1").withColumn("d", F.to_date("ts")).withColumn("cum", F.greatest(F.lit(0), "user_id"))
    tops = ticks.withColumn("top", F.max("cum").over(over(["symbol", "d"], ["ts", "seq"])))
    last = tops.groupBy("symbol", "d", F.date_trunc("minute", "ts").alias("m")).agg(F.max("top").alias("top"))
    before = F.lag("top").over(Window.partitionBy("symbol", "d").orderBy("m"))
    return last.select("symbol", F.col("m").cast("string").alias("minute"), (F.col("top") - F.coalesce(before, F.lit(0))).alias("volume"))


@query(duck("""select symbol, cast(session as varchar) as session, min_by(open, hr) as open, max(high) as high, min(low) as low, max_by(close, hr) as close,
 count(*) = 24 as complete, case when count(volume) = count(*) then cast(sum(volume) as double) end as volume, count(*) as n_bars from bars group by symbol, session"""))
def d4_session_frames(spark, sf):
    return view(spark, sf, "bars").groupBy("symbol", F.col("session").cast("string").alias("session")).agg(
        F.min_by("open", "hr").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "hr").alias("close"),
        (F.count("*") == 24).alias("complete"), F.when(F.count("volume") == F.count("*"), F.sum("volume")).cast("double").alias("volume"), F.count("*").alias("n_bars"))


@query(duck("""select seq, cast(cast(ts - interval 555 minute as date) as varchar) as session,
 cast(floor(date_part('hour', ts) * 60 + date_part('minute', ts) - 555) as bigint) as offset_minutes,
 round((date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts))) / 60 - 555, 6) as since_open,
 cast(date_trunc('minute', ts) as varchar) as minute, (date_part('hour', ts) * 60 + date_part('minute', ts) - 555) between 0 and 374 as regular,
 price > 0 and date_part('year', ts) between 2000 and 2100 and user_id >= 0 as valid from x1"""))
def b1_session_clock(spark, sf):
    since = minutes_since_open(F.col("ts"), 555)
    return view(spark, sf, "x1").select(
        "seq", session_of(F.col("ts"), 555).cast("string").alias("session"), F.floor(since).alias("offset_minutes"), r6(since).alias("since_open"),
        F.date_trunc("minute", "ts").cast("string").alias("minute"), F.floor(since).between(0, 374).alias("regular"),
        ((F.col("price") > 0) & F.year("ts").between(2000, 2100) & (F.col("user_id") >= 0)).alias("valid"))


@query(duck("""with f as (select *, high >= greatest(open, close, low) and low <= least(open, close, high) and low > 0 and coalesce(volume, 0) >= 0 as ok from bars)
 select symbol, count(*) as n, count(*) filter (where ok) as good, count(*) filter (where not ok) as bad,
 count(*) filter (where volume is null) as unknown_volume from f group by symbol"""))
def b7_bar_validity(spark, sf):
    ok = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")) & (F.col("low") > 0) & (F.coalesce("volume", F.lit(0)) >= 0)
    return view(spark, sf, "bars").withColumn("ok", ok).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.count_if(F.col("volume").isNull()).alias("unknown_volume"))


@query(duck(f"""select {KEY}, round(close / nullif(volume, 0), 6) as per_volume, round(close / open - 1, 6) as change,
 round(greatest(0, least(1, (close - 20) / 60.0)), 6) as ramp, round(2 / (1 + exp(-(close / open - 1))) - 1, 6) as sigmoid from bars"""))
def b9_scalar_functions(spark, sf):
    change = ratio_change(F.col("close"), F.col("open"))
    return keyed(view(spark, sf, "bars"), r6(safe_divide(F.col("close"), F.col("volume"))).alias("per_volume"), r6(change).alias("change"),
                 r6(ramp(F.col("close"), 20, 80)).alias("ramp"), r6(centred_sigmoid(change)).alias("sigmoid"))


@query(duck("""with t as (select trade_id, cast(cast(entry_value as decimal(18,4)) * 10000 as bigint) as x from x8)
 select trade_id, (x + 499) // 500 * 5 as up, x // 500 * 5 as down, (x // 500 + case when x % 500 > 250 then 1 when x % 500 = 250 then (x // 500) % 2 else 0 end) * 5 as even from t"""))
def b11_tick_grid(spark, sf):
    cents = lambda how: F.round(to_tick(F.col("entry_value"), "0.05", how) * 100).cast("bigint").alias(how)
    return view(spark, sf, "x8").select("trade_id", cents("up"), cents("down"), cents("even"))


@query(duck("""select event_id, case when cast(session as varchar) < '2024-01-08' then 'warm_up' when cast(session as varchar) < '2024-01-20' then 'development'
 when cast(session as varchar) < '2024-01-26' then 'validation' else 'holdout' end as split from x7"""))
def b19_split_labels(spark, sf):
    d = F.col("session").cast("string")
    label = F.when(d < "2024-01-08", "warm_up").when(d < "2024-01-20", "development").when(d < "2024-01-26", "validation").otherwise("holdout")
    return view(spark, sf, "x7").select("event_id", label.alias("split"))


N = 5


@query(duck(f"""select {KEY}, case when count(close) over w = 5 then round(avg(close) over w, 6) end as mean, case when count(close) over w = 5 then round(stddev_pop(close) over w, 6) end as dev
 from bars window w as (partition by symbol, session order by hr rows between 4 preceding and current row)"""))
def e1_mean_deviation(spark, sf):
    return keyed(rolling(view(spark, sf, "bars"), DAY, ["hr"], "close", N, "c"), r6("c_mean").alias("mean"), r6("c_dev").alias("dev"))


_SEG = """s0 as (select *, case when hr <> lag(hr) over (partition by symbol, session order by hr) + 1 then 1 else 0 end as gap from bars),
 s as (select *, sum(gap) over (partition by symbol, session order by hr rows between unbounded preceding and current row) as segment from s0),
 q as (select *, row_number() over (partition by symbol, session, segment order by hr) as i, lag(close) over (partition by symbol, session, segment order by hr) as pc,
   lag(high) over (partition by symbol, session, segment order by hr) as ph, lag(low) over (partition by symbol, session, segment order by hr) as pl from s)"""


#: Bars by place in their symbol; a run goes on over sessions and ends at a gap within one.
_RUNS = """g0 as (select *, case when hr <> lag(hr) over (partition by symbol, session order by hr) + 1 then 1 else 0 end as gap from bars),
 g1 as (select *, sum(gap) over w as run, row_number() over w as i from g0 window w as (partition by symbol order by session, hr)),
 q as materialized (select *, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl from g1 window w as (partition by symbol, run order by i))"""


def _average_sql(source: str, value: str, n: int, weight: str, name: str, hold: bool = False) -> str:
    """The recursive average row by row, from its definition."""
    shown = f"k >= {n}" if hold else f"k >= {n} and x is not null"
    return f"""{name}_ as (select symbol, i, run, {value} as x, case when {value} is null then 0 else 1 end as k, coalesce({value}, 0) / {n}.0::double as s from {source} where i = 1
      union all select b.symbol, b.i, b.run, b.{value}, case when b.run = a.run then a.k else 0 end + case when b.{value} is null then 0 else 1 end,
        case when b.run <> a.run then coalesce(b.{value}, 0) / {n} when b.{value} is null then a.s when a.k < {n} then a.s + b.{value} / {n} else a.s + {weight}::double * (b.{value} - a.s) end
      from {name}_ a join {source} b on b.symbol = a.symbol and b.i = a.i + 1),
     {name} as materialized (select symbol, i, case when {shown} then s end as v from {name}_)"""


RUNS = ["symbol", "session", "segment"]
#: Places of averages.
SHORT, LONG, RANGE, FAST, SLOW, SIGNAL = 9, 21, 14, 12, 26, 9
_BY = "(symbol, i)"


def r0(c):
    """Rounded to six places, never a negative zero."""
    return r6(c) + F.lit(0.0)


def bars_in_runs(spark, sf, *previous):
    """Bars with `gap` and the columns named of the bar before in their run."""
    bars = segments(view(spark, sf, "bars"), DAY, "hr").drop("segment")
    return with_previous(bars, ["symbol"], "session", "hr", list(previous)) if previous else bars


def averaged(bars, averages, places=False):
    return smoothed(bars, ["symbol"], "session", "hr", averages, 24, places)


@query(duck(f"""with recursive {_RUNS}, {_average_sql("q", "close", SHORT, f"2 / {SHORT + 1}.0", "e")}, {_average_sql("q", "close", LONG, f"2 / {LONG + 1}.0", "f")}
 select {KEY}, round(e.v, 6) as ema_short, round(f.v, 6) as ema_long from q join e using {_BY} join f using {_BY}"""))
def e2_ema(spark, sf):
    return keyed(averaged(bars_in_runs(spark, sf), {"short": exponential("close", SHORT), "long": exponential("close", LONG)}), r6("short").alias("ema_short"), r6("long").alias("ema_long"))


@query(duck(f"""with recursive {_RUNS}, d as materialized (select *, case when pc is not null then greatest(close - pc, 0) end as gain, case when pc is not null then greatest(pc - close, 0) end as loss from q),
 {_average_sql("d", "gain", RANGE, f"1 / {RANGE}.0", "g")}, {_average_sql("d", "loss", RANGE, f"1 / {RANGE}.0", "l")}
 select {KEY}, round(case when g.v = 0 and l.v = 0 then 50 else 100 * g.v / (g.v + l.v) end, 6) as rsi,
 round(case when l.v = 0 then 100 when g.v is null then null else 100 - 100 / (1 + g.v / l.v) end, 6) as rsi_daily from q join g using {_BY} join l using {_BY}"""))
def e4_rsi(spark, sf):
    change = F.col("close") - F.col("previous_close")
    up = lambda c: F.when(change.isNotNull(), F.greatest(c, F.lit(0.0)))
    bars = bars_in_runs(spark, sf, "close").withColumn("gain", up(change)).withColumn("loss", up(-change))
    g, x = F.col("g"), F.col("l")
    rsi = F.when((g == 0) & (x == 0), 50.0).otherwise(100 * g / (g + x))
    return keyed(averaged(bars, {"g": wilder("gain", RANGE), "l": wilder("loss", RANGE)}), r6(rsi).alias("rsi"), r6(F.when(x == 0, 100.0).otherwise(100 - 100 / (1 + g / x))).alias("rsi_daily"))


def true_range():
    """The span of a bar and the close before it; of a run's first bar, its own."""
    before = F.col("previous_close")
    span = F.col("high") - F.col("low")
    return F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


_TRUE = "case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end"


@query(duck(f"""with recursive {_RUNS}, d as materialized (select *, {_TRUE} as tr from q), {_average_sql("d", "tr", RANGE, f"1 / {RANGE}.0", "a")}
 select {KEY}, round(tr, 6) as true_range, round(a.v, 6) as atr from d join a using {_BY}"""))
def e7_atr(spark, sf):
    bars = bars_in_runs(spark, sf, "close").withColumn("tr", true_range())
    return keyed(averaged(bars, {"atr": wilder("tr", RANGE)}), r6("tr").alias("true_range"), r6("atr").alias("atr"))


@query(duck(f"""with recursive {_RUNS}, {_average_sql("q", "close", FAST, f"2 / {FAST + 1}.0", "f")}, {_average_sql("q", "close", SLOW, f"2 / {SLOW + 1}.0", "g")},
 m as materialized (select q.symbol, q.session, q.hr, q.run, i, f.v - g.v as macd from q join f using {_BY} join g using {_BY}), {_average_sql("m", "macd", SIGNAL, f"2 / {SIGNAL + 1}.0", "h")},
 o as (select m.*, h.v as signal, m.macd - h.v as histogram from m join h using {_BY})
 select {KEY}, round(macd, 6) + 0.0::double as macd, round(signal, 6) + 0.0::double as signal, round(histogram, 6) + 0.0::double as histogram,
 round(histogram - lag(histogram) over (partition by symbol, run order by i), 6) + 0.0::double as histogram_change from o"""))
def e6_macd(spark, sf):
    both = averaged(bars_in_runs(spark, sf), {"fast": exponential("close", FAST), "slow": exponential("close", SLOW)})
    both = averaged(both.withColumn("macd", F.col("fast") - F.col("slow")), {"signal": exponential("macd", SIGNAL)})
    both = with_previous(both.withColumn("histogram", F.col("macd") - F.col("signal")), ["symbol"], "session", "hr", ["histogram"])
    return keyed(both, r0("macd").alias("macd"), r0("signal").alias("signal"), r0("histogram").alias("histogram"), r0(F.col("histogram") - F.col("previous_histogram")).alias("histogram_change"))


def directional(bars):
    """plus and minus movement, each as a share of the average range, and their smoothed difference; bars with the previous close, high and low."""
    up, down, known = F.col("high") - F.col("previous_high"), F.col("previous_low") - F.col("low"), F.col("previous_close").isNotNull()
    bars = bars.select("*", F.when(known, true_range()).alias("tr"), F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)).alias("up"), F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)).alias("dn"))
    s = averaged(bars, {"s_tr": wilder("tr", RANGE), "s_up": wilder("up", RANGE), "s_dn": wilder("dn", RANGE)})
    s = s.withColumn("plus", 100 * safe_divide(F.col("s_up"), F.col("s_tr"))).withColumn("minus", 100 * safe_divide(F.col("s_dn"), F.col("s_tr")))
    total = F.col("plus") + F.col("minus")
    return averaged(s.withColumn("dx", F.when(total <= 0, 0.0).otherwise(100 * F.abs(F.col("plus") - F.col("minus")) / total)), {"adx": wilder("dx", RANGE, hold=True)})


@query(duck(f"""with recursive {_RUNS}, d as materialized (select *, case when pc is not null then {_TRUE} end as tr,
   case when high - ph > pl - low and high > ph then high - ph when ph is not null then 0 end as up, case when pl - low > high - ph and pl > low then pl - low when ph is not null then 0 end as dn from q),
 {_average_sql("d", "tr", RANGE, f"1 / {RANGE}.0", "t")}, {_average_sql("d", "up", RANGE, f"1 / {RANGE}.0", "u")}, {_average_sql("d", "dn", RANGE, f"1 / {RANGE}.0", "n")},
 x as (select q.symbol, q.i, q.run, 100 * u.v / nullif(t.v, 0) as plus, 100 * n.v / nullif(t.v, 0) as minus from q join t using {_BY} join u using {_BY} join n using {_BY}),
 y as materialized (select *, case when plus + minus <= 0 then 0 else 100 * abs(plus - minus) / (plus + minus) end as dx from x), {_average_sql("y", "dx", RANGE, f"1 / {RANGE}.0", "a", hold=True)}
 select {KEY}, round(y.plus, 5) as plus_di, round(y.minus, 5) as minus_di, round(a.v, 5) as adx from q join y using {_BY} join a using {_BY}"""))
def e8_adx(spark, sf):
    s = directional(bars_in_runs(spark, sf, "close", "high", "low"))
    return keyed(s, F.round("plus", 5).alias("plus_di"), F.round("minus", 5).alias("minus_di"), F.round("adx", 5).alias("adx"))


_VWAP = f"""v as (select *, (high + low + close) / 3 as tp from bars),
 w as (select *, max(case when {{0}} is null then 1 else 0 end) over r as unknown, sum(tp * {{0}}) over r / sum({{0}}) over r as mean, sum(tp * tp * {{0}}) over r / sum({{0}}) over r as square,
   sum({{0}}) over r as total from v window r as ({RUN}))
 select {KEY}, case when unknown = 0 and total > 0 then round(mean + 1e-9, 5) end as vwap, case when unknown = 0 and total > 0 then round(sqrt(greatest(0, square - mean * mean)), 4) end as vwap_dev from w"""


@query(duck("with " + _VWAP.format("volume")))
def e9_session_vwap(spark, sf):
    return keyed(session_vwap(view(spark, sf, "bars"), DAY, "hr", "volume"), F.round(F.col("vwap") + 1e-9, 5).alias("vwap"), F.round("vwap_dev", 4).alias("vwap_dev"))


@query(duck("with " + _VWAP.format("n_ticks").replace("square - mean * mean)), 4)", "square - mean * mean)), 3)")))
def e10_session_vwap_ticks(spark, sf):
    return keyed(session_vwap(view(spark, sf, "bars"), DAY, "hr", "n_ticks"), F.round(F.col("vwap") + 1e-9, 5).alias("vwap"), F.round("vwap_dev", 3).alias("vwap_dev"))


@query(duck(f"""with {_SEG} select {KEY}, case when max(case when volume is null then 1 else 0 end) over r = 0 then cast(coalesce(sum(sign(close - pcs) * volume) over r, 0) as double) end as obv
 from (select *, lag(close) over (partition by symbol, session order by hr) as pcs from q) window r as ({RUN})"""))
def e11_on_balance_volume(spark, sf):
    bars, w = view(spark, sf, "bars"), over(DAY, ["hr"])
    step = F.signum(F.col("close") - F.lag("close").over(Window.partitionBy(*DAY).orderBy("hr"))) * F.col("volume")
    known = F.max(F.col("volume").isNull().cast("int")).over(w) == 0
    return keyed(bars.withColumn("step", step), F.when(known, F.coalesce(F.sum("step").over(w), F.lit(0.0))).cast("double").alias("obv"))


@query(duck(f"""with c as (select *, min(hr) over r <= 1 as seen from bars window r as ({RUN}))
 select {KEY}, case when seen then first(open) over r end as s_open, case when seen then max(high) over r end as s_high, case when seen then min(low) over r end as s_low,
 case when seen and max(case when volume is null then 1 else 0 end) over r = 0 then cast(sum(volume) over r as double) end as s_volume,
 case when seen and hr >= 2 then max(case when hr < 2 then high end) over r end as or_high, case when seen and hr >= 2 then min(case when hr < 2 then low end) over r end as or_low
 from c window r as ({RUN})"""))
def e12_session_context(spark, sf):
    return keyed(session_context(view(spark, sf, "bars"), DAY, "hr", 2, 1), "s_open", "s_high", "s_low", F.col("s_volume").cast("double").alias("s_volume"), "or_high", "or_low")


@query(duck(f"""select {KEY}, round(close / lag(close, 1) over w - 1, 6) as return_1, round(close / lag(close, 5) over w - 1, 6) as return_5
 from bars window w as (partition by symbol, session order by hr)"""))
def e14_lagged_returns(spark, sf):
    w = Window.partitionBy(*DAY).orderBy("hr")
    back = lambda k: r6(ratio_change(F.col("close"), F.lag("close", k).over(w))).alias(f"return_{k}")
    return keyed(view(spark, sf, "bars"), back(1), back(5))


@query(duck(f"""with {_SEG} select {KEY}, cast(segment as bigint) as segment, case when i > 3 then round(close / lag(close, 3) over w - 1, 6) end as return_3,
 case when count(ln(close / pc)) over v = 3 then round(sqrt(sum(power(ln(close / pc), 2)) over v), 6) end as realised
 from q window w as (partition by symbol, session, segment order by hr), v as (partition by symbol, session, segment order by hr rows between 2 preceding and current row)"""))
def e15_clock_windows(spark, sf):
    bars = segments(view(spark, sf, "bars"), DAY, "hr")
    w = Window.partitionBy(*RUNS).orderBy("hr")
    bars = bars.withColumn("log", F.log(F.col("close") / F.lag("close").over(w)))
    v = w.rowsBetween(-2, 0)
    return keyed(bars, "segment", r6(ratio_change(F.col("close"), F.lag("close", 3).over(w))).alias("return_3"), r6(full(F.sqrt(F.sum(F.col("log") ** 2).over(v)), v, F.col("log"), 3)).alias("realised"))


@query(duck(f"""select {KEY}, case when count(volume) over w = 5 then round(volume / nullif(avg(volume) over w, 0), 6) end as volume_ratio
 from bars window w as (partition by symbol, session order by hr rows between 5 preceding and 1 preceding)"""))
def e17_volume_ratio(spark, sf):
    w = over(DAY, ["hr"], -5, -1)
    return keyed(view(spark, sf, "bars"), r6(full(safe_divide(F.col("volume"), F.avg("volume").over(w)), w, F.col("volume"), 5)).alias("volume_ratio"))


@query(duck(f"""with s as (select *, avg(close) over w as m, stddev_pop(close) over w as d, count(*) over w as n, max(high) over w as hi, min(low) over w as lo
   from bars window w as (partition by symbol, session order by hr rows between 4 preceding and current row))
 select {KEY}, case when n = 5 then round(m + 2 * d, 6) end as upper, case when n = 5 then round(m - 2 * d, 6) end as lower,
 case when n = 5 and d > 0 then round((close - m + 2 * d) / (4 * d), 5) end as percent_b, case when n = 5 then round(4 * d / m, 6) end as bandwidth,
 case when n = 5 then hi end as rolling_high, case when n = 5 then lo end as rolling_low, case when n = 5 then round(hi / close - 1, 6) end as below_high from s"""))
def e18_bollinger_and_extremes(spark, sf):
    bars = rolling(view(spark, sf, "bars"), DAY, ["hr"], "close", N, "c")
    m, d, w = F.col("c_mean"), F.col("c_dev"), over(DAY, ["hr"], -4, 0)
    hi, lo = full(F.max("high").over(w), w, F.col("close"), N), full(F.min("low").over(w), w, F.col("close"), N)
    return keyed(bars, r6(m + 2 * d).alias("upper"), r6(m - 2 * d).alias("lower"), F.round(F.when(d > 0, (F.col("close") - m + 2 * d) / (4 * d)), 5).alias("percent_b"),
                 r6(4 * d / m).alias("bandwidth"), hi.alias("rolling_high"), lo.alias("rolling_low"), r6(hi / F.col("close") - 1).alias("below_high"))


@query(duck(f"""select {KEY}, case when max(high) over r > min(low) over r then round((close - min(low) over r) / (max(high) over r - min(low) over r), 6) end as position,
 round((max(high) over r - min(low) over r) / close, 6) as range_share from bars window r as ({RUN})"""))
def e20_session_position(spark, sf):
    w = over(DAY, ["hr"])
    high, low = F.max("high").over(w), F.min("low").over(w)
    return keyed(view(spark, sf, "bars"), r6(safe_divide(F.col("close") - low, high - low)).alias("position"), r6((high - low) / F.col("close")).alias("range_share"))


@query(duck("""with f as (select symbol, session, min_by(open, hr) as open, max(high) as high, min(low) as low, max_by(close, hr) as close, count(*) >= 12 as complete from bars group by symbol, session)
 select symbol, cast(session as varchar) as session, case when lag(complete) over w then round(lag(close) over w / lag(open) over w - 1, 6) end as previous_return,
 case when count(*) over v = 3 and min(complete) over v then round((max(high) over v - min(low) over v) / lag(close) over w, 6) end as range_3 from f
 window w as (partition by symbol order by session), v as (partition by symbol order by session rows between 3 preceding and 1 preceding)"""))
def e21_prior_sessions(spark, sf):
    frames = view(spark, sf, "bars").groupBy(*DAY).agg(F.min_by("open", "hr").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "hr").alias("close"), (F.count("*") >= 12).alias("complete"))
    w, v = Window.partitionBy("symbol").orderBy("session"), over(["symbol"], ["session"], -3, -1)
    span = (F.max("high").over(v) - F.min("low").over(v)) / F.lag("close").over(w)
    return frames.select("symbol", F.col("session").cast("string").alias("session"), r6(F.when(F.lag("complete").over(w), F.lag("close").over(w) / F.lag("open").over(w) - 1)).alias("previous_return"),
                         r6(F.when((F.count("*").over(v) == 3) & F.min("complete").over(v), span)).alias("range_3"))


@query(duck(f"""select {KEY}, case when count(n_ticks) over w = 5 then round(n_ticks / avg(n_ticks) over w, 6) end as relative_volume
 from bars window w as (partition by symbol, hr order by session rows between 5 preceding and 1 preceding)"""))
def e22_same_minute_volume(spark, sf):
    w = over(["symbol", "hr"], ["session"], -5, -1)
    return keyed(view(spark, sf, "bars"), r6(full(F.col("n_ticks") / F.avg("n_ticks").over(w), w, F.col("n_ticks"), 5)).alias("relative_volume"))


@query(duck("""with k as (select distinct symbol, session from bars), g as (select symbol, session, cast(unnest(range(24)) as int) as hr from k),
 j as (select g.*, b.close, b.open, b.n_ticks from g left join bars b using (symbol, session, hr)),
 f as (select *, count(close) over (partition by symbol, session) as known, last_value(close ignore nulls) over (partition by symbol, session order by hr rows between unbounded preceding and current row) as carried,
   first_value(open ignore nulls) over (partition by symbol, session order by hr rows between current row and unbounded following) as ahead from j)
 select symbol, cast(session as varchar) as session, hr, coalesce(carried, ahead) as close, coalesce(n_ticks, 0) as volume, close is null as filled from f where known >= 12"""))
def e28_quiet_fill(spark, sf):
    bars = view(spark, sf, "bars")
    spine = bars.select(*DAY).distinct().withColumn("hr", F.explode(F.sequence(F.lit(0), F.lit(23))))
    back = over(DAY, ["hr"])
    ahead = Window.partitionBy(*DAY).orderBy("hr").rowsBetween(0, Window.unboundedFollowing)
    j = spine.join(bars.select(*DAY, "hr", "open", "close", "n_ticks"), [*DAY, "hr"], "left")
    j = j.withColumn("known", F.count("close").over(Window.partitionBy(*DAY)))
    price = F.coalesce(F.last("close", True).over(back), F.first("open", True).over(ahead))
    return keyed(j.withColumn("price", price).where("known >= 12"), F.col("price").alias("close"), F.coalesce("n_ticks", F.lit(0)).alias("volume"), F.col("close").isNull().alias("filled"))


DAILY = "symbol, cast(session as varchar) as session"


def daily_keyed(df, *columns):
    return df.select("symbol", F.col("session").cast("timestamp").cast("string").alias("session"), *columns)


DAILY = "symbol, cast(cast(session as timestamp) as varchar) as session"


@query(duck(f"""with r as (select *, close / lag(close) over (partition by symbol order by session) - 1 as ret from daily),
 m as (select session, avg(ret) as mkt from r group by session), j as (select * from r join m using (session))
 select {DAILY}, case when count(ret) over w = 12 then round(covar_samp(ret, mkt) over w / nullif(var_samp(mkt) over w, 0), 4) end as beta
 from j window w as (partition by symbol order by session rows between 11 preceding and current row)"""))
def e30_beta(spark, sf):
    d = view(spark, sf, "daily")
    d = d.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session")) - 1)
    j = d.join(d.groupBy("session").agg(F.avg("ret").alias("mkt")), "session")
    w = over(["symbol"], ["session"], -11, 0)
    return daily_keyed(j, F.round(full(safe_divide(F.covar_samp("ret", "mkt").over(w), F.var_samp("mkt").over(w)), w, F.col("ret"), 12), 4).alias("beta"))


@query(duck(f"""with r as (select *, close / lag(close) over s - 1 as ret, volume / avg(volume) over (partition by symbol order by session rows between 6 preceding and 1 preceding) as vr,
   open / lag(close) over s - 1 as overnight, close / open - 1 as intraday from daily window s as (partition by symbol order by session))
 select {DAILY}, round(close / lag(close, 5) over s - 1, 6) as return_5, case when count(ret) over w = 6 then round(stddev_samp(ret) over w, 6) end as volatility, round(vr, 6) as volume_ratio,
 case when count(overnight) over w = 6 then round(avg(overnight) over w, 6) end as overnight_mean, case when count(overnight) over w = 6 then round(avg(intraday) over w, 6) end as intraday_mean
 from r window s as (partition by symbol order by session), w as (partition by symbol order by session rows between 5 preceding and current row)"""))
def e31_daily_features(spark, sf):
    s, w, v = Window.partitionBy("symbol").orderBy("session"), over(["symbol"], ["session"], -5, 0), over(["symbol"], ["session"], -6, -1)
    d = view(spark, sf, "daily")
    d = d.select("*", (F.col("close") / F.lag("close").over(s) - 1).alias("ret"), (F.col("open") / F.lag("close").over(s) - 1).alias("overnight"), (F.col("close") / F.col("open") - 1).alias("intraday"))
    return daily_keyed(d, r6(F.col("close") / F.lag("close", 5).over(s) - 1).alias("return_5"), r6(full(F.stddev_samp("ret").over(w), w, F.col("ret"), 6)).alias("volatility"),
                       r6(F.col("volume") / F.avg("volume").over(v)).alias("volume_ratio"), r6(full(F.avg("overnight").over(w), w, F.col("overnight"), 6)).alias("overnight_mean"),
                       r6(full(F.avg("intraday").over(w), w, F.col("overnight"), 6)).alias("intraday_mean"))


@query(duck(f"""with a as (select *, case when n % 11 = 0 then 0.5 else 1 end as ratio from daily)
 select {DAILY}, round(exp(coalesce(sum(ln(ratio)) over w, 0)), 8) as factor, round(close * exp(coalesce(sum(ln(ratio)) over w, 0)) + 1e-10, 8) as adjusted_close,
 round(volume / exp(coalesce(sum(ln(ratio)) over w, 0)), 4) as adjusted_volume from a window w as (partition by symbol order by session rows between 1 following and unbounded following)"""))
def e37_back_adjustment(spark, sf):
    d = view(spark, sf, "daily").withColumn("ratio", F.when(F.col("n") % 11 == 0, 0.5).otherwise(1.0))
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(1, Window.unboundedFollowing)
    factor = F.exp(F.coalesce(F.sum(F.log("ratio")).over(w), F.lit(0.0)))
    return daily_keyed(d, F.round(factor, 8).alias("factor"), F.round(F.col("close") * factor + 1e-10, 8).alias("adjusted_close"), F.round(F.col("volume") / factor, 4).alias("adjusted_volume"))


@query(duck("""with v as (select symbol, bar_start, close, case when sum(n_ticks) over r > 0 then sum((high + low + close) / 3 * n_ticks) over r / sum(n_ticks) over r end as vwap
   from bars window r as (partition by symbol, session order by hr rows between unbounded preceding and current row)),
 k as (select *, row_number() over (partition by bar_start order by abs(close / vwap - 1) desc, symbol) as place from v)
 select symbol, cast(bar_start as varchar) as bar_start, cast(place as int) as place, round(close / vwap - 1 + 1e-9, 6) as distance from k where place <= 2"""))
def slice_vwap_leaders(spark, sf):
    """Ticks to bars, session VWAP, and the two symbols of each bar that are farthest from theirs."""
    v = session_vwap(view(spark, sf, "bars"), DAY, "hr", "n_ticks").withColumn("distance", F.col("close") / F.col("vwap") - 1)
    w = Window.partitionBy("bar_start").orderBy(F.abs("distance").desc(), "symbol")
    return v.withColumn("place", F.row_number().over(w)).where("place <= 2").select("symbol", F.col("bar_start").cast("string").alias("bar_start"), "place", tied("distance").alias("distance"))
