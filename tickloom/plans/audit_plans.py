"""Audits across sources: containment, gaps and actions, official closes, coverage of feeds, staged history, labels, live against final; exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from tickloom.operators.windows import grouped_quantiles, over
from tickloom.plans.feature_plans import DAY, KEY, keyed, r6
from tickloom.plans.option_plans import carried_total
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

PRICE_TOLERANCE = 0.10


def days_of(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*DAY).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.min_by("open", "hr").alias("o"), F.max_by("close", "hr").alias("c"), F.sum("n_ticks").alias("v"))


@query(duck(f"""with d as (select symbol, session, max(high) as h, min(low) as l, min_by(open, hr) as o, max_by(close, hr) as c, sum(n_ticks) as v from bars group by 1, 2), f as (select symbol, session, max(high) as h, min(low) as l, min_by(open, hr) as o, max_by(close, hr) as c, sum(n_ticks) as v from feed group by 1, 2)
 select symbol, count(*) as sessions, count(*) filter (where f.h > d.h + {PRICE_TOLERANCE} or f.l < d.l - {PRICE_TOLERANCE}) as outside, round(median(abs(f.o / d.o - 1)), 6) as open_offset, round(median(abs(f.c / d.c - 1)), 6) as close_offset, round(quantile_cont(f.v / d.v, 0.99), 6) as volume_p99, round(avg((f.v = d.v)::int), 6) as volume_exact from d join f using (symbol, session) group by symbol"""))
def j3_daily_containment(spark, sf):
    """Fine bars against daily ones: range kept within a tolerance, offsets of open and close, share of the volume."""
    j = days_of(view(spark, sf, "bars")).alias("d").join(days_of(view(spark, sf, "feed")).alias("f"), DAY)
    out = (F.col("f.h") > F.col("d.h") + PRICE_TOLERANCE) | (F.col("f.l") < F.col("d.l") - PRICE_TOLERANCE)
    off = lambda c: F.abs(F.col(f"f.{c}") / F.col(f"d.{c}") - 1)
    j = j.select("symbol", out.alias("out"), off("o").alias("open_offset"), off("c").alias("close_offset"), (F.col("f.v") / F.col("d.v")).alias("volume"), (F.col("f.v") == F.col("d.v")).cast("int").alias("exact"))
    q = grouped_quantiles(j, ["symbol"], {"open_offset": ("open_offset", 0.5), "close_offset": ("close_offset", 0.5), "volume_p99": ("volume", 0.99)})
    g = j.groupBy("symbol").agg(F.count("*").alias("sessions"), F.count_if("out").alias("outside"), r6(F.avg("exact")).alias("volume_exact"))
    return g.join(q, "symbol").select("symbol", "sessions", "outside", "volume_exact", *[r6(c).alias(c) for c in ("open_offset", "close_offset", "volume_p99")])


GAP, EXCESS = 0.5, 0.3


@query(duck(f"""with g as (select symbol, session, idx, ln(open / lag(close) over (partition by symbol order by idx)) as gap from daily), m as (select session, avg(gap) as mkt from g where symbol < 8 group by session),
 a as (select distinct cast(o_custkey % 25 as int) as symbol, date_trunc('month', o_orderdate) as ex, case when o_orderkey % 3 = 0 then 'split' else 'dividend' end as kind from orders where o_orderkey % 41 = 0),
 j as (select g.*, gap - coalesce(mkt, 0) as net, exists (select 1 from a where a.symbol = g.symbol and a.ex = g.session and kind = 'split') as structural from g left join m using (session) where gap is not null)
 select symbol, count(*) as n, count(*) filter (where abs(gap) > {GAP}) as gaps, count(*) filter (where abs(gap) > {GAP} and not structural) as unexplained, count(*) filter (where structural and abs(net) > {EXCESS}) as action_breaks from j group by symbol"""))
def j4_unexplained_gaps(spark, sf):
    """Overnight gaps, those no structural action explains, and actions whose gap stays beyond the market's."""
    d = view(spark, sf, "daily")
    g = d.select("symbol", "session", F.log(F.col("open") / F.lag("close").over(Window.partitionBy("symbol").orderBy("idx"))).alias("gap")).where("gap is not null")
    m = g.where("symbol < 8").groupBy("session").agg(F.avg("gap").alias("mkt"))
    o = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 41 = 0 and o_orderkey % 3 = 0")
    a = o.select((F.col("o_custkey") % 25).cast("int").alias("symbol"), F.date_trunc("month", "o_orderdate").alias("session")).distinct().withColumn("structural", F.lit(True))
    j = g.withColumn("session", F.col("session").cast("timestamp")).join(m.withColumn("session", F.col("session").cast("timestamp")), "session", "left").join(a, ["symbol", "session"], "left")
    known, net = F.coalesce("structural", F.lit(False)), F.col("gap") - F.coalesce("mkt", F.lit(0.0))
    large = F.abs("gap") > GAP
    return j.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(large).alias("gaps"), F.count_if(large & ~known).alias("unexplained"), F.count_if(known & (F.abs(net) > EXCESS)).alias("action_breaks"))


@query(duck("""with u as (select distinct symbol, yr, round(settle, 2) as price, case when symbol % 6 = 0 then 'index' else 'stock' end as kind from contracts where kind = 'F' and expiry_no = 0), c as (select symbol, yr, round(max(settle), 2) + case when symbol % 4 = 1 then 0.01 else 0 end as official from contracts where kind = 'F' and expiry_no = 0 and yr <> 1996 group by 1, 2)
 select u.kind, count(*) filter (where official is null) as no_close, count(official) as compared, count(*) filter (where abs(price - official) < 0.005) as equal_ from u left join c using (symbol, yr) group by u.kind"""))
def j6_official_closes(spark, sf):
    """Distinct reported prices of underlyings against the official closes of their kind and session."""
    f = view(spark, sf, "contracts").where("kind = 'F' and expiry_no = 0")
    u = f.select("symbol", "yr", F.round("settle", 2).alias("price"), F.when(F.col("symbol") % 6 == 0, "index").otherwise("stock").alias("kind")).distinct()
    c = f.where("yr <> 1996").groupBy("symbol", "yr").agg((F.round(F.max("settle"), 2) + F.when(F.col("symbol") % 4 == 1, 0.01).otherwise(0.0)).alias("official"))
    j = u.join(c, ["symbol", "yr"], "left")
    return j.groupBy("kind").agg(F.count_if(F.col("official").isNull()).alias("no_close"), F.count("official").alias("compared"), F.count_if(F.abs(F.col("price") - F.col("official")) < 0.005).alias("equal_"))


@query(duck("""with v as (select session, stddev_samp(close) as iv from bars where symbol = 'click' group by 1), x as (select session, avg(close) as level_ from bars where symbol = 'error' group by 1), j as (select * from v join x using (session) where iv is not null)
 select count(*) as pairs, round(corr(iv, level_), 6) as rho, round(median(level_ - iv), 6) as median_gap, round(quantile_cont(level_ - iv, 0.05), 6) as p5, round(quantile_cont(level_ - iv, 0.95), 6) as p95 from j"""))
def j8_volatility_against_index(spark, sf):
    """One value a session on each side: correlation and the spread of their difference."""
    b = view(spark, sf, "bars")
    v = b.where("symbol = 'click'").groupBy("session").agg(F.stddev_samp("close").alias("iv")).where("iv is not null")
    x = b.where("symbol = 'error'").groupBy("session").agg(F.avg("close").alias("level"))
    gap = F.col("level") - F.col("iv")
    return v.join(x, "session").agg(F.count("*").alias("pairs"), r6(F.corr("iv", "level")).alias("rho"), r6(F.median(gap)).alias("median_gap"), r6(F.percentile(gap, 0.05)).alias("p5"), r6(F.percentile(gap, 0.95)).alias("p95"))


@query(duck("""with s as (select distinct symbol, session from bars), w as (select *, case when date_part('day', session) % 10 = 0 then 12 else 24 end as due from s), p as (select 'first' as provider, symbol, session, hr from bars union all select 'second', symbol, session, hr from feed), k as (select * from w, (select unnest(['first', 'second']) as provider)),
 c as (select k.provider, k.symbol, k.session, k.due, count(p.hr) filter (where p.hr < due) as held, count(p.hr) filter (where p.hr >= due) as beyond, count(p.hr) filter (where p.hr < least(due, 20)) as early from k left join p on k.provider = p.provider and k.symbol = p.symbol and k.session = p.session group by all)
 select provider, symbol, sum(due - held)::bigint as missing, sum(least(due, 20) - early)::bigint as missing_early, count(*) filter (where held = due) as complete, count(*) filter (where held = 0) as empty_, sum(beyond)::bigint as outside from c group by 1, 2"""))
def j10_coverage_by_feed(spark, sf):
    """Bars of each feed against the windows due on the sessions that any has."""
    due = F.when(F.dayofmonth("session") % 10 == 0, 12).otherwise(24)
    both = view(spark, sf, "bars").select(*DAY, "hr", F.lit("first").alias("provider")).unionByName(view(spark, sf, "feed").select(*DAY, "hr", F.lit("second").alias("provider")))
    spine = both.select(*DAY).distinct().withColumn("provider", F.explode(F.array(F.lit("first"), F.lit("second"))))
    held = both.groupBy("provider", *DAY).agg(F.count_if(F.col("hr") < due).alias("held"), F.count_if(F.col("hr") >= due).alias("beyond"), F.count_if(F.col("hr") < F.least(due, F.lit(20))).alias("early"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = spine.join(held, ["provider", *DAY], "left").select("provider", "symbol", due.alias("due"), zero("held").alias("held"), zero("beyond").alias("beyond"), zero("early").alias("early"))
    return j.groupBy("provider", "symbol").agg(F.sum(F.col("due") - F.col("held")).alias("missing"), F.sum(F.least("due", F.lit(20)) - F.col("early")).alias("missing_early"), F.count_if(F.col("held") == F.col("due")).alias("complete"), F.count_if(F.col("held") == 0).alias("empty_"), F.sum("beyond").alias("outside"))


@query(duck("""with a as (select symbol, yr, max(settle) as close, sum(oi) as oi, sum(contracts) as contracts from contracts where kind = 'F' and expiry_no = 0 group by 1, 2), k as (select symbol, yr, max(settle) * case when symbol % 3 = 0 then 0.5 when yr = 1995 then 1.013 else 1 end as v_close, sum(oi) as v_oi, sum(contracts) * 25 as v_volume from contracts where kind = 'F' and expiry_no = 0 and yr <> 1994 group by 1, 2 union all select symbol, 1900, 1, 1, 1 from x9 where symbol < 5),
 j as (select k.*, close, oi, contracts, round(v_close / close, 4) as ratio from k left join a using (symbol, yr)), r as (select *, count(*) over (partition by symbol, ratio) as times from j where abs(close - v_close) >= 0.005)
 select count(*) filter (where close is null) as no_row, count(close) as compared, count(*) filter (where oi = v_oi) as oi_equal, count(*) filter (where abs(close - v_close) < 0.005) as close_equal, count(*) filter (where abs(close - v_close) < 0.005 and contracts * 25 = v_volume) as volume_equal, (select count(*) from r where times >= 3) as adjusted, (select count(*) from r where times < 3) as unexplained from j"""))
def j12_futures_second_vendor(spark, sf):
    """Near futures against a second vendor: equal closes, open interest and volume; a ratio that recurs is the vendor's adjustment."""
    f = view(spark, sf, "contracts").where("kind = 'F' and expiry_no = 0").groupBy("symbol", "yr").agg(F.max("settle").alias("close"), F.sum("oi").alias("oi"), F.sum("contracts").alias("contracts"))
    factor = F.when(F.col("symbol") % 3 == 0, 0.5).when(F.col("yr") == 1995, 1.013).otherwise(1.0)
    k = f.where("yr <> 1994").select("symbol", "yr", (F.col("close") * factor).alias("v_close"), F.col("oi").alias("v_oi"), (F.col("contracts") * 25).alias("v_volume"))
    lost = view(spark, sf, "x9").where("symbol < 5").select(F.col("symbol").cast("int").alias("symbol"), F.lit(1900).alias("yr"), F.lit(1.0).alias("v_close"), F.lit(1.0).alias("v_oi"), F.lit(1.0).alias("v_volume"))
    j = k.unionByName(lost).join(f, ["symbol", "yr"], "left").withColumn("ratio", F.round(F.col("v_close") / F.col("close"), 4))
    same = F.abs(F.col("close") - F.col("v_close")) < 0.005
    times = F.count_if(~same).over(Window.partitionBy("symbol", "ratio"))
    j = j.withColumn("same", same).withColumn("times", times)
    return j.agg(F.count_if(F.col("close").isNull()).alias("no_row"), F.count("close").alias("compared"), F.count_if(F.col("oi") == F.col("v_oi")).alias("oi_equal"), F.count_if("same").alias("close_equal"), F.count_if(F.col("same") & (F.col("contracts") * 25 == F.col("v_volume"))).alias("volume_equal"),
                 F.count_if(~F.col("same") & (F.col("times") >= 3)).alias("adjusted"), F.count_if(~F.col("same") & (F.col("times") < 3)).alias("unexplained"))


def staged(bars: DataFrame, daily: DataFrame, first: int, last: int) -> DataFrame:
    """bars with `fault`: why a row is to be quarantined (prices, order, volume, twice, outside its session, no daily bar, beyond the daily range), null if none."""
    again = F.row_number().over(Window.partitionBy(*DAY, "hr").orderBy("close", "open")) > 1
    j = bars.withColumn("again", again).join(daily, DAY, "left")
    p = [F.col(c) for c in ("open", "high", "low", "close")]
    known = F.least(*[c.isNotNull().cast("int") for c in p]) == 1
    fault = (
        F.when(~known | (F.least(*p) <= 0), "price").when((F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")), "order").when(F.col("volume") < 0, "volume").when(F.col("again"), "twice")
        .when((F.col("hr") < first) | (F.col("hr") > last), "outside").when(F.col("d_high").isNull(), "no_daily").when((F.col("high") > F.col("d_high") + PRICE_TOLERANCE) | (F.col("low") < F.col("d_low") - PRICE_TOLERANCE), "range")
    )
    return j.withColumn("fault", fault).drop("again")


@query(duck(f"""with h as (select symbol, session, hr, open, case when n_ticks % 17 = 0 then low - 1 else high end as high, low, case when n_ticks % 19 = 0 then null else close end as close, volume from bars union all select symbol, session, hr, open, high, low, close + 0.5, volume from feed where hr = 7),
 d as (select symbol, session, max(high) as d_high, min(low) as d_low from feed where date_part('day', session) <> 13 group by 1, 2), k as (select h.*, row_number() over (partition by h.symbol, h.session, hr order by close nulls first, open) > 1 as again, d_high, d_low from h left join d using (symbol, session)),
 f as (select *, case when close is null or least(open, high, low, close) <= 0 then 'price' when low > least(open, close) or high < greatest(open, close) then 'order' when volume < 0 then 'volume' when again then 'twice' when hr < 2 or hr > 21 then 'outside' when d_high is null then 'no_daily' when high > d_high + {PRICE_TOLERANCE} or low < d_low - {PRICE_TOLERANCE} then 'range' end as fault from k)
 select coalesce(fault, 'good') as state, symbol, count(*) as n, count(distinct session) as sessions from f group by 1, 2"""))
def j14_staged_history(spark, sf):
    """Good rows and rows for quarantine, by reason; write the two apart by `fault`."""
    b = view(spark, sf, "bars").select(*DAY, "hr", "open", F.when(F.col("n_ticks") % 17 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(F.col("n_ticks") % 19 != 0, F.col("close")).alias("close"), "volume")
    feed = view(spark, sf, "feed")
    h = b.unionByName(feed.where("hr = 7").select(*DAY, "hr", "open", "high", "low", (F.col("close") + 0.5).alias("close"), "volume"))
    d = feed.where(F.dayofmonth("session") != 13).groupBy(*DAY).agg(F.max("high").alias("d_high"), F.min("low").alias("d_low"))
    return staged(h, d, 2, 21).groupBy(F.coalesce("fault", F.lit("good")).alias("state"), "symbol").agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"))


@query(duck("""with f as (select a.symbol, a.session, a.hr, count(b.hr) as n, coalesce(max((b.high >= a.close * 1.3)::int), 0) as label from bars a left join bars b on a.symbol = b.symbol and a.session = b.session and b.hr > a.hr and b.hr <= a.hr + 4 group by 1, 2, 3), s as (select symbol, session, hr, case when hr % 11 = 0 then 1 - label else label end as label from f where hr <> 5 union all select symbol, session, 99, 1 from f where hr = 5)
 select symbol, count(*) filter (where s.label = f.label) as agree, count(*) filter (where s.label <> f.label) as differ, count(*) filter (where f.hr is null) as only_stored, count(*) filter (where s.hr is null) as only_computed from f full join s using (symbol, session, hr) group by symbol"""))
def j15_label_recheck(spark, sf):
    """Stored labels against those computed again from the bars: rows of either side that the other lacks show too."""
    w = over(DAY, ["hr"], 1, 4)
    b = view(spark, sf, "bars").withColumn("ahead", F.collect_list(F.struct("hr", "high")).over(w))
    up = F.exists("ahead", lambda a: (a["hr"] <= F.col("hr") + 4) & (a["high"] >= F.col("close") * 1.3))
    f = b.select(*DAY, "hr", up.cast("int").alias("label"))
    s = f.where("hr <> 5").withColumn("label", F.when(F.col("hr") % 11 == 0, 1 - F.col("label")).otherwise(F.col("label"))).unionByName(f.where("hr = 5").select(*DAY, F.lit(99).alias("hr"), F.lit(1).alias("label")))
    j = f.join(s.withColumnRenamed("label", "stored"), [*DAY, "hr"], "full")
    return j.groupBy("symbol").agg(F.count_if(F.col("label") == F.col("stored")).alias("agree"), F.count_if(F.col("label") != F.col("stored")).alias("differ"), F.count_if(F.col("label").isNull()).alias("only_stored"), F.count_if(F.col("stored").isNull()).alias("only_computed"))


@query(duck("""with a as (select symbol, session, hr, open, close, volume, close / (close + 50) as q from feed), b as (select symbol, session, hr, open, close, volume, close / (close + 50) as q from bars)
 select a.symbol, count(*) as live, count(b.hr) as matched, count(*) filter (where a.open = b.open and a.close = b.close and a.volume is not distinct from b.volume) as exact, round(max(abs(a.close - b.close)), 6) as largest, round(max(abs(a.q - b.q)), 7) as prediction_gap, count(*) filter (where (a.q >= 0.5) <> (b.q >= 0.5)) as flipped from a left join b using (symbol, session, hr) group by a.symbol"""))
def j16_live_against_final(spark, sf):
    """Live bars and predictions against the final ones of the same time."""
    key = [*DAY, "hr"]
    side = lambda name: view(spark, sf, name).select(*key, "open", "close", "volume", (F.col("close") / (F.col("close") + 50)).alias("q"))
    a, b = side("feed").alias("a"), side("bars").withColumn("there", F.lit(1)).alias("b")
    same = (F.col("a.open") == F.col("b.open")) & (F.col("a.close") == F.col("b.close")) & F.col("a.volume").eqNullSafe(F.col("b.volume"))
    return a.join(b, key, "left").groupBy("symbol").agg(F.count("*").alias("live"), F.count("there").alias("matched"), F.count_if(same).alias("exact"), r6(F.max(F.abs(F.col("a.close") - F.col("b.close")))).alias("largest"), F.round(F.max(F.abs(F.col("a.q") - F.col("b.q"))), 7).alias("prediction_gap"), F.count_if((F.col("a.q") >= 0.5) != (F.col("b.q") >= 0.5)).alias("flipped"))


@query(duck("""with f as (select symbol, yr, expiry_no, max(oi) as oi from contracts where kind = 'F' group by 1, 2, 3), s as (select distinct symbol, yr from contracts), l as (select distinct symbol, expiry_no from f),
 h as (select s.symbol, s.yr, last_value(f.oi ignore nulls) over (partition by s.symbol, l.expiry_no order by s.yr rows unbounded preceding) as v from s join l using (symbol) left join f using (symbol, yr, expiry_no)), t as (select symbol, yr, case when count(v) = count(*) then sum(v) end as total from h group by 1, 2), c as (select symbol, yr, total / lag(total) over (partition by symbol order by yr) - 1 as official from t),
 v as (select symbol, yr, case when yr % 3 = 0 then official + 0.02 else official end as live, official from c)
 select symbol, count(official) as compared, count(*) filter (where abs(live - official) / greatest(abs(official), 1e-12) <= 1e-9) as equal_, round(max(abs(live - official)), 6) as largest, count(*) filter (where official is null) as withheld from v group by symbol"""))
def j17_live_inputs(spark, sf):
    """Live changes of open interest against those of the official files, relative to them."""
    c = view(spark, sf, "contracts")
    t = carried_total(c.where("kind = 'F'").groupBy("symbol", "yr", "expiry_no").agg(F.max("oi").alias("oi")), c.select("symbol", "yr").distinct(), "symbol", "expiry_no", "yr", "oi")
    official = F.col("total") / F.lag("total").over(Window.partitionBy("symbol").orderBy("yr")) - 1
    v = t.withColumn("official", official).withColumn("live", F.col("official") + F.when(F.col("yr") % 3 == 0, 0.02).otherwise(0.0))
    gap = F.abs(F.col("live") - F.col("official"))
    return v.groupBy("symbol").agg(F.count("official").alias("compared"), F.count_if(gap / F.greatest(F.abs("official"), F.lit(1e-12)) <= 1e-9).alias("equal_"), r6(F.max(gap)).alias("largest"), F.count_if(F.col("official").isNull()).alias("withheld"))


OPEN, CLOSE = 2, 20


def regular(bars: DataFrame, minute: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the regular session, and how many rows of each symbol lie outside it."""
    inside = F.coalesce(F.col(minute).between(first, last), F.lit(False))
    return bars.where(inside), bars.groupBy("symbol").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("rejected"))


@query(duck(f"select symbol, count(*) filter (where hr between {OPEN} and {CLOSE}) as kept, count(*) filter (where hr not between {OPEN} and {CLOSE}) as rejected from bars group by symbol"))
def b5_regular_session(spark, sf):
    return regular(view(spark, sf, "bars"), "hr", OPEN, CLOSE)[1]


def complete(required: list[str], optional: list[str]) -> tuple[Column, Column]:
    """Whether all required inputs are known (neither null nor NaN), and how many optional ones are not."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    ready = F.lit(True)
    for c in required:
        ready = ready & known(c)
    return ready, sum(((~known(c)).cast("int") for c in optional), F.lit(0))


@query(duck("select symbol, idx, volume_ratio_20 is not null and c_3 is not null and rsi14 is not null as ready, (price_vs_vwap_sigma is null)::int + (opening_range_high is null)::int + (minutes is null)::int as optional_missing from snaps"))
def b20_inputs_complete(spark, sf):
    ready, lacking = complete(["volume_ratio_20", "c_3", "rsi14"], ["price_vs_vwap_sigma", "opening_range_high", "minutes"])
    return view(spark, sf, "snaps").select("symbol", "idx", ready.alias("ready"), lacking.alias("optional_missing"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, for files that a query writes and reads again."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top}/{uuid.uuid4().hex}"


def export_wide(df: DataFrame, path: str, by: list[str]) -> None:
    """The feature rows as CSV with a header, null as the empty field, sorted within files by the key."""
    df.repartition("symbol").sortWithinPartitions(*by).write.option("header", True).option("nullValue", "").mode("errorifexists").csv(path)


@query(duck(f"select symbol, count(*) as n, round(sum(close), 4) as close, count(volume) as volumes, min(session)::varchar as first_session from bars group by symbol"))
def a23_wide_export(spark, sf):
    """Features written out wide and read again."""
    at = shared_folder(spark)
    b = view(spark, sf, "bars")
    export_wide(keyed(b, "open", "high", "low", "close", "volume"), at, ["session", "hr"])
    back = spark.read.schema("symbol string, session string, hr int, open double, high double, low double, close double, volume double").csv(at, header=True)
    return back.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("close"), F.count("volume").alias("volumes"), F.min("session").alias("first_session"))


def decisions(bars: DataFrame) -> DataFrame:
    """One row for each side of a decision, with its phase."""
    after = F.lead("close").over(Window.partitionBy(*DAY).orderBy("hr"))
    d = bars.withColumn("next_close", after).where("next_close is not null").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    phase = F.when(F.dayofmonth("session") <= 20, "development").otherwise("holdout")
    return keyed(d, "side", phase.alias("phase"), r6(F.col("side") * (F.col("next_close") / F.col("close") - 1)).alias("outcome"))


@query(duck(f"""with d as (select symbol, session, hr, open, close, lead(close) over (partition by symbol, session order by hr) as next_close from bars), s as (select *, cast(unnest([1, -1]) as int) as side from d where next_close is not null)
 select {KEY}, side, case when date_part('day', session) <= 20 then 'development' else 'holdout' end as phase, round(side * (next_close / close - 1), 6) + 0.0 as outcome from s"""))
def a24_paired_decisions(spark, sf):
    """Both sides of each decision, written in shards by phase and symbol, in order within them, and read again."""
    at = shared_folder(spark)
    d = decisions(view(spark, sf, "bars"))
    d.repartition("phase", "symbol").sortWithinPartitions("session", "hr", "side").write.partitionBy("phase", "symbol").parquet(at)
    return spark.read.schema(d.schema).parquet(at).select("symbol", "session", "hr", "side", "phase", (F.col("outcome") + 0.0).alias("outcome"))
