"""Contract chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.plans.feature_plans import r6
from tickloom.operators.windows import grouped_quantiles
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

UNDERLYING = ["symbol", "session"]
KEY = "symbol, cast(cast(session as timestamp) as varchar) as session"


def chain(spark, sf):
    return view(spark, sf, "x4")


def keyed(df, *columns):
    return df.select("symbol", F.col("session").cast("timestamp").cast("string").alias("session"), *columns)


@query(duck(f"""select {KEY}, round(max(settle) filter (where expiry_no = 0), 6) as near_settle, round(max(settle) filter (where expiry_no = 1), 6) as next_settle, sum(oi) as total_oi,
 round((max(settle) filter (where expiry_no = 1)) / nullif(max(settle) filter (where expiry_no = 0), 0) - 1, 6) as calendar_basis,
 round(100 * coalesce(sum(oi) filter (where expiry_no > 0), 0) / sum(oi), 6) as rollover_pct from x4 where kind = 'F' group by symbol, session"""))
def d5_futures_by_expiry(spark, sf):
    at = lambda k: F.max(F.when(F.col("expiry_no") == k, F.col("settle")))
    later = F.coalesce(F.sum(F.when(F.col("expiry_no") > 0, F.col("oi"))), F.lit(0.0))
    f = chain(spark, sf).where("kind = 'F'").groupBy(*UNDERLYING).agg(
        r6(at(0)).alias("near_settle"), r6(at(1)).alias("next_settle"), F.sum("oi").alias("total_oi"),
        r6(at(1) / F.nullif(at(0), F.lit(0.0)) - 1).alias("calendar_basis"), r6(100 * later / F.sum("oi")).alias("rollover_pct"))
    return keyed(f, "near_settle", "next_settle", "total_oi", "calendar_basis", "rollover_pct")


@query(duck(f"""select {KEY}, round(sum(oi) filter (where opt = 'PE') / nullif(sum(oi) filter (where opt = 'CE'), 0), 6) as pcr_oi,
 round(cast(sum(contracts) filter (where opt = 'PE') as double) / nullif(sum(contracts) filter (where opt = 'CE'), 0), 6) as pcr_contracts,
 round(sum(oi) filter (where opt = 'PE' and expiry_no = 0) / nullif(sum(oi) filter (where opt = 'CE' and expiry_no = 0), 0), 6) as pcr_near from x4 where kind = 'O' group by symbol, session"""))
def d6_put_call_ratios(spark, sf):
    part = lambda c, t: F.sum(F.when(t, F.col(c)))
    put, call, near = F.col("opt") == "PE", F.col("opt") == "CE", F.col("expiry_no") == 0
    return keyed(chain(spark, sf).where("kind = 'O'").groupBy(*UNDERLYING).agg(
        r6(part("oi", put) / F.nullif(part("oi", call), F.lit(0.0))).alias("pcr_oi"),
        r6(part("contracts", put) / F.nullif(part("contracts", call), F.lit(0))).alias("pcr_contracts"),
        r6(part("oi", put & near) / F.nullif(part("oi", call & near), F.lit(0.0))).alias("pcr_near")), "pcr_oi", "pcr_contracts", "pcr_near")


def strikes(spark, sf):
    """One row for each strike of the nearest expiry, calls and puts side by side."""
    one = lambda o, c: F.sum(F.when(F.col("opt") == o, F.col(c)))
    return chain(spark, sf).where("kind = 'O' and expiry_no = 0").groupBy(*UNDERLYING, "strike").agg(
        F.coalesce(one("CE", "oi"), F.lit(0.0)).alias("ce_oi"), F.coalesce(one("PE", "oi"), F.lit(0.0)).alias("pe_oi"), one("CE", "close").alias("ce"), one("PE", "close").alias("pe"))


_STRIKES = """k as (select symbol, session, strike, coalesce(sum(oi) filter (where opt = 'CE'), 0) as ce_oi, coalesce(sum(oi) filter (where opt = 'PE'), 0) as pe_oi,
 sum(close) filter (where opt = 'CE') as ce, sum(close) filter (where opt = 'PE') as pe from x4 where kind = 'O' and expiry_no = 0 group by symbol, session, strike)"""


@query(duck(f"""with {_STRIKES}, p as (select a.symbol, a.session, a.strike, sum(greatest(a.strike - b.strike, 0) * b.ce_oi + greatest(b.strike - a.strike, 0) * b.pe_oi) as payout
   from k a join k b on a.symbol = b.symbol and a.session = b.session group by 1, 2, 3)
 select {KEY}, min_by(strike, (payout, strike)) as max_pain, round(min(payout), 4) as payout from p group by symbol, session"""))
def d7_max_pain(spark, sf):
    k = strikes(spark, sf)
    w = k.select(*UNDERLYING, F.col("strike").alias("other"), "ce_oi", "pe_oi")
    pay = F.greatest(F.col("strike") - F.col("other"), F.lit(0.0)) * F.col("ce_oi") + F.greatest(F.col("other") - F.col("strike"), F.lit(0.0)) * F.col("pe_oi")
    p = k.select(*UNDERLYING, "strike").join(w, UNDERLYING).groupBy(*UNDERLYING, "strike").agg(F.sum(pay).alias("payout"))
    return keyed(p.groupBy(*UNDERLYING).agg(F.min_by("strike", F.struct("payout", "strike")).alias("max_pain"), F.round(F.min("payout"), 4).alias("payout")), "max_pain", "payout")


@query(duck(f"""with {_STRIKES} select {KEY}, max_by(strike, (ce_oi, -strike)) as call_wall, max_by(strike, (pe_oi, -strike)) as put_wall, max(ce_oi) as call_oi, max(pe_oi) as put_oi from k group by symbol, session"""))
def d8_oi_walls(spark, sf):
    wall = lambda c: F.max_by("strike", F.struct(F.col(c), -F.col("strike")))
    return keyed(strikes(spark, sf).groupBy(*UNDERLYING).agg(wall("ce_oi").alias("call_wall"), wall("pe_oi").alias("put_wall"), F.max("ce_oi").alias("call_oi"), F.max("pe_oi").alias("put_oi")),
                 "call_wall", "put_wall", "call_oi", "put_oi")


@query(duck(f"""with {_STRIKES} select {KEY}, min_by(strike, (abs(ce - pe), strike)) as strike, round(min_by(strike + ce - pe, (abs(ce - pe), strike)), 6) as forward, count(*) as pairs,
 round(sum((ce - pe) * (ce_oi + pe_oi)) / sum(ce_oi + pe_oi), 6) as weighted_gap from k where ce is not null and pe is not null group by symbol, session"""))
def c15_parity_forward(spark, sf):
    k = strikes(spark, sf).where("ce is not null and pe is not null")
    gap, size = F.col("ce") - F.col("pe"), F.col("ce_oi") + F.col("pe_oi")
    key = F.struct(F.abs(gap), F.col("strike"))
    return keyed(k.groupBy(*UNDERLYING).agg(F.min_by("strike", key).alias("strike"), r6(F.min_by(F.col("strike") + gap, key)).alias("forward"), F.count("*").alias("pairs"), r6(F.sum(gap * size) / F.sum(size)).alias("weighted_gap")),
                 "strike", "forward", "pairs", "weighted_gap")


@query(duck("""with c as (select *, lag(oi) over w as before, lag(session) over w as ps from x4 window w as (partition by symbol, expiry_no, kind, opt, strike order by session))
 select symbol, kind, count(*) as n, count(*) filter (where before is not null and ps = session - interval 1 year) as direct, count(*) filter (where before is not null and ps <> session - interval 1 year) as after_gap,
 round(sum(oi - before) filter (where ps = session - interval 1 year), 6) as change from c group by symbol, kind"""))
def j5_oi_identity(spark, sf):
    w = Window.partitionBy("symbol", "expiry_no", "kind", "opt", "strike").orderBy("session")
    c = chain(spark, sf).withColumn("before", F.lag("oi").over(w)).withColumn("years", F.year("session") - F.year(F.lag("session").over(w)))
    return c.groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("years") == 1).alias("direct"), F.count_if(F.col("years") != 1).alias("after_gap"),
                                           r6(F.sum(F.when(F.col("years") == 1, F.col("oi") - F.col("before")))).alias("change"))


@query(duck(f"""with {_STRIKES} select symbol, count(*) as pairs, round(median(ce - pe), 6) as median_gap, round(quantile_cont(abs(ce - pe), 0.95), 6) as p95 from k where ce is not null and pe is not null group by symbol"""))
def j7_parity_distribution(spark, sf):
    k = strikes(spark, sf).where("ce is not null and pe is not null").withColumn("gap", F.col("ce") - F.col("pe"))
    q = grouped_quantiles(k.withColumn("size", F.abs("gap")), ["symbol"], {"median_gap": ("gap", 0.5), "p95": ("size", 0.95)})
    return k.groupBy("symbol").agg(F.count("*").alias("pairs")).join(q, "symbol").select("symbol", "pairs", r6("median_gap").alias("median_gap"), r6("p95").alias("p95"))


@query(duck("""with l as (select *, extract(year from session) as y from x4), old as (select * from l where y <= 1995), new as (select * from l where y >= 1995 and symbol % 2 = 0),
 d as (select distinct symbol, session from new) select symbol, cast(cast(session as timestamp) as varchar) as session, kind, 'new' as format, count(*) as n, sum(oi) as oi from new group by all
 union all select o.symbol, cast(cast(o.session as timestamp) as varchar), kind, 'old', count(*), sum(oi) from old o where not exists (select 1 from d where d.symbol = o.symbol and d.session = o.session) group by 1, 2, 3"""))
def a8_prefer_new_format(spark, sf):
    c = chain(spark, sf).withColumn("y", F.year("session"))
    old, new = c.where("y <= 1995"), c.where("y >= 1995 and symbol % 2 = 0").withColumn("format", F.lit("new"))
    rows = new.unionByName(old.join(new.select(*UNDERLYING).distinct(), UNDERLYING, "left_anti").withColumn("format", F.lit("old")))
    return rows.groupBy("symbol", F.col("session").cast("timestamp").cast("string").alias("session"), "kind", "format").agg(F.count("*").alias("n"), F.sum("oi").alias("oi"))
