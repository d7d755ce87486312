"""Ingest jobs, universes and data-quality audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import divide
from tickloom.plans.feature_plans import DAY, KEY, keyed, r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view


def latest(df, key, order):
    """One row of each key: the first by `order`."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


@query(duck(f"select {KEY}, open, high, low, close from bars where bar_start >= timestamp '2024-01-05 06:00:00' and bar_start + interval 1 hour <= timestamp '2024-01-20 00:00:00'"))
def a2_range_load(spark, sf):
    at = F.col("bar_start").cast("timestamp")
    return keyed(view(spark, sf, "bars").where((at >= "2024-01-05 06:00:00") & (at <= F.to_timestamp(F.lit("2024-01-19 23:00:00")))), "open", "high", "low", "close")


@query(duck(f"""with u as (select *, 1 as load from bars union all select *, 2 from feed), k as (select *, row_number() over (partition by symbol, bar_start order by load desc) as rn from u)
 select {KEY}, load, close from k where rn = 1"""))
def a3_upsert(spark, sf):
    both = view(spark, sf, "bars").withColumn("load", F.lit(1)).unionByName(view(spark, sf, "feed").withColumn("load", F.lit(2)))
    return keyed(latest(both, ["symbol", "bar_start"], [F.col("load").desc()]), "load", "close")


@query(duck("""with h as (select symbol, min(bar_start) as a, max(bar_start) as b from feed where n_ticks > 2 group by symbol)
 select symbol, case when a > timestamp '2024-01-01 00:00:00' then cast(a as varchar) end as load_before, case when b < timestamp '2024-01-30 23:00:00' then cast(b as varchar) end as load_after from h"""))
def a4_coverage_gaps(spark, sf):
    h = view(spark, sf, "feed").where("n_ticks > 2").groupBy("symbol").agg(F.min(F.col("bar_start").cast("timestamp")).alias("a"), F.max(F.col("bar_start").cast("timestamp")).alias("b"))
    return h.select("symbol", F.when(F.col("a") > "2024-01-01 00:00:00", F.col("a").cast("string")).alias("load_before"), F.when(F.col("b") < "2024-01-30 23:00:00", F.col("b").cast("string")).alias("load_after"))


@query(duck("""with k as (select symbol, cast(disseminated_at as date) as d, filing_id, subject, row_number() over (partition by symbol, cast(disseminated_at as date) order by case subject when 'purchase' then 0 when 'signup' then 1 else 2 end, filing_id) as rn from x6)
 select symbol, cast(d as varchar) as day, filing_id, subject from k where rn = 1"""))
def a9_series_priority(spark, sf):
    x = view(spark, sf, "x6").withColumn("d", F.to_date("disseminated_at"))
    order = F.when(F.col("subject") == "purchase", 0).when(F.col("subject") == "signup", 1).otherwise(2)
    return latest(x, ["symbol", "d"], [order, "filing_id"]).select("symbol", F.col("d").cast("string").alias("day"), "filing_id", "subject")


@query(duck("""select filing_id, symbol, sha256(concat_ws('|', cast(symbol as varchar), subject, cast(filing_id as varchar))) as key, json_extract_string(raw, '$.page') as page, length(raw) as raw_length from x6"""))
def a16_filings(spark, sf):
    return view(spark, sf, "x6").select("filing_id", "symbol", F.sha2(F.concat_ws("|", F.col("symbol").cast("string"), "subject", F.col("filing_id").cast("string")), 256).alias("key"),
                                        F.get_json_object("raw", "$.page").alias("page"), F.length("raw").cast("bigint").alias("raw_length"))


@query(duck("""with k as (select *, row_number() over (partition by symbol, subject, cast(disseminated_at as date) order by disseminated_at, filing_id) as rn from x6)
 select symbol, subject, filing_id, cast(greatest(disseminated_at, cast(disseminated_at as date) + interval 9 hour) as varchar) as public_at from k where rn = 1"""))
def a17_filing_dedup(spark, sf):
    x = view(spark, sf, "x6").withColumn("at", F.col("disseminated_at").cast("timestamp"))
    first = latest(x, ["symbol", "subject", F.to_date("at")], ["at", "filing_id"])
    opened = F.date_trunc("day", "at") + F.expr("interval 9 hours")
    return first.select("symbol", "subject", "filing_id", F.greatest("at", opened).cast("string").alias("public_at"))


@query(duck("""with k as (select *, row_number() over (partition by series order by market_cap desc, symbol) as place from x9 where industry_id % 2 = 0)
 select symbol, series, cast(place as int) as place, case when place <= 20 then 'target' else 'reserve' end as status from k where place <= 25"""))
def a19_universe(spark, sf):
    k = view(spark, sf, "x9").where("industry_id % 2 = 0").withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy(F.col("market_cap").desc(), "symbol")))
    return k.where("place <= 25").select("symbol", "series", "place", F.when(F.col("place") <= 20, "target").otherwise("reserve").alias("status"))


@query(duck("""with k as (select distinct symbol from bars), d as (select distinct session from bars), a as (select k.symbol, d.session from k cross join d), h as (select distinct symbol, session from feed where n_ticks > 6)
 select a.symbol, cast(a.session as varchar) as session from a left join h using (symbol, session) where h.symbol is null"""))
def a22_missing_sessions(spark, sf):
    bars = view(spark, sf, "bars")
    sessions = bars.agg(F.array_sort(F.collect_set("session")).alias("all"))  # a calendar: one entry a day
    want = bars.select("symbol").distinct().crossJoin(F.broadcast(sessions)).select("symbol", F.explode("all").alias("session"))
    have = view(spark, sf, "feed").where("n_ticks > 6").select(*DAY).distinct()
    return want.join(have, DAY, "left_anti").select("symbol", F.col("session").cast("string").alias("session"))


@query(duck("""select symbol, count(*) as total, count(*) filter (where price > 0 and user_id >= 0) as good, count(*) filter (where not (price > 0 and user_id >= 0)) as bad, min(price) filter (where price > 0) as least from x1 group by symbol"""))
def a25_tick_split(spark, sf):
    good = (F.col("price") > 0) & (F.col("user_id") >= 0)
    return view(spark, sf, "x1").groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.min(F.when(F.col("price") > 0, F.col("price"))).alias("least"))


@query(duck("""select symbol, count(*) as rows_, count(*) filter (where high < low) as inverted, count(*) filter (where volume is null) as unknown_volume, count(*) filter (where n_ticks = 1) as single_tick,
 count(*) filter (where cast(round(close * 100) as bigint) % 5 <> 0) as off_grid from bars group by symbol"""))
def j1_schema_issues(spark, sf):
    return view(spark, sf, "bars").groupBy("symbol").agg(
        F.count("*").alias("rows_"), F.count_if(F.col("high") < F.col("low")).alias("inverted"), F.count_if(F.col("volume").isNull()).alias("unknown_volume"), F.count_if(F.col("n_ticks") == 1).alias("single_tick"),
        F.count_if(F.round(F.col("close") * 100).cast("bigint") % 5 != 0).alias("off_grid"))


@query(duck("""with s as (select *, ln(close / lag(close) over (partition by symbol, session order by hr)) as jump from bars), a as (select symbol, session, count(*) as n, 24 - count(*) as missing, coalesce(max(abs(jump)), 0) as top, avg(case when volume is null then 1.0 else 0 end) as unknown from s group by symbol, session)
 select symbol, cast(session as varchar) as session, n, missing, round(top, 6) as largest_jump, round(unknown, 6) as unknown_share, concat_ws(',', case when missing > 2 then 'missing' end, case when top > 4 then 'jump' end, case when unknown > 0.2 then 'volume' end) as reasons from a"""))
def j2_session_audit(spark, sf):
    s = view(spark, sf, "bars").withColumn("jump", F.log(F.col("close") / F.lag("close").over(Window.partitionBy(*DAY).orderBy("hr"))))
    a = s.groupBy(*DAY).agg(F.count("*").alias("n"), (24 - F.count("*")).alias("missing"), F.coalesce(F.max(F.abs("jump")), F.lit(0.0)).alias("top"), F.avg(F.col("volume").isNull().cast("double")).alias("unknown"))
    reasons = F.concat_ws(",", F.when(F.col("missing") > 2, "missing"), F.when(F.col("top") > 4, "jump"), F.when(F.col("unknown") > 0.2, "volume"))
    return a.select("symbol", F.col("session").cast("string").alias("session"), "n", "missing", r6("top").alias("largest_jump"), r6("unknown").alias("unknown_share"), reasons.alias("reasons"))


@query(duck("""with a as (select symbol, bar_start, close from bars), b as (select symbol, bar_start, close from feed) select coalesce(a.symbol, b.symbol) as symbol, count(*) filter (where a.close is not distinct from b.close) as equal_,
 count(*) filter (where a.close is distinct from b.close and b.symbol is not null) as different, count(*) filter (where b.symbol is null) as absent from a full join b on a.symbol = b.symbol and a.bar_start = b.bar_start group by 1"""))
def j11_format_equality(spark, sf):
    a, b = view(spark, sf, "bars").select("symbol", "bar_start", "close"), view(spark, sf, "feed").select("symbol", "bar_start", F.col("close").alias("other"), F.lit(True).alias("there"))
    j = a.join(b, ["symbol", "bar_start"], "full_outer")
    same = F.col("close").eqNullSafe(F.col("other"))
    return j.groupBy("symbol").agg(F.count_if(same).alias("equal_"), F.count_if(~same & F.col("there").isNotNull()).alias("different"), F.count_if(F.col("there").isNull()).alias("absent"))


@query(duck("""with e as (select symbol, session, count(*) as have, count(*) filter (where high / low > 500) as quarantined from bars group by 1, 2)
 select symbol, cast(sum(24) as bigint) as expected, cast(sum(have - quarantined) as bigint) as usable, cast(sum(quarantined) as bigint) as quarantined, cast(sum(24 - have) as bigint) as missing, sum(24) = sum(have - quarantined) + sum(quarantined) + sum(24 - have) as balanced from e group by symbol"""))
def j13_slot_accounting(spark, sf):
    e = view(spark, sf, "bars").groupBy(*DAY).agg(F.count("*").alias("have"), F.count_if(divide(F.col("high"), F.col("low")) > 500).alias("q"))
    total = F.count("*") * 24
    usable, missing = F.sum(F.col("have") - F.col("q")), F.sum(24 - F.col("have"))
    return e.groupBy("symbol").agg(total.alias("expected"), usable.alias("usable"), F.sum("q").alias("quarantined"), missing.alias("missing"), (total == usable + F.sum("q") + missing).alias("balanced"))
