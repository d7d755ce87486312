"""Intake of end-of-day files, filing texts, readiness, masks, and the batch forms of stream repair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators.divisors import divisors
from tickloom.operators.joins import neighbour
from tickloom.operators.windows import over, quantiles
from tickloom.plans.feature_plans import DAILY, KEY, daily_keyed, keyed, r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

RULES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
_WIDE = ", ".join(f"count(*) filter (where rule = '{k}') as {v}_n, round(sum(entry_value) filter (where rule = '{k}'), 2) as {v}_value" for k, v in RULES.items())
_AT = "cast(cast(session as timestamp) as varchar) as session"


def at_text(name="session"):
    return F.col(name).cast("timestamp").cast("string").alias("session")


@query(duck(f"select {_AT}, {_WIDE} from x8 group by session"))
def a10_participants_wide(spark, sf):
    wide = view(spark, sf, "x8").groupBy("session").pivot("rule", list(RULES)).agg(F.count("entry_value").alias("n"), F.round(F.sum("entry_value"), 2).alias("value"))
    return wide.select(at_text(), *[c for k, v in RULES.items() for c in (F.coalesce(F.col(f"`{k}_n`"), F.lit(0)).alias(f"{v}_n"), F.col(f"`{k}_value`").alias(f"{v}_value"))])


@query(duck(f"""with t as (select symbol, session, sum(oi) as oi, cast(sum(case when kind = 'F' then contracts else 0 end) as bigint) as cap from x4 group by symbol, session)
 select symbol, {_AT}, cap, case when cap > 0 then round(oi / cap * 100, 4) end as used from t"""))
def a11_position_limit(spark, sf):
    t = view(spark, sf, "x4").groupBy("symbol", "session").agg(F.sum("oi").alias("oi"), F.sum(F.when(F.col("kind") == "F", F.col("contracts")).otherwise(0)).alias("cap"))
    return t.select("symbol", at_text(), "cap", F.when(F.col("cap") > 0, F.round(F.col("oi") / F.col("cap") * 100, 4)).alias("used"))


@query(duck(f"""with f as (select distinct session, 1 as present from daily where idx % 5 <> 0), b as (select symbol, session, 1 as listed from daily where n % 11 = 0)
 select {DAILY}, case when present = 1 then listed is not null end as banned from daily left join f using (session) left join b using (symbol, session)"""))
def a12_ban_flag(spark, sf):
    """Null where the session has no file."""
    d = view(spark, sf, "daily")
    files = d.where("idx % 5 <> 0").select("session", F.lit(1).alias("present")).distinct()
    listed = d.where("n % 11 = 0").select("symbol", "session", F.lit(1).alias("listed"))
    j = d.join(files, "session", "left").join(listed, ["symbol", "session"], "left")
    return daily_keyed(j, F.when(F.col("present") == 1, F.col("listed").isNotNull()).alias("banned"))


@query(duck(f"""with s as (select symbol, session, avg(settle) as spot from x4 where kind = 'F' group by symbol, session),
 r as (select *, dense_rank() over (partition by symbol, session order by expiry_no) as nearest from x4)
 select symbol, {_AT}, kind, opt, expiry_no, strike from r left join s using (symbol, session) where kind = 'F' or (nearest <= 2 and strike between spot * 0.7 and spot * 1.3)"""))
def a15_contracts_to_keep(spark, sf):
    x = view(spark, sf, "x4")
    spot = x.where("kind = 'F'").groupBy("symbol", "session").agg(F.avg("settle").alias("spot"))
    ranked = x.withColumn("nearest", F.dense_rank().over(Window.partitionBy("symbol", "session").orderBy("expiry_no")))
    kept = ranked.join(spot, ["symbol", "session"], "left").where("kind = 'F' or (nearest <= 2 and strike between spot * 0.7d and spot * 1.3d)")
    return kept.select("symbol", at_text(), "kind", "opt", "expiry_no", "strike")


@query(duck("select symbol, cast(date_trunc('minute', ts) as varchar) as captured_at, min(seq) as seq, min_by(price, seq) as price from x1 group by symbol, date_trunc('minute', ts)"))
def a18_first_snapshot(spark, sf):
    """The first write of (symbol, minute) wins."""
    x = view(spark, sf, "x1").groupBy("symbol", F.date_trunc("minute", "ts").alias("m")).agg(F.min("seq").alias("seq"), F.min_by("price", "seq").alias("price"))
    return x.select("symbol", F.col("m").cast("string").alias("captured_at"), "seq", "price")


@query(duck("""select symbol, cast(case when symbol % 7 = 0 then 999 when symbol % 3 = 0 then industry_id when symbol % 2 = 0 then industry_id % 10 end as varchar) as industry,
 symbol % 6 = 0 and industry_id <> industry_id % 10 as conflict, not (symbol % 7 = 0 or symbol % 3 = 0 or symbol % 2 = 0) as orphan from x9"""))
def a20_profiles(spark, sf):
    """Industry from lists in order of priority, then overrides; lists that disagree, symbols on none."""
    x = view(spark, sf, "x9")
    lists = x.where("symbol % 3 = 0").select("symbol", F.lit(1).alias("place"), F.col("industry_id").alias("industry"))
    lists = lists.unionByName(x.where("symbol % 2 = 0").select("symbol", F.lit(2).alias("place"), (F.col("industry_id") % 10).alias("industry")))
    best = lists.groupBy("symbol").agg(F.min_by("industry", "place").alias("listed"), (F.min("industry") != F.max("industry")).alias("conflict"))
    over_ = x.where("symbol % 7 = 0").select("symbol", F.lit(999).alias("override"))
    j = x.select("symbol").join(best, "symbol", "left").join(over_, "symbol", "left")
    industry = F.coalesce("override", "listed")
    return j.select("symbol", industry.cast("string").alias("industry"), F.coalesce("conflict", F.lit(False)).alias("conflict"), industry.isNull().alias("orphan"))


@query(duck("""with t as (select filing_id, subject, concat('Dividend Rs ', user_n, '.5 and Rs ', filing_id % 4) as body,
   case filing_id % 3 when 0 then strftime(disseminated_at, '%Y-%m-%d') when 1 then strftime(disseminated_at, '%d-%m-%Y') else strftime(disseminated_at, '%d/%m/%Y') end as day
   from (select *, symbol % 10 as user_n from x6))
 select filing_id, case when subject like '%err%' then 'fault' when subject like '%purchase%' then 'deal' when subject like '%s%' then 'other_s' else 'other' end as kind, subject like 'view%' or subject like 'click%' as routine,
 list_sum(list_transform(regexp_extract_all(body, 'Rs ([0-9.]+)', 1), lambda x: cast(x as double))) as dividend,
 cast(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d-%m-%Y'), try_strptime(day, '%d/%m/%Y'))::date as varchar) as day from t"""))
def b14_filing_texts(spark, sf):
    """Kind by the first keyword that fits, routine by prefix, dividends summed, dates in several formats."""
    x = view(spark, sf, "x6")
    at = F.col("disseminated_at")
    day = F.when(F.col("filing_id") % 3 == 0, F.date_format(at, "yyyy-MM-dd")).when(F.col("filing_id") % 3 == 1, F.date_format(at, "dd-MM-yyyy")).otherwise(F.date_format(at, "dd/MM/yyyy"))
    body = F.concat(F.lit("Dividend Rs "), (F.col("symbol") % 10).cast("string"), F.lit(".5 and Rs "), (F.col("filing_id") % 4).cast("string"))
    t = x.select("filing_id", F.lower("subject").alias("s"), body.alias("body"), day.alias("day"))
    kind = F.when(F.col("s").contains("err"), "fault").when(F.col("s").contains("purchase"), "deal").when(F.col("s").contains("s"), "other_s").otherwise("other")
    paid = F.aggregate(F.regexp_extract_all("body", F.lit(r"Rs ([0-9.]+)"), F.lit(1)), F.lit(0.0), lambda a, v: a + v.cast("double"))
    parsed = F.coalesce(*[F.try_to_timestamp("day", F.lit(f)) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")])
    return t.select("filing_id", kind.alias("kind"), (F.col("s").startswith("view") | F.col("s").startswith("click")).alias("routine"), paid.alias("dividend"), parsed.cast("date").cast("string").alias("day"))


#: Split and bonus ratios of small whole numbers.
RATIOS = sorted({p / q for p in range(1, 6) for q in range(1, 6) if p != q})


@query(duck(f"""with m as (select symbol, session, close / lag(close) over (partition by symbol order by session) as ratio from daily), r as (select cast(unnest({RATIOS}) as double) as real),
 e as (select symbol, session, min_by(real, abs(ratio / real - 1)) as nearest, min(abs(ratio / real - 1)) as error from m, r where ratio is not null group by symbol, session)
 select {DAILY}, case when error <= 0.005 then round(nearest, 6) end as snapped from e"""))
def b15_snapped_ratio(spark, sf):
    d = view(spark, sf, "daily").withColumn("ratio", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session"))).where("ratio is not null")
    near = F.array_min(F.transform(F.array(*map(F.lit, RATIOS)), lambda r: F.struct(F.abs(F.col("ratio") / r - 1).alias("error"), r.alias("real"))))
    d = d.withColumn("near", near)
    return daily_keyed(d, F.when(F.col("near.error") <= 0.005, r6("near.real")).alias("snapped"))


@query(duck(f"""with f as (select *, lag(close) over w as before, count(close) over (w rows between 4 preceding and current row) as seen from bars window w as (partition by symbol, session order by hr))
 select {KEY}, volume is not null as volume_ready, before is not null as return_ready, seen = 5 as mean_ready, volume is not null and before is not null and seen = 5 as core_ready from f"""))
def b22_readiness(spark, sf):
    by, w = ["symbol", "session"], Window.partitionBy("symbol", "session").orderBy("hr")
    bars = view(spark, sf, "bars")
    ready = {"volume_ready": F.col("volume").isNotNull(), "return_ready": F.lag("close").over(w).isNotNull(), "mean_ready": F.count("close").over(over(by, ["hr"], -4, 0)) == 5}
    core = ready["volume_ready"] & ready["return_ready"] & ready["mean_ready"]
    return keyed(bars, *[c.alias(k) for k, c in ready.items()], core.alias("core_ready"))


@query(duck(f"""with b as (select *, coalesce(close > open and close > lag(close) over (partition by symbol, session order by hr), false) as aligned, close < open as dip, high - low > open as moving from bars)
 select {KEY}, 'aligned' as rule from b where aligned union all select {KEY}, 'dip' from b where dip union all select {KEY}, 'moving' from b where moving"""))
def b21_rule_masks(spark, sf):
    before = F.lag("close").over(Window.partitionBy("symbol", "session").orderBy("hr"))
    b = view(spark, sf, "bars")
    masks = {"aligned": (F.col("close") > F.col("open")) & (F.col("close") > before), "dip": F.col("close") < F.col("open"), "moving": F.col("high") - F.col("low") > F.col("open")}
    rules = F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))
    return keyed(b.withColumn("rules", rules), F.explode("rules").alias("rule"))


@query(duck(f"""with f as (select *, close / open - 1 as x, session < timestamp '1996-01-01' as train from daily), c as (select quantile_cont(x, 0.005) as lo, quantile_cont(x, 0.995) as hi from f where train),
 k as (select f.*, greatest(lo, least(hi, x)) as clipped from f, c), m as (select avg(clipped) as mean_, stddev_pop(clipped) as dev from k where train)
 select {DAILY}, round((clipped - mean_) / dev, 5) as z from k, m"""))
def b23_winsorised(spark, sf):
    d = view(spark, sf, "daily").withColumn("x", F.col("close") / F.col("open") - 1).withColumn("train", F.col("session").cast("timestamp") < "1996-01-01")
    cut = quantiles(d.where("train"), "x", {"lo": 0.005, "hi": 0.995})
    d = d.crossJoin(F.broadcast(cut)).withColumn("clipped", F.greatest("lo", F.least("hi", "x")))  # one row of cuts
    scale = d.where("train").agg(F.avg("clipped").alias("mean_"), F.stddev_pop("clipped").alias("dev"))
    return daily_keyed(d.crossJoin(F.broadcast(scale)), F.round((F.col("clipped") - F.col("mean_")) / F.col("dev"), 5).alias("z"))


@query("""with v as (select l_suppkey % 100 as symbol, cast(round(l_quantity * 6) as bigint) as v from lineitem)
 select cast(symbol as bigint) as symbol, cast(list_reduce(list(v), lambda a, b: gcd(a, b)) as bigint) as quantum from v group by symbol""")
def b24_quantum(spark, sf):
    """Divisors are folded in each partition, then over one value a partition."""
    v = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 100).cast("long").alias("symbol"), F.round(F.col("l_quantity") * 6).cast("long").alias("v"))
    some = v.mapInPandas(divisors, "symbol long, v long")
    return some.repartition("symbol").mapInPandas(divisors, "symbol long, v long").withColumnRenamed("v", "quantum")


@query(duck("""with d as (select trade_id, symbol, cast(session as timestamp) as until_, cast(session as timestamp) - interval 40 day as after_ from x8),
 m as (select o_custkey % 50 as symbol, cast(o_orderdate as timestamp) as held, cast(o_orderdate as timestamp) - cast(o_orderkey % 60 as int) * interval 1 day as known from orders where o_orderstatus = 'O')
 select trade_id, count(*) as meetings, count(*) filter (where known <= after_) as known_before from d join m on d.symbol = m.symbol and held > after_ and held <= until_ group by trade_id"""))
def c6_known_meetings(spark, sf):
    """Meetings in the forty days up to a trade, and those known before: each counts from one time to another, so that running sums by symbol and time hold the counts of all trades."""
    trades = view(spark, sf, "x8").select("trade_id", "symbol", F.col("session").cast("timestamp").alias("at")).where("at is not null")
    meetings = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus = 'O'").select((F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderkey") % 60).cast("int").alias("lead"))
    meetings = meetings.where("at is not null").withColumn("end", F.expr("at + interval 40 days")).withColumn("known", F.expr("least(end, greatest(at, end - make_interval(0, 0, 0, lead)))"))
    step = lambda at, n, k: F.struct(F.col(at).alias("at"), F.lit(n).alias("n"), F.lit(k).alias("k"))
    both = F.array(step("at", 1, 0), step("end", -1, 0))
    steps = meetings.select("symbol", F.explode(F.when(F.col("lead").isNull(), both).otherwise(F.concat(both, F.array(step("known", 0, 1), step("end", 0, -1))))).alias("s")).select("symbol", "s.*")
    asked = trades.select("symbol", "at", F.lit(0).alias("n"), F.lit(0).alias("k"))
    times = steps.unionByName(asked).groupBy("symbol", "at").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    w = over(["symbol"], ["at"])
    times = times.select("symbol", "at", F.sum("n").over(w).alias("meetings"), F.sum("k").over(w).alias("known_before")).where("meetings > 0")
    return trades.join(times, ["symbol", "at"]).groupBy("trade_id").agg(F.sum("meetings").alias("meetings"), F.sum("known_before").alias("known_before"))


@query(duck(f"select {DAILY}, n from daily where symbol in (select symbol from daily where n % 11 = 0 and idx % 12 = 0)"))
def c18_ever_flagged(spark, sf):
    d = view(spark, sf, "daily")
    return daily_keyed(d.join(d.where("n % 11 = 0 and idx % 12 = 0").select("symbol"), "symbol", "left_semi"), "n")


@query(duck(f"""with s as (select *, close / open - 1 as score from daily), j as (select a.symbol, a.session, a.close / a.open - 1 as today, b.score, row_number() over (partition by a.session order by b.score desc, a.symbol) as rn from s a join s b on a.symbol = b.symbol and a.idx = b.idx + 1)
 select {DAILY}, round(score, 6) as score, round(today, 6) as today from j where rn = 1"""))
def c19_first_pick(spark, sf):
    """Yesterday's best score, and what it made today."""
    d = view(spark, sf, "daily").withColumn("score", F.col("close") / F.col("open") - 1)
    d = neighbour(d, "symbol", "idx", ["score"], -1, "_before").where("score_before is not null")
    first = d.groupBy("session").agg(F.min_by(F.struct("symbol", "score_before", "score"), F.struct(-F.col("score_before"), "symbol")).alias("pick"))
    return first.select(F.col("pick.symbol").alias("symbol"), at_text(), r6("pick.score_before").alias("score"), r6("pick.score").alias("today"))


@query(duck(f"""with u as (select *, 0 as place from feed union all select *, 1 from bars where n_ticks % 13 = 0 or hr % 5 = 0), k as (select *, row_number() over (partition by symbol, bar_start order by place desc) as rn from u)
 select {KEY}, close, place = 1 as repaired from k where rn = 1"""))
def k7_gap_repair(spark, sf):
    """Live bars and those loaded from history; history wins."""
    live = view(spark, sf, "feed").withColumn("place", F.lit(0))
    loaded = view(spark, sf, "bars").where("n_ticks % 13 = 0 or hr % 5 = 0").withColumn("place", F.lit(1))
    best = live.unionByName(loaded).groupBy("symbol", "session", "hr").agg(F.max_by(F.struct("close", "place"), "place").alias("b"))
    return keyed(best, F.col("b.close").alias("close"), (F.col("b.place") == 1).alias("repaired"))


@query("""with t as (select user_id as symbol, ts, lag(ts) over (partition by user_id order by ts) as before from events),
 g as (select *, sum(case when before is null or ts >= before + interval 6 hour then 1 else 0 end) over (partition by symbol order by ts rows between unbounded preceding and current row) as run from t)
 select symbol, cast(min(ts) as varchar) as active_from, cast(max(ts) as varchar) as last_seen, count(*) as n from g group by symbol, run""")
def k8_silent_symbols(spark, sf):
    """Stretches in which a symbol was never silent for six hours."""
    x = view(spark, sf, "x1").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    runs = x.groupBy("symbol", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return runs.select("symbol", F.col("a").cast("string").alias("active_from"), F.col("b").cast("string").alias("last_seen"), "n")


#: Knots of a calibration map, raw to calibrated.
KNOTS = ((0.0, 0.02), (0.25, 0.1), (0.5, 0.35), (0.75, 0.6), (1.0, 0.9))
_STEPS = " ".join(f"when p <= {b[0]} then {a[1]} + (p - {a[0]}) * {(b[1] - a[1]) / (b[0] - a[0])}" for a, b in zip(KNOTS, KNOTS[1:], strict=False))


@query(duck(f"select event_id, round(cast(case {_STEPS} end as double), 6) as calibrated from x7"))
def l3_calibrated(spark, sf):
    out = None
    for a, b in zip(KNOTS, KNOTS[1:], strict=False):
        value = a[1] + (F.col("p") - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))
        out = F.when(F.col("p") <= b[0], value) if out is None else out.when(F.col("p") <= b[0], value)
    return view(spark, sf, "x7").select("event_id", r6(out).alias("calibrated"))


@query(duck("""with w as (select event_id, power(0.5, date_diff('day', session, (select max(session) from x7)) / 10.0) as w from x7) select event_id, round(w / (select avg(w) from w), 6) as weight from w"""))
def l6_recency_weights(spark, sf):
    """Half-life of ten days, mean 1; the mean is taken over counts a session."""
    x = view(spark, sf, "x7")
    days = x.groupBy("session").agg(F.count("*").alias("n"))
    newest = days.agg(F.max("session").alias("newest"))
    days = days.crossJoin(F.broadcast(newest)).withColumn("w", F.pow(F.lit(0.5), F.datediff("newest", "session") / 10))
    mean = days.agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean_"))
    scaled = days.crossJoin(F.broadcast(mean)).select("session", (F.col("w") / F.col("mean_")).alias("weight"))
    return x.join(scaled, "session").select("event_id", r6("weight").alias("weight"))
