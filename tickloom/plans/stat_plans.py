"""Aggregates and statistics on forecasts and signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators.windows import average_rank, grouped_quantiles, prefix_sums, quantiles
from tickloom.plans.feature_plans import DAILY, daily_keyed, r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view


def brier(p, y):
    return F.avg((F.col(p) - F.col(y)) ** 2)


def log_loss(p, y):
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))


def auc(df, by, score, label):
    """Area under the curve for each group, or of all: counts by score, then running sums; ties count half."""
    g = df.groupBy(*by, score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    if by:
        w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    else:
        g = prefix_sums(g, score, "neg", "below")
    g = g.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    wins, pairs = F.sum("won"), F.sum("pos") * F.sum("neg")
    return g.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


_LL = "avg(-case when y = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end)"
_AUC = """g as (select {0}p, sum(y) as pos, sum(1 - y) as neg from x7 group by {0}p), w as (select *, pos * (coalesce(sum(neg) over ({1} order by p rows between unbounded preceding and 1 preceding), 0) + neg / 2.0) as won from g)"""


@query(duck(f"""with {_AUC.format("", "")}, a as (select sum(won) / (sum(pos) * sum(neg)) as auc from w),
 b as (select floor(least(p, 0.999999) * 10) as bin, count(*) as n, avg(p) as mp, avg(y) as my from x7 group by 1), e as (select sum(n * abs(mp - my)) / sum(n) as ece from b)
 select round((select avg(power(p - y, 2)) from x7), 6) as brier, round((select {_LL} from x7), 6) as log_loss, round(auc, 6) as auc, round(ece, 6) as ece from a, e"""))
def i1_probability_metrics(spark, sf):
    x = view(spark, sf, "x7")
    bins = x.groupBy(F.floor(F.least("p", F.lit(0.999999)) * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    ece = bins.agg(r6(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))
    one = x.agg(r6(brier("p", "y")).alias("brier"), r6(log_loss("p", "y")).alias("log_loss"))
    return one.crossJoin(auc(x, [], "p", "y").select(r6("auc").alias("auc"))).crossJoin(ece)  # one row each


@query(duck("""select cast(least(floor(p * 10), 9) as int) as band, count(*) as n, round(avg(p), 6) as estimate, round(avg(y), 6) as hit_rate, round(count(*) / count(distinct session)::double, 6) as per_session from x7 group by 1"""))
def i2_probability_bands(spark, sf):
    return view(spark, sf, "x7").groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("band")).agg(
        F.count("*").alias("n"), r6(F.avg("p")).alias("estimate"), r6(F.avg("y")).alias("hit_rate"), r6(F.count("*") / F.countDistinct("session")).alias("per_session"))


@query(duck(f"""with {_AUC.format("session, ", "partition by session")}, d as (select session, sum(won) / nullif(sum(pos) * sum(neg), 0) as auc from w group by session)
 select count(auc) as days, round(avg(auc), 6) as mean_auc, round((avg(auc) - 0.5) / (stddev_samp(auc) / sqrt(count(auc))), 4) as t from d"""))
def i3_within_day_auc(spark, sf):
    d = auc(view(spark, sf, "x7"), ["session"], "p", "y")
    return d.agg(F.count("auc").alias("days"), r6(F.avg("auc")).alias("mean_auc"), F.round((F.avg("auc") - 0.5) / (F.stddev_samp("auc") / F.sqrt(F.count("auc"))), 4).alias("t"))


@query(duck(f"""with {_AUC.format("", "")}, a as (select sum(won) / (sum(pos) * sum(neg)) as a, sum(pos)::double as m, sum(neg)::double as n from w)
 select round(a, 6) as auc, round(sqrt((a * (1 - a) + (m - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (m * n)), 6) as standard_error from a"""))
def i4_auc_band(spark, sf):
    a, m, n = F.col("auc"), F.col("positives"), F.col("negatives")
    error = F.sqrt((a * (1 - a) + (m - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (m * n))
    return auc(view(spark, sf, "x7"), [], "p", "y").select(r6(a).alias("auc"), r6(error).alias("standard_error"))


_NEXT = """f as (select symbol, session, idx, close / open - 1 as feature, lead(close) over w / close - 1 as target from daily window w as (partition by symbol order by idx)),
 k as (select *, rank() over (partition by session order by feature) + (count(*) over (partition by session, feature) - 1) / 2.0 as rf,
   rank() over (partition by session order by target) + (count(*) over (partition by session, target) - 1) / 2.0 as rt from f where target is not null),
 ic as (select session, corr(rf, rt) as ic, count(*) as n from k group by session having count(*) >= 5)"""


def _panel(spark, sf):
    w = Window.partitionBy("symbol").orderBy("idx")
    d = view(spark, sf, "daily")
    return d.select("symbol", "session", "idx", "n", (F.col("close") / F.col("open") - 1).alias("feature"), (F.lead("close").over(w) / F.col("close") - 1).alias("target")).where("target is not null")


def daily_ic(panel):
    k = panel.withColumn("rf", average_rank(["session"], "feature")).withColumn("rt", average_rank(["session"], "target"))
    return k.groupBy("session").agg(F.corr("rf", "rt").alias("ic"), F.count("*").alias("n")).where("n >= 5")


@query(duck(f"with {_NEXT} select cast(cast(session as timestamp) as varchar) as session, n, round(ic, 5) as ic from ic"))
def i5_information_coefficient(spark, sf):
    return daily_ic(_panel(spark, sf)).select(F.col("session").cast("timestamp").cast("string").alias("session"), "n", F.round("ic", 5).alias("ic"))


@query(duck(f"""with {_NEXT}, d as (select ic - (select avg(ic) from ic) as x, row_number() over (order by session) as i from ic), l as (select cast(unnest(range(4)) as int) as lag),
 s as (select lag, sum(a.x * b.x) as g from l join d a on true join d b on b.i = a.i + lag group by lag), t as (select count(*)::double as n, avg(ic) as m from ic)
 select cast(n as bigint) as n, round(m, 6) as mean_ic, round(m / sqrt((select sum(case when lag = 0 then g else 2 * (1 - lag / 4.0) * g end) from s) / n / n), 3) as t from t"""))
def i6_newey_west(spark, sf):
    """Bartlett weights over three lags. The series has one value a session, hence one partition."""
    ic = daily_ic(_panel(spark, sf)).select("session", "ic")
    d = ic.crossJoin(ic.agg(F.avg("ic").alias("m"))).withColumn("x", F.col("ic") - F.col("m"))
    w = Window.orderBy("session")
    d = d.select("ic", "x", *[F.lag("x", k).over(w).alias(f"x{k}") for k in (1, 2, 3)])
    total = F.sum(F.col("x") ** 2)
    for k in (1, 2, 3):
        total = total + 2 * (1 - k / 4) * F.coalesce(F.sum(F.col("x") * F.col(f"x{k}")), F.lit(0.0))
    n = F.count("*")
    return d.agg(n.alias("n"), r6(F.avg("ic")).alias("mean_ic"), F.round(F.avg("ic") / F.sqrt(total / n / n), 3).alias("t"))


@query(duck(f"""with {_NEXT} select cast(extract(year from session) as int) as year, count(*) as sessions, round(avg(ic), 5) as mean_ic, round(avg(case when ic > 0 then 1.0 else 0 end), 5) as positive,
 round(min(ic), 5) > -1 as above_floor from ic group by 1"""))
def i7_yearly_summary(spark, sf):
    return daily_ic(_panel(spark, sf)).groupBy(F.year(F.col("session").cast("timestamp")).alias("year")).agg(
        F.count("*").alias("sessions"), F.round(F.avg("ic"), 5).alias("mean_ic"), F.round(F.avg((F.col("ic") > 0).cast("double")), 5).alias("positive"), (F.round(F.min("ic"), 5) > -1).alias("above_floor"))


@query(duck(f"""with {_NEXT}, m as (select session, avg(feature) as mkt from f where target is not null group by session), j as (select f.symbol, f.target, m.mkt from f join m using (session) where target is not null)
 select symbol, count(*) as n, round(regr_slope(target, mkt), 5) as beta, round(regr_intercept(target, mkt), 6) as alpha, round(regr_r2(target, mkt), 6) as r2 from j group by symbol"""))
def i9_beta_alpha(spark, sf):
    p = _panel(spark, sf)
    j = p.join(p.groupBy("session").agg(F.avg("feature").alias("mkt")), "session")
    return j.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.regr_slope("target", "mkt"), 5).alias("beta"), r6(F.regr_intercept("target", "mkt")).alias("alpha"), r6(F.regr_r2("target", "mkt")).alias("r2"))


@query(duck("""with c as (select symbol, count(*)::double as n, sum(y)::double as k from x7 group by symbol) select symbol, cast(n as bigint) as n, cast(k as bigint) as hits,
 round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) as low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) as high from c"""))
def i12_wilson_interval(spark, sf):
    c = view(spark, sf, "x7").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    n, q = F.col("n"), F.col("hits") / F.col("n")
    half = 1.96 * F.sqrt(q * (1 - q) / n + 0.9604 / n / n)
    return c.select("symbol", "n", "hits", r6((q + 1.9208 / n - half) / (1 + 3.8416 / n)).alias("low"), r6((q + 1.9208 / n + half) / (1 + 3.8416 / n)).alias("high"))


@query(duck("""with t as (select cast(unnest([0.2, 0.5, 0.8]) as double) as threshold), s as (select threshold, session, count(*) as n, sum(y) as hits from x7 join t on p >= threshold group by 1, 2)
 select threshold, cast(sum(n) as bigint) as rows_, count(*) as sessions, round(avg(n), 6) as mean_n, round(median(n), 6) as median_n, round(sum(hits)::double / sum(n), 6) as precision_,
 round(avg(hits::double / n), 6) as day_precision from s group by threshold"""))
def i13_threshold_statistics(spark, sf):
    x = view(spark, sf, "x7").withColumn("threshold", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))).where("p >= threshold")
    s = x.groupBy("threshold", "session").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    return s.groupBy("threshold").agg(F.sum("n").alias("rows_"), F.count("*").alias("sessions"), r6(F.avg("n")).alias("mean_n"), r6(F.median("n")).alias("median_n"),
                                      r6(F.sum("hits") / F.sum("n")).alias("precision_"), r6(F.avg(F.col("hits") / F.col("n"))).alias("day_precision"))


@query(duck(f"""select coalesce(cast(symbol % 3 as varchar), 'all') as side, coalesce(cast(date_part('month', session) as varchar), 'all') as month, count(*) as n, round(avg(power(p - y, 2)), 6) as brier, round({_LL}, 6) as log_loss,
 round(avg(case when p >= 0.5 then y end), 6) as at_half from x7 group by grouping sets ((), (symbol % 3), (date_part('month', session)), (symbol % 3, date_part('month', session)))"""))
def i22_dated_diagnostics(spark, sf):
    x = view(spark, sf, "x7").withColumn("side", (F.col("symbol") % 3).cast("string")).withColumn("month", F.month("session").cast("string"))
    g = x.cube("side", "month").agg(F.count("*").alias("n"), r6(brier("p", "y")).alias("brier"), r6(log_loss("p", "y")).alias("log_loss"), r6(F.avg(F.when(F.col("p") >= 0.5, F.col("y")))).alias("at_half"))
    return g.fillna("all", ["side", "month"])


@query(duck(f"""with l as (select session, symbol % 5 as book, avg(-case when y = 1 then ln(least(greatest(p, 1e-6), 1 - 1e-6)) else ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) end) as ll, avg(y) as base from x7 group by 1, 2)
 select book, count(*) as days, round(avg(0.6931471805599453 - ll), 6) as gain, min(0.6931471805599453 - ll) > 0 as robust from l group by book"""))
def i15_day_log_loss_gain(spark, sf):
    d = view(spark, sf, "x7").groupBy("session", (F.col("symbol") % 5).alias("book")).agg(log_loss("p", "y").alias("ll"))
    gain = 0.6931471805599453 - F.col("ll")
    return d.groupBy("book").agg(F.count("*").alias("days"), r6(F.avg(gain)).alias("gain"), (F.min(gain) > 0).alias("robust"))


@query("""with h as (select hour(ts) as slot, case when event_type = 'error' then 1 else 0 end as y, value from events)
 select cast(slot as int) as slot, count(*) as n, round(avg(y), 6) as base_rate, round(quantile_cont(value, 0.25), 6) as p25, round(median(value), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from h group by slot""")
def d17_time_of_day_base_rate(spark, sf):
    x = view(spark, sf, "x1").withColumn("y", (F.col("symbol") == "error").cast("int"))
    x = x.withColumn("slot", F.hour("ts"))
    q = grouped_quantiles(x, ["slot"], {"p25": ("price", 0.25), "p50": ("price", 0.5), "p90": ("price", 0.9)})
    return x.groupBy("slot").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("base_rate")).join(q, "slot").select("slot", "n", "base_rate", *[r6(c).alias(c) for c in ("p25", "p50", "p90")])


@query(duck("""with r as (select *, close / lag(close) over (partition by symbol order by session) - 1 as ret from daily)
 select cast(cast(session as timestamp) as varchar) as session, count(ret) as n, round(avg(case when ret > 0 then 1.0 when ret is not null then 0.0 end), 6) as breadth, round(stddev_pop(ret), 6) as dispersion, round(avg(ret), 6) as mean_return from r group by session"""))
def d15_breadth(spark, sf):
    d = view(spark, sf, "daily")
    d = d.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session")) - 1)
    return d.groupBy(F.col("session").cast("timestamp").cast("string").alias("session")).agg(
        F.count("ret").alias("n"), r6(F.avg((F.col("ret") > 0).cast("double"))).alias("breadth"), r6(F.stddev_pop("ret")).alias("dispersion"), r6(F.avg("ret")).alias("mean_return"))


@query(duck("""with u as (select 'volume' as feature, volume is null as missing from bars union all select 'close', close is null from bars union all select 'flat', nullif(high - low, 0) is null from bars)
 select feature, round(avg(case when missing then 1.0 else 0 end), 6) as missing_share from u group by feature"""))
def d18_missing_share(spark, sf):
    bars = view(spark, sf, "bars").select(F.col("volume").cast("double").alias("volume"), "close", F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low")).alias("flat"))
    long = bars.unpivot([], ["volume", "close", "flat"], "feature", "value")
    return long.groupBy("feature").agg(r6(F.avg(F.col("value").isNull().cast("double"))).alias("missing_share"))


@query(duck(f"""with q as (select symbol, session, (close / open - 1) as f, row_number() over (partition by session order by close / open, symbol) as a, row_number() over (partition by session order by close / open desc, symbol) as b, count(*) over (partition by session) as n from daily)
 select cast(cast(session as timestamp) as varchar) as session, round(avg(f) filter (where b <= 3), 6) as long_leg, round(avg(f) filter (where a <= 3), 6) as short_leg,
 round(avg(f) filter (where b <= 3) - avg(f) filter (where a <= 3), 6) as net, string_agg(cast(symbol as varchar), ',' order by b) filter (where b <= 3) as members from q where n >= 6 group by session"""))
def f14_long_short_book(spark, sf):
    s = Window.partitionBy("session")
    q = view(spark, sf, "daily").withColumn("f", F.col("close") / F.col("open") - 1).withColumn("key", F.col("close") / F.col("open"))
    q = q.select("session", "symbol", "f", F.row_number().over(s.orderBy("key", "symbol")).alias("a"), F.row_number().over(s.orderBy(F.col("key").desc(), "symbol")).alias("b"), F.count("*").over(s).alias("n")).where("n >= 6")
    top, low = F.avg(F.when(F.col("b") <= 3, F.col("f"))), F.avg(F.when(F.col("a") <= 3, F.col("f")))
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("b") <= 3, F.struct("b", "symbol")))), lambda x: x["symbol"].cast("string")), ",")
    return q.groupBy(F.col("session").cast("timestamp").cast("string").alias("session")).agg(r6(top).alias("long_leg"), r6(low).alias("short_leg"), r6(top - low).alias("net"), members.alias("members"))


@query(duck(f"""with k as (select symbol, session, close / open - 1 as f, (rank() over (partition by session order by close / open) + (count(*) over (partition by session, close / open) - 1) / 2.0) as r, count(*) over (partition by session) as n from daily)
 select {DAILY}, round(r / n - 0.5 - 0.5 / n, 6) as centred, case when n > 1 then round((row_number() over (partition by session order by f, symbol) - 1) / (n - 1.0), 6) end as percentile from k"""))
def f13_centred_and_percentile_ranks(spark, sf):
    d = view(spark, sf, "daily").withColumn("key", F.col("close") / F.col("open"))
    s = Window.partitionBy("session")
    d = d.withColumn("r", average_rank(["session"], "key")).withColumn("cnt", F.count("*").over(s)).withColumn("f", F.col("key") - 1)
    return daily_keyed(d, r6(F.col("r") / F.col("cnt") - 0.5 - 0.5 / F.col("cnt")).alias("centred"), r6(F.when(F.col("cnt") > 1, (F.row_number().over(s.orderBy("f", "symbol")) - 1) / (F.col("cnt") - 1))).alias("percentile"))


@query(duck(f"""with {_NEXT}, q as (select session, target, rf / count(*) over (partition by session) as pct, count(*) over (partition by session) as n from k)
 select cast(cast(session as timestamp) as varchar) as session, round(avg(target) filter (where pct > 0.8) - avg(target) filter (where pct <= 0.2), 6) as spread from q where n >= 5 group by session"""))
def f15_quintile_spread(spark, sf):
    s = Window.partitionBy("session")
    q = _panel(spark, sf).withColumn("pct", average_rank(["session"], "feature") / F.count("*").over(s)).withColumn("n", F.count("*").over(s)).where("n >= 5")
    return q.groupBy(F.col("session").cast("timestamp").cast("string").alias("session")).agg(
        r6(F.avg(F.when(F.col("pct") > 0.8, F.col("target"))) - F.avg(F.when(F.col("pct") <= 0.2, F.col("target")))).alias("spread"))


@query(duck(f"""with {_NEXT}, t as (select quantile_cont(feature, 0.1) as lo, quantile_cont(feature, 0.9) as hi from f where target is not null and session < timestamp '1996-01-01'),
 z as (select case when session < timestamp '1996-01-01' then 'discovery' else 'later' end as period, case when feature <= lo then 'low' when feature >= hi then 'high' end as tail, target from f, t where target is not null)
 select period, tail, count(*) as n, round(avg(target), 6) as mean_target from z where tail is not null group by 1, 2"""))
def f16_decile_tails(spark, sf):
    p = _panel(spark, sf).withColumn("early", F.col("session").cast("timestamp") < "1996-01-01")
    cut = quantiles(p.where("early"), "feature", {"lo": 0.1, "hi": 0.9})
    z = p.crossJoin(F.broadcast(cut))  # one row of thresholds
    tail = F.when(F.col("feature") <= F.col("lo"), "low").when(F.col("feature") >= F.col("hi"), "high")
    z = z.select(F.when(F.col("early"), "discovery").otherwise("later").alias("period"), tail.alias("tail"), "target").where("tail is not null")
    return z.groupBy("period", "tail").agg(F.count("*").alias("n"), r6(F.avg("target")).alias("mean_target"))
