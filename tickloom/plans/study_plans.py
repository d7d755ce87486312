"""Resampled intervals, horizon and threshold metrics, rules of the market, overlap of features, histograms and tallies."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.chains import kept
from tickloom.operators.windows import grouped_quantiles, over
from tickloom.plans.feature_plans import DAY, KEY, keyed, r6
from tickloom.plans.label_plans import BARRIER, HORIZONS, _classes
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

REPLICATES, BLOCK = 60, 5


def draw(*parts: Column, n: Column) -> Column:
    """A number from 0 to n - 1 by a hash of the parts: draws repeat."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def _draw(text: str, n: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint % {n})"


_DAYS = "dd as (select session, count(*) as n, sum(y) as hits, avg(p) as mean_ from x7 where p > 0.4 group by session), dn as (select *, row_number() over (order by session) - 1 as i, count(*) over () as k from dd)"


def _days(spark, sf) -> DataFrame:
    """One row a session, numbered: small, whatever the rows."""
    d = view(spark, sf, "x7").where("p > 0.4").groupBy("session").agg(F.count("*").alias("n"), F.sum("y").alias("hits"), F.avg("p").alias("mean"))
    return d.withColumn("i", F.row_number().over(Window.orderBy("session")) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))


def replicated(days: DataFrame, index: Column, columns: list[str]) -> DataFrame:
    """(r, columns): for each replicate and place, the day that `index` (of r and i) names."""
    places = days.select("i", "k").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES)))).withColumn("at", index)
    return places.select("r", "at").join(days.select(F.col("i").cast("long").alias("at"), *columns), "at")


@query(duck(f"""with {_DAYS}, pick as (select r, {_draw("r || '-' || i", "k")} as at_ from dn, (select unnest(generate_series(1, {REPLICATES})) as r)), s as (select r, sum(hits) / sum(n) as rate from pick join dn on i = at_ group by r)
 select round(avg(rate), 6) as mean, round(quantile_cont(rate, 0.025), 6) as low, round(quantile_cont(rate, 0.975), 6) as high from s"""))
def i10_day_bootstrap(spark, sf):
    """The range of a rate when whole sessions are drawn with replacement."""
    d = _days(spark, sf)
    s = replicated(d, draw(F.col("r"), F.col("i"), n=F.col("k")), ["n", "hits"]).groupBy("r").agg((F.sum("hits") / F.sum("n")).alias("rate"))
    return s.agg(r6(F.avg("rate")).alias("mean"), r6(F.percentile("rate", 0.025)).alias("low"), r6(F.percentile("rate", 0.975)).alias("high"))


@query(duck(f"""with {_DAYS}, pick as (select r, ({_draw("r || '-' || (i // 5)", "k")} + i % {BLOCK}) % k as at_ from dn, (select unnest(generate_series(1, {REPLICATES})) as r)), s as (select r, avg(mean_) as m from pick join dn on i = at_ group by r)
 select round(quantile_cont(m, 0.025), 6) as low, round(median(m), 6) as mid, round(quantile_cont(m, 0.975), 6) as high from s"""))
def i11_block_bootstrap(spark, sf):
    """The range of a daily mean by circular blocks of sessions."""
    d = _days(spark, sf)
    at = (draw(F.col("r"), F.floor(F.col("i") / BLOCK), n=F.col("k")) + F.col("i") % BLOCK) % F.col("k")
    s = replicated(d, at, ["mean"]).groupBy("r").agg(F.avg("mean").alias("m"))
    return s.agg(r6(F.percentile("m", 0.025)).alias("low"), r6(F.median("m")).alias("mid"), r6(F.percentile("m", 0.975)).alias("high"))


@query(duck(f"""with a as (select a.symbol, a.session, a.hr, n.open as entry from bars a join bars n on a.symbol = n.symbol and a.session = n.session and n.hr = a.hr + 1),
 f as (select a.*, min(case when b.hr > a.hr + 1 and (b.high >= entry * {1 + BARRIER} or b.low <= entry * {1 - BARRIER}) then b.hr end) as hit from a join bars b on a.symbol = b.symbol and a.session = b.session and b.hr > a.hr and b.hr <= a.hr + {HORIZONS[-1]} group by all having count(b.hr) = {HORIZONS[-1]}),
 g as (select f.symbol, f.session, f.hr, f.hit - f.hr as took, b.low <= entry * {1 - BARRIER} as stop from f left join bars b on f.symbol = b.symbol and f.session = b.session and b.hr = f.hit),
 m as (select *, 0.1 + 0.02 * (hr % 5) as p1, 0.2 + 0.02 * (hr % 5) as p2, 0.3 + 0.02 * (hr % 5) as p3 from g),
 s as (select session, (power(p1 - coalesce((not stop and took <= {HORIZONS[0]})::int, 0), 2) + power(p2 - coalesce((not stop and took <= {HORIZONS[1]})::int, 0), 2) + power(p3 - coalesce((not stop)::int, 0), 2)) / 3 as b from m)
 select round(avg(d), 6) as integrated, count(*) as days from (select session, avg(b) as d from s group by session)"""))
def i16_integrated_brier(spark, sf):
    """The Brier score of the chance of the target by each horizon, averaged over horizons, then within days, then over days."""
    c = _classes(spark, sf)
    p = F.array(*[F.lit(0.1 * (k + 1)) + 0.02 * (F.col("hr") % 5) for k in range(len(HORIZONS))])
    s = c.select("session", "class", F.posexplode(p).alias("k", "p")).withColumn("hit", F.coalesce((F.col("class") <= F.col("k")).cast("int"), F.lit(0)))
    d = s.groupBy("session").agg(F.avg((F.col("p") - F.col("hit")) ** 2).alias("d"))
    return d.agg(r6(F.avg("d")).alias("integrated"), F.count("*").alias("days"))


@query(duck(f"""with m as (select a.symbol, a.session, sign(max(case when a.hr = 6 then a.close end) / min_by(a.open, a.hr) - 1) as early, sign(max_by(a.close, a.hr) / max(case when a.hr = 6 then a.close end) - 1) as late from bars a group by 1, 2), i as (select session, late as index_late from m where symbol = 'click' and late is not null),
 v as (select m.*, index_late from m left join i using (session) where early is not null and late is not null)
 select symbol, count(*) as n, round(avg(case when early = late then 1.0 else 0 end), 6) as keeps, round(avg(case when -early = late then 1.0 else 0 end), 6) as turns, round(avg(case when index_late is not null then case when late = index_late then 1.0 else 0 end end), 6) as with_index from v group by symbol"""))
def i17_sign_rules(spark, sf):
    """How often the sign of the early move comes again later, turns, and goes with the index's."""
    b = view(spark, sf, "bars")
    six = F.max(F.when(F.col("hr") == 6, F.col("close")))
    m = b.groupBy(*DAY).agg(F.signum(six / F.min_by("open", "hr") - 1).alias("early"), F.signum(F.max_by("close", "hr") / six - 1).alias("late"))
    i = m.where("symbol = 'click' and late is not null").select("session", F.col("late").alias("index_late"))
    v = m.join(i, "session", "left").where("early is not null and late is not null")
    share = lambda t: r6(F.avg(t.cast("double")))
    return v.groupBy("symbol").agg(F.count("*").alias("n"), share(F.col("early") == F.col("late")).alias("keeps"), share(-F.col("early") == F.col("late")).alias("turns"), share(F.col("late") == F.col("index_late")).alias("with_index"))


@query(duck("""with m as (select session, date_part('day', session) <= 15 as early, avg(p) as feature, avg(y) as target from x7 group by 1, 2), c as (select median(feature) as cut, sign(avg(case when feature > q then target end) - avg(case when feature <= q then target end)) as sgn from m, (select median(feature) as q from m where early) where early)
 select early, count(*) as n, round(avg(sgn * case when feature > cut then 1 else -1 end * (target - 0.2)), 6) as mean from m, c group by early"""))
def i18_median_split(spark, sf):
    """A rule of the market: above or below the median of the choice period, in the direction that held there, on both periods."""
    m = view(spark, sf, "x7").groupBy("session", (F.dayofmonth("session") <= 15).alias("early")).agg(F.avg("p").alias("feature"), F.avg("y").alias("target"))
    cut = m.where("early").agg(F.median("feature").alias("cut"))
    above = F.col("feature") > F.col("cut")
    j = m.crossJoin(F.broadcast(cut))  # one row
    sign = j.where("early").agg(F.signum(F.avg(F.when(above, F.col("target"))) - F.avg(F.when(~above, F.col("target")))).alias("sign"))
    return j.crossJoin(F.broadcast(sign)).groupBy("early").agg(F.count("*").alias("n"), r6(F.avg(F.col("sign") * F.when(above, 1).otherwise(-1) * (F.col("target") - 0.2))).alias("mean"))


_AT = (0.3, 0.5, 0.7)


@query(duck(f"""with t as (select *, cast(unnest({list(_AT)}) as double) as at_ from x7) select at_ as threshold, count(*) as n, count(distinct (session, symbol)) as bars, round(count(*) / count(distinct session), 6) as per_session, round(avg(y), 6) as rate, round(avg(p - 0.4) filter (where y = 0), 6) as misses, round(quantile_cont(p, 0.25), 6) as p25, round(quantile_cont(p, 0.75), 6) as p75 from t where p >= at_ group by at_"""))
def i19_by_threshold(spark, sf):
    t = view(spark, sf, "x7").withColumn("threshold", F.explode(F.array(*map(F.lit, _AT)))).where("p >= threshold")
    q = grouped_quantiles(t, ["threshold"], {"p25": ("p", 0.25), "p75": ("p", 0.75)})
    g = t.groupBy("threshold").agg(F.count("*").alias("n"), F.countDistinct("session", "symbol").alias("bars"), r6(F.count("*") / F.countDistinct("session")).alias("per_session"), r6(F.avg("y")).alias("rate"), r6(F.avg(F.when(F.col("y") == 0, F.col("p") - 0.4))).alias("misses"))
    return g.join(q, "threshold").withColumn("p25", r6("p25")).withColumn("p75", r6("p75"))


@query(duck("""with s as (select *, abs(p - 0.5) >= 0.2 as acts, case when p >= 0.5 then 1 else 0 end as call, event_id % 10 as took from x7), d as (select session, coalesce(avg(case when acts then case when call = y then exp(-took / 5.0) else -1 end end), 0) as utility from s group by session),
 u as (select avg(utility) as utility from d) select count(*) as n, round(avg(acts::int), 6) as coverage, round(avg(case when acts then (call = y)::int end), 6) as precision_, round(sum((acts and call = 1 and y = 1)::int) / sum(y), 6) as recall, round(avg(case when acts and call = y then (took <= 3)::int end), 6) as soon, round(any_value(u.utility), 6) as equal_day_utility from s, u"""))
def i20_selective_signal(spark, sf):
    """Coverage, precision, recall and early hits of the rows that act; utility with equal weight a day."""
    s = view(spark, sf, "x7").select("*", (F.abs(F.col("p") - 0.5) >= 0.2).alias("acts"), (F.col("p") >= 0.5).cast("int").alias("call"), (F.col("event_id") % 10).alias("took"))
    right = (F.col("call") == F.col("y")).cast("int")
    d = s.groupBy("session").agg(F.coalesce(F.avg(F.when(F.col("acts"), F.when(right == 1, F.exp(-F.col("took") / 5)).otherwise(-1.0))), F.lit(0.0)).alias("utility")).agg(r6(F.avg("utility")).alias("equal_day_utility"))
    hits = F.sum((F.col("acts") & (F.col("call") == 1) & (F.col("y") == 1)).cast("int"))
    g = s.agg(F.count("*").alias("n"), r6(F.avg(F.col("acts").cast("int"))).alias("coverage"), r6(F.avg(F.when(F.col("acts"), right))).alias("precision_"), r6(hits / F.sum("y")).alias("recall"), r6(F.avg(F.when(F.col("acts") & (right == 1), (F.col("took") <= 3).cast("int")))).alias("soon"))
    return g.crossJoin(F.broadcast(d))  # one row each


@query(duck(f"""with e as (select session, avg(power(p - y, 2) - power(0.2 - y, 2)) as diff, count(*) as n from x7 group by session), d as (select *, row_number() over (order by session) - 1 as i, count(*) over () as k from e), pick as (select r, ({_draw("'x-' || r || '-' || (i // 5)", "k")} + i % {BLOCK}) % k as at_ from d, (select unnest(generate_series(1, {REPLICATES})) as r)),
 s as (select r, avg(diff) as m from pick join d on i = at_ group by r) select round(avg(diff), 6) as mean, any_value(low) as low, any_value(high) as high, any_value(share) as share_better from e, (select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(avg((m < 0)::int), 6) as share from s)"""))
def i21_paired_losses(spark, sf):
    """Two forecasts' loss by day, paired, with an interval by blocks of days."""
    e = view(spark, sf, "x7").groupBy("session").agg(F.avg((F.col("p") - F.col("y")) ** 2 - (0.2 - F.col("y")) ** 2).alias("diff"))
    d = e.withColumn("i", F.row_number().over(Window.orderBy("session")) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))  # one row a session
    at = (draw(F.lit("x"), F.col("r"), F.floor(F.col("i") / BLOCK), n=F.col("k")) + F.col("i") % BLOCK) % F.col("k")
    s = replicated(d, at, ["diff"]).groupBy("r").agg(F.avg("diff").alias("m"))
    s = s.agg(r6(F.percentile("m", 0.025)).alias("low"), r6(F.percentile("m", 0.975)).alias("high"), r6(F.avg((F.col("m") < 0).cast("int"))).alias("share_better"))
    return d.agg(r6(F.avg("diff")).alias("mean")).crossJoin(s)


@query(duck("""with h as (select symbol % 12 as variant, date_part('day', session)::int // 11 as half, avg(p - 0.28) as net from x7 group by 1, 2), v as (select variant, min(net) as worst, avg(net) as total from h group by 1), a as (select max((worst > 0)::int) as any_ from v)
 select variant, round(total, 6) as total, any_ = 1 as robust from v, a where worst > 0 or any_ = 0 order by total desc, variant limit 1"""))
def i23_robust_variant(spark, sf):
    """Of the variants that are positive in every part of the period the best, else the best of all."""
    h = view(spark, sf, "x7").groupBy((F.col("symbol") % 12).alias("variant"), F.floor(F.dayofmonth("session") / 11).alias("half")).agg(F.avg(F.col("p") - 0.28).alias("net"))
    v = h.groupBy("variant").agg(F.min("net").alias("worst"), F.avg("net").alias("total"))
    g = v.agg(F.max_by(F.struct("variant", "total"), F.struct((F.col("worst") > 0).alias("ok"), "total", -F.col("variant"))).alias("b"), F.max((F.col("worst") > 0)).alias("robust"))
    return g.select("b.variant", r6(F.col("b.total")).alias("total"), "robust")


@query(duck("""with r as (select symbol, idx, n, close, close / lag(close) over (partition by symbol order by idx) - 1 as ret, volume from daily), m as (select idx, avg(case when ret > 0 then 1.0 when ret is not null then 0 end) as breadth, avg(case when n % 3 = 0 then n end) as delivery, count(*) filter (where n % 13 = 0) as banned, avg(close) as level_ from r group by idx)
 select idx, round(breadth, 6) as breadth, round(delivery, 6) as delivery, banned, round(level_ / lag(level_) over w - 1, 6) as index_1, round(level_ / lag(level_, 5) over w - 1, 6) as index_5, round(lead(level_) over w / level_ - 1, 6) as next_day, round(delivery - lag(delivery) over w, 6) + 0.0 as delivery_change from m window w as (order by idx)"""))
def d16_market_frame(spark, sf):
    """Breadth, mean delivery, stocks in ban and index changes, one row a session; lags go over those few rows."""
    d = view(spark, sf, "daily")
    d = d.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("idx")) - 1)
    m = d.groupBy("idx").agg(F.avg((F.col("ret") > 0).cast("double")).alias("b"), F.avg(F.when(F.col("n") % 3 == 0, F.col("n"))).alias("dv"), F.count_if(F.col("n") % 13 == 0).alias("banned"), F.avg("close").alias("level"))
    w = Window.orderBy("idx")
    back = lambda k: r6(F.col("level") / F.lag("level", k).over(w) - 1)
    return m.select("idx", r6(F.col("b")).alias("breadth"), r6(F.col("dv")).alias("delivery"), "banned", back(1).alias("index_1"), back(5).alias("index_5"), r6(F.lead("level").over(w) / F.col("level") - 1).alias("next_day"), (r6(F.col("dv") - F.lag("dv").over(w)) + 0.0).alias("delivery_change"))


FEATURES = ("open", "high", "low", "close", "volume", "n")


@query(duck("""with f as (select symbol, unnest([{'l': 'open', 'r': 'high', 'x': open, 'y': high}, {'l': 'open', 'r': 'low', 'x': open, 'y': low}, {'l': 'open', 'r': 'close', 'x': open, 'y': close}, {'l': 'open', 'r': 'volume', 'x': open, 'y': volume}, {'l': 'open', 'r': 'n', 'x': open, 'y': n}, {'l': 'high', 'r': 'low', 'x': high, 'y': low}, {'l': 'high', 'r': 'close', 'x': high, 'y': close},
 {'l': 'high', 'r': 'volume', 'x': high, 'y': volume}, {'l': 'high', 'r': 'n', 'x': high, 'y': n}, {'l': 'low', 'r': 'close', 'x': low, 'y': close}, {'l': 'low', 'r': 'volume', 'x': low, 'y': volume}, {'l': 'low', 'r': 'n', 'x': low, 'y': n}, {'l': 'close', 'r': 'volume', 'x': close, 'y': volume}, {'l': 'close', 'r': 'n', 'x': close, 'y': n}, {'l': 'volume', 'r': 'n', 'x': volume, 'y': n}]) as p from daily),
 c as (select symbol, p.l as l, p.r as r, corr(p.x, p.y) as rho, count(*) as n from f group by all having count(*) >= 20), s as (select count(distinct symbol) as k from daily)
 select l as left_, r as right_, round(min(abs(rho)), 6) as least, min(abs(rho)) >= 0.9 as redundant, sum(n)::bigint as n from c, s group by l, r, k having count(*) = k"""))
def d20_redundant_pairs(spark, sf):
    """All pairs of features: the least correlation within any symbol; redundant where it is high in every one."""
    d = view(spark, sf, "daily")
    pairs = F.array(*[F.struct(F.lit(a).alias("left_"), F.lit(b).alias("right_"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(FEATURES, 2)])
    c = d.select("symbol", F.explode(pairs).alias("p")).select("symbol", "p.*").groupBy("symbol", "left_", "right_").agg(F.corr("x", "y").alias("rho"), F.count("*").alias("n")).where("n >= 20")
    all_ = d.agg(F.countDistinct("symbol").alias("k"))
    g = c.groupBy("left_", "right_").agg(F.min(F.abs("rho")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("held")).crossJoin(F.broadcast(all_)).where("held = k")  # one row
    return g.select("left_", "right_", r6(F.col("m")).alias("least"), (F.col("m") >= 0.9).alias("redundant"), "n")


def average_ranks(df: DataFrame, names: tuple[str, ...], parts: int = 64) -> DataFrame:
    """(feature, v, rank) of all values of the columns `names`: ranks from 1, equal values sharing the mean of theirs, nulls none.

    Counts of values fall into ranges between approximate quantiles of their column
    (a row a column); places are those within a range and the sizes of the ranges
    before it, so that no task orders a column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("x.*").where("v is not null")
    counts = long.groupBy("feature", "v").agg(F.count("*").alias("m"))
    cuts = kept(long.groupBy("feature").agg(F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("cuts")))  # the same for both readers
    placed = counts.join(F.broadcast(cuts), "feature").withColumn("part", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")
    line = Window.partitionBy("feature").orderBy("part")
    before = placed.groupBy("feature", "part").agg(F.sum("m").alias("n")).withColumn("before", F.sum("n").over(line) - F.col("n")).drop("n")
    own = F.sum("m").over(Window.partitionBy("feature", "part").orderBy("v"))
    return placed.join(F.broadcast(before), ["feature", "part"]).select("feature", "v", (F.col("before") + own - (F.col("m") - 1) / 2).alias("rank"))  # parts rows a column


def rank_correlations(df: DataFrame, names: tuple[str, ...]) -> dict[tuple[str, str], float]:
    """Spearman correlations of all pairs over rows where both are known, repeated rows counting each; ranks are those of each column's known values."""
    ranks, rows = average_ranks(df, names), df.select(*[F.col(n).cast("double").alias(n) for n in names]).groupBy(*names).agg(F.count("*").alias("__m"))
    for n in names:
        rows = rows.join(ranks.where(F.col("feature") == n).select(F.col("v").alias(n), F.col("rank").alias(f"__{n}")), n, "left")
    out = []
    for a, b in combinations(names, 2):
        known = F.col(f"__{a}").isNotNull() & F.col(f"__{b}").isNotNull()
        m = lambda *c: F.sum(F.when(known, reduce(mul, map(F.col, c), F.col("__m").cast("double"))))  # noqa: E731, B023
        x, y, n = m(f"__{a}"), m(f"__{b}"), m()
        over = F.sqrt((m(f"__{a}", f"__{a}") - x * x / n) * (m(f"__{b}", f"__{b}") - y * y / n))
        out.append(F.when(over > 0, (m(f"__{a}", f"__{b}") - x * y / n) / over).alias(f"{a}|{b}"))
    row = rows.agg(*out).first()
    return {(a, b): row[f"{a}|{b}"] or 0.0 for a, b in combinations(names, 2)}  # unknown where one is constant


_RANKED = ", ".join(f"rank() over (order by {f}) + (count(*) over (partition by {f}) - 1) / 2.0 as r_{f}" for f in FEATURES)
_RHO = ", ".join(f"'{a}|{b}': corr(r_{a}, r_{b})" for a, b in combinations(FEATURES, 2))


@query(duck(f"""with recursive d0 as (select * from daily where idx % 2 = 0), d as (select * from d0 union all select * from d0 where n % 5 = 0), r as (select {_RANKED} from d), m as (select map {{{_RHO}}} as rho from r), fs as (select {list(FEATURES)} as names),
 k as (select 1 as i, [names[1]] as kept, null::varchar as clash from fs union all
  select i + 1, case when c is null then kept || [names[i + 1]] else kept end, c from (select i, kept, names, list_filter(kept, lambda x: abs(coalesce(rho[x || '|' || names[i + 1]], 0)) > 0.9)[1] as c from k, fs, m where i < len(names)))
 select names[i] as feature, clash is null as kept, clash as duplicates, round(rho[clash || '|' || names[i]], 6) as spearman from k, fs, m"""))
def d21_pruned_features(spark, sf):
    """Features in order, but those that rank as an earlier kept one does; some rows come twice. The correlations are one small row."""
    d = view(spark, sf, "daily").where("idx % 2 = 0").select("symbol", "idx", *FEATURES)
    rho, kept, out = rank_correlations(d.unionByName(d.where("n % 5 = 0")), FEATURES), [], []
    for f in FEATURES:
        clash = next((k for k in kept if abs(rho[(k, f)]) > 0.9), None)
        out.append((f, clash is None, clash, None if clash is None else round(rho[(clash, f)], 6)))
        if clash is None:
            kept.append(f)
    return spark.createDataFrame(out, "feature string, kept boolean, duplicates string, spearman double")


@query(duck("""with h as (select event_type as kind, user_id as v, count(*) as n from events group by 1, 2), c as (select *, sum(n) over (partition by kind order by v) as cum, sum(n) over (partition by kind) as total from h)
 select kind, any_value(total)::bigint as n, round(sum(v * n) / any_value(total), 6) as mean, min(case when cum >= 0.25 * total then v end) as p25, min(case when cum >= 0.5 * total then v end) as median, min(case when cum >= 0.75 * total then v end) as p75, min(case when cum >= 0.9 * total then v end) as p90 from c group by kind""".replace("from events", "from (select symbol as event_type, user_id from x1)")))
def d22_histogram_quantiles(spark, sf):
    """Quantiles from a histogram: the first value at which the running count reaches the share."""
    h = view(spark, sf, "x1").groupBy(F.col("symbol").alias("kind"), F.col("user_id").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind")
    c = h.select("*", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n").over(w).alias("total"))
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("v")))
    return c.groupBy("kind").agg(F.first("total").alias("n"), r6(F.sum(F.col("v") * F.col("n")) / F.first("total")).alias("mean"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.9).alias("p90"))


ITEMS = 5


@query(duck(f"""with f as (select *, row_number() over (partition by symbol order by disseminated_at desc, filing_id desc) as rn from x6 where subject <> 'view')
 select a.symbol, count(*) as filings, count(*) filter (where subject <> 'view') as material, string_agg(distinct subject, ',' order by subject) as subjects, any_value(items) as items, max(k.top) as most from x6 a left join (select symbol, string_agg(filing_id, ',' order by rn) as items from f where rn <= {ITEMS} group by symbol) using (symbol)
 left join (select symbol, max(n) as top from (select symbol, subject, count(*) as n from x6 group by 1, 2) group by 1) k using (symbol) group by a.symbol""".replace("max(k.top) as most", "max(k.top)::bigint as most")))
def d23_filing_tallies(spark, sf):
    """Filings of a symbol: counts by subject, the latest material ones first. Only the latest few are gathered."""
    f = view(spark, sf, "x6")
    material = F.col("subject") != "view"
    w = Window.partitionBy("symbol", material).orderBy(F.desc("disseminated_at"), F.desc("filing_id"))
    f = f.withColumn("rn", F.when(material, F.row_number().over(w)))
    by = f.groupBy("symbol", "subject").agg(F.count("*").alias("n"), F.count_if(material).alias("m"), F.collect_list(F.when(F.col("rn") <= ITEMS, F.struct("rn", "filing_id"))).alias("xs"))
    g = by.groupBy("symbol").agg(F.sum("n").alias("filings"), F.sum("m").alias("material"), F.array_join(F.sort_array(F.collect_set("subject")), ",").alias("subjects"), F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("xs"))), lambda x: x["filing_id"].cast("string")), ",").alias("xs"), F.max("n").alias("most"))
    return g.select("symbol", "filings", "material", "subjects", F.nullif("xs", F.lit("")).alias("items"), "most")


@query(duck("""with j as (select a.symbol, a.session, a.close as l, b.close as r, a.volume as lv, b.volume as rv from bars a full join feed b on a.symbol = b.symbol and a.session = b.session and a.hr = b.hr)
 select symbol, cast(session as varchar) as session, count(*) as bars, count(*) filter (where l is not null and r is not null) as compared, count(*) filter (where l = r) as exact, round(avg(abs(r - l)), 6) as mean_diff, round(max(abs(r - l)), 6) as most_diff, round(avg(case when l <> 0 then abs(r / l - 1) * 10000 end), 4) as mean_bps, count(*) filter (where r is null) as missing
 from j group by grouping sets ((symbol, session), (symbol), ()) having symbol is not null or session is null""".replace("a.symbol, a.session, a.close", "coalesce(a.symbol, b.symbol) as symbol, coalesce(a.session, b.session) as session, a.close")))
def d25_quotes_between_feeds(spark, sf):
    """Differences of two feeds by symbol and session, with totals by symbol and of all."""
    key = [*DAY, "hr"]
    j = view(spark, sf, "bars").select(*key, F.col("close").alias("l")).join(view(spark, sf, "feed").select(*key, F.col("close").alias("r")), key, "full")
    d = F.abs(F.col("r") - F.col("l"))
    g = j.rollup("symbol", "session").agg(F.count("*").alias("bars"), F.count(d).alias("compared"), F.count_if(F.col("l") == F.col("r")).alias("exact"), r6(F.avg(d)).alias("mean_diff"), r6(F.max(d)).alias("most_diff"),
        F.round(F.avg(F.when(F.col("l") != 0, F.abs(F.col("r") / F.col("l") - 1) * 10_000)), 4).alias("mean_bps"), F.count_if(F.col("r").isNull()).alias("missing"))
    return g.withColumn("session", F.col("session").cast("string"))


@query()
def d27_feature_overlap(spark, sf):
    """Each feature's strongest partner and how much of it the others explain, from one row of sums: R2 = 1 - 1 / (inverse correlation)."""
    import numpy as np

    names = ("open", "volume", "n", "idx", "symbol")
    row = view(spark, sf, "daily").agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in combinations(names, 2)]).first()
    m = np.eye(len(names))
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        m[i, j] = m[j, i] = row[f"{a}|{b}"] or 0.0  # unknown where one is constant
    inverse, off = np.linalg.pinv(m), np.abs(m - np.eye(len(names)))
    out = [(a, names[int(off[i].argmax())], round(float(m[i, off[i].argmax()]), 6), round(float(1 - 1 / inverse[i, i]), 6)) for i, a in enumerate(names)]
    return spark.createDataFrame(out, "feature string, partner string, correlation double, r2 double")


_TOUCH = (0.2, 0.5)


@query(duck(f"""with a as (select *, cast(unnest({list(_TOUCH)}) as double) as level_, 1 as one from bars where hr <= 12), s as (select a.*, cast(unnest([1, -1]) as int) as side from a),
 f as (select s.symbol, s.session, s.hr, level_, side, s.close, min(case when side = 1 then case when b.high >= s.close * (1 + level_) then b.hr end else case when b.low <= s.close * (1 - level_) then b.hr end end) - s.hr as took, max_by(b.close, b.hr) / any_value(s.close) - 1 as final_ from s join bars b on s.symbol = b.symbol and s.session = b.session and b.hr > s.hr and b.hr <= 20 group by s.symbol, s.session, s.hr, level_, side, s.close)
 select level_ as level, side, count(*) as calls, round(100 * avg((took is not null)::int), 4) as touched_pct, round(100 * avg(coalesce(took <= 3, false)::int), 4) as within_3_pct, round(quantile_cont(took, 0.5), 4) as median_bars, round(quantile_cont(took, 0.9), 4) as p90_bars, round(avg(case when took is null then side * final_ end), 6) + 0.0 as misses,
  round(100 * (0.001 - coalesce(avg(case when took is null then side * final_ end), 0)) / (level_ - coalesce(avg(case when took is null then side * final_ end), 0)), 3) as break_even_pct from f group by level_, side"""))
def d28_first_touch_summary(spark, sf):
    """First touches of levels on both sides: share by horizon, bars to the touch, mean of what missed, the rate that pays charges."""
    from tickloom.plans.label_plans import ahead, first_of

    b = ahead(view(spark, sf, "bars").where("hr <= 20"), DAY, ["hr"], 20, "hr").where((F.col("hr") <= 12) & (F.size("ahead") > 0))
    b = b.withColumn("level", F.explode(F.array(*map(F.lit, _TOUCH)))).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    hit = first_of("ahead", lambda x: F.when(F.col("side") == 1, x["high"] >= F.col("close") * (1 + F.col("level"))).otherwise(x["low"] <= F.col("close") * (1 - F.col("level"))))
    b = b.withColumn("took", hit["step"] - F.col("hr")).withColumn("final", F.element_at("ahead", -1)["close"] / F.col("close") - 1)
    miss = F.avg(F.when(F.col("took").isNull(), F.col("side") * F.col("final")))
    no = F.coalesce(miss, F.lit(0.0))
    return b.groupBy("level", "side").agg(F.count("*").alias("calls"), F.round(100 * F.avg(F.col("took").isNotNull().cast("int")), 4).alias("touched_pct"), F.round(100 * F.avg(F.coalesce(F.col("took") <= 3, F.lit(False)).cast("int")), 4).alias("within_3_pct"),
        F.round(F.percentile("took", 0.5), 4).alias("median_bars"), F.round(F.percentile("took", 0.9), 4).alias("p90_bars"), (r6(miss) + 0.0).alias("misses"), F.round(100 * (0.001 - no) / (F.col("level") - no), 3).alias("break_even_pct"))


@query(duck("""with recursive c as (select concat('S', cast(c_custkey as varchar)) as new_, concat('S', cast(c_custkey - 7 as varchar)) as old_, cast(date '1995-01-01' + cast(c_custkey % 900 as int) as date) as changed from (select distinct symbol as c_custkey from x9) where c_custkey % 7 <> 3 and c_custkey > 7 and c_custkey % 13 <> 5),
 h as (select new_ as symbol, old_ as current_, changed, 1 as depth from c union all select h.symbol, c.old_, c.changed, h.depth + 1 from h join c on c.new_ = h.current_ where h.depth < 30),
 s as (select distinct concat('S', cast(symbol as varchar)) as symbol from x9), o as (select symbol, depth, current_, changed, lead(changed) over (partition by symbol order by depth) as nx from h)
 , e as (select symbol, depth, current_, bool_and(date '1996-01-01' < changed) over (partition by symbol order by depth) as ok from o) select s.symbol, coalesce(max_by(current_, depth) filter (where ok), s.symbol) as listed_as, coalesce(max(depth), 0)::int as changes from s left join e on s.symbol = e.symbol group by s.symbol""".replace("with recursive c as", "with c as")).replace("with x9 as", "with recursive x9 as"))
def c9_symbol_as_of(spark, sf):
    """Chains of renames and the symbol of a date: each round joins all chains with their next rename, until none grows; a cycle ends at the bound."""
    k = view(spark, sf, "x9").select("symbol").distinct()
    c = k.where("symbol % 7 <> 3 and symbol > 7 and symbol % 13 <> 5").select(F.concat(F.lit("S"), "symbol").alias("new"), F.concat(F.lit("S"), F.col("symbol") - 7).alias("old"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("symbol") % 900).cast("int")).alias("changed"))
    return symbols_as_of(k.select(F.concat(F.lit("S"), "symbol").alias("symbol")), c, F.lit("1996-01-01").cast("date"))


def symbols_as_of(symbols: DataFrame, changes: DataFrame, day: Column, most: int = 30) -> DataFrame:
    """(symbol, listed_as, changes): changes (new, old, changed) are followed back while the day lies before them."""
    out = symbols.select("symbol", F.col("symbol").alias("listed_as"), F.col("symbol").alias("at"), F.lit(True).alias("before"), F.lit(0).alias("changes"))
    depth = 0
    while depth < most:
        depth += 1
        j = out.join(changes, out["at"] == changes["new"], "left")
        goes = F.coalesce(F.col("before") & (day < F.col("changed")), F.lit(False))
        nxt = j.select("symbol", F.when(goes, F.col("old")).otherwise(F.col("listed_as")).alias("listed_as"), F.col("old").alias("at"), goes.alias("before"), (F.col("changes") + F.col("old").isNotNull().cast("int")).alias("changes"))
        if depth % 8 == 0:  # a chain that still grows goes on; plans stay short
            nxt = nxt.checkpoint() if symbols.sparkSession.sparkContext.getCheckpointDir() else nxt
            if nxt.where("at is not null").isEmpty():
                out = nxt
                break
        out = nxt
    return out.select("symbol", "listed_as", "changes")
