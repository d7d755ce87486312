"""Deadline outcomes, rank and score diagnostics, fitted probabilities."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators.isotonic import interpolated, isotonic
from tickloom.operators.windows import average_rank, quantiles
from tickloom.plans.feature_plans import DAY, KEY, keyed, r6
from tickloom.plans.stat_plans import _NEXT, _panel, brier, log_loss
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

@query(duck(f"""with h as (select distinct session, symbol, hr, close from bars) select {KEY.replace("symbol,", "a.symbol,").replace("(session", "(a.session").replace(", hr", ", a.hr")}, round(b.close / a.close - 1, 6) as at_noon, round(c.close / a.close - 1, 6) as at_twenty
 from bars a left join h b on a.symbol = b.symbol and a.session = b.session and b.hr = 12 and a.hr < 12 left join h c on a.symbol = c.symbol and a.session = c.session and c.hr = 20 and a.hr < 20"""))
def g3_deadline_returns(spark, sf):
    """Return from each bar to the closes of two later hours, by one window a session."""
    b = view(spark, sf, "bars")
    w = Window.partitionBy(*DAY)
    at = lambda h: F.when(F.col("hr") < h, r6(F.max(F.when(F.col("hr") == h, F.col("close"))).over(w) / F.col("close") - 1))
    return keyed(b, at(12).alias("at_noon"), at(20).alias("at_twenty"))


_LEVELS = (0.05, 0.2, 1.0)


@query(duck(f"""with l as (select *, cast(unnest({list(_LEVELS)}) as double) as level from (select symbol, session, min_by(open, hr) as start, max_by(close, hr) as final from bars group by symbol, session)),
 j as (select l.symbol, l.session, level, start, final, min(case when high >= start * (1 + level) then hr end) as up, min(case when low <= start * (1 - level) then hr end) as down from l join bars b on l.symbol = b.symbol and l.session = b.session group by all)
 select symbol, cast(session as varchar) as session, level, cast(up as double) as up_hr, cast(down as double) as down_hr, case when up is null and down is null then 'time' when down is null or up < down then 'up' when up is null or down < up then 'down' else 'both' end as first from j"""))
def g5_level_touches(spark, sf):
    """First touches of several levels around the session's open; what is not touched ends by time."""
    w = Window.partitionBy(*DAY)
    b = view(spark, sf, "bars").withColumn("start", F.min_by("open", "hr").over(w)).withColumn("level", F.explode(F.array(*map(F.lit, _LEVELS))))
    up = F.min(F.when(F.col("high") >= F.col("start") * (1 + F.col("level")), F.col("hr")))
    down = F.min(F.when(F.col("low") <= F.col("start") * (1 - F.col("level")), F.col("hr")))
    g = b.groupBy("symbol", F.col("session").cast("string").alias("session"), "level").agg(up.cast("double").alias("up_hr"), down.cast("double").alias("down_hr"))
    u, d = F.col("up_hr"), F.col("down_hr")
    return g.withColumn("first", F.when(u.isNull() & d.isNull(), "time").when(d.isNull() | (u < d), "up").when(u.isNull() | (d < u), "down").otherwise("both"))


@query(duck(f"""with {_NEXT}, p as (select rank() over (order by rf) + (count(*) over (partition by rf) - 1) / 2.0 as a, rank() over (order by rt) + (count(*) over (partition by rt) - 1) / 2.0 as b from k)
 select count(*) as n, round(corr(a, b), 5) as rho, round(corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))), 3) as t from p"""))
def i8_pooled_spearman(spark, sf):
    """Ranks within sessions, pooled: places come from counts of the few distinct ranks, not from one sort of all rows."""
    k = _panel(spark, sf).withColumn("rf", average_rank(["session"], "feature")).withColumn("rt", average_rank(["session"], "target"))
    for c, name in (("rf", "a"), ("rt", "b")):
        n = k.groupBy(c).agg(F.count("*").alias("m"))
        place = F.sum("m").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) - (F.col("m") - 1) / 2
        k = k.join(n.select(c, place.alias(name)), c)
    rho, n = F.corr("a", "b"), F.count("*")
    return k.agg(n.alias("n"), F.round(rho, 5).alias("rho"), F.round(rho * F.sqrt((n - 2) / (1 - rho * rho)), 3).alias("t"))


@query(duck("""with c as (select quantile_cont(abs(p - 0.3), 0.8) as cut from x7) select count(*) as n, round(avg(power(p - y, 2)), 6) as mse, round(avg(power(0.3 - y, 2)), 6) as neutral,
 count(*) filter (where abs(p - 0.3) >= cut) as top_n, round(avg(sign(p - 0.3) * (y - 0.3)) filter (where abs(p - 0.3) >= cut), 6) as top_utility from x7, c"""))
def i14_score_diagnostics(spark, sf):
    x = view(spark, sf, "x7").withColumn("size", F.abs(F.col("p") - 0.3))
    x = x.crossJoin(F.broadcast(quantiles(x, "size", {"cut": 0.8})))  # one row
    top = F.col("size") >= F.col("cut")
    return x.agg(F.count("*").alias("n"), r6(brier("p", "y")).alias("mse"), r6(F.avg((0.3 - F.col("y")) ** 2)).alias("neutral"), F.count_if(top).alias("top_n"),
                 r6(F.avg(F.when(top, F.signum(F.col("p") - 0.3) * (F.col("y") - 0.3)))).alias("top_utility"))


@query(duck("""with g as (select 'all' as grp, * from x7 union all select 'high', * from x7 where p >= 0.5 union all select 'even', * from x7 where symbol % 2 = 0)
 select grp, coalesce(cast(date_part('month', session) as varchar), 'all') as month, count(*) as n, sum(y)::bigint as hits, round(avg(y), 6) as rate, count(distinct session) as sessions, count(distinct symbol) as symbols from g group by grouping sets ((grp), (grp, date_part('month', session)))"""))
def d19_outcomes_by_group(spark, sf):
    x = view(spark, sf, "x7")
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("p") >= 0.5, "high"), F.when(F.col("symbol") % 2 == 0, "even")))
    x = x.withColumn("grp", F.explode(groups)).withColumn("month", F.explode(F.array(F.lit("all"), F.month("session").cast("string"))))
    return x.groupBy("grp", "month").agg(F.count("*").alias("n"), F.sum("y").alias("hits"), r6(F.avg("y")).alias("rate"), F.countDistinct("session").alias("sessions"), F.countDistinct("symbol").alias("symbols"))


@query(duck("""with s as (select symbol, session, count(*) filter (where hr < 18) as seen, count(*) filter (where abs(close * 20 - round(close * 20)) > 1e-6) as off_grid from bars group by symbol, session)
 select symbol, cast(session as varchar) as session, 18 - seen as missing, off_grid, seen >= 12 as usable from s"""))
def j9_session_audit_to_cutoff(spark, sf):
    steps = F.col("close") * 20
    s = view(spark, sf, "bars").groupBy("symbol", F.col("session").cast("string").alias("session")).agg(F.count_if(F.col("hr") < 18).alias("seen"), F.count_if(F.abs(steps - F.round(steps)) > 1e-6).alias("off_grid"))
    return s.select("symbol", "session", (18 - F.col("seen")).alias("missing"), "off_grid", (F.col("seen") >= 12).alias("usable"))


def _features(spark, sf):
    """Rows with `label`, and `later` for the last third of the sessions' days."""
    x = view(spark, sf, "x7").withColumn("later", F.dayofmonth("session") > 20)
    x = x.select("*", F.col("y").cast("double").alias("label"), (F.col("symbol") % 7).cast("double").alias("s7"), F.dayofweek("session").cast("double").alias("dow"))
    return VectorAssembler(inputCols=["p", "s7", "dow"], outputCol="features").transform(x)


def _scored(model, x):
    return model.transform(x).select("event_id", "symbol", "later", "y", F.round(vector_to_array("probability")[1], 9).alias("q"))


@query()
def l1_boosted_probability(spark, sf):
    """Fitted on earlier days; each sixth of them says when to stop. Rows carry the probability; without both labels on earlier days there are none."""
    x = _features(spark, sf)
    fit = x.where("not later").withColumn("check", F.dayofmonth("session") > 17)
    if fit.select("label").distinct().count() < 2:
        return x.limit(0).select("event_id", "later", F.lit(0.0).alias("probability"))
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=7, validationIndicatorCol="check").fit(fit)
    return _scored(model, x).select("event_id", "later", F.col("q").alias("probability"))


@query()
def l2_platt_calibration(spark, sf):
    """A logistic map on the log odds of p, fitted on earlier days; log loss before and after on later ones. Without both labels on earlier days, nothing."""
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    x = _features(spark, sf).drop("features").withColumn("odds", F.log(p / (1 - p)))
    x = VectorAssembler(inputCols=["odds"], outputCol="features").transform(x)
    if x.where("not later").select("label").distinct().count() < 2:
        return x.limit(0).select("later", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("raw"), F.lit(0.0).alias("calibrated"))
    q = LogisticRegression(maxIter=50).fit(x.where("not later"))
    both = q.transform(x).select("later", "y", "p", vector_to_array("probability")[1].alias("q"))
    return both.groupBy("later").agg(F.count("*").alias("n"), r6(log_loss("p", "y")).alias("raw"), r6(log_loss("q", "y")).alias("calibrated"))


#: Places of a score that the fit tells apart; the days that maps are fitted on end before the first, those that choose among them before the second.
PLACES, CHOICE, USE = 2, "2024-01-15", "2024-01-22"


@query(duck(f"""with g as (select round(p, {PLACES}) as x, count(*) as w, sum(y) as t from x7 where cast(session as varchar) < '{CHOICE}' group by 1), i as (select *, row_number() over (order by x) as k, sum(w) over (order by x) as cw, sum(t) over (order by x) as ct from g),
 m as (select a.k as a, b.k as b, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w)::double as mean from i a join i b on b.k >= a.k),
 lo as (select a, b as k, min(mean) over (partition by a order by b desc rows unbounded preceding) as least from m), f as (select k, max(least) as value from lo where a <= k group by k),
 s as (select x, w, round(value, 9) as value from i join f using (k)) select min(x) as low, max(x) as high, cast(sum(w) as double) as weight, any_value(round(value, 6)) as value from s group by s.value"""))
def l2_isotonic_fit(spark, sf):
    """Steps of the isotonic map of scores to outcomes on the days for fitting."""
    x = view(spark, sf, "x7").where(F.col("session").cast("string") < CHOICE).withColumn("x", F.round("p", PLACES))
    return isotonic(x, "x", "y").withColumn("value", r6("value"))


def calibrations(fit, score: str, outcome: str) -> dict:
    """Maps of a score by name: as it is, logistic in its log odds, isotonic; fitted on rows with both outcomes, else the first alone."""
    odds = lambda c: F.log(F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))))
    maps = {"raw": lambda df, name: df.withColumn(name, F.col(score))}
    if fit.select(outcome).where(F.col(outcome).isNotNull()).distinct().count() < 2:
        return maps
    gather = VectorAssembler(inputCols=["__odds"], outputCol="__features", handleInvalid="skip")
    model = LogisticRegression(maxIter=50, featuresCol="__features", labelCol="__label").fit(gather.transform(fit.select(odds(F.col(score)).alias("__odds"), F.col(outcome).cast("double").alias("__label"))))
    slope, start = float(model.coefficients[0]), float(model.intercept)
    steps = sorted((r["low"], r["high"], r["value"]) for r in isotonic(fit, score, outcome).collect())
    maps["platt"] = lambda df, name: df.withColumn(name, 1 / (1 + F.exp(-(F.lit(start) + slope * odds(F.col(score))))))
    maps["isotonic"] = lambda df, name: df.withColumn(name, interpolated(steps, F.col(score)))
    return maps


def chosen_calibration(fit, choice, score: str, outcome: str) -> tuple[dict, str, dict[str, float]]:
    """Maps fitted on `fit`, the name of that of the least log loss on `choice` (the earlier of equal ones), and the losses. No rows to choose by: raw."""
    maps = calibrations(fit, score, outcome)
    names = list(maps)
    both = choice
    for name in names:
        both = maps[name](both, f"__{name}")
    r = both.agg(*[F.round(log_loss(f"__{name}", outcome), 6).alias(name) for name in names]).first()
    losses = {name: r[name] for name in names}
    return maps, min(names, key=lambda name: (losses[name] is None, losses[name] or 0.0)), losses


@query()
def l2_chosen_calibration(spark, sf):
    """Raw, logistic or isotonic, fitted on early days and chosen by the log loss of the days after them; how each fares on the last days, and which was chosen."""
    x = view(spark, sf, "x7").withColumn("d", F.col("session").cast("string"))
    maps, chosen, losses = chosen_calibration(x.where(F.col("d") < CHOICE), x.where((F.col("d") >= CHOICE) & (F.col("d") < USE)), "p", "y")
    rest, out = x.where(F.col("d") >= USE), None
    for name in maps:
        one = maps[name](rest, "q").agg(F.lit(name).alias("map"), F.lit(name == chosen).alias("chosen"), F.lit(losses[name]).cast("double").alias("choice_loss"), F.count("*").alias("n"), r6(log_loss("q", "y")).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out
