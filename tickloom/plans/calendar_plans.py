"""Calendars, action dates, prior sessions, paired decision rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators.joins import interval_join
from tickloom.plans.feature_plans import DAILY, DAY, KEY, daily_keyed, keyed, r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view


@query(duck("""with s as (select symbol, cast(unnest(generate_series(cast(min(session) as timestamp), cast(max(session) as timestamp), interval 1 day)) as date) as session from bars group by symbol),
 e as (select symbol, session, case when date_part('day', session) % 10 = 0 then 12 else 24 end as expected from s)
 select e.symbol, cast(e.session as varchar) as session, any_value(expected) as expected, any_value(expected) - count(b.hr) as missing from e left join bars b on e.symbol = b.symbol and e.session = b.session and b.hr < expected group by e.symbol, e.session"""))
def b6_expected_bars(spark, sf):
    """Bars due on each day from a symbol's first to its last; every tenth day closes early."""
    bars = view(spark, sf, "bars")
    due = F.when(F.dayofmonth("session") % 10 == 0, 12).otherwise(24)
    spine = bars.groupBy("symbol").agg(F.explode(F.sequence(F.min("session"), F.max("session"))).alias("session")).withColumn("expected", due)
    held = bars.where(F.col("hr") < due).groupBy(*DAY).agg(F.count("*").alias("held"))
    j = spine.join(held, DAY, "left")
    return j.select("symbol", F.col("session").cast("string").alias("session"), "expected", (F.col("expected") - F.coalesce("held", F.lit(0))).alias("missing"))


@query(duck(f"""with m as (select distinct idx, dense_rank() over (order by idx) as place from daily), p as (select d.*, m.place from daily d join m using (idx))
 select a.symbol, cast(cast(a.session as timestamp) as varchar) as session, b.close as prior_close from p a left join p b on a.symbol = b.symbol and b.place = a.place - 1"""))
def c4_prior_market_session(spark, sf):
    """A symbol's row of the session before in the market's calendar; null where it had none."""
    d = view(spark, sf, "daily")
    calendar = d.select("idx").distinct().withColumn("place", F.row_number().over(Window.orderBy("idx")))  # one row a session
    p = d.join(calendar, "idx")
    return daily_keyed(p.join(p.select("symbol", (F.col("place") + 1).alias("place"), F.col("close").alias("prior_close")), ["symbol", "place"], "left"), "prior_close")


@query(duck("""with t as (select trade_id, symbol, cast(session as timestamp) as until_, cast(session as timestamp) - interval 200 day as after_ from x8), a as (select symbol, cast(session as timestamp) as ex from daily where n % 11 = 0)
 select trade_id, count(*) as actions, power(0.5, count(*)) as factor from t join a on t.symbol = a.symbol and ex > after_ and ex <= until_ group by trade_id"""))
def c7_actions_by_ex_date(spark, sf):
    """Actions that went ex within 200 days before a trade, and their common factor."""
    t = view(spark, sf, "x8").select("trade_id", "symbol", F.col("session").cast("timestamp").alias("until")).withColumn("after", F.expr("until - interval 200 days"))
    a = view(spark, sf, "daily").where("n % 11 = 0").select(F.col("symbol").cast("long").alias("symbol"), F.col("session").cast("timestamp").alias("ex"))
    found = interval_join(t, a, "symbol", "after", "until", "ex", 200 * 86400)
    return found.groupBy("trade_id").agg(F.count("*").alias("actions"), F.pow(F.lit(0.5), F.count("*")).alias("factor"))
