"""Streams over the given events, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans import feature_plans as fp
from tickloom.registry import query
from tickloom.streaming.stateful import bar_averages, bar_features, volume_steps, warmed
from tickloom.streaming.ticks import counted, counters, decided, decider, drained, first_seen, landed, minute_bars, shared, watched_bars


def _ticks(spark, sf, symbol):
    path = f"{sf}/events.parquet"
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a file or a folder
    return stream.select(F.col(symbol).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


@query("""select event_type as symbol, cast(date_trunc('minute', ts) as varchar) as minute, min_by(value, (ts, event_id)) as open, max(value) as high, min(value) as low, max_by(value, (ts, event_id)) as close, count(*) as n_ticks
 from events where value > 0 group by event_type, date_trunc('minute', ts)
 having date_trunc('minute', ts) + interval 1 minute <= (select max(ts) from events where value > 0) - interval 10 minute""")
def k1_stream_bars(spark, sf):
    """Bars that are final: their end lies ten minutes or more before the newest tick."""
    bars = drained(minute_bars(_ticks(spark, sf, "event_type"), "10 minutes"))
    return bars.withColumn("minute", F.col("minute").cast("string"))


#: Deliveries of a stream; minutes of a bucket, behind the newest tick, and after which a silent symbol is forgotten.
BATCHES, BUCKET, LATE, IDLE = 4, 360, 10, 45


def _deliveries(spark, sf):
    """The events as a stream of several batches, in order of time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("cum"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed(events, "ts", BATCHES))


#: Readings whose bucket the watermark has passed in the end.
_PASSED = f"""p as (select event_type as symbol, event_id as seq, ts, event_id // 3 as cum from events
 where to_timestamp((floor(epoch(ts) / {60 * BUCKET}) + 1) * {60 * BUCKET}) at time zone 'UTC' <= (select max(ts) from events) - interval {LATE} minute)"""


@query(f"""with {_PASSED}, m as (select *, max(cum) over (partition by symbol order by ts, seq rows between unbounded preceding and current row) as top from p)
 select symbol, seq, coalesce(top - lag(top) over (partition by symbol order by ts, seq), -1) as step from m""")
def k4_stream_volume_steps(spark, sf):
    """Unknown steps are -1; rows come out once the watermark has passed their bucket."""
    return drained(volume_steps(_deliveries(spark, sf), None, f"{LATE} minutes", BUCKET)).withColumn("step", F.coalesce("step", F.lit(-1)))


@query("select count(*) as n, count(distinct event_id) as ids from events")
def k6_stream_first_seen(spark, sf):
    """Every event twice in the stream; each id passes once."""
    ticks = _ticks(spark, sf, "event_type")
    once = drained(first_seen(ticks.unionByName(ticks.withColumn("price", F.col("price") + 1)), ["seq"], "10 minutes"))
    return once.agg(F.count("*").alias("n"), F.countDistinct("seq").alias("ids"))


@query("""with s as (select distinct event_type as symbol, timestamp '2024-01-05 10:20:30' + cast(length(event_type) % 3 as int) * interval 30 second as since from events), t as (select event_type as symbol, ts, event_id, value from events where value > 0)
 select t.symbol, cast(date_trunc('minute', ts) as varchar) as minute, min_by(value, (ts, event_id)) as open, max_by(value, (ts, event_id)) as close, count(*) as n_ticks from t join s using (symbol) where date_trunc('minute', ts) >= since group by t.symbol, date_trunc('minute', ts)
 having date_trunc('minute', ts) + interval 1 minute <= (select max(ts) from t join s using (symbol) where date_trunc('minute', ts) >= since) - interval 10 minute""")
def k2_watched_bars(spark, sf):
    """Bars of minutes that were watched from their start."""
    seconds = F.make_interval(secs=30 * (F.length("event_type") % 3))
    since = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), (F.lit("2024-01-05 10:20:30").cast("timestamp") + seconds).alias("since")).distinct()
    bars = drained(watched_bars(_ticks(spark, sf, "event_type"), since, "10 minutes"))
    return bars.select("symbol", F.col("minute").cast("string").alias("minute"), "open", "close", "n_ticks")


@query("select count(*) as n, count(*) filter (where value <= 0) as no_price, count(*) filter (where event_id % 9 = 0) as unknown_volume, 0::bigint as late from events")
def k3_stream_counters(spark, sf):
    """What the progress of a drained stream counted: ticks, those without a price, unknown volumes, late ones."""
    ticks = _ticks(spark, sf, "event_type").withColumn("cum", F.when(F.col("seq") % 9 != 0, F.col("seq")))
    reports: list = []
    drained(minute_bars(counted(ticks), "10 minutes"), reports)
    found = counters(reports)
    return spark.createDataFrame([tuple(found.values())], "n long, no_price long, unknown_volume long, late long")


#: The session from which bars come as a stream; those before it only warm the state.
LIVE = "2024-01-11"
_AVERAGES = bar_averages(fp.SHORT, fp.LONG, fp.RANGE)
STEPS, OPENING, ANCHOR = 24, 2, 1
_JOIN = "(symbol, session, hr)"


def _batch_sql(name: str) -> str:
    from tickloom.registry import ORACLES

    return ORACLES[name]


@query(f"""with a as ({_batch_sql("e2_ema")}), b as ({_batch_sql("e4_rsi")}), c as ({_batch_sql("e7_atr")}), d as ({_batch_sql("e12_session_context")}),
 n as (select symbol, max(session) as newest from a group by symbol)
 select a.*, rsi, true_range, atr, s_open, s_high, s_low, s_volume, or_high, or_low from a join b using {_JOIN} join c using {_JOIN} join d using {_JOIN}
 where session >= '{LIVE}' and cast(session as timestamp) + to_hours(cast(hr + 1 as bigint)) <= (select max(cast(session as timestamp) + to_hours(cast(hr as bigint))) from a)""")
def k5_stream_features(spark, sf):
    """Bars of later sessions as a stream of several batches, from states that the sessions before it leave: the rows of the batch queries of averages, strength, range and session context."""
    exact = ("s_open", "s_high", "s_low", "s_volume", "or_high", "or_low")
    f = _placed(drained(_live_features(spark, sf)))
    return f.select("symbol", F.to_date("bar_start").cast("string").alias("session"), F.hour("bar_start").alias("hr"), fp.r6("short").alias("ema_short"), fp.r6("long").alias("ema_long"), fp.r6("rsi").alias("rsi"), fp.r6("true_range").alias("true_range"), fp.r6("atr").alias("atr"), *exact)


def _live_features(spark, sf):
    """The stream of features of bars from LIVE on, by the state that the bars before leave."""
    bars = fp.bars_in_runs(spark, sf, "close").withColumn("ts", F.col("bar_start").cast("timestamp")).withColumn("seq", F.datediff("session", F.lit("1970-01-01")) * STEPS + F.col("hr"))
    old, new = bars.where(F.col("session") < LIVE), bars.where(F.col("session") >= LIVE).select("symbol", "ts", "seq", "open", "high", "low", "close", "volume")
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(landed(new, "ts", BATCHES))
    return bar_features(stream, _AVERAGES, STEPS, OPENING, ANCHOR, "0 seconds", 3600, warmed(old, _AVERAGES, STEPS, OPENING))


def _placed(features):
    """With the time that a bar starts at; its place since the epoch is in hours."""
    return features.withColumn("bar_start", F.timestamp_seconds(F.col("seq") * 3600))


@query(f"""with {_PASSED}, g as (select *, coalesce(ts - lag(ts) over (partition by symbol order by ts, seq) > interval {IDLE} minute, true) as anew from p),
 i as (select *, sum(anew::int) over (partition by symbol order by ts, seq) as island from g), m as (select *, max(cum) over (partition by symbol, island order by ts, seq rows between unbounded preceding and current row) as top from i)
 select symbol, seq, coalesce(top - lag(top) over (partition by symbol, island order by ts, seq), -1) as step from m""")
def k9_state_eviction(spark, sf):
    """Steps whose state goes when its symbol is silent for three quarters of an hour: its next reading is a first one again."""
    return drained(volume_steps(_deliveries(spark, sf), IDLE, f"{LATE} minutes", BUCKET)).withColumn("step", F.coalesce("step", F.lit(-1)))


#: Picks of a cycle.
MOST = 2


@query(f"""with k as ({_batch_sql("k5_stream_features")}), f as (select symbol, cast(session as timestamp) + to_hours(cast(hr + 1 as bigint)) as cycle, ema_short, ema_long, rsi, atr from k),
 v as (select event_type as symbol, cast(cast(ts as date) as timestamp) + interval 30 hour as known_at, count(*) % 3 <> 0 as allowed from events group by 1, 2),
 j as (select f.*, allowed, (ema_short - ema_long) / atr as score from f asof left join v on f.symbol = v.symbol and f.cycle >= v.known_at),
 r as (select *, count(*) over (partition by cycle) as ready from j where allowed and ema_short is not null and ema_long is not null and rsi is not null and atr is not null and score is not null),
 p as (select *, row_number() over (partition by cycle order by abs(score) desc, symbol) as place from r where score <> 0)
 select cast(cycle as varchar) as cycle, symbol, case when score > 0 then 'LONG' else 'SHORT' end as side, round(score, 6) as score, place, ready from p where place <= {MOST}""")
def k10_decision_cycles(spark, sf):
    """Bars to features by the state of the stream, the context of each cycle's time, complete inputs, ranked picks, batch by batch."""
    at = shared(spark)
    days = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg((F.count("*") % 3 != 0).alias("allowed"))
    days.select("symbol", (F.col("day") + F.expr("interval 30 hours")).alias("known_at"), "allowed").write.parquet(f"{at}/context")
    needed = ["short", "long", "rsi", "atr"]
    rows = _placed(_live_features(spark, sf)).select("symbol", (F.col("bar_start") + F.expr("interval 1 hour")).alias("cycle"), *[fp.r6(c).alias(c) for c in needed])
    decided(rows, decider(f"{at}/context", at, needed, (F.col("short") - F.col("long")) / F.col("atr"), MOST), at)
    d = spark.read.schema("cycle timestamp, symbol string, side string, score double, place int, ready long, batch int").parquet(f"{at}/rows").drop("batch")
    return d.select(F.col("cycle").cast("string").alias("cycle"), "symbol", "side", fp.r6("score").alias("score"), "place", "ready")
