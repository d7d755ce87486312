"""Tick streams: minute bars, duplicate rejection, volume steps. Each takes and gives a streaming DataFrame."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.joins import asof_join
from tickloom.streaming.stateful import rocks


def minute_bars(ticks: DataFrame, late: str) -> DataFrame:
    """Bars of ticks (symbol, ts, seq, price), each once, when the watermark (`late` behind the newest tick) has passed its end.

    A tick later than that changes no bar; Spark counts it in
    numRowsDroppedByWatermark. Ticks without a positive price are left out.
    """
    at = F.struct("ts", "seq")
    bars = ticks.where("price > 0").withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n_ticks"))
    return bars.select("symbol", F.col("w.start").alias("minute"), "open", "high", "low", "close", "n_ticks")


def first_seen(ticks: DataFrame, key: list[str], late: str) -> DataFrame:
    """Rows whose key was not seen before, within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def watched_bars(ticks: DataFrame, subscriptions: DataFrame, late: str) -> DataFrame:
    """minute_bars of subscribed symbols, without the minute that a subscription (symbol, since) began in, unless it began with it.

    subscriptions is a table at rest; its rows are joined to each batch.
    """
    whole = F.date_trunc("minute", "ts") >= F.col("since")
    return minute_bars(ticks.join(subscriptions, "symbol").where(whole).drop("since"), late)


def counted(ticks: DataFrame, name: str = "ticks") -> DataFrame:
    """ticks, with counters in the query's progress under `name`: all, without a positive price, with unknown volume. Late ones are in numRowsDroppedByWatermark."""
    return ticks.observe(name, F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("price") <= 0, F.lit(True))).alias("no_price"), F.count_if(F.col("cum").isNull()).alias("unknown_volume"))


def counters(progress: list[dict], name: str = "ticks") -> dict[str, int]:
    """The sums over a query's batches of what `counted` observed, and of late rows."""
    out = {"n": 0, "no_price": 0, "unknown_volume": 0, "late": 0}
    for p in progress:
        seen = (p.get("observedMetrics") or {}).get(name)
        if seen is not None:
            for k in ("n", "no_price", "unknown_volume"):
                out[k] += seen[k] or 0
        out["late"] += sum(op["numRowsDroppedByWatermark"] for op in p.get("stateOperators", []))
    return out


def decisions(rows: DataFrame, context: DataFrame, needed: list[str], score: Column, most: int) -> DataFrame:
    """Ranked picks of each cycle: (cycle, symbol, side, score, place, ready).

    rows: (symbol, cycle, features), one a symbol and cycle. context: versions of
    what is known of a symbol (symbol, known_at, allowed); the newest at or before
    the cycle counts, and without one nothing is allowed. A row is ready if it is
    allowed and all needed features and the score are known; `ready` says how many
    of the cycle are. The `most` of the greatest score either way are picked, equal
    ones by symbol; a score of 0 is no pick.
    """
    versions = context.select("symbol", F.col("known_at").alias("cycle"), "allowed")
    j = asof_join(rows.withColumn("score", score), versions, ["symbol"], "cycle", ["allowed"], ["allowed"])
    known = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in [*needed, "score"]])
    ready = j.where(F.coalesce("allowed", F.lit(False)) & known).withColumn("ready", F.count("*").over(Window.partitionBy("cycle")))
    picked = ready.where("score <> 0").withColumn("place", F.row_number().over(Window.partitionBy("cycle").orderBy(F.abs("score").desc(), "symbol")))
    return picked.where(F.col("place") <= most).select("cycle", "symbol", F.when(F.col("score") > 0, "LONG").otherwise("SHORT").alias("side"), "score", "place", "ready")


def decider(context: str, path: str, needed: list[str], score: Column, most: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: decides the cycles of a batch by the versions that the table `context` (a Parquet path) holds then, and writes them under the batch's number, so that a batch done again replaces its own."""

    def each_batch(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(context)
        decisions(batch, known, needed, score, most).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return each_batch


def decided(features: DataFrame, each_batch: Callable[[DataFrame, int], None], path: str) -> None:
    """Runs all batches of a stream of features that are there through each_batch."""
    with rocks(features.sparkSession):
        features.writeStream.foreachBatch(each_batch).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where none is set and both are one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="checkpoints-")
    return f"{top}/stream-{uuid.uuid4().hex}"


def landed(rows: DataFrame, at: str, batches: int, files: int = 1) -> str:
    """Writes rows in order of `ts` as so many deliveries of so many files each, and gives their folder: a stream with maxFilesPerTrigger = files reads a delivery a batch."""
    spark, folder = rows.sparkSession, f"{shared(rows.sparkSession)}/in"
    cuts = rows.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows.where((F.lit(True) if low is None else F.col(at) > low) & (F.lit(True) if high is None else F.col(at) <= high))
        part.repartition(files).write.mode("append").parquet(folder)
    return folder


def drained(stream: DataFrame, progress: list | None = None) -> DataFrame:
    """All that a stream gives for the input that is there now, in files of the shared folder; progress takes the reports of its batches."""
    spark: SparkSession = stream.sparkSession
    at = shared(spark)
    with rocks(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode("append").start(f"{at}/rows")
        query.awaitTermination()
    if progress is not None:
        progress += [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
