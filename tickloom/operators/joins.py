"""Joins in time: as-of, interval, neighbour sessions, first touch of a barrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str], order: list[str], bucket: str = "day") -> DataFrame:
    """left with the newest right row at or before `at` in each group, by one union and windows (no range join).

    A window covers one group and time bucket, so that a group with a long history
    is many tasks' work; where a bucket has no earlier row of its own, the last one
    of the buckets before it comes from a small table with a row for each group and
    bucket. order breaks ties among right rows of one time.
    """
    keep = [c for c in left.columns if c not in by and c != at]
    a = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*keep).alias("__row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__new"),
                    *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order)])
    b = right.select(*by, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*columns).alias("__new"),
                     *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    places = ["__at", "__side", *[f"__o{i}" for i in range(len(order))]]
    both = a.unionByName(b).withColumn("__bucket", F.date_trunc(bucket, "__at"))
    w = Window.partitionBy(*by, "__bucket").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__last", F.last("__new", ignorenulls=True).over(w)).where("__side = 1")
    ends = both.groupBy(*by, "__bucket").agg(F.max_by("__new", F.when(F.col("__side") == 0, F.struct(*places))).alias("__end"))
    carried = ends.select(*by, "__bucket", F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    out = own.join(carried, [*by, "__bucket"], "left").withColumn("__last", F.coalesce("__last", "__carried"))
    return out.select(*by, F.col("__at").alias(at), *[F.col(f"__row.{c}").alias(c) for c in keep], *[F.col(f"__last.{c}").alias(c) for c in columns])


def interval_join(left: DataFrame, right: DataFrame, by: str, start: str, end: str, at: str, bucket_seconds: int, how: str = "inner") -> DataFrame:
    """left x right where start < right.at <= end, equal on `by`: an equi join on time buckets, then the exact test."""
    unit = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_seconds)
    a = left.withColumn("__b", F.explode(F.sequence(unit(start), unit(end))))
    b = right.withColumn("__b", unit(at)).withColumnRenamed(by, f"__{by}")
    return a.join(b, (a[by] == b[f"__{by}"]) & (a["__b"] == b["__b"]) & (b[at] > a[start]) & (b[at] <= a[end]), how).drop(f"__{by}", "__b")


def neighbour(df: DataFrame, by: str, index: str, columns: list[str], step: int, suffix: str) -> DataFrame:
    """Columns of the row exactly `step` sessions away, null where the neighbour is another session."""
    w = Window.partitionBy(by).orderBy(index)
    shift = F.lag if step < 0 else F.lead
    there = shift(index, abs(step)).over(w) == F.col(index) + step
    return df.select("*", *[F.when(there, shift(c, abs(step)).over(w)).alias(c + suffix) for c in columns])


def forward_window(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """`ahead`: the (step, open, high, low, close) of the next n rows of a group, in order; n bounds the array."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1, n)
    return df.withColumn("ahead", F.collect_list(F.struct(F.col(order).alias("step"), "open", "high", "low", "close")).over(w))


def first_touch(df: DataFrame, target: float, stop: float) -> DataFrame:
    """From `close` over `ahead`: steps of the first bar at or above +target and at or below -stop, best and worst moves, last return."""
    up = F.col("close") * (1 + target)
    down = F.col("close") * (1 - stop)
    first = lambda test: F.element_at(F.filter("ahead", test), 1)["step"]
    df = df.withColumn("__up", up).withColumn("__down", down)
    return df.select(
        *[c for c in df.columns if not c.startswith("__")],
        F.when(F.size(F.filter("ahead", lambda a: a["high"] >= F.col("__up"))) > 0, first(lambda a: a["high"] >= F.col("__up"))).alias("up_step"),
        F.when(F.size(F.filter("ahead", lambda a: a["low"] <= F.col("__down"))) > 0, first(lambda a: a["low"] <= F.col("__down"))).alias("down_step"),
        (F.array_max(F.transform("ahead", lambda a: a["high"])) / F.col("close") - 1).alias("best"),
        (F.array_min(F.transform("ahead", lambda a: a["low"])) / F.col("close") - 1).alias("worst"),
        F.when(F.size("ahead") > 0, F.element_at("ahead", -1)["close"] / F.col("close") - 1).alias("last_return"),
    )
