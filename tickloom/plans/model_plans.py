"""Models over time: walk-forward fits, permutation reliance."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.feature_plans import r6
from tickloom.plans.stat_plans import log_loss
from tickloom.registry import query
from tickloom.sources.fixtures import view

INPUTS = ("p", "s7", "dow")


def rows(spark, sf) -> DataFrame:
    """Inputs, label, the day that the outcome resolved and the period of the session."""
    x = view(spark, sf, "x7")
    return x.select("event_id", "session", "p", (F.col("symbol") % 7).cast("double").alias("s7"), F.dayofweek("session").cast("double").alias("dow"), F.col("y").cast("double").alias("label"),
                    F.date_add("session", 2).alias("resolved"), F.floor((F.dayofmonth("session") - 1) / 8).cast("int").alias("period"))


def fitted(train: DataFrame, inputs: tuple[str, ...] = INPUTS):
    return LogisticRegression(maxIter=30, regParam=1e-4).fit(VectorAssembler(inputCols=list(inputs), outputCol="features").transform(train))


def scored(model, df: DataFrame, inputs: tuple[str, ...] = INPUTS) -> DataFrame:
    out = model.transform(VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df))
    return out.withColumn("q", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def walk_forward(df: DataFrame) -> DataFrame:
    """Each period scored by a model of the rows whose outcome was known before its first session; periods without such rows, or with one label, are left out.

    The driver loops over the few periods; each fit is distributed.
    """
    starts = sorted((r["period"], r["first"]) for r in df.groupBy("period").agg(F.min("session").alias("first")).collect())
    out = None
    for period, first in starts:
        train = df.where(F.col("resolved") < F.lit(first))
        if train.select("label").distinct().count() < 2:
            continue
        part = scored(fitted(train), df.where(F.col("period") == period))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("q", F.lit(0.0))


@query()
def l4_walk_forward(spark, sf):
    s = walk_forward(rows(spark, sf))
    return s.groupBy("period").agg(F.count("*").alias("n"), r6(log_loss("q", "label")).alias("log_loss"), r6(F.avg("q")).alias("mean"), r6(F.avg("label")).alias("rate"))


def shuffled(df: DataFrame, column: str, by: str, key: str, seed: str) -> DataFrame:
    """df with the values of a column dealt anew within each group: places by two hashes are joined, so that no task sorts all rows."""
    place = lambda salt: F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(salt), key), key))
    given = df.select(by, place(f"{seed}-a").alias("__i"), F.col(column).alias("__v"))
    return df.withColumn("__i", place(f"{seed}-b")).join(given, [by, "__i"]).withColumn(column, F.col("__v")).drop("__i", "__v")


@query()
def l7_permutation_reliance(spark, sf):
    """How much the log loss of a fitted model grows when one input is dealt anew within sessions. Without both labels on earlier days, nothing."""
    df = rows(spark, sf)
    if df.where("period < 2").select("label").distinct().count() < 2:
        return df.limit(0).select(F.lit("").alias("input"), F.lit(0.0).alias("loss"))
    model = fitted(df.where("period < 2"))
    later = df.where("period >= 2")
    loss = lambda d: scored(model, d).agg(r6(log_loss("q", "label")).alias("loss"))
    out = loss(later).select(F.lit("none").alias("input"), "loss")
    for c in INPUTS:
        out = out.unionByName(loss(shuffled(later, c, "session", "event_id", c)).select(F.lit(c).alias("input"), "loss"))
    return out
