"""Isotonic regression: pool-adjacent-violators within ranges, whose tables of blocks are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges whose blocks one task merges.
FAN = 8
_BLOCKS = "part long, low double, high double, weight double, total double"


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[list, list, list, list]:
    """Blocks in order, neighbours put together until their means rise. Blocks of equal means are one."""
    lows, highs, weights, totals = [], [], [], []
    for a, b, w, t in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist(), strict=True):
        while weights and totals[-1] * w >= t * weights[-1]:
            a = lows.pop()
            highs.pop()
            w += weights.pop()
            t += totals.pop()
        lows.append(a)
        highs.append(b)
        weights.append(w)
        totals.append(t)
    return lows, highs, weights, totals


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of a sorted range, pooled batch by batch."""
    from pyspark import TaskContext

    held = None
    for b in batches:
        both = b if held is None else pd.concat([held, b], ignore_index=True)
        held = pd.DataFrame(dict(zip(("low", "high", "weight", "total"), pooled(*(both[c].to_numpy() for c in ("low", "high", "weight", "total"))), strict=True)))
    if held is not None:
        yield held.assign(part=TaskContext.get().partitionId())


def _merged(blocks: pd.DataFrame) -> pd.DataFrame:
    b = blocks.sort_values("low", kind="stable")
    out = pd.DataFrame(dict(zip(("low", "high", "weight", "total"), pooled(*(b[c].to_numpy() for c in ("low", "high", "weight", "total"))), strict=True)))
    return out.assign(part=b["part"].min() // FAN)


def isotonic(df: DataFrame, x: str, y: str) -> DataFrame:
    """(low, high, weight, value): the steps of the rising function of x with the least squared distance from y.

    Rows of equal x count as one, with their mean; rows without x or y don't count.
    Ranges of x are pooled by tasks of their own; a task then merges the blocks of
    FAN neighbouring ranges, until one table is left. It holds the steps of the fit,
    not the rows.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("low")).agg(F.count("*").cast("double").alias("weight"), F.sum(F.col(y).cast("double")).alias("total"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = points.repartitionByRange(n, "low").sortWithinPartitions("low").select("low", F.col("low").alias("high"), "weight", "total")
    blocks = ranges.mapInPandas(_within, _BLOCKS)
    while n > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / FAN).alias("__g")).applyInPandas(_merged, _BLOCKS)
        n = -(-n // FAN)
    return blocks.select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def interpolated(steps: list[tuple[float, float, float]], x: Column) -> Column:
    """x mapped through steps (low, high, value): level within a step, linear between two, level beyond the ends. The steps are a model, held as Spark ML holds its own."""
    at = np.array([v for low, high, _ in steps for v in ((low,) if low == high else (low, high))])
    level = np.array([v for low, high, value in steps for v in ((value,) if low == high else (value, value))])

    @F.pandas_udf("double")
    def mapped(values: pd.Series) -> pd.Series:
        known = values.notna()
        out = pd.Series(np.nan, index=values.index)
        out[known] = np.interp(values[known].to_numpy(float), at, level)
        return out

    return mapped(x)
