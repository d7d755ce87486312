"""Recursive averages over long histories: a parallel scan over affine maps.

A group's rows are cut into parts (sessions, or blocks of them). What a part does
to the state is an affine map, s -> a * s + b: maps are composed within parts,
the few maps of a group are prefixed, and each part is worked off from the state
that enters it. No task holds a group, and powers stay within a part.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Average:
    """A recursive average of `column`: the mean of the first n known values, then s += weight * (x - s). hold: rows of unknown values show the average before them, instead of null."""

    column: str
    n: int
    weight: float
    hold: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.weight < 1 or self.n < 1:
            raise ValueError("an average needs a weight between 0 and 1 and a value at least")


def exponential(column: str, n: int) -> Average:
    return Average(column, n, 2 / (n + 1))


def wilder(column: str, n: int, hold: bool = False) -> Average:
    return Average(column, n, 1 / n, hold)


#: What powers of 1 / (1 - weight) may reach within a part, as a logarithm.
_REACH = 300.0


def _block(averages: Iterable[Average]) -> int:
    """Steps of a part that keep its powers within reach."""
    return min(max(1, int(_REACH / -math.log(1 - a.weight))) for a in averages)


def with_previous(df: DataFrame, by: list[str], part: str, step: str, columns: list[str]) -> DataFrame:
    """df with `previous_<column>`: that of the row before in its group, over parts; null where the row follows a gap (`gap` = 1).

    Within a part by a window; a part's first row takes the end of the last part
    before it, from a table with a row a part.
    """
    w = Window.partitionBy(*by, part).orderBy(step)
    ends = df.groupBy(*by, part).agg(*[F.max_by(c, step).alias(f"__end_{c}") for c in columns])
    before = Window.partitionBy(*by).orderBy(part)
    ends = ends.select(*by, part, *[F.lag(f"__end_{c}").over(before).alias(f"__end_{c}") for c in columns])
    rows = df.select("*", F.row_number().over(w).alias("__at"), *[F.lag(c).over(w).alias(f"__lag_{c}") for c in columns]).join(ends, [*by, part])
    own = lambda c: F.when(F.col("gap") == 0, F.when(F.col("__at") == 1, F.col(f"__end_{c}")).otherwise(F.col(f"__lag_{c}")))
    return rows.select(*df.columns, *[own(c).alias(f"previous_{c}") for c in columns])


def _entered(names: list[str], part: list[str]):
    """The state that enters each part, from the maps of those before it."""

    def run(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values(part, kind="stable")
        for c in names:
            s, states = 0.0, []
            for a, b in zip(maps[f"__a_{c}"].tolist(), maps[f"__b_{c}"].tolist(), strict=True):
                states.append(s)
                s = a * s + b
            maps[f"__s_{c}"] = states
        return maps.drop(columns=[f"__{x}_{c}" for c in names for x in "ab"])

    return run


def smoothed(df: DataFrame, by: list[str], part: str, step: str, averages: dict[str, Average], steps: int = 1440, places: bool = False, states: bool = False) -> DataFrame:
    """df (with `gap` = 1 where a row follows a gap) with recursive averages by name.

    Rows of a group go by part, then step, a whole number below `steps` that is
    unique in its part. The state goes on from part to part and starts anew after a
    gap. A null value leaves the state and is null itself, unless held; so are the
    first n - 1 known values of a run. places: also `run` and `place`, the number of gaps before
    a row in its group and its place in the run. states: also what `Fold` would hold
    after the row, as n_<name> and s_<name>. Long parts are cut at fixed steps
    where powers of a heavy weight would not fit in a double.
    """
    names = sorted(averages)
    block = _block(averages.values())
    parts = [part] if steps <= block else [part, "__block"]
    rows = df if steps <= block else df.withColumn("__block", F.floor(F.col(step) / block))
    key = [*by, *parts]
    order = Window.partitionBy(*key).orderBy(step)
    rows = rows.withColumn("__seg", F.sum("gap").over(order))
    piece = Window.partitionBy(*key, "__seg").orderBy(step)
    rows = rows.select("*", F.row_number().over(piece).alias("__i"), *[F.col(averages[c].column).cast("double").alias(f"__x_{c}") for c in names], *[F.count(averages[c].column).over(piece).alias(f"__c_{c}") for c in names])

    # How many known values of its run each part begins with.
    ends = rows.groupBy(*key).agg(F.max("__seg").alias("__segs"), F.max_by("__i", F.struct("__seg", "__i")).alias("__n_"), *[F.max_by(f"__c_{c}", F.struct("__seg", "__i")).alias(f"__n_{c}") for c in names])
    line = Window.partitionBy(*by).orderBy(*parts)
    ends = ends.withColumn("__run", F.sum("__segs").over(line))
    since = Window.partitionBy(*by, "__run").orderBy(*parts)
    counted = ["", *names]
    ends = ends.select(*key, "__segs", "__run", *[F.sum(f"__n_{c}").over(since).alias(f"__k_{c}") for c in counted])
    ends = ends.select(*key, "__segs", F.coalesce(F.lag("__run").over(line), F.lit(0)).alias("__run"), *[F.coalesce(F.lag(f"__k_{c}").over(line), F.lit(0)).alias(f"__k_{c}") for c in counted])

    first = F.col("__seg") == 0

    def decays(c: str, known: Column) -> Column:
        """How often the state was multiplied since the piece began, known values of the run being counted."""
        n = averages[c].n
        return F.greatest(F.lit(0), known - n) - F.when(first, F.greatest(F.lit(0), F.col(f"__k_{c}") - n)).otherwise(0)

    def added(c: str) -> Column:
        x, a = F.col(f"__x_{c}"), averages[c]
        return F.when(x.isNull(), 0.0).when(F.col(f"__place_{c}") <= a.n, x / a.n).otherwise(a.weight * x)

    placed = rows.join(ends, key)
    placed = placed.select("*", *[(F.col(f"__c_{c}") + F.when(first, F.col(f"__k_{c}")).otherwise(0)).alias(f"__place_{c}") for c in names])
    placed = placed.select("*", *[decays(c, F.col(f"__place_{c}")).alias(f"__m_{c}") for c in names], *[added(c).alias(f"__add_{c}") for c in names])

    keep = {c: F.lit(1 - averages[c].weight) for c in names}
    last = F.col("__seg") == F.col("__segs")
    totals = placed.where(last).select(*key, "__segs", *[f"__{x}_{c}" for c in names for x in ("m", "add")])
    whole = totals.groupBy(*key).agg(F.max("__segs").alias("__segs"), *[F.max(f"__m_{c}").alias(f"__top_{c}") for c in names], *[_decayed(c, keep[c]).alias(f"__b_{c}") for c in names])
    maps = whole.select(*key, *[F.when(F.col("__segs") > 0, 0.0).otherwise(F.pow(keep[c], F.col(f"__top_{c}"))).alias(f"__a_{c}") for c in names], *[f"__b_{c}" for c in names])
    kept = maps.select(*key, *[F.lit(0.0).alias(f"__s_{c}") for c in names]).schema
    entered = maps.groupBy(*by).applyInPandas(_entered(names, parts), kept)

    out = []
    for c in names:
        sums = F.sum(F.col(f"__add_{c}") * F.pow(keep[c], -F.col(f"__m_{c}"))).over(piece)
        value = F.pow(keep[c], F.col(f"__m_{c}")) * (sums + F.when(first, F.col(f"__s_{c}")).otherwise(0.0))
        shown = F.col(f"__place_{c}") >= averages[c].n
        out.append(F.when(shown if averages[c].hold else shown & F.col(f"__x_{c}").isNotNull(), value).alias(c))
        if states:
            out += [F.col(f"__place_{c}").alias(f"n_{c}"), F.coalesce(value, F.when(first, F.col(f"__s_{c}")), F.lit(0.0)).alias(f"s_{c}")]
    if places:
        out += [(F.col("__run") + F.col("__seg")).alias("run"), (F.col("__i") + F.when(first, F.col("__k_")).otherwise(0)).alias("place")]
    return placed.join(entered, key).select(*[c for c in df.columns if c not in averages], *out)


def _decayed(c: str, keep: Column) -> Column:
    """What a part adds: each term times the powers of the steps after it; terms are scaled to the last step in the end."""
    m = F.col(f"__m_{c}")
    return F.sum(F.col(f"__add_{c}") * F.pow(keep, -m)) * F.pow(keep, F.max(m))


class Fold:
    """The same averages, one value after the other: the state (known values, average) can be kept and taken up again."""

    def __init__(self, average: Average, state: tuple[int, float] = (0, 0.0)) -> None:
        self.n, self.weight, self.hold = average.n, average.weight, average.hold
        self.known, self.value = state

    def __call__(self, x: float | None) -> float | None:
        if x is None or x != x:
            return self.value if self.hold and self.known >= self.n else None
        self.known += 1
        if self.known <= self.n:
            self.value += x / self.n
        else:
            self.value += self.weight * (x - self.value)
        return self.value if self.known >= self.n else None

    @property
    def state(self) -> tuple[int, float]:
        return self.known, self.value


def folded(average: Average, values: Iterable[float | None]) -> Iterator[float | None]:
    return map(Fold(average), values)
