"""Rows that depend on the last one chosen: successors by joins, chains by pointer jumping.

Each row has one successor, whatever was chosen before it; what is chosen are the
rows that the first of a group leads to. Jump tables of doubled length, each made
from the one before it by a join, mark them: as many joins as the logarithm of the
longest chain, none of which holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.streaming.ticks import shared


def kept(df: DataFrame) -> DataFrame:
    """df, written and read again, so that its lineage ends here."""
    spark, path = df.sparkSession, shared(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def followed(links: DataFrame, by: list[str], node: str, successor: str, starts: DataFrame) -> DataFrame:
    """(by, node, n): the nodes that each group's start (by, node) leads to by links (by, node, successor), and how many steps after it.

    A node has one link at most; a null or unknown successor ends a chain, and
    chains never come back (successors are greater in some order). Rounds go on
    while one adds a node.
    """
    jumps = kept(links.where(F.col(successor).isNotNull()).select(*by, node, F.col(successor).alias("__to")))
    reached = kept(starts.select(*by, node, F.lit(0).cast("long").alias("n")))
    span = 1
    while True:
        new = kept(reached.join(jumps, [*by, node]).select(*by, F.col("__to").alias(node), (F.col("n") + span).alias("n")))
        if new.isEmpty():
            return reached
        reached = kept(reached.unionByName(new))
        second = jumps.select(*by, F.col(node).alias("__to"), F.col("__to").alias("__then"))
        jumps = kept(jumps.join(second, [*by, "__to"]).select(*by, node, F.col("__then").alias("__to")))
        span *= 2


def next_at_or_after(asked: DataFrame, by: list[str], wanted: str, rows: DataFrame, at: str, width: float) -> DataFrame:
    """asked with `__to`: the least `at` of the rows of its group that is `wanted` or more; null if there is none.

    Both meet in buckets of `width`; where a bucket has no such row, the first of the
    next bucket that has one comes from a table with a row a bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    there = rows.select(*by, bucket(at).alias("__b"), F.col(at).alias("__v"), F.lit(1).alias("__kind"))
    kind = asked.select(F.struct(*asked.columns).alias("r")).schema["r"].dataType
    both = asked.select(*by, bucket(wanted).alias("__b"), F.col(wanted).alias("__v"), F.lit(0).alias("__kind"), F.struct(*asked.columns).alias("__row")).unionByName(there.withColumn("__row", F.lit(None).cast(kind)))
    w = Window.partitionBy(*by, "__b").orderBy("__v", "__kind").rowsBetween(0, Window.unboundedFollowing)
    own = both.withColumn("__to", F.first(F.when(F.col("__kind") == 1, F.col("__v")), ignorenulls=True).over(w)).where("__kind = 0")
    firsts = both.groupBy(*by, "__b").agg(F.min(F.when(F.col("__kind") == 1, F.col("__v"))).alias("__first"))
    after = Window.partitionBy(*by).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    carried = firsts.select(*by, "__b", F.first("__first", ignorenulls=True).over(after).alias("__carried"))
    return own.join(carried, [*by, "__b"]).select("__row.*", F.coalesce("__to", "__carried").alias("__to"))


def numbered(rows: DataFrame, by: list[str], at: str, width: float, name: str) -> DataFrame:
    """rows with their place from 0 in the order of `at`, which is unique in its group: places within buckets of `width`, and the counts of the buckets before."""
    rows = kept(rows.withColumn("__b", F.floor(F.col(at) / width)))  # read twice here, often by those who number them
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))
    own = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(at)) - 1
    return rows.withColumn(name, own).join(before, [*by, "__b"]).withColumn(name, F.col(name) + F.col("__n")).drop("__b", "__n")


def first_outside(rows: DataFrame, by: list[str], at: str, low: str, high: str, floor: str, ceiling: str, strict: bool = False, fan: int = 8) -> DataFrame:
    """rows with `__to`: the least later `at` of the group where `low` <= the row's `floor` or `high` >= its `ceiling` (< and > if strict); null if there is none.

    rows: `at` counts a group's rows from 0 without holes; floor and ceiling may be
    null (never reached). A pyramid of least lows and greatest highs, of blocks of
    fan ** k rows, is climbed until a block holds such a row, then descended: a
    join of the open rows with a level at each step, so that a search costs
    fan * log n rows, wherever it ends.
    """
    rows = kept(rows)  # read by the search, the pyramid and the result
    base = kept(rows.select(*by, F.col(at).cast("long").alias("__i"), F.col(low).cast("double").alias("__low"), F.col(high).cast("double").alias("__high")))
    most = base.agg(F.max("__i")).first()[0]
    levels = 0
    while most is not None and fan ** (levels + 1) <= most:
        levels += 1
    pyramid = [base]
    for _ in range(levels):
        up = pyramid[-1].groupBy(*by, F.floor(F.col("__i") / fan).alias("__i")).agg(F.min("__low").alias("__low"), F.max("__high").alias("__high"))
        pyramid.append(kept(up))
    # Blocks of each level lie under one parent, in whose range a search looks on.
    shelf = [p.withColumn("__p", F.floor(F.col("__i") / fan)) for p in pyramid]
    hit = (F.col("__low") < F.col("__floor")) | (F.col("__high") > F.col("__ceil")) if strict else (F.col("__low") <= F.col("__floor")) | (F.col("__high") >= F.col("__ceil"))
    search = ["__of", "__floor", "__ceil"]

    def looked(open_: DataFrame, level: int, first: bool) -> DataFrame:
        """open_ (by, search, __i: a block of this level) with __hit: the first block after it (or from it on, as a parent's first) under the same parent that holds a row outside."""
        asked = open_.withColumn("__p", F.floor(F.col("__i") / fan)).withColumnRenamed("__i", "__from")
        later = F.col("__i") >= F.col("__from") if first else F.col("__i") > F.col("__from")
        found = asked.join(shelf[level], [*by, "__p"]).where(later & F.coalesce(hit, F.lit(False))).groupBy(*by, "__of").agg(F.min("__i").alias("__hit"))
        return asked.join(found, [*by, "__of"], "left")

    open_ = rows.select(*by, F.col(at).cast("long").alias("__of"), F.col(floor).cast("double").alias("__floor"), F.col(ceiling).cast("double").alias("__ceil"), F.col(at).cast("long").alias("__i"))
    descending = None
    for level in range(levels + 1):
        seen = kept(looked(open_, level, False))
        down = seen.where("__hit is not null").select(*by, *search, F.col("__hit").alias("__i"), F.lit(level).alias("__level"))
        descending = down if descending is None else descending.unionByName(down)
        open_ = seen.where("__hit is null").select(*by, *search, F.col("__p").alias("__i"))
    descending = kept(descending)
    for level in range(levels, 0, -1):
        inside = descending.where(F.col("__level") == level).withColumn("__i", F.col("__i") * fan)
        seen = looked(inside, level - 1, True).select(*by, *search, F.col("__hit").alias("__i"), F.lit(level - 1).alias("__level"))
        descending = kept(descending.where(F.col("__level") < level).unionByName(seen))
    return rows.join(descending.select(*by, F.col("__of").alias(at), F.col("__i").alias("__to")), [*by, at], "left")
