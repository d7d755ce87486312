"""A store of bars in files by session: range loads read the sessions they need, upserts rewrite the sessions they touch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATE = "session_date"
#: Files of a session that an upsert writes.
FILES = 1


class BarStore:
    """Rows of `schema` (with symbol and bar_start, `load` being the number of their load) under a path that all executors share, in a folder a session."""

    def __init__(self, spark: SparkSession, path: str, schema: str, files: int = FILES) -> None:
        self.spark, self.path, self.schema, self.files = spark, path, f"{schema}, {DATE} date", files

    def create(self) -> BarStore:
        """An empty store, unless there is one."""
        self.spark.createDataFrame([], self.schema).write.mode("append").partitionBy(DATE).parquet(self.path)
        return self

    def bars(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def load(self, start: dt.datetime, end: dt.datetime, width: dt.timedelta) -> DataFrame:
        """Bars that lie in [start, end] as a whole; other sessions' files are not read."""
        whole = (F.col("bar_start") >= F.lit(start)) & (F.col("bar_start") <= F.lit(end - width))
        return self.bars().where(F.col(DATE).between(F.lit(start.date()), F.lit((end - width).date())) & whole)

    def upsert(self, rows: DataFrame) -> list[dt.date]:
        """Puts rows in, of equal (symbol, bar_start) those of the highest load, and gives the sessions that were written anew.

        Repeated rows of one load count once, whichever of them; a stored row gives
        way to one of its own load. Rows without a time are left out. The sessions
        touched (a list of days) go through the driver, rows don't; a session's old
        files stay until its new ones are complete.
        """
        rows = rows.where("bar_start is not null").withColumn(DATE, F.to_date("bar_start"))
        days = sorted(r[0] for r in rows.select(DATE).distinct().collect())
        if not days:
            return days
        columns = self.bars().columns
        old = self.bars().where(F.col(DATE).isin(days)).withColumn("__new", F.lit(0))
        both = old.unionByName(rows.select(*columns).withColumn("__new", F.lit(1)))
        best = Window.partitionBy("symbol", "bar_start", DATE).orderBy(F.desc("load"), F.desc("__new"))
        kept = both.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").select(*columns)
        spread = kept.repartition(DATE, F.pmod(F.xxhash64("symbol"), F.lit(self.files))).sortWithinPartitions(DATE, "symbol", "bar_start")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(self.path)
        return days
