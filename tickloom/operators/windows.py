"""Causal windows over bars. `by` are the grouping columns, `order` the ordering ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import safe_divide
from tickloom.operators.chains import kept as at_rest

RUNNING = (Window.unboundedPreceding, 0)


def over(by: list[str], order: list[str], first: int = Window.unboundedPreceding, last: int = 0) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(first, last)


def full(value: Column, window: Window, column: Column, n: int) -> Column:
    """value, but null until the window holds n known values."""
    return F.when(F.count(column).over(window) == n, value)


def rolling(df: DataFrame, by: list[str], order: list[str], column: str, n: int, prefix: str) -> DataFrame:
    """Simple mean and population deviation of the last n rows, the current one included."""
    w, c = over(by, order, 1 - n, 0), F.col(column)
    return df.withColumn(f"{prefix}_mean", full(F.avg(c).over(w), w, c, n)).withColumn(f"{prefix}_dev", full(F.stddev_pop(c).over(w), w, c, n))


def segments(df: DataFrame, by: list[str], step: str) -> DataFrame:
    """`segment`: how many gaps in `step` lie before the row; `gap`: the row follows one."""
    w = Window.partitionBy(*by).orderBy(step)
    df = df.withColumn("gap", F.coalesce((F.col(step) != F.lag(step).over(w) + 1).cast("int"), F.lit(0)))
    return df.withColumn("segment", F.sum("gap").over(w.rowsBetween(*RUNNING)))


def prefix_sums(df: DataFrame, order: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """df with the sum of `value` over all rows of lower `order`, which must differ from row to row, without one task that sorts all.

    Rows fall into parts between approximate quantiles; each part is summed within
    itself, and the few totals of the parts before it are added.
    """
    # Kept: approximate quantiles can come out otherwise when they are taken again, and both readers need the same parts.
    cuts = at_rest(df.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("__cuts")))
    d = df.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda c: c <= F.col(order)))).drop("__cuts")  # one row of cuts
    d = d.withColumn("__part", F.coalesce("__part", F.lit(0)))
    totals = d.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = totals.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a part
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before")).drop("__part", "__before")


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact quantiles (interpolated), named by shares' keys: from counts of values, whose places are prefix sums; no task holds all values. Nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__m"))
    placed = prefix_sums(counts, "__v", "__m", "__first")
    total = F.col("__n")
    placed = placed.crossJoin(F.broadcast(counts.agg(F.sum("__m").alias("__n"))))  # one row

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__first") <= place) & (place < F.col("__first") + F.col("__m")), F.col("__v")))

    out = []
    for name, q in shares.items():
        place = (total - 1) * q
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * (F.max(place) - F.floor(F.max(place)))).alias(name))
    return placed.agg(*out)


#: Copies of a group's bounds that its values are spread over.
SALTS = 16


def grouped_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], parts: int = 64) -> DataFrame:
    """by and the exact quantiles (interpolated) of each group: name to (column, share). Nulls don't count; a group without values has null.

    Counts of values fall into parts between approximate quantiles of their group;
    from the sizes of parts follows which of them hold the places asked for, and
    only their values are ordered, part by part. Values of a large group are spread
    over SALTS copies of its bounds, so that no task holds a group.
    """
    columns = sorted({c for c, _ in wanted.values()})
    shares = sorted({(columns.index(c), q) for c, q in wanted.values()})
    long = df.select(*by, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("__c", "__v"))
    key = [*by, "__c"]
    counts = long.where("__v is not null").groupBy(*key, "__v").agg(F.count("*").alias("__m"))
    # Kept: sizes and values of parts are read apart, and approximate quantiles can come out otherwise when they are taken again.
    bounds = at_rest(long.groupBy(*key).agg(F.percentile_approx("__v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("__cuts"), F.count("__v").alias("__n")))
    salted = bounds.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = _same_group(counts.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int")), salted, [*key, "__salt"])
    placed = placed.withColumn("__part", F.size(F.filter("__cuts", lambda c: c <= F.col("__v")))).drop("__cuts", "__salt")
    line = Window.partitionBy(*key).orderBy("__part")
    sizes = placed.groupBy(*key, "__part").agg(F.sum("__m").alias("__size"), F.first("__n").alias("__n")).withColumn("__first", F.sum("__size").over(line) - F.col("__size"))
    place = [(F.col("__n") - 1) * q for _, q in shares]
    inside = lambda p, first, size: (first <= F.ceil(p)) & (F.floor(p) < first + size)
    needed = F.lit(False)
    for (k, _), p in zip(shares, place, strict=True):
        needed = needed | ((F.col("__c") == k) & inside(p, F.col("__first"), F.col("__size")))
    kept = _same_group(placed.drop("__n"), sizes.where(needed).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*key, "__part"], salt=True)
    own = Window.partitionBy(*key, "__part").orderBy("__v")
    first = F.col("__first") + F.sum("__m").over(own) - F.col("__m")
    kept = kept.select(*by, "__c", "__v", "__m", "__n", first.alias("__at"))

    def at(k: int, p: Column) -> Column:
        return F.max(F.when((F.col("__c") == k) & (F.col("__at") <= p) & (p < F.col("__at") + F.col("__m")), F.col("__v")))

    out = []
    for name, (c, q) in wanted.items():
        k = columns.index(c)
        p = (F.col("__n") - 1) * q
        share = F.max(F.when(F.col("__c") == k, p - F.floor(p)))
        low, high = at(k, F.floor(p)), at(k, F.ceil(p))
        out.append((low + (high - low) * share).alias(name))
    found = kept.groupBy(*by).agg(*out)
    return _same_group(df.select(*by).distinct(), found, by, how="left").select(*by, *wanted)


def _same_group(a: DataFrame, b: DataFrame, key: list[str], salt: bool = False, how: str = "inner") -> DataFrame:
    """a joined with b on key, nulls being equal; salt: b has SALTS copies of each row, of which rows of a meet one."""
    if salt:
        a, key = a.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int")), [*key, "__salt"]
    named = b.select(*[F.col(c).alias(f"__of_{c}") for c in key], *[c for c in b.columns if c not in key])
    same = F.lit(True)
    for c in key:
        same = same & a[c].eqNullSafe(F.col(f"__of_{c}"))
    return a.join(named, same, how).drop(*[f"__of_{c}" for c in key], *(["__salt"] if salt else []))


def session_vwap(df: DataFrame, by: list[str], order: str, volume: str) -> DataFrame:
    """`vwap` and its deviation (`vwap_dev`, `vwap_sigma`); one unknown volume hides the rest of the session."""
    w = over(by, [order])
    price, v = (F.col("high") + F.col("low") + F.col("close")) / 3, F.col(volume).cast("double")
    known = F.max(v.isNull().cast("int")).over(w) == 0
    total = F.sum(v).over(w)
    mean = F.sum(price * v).over(w) / total
    square = F.sum(price * price * v).over(w) / total
    df = df.withColumn("vwap", F.when(known & (total > 0), mean))
    df = df.withColumn("vwap_dev", F.when(known & (total > 0), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))))
    return df.withColumn("vwap_sigma", safe_divide(F.col("close") - F.col("vwap"), F.col("vwap_dev")))


def session_context(df: DataFrame, by: list[str], order: str, opening: int, anchor: int = 0) -> DataFrame:
    """Open, high, low and volume of the session so far, where it was seen from its opening; the opening range once it is over."""
    w = over(by, [order])
    seen = F.min(order).over(w) <= anchor
    keep = lambda c: F.when(seen, c)
    early = lambda c: F.when(F.col(order) < opening, F.col(c))
    late = seen & (F.col(order) >= opening)
    return df.select(
        "*", keep(F.first("open").over(w)).alias("s_open"), keep(F.max("high").over(w)).alias("s_high"), keep(F.min("low").over(w)).alias("s_low"),
        F.when(seen & (F.max(F.col("volume").isNull().cast("int")).over(w) == 0), F.sum("volume").over(w)).alias("s_volume"),
        F.when(late, F.max(early("high")).over(w)).alias("or_high"), F.when(late, F.min(early("low")).over(w)).alias("or_low"),
    )


def average_rank(by: list[str], column: str) -> Column:
    """Rank from 1, equal values sharing the mean of their places."""
    w = Window.partitionBy(*by).orderBy(column)
    return F.rank().over(w) + (F.count(column).over(Window.partitionBy(*by, column)) - 1) / 2
