"""Normalised rows of landed files. Readers take all columns as text, as `spark.read.csv(path, header=True)` gives them.

Each reader gives typed columns and `bad`: null, or why the row can't be used, so
that bad rows can be written apart and none is lost. Blanks are null, never zero.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Instrument types of the newer end-of-day file: kind (future or option) and underlying (stock or index). Fixed values.
INSTRUMENTS = {"STF": ("F", "S"), "STO": ("O", "S"), "IDF": ("F", "I"), "IDO": ("O", "I")}
LAKH = 100_000


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names and values trimmed; quoted fields may hold line ends."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*[c.strip() for c in df.columns])


def trimmed(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def number(c: str, kind: str = "double") -> Column:
    return trimmed(c).try_cast(kind)


def unreadable(c: str, kind: str = "double") -> Column:
    """Not blank, and no number."""
    return trimmed(c).isNotNull() & number(c, kind).isNull()


def whole(c: str) -> Column:
    """Whole numbers, also when written with decimals; blank counts as zero."""
    return F.coalesce(number(c), F.lit(0.0)).cast("long")


def first_fault(faults: Mapping[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in faults.items()], F.lit(None).cast("string"))


def minute_bars(raw: DataFrame) -> DataFrame:
    """start_time (with its offset), OHLC as decimals, volume (blank: unknown); end_time is a minute later, session_date partitions it."""
    prices = ("open", "high", "low", "close")
    start = trimmed("start_time").try_cast("timestamp")
    kind = "decimal(18,4)"
    faults = {"time": start.isNull(), "price": F.greatest(*[number(c, kind).isNull().cast("int") for c in prices]) == 1, "volume": unreadable("volume", "long")}
    other = [c for c in raw.columns if c not in (*prices, "start_time", "volume")]
    return raw.select(
        *other, start.alias("start_time"), (start + F.expr("interval 1 minute")).alias("end_time"), start.cast("date").alias("session_date"),
        *[number(c, kind).alias(c) for c in prices], number("volume", "long").alias("volume"), first_fault(faults).alias("bad"),
    )


def daily_bars(raw: DataFrame) -> DataFrame:
    """Session from the first ten characters of the stamp, OHLC and volume (blank: unknown)."""
    prices = ("open", "high", "low", "close")
    session = F.substring(trimmed("stamp"), 1, 10).try_cast("date")
    faults = {"session": session.isNull(), "price": F.greatest(*[number(c).isNull().cast("int") for c in prices]) == 1, "volume": unreadable("volume")}
    other = [c for c in raw.columns if c not in (*prices, "stamp", "volume")]
    return raw.select(*other, session.alias("session"), *[number(c).alias(c) for c in (*prices, "volume")], first_fault(faults).alias("bad"))


#: Column names of both kinds of file. Fixed values.
_NEW = {"open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "settle": "SttlmPric", "value": "TtlTrfVal", "last": "LastPric", "prev_close": "PrvsClsgPric", "underlying_price": "UndrlygPric"}
_NEW_WHOLE = {"contracts": "TtlTradgVol", "oi": "OpnIntrst", "chg_oi": "ChngInOpnIntrst", "lot": "NewBrdLotQty"}
_OLD = {"open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "settle": "SETTLE_PR"}
_OLD_WHOLE = {"contracts": "CONTRACTS", "oi": "OPEN_INT", "chg_oi": "CHG_IN_OI"}


def _derivatives(raw: DataFrame, day: str, date: str, symbol: str, kind: Column, underlying: Column, option: Column, expiry: str, strike: str, floats: dict, wholes: dict, faults: dict) -> DataFrame:
    session = trimmed(date).try_cast("date")
    unread = [unreadable(c).cast("int") for c in (*floats.values(), *wholes.values())]
    broken = [(F.coalesce(number(c), F.lit(0.0)) % 1 != 0).cast("int") for c in wholes.values()]
    known = {"session": session.isNull() | (session != F.col(day)), **faults, "expiry": trimmed(expiry).try_cast("date").isNull(), "number": F.greatest(*unread) == 1, "whole": F.greatest(*broken) == 1}
    return raw.select(
        F.col(day).alias("session"), trimmed(symbol).alias("symbol"), kind.alias("kind"), underlying.alias("underlying"), option.alias("option"), trimmed(expiry).try_cast("date").alias("expiry"),
        F.when(kind == "O", number(strike)).alias("strike"), *[number(c).alias(n) for n, c in floats.items()], *[whole(c).alias(n) for n, c in wholes.items()], first_fault(known).alias("bad"),
    )


def derivatives_new(raw: DataFrame, day: str = "day") -> DataFrame:
    """The newer end-of-day file of futures and options; `day` (a date) is the session that the file is for."""
    code = trimmed("FinInstrmTp")
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in INSTRUMENTS.items() for x in (k, v[i])])[F.coalesce(code, F.lit(""))]
    option = F.coalesce(trimmed("OptnTp"), F.lit(""))
    faults = {"kind": pick(0).isNull(), "option": (pick(0) == "O") != option.isin("CE", "PE")}
    return _derivatives(raw, day, "TradDt", "TckrSymb", pick(0), pick(1), option, "XpryDt", "StrkPric", _NEW, _NEW_WHOLE, faults)


def derivatives_old(raw: DataFrame, day: str = "day") -> DataFrame:
    """The older file in the same schema: value in rupees instead of lakhs, columns that it lacks null, lot zero."""
    code, given = trimmed("INSTRUMENT"), F.coalesce(trimmed("OPTION_TYP"), F.lit(""))
    kind = F.when(code.startswith("FUT"), "F").when(code.startswith("OPT"), "O")
    option = F.when((kind == "F") & (given == "XX"), "").otherwise(given)
    faults = {"kind": kind.isNull(), "option": (kind == "O") != option.isin("CE", "PE")}
    out = _derivatives(raw, day, "TIMESTAMP", "SYMBOL", kind, F.when(code.endswith("STK"), "S").otherwise("I"), option, "EXPIRY_DT", "STRIKE_PR", _OLD | {"value": "VAL_INLAKH"}, _OLD_WHOLE, faults)
    none = {c: F.lit(None).cast("double") for c in ("last", "prev_close", "underlying_price")}
    return out.withColumns({"value": F.col("value") * LAKH, **none, "lot": F.lit(0).cast("long")})


def index_closes(raw: DataFrame) -> DataFrame:
    """The all-index file: close, P/E, P/B and yield by name; `-` or blank is unknown, rows without a name are left out."""
    fields = {"open": "Open Index Value", "close": "Closing Index Value", "pe": "P/E", "pb": "P/B", "div_yield": "Div Yield"}
    value = lambda c: F.when(F.coalesce(trimmed(c), F.lit("-")) != "-", number(c)) if c in raw.columns else F.lit(None).cast("double")
    return raw.where(trimmed("Index Name").isNotNull()).select(F.col("day"), trimmed("Index Name").alias("name"), *[value(c).alias(n) for n, c in fields.items()])


def file_checks(raw: DataFrame, file: str, session: str, key: list[str], least_rows: int) -> DataFrame:
    """For each file: its rows and sessions, and why it fails (not one session, too few rows, a key twice); null if it holds."""
    n, days, keys = F.count("*"), F.countDistinct(session), F.countDistinct(*key)
    g = raw.groupBy(file).agg(n.alias("n_rows"), days.alias("n_sessions"), F.min(session).alias("session"), keys.alias("n_keys"))
    return g.withColumn("fault", F.when(F.col("n_sessions") != 1, "sessions").when(F.col("n_rows") < least_rows, "rows").when(F.col("n_keys") < F.col("n_rows"), "keys"))
