"""Market-shaped inputs as views over the given tables; the same SQL runs on Spark and on DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "lineitem", "supplier", "orders", "customer")

VIEWS = {
    "x1": "select event_type as symbol, ts, event_id as seq, value as price, user_id from {events}",
    "x2": """select event_type as symbol, date_trunc('hour', ts) as bar_start, min_by(value, ts) as open, max(value) as high,
       min(value) as low, max_by(value, ts) as close, count(*) as n_ticks,
       case when count(*) % 7 = 0 then null else sum(user_id) end as volume
       from {events} group by event_type, date_trunc('hour', ts)""",
    "x3": """select symbol, session, min_by(price, rn) as open, max(price) as high, min(price) as low, max_by(price, rn) as close,
       sum(qty) as volume, count(*) as n from (
         select s_nationkey as symbol, date_trunc('month', l_shipdate) as session, l_extendedprice / l_quantity as price, l_quantity as qty,
                row_number() over (partition by s_nationkey, date_trunc('month', l_shipdate)
                  order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn
         from {lineitem} join {supplier} on l_suppkey = s_suppkey) group by symbol, session""",
    "x4": """select s_nationkey as symbol, date_trunc('year', l_shipdate) as session, l_linenumber % 3 as expiry_no,
       case when l_returnflag = 'A' then 'F' else 'O' end as kind,
       case when l_returnflag = 'A' then '' when l_linestatus = 'O' then 'CE' else 'PE' end as opt,
       case when l_returnflag = 'A' then null else cast(floor(l_extendedprice / 5000) * 5000 as double) end as strike,
       sum(l_quantity) as oi, count(*) as contracts, avg(l_extendedprice) as settle, avg(l_discount * l_extendedprice) as close
       from {lineitem} join {supplier} on l_suppkey = s_suppkey group by 1, 2, 3, 4, 5, 6""",
    "x6": "select user_id as symbol, event_type as subject, ts as disseminated_at, props as raw, event_id as filing_id from {events}",
    "x7": """select event_id, cast(ts as date) as session, user_id as symbol, value / (value + 50) as p,
       case when event_type = 'error' then 1 else 0 end as y from {events}""",
    "x8": """select o_orderkey as trade_id, o_custkey % 50 as symbol, o_orderdate as session, o_totalprice as entry_value,
       o_totalprice * ((o_orderkey % 41) - 20) / 1000 as gross, o_orderpriority as rule,
       case when o_orderstatus = 'F' then 'SHORT' else 'LONG' end as side from {orders}""",
    "x9": "select c_custkey as symbol, c_mktsegment as series, c_nationkey as industry_id, c_acctbal as market_cap from {customer}",
}
#: Hour bars with their session and place in it; and the second feed, some bars missing, some closes a hundredth higher.
VIEWS["bars"] = f"""select symbol, bar_start, cast(bar_start as date) as session, cast(extract(hour from bar_start) as int) as hr,
       open, high, low, close, n_ticks, volume from ({VIEWS["x2"]})"""
VIEWS["feed"] = f"""select symbol, bar_start, session, hr, open, high, low, case when n_ticks % 5 = 0 then close + 0.01 else close end as close,
       n_ticks, volume from ({VIEWS["bars"]}) where n_ticks % 13 <> 0"""
VIEWS["daily"] = f"""select *, row_number() over (partition by symbol order by session) as i,
       cast(extract(year from session) as int) * 12 + cast(extract(month from session) as int) as idx from ({VIEWS["x3"]})"""

_W = "(partition by symbol order by idx rows between {} preceding and current row)"
#: Snapshots that rules read: moving means stand for the recursive averages here, the rules only read them by name. Some values are unknown.
VIEWS["snaps"] = f"""select *, (ema9 - ema21) / 4 as macd_histogram, (ema9 - ema21) / 4 - c_3 / 50 as macd_histogram_change, 100 * (close - low4) / nullif(high4 - low4, 0) as rsi14, 60 * abs(close - c_3) / nullif(high4 - low4, 0) as adx14, case when n % 7 <> 0 then volume / mean_volume end as volume_ratio_20,
       (close - (mean20 - 2 * dev20)) / nullif(4 * dev20, 0) as bollinger_percent_b_20, case when n % 5 <> 0 then 3 * (close - mean20) / nullif(dev20, 0) end as price_vs_vwap_sigma, atr14 / close as atr_pct, case when n % 11 <> 0 then cast(n * 37 % 375 as double) end as minutes,
       ema9 / nullif(c_3, 0) - 1 as ema9_slope_5, ema21 / nullif(c_3, 0) - 1 as ema21_slope_5, close / c_1 - 1 as return_1, close / c_2 - 1 as return_5, close / c_3 - 1 as return_15, 20.0 + n % 30 as plus_di14, 25.0 as minus_di14, case when n % 4 <> 0 then close / open - 1 end as from_open, case when n % 6 <> 0 then (close - low) / nullif(high - low, 0) end as in_range
       from (select symbol, idx, n, open, high, low, close, volume, lag(close, 1) over (partition by symbol order by idx) as c_1, lag(close, 2) over (partition by symbol order by idx) as c_2, lag(close, 3) over (partition by symbol order by idx) as c_3,
         avg(close) over {_W.format(1)} as ema9, avg(close) over {_W.format(3)} as ema21, avg(close) over {_W.format(7)} as ema50, avg(high - low) over {_W.format(4)} as atr14, max(high) over {_W.format(3)} as high4, min(low) over {_W.format(3)} as low4,
         max(high) over {_W.format(5)} as rolling_high_20, min(low) over {_W.format(5)} as rolling_low_20, avg(volume) over {_W.format(5)} as mean_volume, avg(close) over {_W.format(5)} as mean20, stddev_pop(close) over {_W.format(5)} as dev20,
         case when n % 3 <> 0 then open * 1.1 end as opening_range_high, case when n % 3 <> 0 then open * 0.9 end as opening_range_low from ({VIEWS["daily"]}))"""
#: Contracts with days to expiry, a change of open interest and a quoted volatility; futures have neither side nor strike.
VIEWS["contracts"] = f"""select symbol, session, cast(extract(year from session) as int) as yr, expiry_no, 20 + 30 * expiry_no as dte, kind, opt, strike, oi, cast(contracts as double) as contracts, settle, close,
       cast(contracts % 7 - 3 as double) as chg_oi, cast(0.1 + 0.02 * (contracts % 9) + 0.01 * expiry_no as double) as vol from ({VIEWS["x4"]})"""
#: Files as text, some rows faulty: minutes, days, both derivative formats, index closes.
VIEWS["raw_minutes"] = """select event_id as id, case when event_id % 97 = 0 then 'never' else cast(ts as string) end as start_time, cast(cast(value as decimal(18,4)) as string) as open, cast(cast(value + 2 as decimal(18,4)) as string) as high,
       cast(cast(value - 1 as decimal(18,4)) as string) as low, case when event_id % 89 = 0 then 'x' else cast(cast(value + 1 as decimal(18,4)) as string) end as close, case when event_id % 7 = 0 then ' ' when event_id % 83 = 0 then 'many' else cast(user_id as string) end as volume from {events}"""
VIEWS["raw_daily"] = f"""select symbol, case when n % 37 = 0 then 'x' else concat(cast(cast(session as date) as string), 'T00:00:00') end as stamp, cast(open as string) as open, cast(case when n % 23 = 0 then low - 1 else high end as string) as high, cast(low as string) as low,
       case when n % 31 = 0 then '-' else cast(close as string) end as close, case when n % 7 = 0 then '' else cast(volume as string) end as volume, n from ({VIEWS["x3"]})"""
VIEWS["raw_new"] = """select concat('fo-', cast(o_orderdate as string)) as file, cast(o_orderdate as date) as day, cast(cast(case when o_orderkey % 53 = 0 then o_orderdate + interval '1' day else o_orderdate end as date) as string) as TradDt,
       case o_orderkey % 9 when 0 then 'STF' when 1 then 'STO' when 2 then 'IDF' when 3 then 'IDO' when 4 then 'ZZZ' when 5 then ' STO' when 6 then 'STF ' when 7 then 'STO' else 'IDO' end as FinInstrmTp,
       concat('S', cast(o_custkey % 11 as string)) as TckrSymb, case when o_orderkey % 9 in (0, 2, 6) then '' when o_orderkey % 2 = 0 then 'CE' when o_orderkey % 61 = 0 then 'XX' else 'PE ' end as OptnTp, '1999-12-30' as XpryDt, cast(o_custkey % 100 * 5 as string) as StrkPric,
       '1' as OpnPric, '2' as HghPric, '0.5' as LwPric, case when o_orderkey % 59 = 0 then 'n/a' when o_orderkey % 13 = 0 then ' ' else cast(o_totalprice as string) end as ClsPric, '1.25' as SttlmPric, cast(o_totalprice as string) as TtlTrfVal, '' as LastPric, '' as PrvsClsgPric, '' as UndrlygPric,
       '3' as TtlTradgVol, case when o_orderkey % 67 = 0 then '1.5' when o_orderkey % 5 = 0 then '' else cast(o_custkey as string) end as OpnIntrst, '0' as ChngInOpnIntrst, '25.0' as NewBrdLotQty from {orders}"""
VIEWS["raw_old"] = """select cast(o_orderdate as date) as day, cast(cast(case when o_orderkey % 53 = 0 then o_orderdate + interval '1' day else o_orderdate end as date) as string) as TIMESTAMP,
       case o_orderkey % 5 when 0 then 'FUTSTK' when 1 then 'OPTSTK' when 2 then 'FUTIDX' when 3 then 'OPTIDX' else 'BOND' end as INSTRUMENT, concat('S', cast(o_custkey % 11 as string)) as SYMBOL, '1999-12-30' as EXPIRY_DT, '100' as STRIKE_PR,
       case when o_orderkey % 5 in (0, 2) then 'XX' when o_orderkey % 41 = 0 then '?' else 'CE' end as OPTION_TYP, '1' as OPEN, '2' as HIGH, '0.5' as LOW, '1' as CLOSE, '1' as SETTLE_PR, '3' as CONTRACTS, cast(o_custkey as string) as VAL_INLAKH, '7' as OPEN_INT, '0' as CHG_IN_OI from {orders}"""
VIEWS["raw_indices"] = """select day, `Index Name`, `Closing Index Value`, `P/E` from (select cast(o_orderdate as date) as day, case when o_orderkey % 17 = 0 then ' ' else concat(' index ', cast(o_orderkey % 4 as string)) end as `Index Name`,
       cast(o_totalprice as string) as `Closing Index Value`, case when o_orderkey % 3 = 0 then '-' when o_orderkey % 7 = 0 then '' else cast(o_custkey as string) end as `P/E` from {orders})"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """Puts the views that a DuckDB statement names in front of it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    parts = ", ".join(f"{n} as ({VIEWS[n].replace('`', chr(34)).format(**{t: t for t in TABLES})})" for n in names)
    sql = sql.strip()
    for start in ("with recursive ", "with "):
        if sql.lower().startswith(start):
            return f"{start}{parts}, {sql[len(start):]}"
    return f"with {parts} {sql}"
