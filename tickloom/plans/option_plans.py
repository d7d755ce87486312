"""Option chains: implied volatility, smiles, terms, call and put pairs, open interest of listed contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.options import RATE, implied_volatility
from tickloom.functions.scalars import safe_divide
from tickloom.plans.chain_plans import KEY, UNDERLYING, keyed
from tickloom.plans.feature_plans import r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view

#: Points this near to the forward give the level at the money; skew between two shares of the forward; days that terms are brought to.
ATM_BAND, SKEW, TARGET_DAYS = 0.10, (0.95, 1.05), 30


def with_forward(chain: DataFrame) -> DataFrame:
    """Traded options with the settlement of the future of their expiry as `forward`."""
    futures = chain.where("kind = 'F' and settle > 0").groupBy(*UNDERLYING, "expiry_no").agg(F.max("settle").alias("forward"))
    return chain.where("kind = 'O' and contracts > 0 and close > 0").join(futures, [*UNDERLYING, "expiry_no"])


@query()
def l5_implied_volatility(spark, sf):
    """The implied volatility of each option of all chains, in Arrow batches; bounds are checked in the same pass."""
    o = with_forward(view(spark, sf, "contracts"))
    v = implied_volatility(F.col("close"), F.col("forward"), F.col("strike"), F.col("dte") / 365, F.col("opt") == "CE")
    return keyed(o, "expiry_no", "opt", "strike", "close", "forward", "dte", v.alias("implied_vol"))


def smile(options: DataFrame, by: list[str]) -> DataFrame:
    """(by, strike, vol) of out-of-the-money options: puts below the forward, calls above, the mean of both at it."""
    call, k, f = F.col("opt") == "CE", F.col("strike"), F.col("forward")
    out = options.where(F.col("vol").isNotNull() & (((k < f) & ~call) | ((k > f) & call) | (k == f)))
    return out.groupBy(*by, "forward", "strike").agg(F.avg("vol").alias("vol"))


def interpolated(points: DataFrame, by: list[str], x: str, y: str, at: F.Column, name: str, where: F.Column | None = None) -> DataFrame:
    """y at a point, straight between the nearest known x on both sides; null where one side has none."""
    p = points.where(where) if where is not None else points
    pair = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    g = p.withColumn("__at", at).groupBy(*by, "__at").agg(F.max(F.when(F.col(x) <= F.col("__at"), pair)).alias("__a"), F.min(F.when(F.col(x) >= F.col("__at"), pair)).alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    between = a["y"] + (b["y"] - a["y"]) * (F.col("__at") - a["x"]) / (b["x"] - a["x"])
    return g.select(*by, F.when(a["x"] == b["x"], a["y"]).when(a.isNotNull() & b.isNotNull(), between).alias(name))


_FWD = """fwd as (select symbol, session, expiry_no, max(settle) as forward from contracts where kind = 'F' and settle > 0 group by all),
 op as (select c.*, forward from contracts c join fwd using (symbol, session, expiry_no) where kind = 'O' and contracts > 0 and close > 0),
 sm as (select symbol, session, expiry_no, dte, forward, strike, avg(vol) as vol from op where (strike < forward and opt = 'PE') or (strike > forward and opt = 'CE') or strike = forward group by all)"""
_BY = [*UNDERLYING, "expiry_no", "dte"]


def _lerp(name: str, at: str, where: str = "true") -> str:
    return f"""{name} as (select symbol, session, expiry_no, dte, case when x1 = x2 then y1 else y1 + (y2 - y1) * (pt - x1) / (x2 - x1) end as {name} from (
   select symbol, session, expiry_no, dte, any_value({at}) as pt, max(strike) filter (where strike <= {at}) as x1, max_by(vol, strike) filter (where strike <= {at}) as y1,
    min(strike) filter (where strike >= {at}) as x2, min_by(vol, strike) filter (where strike >= {at}) as y2 from sm where {where} group by symbol, session, expiry_no, dte) q)"""


_NEAR = f"abs(strike / forward - 1) <= {ATM_BAND}"


@query(duck(f"with {_FWD} select {KEY}, expiry_no, strike, round(vol, 6) as vol from sm"))
def d9_smile_points(spark, sf):
    return keyed(smile(with_forward(view(spark, sf, "contracts")), _BY), "expiry_no", "strike", r6(F.col("vol")).alias("vol"))


@query(duck(f"""with {_FWD}, {_lerp("level", "forward", _NEAR)}, {_lerp("low", f"{SKEW[0]} * forward")}, {_lerp("high", f"{SKEW[1]} * forward")}
 select {KEY}, expiry_no, round(level, 6) as atm, round(low - high, 6) as skew from low join high using (symbol, session, expiry_no, dte) left join level using (symbol, session, expiry_no, dte)"""))
def d10_atm_and_skew(spark, sf):
    """The level at the money from near points, and the skew between two strikes, each interpolated."""
    points = smile(with_forward(view(spark, sf, "contracts")), _BY)
    near = F.abs(F.col("strike") / F.col("forward") - 1) <= ATM_BAND
    low, high = (interpolated(points, _BY, "strike", "vol", F.lit(s) * F.col("forward"), n) for s, n in zip(SKEW, ("low", "high"), strict=True))
    level = interpolated(points, _BY, "strike", "vol", F.col("forward"), "atm", near)
    return keyed(low.join(high, _BY).join(level, _BY, "left"), "expiry_no", r6(F.col("atm")).alias("atm"), r6(F.col("low") - F.col("high")).alias("skew"))


@query(duck(f"""with {_FWD}, {_lerp("level", "forward", _NEAR)}, l as (select *, level * level * dte as w from level where level is not null),
 b as (select symbol, session, max(dte) filter (where dte <= {TARGET_DAYS}) as t1, max_by(w, dte) filter (where dte <= {TARGET_DAYS}) as w1, min(dte) filter (where dte >= {TARGET_DAYS}) as t2, min_by(w, dte) filter (where dte >= {TARGET_DAYS}) as w2 from l group by 1, 2)
 select {KEY}, round(sqrt(case when t1 = t2 then w1 else w1 + (w2 - w1) * ({TARGET_DAYS} - t1) / (t2 - t1) end / {TARGET_DAYS}), 6) as vol_30d from b where case when t1 = t2 then w1 else w1 + (w2 - w1) * ({TARGET_DAYS} - t1) / (t2 - t1) end > 0"""))
def d11_thirty_day_vol(spark, sf):
    """Linear in total variance between the nearest expiries on both sides."""
    points = smile(with_forward(view(spark, sf, "contracts")), _BY)
    near = F.abs(F.col("strike") / F.col("forward") - 1) <= ATM_BAND
    level = interpolated(points, _BY, "strike", "vol", F.col("forward"), "atm", near).where("atm is not null").withColumn("w", F.col("atm") ** 2 * F.col("dte"))
    total = interpolated(level, UNDERLYING, "dte", "w", F.lit(TARGET_DAYS), "w").where("w > 0")
    return keyed(total, r6(F.sqrt(F.col("w") / TARGET_DAYS)).alias("vol_30d"))


def pairs(options: DataFrame, by: list[str]) -> DataFrame:
    """Calls and puts of a strike side by side: call, call_oi, call_vol and so on; strikes with both only."""
    one = lambda o, c: F.max(F.when(F.col("opt") == o, F.col(c)))
    columns = [one(o, c).alias(f"{side}{suffix}") for o, side in (("CE", "call"), ("PE", "put")) for c, suffix in (("close", ""), ("oi", "_oi"), ("vol", "_vol"))]
    return options.groupBy(*by, "strike").agg(*columns).where("call is not null and put is not null")


_PAIRS = """pr as (select symbol, session, expiry_no, dte, forward, strike, max(close) filter (where opt = 'CE') as call, max(close) filter (where opt = 'PE') as put, max(oi) filter (where opt = 'CE') as call_oi, max(oi) filter (where opt = 'PE') as put_oi,
   max(vol) filter (where opt = 'CE') as call_vol, max(vol) filter (where opt = 'PE') as put_vol from op group by all having call is not null and put is not null)"""


@query(duck(f"with {_FWD}, {_PAIRS} select {KEY}, expiry_no, count(*) as pairs, round(sum(call - put), 6) as gap, sum(call_oi + put_oi) as oi from pr group by symbol, session, expiry_no"))
def c14_call_put_pairs(spark, sf):
    p = pairs(with_forward(view(spark, sf, "contracts")), [*_BY, "forward"])
    return keyed(p.groupBy(*UNDERLYING, "expiry_no").agg(F.count("*").alias("pairs"), r6(F.sum(F.col("call") - F.col("put"))).alias("gap"), F.sum(F.col("call_oi") + F.col("put_oi")).alias("oi")), "expiry_no", "pairs", "gap", "oi")


@query(duck(f"""with {_FWD}, {_PAIRS}, best as (select symbol, session, min(expiry_no) as expiry_no from op where dte >= 3 group by 1, 2),
 w as (select *, call_oi + put_oi + 1 as weight, (call - put - exp(-{RATE} * dte / 365.0) * (forward - strike)) / forward * 10000 as gap from pr join best using (symbol, session, expiry_no) where abs(strike / forward - 1) <= 0.3)
 select {KEY}, round(sum(weight * (call_vol - put_vol)) / sum(weight), 6) as vol_spread, round(sum(weight * gap) / sum(weight), 4) as parity_bp, count(*) as pairs from w group by symbol, session"""))
def d12_call_put_spread(spark, sf):
    """Of the nearest expiry three days away at least, strikes near the forward: call less put volatility and the parity gap, weighted by open interest."""
    o = with_forward(view(spark, sf, "contracts"))
    best = o.where("dte >= 3").groupBy(*UNDERLYING).agg(F.min("expiry_no").alias("expiry_no"))
    p = pairs(o, [*_BY, "forward"]).join(best, [*UNDERLYING, "expiry_no"]).where(F.abs(F.col("strike") / F.col("forward") - 1) <= 0.3)
    weight, f = F.col("call_oi") + F.col("put_oi") + 1, F.col("forward")
    gap = (F.col("call") - F.col("put") - F.exp(-RATE * F.col("dte") / 365) * (f - F.col("strike"))) / f * 10_000
    g = p.groupBy(*UNDERLYING).agg(r6(F.sum(weight * (F.col("call_vol") - F.col("put_vol"))) / F.sum(weight)).alias("vol_spread"), F.round(F.sum(weight * gap) / F.sum(weight), 4).alias("parity_bp"), F.count("*").alias("pairs"))
    return keyed(g, "vol_spread", "parity_bp", "pairs")


@query(duck(f"""with k as (select symbol, session, strike, sum(oi) filter (where opt = 'CE') as ce, sum(oi) filter (where opt = 'PE') as pe from contracts where kind = 'O' and expiry_no = 1 group by 1, 2, 3)
 select cast(a.symbol as bigint) as symbol, cast(cast(a.session as timestamp) as varchar) as session, a.strike as settled, round(sum(greatest(a.strike - b.strike, 0) * coalesce(b.ce, 0)), 2) as call_pays, round(sum(greatest(b.strike - a.strike, 0) * coalesce(b.pe, 0)), 2) as put_pays
 from k a join k b on a.symbol = b.symbol and a.session = b.session group by 1, 2, 3"""))
def c16_payouts_by_settlement(spark, sf):
    """What calls and puts pay at each settlement: strikes of one chain against each other, bounded by its strikes."""
    one = lambda o: F.coalesce(F.sum(F.when(F.col("opt") == o, F.col("oi"))), F.lit(0.0))
    k = view(spark, sf, "contracts").where("kind = 'O' and expiry_no = 1").groupBy(*UNDERLYING, "strike").agg(one("CE").alias("ce"), one("PE").alias("pe"))
    j = k.select(*UNDERLYING, F.col("strike").alias("settled")).join(k, UNDERLYING)
    over = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0.0))
    g = j.groupBy(*UNDERLYING, "settled").agg(F.round(F.sum(over("settled", "strike") * F.col("ce")), 2).alias("call_pays"), F.round(F.sum(over("strike", "settled") * F.col("pe")), 2).alias("put_pays"))
    return keyed(g.withColumn("symbol", F.col("symbol").cast("long")), "settled", "call_pays", "put_pays")


def carried_total(bars: DataFrame, spine: DataFrame, by: str, contract: str, session: str, value: str) -> DataFrame:
    """(by, session, total): the sum over a symbol's contracts of the last known value; null until all are known."""
    listed = bars.select(by, contract).distinct()
    w = Window.partitionBy(by, contract).orderBy(session).rowsBetween(Window.unboundedPreceding, 0)
    held = spine.join(listed, by).join(bars.select(by, contract, session, value), [by, contract, session], "left").withColumn("__v", F.last(value, ignorenulls=True).over(w))
    return held.groupBy(by, session).agg(F.when(F.count("__v") == F.count("*"), F.sum("__v")).alias("total"))


@query(duck("""with f as (select symbol, yr, expiry_no, max(oi) as oi, max(settle) as settle from contracts where kind = 'F' group by 1, 2, 3), s as (select distinct symbol, yr from contracts), l as (select distinct symbol, expiry_no from f),
 h as (select s.symbol, s.yr, l.expiry_no, last_value(f.oi ignore nulls) over (partition by s.symbol, l.expiry_no order by s.yr rows unbounded preceding) as v from s join l using (symbol) left join f using (symbol, yr, expiry_no)),
 t as (select symbol, yr, case when count(v) = count(*) then sum(v) end as total from h group by 1, 2)
 select symbol, yr, total, round(total / lag(total) over w - 1, 6) as change_1, round(total / lag(total, 5) over w - 1, 6) as change_5 from t window w as (partition by symbol order by yr)"""))
def d13_total_open_interest(spark, sf):
    """Open interest of all listed futures; a contract without a trade keeps its last."""
    c = view(spark, sf, "contracts")
    f = c.where("kind = 'F'").groupBy("symbol", "yr", "expiry_no").agg(F.max("oi").alias("oi"))
    t = carried_total(f, c.select("symbol", "yr").distinct(), "symbol", "expiry_no", "yr", "oi")
    w = Window.partitionBy("symbol").orderBy("yr")
    change = lambda n: r6(F.col("total") / F.lag("total", n).over(w) - 1)
    return t.select("symbol", "yr", "total", change(1).alias("change_1"), change(5).alias("change_5"))


#: Moves of price and open interest below these say nothing.
PRICE_BAND, OI_BAND = 0.002, 0.01


def build_up(price: F.Column, oi: F.Column) -> F.Column:
    """What moves of price and open interest say together; null where either is unknown."""
    small = (F.abs(price) < PRICE_BAND) | (F.abs(oi) < OI_BAND)
    kind = F.when(small, "neutral").when(oi > 0, F.when(price > 0, "long_buildup").otherwise("short_buildup")).otherwise(F.when(price > 0, "short_covering").otherwise("long_unwinding"))
    return F.when(price.isNotNull() & oi.isNotNull(), kind)


def _build_up(price: str, oi: str) -> str:
    return f"case when {price} is null or {oi} is null then null when abs({price}) < {PRICE_BAND} or abs({oi}) < {OI_BAND} then 'neutral' when {oi} > 0 then (case when {price} > 0 then 'long_buildup' else 'short_buildup' end) else (case when {price} > 0 then 'short_covering' else 'long_unwinding' end) end"


@query(duck(f"""with p as (select symbol, expiry_no, yr + 1 as yr, oi as before, settle as settled from contracts where kind = 'F'), j as (select symbol, yr, expiry_no, oi, before, settle, settled, close from contracts join p using (symbol, expiry_no, yr) where kind = 'F'),
 g as (select symbol, yr, sum(oi) filter (where before > 0) / sum(before) filter (where before > 0) - 1 as change, max(settle / settled - 1) filter (where expiry_no = 0) as moved, max(settle / close - 1) filter (where expiry_no = 0) as premium from j group by 1, 2)
 select symbol, yr, round(change, 6) as oi_change, round(moved, 6) as price_change, round(premium, 6) as premium, {_build_up("moved", "change")} as build_up from g"""))
def d14_live_open_interest(spark, sf):
    """Open interest of the contracts with a known last close against it, the near month's move and premium."""
    f = view(spark, sf, "contracts").where("kind = 'F'")
    before = f.select("symbol", "expiry_no", (F.col("yr") + 1).alias("yr"), F.col("oi").alias("before"), F.col("settle").alias("settled"))
    known, near = F.col("before") > 0, F.col("expiry_no") == 0
    g = f.join(before, ["symbol", "expiry_no", "yr"]).groupBy("symbol", "yr").agg(
        (F.sum(F.when(known, F.col("oi"))) / F.sum(F.when(known, F.col("before"))) - 1).alias("change"), F.max(F.when(near, F.col("settle") / F.col("settled") - 1)).alias("moved"), F.max(F.when(near, F.col("settle") / F.col("close") - 1)).alias("premium"))
    return g.select("symbol", "yr", r6(F.col("change")).alias("oi_change"), r6(F.col("moved")).alias("price_change"), r6(F.col("premium")).alias("premium"), build_up(F.col("moved"), F.col("change")).alias("build_up"))


#: Participants of the futures file, four and their total.
_WHO = "case l_linenumber % 4 when 0 then 'client' when 1 then 'dii' when 2 then 'fii' else 'pro' end"
_POSITIONS = f"""w as (select date_trunc('month', l_shipdate) as session, {_WHO} as who, sum(l_quantity) filter (where l_returnflag = 'A') as fut_long, sum(l_quantity) filter (where l_returnflag = 'R') as fut_short,
   sum(l_quantity) filter (where l_linestatus = 'O') as call_long, sum(l_quantity) filter (where l_linestatus = 'F') as call_short from lineitem group by 1, 2)"""


def _positions(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = lambda c, v: F.sum(F.when(F.col(c) == v, F.col("l_quantity")))
    n = F.col("l_linenumber") % 4
    who = F.when(n == 0, "client").when(n == 1, "dii").when(n == 2, "fii").otherwise("pro")
    return li.groupBy(F.date_trunc("month", "l_shipdate").alias("session"), who.alias("who")).agg(
        part("l_returnflag", "A").alias("fut_long"), part("l_returnflag", "R").alias("fut_short"), part("l_linestatus", "O").alias("call_long"), part("l_linestatus", "F").alias("call_short"))


@query(f"""with {_POSITIONS}, t as (select date_trunc('month', l_shipdate) as session, sum(l_quantity) filter (where l_returnflag = 'A' and l_orderkey % 499 <> 0) as fut_long from lineitem group by 1),
 g as (select session, coalesce(sum(fut_long), 0) as parts, coalesce(sum(fut_long), 0) = coalesce(sum(fut_short), 0) as even_, count(*) as who from w group by session)
 select cast(cast(session as timestamp) as varchar) as session, parts, coalesce(fut_long, 0) as total, parts = coalesce(fut_long, 0) as same_total, even_, round(abs(parts - coalesce(fut_long, 0)) / greatest(abs(coalesce(fut_long, 0)), 1), 6) as off, who from g join t using (session)""")
def d24_participant_totals(spark, sf):
    """The four participants add up to the reported total, longs equal shorts."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = _positions(spark, sf).groupBy("session").agg(zero(F.sum("fut_long")).alias("parts"), (zero(F.sum("fut_long")) == zero(F.sum("fut_short"))).alias("even_"), F.count("*").alias("who"))
    reported = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.date_trunc("month", "l_shipdate").alias("session")).agg(zero(F.sum(F.when((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 499 != 0), F.col("l_quantity")))).alias("total"))
    j = parts.join(reported, "session")
    return j.select(F.col("session").cast("timestamp").cast("string").alias("session"), "parts", "total", (F.col("parts") == F.col("total")).alias("same_total"), "even_",
                    r6(F.abs(F.col("parts") - F.col("total")) / F.greatest(F.abs("total"), F.lit(1.0))).alias("off"), "who")


@query(f"""with {_POSITIONS}, b as (select date_trunc('month', l_shipdate) as session, count(distinct l_suppkey) as banned from lineitem where l_quantity = 50 group by 1)
 select cast(cast(session as timestamp) as varchar) as session, round(max(case when who = 'fii' and fut_long + fut_short > 0 then fut_long / (fut_long + fut_short) * 100 end), 4) as fii_long_pct, round(max(case when who = 'client' and fut_long + fut_short > 0 then fut_long / (fut_long + fut_short) * 100 end), 4) as client_long_pct,
 max(case when who = 'fii' then call_long - call_short end) as fii_call_net, cast(max(banned) as double) as in_ban from w left join b using (session) group by session""")
def d26_participant_positioning(spark, sf):
    """A session's shares of longs, net calls and stocks in ban; a missing ban file leaves its count unknown."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    ban = li.where("l_quantity = 50").groupBy(F.date_trunc("month", "l_shipdate").alias("session")).agg(F.countDistinct("l_suppkey").alias("banned"))
    at = lambda who, c: F.max(F.when(F.col("who") == who, c))
    share, net = safe_divide(F.col("fut_long"), F.col("fut_long") + F.col("fut_short")) * 100, F.col("call_long") - F.col("call_short")
    g = _positions(spark, sf).join(ban, "session", "left").groupBy("session").agg(F.round(at("fii", share), 4).alias("fii_long_pct"), F.round(at("client", share), 4).alias("client_long_pct"), at("fii", net).alias("fii_call_net"), F.max("banned").cast("double").alias("in_ban"))
    return g.withColumn("session", F.col("session").cast("timestamp").cast("string"))


@query(duck(f"""with d as (select symbol, idx, close, lag(close) over w as c1, lag(idx) over w as i1, cast(n as double) as oi, lag(cast(n as double)) over w as o1, lag(cast(n as double), 5) over w as o5, lag(idx, 5) over w as i5, volume from daily window w as (partition by symbol order by idx)),
 e as (select *, (idx // 3) = (i1 // 3) as same1, (idx // 3) = (i5 // 3) as same5, 30 * (2 - idx % 3) as dte from d), f as (select *, case when same1 then close / c1 - 1 end as price, case when same1 and o1 > 0 then oi / o1 - 1 end as oi1, case when same5 and o5 > 0 then oi / o5 - 1 end as oi5 from e)
 select symbol, idx, round(price, 6) as price_1d, round(oi1, 6) as oi_1d, round(oi5, 6) as oi_5d, {_build_up("price", "oi1")} as build_up, dte, case when dte >= 3 then round((close / 2000 - 1) * 100 * 365 / dte, 6) end as basis_ann, round(volume / oi, 6) as volume_to_oi from f"""))
def e34_daily_oi_features(spark, sf):
    """Changes within one contract only; the contract changes after every third month."""
    d = view(spark, sf, "daily").withColumn("oi", F.col("n").cast("double")).withColumn("contract", F.floor(F.col("idx") / 3)).withColumn("dte", 30 * (2 - F.col("idx") % 3))
    w = Window.partitionBy("symbol").orderBy("idx")
    back = lambda c, k: F.when((F.lag("contract", k).over(w) == F.col("contract")) & (F.lag(c, k).over(w) > 0), F.col(c) / F.lag(c, k).over(w) - 1)
    d = d.select("*", back("close", 1).alias("price"), back("oi", 1).alias("oi1"), back("oi", 5).alias("oi5"))
    return d.select("symbol", "idx", r6(F.col("price")).alias("price_1d"), r6(F.col("oi1")).alias("oi_1d"), r6(F.col("oi5")).alias("oi_5d"), build_up(F.col("price"), F.col("oi1")).alias("build_up"), "dte",
                    F.when(F.col("dte") >= 3, F.round((F.col("close") / 2000 - 1) * 100 * 365 / F.col("dte"), 6)).alias("basis_ann"), r6(F.col("volume") / F.col("oi")).alias("volume_to_oi"))


#: From this day, monthly contracts end on the last Tuesday instead of the last Thursday.
TUESDAY_FROM = "1996-01-01"
_EXPIRY = f"""c as (select distinct cast(o_orderdate as date) as d from orders where o_orderkey % 3 = 0), r as (select min(d) as first_, max(d) as last_ from c),
 m as (select distinct last_day(d) as l from c), t as (select l, cast(l - cast((isodow(l) - case when l >= date '{TUESDAY_FROM}' then 2 else 4 end + 7) % 7 as integer) as date) as due from m),
 e as (select due, case when due > last_ then due else (select max(d) from c where d <= due) end as expiry from t, r)"""


def monthly_expiries(calendar: DataFrame, day: str, tuesday_from: str = TUESDAY_FROM) -> DataFrame:
    """(due, expiry): the last Thursday (later Tuesday) of each month, moved back to a session; after the last known session, the calendar date."""
    last = F.last_day(day)
    target = F.when(F.col("l") >= F.lit(tuesday_from).cast("date"), 3).otherwise(5)  # dayofweek: Sunday is 1
    due = calendar.select(last.alias("l")).distinct().select(F.date_sub("l", F.pmod(F.dayofweek("l") - target, F.lit(7)).cast("int")).alias("due"))
    # The as-of join to the calendar is one union and one window over one row a session.
    both = due.select(F.col("due").alias("at"), F.lit(None).cast("date").alias("held"), F.lit(1).alias("side")).union(calendar.select(day, day, F.lit(0)).distinct())
    w = Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("expiry", F.last("held", ignorenulls=True).over(w)).withColumn("end", F.max("held").over(Window.partitionBy()))
    return filled.where("side = 1").select(F.col("at").alias("due"), F.when(F.col("at") > F.col("end"), F.col("at")).otherwise(F.col("expiry")).alias("expiry"))


def _calendar(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_orderdate").cast("date").alias("d")).distinct()


@query(f"with {_EXPIRY} select cast(due as varchar) as due, cast(expiry as varchar) as expiry from e")
def e35_monthly_expiries(spark, sf):
    e = monthly_expiries(_calendar(spark, sf), "d")
    return e.select(F.col("due").cast("string").alias("due"), F.col("expiry").cast("string").alias("expiry"))


@query(f"""with {_EXPIRY}, s as (select d, row_number() over (order by d) as i, max(d) over (partition by last_day(d)) as month_end from c), x as (select s.*, (select min(expiry) from e where expiry >= s.d) as expiry from s)
 select cast(x.d as varchar) as session, a.i - x.i as to_month_end, cast(b.i - x.i as double) as to_expiry from x join s a on a.d = x.month_end left join s b on b.d = x.expiry""")
def e36_sessions_to_expiry(spark, sf):
    """Sessions left in the month and to the next expiry, by places in the calendar (one row a session)."""
    s = _calendar(spark, sf).withColumn("i", F.row_number().over(Window.orderBy("d")))
    e = monthly_expiries(s.select("d"), "d").select("expiry").distinct().join(s.select(F.col("d").alias("expiry"), F.col("i").alias("ei")), "expiry", "left")
    both = s.select(F.col("d").alias("at"), "i", F.lit(None).cast("int").alias("ei"), F.lit(None).cast("date").alias("next")).unionByName(e.select(F.col("expiry").alias("at"), F.lit(None).cast("int").alias("i"), "ei", F.col("expiry").alias("next")))
    ahead = Window.orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    first = F.min(F.when(F.col("next").isNotNull(), F.struct("next", "ei"))).over(ahead)
    month = Window.partitionBy(F.last_day("at"))
    out = both.select("at", "i", first["ei"].alias("xi"), F.max("i").over(month).alias("mi")).where("i is not null")
    return out.select(F.col("at").cast("string").alias("session"), (F.col("mi") - F.col("i")).alias("to_month_end"), (F.col("xi") - F.col("i")).cast("double").alias("to_expiry"))
