"""Entry rules over snapshots, the signed score, feasibility, charges and sizes, order books.

A rule is a pair of columns, direction and score; both are null where it has
nothing to say, which is so too where one of its inputs is unknown. Thresholds
are parameters of `Scoring`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalars import centred_sigmoid, ramp, safe_divide
from tickloom.plans.feature_plans import r6
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view


@dataclass(frozen=True)
class Scoring:
    """Thresholds of the rules. Their defaults are fixed values."""

    adx_floor: float = 25
    adx_ceiling: float = 50
    adx_range: float = 20
    rsi_high: float = 70
    rsi_low: float = 30
    exhausted_high: float = 80
    exhausted_low: float = 20
    rsi_span: float = 15
    macd_atr: float = 0.5
    breakout_atr: float = 0.1
    volume_floor: float = 1.5
    volume_ceiling: float = 3
    stretch: float = 0.5
    sigma: float = 2
    sigma_ceiling: float = 4
    range_atr: float = 1
    weight: float = 0.5


SCORING = Scoring()
C = F.col


def _mean(a: Column, b: Column, weight: float) -> Column:
    return a * weight + b * (1 - weight)


def _known(*names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & C(n).isNotNull()
    return test


def trend_continuation(s: Scoring = SCORING) -> tuple[Column, Column]:
    """Stacked averages, momentum of their direction, a strong trend, no exhaustion."""
    ready = _known("ema9", "ema21", "ema50", "adx14", "macd_histogram", "rsi14", "atr14") & (C("adx14") >= s.adx_floor)
    up = (C("ema9") > C("ema21")) & (C("ema21") > C("ema50")) & (C("macd_histogram") > 0)
    down = (C("ema9") < C("ema21")) & (C("ema21") < C("ema50")) & (C("macd_histogram") < 0)
    direction = F.when(ready & up & (C("rsi14") < s.exhausted_high), "LONG").when(ready & down & (C("rsi14") > s.exhausted_low), "SHORT")
    push = F.coalesce(ramp(safe_divide(F.abs("macd_histogram"), C("atr14")), 0, s.macd_atr), F.lit(0.0))
    return direction, F.when(direction.isNotNull(), _mean(ramp(C("adx14"), s.adx_floor, s.adx_ceiling), push, s.weight))


def range_breakout(s: Scoring = SCORING) -> tuple[Column, Column]:
    """A close within a share of the range's edge; volume confirms where it is known."""
    high, low, tolerance = C("rolling_high_20"), C("rolling_low_20"), C("atr14") * s.breakout_atr
    ready = _known("rolling_high_20", "rolling_low_20", "atr14") & (high > low) & (tolerance > 0)
    below, above = high - C("close"), C("close") - low
    long = (below <= tolerance) & (below <= above)
    direction = F.when(ready & long, "LONG").when(ready & (above <= tolerance), "SHORT")
    near = 1 - ramp(F.when(long, below).otherwise(above) / tolerance, 0, 1)
    confirmed = _mean(near, ramp(C("volume_ratio_20"), s.volume_floor, s.volume_ceiling), s.weight)
    return direction, F.when(direction.isNotNull(), F.coalesce(confirmed, near))


def band_reversion(s: Scoring = SCORING) -> tuple[Column, Column]:
    """A stretch outside the band, an extreme RSI, no trend."""
    b, rsi = C("bollinger_percent_b_20"), C("rsi14")
    ready = _known("bollinger_percent_b_20", "rsi14", "adx14") & (C("adx14") < s.adx_range)
    direction = F.when(ready & (b <= 0) & (rsi <= s.rsi_low), "LONG").when(ready & (b >= 1) & (rsi >= s.rsi_high), "SHORT")
    long = direction == "LONG"
    stretch, extreme = ramp(F.when(long, -b).otherwise(b - 1), 0, s.stretch), ramp(F.when(long, s.rsi_low - rsi).otherwise(rsi - s.rsi_high), 0, s.rsi_span)
    return direction, F.when(direction.isNotNull(), _mean(stretch, extreme, s.weight))


def vwap_reversion(s: Scoring = SCORING) -> tuple[Column, Column]:
    sigma = C("price_vs_vwap_sigma")
    direction = F.when(sigma <= -s.sigma, "LONG").when(sigma >= s.sigma, "SHORT")
    return direction, F.when(direction.isNotNull(), ramp(F.abs(sigma), s.sigma, s.sigma_ceiling))


def opening_breakout(s: Scoring = SCORING) -> tuple[Column, Column]:
    """Beyond the opening range on either side, by ranges of a bar."""
    high, low, ready = C("opening_range_high"), C("opening_range_low"), _known("opening_range_high", "opening_range_low", "atr14") & (C("atr14") != 0)
    direction = F.when(ready & (C("close") > high), "LONG").when(ready & (C("close") < low), "SHORT")
    beyond = F.when(C("close") > high, C("close") - high).otherwise(low - C("close"))
    return direction, F.when(direction.isNotNull(), ramp(safe_divide(beyond, C("atr14")), 0, s.range_atr))


RULES = {"trend_continuation": trend_continuation, "range_breakout": range_breakout, "band_mean_reversion": band_reversion, "vwap_reversion": vwap_reversion, "opening_range_breakout": opening_breakout}


def _signals(spark, sf, rule):
    direction, score = rule()
    d = view(spark, sf, "snaps").select("symbol", "idx", direction.alias("direction"), score.alias("score"))
    return d.where("direction is not null").select("symbol", "idx", "direction", (r6(C("score")) + 0.0).alias("score"))


def _u(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


@query(duck(f"""with f as (select *, adx14 >= 25 and ema9 is not null and ema50 is not null and atr14 is not null as ready from snaps), g as (select *, case when ready and ema9 > ema21 and ema21 > ema50 and macd_histogram > 0 and rsi14 < 80 then 'LONG' when ready and ema9 < ema21 and ema21 < ema50 and macd_histogram < 0 and rsi14 > 20 then 'SHORT' end as direction from f)
 select symbol, idx, direction, round(({_u("(adx14 - 25) / 25")} + case when atr14 = 0 then 0 else {_u("abs(macd_histogram) / atr14 / 0.5")} end) / 2, 6) + 0.0 as score from g where direction is not null"""))
def f1_trend_continuation(spark, sf):
    return _signals(spark, sf, trend_continuation)


@query(duck(f"""with f as (select *, rolling_high_20 - close as below, close - rolling_low_20 as above, 0.1 * atr14 as tol from snaps where rolling_high_20 > rolling_low_20 and atr14 > 0), g as (select *, case when below <= tol and below <= above then 'LONG' when above <= tol then 'SHORT' end as direction from f),
 s as (select *, 1 - {_u("(case when direction = 'LONG' then below else above end) / tol")} as near from g where direction is not null)
 select symbol, idx, direction, round(case when volume_ratio_20 is null then near else (near + {_u("(volume_ratio_20 - 1.5) / 1.5")}) / 2 end, 6) + 0.0 as score from s"""))
def f2_range_breakout(spark, sf):
    return _signals(spark, sf, range_breakout)


@query(duck(f"""with g as (select *, bollinger_percent_b_20 as b, case when adx14 < 20 and bollinger_percent_b_20 <= 0 and rsi14 <= 30 then 'LONG' when adx14 < 20 and bollinger_percent_b_20 >= 1 and rsi14 >= 70 then 'SHORT' end as direction from snaps)
 select symbol, idx, direction, round(case direction when 'LONG' then ({_u("-b / 0.5")} + {_u("(30 - rsi14) / 15")}) / 2 else ({_u("(b - 1) / 0.5")} + {_u("(rsi14 - 70) / 15")}) / 2 end, 6) + 0.0 as score from g where direction is not null"""))
def f3_band_reversion(spark, sf):
    return _signals(spark, sf, band_reversion)


@query(duck(f"select symbol, idx, case when price_vs_vwap_sigma < 0 then 'LONG' else 'SHORT' end as direction, round({_u('(abs(price_vs_vwap_sigma) - 2) / 2')}, 6) + 0.0 as score from snaps where abs(price_vs_vwap_sigma) >= 2"))
def f4_vwap_reversion(spark, sf):
    return _signals(spark, sf, vwap_reversion)


@query(duck(f"""select symbol, idx, case when close > opening_range_high then 'LONG' else 'SHORT' end as direction, round({_u("(case when close > opening_range_high then close - opening_range_high else opening_range_low - close end) / atr14")}, 6) + 0.0 as score
 from snaps where atr14 <> 0 and (close > opening_range_high or close < opening_range_low)"""))
def f5_opening_range_breakout(spark, sf):
    return _signals(spark, sf, opening_breakout)


#: Weights of the eight components, target, decay and close-out of the signed score.
WEIGHTS, TARGET, DECAY, SQUARE_OFF = (0.4, 0.3, 0.2, 0.2, 0.3, 0.1, 0.2, 0.3), 0.002, 5.0, 360.0
COMPONENTS = ("alignment", "momentum", "pressure", "range", "reversion", "pullback", "session", "confirmation")
_NEEDED = "ema9 ema21 ema50 ema9_slope_5 ema21_slope_5 return_1 return_5 return_15 macd_histogram macd_histogram_change plus_di14 minus_di14 adx14 rolling_high_20 rolling_low_20 rsi14 bollinger_percent_b_20 atr14 atr_pct".split()


def opportunity(weights: tuple[float, ...] = WEIGHTS, target: float = TARGET, decay: float = DECAY, square_off: float = SQUARE_OFF) -> tuple[Column, Column, Column, Column]:
    """(reason, components, reachability, score): eight components between -1 and 1, weighted, by the chance to get there in time."""
    bound = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    mean = lambda *xs: sum(xs[1:], xs[0]) / len(xs)

    def known_mean(*xs: Column) -> Column:
        n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
        total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
        return F.when(n > 0, total / n).otherwise(0.0)

    # What a row without volatility, or at minute zero, would divide by is unknown; its reason says why.
    positive = lambda x: F.when(x > 0, x)
    atr, share, close, left = positive(C("atr14")), positive(C("atr_pct")), C("close"), square_off - C("minutes")
    regime = F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("adx14") / 50))
    alignment = mean(bound((C("ema9") - C("ema21")) / atr), bound((C("ema21") - C("ema50")) / atr), bound(C("ema9_slope_5") / share), bound(C("ema21_slope_5") / share))
    momentum = mean(*[bound(C(f"return_{k}") / (share * k**0.5)) for k in (1, 5, 15)], bound(C("macd_histogram") / atr), bound(C("macd_histogram_change") / atr))
    both = C("plus_di14") + C("minus_di14")
    pressure = F.when(both > 0, (C("plus_di14") - C("minus_di14")) / both).otherwise(0.0)
    place = lambda high, low: bound((2 * close - high - low) / (high - low + 2 * atr))
    stretched = known_mean(bound((C("rsi14") - 50) / 20), bound(2 * (C("bollinger_percent_b_20") - 0.5)), bound(C("price_vs_vwap_sigma") / 2))
    session = known_mean(bound(C("from_open") / (share * F.sqrt(positive(C("minutes"))))), 2 * C("in_range") - 1, place(C("opening_range_high"), C("opening_range_low")))
    volume = C("volume_ratio_20")
    confirmation = F.when(volume >= 0, mean(alignment, momentum, pressure) * volume / (1 + volume)).otherwise(0.0)
    components = F.array(alignment, momentum, pressure, place(C("rolling_high_20"), C("rolling_low_20")) * regime, -stretched * (1 - regime), -bound((close - C("ema9")) / atr) * regime, session * regime, confirmation)
    reach = (1 - F.exp(-decay * (share / target) ** 2)) * (1 - F.exp(-left / decay))
    reason = F.when(C("minutes").isNull(), "not_ready").when((C("minutes") <= 0) | (left <= 0), "outside_window").when(~_known(*_NEEDED), "not_ready").when((C("atr14") <= 0) | (C("atr_pct") <= 0), "no_volatility")
    dot = F.aggregate(F.zip_with(components, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return reason, components, F.when(reason.isNull(), reach).otherwise(0.0), F.when(reason.isNull(), centred_sigmoid(reach * dot)).otherwise(0.0)


def _b(x: str) -> str:
    return f"greatest(-1.0, least(1.0, {x}))"


_PLACE = "(2 * close - {0} - {1}) / ({0} - {1} + 2 * atr14)"
_OPPORTUNITY = f"""o0 as (select *, greatest(0.0, least(1.0, adx14 / 50)) as regime, {SQUARE_OFF} - minutes as left_, ({_b("(ema9 - ema21) / atr14")} + {_b("(ema21 - ema50) / atr14")} + {_b("ema9_slope_5 / atr_pct")} + {_b("ema21_slope_5 / atr_pct")}) / 4 as c1,
  ({_b("return_1 / atr_pct")} + {_b("return_5 / (atr_pct * sqrt(5.0))")} + {_b("return_15 / (atr_pct * sqrt(15.0))")} + {_b("macd_histogram / atr14")} + {_b("macd_histogram_change / atr14")}) / 5 as c2, (plus_di14 - minus_di14) / (plus_di14 + minus_di14) as c3,
  list_avg(list_filter([{_b("(rsi14 - 50) / 20")}, {_b("2 * (bollinger_percent_b_20 - 0.5)")}, case when price_vs_vwap_sigma is not null then {_b("price_vs_vwap_sigma / 2")} end], lambda x: x is not null)) as stretched,
  coalesce(list_avg(list_filter([case when from_open is not null then {_b("from_open / (atr_pct * sqrt(minutes))")} end, 2 * in_range - 1, case when opening_range_high is not null then {_b(_PLACE.format("opening_range_high", "opening_range_low"))} end], lambda x: x is not null)), 0) as sess from snaps where minutes > 0 and minutes < {SQUARE_OFF} and {" and ".join(f"{n} is not null" for n in _NEEDED)} and atr14 > 0),
 o1 as (select *, {_b(_PLACE.format("rolling_high_20", "rolling_low_20"))} * regime as c4, -stretched * (1 - regime) as c5, -{_b("(close - ema9) / atr14")} * regime as c6, sess * regime as c7, case when volume_ratio_20 >= 0 then (c1 + c2 + c3) / 3 * volume_ratio_20 / (1 + volume_ratio_20) else 0 end as c8,
  (1 - exp(-{DECAY} * power(atr_pct / {TARGET}, 2))) * (1 - exp(-left_ / {DECAY})) as reach from o0),
 o2 as (select *, reach * ({" + ".join(f"{w} * c{i + 1}" for i, w in enumerate(WEIGHTS))}) as raw from o1)"""


@query(duck(f"""with {_OPPORTUNITY} select s.symbol, s.idx, case when s.minutes is null then 'not_ready' when s.minutes <= 0 or s.minutes >= {SQUARE_OFF} then 'outside_window' when o2.idx is null and s.atr14 <= 0 and s.c_3 is not null and s.rsi14 is not null then 'no_volatility' when o2.idx is null then 'not_ready' end as reason,
 round(coalesce(2 / (1 + exp(-raw)) - 1, 0), 6) + 0.0 as score, round(coalesce(reach, 0), 6) as reach, round(c1, 6) + 0.0 as alignment, round(c5, 6) + 0.0 as reversion, round(c7, 6) + 0.0 as session_, round(c8, 6) + 0.0 as confirmation from snaps s left join o2 on s.symbol = o2.symbol and s.idx = o2.idx"""))
def f6_signed_opportunity(spark, sf):
    reason, parts, reach, score = opportunity()
    d = view(spark, sf, "snaps").select("symbol", "idx", reason.alias("reason"), parts.alias("c"), reach.alias("reach"), score.alias("score"))
    part = lambda i: F.when(C("reason").isNull(), r6(C("c")[i]) + 0.0)
    return d.select("symbol", "idx", "reason", (r6("score") + 0.0).alias("score"), r6("reach").alias("reach"), part(0).alias("alignment"), part(4).alias("reversion"), part(6).alias("session_"), part(7).alias("confirmation"))


#: Charge schedules, fixed values: fractions of a leg's value; brokerage is capped a leg, deliveries pay a fee when sold.
BROKERAGE, CAP, EXCHANGE, FUND, REGULATOR, SERVICE_TAX = 0.0003, 20.0, 0.000030699, 0.000000001, 0.000001, 0.18
INTRADAY_SELL_TAX, INTRADAY_STAMP, DELIVERY_TAX, DELIVERY_STAMP, DEPOSITORY = 0.00025, 0.00003, 0.001, 0.00015, 15.34
CLIP, MARGIN, TICK = 100_000.0, 0.002, 0.05


def charges(buy: Column, sell: Column, same_session: Column) -> dict[str, Column]:
    """The parts of a trade's charges, intraday or delivery, and their total."""
    turnover = buy + sell
    pick = lambda a, b: F.when(same_session, a).otherwise(b)
    exchange, regulator = turnover * (EXCHANGE + FUND), turnover * REGULATOR
    brokerage = pick(F.least(F.lit(CAP), buy * BROKERAGE) + F.least(F.lit(CAP), sell * BROKERAGE), F.lit(0.0))
    out = {"brokerage": brokerage, "tax": pick(sell * INTRADAY_SELL_TAX, turnover * DELIVERY_TAX), "exchange": exchange, "regulator": regulator, "stamp": buy * pick(F.lit(INTRADAY_STAMP), F.lit(DELIVERY_STAMP)),
           "service_tax": (brokerage + exchange + regulator) * SERVICE_TAX, "depository": pick(F.lit(0.0), F.lit(DEPOSITORY))}
    return out | {"total": sum(list(out.values())[1:], brokerage)}


def _charges(buy: str, sell: str) -> str:
    return f"""(least({CAP}, {buy} * {BROKERAGE}) + least({CAP}, {sell} * {BROKERAGE})) as i_brokerage, ({buy} + {sell}) * {EXCHANGE + FUND} as exchange, ({buy} + {sell}) * {REGULATOR} as regulator"""


@query(duck(f"""with c as (select trade_id, entry_value as buy, entry_value + gross as sell, trade_id % 3 <> 0 as same, {_charges("entry_value", "(entry_value + gross)")} from x8),
 p as (select trade_id, case when same then 'intraday' else 'delivery' end as kind, case when same then i_brokerage else 0 end as brokerage, case when same then sell * {INTRADAY_SELL_TAX} else (buy + sell) * {DELIVERY_TAX} end as tax, exchange, regulator, buy * case when same then {INTRADAY_STAMP} else {DELIVERY_STAMP} end as stamp, case when same then 0 else {DEPOSITORY} end as depository from c),
 q as (select *, (brokerage + exchange + regulator) * {SERVICE_TAX} as service_tax from p)
 select trade_id, kind, round(brokerage, 11) as brokerage, round(tax, 11) as tax, round(stamp, 11) as stamp, round(service_tax, 11) as service_tax, round(depository, 2) as depository, round(brokerage + tax + exchange + regulator + stamp + service_tax + depository, 11) as total from q"""))
def h3_trade_charges(spark, sf):
    x = view(spark, sf, "x8")
    same = C("trade_id") % 3 != 0
    c = charges(C("entry_value"), C("entry_value") + C("gross"), same)
    return x.select("trade_id", F.when(same, "intraday").otherwise("delivery").alias("kind"), *[F.round(c[k], 11).alias(k) for k in ("brokerage", "tax", "stamp", "service_tax")], F.round(c["total"], 11).alias("total"), F.round(c["depository"], 2).alias("depository"))


def sized(price: Column, clip: float = CLIP, margin: float = MARGIN, tick: float = TICK) -> dict[str, Column]:
    """Whole shares worth the clip at least, the move that leaves the margin after charges, exits rounded away from the entry to the tick grid."""
    shares = F.ceil(clip / price - 1e-9)
    notional = price * shares
    required = charges(notional, notional, F.lit(True))["total"] / notional + margin
    return {"shares": shares, "required": required, "long_exit": F.ceil(price * (1 + required) / tick - 1e-9) * tick, "short_exit": F.floor(price * (1 - required) / tick + 1e-9) * tick}


_SIZED = f"""z0 as (select *, cast(ceil({CLIP} / close - 1e-9) as bigint) as shares from snaps), z1 as (select *, close * shares as notional from z0), z2 as (select *, {_charges("notional", "notional")} from z1),
 z3 as (select *, (i_brokerage + exchange + regulator) * {1 + SERVICE_TAX} + notional * {INTRADAY_SELL_TAX + INTRADAY_STAMP} as cost from z2), z4 as (select *, cost / notional + {MARGIN} as required from z3)"""


@query(duck(f"with {_SIZED} select symbol, idx, shares, round(required, 9) as required, round(ceil(close * (1 + required) / {TICK} - 1e-9) * {TICK}, 2) as long_exit, round(floor(close * (1 - required) / {TICK} + 1e-9) * {TICK}, 2) as short_exit from z4"))
def h4_size_and_targets(spark, sf):
    z = sized(C("close"))
    return view(spark, sf, "snaps").select("symbol", "idx", z["shares"].alias("shares"), F.round(z["required"], 9).alias("required"), F.round(z["long_exit"], 2).alias("long_exit"), F.round(z["short_exit"], 2).alias("short_exit"))


@query(duck(f"""with {_SIZED} select symbol, idx, round(required, 9) as required, case when n % 13 = 0 then 'volatility_unknown' when required > 0.01 * atr_pct then 'volatility_too_low' when minutes is null then 'clock_unknown' when {SQUARE_OFF} - minutes < 30 then 'session_too_short' end as reason from z4"""))
def f9_feasibility(spark, sf):
    """Volatility first, then the clock; what is unknown fails. The required move is that of the size that would be bought."""
    required = sized(C("close"))["required"]
    s = view(spark, sf, "snaps").withColumn("required", required).withColumn("known", F.when(C("n") % 13 != 0, C("atr_pct")))
    reason = F.when(C("known").isNull(), "volatility_unknown").when(C("required") > 0.01 * C("known"), "volatility_too_low").when(C("minutes").isNull(), "clock_unknown").when(SQUARE_OFF - C("minutes") < 30, "session_too_short")
    return s.select("symbol", "idx", F.round("required", 9).alias("required"), reason.alias("reason"))


def slippage(levels: str, mid: Column, notional: float) -> Column:
    """Basis points against mid of a market order of a value, walking levels (price, qty), best first; null where they don't fill it."""
    start = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("qty"))

    def step(t, x):
        take = F.when(t["left"] > 0, F.least(x["qty"], F.floor(t["left"] / x["price"]) + 1)).otherwise(0.0)
        return F.struct((t["left"] - take * x["price"]).alias("left"), (t["cost"] + take * x["price"]).alias("cost"), (t["qty"] + take).alias("qty"))

    walked = F.aggregate(levels, start, step)
    return F.when(walked["left"] <= 0, F.abs(walked["cost"] / walked["qty"] - mid) / mid * 10_000)


def books(spark, sf):
    """Five levels of bids and asks of each order, best first, in one pass; quantities, last and previous prices beside them."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", (C("l_linestatus") == "O").alias("bid"), (C("l_extendedprice").cast("double") / C("l_quantity").cast("double")).alias("price"), C("l_quantity").cast("double").alias("qty"), "l_linenumber", "l_partkey")
    level = lambda sign: F.struct((sign * C("price")).alias("k"), "qty", "l_linenumber", "l_partkey", "price")
    best = lambda side, sign: F.slice(F.sort_array(F.collect_list(F.when(side, level(sign)))), 1, 5)
    return rows.groupBy("l_orderkey").agg(best(C("bid"), -1).alias("bids"), best(~C("bid"), 1).alias("asks"), F.sum(F.when(C("bid"), C("qty"))).alias("buy"), F.sum(F.when(~C("bid"), C("qty"))).alias("sell"), F.max("price").alias("last"), F.min("price").alias("previous"))


_BOOK = """r as (select l_orderkey, l_linestatus = 'O' as bid, cast(l_extendedprice as double) / cast(l_quantity as double) as price, cast(l_quantity as double) as qty, l_linenumber, l_partkey from lineitem),
 l as (select *, row_number() over (partition by l_orderkey, bid order by case when bid then -price else price end, qty, l_linenumber, l_partkey) as lvl from r),
 b as (select l_orderkey, max(price) filter (where bid and lvl = 1) as bp, max(qty) filter (where bid and lvl = 1) as bq, max(price) filter (where not bid and lvl = 1) as ap, max(qty) filter (where not bid and lvl = 1) as aq, sum(qty) filter (where bid and lvl <= 5) as b5, sum(qty) filter (where not bid and lvl <= 5) as a5,
   sum(price * qty) filter (where bid and lvl <= 5) as bv, sum(price * qty) filter (where not bid and lvl <= 5) as av, sum(qty) filter (where bid) as buy, sum(qty) filter (where not bid) as sell, max(price) as last_, min(price) as previous from l group by l_orderkey)"""


@query(f"""with {_BOOK} select l_orderkey, bp is not null and ap is not null as two_sided, round((ap - bp) / ((ap + bp) / 2) * 10000, 6) + 0.0 as spread_bps, case when ap is not null then round((bq - aq) / (bq + aq), 7) + 0.0 end as imbalance_1, round((b5 - a5) / (b5 + a5), 7) + 0.0 as imbalance_5, round((coalesce(buy, 0) - coalesce(sell, 0)) / (coalesce(buy, 0) + coalesce(sell, 0)), 7) + 0.0 as imbalance_total,
 round(((bp * aq + ap * bq) / (bq + aq) - (ap + bp) / 2) / ((ap + bp) / 2) * 10000, 6) + 0.0 as microprice_bps, case when ap is not null and bp is not null then round(bv, 3) end as bid_value, case when ap is not null and bp is not null then round(av, 3) end as ask_value, round((last_ / previous - 1) * 100, 6) + 0.0 as day_change_pct,
 round((previous * 1.2 / last_ - 1) * 100, 6) + 0.0 as to_upper_pct, round((1 - previous * 0.8 / last_) * 100, 6) + 0.0 as to_lower_pct from b""")
def e41_order_book(spark, sf):
    b = books(spark, sf)
    first = lambda side, f: F.try_element_at(side, F.lit(1))[f]
    bp, bq, ap, aq = first("bids", "price"), first("bids", "qty"), first("asks", "price"), first("asks", "qty")
    total = lambda side, f: F.aggregate(side, F.lit(0.0), lambda t, x: t + f(x))
    both, mid = (F.size("bids") > 0) & (F.size("asks") > 0), (ap + bp) / 2
    b5, a5 = total("bids", lambda x: x["qty"]), total("asks", lambda x: x["qty"])
    z = lambda c, n=6: F.round(c, n) + 0.0
    only = lambda c: F.when(both, c)
    buy, sell = F.coalesce("buy", F.lit(0.0)), F.coalesce("sell", F.lit(0.0))
    value = lambda side: only(F.round(total(side, lambda x: x["price"] * x["qty"]), 3))
    return b.select("l_orderkey", both.alias("two_sided"), z(safe_divide(ap - bp, mid) * 10_000).alias("spread_bps"), z(safe_divide(bq - aq, bq + aq), 7).alias("imbalance_1"), only(z(safe_divide(b5 - a5, b5 + a5), 7)).alias("imbalance_5"), z(safe_divide(buy - sell, buy + sell), 7).alias("imbalance_total"),
                    z(safe_divide(safe_divide(bp * aq + ap * bq, bq + aq) - mid, mid) * 10_000).alias("microprice_bps"), value("bids").alias("bid_value"), value("asks").alias("ask_value"), z((safe_divide(C("last"), C("previous")) - 1) * 100).alias("day_change_pct"),
                    z((safe_divide(C("previous") * 1.2, C("last")) - 1) * 100).alias("to_upper_pct"), z((1 - safe_divide(C("previous") * 0.8, C("last"))) * 100).alias("to_lower_pct"))


NOTIONAL = 60_000.0


@query(f"""with recursive {_BOOK}, s as (select l.l_orderkey, lvl, price, qty, (ap + bp) / 2 as mid from l join b using (l_orderkey) where not bid and lvl <= 5 and bp is not null and ap is not null),
 w as (select l_orderkey, 0 as lvl, {NOTIONAL}::double as left_, 0.0::double as cost, 0.0::double as got, any_value(mid) as mid from s group by 1 union all
   select w.l_orderkey, s.lvl::int, left_ - t.take * price, cost + t.take * price, got + t.take, w.mid from w join s on w.l_orderkey = s.l_orderkey and s.lvl = w.lvl + 1, lateral (select least(qty, floor(left_ / price) + 1) as take) t where left_ > 0)
 select l_orderkey, case when min(left_) <= 0 then round(abs(min_by(cost, left_) / min_by(got, left_) - any_value(mid)) / any_value(mid) * 10000, 6) + 0.0 end as buy_slippage_bps from w group by l_orderkey""")
def e42_slippage(spark, sf):
    b = books(spark, sf).where((F.size("bids") > 0) & (F.size("asks") > 0))
    mid = (F.element_at("bids", 1)["price"] + F.element_at("asks", 1)["price"]) / 2
    return b.select("l_orderkey", (r6(slippage("asks", mid, NOTIONAL)) + 0.0).alias("buy_slippage_bps"))
