"""Forward outcomes: brackets over sessions, competing targets, horizon classes, sequential moves, breakouts, target exits."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.feature_plans import DAY, KEY, keyed, r6
from tickloom.operators.chains import first_outside, followed, numbered
from tickloom.registry import query
from tickloom.sources.fixtures import duck, view


def ahead(df: DataFrame, by: list[str], order: list[str], n: int, step: str) -> DataFrame:
    """`ahead`: (step, session, open, high, low, close) of the next n rows of a group, in order; n bounds the array."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, n)
    return df.withColumn("ahead", F.collect_list(F.struct(F.col(step).alias("step"), "session", "open", "high", "low", "close")).over(w))


def first_of(rows: str | Column, test) -> Column:
    """The first element that passes; null if none does."""
    found = F.filter(rows, test)
    return F.when(F.size(found) > 0, F.element_at(found, 1))


def placed(spark, sf) -> DataFrame:
    return view(spark, sf, "bars").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("session", "hr")))


_PLACED = "pl as (select *, row_number() over (partition by symbol order by session, hr) as k from bars)"
#: Bracket of buys, and the bars that it may take.
BRACKET, HOLDING = 0.9, 40


@query(duck(f"""with {_PLACED}, e as (select a.symbol, a.session, a.hr, a.k, n.open as entry from pl a join pl n on a.symbol = n.symbol and n.k = a.k + 1),
 h as (select e.symbol, e.session, e.hr, min(f.k) as fk from e join pl f on e.symbol = f.symbol and f.k > e.k and f.k <= e.k + {HOLDING} and (f.high >= e.entry * (1 + {BRACKET}) or f.low <= e.entry * (1 - {BRACKET})) group by 1, 2, 3),
 d as (select e.*, f.session as exit_session, case when f.open <= e.entry * (1 - {BRACKET}) then 'sl_gap' when f.open >= e.entry * (1 + {BRACKET}) then 'tp_gap' when f.high >= e.entry * (1 + {BRACKET}) and f.low <= e.entry * (1 - {BRACKET}) then 'sl_same' when f.high >= e.entry * (1 + {BRACKET}) then 'tp' when f.k is not null then 'sl' else 'open' end as reason,
   (select count(distinct g.session) from pl g where g.symbol = e.symbol and g.k >= e.k and g.k <= f.k) as held from e left join h using (symbol, session, hr) left join pl f on e.symbol = f.symbol and f.k = h.fk)
 select {KEY}, reason, case when reason = 'open' or held <> date_diff('day', session, exit_session) + 1 then null when reason in ('tp', 'tp_gap') then 1.0::double else 0.0::double end as label from d"""))
def g7_bracket_over_sessions(spark, sf):
    """A buy at the next open leaves at a bracket, if need be in later sessions; a gap fills at the open, both in one bar is a stop; missing sessions make it unknown."""
    b = ahead(placed(spark, sf), ["symbol"], ["session", "hr"], HOLDING, "k").where(F.size("ahead") > 0).withColumn("entry", F.element_at("ahead", 1)["open"])
    up, down = F.col("entry") * float(1 + Decimal(str(BRACKET))), F.col("entry") * float(1 - Decimal(str(BRACKET)))  # decimal shares: 0.1, not 0.09999999999999998
    b = b.withColumn("up", up).withColumn("down", down).withColumn("hit", first_of("ahead", lambda a: (a["high"] >= F.col("up")) | (a["low"] <= F.col("down"))))
    hit, held = F.col("hit"), F.size(F.array_distinct(F.concat(F.array("session"), F.transform(F.filter("ahead", lambda a: a["step"] <= F.col("hit.step")), lambda a: a["session"]))))
    reason = F.when(hit.isNull(), "open").when(hit["open"] <= down, "sl_gap").when(hit["open"] >= up, "tp_gap").when((hit["high"] >= up) & (hit["low"] <= down), "sl_same").when(hit["high"] >= up, "tp").otherwise("sl")
    b = b.withColumn("reason", reason).withColumn("whole", held == F.date_diff(hit["session"], F.col("session")) + 1)
    return keyed(b, "reason", F.when(F.col("whole"), F.when(F.col("reason").startswith("tp"), 1.0).otherwise(0.0)).alias("label"))


#: Take-profit and stop of multi-day holdings, and their sessions.
TAKE, STOP, SESSIONS = 0.9, 0.6, 5
#: Days of the month at whose multiples a price breaks.
BREAKS = 9


@query(duck(f"""with d as (select symbol, session, min_by(open, hr) as open, max(high) as high, min(low) as low, max_by(close, hr) as close from bars group by 1, 2),
 m as (select symbol, session, hr, open, high, low from bars where date_part('day', session) % 3 <> 0), e as (select symbol, session, close as price from d where date_part('day', session) % 3 <> 0),
 ev as (select symbol, session, hr, open, high, low, false as daily from m union all select symbol, session, 0, open, high, low, true from d where date_part('day', session) % 3 = 0 and date_part('day', session) <> 21),
 t as (select e.symbol, e.session, price, ev.session as at_, ev.hr, ev.open, ev.high, ev.low, daily, row_number() over (partition by e.symbol, e.session order by ev.session, ev.hr) as rn from e join ev on e.symbol = ev.symbol and ev.session > e.session and ev.session <= e.session + interval {SESSIONS} day
   where ev.high >= price * (1 + {TAKE}) or ev.low <= price * (1 - {STOP})),
 l as (select max(session) as last_ from d), gap as (select e.symbol, e.session, min(cast(s.at_ as date)) as missing from e, l, (select cast(unnest(generate_series(1, {SESSIONS})) as int) as off) o, lateral (select cast(e.session + o.off * interval 1 day as date) as at_) s
   where s.at_ <= l.last_ and not exists (select 1 from ev where ev.symbol = e.symbol and ev.session = s.at_) group by 1, 2),
 r as (select e.symbol, e.session, e.price, t.*exclude (symbol, session, price), gap.missing, l.last_ from e cross join l left join t on e.symbol = t.symbol and e.session = t.session and rn = 1 left join gap on e.symbol = gap.symbol and e.session = gap.session),
 s as (select symbol, session, at_, case when missing is not null and (at_ is null or missing < at_) then 'missing_day' when at_ is null and session + interval {SESSIONS} day > last_ then 'censored' when at_ is null then 'timeout'
  when open >= price * (1 + {TAKE}) then 'tp' when open <= price * (1 - {STOP}) then 'sl' when high >= price * (1 + {TAKE}) and low <= price * (1 - {STOP}) then case when daily then 'daily_ambiguous' else 'sl' end when high >= price * (1 + {TAKE}) then 'tp' else 'sl' end as status from r)
 select symbol, cast(session as varchar) as session, case when status in ('tp', 'sl', 'timeout') and exists (select 1 from d b where b.symbol = s.symbol and date_part('day', b.session) % {BREAKS} = 0 and b.session > s.session and b.session <= coalesce(s.at_, s.session + interval {SESSIONS} day)) then 'demerger_window' else status end as status from s"""))
def g8_multi_day_target(spark, sf):
    """The first touch in the next sessions, by bars, by the day where a session has none; a session without either before it makes it unknown, and so does a break of the price (a demerger) up to the exit."""
    b, odd = view(spark, sf, "bars"), F.dayofmonth("session") % 3 == 0
    d = b.groupBy(*DAY).agg(F.min_by("open", "hr").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "hr").alias("close"))
    bars = b.where(~odd).select("symbol", F.col("session").alias("at"), "hr", "open", "high", "low", F.lit(False).alias("daily"))
    events = bars.unionByName(d.where(odd & (F.dayofmonth("session") != 21)).select("symbol", F.col("session").alias("at"), F.lit(0).alias("hr"), "open", "high", "low", F.lit(True).alias("daily")))
    last = d.agg(F.max("session").alias("last"))
    e = d.where(~odd).select("symbol", "session", F.col("close").alias("price")).crossJoin(F.broadcast(last))  # one row
    e = e.withColumn("at", F.explode(F.sequence(F.date_add("session", 1), F.date_add("session", SESSIONS))))
    days = events.withColumn("x", F.struct("hr", "open", "high", "low", "daily")).groupBy("symbol", "at").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    breaks = d.where(F.dayofmonth("session") % BREAKS == 0).select("symbol", F.col("session").alias("at"), F.lit(True).alias("broke"))
    j = e.join(days, ["symbol", "at"], "left").join(breaks, ["symbol", "at"], "left")
    up, down = F.col("price") * (1 + TAKE), F.col("price") * (1 - STOP)
    j = j.withColumn("up", up).withColumn("down", down).withColumn("hit", first_of("xs", lambda x: (x["high"] >= F.col("up")) | (x["low"] <= F.col("down"))))
    hit = F.col("hit")
    kind = F.when(hit["open"] >= up, "tp").when(hit["open"] <= down, "sl").when((hit["high"] >= up) & (hit["low"] <= down), F.when(hit["daily"], "daily_ambiguous").otherwise("sl")).when(hit["high"] >= up, "tp").otherwise("sl")
    what = F.when(F.col("xs").isNull() & (F.col("at") <= F.col("last")), "missing_day").when(hit.isNotNull(), kind)
    g = j.withColumn("what", what).groupBy(*DAY).agg(F.min(F.when(F.col("what").isNotNull(), F.struct("at", "what"))).alias("first"), F.max("at").alias("end"), F.max("last").alias("last"), F.min(F.when(F.col("broke"), F.col("at"))).alias("broke"))
    g = g.withColumn("status", F.coalesce("first.what", F.when(F.col("end") > F.col("last"), "censored").otherwise("timeout")))
    within = F.col("status").isin("tp", "sl", "timeout") & (F.col("broke") <= F.coalesce("first.at", "end"))
    return g.select("symbol", F.col("session").cast("string").alias("session"), F.when(within, "demerger_window").otherwise(F.col("status")).alias("status"))


#: Symmetric target on a tick grid, decay in bars, last bar of the session that counts.
TARGET, TICK, DECAY, CUTOFF = 0.3, 0.1, 5.0, 20


@query(duck(f"""with a as (select *, ceil(close * {1 + TARGET} / {TICK} - 1e-9) * {TICK} as upper_, floor(close * {1 - TARGET} / {TICK} + 1e-9) * {TICK} as lower_ from bars where hr < {CUTOFF}),
 f as (select a.symbol, a.session, a.hr, count(b.hr) as n, min(case when b.high >= upper_ - 1e-9 then b.hr end) - a.hr as up, min(case when b.low <= lower_ + 1e-9 then b.hr end) - a.hr as down from a left join bars b on a.symbol = b.symbol and a.session = b.session and b.hr > a.hr and b.hr <= {CUTOFF} group by 1, 2, 3)
 select {KEY}, case when n < {CUTOFF} - hr then 'missing' when up = down then 'ambiguous' else 'ok' end as state, case when n < {CUTOFF} - hr or up = down then null when up is null and down is null then 0 when down is null or up < down then exp(-(up - 1) / {DECAY}) else -exp(-(down - 1) / {DECAY}) end as raw from f""").replace("end as raw from f", "end as utility from f"))
def g9_competing_target(spark, sf):
    """The first of two targets up to a cut-off, discounted by time; a missing bar or both in one bar abstain."""
    b = view(spark, sf, "bars").where(F.col("hr") <= CUTOFF)
    b = b.withColumn("upper", F.ceil(F.col("close") * (1 + TARGET) / TICK - 1e-9) * TICK).withColumn("lower", F.floor(F.col("close") * (1 - TARGET) / TICK + 1e-9) * TICK)
    b = ahead(b, DAY, ["hr"], CUTOFF, "hr").where(F.col("hr") < CUTOFF)
    up = first_of("ahead", lambda a: a["high"] >= F.col("upper") - 1e-9)["step"] - F.col("hr")
    down = first_of("ahead", lambda a: a["low"] <= F.col("lower") + 1e-9)["step"] - F.col("hr")
    b = b.withColumn("up", up).withColumn("down", down).withColumn("missing", F.size("ahead") < CUTOFF - F.col("hr"))
    up, down, same = F.col("up"), F.col("down"), F.coalesce(F.col("up") == F.col("down"), F.lit(False))
    state = F.when(F.col("missing"), "missing").when(same, "ambiguous").otherwise("ok")
    utility = F.when(F.col("missing") | same, None).when(up.isNull() & down.isNull(), 0.0).when(down.isNull() | (up < down), F.exp(-(up - 1) / DECAY)).otherwise(-F.exp(-(down - 1) / DECAY))
    return keyed(b, state.alias("state"), utility.alias("utility"))


#: Horizons in bars of the outcome classes, and their barrier.
HORIZONS, BARRIER = (2, 4, 8), 0.4


@query(duck(f"""with a as (select a.symbol, a.session, a.hr, n.open as entry from bars a join bars n on a.symbol = n.symbol and a.session = n.session and n.hr = a.hr + 1),
 f as (select a.*, count(b.hr) as n, min(case when b.hr > a.hr + 1 and (b.high >= entry * {1 + BARRIER} or b.low <= entry * {1 - BARRIER}) then b.hr end) as hit from a join bars b on a.symbol = b.symbol and a.session = b.session and b.hr > a.hr and b.hr <= a.hr + {HORIZONS[-1]} group by all having count(b.hr) = {HORIZONS[-1]}),
 g as (select f.symbol, f.session, f.hr, f.hit - f.hr as took, b.low <= entry * {1 - BARRIER} as stop from f left join bars b on f.symbol = b.symbol and f.session = b.session and b.hr = f.hit)
 select {KEY}, case when took is null then 6 else (case when took <= {HORIZONS[0]} then 0 when took <= {HORIZONS[1]} then 1 else 2 end) + case when stop then 3 else 0 end end as class from g"""))
def g10_horizon_class(spark, sf):
    """Target or stop by horizon, or neither: entered at the next open, that bar not counted; both in one bar is a stop."""
    return keyed(_classes(spark, sf), "class")


def _classes(spark, sf) -> DataFrame:
    n = HORIZONS[-1]
    b = ahead(view(spark, sf, "bars"), DAY, ["hr"], n, "hr").where((F.size("ahead") == n) & (F.element_at("ahead", -1)["step"] == F.col("hr") + n)).withColumn("entry", F.element_at("ahead", 1)["open"])
    hit = first_of(F.slice("ahead", 2, n - 1), lambda a: (a["high"] >= F.col("entry") * (1 + BARRIER)) | (a["low"] <= F.col("entry") * (1 - BARRIER)))
    b = b.withColumn("hit", hit)
    took, stop = F.col("hit.step") - F.col("hr"), F.col("hit.low") <= F.col("entry") * (1 - BARRIER)
    bucket = F.when(took <= HORIZONS[0], 0).when(took <= HORIZONS[1], 1).otherwise(2)
    return b.withColumn("class", F.when(took.isNull(), 6).otherwise(bucket + F.when(stop, 3).otherwise(0)))


@query(duck(f"""with a as (select a.symbol, a.session, a.hr, n.open as entry from bars a join bars n on a.symbol = n.symbol and a.session = n.session and n.hr = a.hr + 1),
 f as (select a.*, min(case when b.hr > a.hr + 1 and (b.high >= entry * {1 + BARRIER} or b.low <= entry * {1 - BARRIER}) then b.hr end) as hit from a join bars b on a.symbol = b.symbol and a.session = b.session and b.hr > a.hr and b.hr <= a.hr + {HORIZONS[-1]} group by all having count(b.hr) = {HORIZONS[-1]}),
 g as (select f.symbol, f.hit - f.hr as took, b.low <= entry * {1 - BARRIER} as stop from f left join bars b on f.symbol = b.symbol and f.session = b.session and b.hr = f.hit)
 select symbol, round(count(*) filter (where not stop and took <= {HORIZONS[0]}) / count(*), 6) as tp_1, round(count(*) filter (where not stop and took <= {HORIZONS[1]}) / count(*), 6) as tp_2, round(count(*) filter (where not stop) / count(*), 6) as tp_3 from g group by symbol"""))
def g11_cumulative_target(spark, sf):
    """The chance of the target within each horizon, as running sums of class mass."""
    c = _classes(spark, sf).groupBy("symbol").agg(F.array(*[F.count_if(F.col("class") == k) / F.count("*") for k in range(2 * len(HORIZONS) + 1)]).alias("mass"))
    grown = F.aggregate(F.slice("mass", 1, len(HORIZONS)), F.array().cast("array<double>"), lambda a, m: F.concat(a, F.array(F.least(F.lit(1.0), F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + m))))
    return c.select("symbol", *[r6(grown[i]).alias(f"tp_{i + 1}") for i in range(len(HORIZONS))])


MOVE = 0.5


def sequential_moves(bars: DataFrame, by: list[str], step: str, move: float, width: float) -> DataFrame:
    """(by, n, reference, touch, direction): the n-th move by a share `move` off the close of the bar that ended the move before, from a group's first bar on.

    direction is 1 up, -1 down, 0 if a bar touches both. Every bar's successor is
    the first later one whose high or low lies outside its band; the first bar leads
    to all that count. width: of the buckets of steps that a task numbers.
    """
    b = numbered(bars.select(*by, step, "high", "low", "close"), by, step, width, "place")
    b = b.withColumn("above", F.col("close") * (1 + move)).withColumn("below", F.col("close") * (1 - move))
    linked = first_outside(b, by, "place", "low", "high", "below", "above")
    reached = followed(linked, by, "place", "__to", b.groupBy(*by).agg(F.min("place").alias("place")))
    there = b.select(*by, F.col("place").alias("__to"), F.col(step).alias("touch"), F.col("high").alias("top"), F.col("low").alias("bottom"))
    moves = linked.join(reached, [*by, "place"]).join(there, [*by, "__to"])
    way = (F.col("top") >= F.col("above")).cast("int") - (F.col("bottom") <= F.col("below")).cast("int")
    return moves.select(*by, (F.col("n") + 1).cast("int").alias("n"), F.col(step).alias("reference"), "touch", way.alias("direction"))



@query(duck(f"""with recursive s as (select symbol, session, min(hr) as hr from bars group by 1, 2),
 r as (select symbol, session, hr, 0 as n, cast(null as int) as before from s union all
   select r.symbol, r.session, (select min(f.hr) from bars f, bars a where a.symbol = r.symbol and a.session = r.session and a.hr = r.hr and f.symbol = r.symbol and f.session = r.session and f.hr > r.hr and (f.high >= a.close * {1 + MOVE} or f.low <= a.close * {1 - MOVE})), r.n + 1, r.hr from r where r.hr is not null)
 select r.symbol, cast(r.session as varchar) as session, r.n, r.before as reference, r.hr as touch, (case when f.high >= a.close * {1 + MOVE} then 1 else 0 end) - (case when f.low <= a.close * {1 - MOVE} then 1 else 0 end) as direction
 from r join bars a on a.symbol = r.symbol and a.session = r.session and a.hr = r.before join bars f on f.symbol = r.symbol and f.session = r.session and f.hr = r.hr where r.n > 0""").replace("with bars as", "with recursive bars as").replace(", recursive s as", ", s as"))
def g12_sequential_moves(spark, sf):
    """Moves of a share, each measured from the bar that ended the last."""
    moves = sequential_moves(view(spark, sf, "bars"), DAY, "hr", MOVE, 24)
    return moves.select("symbol", F.col("session").cast("string").alias("session"), "n", "reference", "touch", "direction")


#: Last bar of the opening range, last entry, deadline.
RANGE_END, LAST_ENTRY, DEADLINE = 2, 12, 20


def breakouts(bars: DataFrame) -> DataFrame:
    """(symbol, session, side, stop, trigger, price, exit_hr, gross) of both sides' first cross of the opening range, for each kind of stop."""
    rows = F.sort_array(F.collect_list(F.when(F.col("hr") <= DEADLINE, F.struct("hr", "open", "high", "low", "close"))))
    d = bars.groupBy(*DAY).agg(F.max(F.when(F.col("hr") <= RANGE_END, F.col("high"))).alias("top"), F.min(F.when(F.col("hr") <= RANGE_END, F.col("low"))).alias("bottom"), rows.alias("rows")).where("top is not null")
    d = d.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("level", F.when(F.col("side") == 1, F.col("top")).otherwise(F.col("bottom")))
    inside = lambda x: (x["hr"] > RANGE_END) & (x["hr"] <= LAST_ENTRY)
    d = d.withColumn("t", first_of("rows", lambda x: inside(x) & F.when(F.col("side") == 1, x["high"] > F.col("level")).otherwise(x["low"] < F.col("level")))).where("t is not null")
    long = F.col("side") == 1
    d = d.withColumn("price", F.when(long, F.greatest("level", "t.open")).otherwise(F.least("level", "t.open")))
    stops = F.array(F.struct(F.lit("opposite").alias("stop"), F.when(long, F.col("bottom")).otherwise(F.col("top")).alias("at")), F.struct(F.lit("middle").alias("stop"), ((F.col("top") + F.col("bottom")) / 2).alias("at")), F.struct(F.lit("none").alias("stop"), F.lit(None).cast("double").alias("at")))
    d = d.withColumn("s", F.explode(stops)).select("*", "s.stop", "s.at")
    hit = first_of("rows", lambda x: (x["hr"] >= F.col("t.hr")) & F.when(long, x["low"] <= F.col("at")).otherwise(x["high"] >= F.col("at")))
    d = d.withColumn("hit", hit)
    last, h = F.element_at("rows", -1), F.col("hit")
    fill = F.when(h["hr"] == F.col("t.hr"), F.col("at")).when(long, F.least("at", h["open"])).otherwise(F.greatest("at", h["open"]))
    out = F.when(h.isNotNull(), fill).otherwise(last["close"])
    return d.select(*DAY, "side", "stop", F.col("t.hr").alias("trigger"), "price", F.coalesce(h["hr"], last["hr"]).alias("exit_hr"), (F.col("side") * (out / F.col("price") - 1)).alias("gross"))


@query(duck(f"""with o as (select symbol, session, max(high) filter (where hr <= {RANGE_END}) as top, min(low) filter (where hr <= {RANGE_END}) as bottom from bars group by 1, 2 having max(high) filter (where hr <= {RANGE_END}) is not null),
 s as (select *, cast(unnest([1, -1]) as int) as side from o), t as (select s.symbol, s.session, s.side, top, bottom, min(hr) as trigger from s join bars b on s.symbol = b.symbol and s.session = b.session and hr > {RANGE_END} and hr <= {LAST_ENTRY} and case when side = 1 then high > top else low < bottom end group by all),
 p as (select t.*, case when side = 1 then greatest(top, b.open) else least(bottom, b.open) end as price from t join bars b on t.symbol = b.symbol and t.session = b.session and b.hr = trigger),
 k as (select *, 'opposite' as stop, case when side = 1 then bottom else top end as at_ from p union all select *, 'middle', (top + bottom) / 2 from p union all select *, 'none', null from p),
 h as (select k.symbol, k.session, side, stop, trigger, price, at_, min(case when b.hr >= trigger and case when side = 1 then b.low <= at_ else b.high >= at_ end then b.hr end) as hit, max(b.hr) as last_hr, max_by(b.close, b.hr) as last_close from k join bars b on k.symbol = b.symbol and k.session = b.session and b.hr <= {DEADLINE} group by all)
 select h.symbol, cast(h.session as varchar) as session, side, stop, trigger, coalesce(hit, last_hr) as exit_hr, round(side * (case when hit is null then last_close when hit = trigger then at_ when side = 1 then least(at_, b.open) else greatest(at_, b.open) end / price - 1), 6) + 0.0 as gross from h left join bars b on h.symbol = b.symbol and h.session = b.session and b.hr = hit"""))
def g13_breakout_outcomes(spark, sf):
    return breakouts(view(spark, sf, "bars")).select("symbol", F.col("session").cast("string").alias("session"), "side", "stop", "trigger", "exit_hr", (r6(F.col("gross")) + 0.0).alias("gross"))


NOON, NOON_STOP = 12, 0.3


@query(duck(f"""with d as (select symbol, session, max(case when hr = {NOON} then close end) as entry, min_by(open, hr) as o from bars group by 1, 2 having max(case when hr = {NOON} then close end) is not null), t as (select *, sign(entry - o)::int as trend from d where entry <> o),
 s as (select *, flip, trend * flip as side, stop from t, (values (1), (-1)) f(flip), (values (null::double), ({NOON_STOP})) q(stop)), k as (select *, entry * (1 - side * stop) as at_ from s),
 h as (select k.symbol, k.session, flip, stop, side, entry, at_, min(case when b.hr > {NOON} and case when side = 1 then b.low <= at_ else b.high >= at_ end then b.hr end) as hit, max_by(b.close, b.hr) as last_close from k join bars b on k.symbol = b.symbol and k.session = b.session and b.hr <= {DEADLINE} group by all)
 select h.symbol, cast(h.session as varchar) as session, case when flip = 1 then 'trend' else 'reversal' end as direction, stop is not null as stopped_at, round(side * (case when hit is null then last_close when side = 1 then least(at_, b.open) else greatest(at_, b.open) end / entry - 1), 6) + 0.0 as gross from h left join bars b on h.symbol = b.symbol and h.session = b.session and b.hr = hit"""))
def g14_afternoon_outcomes(spark, sf):
    """With or against the morning's move, from noon to the deadline, with a stop and without."""
    rows = F.sort_array(F.collect_list(F.when(F.col("hr") <= DEADLINE, F.struct("hr", "open", "high", "low", "close"))))
    d = view(spark, sf, "bars").groupBy(*DAY).agg(F.max(F.when(F.col("hr") == NOON, F.col("close"))).alias("entry"), F.min_by("open", "hr").alias("o"), rows.alias("rows")).where("entry is not null and entry <> o")
    d = d.withColumn("flip", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("side", F.signum(F.col("entry") - F.col("o")) * F.col("flip")).withColumn("stopped_at", F.explode(F.array(F.lit(True), F.lit(False))))
    long = F.col("side") == 1
    d = d.withColumn("at", F.when(F.col("stopped_at"), F.col("entry") * (1 - F.col("side") * NOON_STOP)))
    d = d.withColumn("hit", first_of("rows", lambda x: (x["hr"] > NOON) & F.when(long, x["low"] <= F.col("at")).otherwise(x["high"] >= F.col("at"))))
    out = F.when(F.col("hit").isNull(), F.element_at("rows", -1)["close"]).when(long, F.least("at", "hit.open")).otherwise(F.greatest("at", "hit.open"))
    return d.select("symbol", F.col("session").cast("string").alias("session"), F.when(F.col("flip") == 1, "trend").otherwise("reversal").alias("direction"), "stopped_at", (r6(F.col("side") * (out / F.col("entry") - 1)) + 0.0).alias("gross"))


@query(duck(f"""with p as (select symbol, session, close as entry, case when date_part('day', session) % 2 = 0 then 1 else -1 end as side, case when date_part('day', session) % 2 = 0 then close * 1.5 else close * 0.5 end as target from bars where hr = 5),
 f as (select p.*, min(case when side = 1 then case when b.high >= target then b.hr end else case when b.low <= target then b.hr end end) as hit, max_by(b.close, b.hr) as last_close, max(b.hr) as last_hr from p left join bars b on p.symbol = b.symbol and p.session = b.session and b.hr > 5 and b.hr < {DEADLINE} group by all)
 select f.symbol, cast(f.session as varchar) as session, case when last_hr is null then 'open' when hit is null then 'time' when (side = 1 and b.open >= target) or (side = -1 and b.open <= target) then 'tp_gap' else 'tp' end as reason,
  round(case when hit is null then last_close when (side = 1 and b.open >= target) or (side = -1 and b.open <= target) then b.open else target end, 6) as exit_price from f left join bars b on f.symbol = b.symbol and f.session = b.session and b.hr = hit"""))
def g16_target_exits(spark, sf):
    """Open positions over completed bars: a gap over the target fills at the open, else at the target, else the last close before the deadline."""
    b = view(spark, sf, "bars").where(F.col("hr") < DEADLINE)
    even = F.dayofmonth("session") % 2 == 0
    p = b.where("hr = 5").select(*DAY, F.when(even, 1).otherwise(-1).alias("side"), F.when(even, F.col("close") * 1.5).otherwise(F.col("close") * 0.5).alias("target"))
    j = p.join(b.where("hr > 5"), DAY, "left")
    touched = F.when(F.col("side") == 1, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    g = j.groupBy(*DAY, "side", "target").agg(F.min(F.when(touched, F.struct("hr", "open"))).alias("hit"), F.max_by("close", "hr").alias("last"))
    gap = F.when(F.col("side") == 1, F.col("hit.open") >= F.col("target")).otherwise(F.col("hit.open") <= F.col("target"))
    reason = F.when(F.col("last").isNull(), "open").when(F.col("hit").isNull(), "time").when(gap, "tp_gap").otherwise("tp")
    price = F.when(F.col("hit").isNull(), F.col("last")).when(gap, F.col("hit.open")).otherwise(F.col("target"))
    return g.select("symbol", F.col("session").cast("string").alias("session"), reason.alias("reason"), r6(price).alias("exit_price"))


@query(duck(f"""with {_PLACED}, e as (select a.symbol, a.session, a.hr, a.k, n.open as entry from pl a join pl n on a.symbol = n.symbol and n.k = a.k + 1)
 select e.symbol, cast(e.session as varchar) as session, e.hr, cast(min(case when f.high >= entry * 1.3 then f.k end) - e.k as double) as first_touch from e join pl f on e.symbol = f.symbol and f.k > e.k and f.k <= e.k + 6 group by e.symbol, e.session, e.hr, e.k"""))
def g17_touch_within(spark, sf):
    """Bars until a target over the next open, within six."""
    b = ahead(placed(spark, sf), ["symbol"], ["session", "hr"], 6, "k").where(F.size("ahead") > 0).withColumn("entry", F.element_at("ahead", 1)["open"])
    return keyed(b, (first_of("ahead", lambda a: a["high"] >= F.col("entry") * 1.3)["step"] - F.col("k")).cast("double").alias("first_touch"))


@query(duck(f"""with {_PLACED}, f as (select a.symbol, a.session, a.hr, a.close, min(case when b.high >= a.close * 1.2 then b.k end) - a.k as up, min(case when b.high >= a.close * 1.6 then b.k end) - a.k as big, min(case when b.low <= a.close * 0.8 then b.k end) - a.k as down, max_by(b.close, b.k) as last_close
  from pl a join pl b on a.symbol = b.symbol and b.k > a.k and b.k <= a.k + 8 group by a.symbol, a.session, a.hr, a.close, a.k)
 select {KEY}, coalesce(up <= 3, false) as quick, coalesce(big <= 3, false) as big, up is not null and (down is null or up < down) as clean, round(case when up is not null then 0.2 else last_close / close - 1 end, 6) as proxy from f"""))
def g18_outcome_labels(spark, sf):
    """Quick, big and clean outcomes, and a return that stands for them, from first touches."""
    b = ahead(placed(spark, sf), ["symbol"], ["session", "hr"], 8, "k").where(F.size("ahead") > 0)
    at = lambda test: first_of("ahead", test)["step"] - F.col("k")
    b = b.withColumn("up", at(lambda a: a["high"] >= F.col("close") * 1.2)).withColumn("large", at(lambda a: a["high"] >= F.col("close") * 1.6)).withColumn("down", at(lambda a: a["low"] <= F.col("close") * 0.8))
    no = lambda c: F.coalesce(c, F.lit(False))
    return keyed(b, no(F.col("up") <= 3).alias("quick"), no(F.col("large") <= 3).alias("big"), (F.col("up").isNotNull() & (F.col("down").isNull() | (F.col("up") < F.col("down")))).alias("clean"),
                 r6(F.when(F.col("up").isNotNull(), 0.2).otherwise(F.element_at("ahead", -1)["close"] / F.col("close") - 1)).alias("proxy"))
