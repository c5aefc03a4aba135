"""Queries over single price series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.sqltext import BARS
from pairloom.operators import indicators as I
from pairloom.registry import query
from pairloom.sources import panels as P

R = lambda c, n=6: F.round(c, n).alias(c)
SEQ = "over (partition by sym order by d)"


def win(n: int) -> str:
    return f"over (partition by sym order by d rows between {n - 1} preceding and current row)"


def mp(agg: str, x: str, n: int, m: int) -> str:
    return f"case when count({x}) {win(n)} >= {m} then {agg} {win(n)} end"


@query(f"with {BARS} select sym, d, close, volume from bars")
def bars_brand_week(spark, sf):
    return P.bars_brand_week(spark, sf)


@query("""select event_type as sym, date_trunc('hour', ts) as ts, arg_min(value, event_id) as open, max(value) as high, min(value) as low,
  arg_max(value, event_id) as close, count(*) as volume from events group by 1, 2""")
def bars_ohlc_hour(spark, sf):
    return P.bars_event_hour(spark, sf)


@query(f"""with {BARS} select sym, d, round(close / lag(close) {SEQ} - 1, 6) as returns, round(ln(close / lag(close) {SEQ}), 6) as log_returns from bars""")
def returns_log(spark, sf):
    return I.returns(P.bars_brand_week(spark, sf)).select("sym", "d", R("returns"), R("log_returns"))


@query(f"with {BARS} select sym, d, " + ", ".join(f"round(close / lag(close, {k}) {SEQ} - 1, 6) as momentum_{k}" for k in (1, 5, 10, 20)) + " from bars")
def momentum_k(spark, sf):
    return I.momentum(P.bars_brand_week(spark, sf)).select("sym", "d", *[R(f"momentum_{k}") for k in (1, 5, 10, 20)])


@query(f"with {BARS} select sym, d, " + ", ".join(f"floor({mp('avg(close)', 'close', n, int(n * 0.7))} * 1000 + 0.37) / 1000 as ma_{n}" for n in (5, 10, 20, 50)) + " from bars")
def ma_min_periods(spark, sf):
    return I.moving_averages(P.bars_brand_week(spark, sf)).select("sym", "d", *[P.thousandths(F.col(f"ma_{n}")).alias(f"ma_{n}") for n in (5, 10, 20, 50)])


@query(f"""with recursive {BARS}, n as (select sym, d, close, row_number() {SEQ} as i from bars),
e as (select sym, d, close, i, close as n5, 1.0::double as d5, close as n20, 1.0::double as d20 from n where i = 1
  union all select n.sym, n.d, n.close, n.i, e.n5 * (1 - 2 / 6.0::double) + n.close, e.d5 * (1 - 2 / 6.0::double) + 1, e.n20 * (1 - 2 / 21.0::double) + n.close, e.d20 * (1 - 2 / 21.0::double) + 1
  from e join n on n.sym = e.sym and n.i = e.i + 1)
select sym, d, round(n5 / d5, 4) as ema_5, round(n20 / d20, 4) as ema_20 from e""")
def ema_span(spark, sf):
    return I.ema(P.bars_brand_week(spark, sf), (5, 20)).select("sym", "d", R("ema_5", 4), R("ema_20", 4))


@query(f"""with {BARS}, g as (select *, close - lag(close) {SEQ} as ch from bars),
h as (select sym, d, case when ch > 0 then ch else 0 end as up, case when ch < 0 then -ch else 0 end as dn from g)
select sym, d, """ + ", ".join(f"round(coalesce(100 - 100 / (1 + {mp('avg(up)', 'up', n, m)} / ({mp('avg(dn)', 'dn', n, m)} + 1e-10)), 50), 4) as rsi_{n}" for n, m in ((14, 9), (21, 14))) + " from h")
def rsi_windows(spark, sf):
    return I.rsi(P.bars_brand_week(spark, sf)).select("sym", "d", R("rsi_14", 4), R("rsi_21", 4))


@query(f"""with {BARS}, m as (select sym, d, close, {mp('avg(close)', 'close', 20, 14)} as a, {mp('stddev_samp(close)', 'close', 20, 14)} as s from bars)
select sym, d, round(a + 2 * s, 3) as bb_upper, round(a - 2 * s, 3) as bb_lower, round((close - (a - 2 * s)) / (4 * s + 1e-8), 5) as bb_position from m""")
def bollinger_20(spark, sf):
    return I.bollinger(P.bars_brand_week(spark, sf)).select("sym", "d", R("bb_upper", 3), R("bb_lower", 3), R("bb_position", 5))


@query(f"with {BARS}, r as (select sym, d, close / lag(close) {SEQ} - 1 as r from bars) select sym, d, " + ", ".join(f"round({mp('stddev_samp(r)', 'r', n, int(n * 0.7))} * sqrt(252), 5) as volatility_{n}" for n in (10, 20, 50)) + " from r")
def volatility_k(spark, sf):
    return I.volatility(P.bars_brand_week(spark, sf)).select("sym", "d", *[R(f"volatility_{n}", 5) for n in (10, 20, 50)])


@query(f"with {BARS} select sym, d, round({mp('avg(volume)', 'volume', 20, 14)}, 4) as volume_ma, round(volume / ({mp('avg(volume)', 'volume', 20, 14)} + 1e-8), 6) as volume_ratio from bars")
def volume_ratio(spark, sf):
    return I.volume(P.bars_brand_week(spark, sf)).select("sym", "d", R("volume_ma", 4), R("volume_ratio"))


@query(f"""with {BARS}, r as (select sym, d, close / lag(close) {SEQ} - 1 as r from bars), v as (select sym, d, {mp('stddev_samp(r)', 'r', 20, 14)} * sqrt(252) as v from r)
select sym, d, cast(coalesce(v > {mp('quantile_cont(v, 0.7)', 'v', 200, 100)}, false) as int) as high_vol_regime from v""")
def high_vol_regime(spark, sf):
    return I.high_vol_regime(P.bars_brand_week(spark, sf)).select("sym", "d", "high_vol_regime")


@query(f"""with {BARS} select sym, d, round(abs({mp('avg(close)', 'close', 20, 14)} - {mp('avg(close)', 'close', 50, 35)}) / ({mp('stddev_samp(close)', 'close', 20, 20)} + 1e-8), 5) as trend_strength from bars""")
def trend_strength(spark, sf):
    return I.trend_strength(P.bars_brand_week(spark, sf)).select("sym", "d", R("trend_strength", 5))


_GAPS = """e as (select event_type as sym, cast(date_trunc('hour', ts) as timestamp) as d, max(value) as close from events group by 1, 2),
g as (select s.sym, c.d, e.close from (select distinct sym from e) s cross join (select distinct d from e) c left join e on e.sym = s.sym and e.d = c.d)"""


def _gaps(spark, sf):
    """Hour bars on the calendar of all hours: the outer alignment of every symbol."""
    e = P.table(spark, sf, "events").groupBy(F.col("event_type").alias("sym"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("d")).agg(F.max("value").alias("close"))
    grid = e.select("d").distinct().crossJoin(F.broadcast(e.select("sym").distinct()))  # a handful of event types
    return grid.join(e, ["sym", "d"], "left").select("sym", "d", "close")


@query(f"with {_GAPS} select sym, d, coalesce(close, 0) as close from g")
def align_outer_zero(spark, sf):
    return _gaps(spark, sf).withColumn("close", F.coalesce("close", F.lit(0.0)))


@query(f"""with {_GAPS} select sym, d, coalesce(last_value(close ignore nulls) over (partition by sym order by d rows between unbounded preceding and current row),
  first_value(close ignore nulls) over (partition by sym order by d rows between current row and unbounded following)) as close from g""")
def fill_forward_back(spark, sf):
    return _gaps(spark, sf).select("sym", "d", I.filled("close").alias("close"))


@query(f"""with {_GAPS}, m as (select *, case when extract(hour from d) < 14 then close end as rsi_x, avg(case when extract(hour from d) < 14 and close is not null then 0.0 else 1.0 end) over (partition by sym) as miss from g)
select sym, d, case when miss > 0.5 then 50.0 else coalesce(last_value(rsi_x ignore nulls) over (partition by sym order by d rows between unbounded preceding and current row),
  first_value(rsi_x ignore nulls) over (partition by sym order by d rows between current row and unbounded following), 0) end as rsi_x from m""")
def null_share_policy(spark, sf):
    g = _gaps(spark, sf).select("sym", "d", F.when(F.hour("d") < 14, F.col("close")).alias("rsi_x"))
    return I.fill_policy(g, ("rsi_x",))


@query()
def indicators_all(spark, sf):
    return I.all_indicators(P.bars_brand_week(spark, sf))


@query(f"""with {BARS} select sym, d, round(close / first_value(close) {SEQ}, 6) as path from bars""")
def normalised_paths(spark, sf):
    first = F.first("close", True).over(I.seq().rowsBetween(W.unboundedPreceding, 0))
    return P.bars_brand_week(spark, sf).select("sym", "d", F.round(F.col("close") / first, 6).alias("path"))


@query("""select distinct upper(regexp_replace(trim(s), '[ \\t\\n]', '', 'g')) as symbol from (select p_brand as s from part union all select p_type from part union all select ' ' || c_mktsegment from customer union all select cast(p_size as varchar) from part) x
where s is not null and length(upper(regexp_replace(trim(s), '[ \\t\\n]', '', 'g'))) between 1 and 8 and upper(regexp_replace(trim(s), '[ \\t\\n]', '', 'g')) not in ('NAN', 'NULL', '', '0')
  and not regexp_matches(regexp_replace(trim(s), '[ \\t\\n]', '', 'g'), '^[0-9]+$') and regexp_matches(upper(regexp_replace(trim(s), '[ \\t\\n]', '', 'g')), '^[A-Z0-9.#-]+$')""")
def symbol_clean(spark, sf):
    from pairloom.operators.cleaning import clean_symbols

    part, cust = P.table(spark, sf, "part"), P.table(spark, sf, "customer")
    raw = part.select(F.col("p_brand").alias("symbol")).union(part.select("p_type")).union(cust.select(F.concat(F.lit(" "), "c_mktsegment"))).union(part.select(F.col("p_size").cast("string")))
    return clean_symbols(raw, longest=8, allowed="A-Z0-9.#-")


@query(f"""with {BARS} select sym, count(*) as n, min(close) as least, round(avg(case when close is null then 1.0 else 0.0 end), 6) as null_share,
  min(close) > 0 and avg(case when close is null then 1.0 else 0.0 end) <= 0.15 and min(close) >= 2.0 as valid from bars group by sym""")
def price_validation(spark, sf):
    from pairloom.operators.cleaning import validate_prices

    return validate_prices(P.bars_brand_week(spark, sf)).select("sym", "n", "least", R("null_share"), "valid")


@query(f"""with {BARS}, r as (select *, close / lag(close) {SEQ} - 1 as r, {mp('avg(volume)', 'volume', 20, 14)} as vma from bars)
select sym, count(*) as n, round(avg(vma), 4) as volume_ma, round(avg(close), 3) as close, round(stddev_samp(r) * sqrt(252), 4) as vol
from r group by sym having count(*) >= 300 and avg(vma) >= 50 and avg(close) >= 5 and stddev_samp(r) * sqrt(252) between 0.05 and 80""")
def quality_symbols(spark, sf):
    from pairloom.operators.cleaning import quality_symbols as q

    return q(P.bars_brand_week(spark, sf), least_rows=300, least_volume=50, least_close=5, vol_low=0.05, vol_high=80.0).select("sym", "n", R("volume_ma", 4), R("close", 3), R("vol", 4))


@query(f"""with {BARS} select sym, cast(min(d) as date) as first_d, cast(max(d) as date) as last_d, count(*) as n, count(*) - count(close) as missing from bars group by sym""")
def coverage_audit(spark, sf):
    return P.bars_brand_week(spark, sf).groupBy("sym").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("n"), (F.count("*") - F.count("close")).alias("missing"))


@query(f"""with {BARS} select case when d <= date '1996-12-31' then 'train' else 'test' end as part, sym, count(*) as n from bars group by 1, 2 having count(*) >= 50""")
def time_split(spark, sf):
    b = P.bars_brand_week(spark, sf).withColumn("part", F.when(F.col("d") <= F.lit("1996-12-31").cast("date"), "train").otherwise("test"))
    return b.groupBy("part", "sym").agg(F.count("*").alias("n")).where("n >= 50")
