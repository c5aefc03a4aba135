"""Queries for regimes, costs, reports, baselines, significance, simulation and the scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.config import EngineConfig
from pairloom.functions.sqltext import BARS, DAILY, MACRO, SECTOR, TRADES
from pairloom.operators import baselines as BL
from pairloom.operators import costs as C
from pairloom.operators import pairs as OP
from pairloom.operators import regime as RG
from pairloom.operators import reports as RP
from pairloom.operators import scorer as SC
from pairloom.operators import significance as SG
from pairloom.operators import risk as RK
from pairloom.operators import simulate as SM
from pairloom.operators import spread as SP
from pairloom.plans.pair_queries import _FORM, _paths, _spread
from pairloom.registry import query
from pairloom.sources import panels as P

R = lambda c, n=6: F.round(c, n).alias(c)
UP = "rows between unbounded preceding and current row"

# regimes ------------------------------------------------------------------------------------------------------------

_DISP = SECTOR + f""", r as (select sym, d, ln(close) - ln(lag(close) over (partition by sym order by d)) as r from sector),
s as (select sym, d, case when count(r) over w >= 30 then sum(r) over w end as s from r window w as (partition by sym order by d rows between 62 preceding and current row)),
g as (select d, stddev_samp(s) as x from s group by d), disp as (select d, case when count(x) over h >= 60 then (x - avg(x) over h) / (stddev_samp(x) over h + 1e-10) end as z from g window h as (order by d rows between 251 preceding and current row))"""


def _sectors(spark, sf):
    return P.sector_week(spark, sf)


@query(f"with {_DISP} select d, round(z, 5) as z from disp")
def dispersion_z(spark, sf):
    return RG.dispersion_z(_sectors(spark, sf)).select("d", R("z", 5))


@query(f"""with {SECTOR}, r as (select sym, d, close / lag(close) over (partition by sym order by d) - 1 as r, count(*) over (partition by sym) as n from sector),
g as (select d, stddev_samp(r) as x from r where n > 10 group by d having stddev_samp(r) is not null),
z as (select d, case when count(x) over h >= 60 then (x - avg(x) over h) / (stddev_samp(x) over h + 1e-10) end as z from g window h as (order by d rows between 251 preceding and current row))
select d, round(z, 5) as z from z where z is not null""")
def daily_dispersion_z(spark, sf):
    return RG.daily_dispersion_z(_sectors(spark, sf)).select("d", R("z", 5))


@query(f"with {MACRO} select d, vix, case when vix > 40 then 'high' when vix > 30 then 'raised' when vix < 20 then 'low' else 'usual' end as band from macro")
def vix_bands(spark, sf):
    v = F.col("vix")
    return P.macro_day(spark, sf).withColumn("band", F.when(v > 40, "high").when(v > 30, "raised").when(v < 20, "low").otherwise("usual"))


_REG = MACRO + ", " + _DISP + """, reg as (select m.d, m.vix, coalesce(round(x.z, 5), 0) as z from macro m asof left join (select d, z from disp where z is not null) x on m.d >= x.d),
sc as (select d, vix, z, least(case when vix > 40 then 0.25 when vix > 30 then 0.5 else 1.0 end, case when z > 2 then 0.5 when vix < 20 and z > 0.8 then 0.4 else 1.0 end)::double as scale from reg)"""


def _regime(spark, sf):
    m = P.macro_day(spark, sf)
    z = RG.dispersion_z(_sectors(spark, sf)).where("z is not null").select("d", F.round("z", 5).alias("z"))
    x = RG.as_of(m.withColumn("sym", F.lit("")), z, "z").withColumn("z", F.coalesce("z", F.lit(0.0)))
    return x.select("d", "vix", "z", RG.regime_scale(F.col("vix"), F.col("z")).alias("scale"))


@query(f"with {_REG} select d, vix, z, scale from sc")
def regime_scale(spark, sf):
    return _regime(spark, sf)


@query(f"with {_REG} select scale, count(*) as n from sc group by scale")
def regime_histogram(spark, sf):
    return _regime(spark, sf).groupBy("scale").agg(F.count("*").alias("n"))


@query(f"with {_REG} select d, scale, row_number() over (order by d) >= 63 and sum(cast(scale < 1 as int)) over (order by d rows between 62 preceding and current row) / 63.0::double > 0.2 as stop from sc")
def hard_stop_flag(spark, sf):
    return RG.hard_stop(_regime(spark, sf).select("d", "scale"))


@query(f"""with {_REG} select count(*) as n, round(avg(vix), 4) as vix_mean, min(vix) as vix_min, max(vix) as vix_max, round(avg(z), 4) as z_mean, max(z) as z_max, count(*) filter (z > 1) as above_1_0, count(*) filter (z > 1.2) as above_1_2, count(*) filter (z > 2) as above_2_0,
(select round(avg(vix), 4) from (select vix from sc where d < date '1997-01-01' order by d desc limit 252)) as vix_before from sc where d between date '1997-01-01' and date '1997-12-31'""")
def regime_diagnosis(spark, sf):
    return RG.diagnosis(_regime(spark, sf), "1997-01-01", "1997-12-31").withColumns({c: F.round(c, 4) for c in ("vix_mean", "z_mean", "vix_before")})


# costs --------------------------------------------------------------------------------------------------------------

_COST = TRADES + """, l as (select *, 1000 * px_long as lv, 900 * px_short as sv from trades),
c as (select *, 2 * (greatest(lv * 0.15::double * 0.6::double / 1e4, 0.5) + greatest(sv * 0.15::double * 0.6::double / 1e4, 0.5)) as commission,
 2 * (least(0.3::double * sqrt(lv / (5e6 * px_long)) * 1e4, 2) * lv / 1e4 + least(0.3::double * sqrt(sv / (5e6 * px_short)) * 1e4, 2) * sv / 1e4) as impact, 2 * (lv + sv) * 0.8::double / 1e4 as bid_ask,
 sv * case when length(short_sym) <= 3 and regexp_matches(short_sym, '^[A-Za-z]+$') then 0.0005 when length(short_sym) = 4 and regexp_matches(short_sym, '^[A-Za-z]+$') then 0.001 when length(short_sym) >= 5 then 0.02 else 0.005 end::double * holding_days / 365 as borrow,
 (lv + sv) * 0.1::double * 0.055::double * holding_days / 365 as financing from l)"""


@query(f"with {_COST} select trade_id, round(commission, 4) as commission, round(impact, 4) as impact, round(bid_ask, 4) as bid_ask, round(borrow, 4) as borrow, round(financing, 4) as financing, round(commission + impact + bid_ask + borrow + financing, 4) as total_cost from c")
def trade_costs(spark, sf):
    t = P.trades(spark, sf).withColumn("long_qty", F.lit(1000.0)).withColumn("short_qty", F.lit(900.0))
    return C.trade_costs(t).select("trade_id", *[R(c, 4) for c in ("commission", "impact", "bid_ask", "borrow", "financing", "total_cost")])


#: The profiles as rows; fixed values, the same as in operators.costs.
_PROF = """prof(profile, commission_bps, bid_ask_bps, impact, impact_cap, easy, general, hard, financing, adv, base, most, day_trades, dd_limit) as (values
('quant_hf', 1.0::double, 2.0::double, 0.40::double, 12.0::double, 0.003::double, 0.006::double, 0.025::double, 0.005::double, 1e9, 0.12::double, 0.30::double, 8, 0.20::double),
('multi_strat', 1.5, 4.0, 0.60, 20.0, 0.005, 0.010, 0.050, 0.010, 1e9, 0.08, 0.20, 6, 0.15), ('fundamental_ls', 5.0, 10.0, 1.20, 50.0, 0.010, 0.020, 0.080, 0.015, 5e8, 0.04, 0.10, 4, 0.12),
('institutional', 0.42, 1.19, 0.15, 4.0, 0.0005, 0.001, 0.005, 0.0, 2e9, 0.02, 0.05, 3, 0.10), ('retail', 7.0, 15.0, 2.50, 80.0, 0.030, 0.060, 0.150, 0.030, 1e8, 0.02, 0.05, 2, 0.15))"""


def _parts(value):
    """The five parts of a profile's round trip, in the order of the report."""
    return {
        "commission": f"4 * {value} / 2 * commission_bps / 1e4", "bid_ask": f"4 * {value} / 2 * bid_ask_bps / 1e4", "impact": f"{value} * least(impact * sqrt({value} / 2 / greatest(adv, 1)) * 1e4, impact_cap) / 1e4",
        "borrow": f"{value} / 2 * case when length(short_sym) <= 3 then easy when length(short_sym) = 4 then general else hard end * holding_days / 365",
        "financing": f"{value} * (1 - 1 / greatest(1, base * day_trades * 5)) * (0.05::double + financing) * holding_days / 365",
    }


def _pc(value):
    return " + ".join(_parts(value).values())


@query(f"with {TRADES}, {_PROF} select profile, round(avg({_pc('1e6')}), 4) as cost, round(max({_pc('1e6')}), 4) as most_cost from trades cross join prof group by profile")
def profile_costs(spark, sf):
    t = P.trades(spark, sf).select("short_sym", "holding_days", F.lit(1e6).alias("value")).crossJoin(F.broadcast(C.profiles(spark)))  # five rows
    return C.profile_costs(t).groupBy("profile").agg(F.round(F.avg("cost"), 4).alias("cost"), F.round(F.max("cost"), 4).alias("most_cost"))


@query("select o_orderkey, round(case when o_totalprice * 5000 >= 1e9 then 0.2 when o_totalprice * 5000 >= 1e8 then 0.4 when o_totalprice * 5000 >= 1e7 then 0.6 else 0.8 end::double, 2) as discount from orders")
def volume_tiers(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", C.volume_discount(F.col("o_totalprice") * 5000).alias("discount"))


@query("select p_partkey, case when length(p_brand) <= 3 then 0.0005 when length(p_brand) = 4 then 0.001 when length(p_brand) >= 5 then 0.02 else 0.005 end::double as rate from part")
def borrow_tier(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", C.borrow_rate(F.col("p_brand")).alias("rate"))


# reports ------------------------------------------------------------------------------------------------------------

_PF = "case when sum(net_pnl_pct) filter (net_pnl_pct > 0) is null then 0 when sum(-net_pnl_pct) filter (net_pnl_pct < 0) is null then 999 else sum(net_pnl_pct) filter (net_pnl_pct > 0) / sum(-net_pnl_pct) filter (net_pnl_pct < 0) end"


@query(f"with {TRADES} select count(*) as trades, count(*) filter (net_pnl_pct > 0) as wins, count(*) filter (net_pnl_pct < 0) as losses, round(count(*) filter (net_pnl_pct > 0) / count(*), 6) as win_rate, round(avg(net_pnl_pct) filter (net_pnl_pct > 0), 6) as mean_win, round(avg(-net_pnl_pct) filter (net_pnl_pct < 0), 6) as mean_loss, round({_PF}, 6) as profit_factor from trades")
def trades_summary(spark, sf):
    return RP.trade_summary(P.trades(spark, sf)).select("trades", "wins", "losses", R("win_rate"), R("mean_win"), R("mean_loss"), R("profit_factor"))


def _cat(values, of):
    rows = ", ".join(f"('{v}')" for v in values)
    return f"""with {TRADES}, g as (select {of} as category, count(*) as trades, avg(cast(net_pnl_pct > 0 as int)) * 100 as w, avg(net_pnl_pct) * 100 as m, sum(net_pnl_pct) * 100 as t from trades group by 1)
select c.category, coalesce(trades, 0) as trades, round(coalesce(w, 0), 5) as win_pct, round(coalesce(m, 0), 5) as mean_pct, round(coalesce(t, 0), 5) as total_pct from (values {rows}) c(category) left join g on g.category = c.category"""


def _rounded(df):
    return df.select("category", "trades", R("win_pct", 5), R("mean_pct", 5), R("total_pct", 5))


@query(_cat(("LONG", "SHORT"), "action"))
def by_action(spark, sf):
    return _rounded(RP.by_category(P.trades(spark, sf), ["LONG", "SHORT"], F.col("action")))


@query(_cat(("1-3", "4-7", "8-999"), "case when holding_days <= 3 then '1-3' when holding_days <= 7 then '4-7' else '8-999' end"))
def by_holding_bucket(spark, sf):
    return _rounded(RP.by_category(P.trades(spark, sf), ["1-3", "4-7", "8-999"], RP.holding_bucket()))


@query(_cat(("0.5-0.7", "0.7-0.85", "0.85-1.0"), "case when strength >= 0.5 and strength < 0.7 then '0.5-0.7' when strength >= 0.7 and strength < 0.85 then '0.7-0.85' when strength >= 0.85 and strength <= 1 then '0.85-1.0' end"))
def by_strength_bucket(spark, sf):
    return _rounded(RP.by_category(P.trades(spark, sf), ["0.5-0.7", "0.7-0.85", "0.85-1.0"], RP.strength_bucket()))


_PERF = TRADES + f""", v as (select *, exp(sum(ln(1 + net_pnl_pct)) over (partition by pair order by d, trade_id {UP})) as v from trades), dd as (select *, 1 - v / max(v) over (partition by pair order by d, trade_id {UP}) as dd from v),
perf as (select pair, count(*) as trades, sum(net_pnl_pct) * 100 as total_return, count(*) filter (net_pnl_pct > 0) as wins, count(*) filter (net_pnl_pct <= 0) as losses, avg(holding_days) as mean_hold, {_PF} as profit_factor,
 coalesce(avg(net_pnl_pct) / nullif(stddev_pop(net_pnl_pct), 0) * sqrt(252), 0) as sharpe, max(dd) as max_drawdown, sum(pnl_dollar) as pnl_dollar from dd group by pair)"""
_PERF_OUT = "pair, trades, round(total_return, 5) as total_return, wins, losses, round(mean_hold, 5) as mean_hold, round(profit_factor, 5) as profit_factor, round(sharpe, 5) as sharpe, round(max_drawdown, 6) as max_drawdown, round(pnl_dollar, 2) as pnl_dollar"


def _perf(spark, sf):
    p = RP.pair_performance(P.trades(spark, sf))
    return p.select("pair", "trades", R("total_return", 5), "wins", "losses", R("mean_hold", 5), R("profit_factor", 5), R("sharpe", 5), R("max_drawdown"), R("pnl_dollar", 2))


@query(f"with {_PERF} select {_PERF_OUT} from perf")
def pair_performance(spark, sf):
    return _perf(spark, sf)


@query(f"with {_PERF} select * from (select {_PERF_OUT} from perf) order by total_return desc, pair limit 10")
def top10_pairs(spark, sf):
    return _perf(spark, sf).orderBy(F.desc("total_return"), "pair").limit(10)


@query(f"with {TRADES}, r as (select *, row_number() over (partition by d order by strength * zscore desc, trade_id) as r from trades) select d, trade_id, r from r where r <= 8")
def daily_top8(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("d").orderBy(F.desc(F.col("strength") * F.col("zscore")), "trade_id")
    return P.trades(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 8").select("d", "trade_id", F.col("r").cast("long").alias("r"))


_EQ = DAILY + f", eq as (select d, pnl, exp(sum(ln(1 + pnl)) over (order by d {UP})) as v from daily), dd as (select *, (max(v) over (order by d {UP}) - v) / max(v) over (order by d {UP}) as dd from eq)"


@query(f"with {_EQ} select d, pnl, round(v, 6) as value, round(dd, 6) as drawdown from dd")
def equity_curve(spark, sf):
    return RP.drawdowns(P.daily(spark, sf)).select("d", "pnl", R("value"), R("drawdown"))


@query(f"with {_EQ} select round(max(dd), 6) as max_drawdown from dd")
def max_drawdown(spark, sf):
    return RP.drawdowns(P.daily(spark, sf)).agg(F.round(F.max("drawdown"), 6).alias("max_drawdown"))


@query(f"with {DAILY} select cast(date_trunc('month', d) as date) as month, round(exp(sum(ln(1 + pnl))) - 1, 6) as total, count(*) as days, round(avg(cast(pnl > 0 as int)), 6) as win_share, round(stddev_samp(pnl) * sqrt(21), 6) as vol, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(21), 0), 5) as sharpe from daily group by 1")
def monthly_performance(spark, sf):
    return RP.monthly(P.daily(spark, sf)).select("month", R("total"), "days", R("win_share"), R("vol"), R("sharpe", 5))


@query(f"with {_EQ} select round(exp(sum(ln(1 + pnl))) - 1, 6) as total, round((exp(sum(ln(1 + pnl))) - 1) * 252 / count(*), 6) as annualised, round(avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(252), 5) as sharpe, round(stddev_pop(pnl) * sqrt(252), 6) as vol, round(max(dd), 6) as max_drawdown, count(*) as days from dd")
def backtest_summary(spark, sf):
    return RP.backtest_summary(P.daily(spark, sf)).select(R("total"), R("annualised"), R("sharpe", 5), R("vol"), R("max_drawdown"), "days")


_WIN = DAILY + ''', ord as (select d, row_number() over (order by d) - 1 as i, count(*) over () as n from (select distinct d from daily)), st as (select unnest(range(0, (select max(n) from ord) - 315 + 1, 63)) as s),
win as (select cast(s / 63 + 1 as int) as "window", max(d) filter (i = s) as train_start, max(d) filter (i = s + 251) as train_end, max(d) filter (i = s + 252) as test_start, max(d) filter (i = s + 314) as test_end from st join ord on i between s and s + 314 group by s),
res as (select "window", test_start, exp(sum(ln(1 + pnl))) - 1 as total, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(252) as sharpe from daily join win on d between test_start and test_end group by 1, 2)'''


def _windows(spark, sf):
    return RP.walk_windows(P.daily(spark, sf))


def _results(spark, sf):
    return RP.window_returns(P.daily(spark, sf), _windows(spark, sf))


@query(f'with {_WIN} select "window", train_start, train_end, test_start, test_end from win')
def walk_windows(spark, sf):
    return _windows(spark, sf)


@query(f"with {_WIN} select test_start >= date '1997-01-01' as late, count(*) as n, round(avg(total), 6) as mean, count(*) filter (total > 0) as profitable from res group by 1")
def era_split(spark, sf):
    return _results(spark, sf).groupBy((F.col("test_start") >= F.lit("1997-01-01").cast("date")).alias("late")).agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean"), F.count_if(F.col("total") > 0).alias("profitable"))


@query(f"with {_WIN} select count(*) as windows, count(*) filter (total > 0) as profitable, round(avg(total), 6) as mean, round(list_sort(list(total))[cast(count(*) // 2 + 1 as int)], 6) as median, round(avg(sharpe), 5) as sharpe, round(exp(sum(ln(1 + total))) - 1, 6) as stitched from res")
def walk_summary(spark, sf):
    return RP.walk_summary(_results(spark, sf)).select("windows", "profitable", R("mean"), R("median"), R("sharpe", 5), R("stitched"))


#: The Sharpe ratio and the annualised return count every day of the calendar up to the stop, 0 where nothing exits.
_REPLAY = TRADES + ", " + _PROF + f""", x as (select *, least(base * least(abs(zscore) / 2.3, 2), most) as fr from trades cross join prof), y as (select *, fr * 1e8 as val from x),
z as (select profile, dd_limit, d + cast(greatest(1, holding_days) as int) as d, net_pnl_pct * fr - ({_pc('val')}) / 1e8 as net, {_pc('val')} as cost from y),
dy as (select profile, dd_limit, d, sum(net) as pnl from z group by 1, 2, 3), v as (select *, exp(sum(ln(1 + greatest(pnl, -0.999999))) over (partition by profile order by d {UP})) as v from dy),
dd as (select *, 1 - v / greatest(1, max(v) over (partition by profile order by d {UP})) as dd from v), stp as (select p.profile, min(d) as stop from prof p left join dd on dd.profile = p.profile and dd >= p.dd_limit group by 1),
cal as (select s.profile, c.d, coalesce(dy.pnl, 0) as r from stp s join (select distinct d from trades) c on s.stop is null or c.d <= s.stop left join dy on dy.profile = s.profile and dy.d = c.d),
per as (select profile, avg(r) / (stddev_pop(r) + 1e-10) * sqrt(252) as sharpe, count(*) as days from cal group by 1),
tr as (select z.profile, count(*) as trades, sum(cost) as cost, count(*) filter (net > 0) / count(*) as win_rate, sum(net) filter (net > 0) / sum(-net) filter (net < 0) as pf from z join stp using (profile) where stop is null or d <= stop group by 1),
eq as (select dd.profile, arg_max(v, d) - 1 as total, max(dd) as worst from dd join stp using (profile) where stop is null or d <= stop group by 1)
select profile, trades, round(total, 6) as total, round(total * 252 / days, 6) as annualised, round(worst, 6) as max_drawdown, round(cost, 0) as cost, round(win_rate, 6) as win_rate, round(coalesce(pf, 0), 5) as profit_factor,
 round(sharpe, 4) as sharpe, days, stop is not null as stopped from eq join per using (profile) join tr using (profile) join stp using (profile)"""


@query(f"with {_REPLAY}")
def fund_replay(spark, sf):
    t = P.trades(spark, sf).withColumn("spread_return", F.col("net_pnl_pct"))
    out = RP.fund_replay(t, P.trades(spark, sf).select("d"))
    return out.select("profile", "trades", R("total"), R("annualised"), R("max_drawdown"), R("cost", 0), R("win_rate"), R("profit_factor", 5), R("sharpe", 4), "days", "stopped")


_RUN = _EQ + """, t as (select *, (trade_id * 3 % 50) / 1e5::double as cost_pct, 0.45::double + (trade_id * 7) % 50 / 100.0::double as quality, (trade_id * 19 % 100) / 100.0::double as feature_quality from trades),
b as (select exp(sum(ln(1 + pnl))) - 1 as total, count(*) as days, max(dd) as worst from dd)"""


@query(f"""with {_RUN} select (select round(total, 6) from b) as total, (select round(worst, 6) from b) as max_drawdown, count(*) as trades, round(sum(cost_pct) * 1e8, 0) as costs, round(sum(cost_pct), 6) as cost_impact, round(avg(cost_pct) * 1e8, 2) as cost_per_trade, round(avg(cost_pct), 8) as cost_pct_per_trade,
round(avg(strength), 6) as mean_strength, round(avg(quality), 6) as mean_quality, count(*) filter (feature_quality > 0.7) as high_quality, round(avg(net_pnl_pct), 8) as mean_trade, (select max(n) from (select count(*) as n from t group by d)) as most_daily, round(count(*) / (select days from b), 5) as trades_per_day from t""")
def run_summary(spark, sf):
    k = F.col("trade_id")
    t = P.trades(spark, sf).withColumn("cost_pct", F.pmod(k * 3, F.lit(50)) / F.lit(1e5)).withColumn("quality", 0.45 + F.pmod(k * 7, F.lit(50)) / F.lit(100.0)).withColumn("feature_quality", F.pmod(k * 19, F.lit(100)) / F.lit(100.0))
    out = RP.run_summary(P.daily(spark, sf), t)
    return out.select(R("total"), R("max_drawdown"), "trades", R("costs", 0), R("cost_impact"), R("cost_per_trade", 2), R("cost_pct_per_trade", 8), R("mean_strength"), R("mean_quality"), "high_quality", R("mean_trade", 8), "most_daily", R("trades_per_day", 5))


@query(f"with {DAILY}, i as (select *, sum(cast(pnl > 0.003 as int)) over (order by d {UP}) as isl from daily), r as (select d, pnl, cast(sum(cast(pnl < -0.008 as int)) over (partition by isl order by d {UP}) as bigint) as run from i) select d, pnl, run, run >= 5 as stop from r")
def losing_run(spark, sf):
    return RP.losing_run(P.daily(spark, sf))


# significance -------------------------------------------------------------------------------------------------------

@query(f"with {DAILY} select count(*) as n, round(avg(pnl), 8) as mean, round(stddev_samp(pnl), 8) as sd, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) as sharpe, round(skewness(pnl), 5) as skew, round(kurtosis(pnl) + 3, 5) as kurt from daily")
def sharpe_moments(spark, sf):
    return SG.moments(P.daily(spark, sf)).select("n", R("mean", 8), R("sd", 8), R("sharpe", 5), R("skew", 5), R("kurt", 5))


@query(f"""with {DAILY}, e as (select d, pnl, pnl - avg(pnl) over () as e, row_number() over (order by d) as i from daily), p as (select count(*) as n, greatest(1, cast(floor(4 * pow(count(*) / 100.0::double, 2.0::double / 9)) as int)) as l, avg(pnl) as m, sum(e * e) as g0 from e),
g as (select k, sum(a.e * b.e) as g from p, range(1, p.l + 1) r(k) join e a on true join e b on b.i = a.i - k group by k)
select any_value(n) as n, round(any_value(m), 8) as mean, round(any_value(m) / sqrt(greatest((any_value(g0) / any_value(n) + sum(2 * (1 - k / (l + 1.0::double)) * g / n)) / any_value(n), 1e-18)), 4) as t from g cross join p""")
def hac_tstat(spark, sf):
    return SG.hac_t(P.daily(spark, sf)).select("n", R("mean", 8), R("t", 4))


def _totals(spark, sf):
    return [x.total for x in _results(spark, sf).orderBy("window").collect()]  # a value a quarter


@query()
def significance_report(spark, sf):
    """The tests of the daily series, of what lies in test periods, and of the test periods' returns."""
    daily, windows = P.daily(spark, sf), _windows(spark, sf)
    oos = daily.join(F.broadcast(windows), F.col("d").between(F.col("test_start"), F.col("test_end"))).select("d", "pnl")  # a row a quarter
    return SG.report(daily, oos, _totals(spark, sf))


@query()
def bootstrap_ci(spark, sf):
    return SG.bootstrap_sharpe(P.daily(spark, sf))


@query()
def oos_window_test(spark, sf):
    return spark.createDataFrame([SG.window_test(_totals(spark, sf))], SG.WINDOW_TEST)


# baselines ----------------------------------------------------------------------------------------------------------

_DT = BARS + """, paths as (select sym, d, close / first_value(close) over (partition by sym order by d) as p from bars), pj as (select a.sym as s1, b.sym as s2, a.d, a.p as p1, b.p as p2 from paths a join paths b on a.d = b.d and a.sym < b.sym),
f as (select s1, s2, avg(p1 - p2) as mu, stddev_samp(p1 - p2) as sd from pj where d <= date '1996-12-31' group by 1, 2 having count(*) >= 30 and stddev_samp(p1 - p2) > 0),
t as (select pj.*, mu, sd, p1 - p2 as x, r from (select *, p1 / lag(p1) over w - p2 / lag(p2) over w as r from pj window w as (partition by s1, s2 order by d)) pj join f using (s1, s2) where d > date '1996-12-31'),
n as (select *, row_number() over (partition by s1, s2 order by d) as i, count(*) over (partition by s1, s2) as m from t),
st as (select s1, s2, i, d, m, case when x > mu + 2 * sd then -1 when x < mu - 2 * sd then 1 else 0 end as pos, case when x > mu + 2 * sd or x < mu - 2 * sd then -0.0005::double else 0.0::double end as pnl from n where i = 1
  union all select n.s1, n.s2, n.i, n.d, n.m, case when st.pos = 0 then case when x > mu + 2 * sd then -1 when x < mu - 2 * sd then 1 else 0 end when (st.pos = 1 and x >= mu) or (st.pos = -1 and x <= mu) then 0 else st.pos end,
   st.pos * r - case when st.pos = 0 and (x > mu + 2 * sd or x < mu - 2 * sd) or (st.pos = 1 and x >= mu) or (st.pos = -1 and x <= mu) then 0.0005::double else 0.0::double end from st join n on n.s1 = st.s1 and n.s2 = st.s2 and n.i = st.i + 1),
dt as (select s1, s2, d, pnl - case when i = m and pos <> 0 then 0.0005::double else 0.0::double end as pnl from st)"""


def _distance(spark, sf):
    pairs = OP.align(_paths(spark, sf))
    return BL.distance_trades(pairs, "1996-12-31")


@query(f"with recursive {_DT} select s1, s2, d, round(pnl, 6) as pnl from dt")
def distance_trades(spark, sf):
    return _distance(spark, sf).select("s1", "s2", "d", R("pnl"))


@query(f"with recursive {_DT}, k as (select count(*) as k from (select distinct s1, s2 from dt)) select d, round(sum(pnl) / any_value(k), 6) as pnl from dt cross join k group by d")
def benchmark_portfolio(spark, sf):
    return BL.portfolio(_distance(spark, sf)).select("d", R("pnl"))


_DB = _DT.replace(BARS, _FORM).replace("a.sym < b.sym),\nf as", "a.sym < b.sym join picked k on k.s1 = a.sym and k.s2 = b.sym),\nf as")


@query(f"""with recursive {_DB}, k as (select count(*) as k from (select distinct s1, s2 from dt)), day as (select d, sum(pnl) / any_value(k) as r from dt cross join k group by d)
select round(sum(ln(1 + r)), 5) as log_total, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0), 5) as sharpe, count(*) as days, any_value(k) as pairs from day cross join k""")
def distance_baseline(spark, sf):
    return BL.distance_baseline(P.bars_brand_week(spark, sf), "1996-12-31").select(F.round(F.ln(1 + F.col("total")), 5).alias("log_total"), R("sharpe", 5), "days", "pairs")


@query()
def random_control(spark, sf):
    return BL.random_control(P.bars_brand_week(spark, sf), "1996-12-31", pairs=10)


@query(f"""with {TRADES}, c as (select distinct pair from trades), x as (select a.pair as a, b.pair as b from c a cross join c b),
m as (select x.a, x.b, corr(p.r, q.r) as r from x join (select pair, d, avg(net_pnl_pct) as r from trades group by 1, 2) p on p.pair = x.a join (select pair, d, avg(net_pnl_pct) as r from trades group by 1, 2) q on q.pair = x.b and q.d = p.d group by 1, 2)
select x.a, x.b, cast(x.a = x.b as int) as placeholder, case when abs(m.r) > 0.999999 then round(m.r, 1) else round(m.r, 4) end as correlation from x left join m on m.a = x.a and m.b = x.b""")
def pair_correlation_matrix(spark, sf):
    """The identity that the reference's report holds, beside the real correlation of pairs' daily results."""
    t = P.trades(spark, sf).groupBy("pair", "d").agg(F.avg("net_pnl_pct").alias("r"))
    names = P.trades(spark, sf).select("pair").distinct()
    a, b = t.select(F.col("pair").alias("a"), "d", F.col("r").alias("x")), t.select(F.col("pair").alias("b"), "d", F.col("r").alias("y"))
    m = a.join(b, "d").groupBy("a", "b").agg(F.corr("x", "y").alias("c"))
    grid = names.select(F.col("pair").alias("a")).crossJoin(names.select(F.col("pair").alias("b")))  # the result has a row a cell; names are broadcast only below the session's threshold
    return grid.join(m, ["a", "b"], "left").select("a", "b", (F.col("a") == F.col("b")).cast("int").alias("placeholder"), F.when(F.abs("c") > 0.999999, F.round("c", 1)).otherwise(F.round("c", 4)).alias("correlation"))


@query("""with s as (select p_brand as s1, p_type as s2, p_size as k, count(*) as bars from part group by 1, 2, 3) select s1, s2, arg_min(k, (-bars, k)) as resel_date, max(bars) as bars from s group by 1, 2""")
def longest_windows(spark, sf):
    from pairloom.plans.system import longest_windows as pick

    s = P.table(spark, sf, "part").groupBy(F.col("p_brand").alias("s1"), F.col("p_type").alias("s2"), F.col("p_size").alias("resel_date")).agg(F.count("*").alias("bars"))
    return pick(s)


def _turned(of, name, values, digits):
    """SQL of rows of `of`, a row a profile, turned to a row a value and a column a profile."""
    wide = lambda v: ", ".join(f"round({v} filter (profile = '{p[0]}'), {digits}) as {p[0]}" for p in C.PROFILES)
    return " union all ".join(f"select '{k}' as {name}, {wide(v)} from {of}" for k, v in values.items())


@query(f"with {TRADES}, {_PROF}, z as (select profile, " + ", ".join(f"{v} as {k}_cost" for k, v in _parts("1e6").items()) + " from trades cross join prof) " + _turned("z", "part", {k: f"sum({k}_cost)" for k in _parts("1e6")}, 0))
def fund_cost_table(spark, sf):
    """The transposed cost table of the fund report: components as rows, profiles as columns."""
    t = P.trades(spark, sf).select("short_sym", "holding_days", F.lit(1e6).alias("value")).crossJoin(F.broadcast(C.profiles(spark)))  # five rows
    parts = ["commission", "bid_ask", "impact", "borrow", "financing"]
    x = C.profile_costs(t).groupBy("profile").agg(*[F.sum(f"{k}_cost").alias(k) for k in parts])
    return RP.by_profile(x, parts, "part").select("part", *[R(p[0], 0) for p in C.PROFILES])


_METRICS = {
    "total_return_pct": "total * 100", "gross_return_pct": "total * 100 + cost / 1e6", "annualised_return_pct": "annualised * 100", "sharpe": "sharpe", "max_drawdown_pct": "max_drawdown * 100", "win_rate_pct": "win_rate * 100",
    "profit_factor": "profit_factor", "trades": "trades::double", "cost_pct": "cost / 1e6", "commission_bps": "commission_bps", "bid_ask_bps": "bid_ask_bps", "impact_cap_bps": "impact_cap",
    "borrow_easy_pct": "easy * 100", "financing_pct": "financing * 100", "base_position_pct": "base * 100", "stopped": "stopped::int::double",
}


@query(f"with replay as (with {_REPLAY}), {_PROF}, r as (select * from replay join prof using (profile)) " + _turned("r", "metric", {k: f"max({v})" for k, v in _METRICS.items()}, 3))
def fund_metric_table(spark, sf):
    """The transposed metrics of the fund report: metrics as rows, profiles as columns."""
    return RP.fund_metrics(fund_replay(spark, sf)).select("metric", *[R(p[0], 3) for p in C.PROFILES])


@query(f"with {_REPLAY[: _REPLAY.index('select profile, trades')]} select dd.profile, d, round(v * 100, 4) as value, round(dd, 6) as drawdown from dd join stp using (profile) where stop is null or d <= stop")
def fund_curves(spark, sf):
    """Equity in millions by exit date of each profile, up to its stop."""
    t = P.trades(spark, sf).withColumn("spread_return", F.col("net_pnl_pct"))
    return RP.fund_curves(t).select("profile", "d", F.round(F.col("value") / 1e6, 4).alias("value"), R("drawdown"))


@query(f"""with {DAILY}, m as (select min(pnl) as lo, (max(pnl) - min(pnl)) / 20 as width, count(*) as n, avg(pnl) as mean, stddev_pop(pnl) as sd from daily),
b as (select least(19, cast(floor((pnl - lo) / width) as int)) as bin, count(*) as days from daily cross join m group by 1)
select bin, round(lo + bin * width, 8) as low, days, round(days / (n * width), 4) as density, round(mean, 8) as mean, round(sd, 8) as sd from b cross join m""")
def return_histogram(spark, sf):
    return RP.return_histogram(P.daily(spark, sf)).select("bin", R("low", 8), "days", R("density", 4), R("mean", 8), R("sd", 8))


@query()
def system_report(spark, sf):
    """The whole run on weekly brand bars: its one-row tables as section, measure, value."""
    from pairloom.plans.pair_queries import WEEKLY
    from pairloom.plans.system import measures, run_system

    got = run_system(P.bars_brand_week(spark, sf), P.macro_day(spark, sf), _sectors(spark, sf).select("sym", "d", "close"), "1998-06-30", config=WEEKLY, train=104, test=26, tests=False)
    out = measures("run", got["run"])
    for name in ("walk_forward", "fdr", "baseline"):
        out = out.unionByName(measures(name, got[name]))
    return out


# risk and size ------------------------------------------------------------------------------------------------------

_SIZES = TRADES + """, sized as (select trade_id, strength, zscore, 0.45::double + (trade_id * 7) % 50 / 100.0::double as quality, (trade_id * 11) % 40 / 100.0::double as volatility, (trade_id * 13) % 30 / 100.0::double as exposure, (trade_id * 3) % 4 * 600000.0::double as volume, (trade_id * 5) % 6 / 5.0::double as won, (trade_id * 23) % 12 as outcomes from trades),
f as (select *, greatest(0.03, least(0.1, 0.04::double * least(0.7 + 0.6 * strength, 2) * least(0.8 + 0.4 * quality, 1.5) * case when outcomes > 5 and won < 0.3 then 0.7 when outcomes > 5 and won > 0.7 then 1.3 else 1 end * case when volatility > 0.08 then 0.8 else 1 end)) * least(abs(zscore) / 2.3, 2) as size from sized)"""


def _sized(spark, sf):
    k = F.col("trade_id")
    part = lambda m, n: F.pmod(k * m, F.lit(n))
    t = P.trades(spark, sf).select("trade_id", "strength", "zscore", (0.45 + part(7, 50) / F.lit(100.0)).alias("quality"), (part(11, 40) / F.lit(100.0)).alias("volatility"), (part(13, 30) / F.lit(100.0)).alias("exposure"), (part(3, 4) * 600000.0).alias("volume"), (part(5, 6) / F.lit(5.0)).alias("won"), part(23, 12).alias("outcomes"))
    return t.withColumn("size", RK.size_fraction(F.col("strength"), F.col("quality"), F.col("zscore"), F.col("volatility"), by_form=RK.form(F.col("won"), F.col("outcomes"))))


@query(f"with {_SIZES} select trade_id, round(size, 8) as size from f")
def position_sizes(spark, sf):
    return _sized(spark, sf).select("trade_id", R("size", 8))


@query(f"""with {_SIZES} select trade_id, case when zscore < 1.5 and zscore > -1.5 then 'zscore' when quality < 0.55 then 'quality' when size > 0.1 then 'size' when volatility > 0.3 then 'volatility' when exposure + size > 0.3 then 'exposure' when volume < 1000000 then 'volume' else 'pass' end as verdict from f""")
def signal_verdicts(spark, sf):
    c = F.col
    return _sized(spark, sf).select("trade_id", RK.verdict(c("strength"), c("zscore"), c("quality"), c("size"), c("exposure"), c("volatility"), c("volume")).alias("verdict"))


@query(f"""with {DAILY}, v as (select d, pnl, exp(sum(ln(1 + pnl)) over (order by d {UP})) as value, count(*) over (order by d rows between unbounded preceding and 1 preceding) as seen, stddev_pop(pnl) over (order by d rows between 20 preceding and 1 preceding) * sqrt(252) / 0.02 as ratio from daily),
u as (select *, 1 - value / greatest(1, max(value) over (order by d {UP})) as drawdown, coalesce(lag(value) over (order by d), 1) - 1 as gain, coalesce(lag(pnl) over (order by d), 0) as eve from v)
select d, pnl, round(value, 6) as value, round(drawdown, 6) as drawdown, round(least(case when seen < 10 or ratio <= 1 then 1 when ratio > 1.5 then 0.5 else 1.5 - ratio / 2 end, case when gain < 0.4 then 1 when gain >= 0.6 then 0.5 else 2 - gain * 2.5 end), 6) as scale, eve < -0.03 as paused, drawdown >= 0.15 or pnl < -0.05 as stop from u""")
def risk_state(spark, sf):
    return RK.risk_state(P.daily(spark, sf)).select("d", "pnl", R("value"), R("drawdown"), R("scale"), "paused", "stop")


# simulation ---------------------------------------------------------------------------------------------------------

_SIM = EngineConfig(min_quality=0.3, min_strength=0.3, stop_share=0.9)


def _candidates(spark, sf):
    pairs = OP.align(P.bars_brand_week(spark, sf))
    life = OP.half_life(pairs)
    stats = life.withColumn("score", 0.4 + 0.5 / (1 + F.col("half_life")))
    return SM.candidates(SP.kalman_spread(pairs), stats, _SIM)


def _days(spark, sf):
    d = P.bars_brand_week(spark, sf).select("d").distinct()
    reg = _regime(spark, sf).select("d", "scale")
    return RG.as_of(d.withColumn("sym", F.lit("")), reg, "scale").select("d", F.coalesce("scale", F.lit(1.0)).alias("scale"))


@query()
def candidate_table(spark, sf):
    return _candidates(spark, sf)


@query()
def portfolio_fold(spark, sf):
    return SM.simulate(_candidates(spark, sf), _days(spark, sf), config=_SIM)


@query()
def walk_forward(spark, sf):
    days = _days(spark, sf)
    return SM.simulate(_candidates(spark, sf), days, RP.walk_windows(days, 104, 52), result="daily", config=_SIM)


# scorer -------------------------------------------------------------------------------------------------------------

@query(f"""with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders) select o_orderkey, round((o_totalprice - b) / coalesce(nullif(c - a, 0), 1), 6) as x from orders cross join q""")
def robust_scale(spark, sf):
    o = P.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    return SC.robust_scale(o, ["x"]).select("o_orderkey", R("x"))


@query(f"""with {TRADES}, z as (select trade_id, pair, d, net_pnl_pct as gain, case when action = 'LONG' then -zscore else zscore end as z from trades), a as (select *, case when z > 2 and least(abs(z) / 2.5, 1) > 0.65::double then 2 when z < -2 and least(abs(z) / 2.5, 1) > 0.65::double then 0 else 1 end as act from z),
c as (select *, count(*) over w as acts, count(*) filter (act = 1) over w as waits from a window w as (partition by pair order by d, trade_id {UP})),
r as (select *, case act when 0 then case when gain > 0 then gain * 10000 + 200 else gain * 2500 end when 2 then case when gain < 0 then -gain * 10000 + 200 else -gain * 2500 end else case when abs(z) > 1.75 then -50 else -5 end end as direction,
 case when abs(z) <= 1.75 then 0 when (z > 1.75 and act = 2 and gain < 0) or (z < -1.75 and act = 0 and gain > 0) then 200 when act <> 1 then 20 else 0 end as bonus,
 case when acts <= 20 then 0 when (acts - waits) / acts > 0.15 and (acts - waits) / acts < 0.5 then 100 when (acts - waits) / acts > 0.05 then 50 when waits / acts > 0.85 then -100 else 0 end as steady from c)
select trade_id, act, round(greatest(-500, least(500, direction + bonus + steady)), 4) as reward from r""")
def signal_rewards(spark, sf):
    from pyspark.sql import Window as W

    t = P.trades(spark, sf).select("trade_id", "pair", "d", F.col("net_pnl_pct").alias("gain"), F.when(F.col("action") == "LONG", -F.col("zscore")).otherwise(F.col("zscore")).alias("z"))
    w = W.partitionBy("pair").orderBy("d", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("act", SC.action(F.col("z"))).withColumn("acts", F.count("*").over(w)).withColumn("waits", F.count_if(F.col("act") == 1).over(w))
    return t.select("trade_id", "act", F.round(SC.reward(*map(F.col, ("act", "gain", "z", "acts", "waits"))), 4).alias("reward"))


@query("""with p as (select distinct p_brand as s1, p_type as s2 from part), k as (select p_brand as s1, p_type as s2, round(avg(p_size) / 100, 6) as correlation, nullif(max(p_size), 49)::double as half_life, nullif(min(p_size), 26) / 1000.0::double as cointegration_pvalue, count(*) / 10.0::double as quality_score from part where p_size > 25 group by 1, 2)
select s1, s2, coalesce(correlation, 0.5::double) as correlation, coalesce(half_life, 30::double) as half_life, coalesce(cointegration_pvalue, 0.05::double) as cointegration_pvalue, coalesce(quality_score, 0.8::double) as quality_score from p left join k using (s1, s2)""")
def pair_stat_defaults(spark, sf):
    part = P.table(spark, sf, "part").select(F.col("p_brand").alias("s1"), F.col("p_type").alias("s2"), "p_size")
    known = part.where("p_size > 25").groupBy("s1", "s2").agg(F.round(F.avg("p_size") / 100, 6).alias("correlation"), F.nullif(F.max("p_size"), F.lit(49)).cast("double").alias("half_life"), (F.nullif(F.min("p_size"), F.lit(26)) / F.lit(1000.0)).alias("cointegration_pvalue"), (F.count("*") / F.lit(10.0)).alias("quality_score"))
    return SC.with_pair_stats(part.select("s1", "s2").distinct(), known)


@query()
def scorer_rank(spark, sf):
    s = _spread(spark, sf)
    f = SP.features(s).na.drop()
    labels = SP.outcomes(s, entry_z=1.0)
    rows = labels.join(f, ["s1", "s2", "d"])
    cols = ["mean_5", "mean_10", "std_10", "from_ma_5", "mom_20"]
    rows = SC.robust_scale(rows, cols)
    return SC.rank_signals(rows, rows, cols).select("s1", "s2", "d", "z", "label", "score")


# extension ----------------------------------------------------------------------------------------------------------

@query("select event_type as sym, date_trunc('hour', ts) as ts, max(value) as high, min(value) as low, round(avg(value), 6) as mean, count(*) as volume from events group by 1, 2")
def stream_bars(spark, sf):
    from pairloom.streaming.bars import windowed_bars

    return windowed_bars(P.table(spark, sf, "events")).withColumn("mean", F.round("mean", 6))


