"""Queries over pairs of series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.config import EngineConfig
from pairloom.functions.sqltext import BARS, MACRO, PAIRS, SPREAD
from pairloom.operators import pairs as OP
from pairloom.operators import spread as SP
from pairloom.registry import query
from pairloom.sources import panels as P

R = lambda c, n=6: F.round(c, n).alias(c)
PP = "over (partition by s1, s2 order by d)"


def run(lo, hi="current row"):
    return f"over (partition by s1, s2 order by d rows between {lo} and {hi})"


#: Weekly panels are shorter than the daily histories that the defaults ask for.
WEEKLY = EngineConfig(min_common=250, min_correlation=0.0, coint_p=0.05, half_life_low=0.0, half_life_high=60.0, min_score=0.1)


def _pairs(spark, sf):
    return OP.align(P.bars_brand_week(spark, sf))


def _spread(spark, sf):
    return OP.log_spread(_pairs(spark, sf))


@query(f"with {PAIRS} select s1, s2, d, p1, p2 from joined")
def align_inner(spark, sf):
    return _pairs(spark, sf)


@query(f"with {BARS} select a.sym as s1, b.sym as s2 from (select distinct sym from bars) a join (select distinct sym from bars) b on a.sym < b.sym")
def all_pairs(spark, sf):
    s = P.table(spark, sf, "part").select(F.col("p_brand").alias("sym")).distinct()
    return s.select(F.col("sym").alias("s1")).join(s.select(F.col("sym").alias("s2")), F.col("s1") < F.col("s2"))


_Z = SPREAD + f", zz as (select s1, s2, d, s, (s - avg(s) {run('unbounded preceding')}) / (stddev_samp(s) {run('unbounded preceding')} + 1e-8) as z from spread)"


@query(f"with {_Z} select s1, s2, d, round(z, 5) as z from zz where abs(z) >= 1.8")
def spread_signals(spark, sf):
    return SP.expanding_z(_spread(spark, sf)).where("abs(z) >= 1.8").select("s1", "s2", "d", R("z", 5))


@query(f"with {_Z} select s1, s2, d, round(z, 5) as z from zz")
def zscore_expanding(spark, sf):
    return SP.expanding_z(_spread(spark, sf)).select("s1", "s2", "d", R("z", 5))


@query(f"""with {SPREAD}, f as (select s1, s2, d, s, s - lag(s) {PP} as diff, coalesce(lag(s, 20) {PP}, first_value(s) {PP}) as back from spread)
select s1, s2, d, round(diff, 6) as diff, round(avg(diff) {run('4 preceding')}, 6) as mean_5, round(avg(diff) {run('9 preceding')}, 6) as mean_10, round(stddev_samp(diff) {run('9 preceding')}, 6) as std_10,
round((s - avg(s) {run('4 preceding')}) / (stddev_samp(s) {run('unbounded preceding')} + 1e-8), 5) as from_ma_5, round((s - back) / (stddev_samp(s) {run('unbounded preceding')} + 1e-8), 5) as mom_20
from f""")
def spread_features(spark, sf):
    return SP.features(_spread(spark, sf)).select("s1", "s2", "d", R("diff"), R("mean_5"), R("mean_10"), R("std_10"), R("from_ma_5", 5), R("mom_20", 5))


@query(f"""with {PAIRS}, r as (select s1, s2, d, p1 / lag(p1) {PP} - 1 as r1, p2 / lag(p2) {PP} - 1 as r2 from joined), c as (select * from r where r1 is not null and r2 is not null),
z as (select *, abs((r1 - avg(r1) over p) / nullif(stddev_pop(r1) over p, 0)) < 4 and abs((r2 - avg(r2) over p) / nullif(stddev_pop(r2) over p, 0)) < 4 as ok from c window p as (partition by s1, s2)),
g as (select s1, s2, count(*) as n, count(*) filter (ok) as kept, corr(r1, r2) filter (ok) as c, corr(r1, r2) as raw from z group by 1, 2)
select s1, s2, n, round(case when n >= 250 then case when kept >= 0.6 * n and kept >= 100 then c else raw end else 0 end, 6) as correlation from g""")
def pair_correlation_clean(spark, sf):
    return OP.clean_correlation(_pairs(spark, sf), 250).select("s1", "s2", "n", R("correlation"))


@query(f"""with {PAIRS}, r as (select s1, s2, d, ln(p1) - ln(lag(p1) {PP}) as r1, ln(p2) - ln(lag(p2) {PP}) as r2 from joined)
select s1, s2, d, round(case when count(r1) {run('19 preceding')} >= 15 then corr(r1, r2) {run('19 preceding')} end, 5) as corr from r""")
def rolling_corr_20(spark, sf):
    return SP.rolling_correlation(_pairs(spark, sf)).select("s1", "s2", "d", R("corr", 5))


_HL = SPREAD + f""", ar as (select s1, s2, s, lag(s) {PP} as b from spread), hl as (select s1, s2, case when count(*) >= 50 and regr_slope(s, b) > 0 and regr_slope(s, b) < 1
  then least(999, greatest(1, -ln(2) / ln(regr_slope(s, b)))) else 999 end as half_life from ar group by 1, 2)"""


@query(f"with {_HL} select s1, s2, round(half_life, 5) as half_life from hl")
def half_life_ar1(spark, sf):
    return OP.half_life(_pairs(spark, sf)).select("s1", "s2", R("half_life", 5))


@query(f"with {_HL} select s1, s2, cast(greatest(30, least(90, floor(3 * half_life))) as int) as window from hl")
def reference_window(spark, sf):
    return SP.reference_window(OP.half_life(_pairs(spark, sf))).select("s1", "s2", "window")


@query(f"""with {_HL}, c as (select s1, s2, count(*) as n from joined group by 1, 2) select s1, s2, round(least(1, least(0.3, 0.3 * 0.6) + (0.05 - 0.01) / 0.05 * 0.3
  + case when half_life between 4 and 25 then 0.2 * greatest(0, 1 - abs(half_life - 10) / 15) else 0 end + case when n > 300 then 0.2 else 0 end + case when n % 2 = 0 then 0.15 else 0 end), 6) as score from hl join c using (s1, s2)""")
def quality_score(spark, sf):
    pairs = _pairs(spark, sf)
    n = pairs.groupBy("s1", "s2").agg(F.count("*").alias("n"))
    score = OP.quality_score(F.lit(0.3), F.lit(0.01), F.col("half_life"), F.col("n") > 300, F.col("n") % 2 == 0)
    return OP.half_life(pairs).join(n, ["s1", "s2"]).select("s1", "s2", F.round(score, 6).alias("score"))


@query(f"""with {SPREAD}, r as (select s1, s2, d, s - lag(s) {PP} as r, count(*) over (partition by s1, s2) as n from spread), v as (select *, stddev_samp(r) over (partition by s1, s2) as sd, (r - avg(r) over (partition by s1, s2)) / nullif(stddev_samp(r) over (partition by s1, s2), 0) as v from r where r is not null),
c as (select *, sum(v - 0.5) {run('unbounded preceding')} as up, sum(-v - 0.5) {run('unbounded preceding')} as dn from v),
m as (select *, up - least(0, min(up) {run('unbounded preceding')}) as hi, dn - least(0, min(dn) {run('unbounded preceding')}) as lo from c)
select s1, s2, coalesce(any_value(n) >= 20 and any_value(sd) >= 1e-8 and greatest(max(hi), max(lo)) > 5, false) as break, round(max(hi), 5) as hi, round(max(lo), 5) as lo from m group by 1, 2""")
def cusum_break(spark, sf):
    return SP.cusum_break(_spread(spark, sf)).select("s1", "s2", "break", R("hi", 5), R("lo", 5))


@query(f"""with {SPREAD}, x as (select s1, s2, """ + ", ".join(f"s - lag(s, {k}) {PP} as d{k}" for k in (1, 2, 4, 8, 16)) + """ from spread),
g as (select s1, s2, count(*) as n, """ + ", ".join(f"var_pop(d{k}) as v{k}" for k in (1, 2, 4, 8, 16)) + """ from x group by 1, 2),
p as (""" + " union all ".join(f"select s1, s2, n, ln({k}) as k, ln(v{k}) as v from g where {k} < n // 2 and v{k} >= 1e-16" for k in (1, 2, 4, 8, 16)) + """)
select s1, s2, round(case when any_value(n) >= 20 and count(*) >= 3 then greatest(0, least(1, regr_slope(v, k) / 2)) else 0.5 end, 6) as hurst from p group by 1, 2""")
def hurst_exponent(spark, sf):
    return SP.hurst(_spread(spark, sf)).select("s1", "s2", R("hurst"))


_KALMAN = PAIRS + """, k0 as (select s1, s2, d, p1, ln(p1 + 1e-8) as y, ln(p2 + 1e-8) as x, row_number() over (partition by s1, s2 order by d) as i, count(*) over (partition by s1, s2) as n from joined),
q as (select s1, s2, 1e-5 / (1 - 1e-5) * var_pop(x) as q, regr_slope(y, x) filter (i <= 30) as b0 from k0 where n >= 100 group by 1, 2),
k as (select s1, s2, 0::bigint as i, null::date as d, b0 as b, 1.0::double as p, 0.0::double as s from q
  union all select s1, s2, i, d, b1 as b, (1 - g * x) * pp as p, y - b1 * x as s from (select *, b + g * (y - x * b) as b1 from (select k0.s1, k0.s2, k0.i, k0.d, k0.x, k0.y, k.b, k.p + q.q as pp, (k.p + q.q) * k0.x / (k0.x * k0.x * (k.p + q.q) + 0.001) as g
    from k join k0 on k0.s1 = k.s1 and k0.s2 = k.s2 and k0.i = k.i + 1 join q on q.s1 = k.s1 and q.s2 = k.s2)))"""


@query(f"with recursive {_KALMAN} select s1, s2, d, round(s, 6) as s from k where i > 0")
def kalman_spread(spark, sf):
    return SP.kalman_spread(_pairs(spark, sf)).select("s1", "s2", "d", R("s"))


@query(f"with recursive {_KALMAN} select k.s1, k.s2, k.d, round(case when abs(ln(j.p2)) > 1e-4 then (ln(j.p1) - k.s) / ln(j.p2) else 1 end, 6) as beta from k join joined j on j.s1 = k.s1 and j.s2 = k.s2 and j.d = k.d where k.i > 0")
def locked_beta(spark, sf):
    return SP.kalman_spread(_pairs(spark, sf)).select("s1", "s2", "d", R("beta"))


@query(f"""with {SPREAD}, x as (select *, row_number() {PP} - 1 as i, count(*) over (partition by s1, s2) as n, avg(s) {run('unbounded preceding')} as mu, stddev_samp(s) {run('unbounded preceding')} + 1e-8 as sd, list(s) {run('1 following', '10 following')} as nx from spread)
select s1, s2, d, round((s - mu) / sd, 5) as z, cast(len(list_filter(nx, lambda v: abs((v - mu) / sd) < 0.5)) > 0 as int) as label from x where i >= 60 and i % 2 = 0 and i < n - 10 and abs((s - mu) / sd) >= 1.8""")
def outcome_labels(spark, sf):
    return SP.outcomes(_spread(spark, sf)).select("s1", "s2", "d", R("z", 5), "label")


@query(f"""with {_Z}, x as (select *, row_number() {PP} as i from zz), e as (select s1, s2, d, i, z from x where abs(z) > 1.8)
select e.s1, e.s2, e.d as entry_d, round(e.z, 5) as z0, arg_min(x.d, x.i) as exit_d, min(x.i) - e.i - 1 as held from e join x on x.s1 = e.s1 and x.s2 = e.s2 and x.i between e.i + 2 and e.i + 26
where case when e.z < 0 then x.z > -0.5 or x.z - e.z > 1 else x.z < 0.5 or e.z - x.z > 1 end or x.i - e.i - 1 >= 25 group by e.s1, e.s2, e.d, e.z, e.i""")
def exit_search(spark, sf):
    return SP.exits(SP.expanding_z(_spread(spark, sf))).select("s1", "s2", "entry_d", R("z0", 5), "exit_d", F.col("held").cast("long").alias("held"))


#: Formation up to the end of 1996: wide enough symbols on all its days, gaps filled forward, then back, over the first close.
_FORM = BARS + """, fb as (select * from bars where d <= date '1996-12-31'), days as (select distinct d from fb),
wide as (select sym from fb group by 1 having count(*) > 0.9 * (select count(*) from days) order by sym limit 200),
grid as (select w.sym, c.d, b.close from wide w cross join days c left join fb b on b.sym = w.sym and b.d = c.d),
flat as (select sym, d, coalesce(last_value(close ignore nulls) over (partition by sym order by d rows between unbounded preceding and current row), first_value(close ignore nulls) over (partition by sym order by d rows between current row and unbounded following)) as p from grid),
norm as (select sym, d, p / first_value(p) over (partition by sym order by d) as p from flat),
ssd as (select a.sym as s1, b.sym as s2, sum((a.p - b.p) * (a.p - b.p)) as ssd from norm a join norm b on a.d = b.d and a.sym < b.sym group by 1, 2 having stddev_pop(a.p - b.p) >= 0.005),
picked as (select s1, s2, ssd from ssd order by ssd.ssd, s1, s2 limit 20)"""


def _paths(spark, sf):
    first = F.first("close", True).over(W.partitionBy("sym").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    return P.bars_brand_week(spark, sf).select("sym", "d", (F.col("close") / first).alias("close"))


@query(f"with {_FORM} select s1, s2, round(ssd, 5) as ssd from picked")
def distance_pairs(spark, sf):
    from pairloom.operators.baselines import distance_pairs as pick

    return pick(P.bars_brand_week(spark, sf), "1996-12-31").select("s1", "s2", R("ssd", 5))


@query("""with t as (select o_orderkey, ((o_orderkey * 7919) % 9973 + 1) / 9974.0::double * ((o_orderkey * 31) % 11 + 1) / 11.0::double as p from orders), k as (select p, row_number() over (order by p, o_orderkey) as k, count(*) over () as m from t)
select count(*) as tested, count(*) filter (p < 0.05) as raw, round(count(*) * 0.05::double, 4) as by_chance, coalesce(max(k) filter (p <= k * 0.1::double / m), 0) as survive from k""")
def bh_fdr(spark, sf):
    k = F.col("o_orderkey")
    t = P.table(spark, sf, "orders").select(((F.pmod(k * 7919, F.lit(9973)) + 1) / F.lit(9974.0) * (F.pmod(k * 31, F.lit(11)) + 1) / F.lit(11.0)).alias("p_value"))
    return OP.benjamini_hochberg(t, 0.1).select("tested", "raw", R("by_chance", 4), F.col("survive").cast("long").alias("survive"))


@query(f"""with {BARS}, {MACRO} select b.sym, b.d, m.vix, round(coalesce(m.vix - m28.vix, 0), 4) as change_28 from bars b asof left join macro m on b.d >= m.d asof left join macro m28 on b.d - interval 28 day >= m28.d""")
def asof_macro(spark, sf):
    from pairloom.operators.regime import as_of

    bars, macro = P.bars_brand_week(spark, sf), P.macro_day(spark, sf)
    now = as_of(bars.select("sym", "d"), macro, "vix")
    before = as_of(bars.select("sym", F.date_sub("d", 28).alias("d")), macro, "vix").select("sym", F.date_add("d", 28).alias("d"), F.col("vix").alias("vix_28"))
    return now.join(before, ["sym", "d"], "left").select("sym", "d", "vix", F.round(F.coalesce(F.col("vix") - F.col("vix_28"), F.lit(0.0)), 4).alias("change_28"))


@query(f"""with {BARS}, days as (select distinct d from bars), s as (select d as resel from (select d, row_number() over (order by d) - 1 as i from days) where i % 13 = 5)
select days.d, coalesce(s.resel, (select min(resel) from s)) as resel from days asof left join s on days.d >= s.resel""")
def asof_schedule(spark, sf):
    from pairloom.operators.regime import as_of

    days = P.bars_brand_week(spark, sf).select("d").distinct()
    s = days.withColumn("i", F.row_number().over(W.orderBy("d")) - 1).where("i % 13 = 5").select("d", F.col("d").alias("resel"))
    first = s.agg(F.min("resel").alias("first"))
    return as_of(days.withColumn("sym", F.lit("")), s, "resel").crossJoin(F.broadcast(first)).select("d", F.coalesce("resel", "first").alias("resel"))  # one row


def _all(spark, sf):
    return P.bars_brand_week(spark, sf), all_pairs(spark, sf)


@query()
def eg_cointegration(spark, sf):
    return OP.cointegration(*_all(spark, sf), 250)


@query()
def pca_residuals(spark, sf):
    return OP.factor_residuals(P.bars_brand_week(spark, sf))


@query()
def pair_screen(spark, sf):
    """Every pair of enough history, with correlation, p-value and half-life."""
    return OP.screen(P.bars_brand_week(spark, sf), WEEKLY)


@query()
def pair_selection(spark, sf):
    return OP.select_pairs(P.bars_brand_week(spark, sf), WEEKLY)


@query()
def selection_fdr(spark, sf):
    """How many of the screened pairs survive control of the false discovery rate, beside those selected."""
    bars = P.bars_brand_week(spark, sf)
    screened = OP.screen(bars.join(OP.universe(bars, WEEKLY), "sym", "left_semi"), WEEKLY)
    return OP.fdr(screened, OP.select_pairs(bars, WEEKLY, screened=screened))


@query()
def pair_schedule(spark, sf):
    bars, pool = _all(spark, sf)
    return OP.pair_schedule(bars, pool, every=52, window_days=1460, least=100, short_days=728)


@query()
def signal_features(spark, sf):
    """The 38 numbers of every pair and week, with brands' own indicators and regions as sectors."""
    from pairloom.operators import indicators as I
    from pairloom.operators.features import signal_features as made

    bars, pairs = P.bars_brand_week(spark, sf), _pairs(spark, sf)
    legs = I.rsi(bars).select("sym", "d", "rsi_14").join(I.momentum(bars).select("sym", "d", "momentum_5"), ["sym", "d"]).join(I.high_vol_regime(bars).select("sym", "d", F.col("high_vol_regime").alias("high_vol")), ["sym", "d"])
    stats = OP.half_life(pairs).join(OP.clean_correlation(pairs, 250).select("s1", "s2", "correlation"), ["s1", "s2"]).withColumn("score", 0.4 + 0.5 / (1 + F.col("half_life")))
    sectors = P.sector_week(spark, sf).groupBy("sector", "d").agg(F.avg("close").alias("close"))
    region = P.table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    names = bars.select("sym").distinct()
    sector_of = names.join(F.broadcast(region), F.pmod(F.crc32("sym"), F.lit(5)) == F.col("r_regionkey")).select("sym", "sector")  # five rows
    return made(_spread(spark, sf), legs, stats, P.macro_day(spark, sf), sectors, sector_of)
