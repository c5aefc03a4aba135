"""Pair discovery: joins of symbols, screens, scores, selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.config import CONFIG, EngineConfig
from pairloom.functions import numeric

from .cleaning import fallback_symbols, quality_symbols

PAIR = ("s1", "s2")


def align(bars: DataFrame) -> DataFrame:
    """s1, s2, d, p1, p2: every unordered pair on its common dates. The equi-join on dates keeps it off nested loops."""
    a = bars.select(F.col("sym").alias("s1"), "d", F.col("close").alias("p1"))
    b = bars.select(F.col("sym").alias("s2"), "d", F.col("close").alias("p2"))
    return a.join(b, "d").where("s1 < s2").select("s1", "s2", "d", "p1", "p2")


def log_spread(pairs: DataFrame) -> DataFrame:
    """The spread at a hedge ratio of one."""
    return pairs.withColumn("s", F.ln(F.col("p1") + 1e-8) - F.ln(F.col("p2") + 1e-8))


def clean_correlation(pairs: DataFrame, least: int = CONFIG.min_common) -> DataFrame:
    """Correlation of returns without outliers beyond four deviations; 0 where too little is left."""
    w = W.partitionBy(*PAIR).orderBy("d")
    r = lambda p: F.try_divide(F.col(p), F.lag(p).over(w)) - 1
    x = pairs.withColumn("r1", r("p1")).withColumn("r2", r("p2")).where("r1 is not null and r2 is not null")
    every = W.partitionBy(*PAIR)
    z = lambda c: F.abs((F.col(c) - F.avg(c).over(every)) / F.nullif(F.stddev_pop(c).over(every), F.lit(0.0)))
    x = x.withColumn("ok", (z("r1") < 4) & (z("r2") < 4))
    g = x.groupBy(*PAIR).agg(F.count("*").alias("n"), F.count_if("ok").alias("kept"), F.corr(F.when(F.col("ok"), F.col("r1")), F.when(F.col("ok"), F.col("r2"))).alias("c"), F.corr("r1", "r2").alias("raw"))
    use = F.when((F.col("kept") >= 0.6 * F.col("n")) & (F.col("kept") >= 100), F.col("c")).otherwise(F.col("raw"))
    return g.select(*PAIR, "n", F.when(F.col("n") >= least, F.coalesce(use, F.lit(0.0))).otherwise(0.0).alias("correlation"))


def half_life(pairs: DataFrame) -> DataFrame:
    w = W.partitionBy(*PAIR).orderBy("d")
    x = log_spread(pairs).withColumn("before", F.lag("s").over(w))
    g = x.groupBy(*PAIR).agg(F.count("*").alias("n"), F.regr_slope("s", "before").alias("b"))
    life = F.when((F.col("n") >= 50) & (F.col("b") > 0) & (F.col("b") < 1), F.least(F.lit(999.0), F.greatest(F.lit(1.0), -F.lit(float(np.log(2))) / F.ln("b")))).otherwise(999.0)
    return g.select(*PAIR, life.alias("half_life"))


def align_pairs(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """align() of the given pairs (s1, s2) alone: two equi-joins, rows in proportion to the pairs."""
    a = bars.select(F.col("sym").alias("s1"), "d", F.col("close").alias("p1"))
    b = bars.select(F.col("sym").alias("s2"), "d", F.col("close").alias("p2"))
    return pairs.select(*PAIR).join(a, "s1").join(b, ["s2", "d"]).select(*PAIR, "d", "p1", "p2")


def packed(bars: DataFrame) -> DataFrame:
    """One row a symbol: sym, days (numbers of days, ascending) and close beside them."""
    a = F.array_sort(F.collect_list(F.struct(F.unix_date("d").alias("day"), "close")))  # a number a day
    return bars.groupBy("sym").agg(a.alias("a")).select("sym", F.col("a.day").alias("days"), F.col("a.close").alias("close"))


def beside(pairs: DataFrame, series: DataFrame) -> DataFrame:
    """pairs with the arrays of both symbols: days1, p1, days2, p2."""
    of = lambda k: series.select(F.col("sym").alias(f"s{k}"), F.col("days").alias(f"days{k}"), F.col("close").alias(f"p{k}"))
    return pairs.join(of(1), "s1").join(of(2), "s2")


def common(days1: np.ndarray, p1: np.ndarray, days2: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The days of both series and the two closes on them, nulls as NaN."""
    days, i, j = np.intersect1d(days1, days2, assume_unique=True, return_indices=True)
    return days, np.asarray(p1, float)[i], np.asarray(p2, float)[j]


def in_blocks(series: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, block: int = 64, least: int = 8) -> DataFrame:
    """Runs `run` on the rows of two blocks of symbols at a time, so that every pair meets in one call.

    Rows of `series` have `sym` and arrays. Blocks meet by an equi-join on their numbers, so a symbol's row is sent
    symbols / block times and no join is a nested loop. In a call a pair counts where `pairs_of` yields it.
    """
    n = series.count()
    nb = max(-(-n // block), min(n, least), 1)
    b = F.pmod(F.xxhash64("sym"), F.lit(nb))
    cells = series.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    cells = cells.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o")
    return cells.groupBy("i", "j").applyInPandas(run, schema)


def pairs_of(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Positions of the pairs of a cell, the smaller symbol first."""
    sym, b = pdf["sym"].tolist(), pdf["b"].tolist()
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    for x in range(len(sym)):
        for y in range(len(sym)):
            if sym[x] < sym[y] and (one or b[x] != b[y]):
                yield x, y


def cointegration(bars: DataFrame, pairs: DataFrame, least: int = CONFIG.min_common) -> DataFrame:
    """s1, s2, p_value: Engle-Granger on the common days of each of the given pairs."""
    return beside(pairs.select(*PAIR), packed(bars)).select(*PAIR, _p_value(least)("days1", "p1", "days2", "p2").alias("p_value"))


def _p_value(least: int) -> Callable[..., Column]:
    @F.pandas_udf("double")
    def p(days1: pd.Series, p1: pd.Series, days2: pd.Series, p2: pd.Series) -> pd.Series:
        return pd.Series([numeric.cointegration_p(*common(*x)[1:], least) for x in zip(days1, p1, days2, p2, strict=True)], dtype=float)

    return p


SCREENED = "s1 string, s2 string, common long, complete boolean, correlation double, p_value double, half_life double"


def screen(bars: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Every pair that has enough common days and correlation, with its p-value and half-life, cheap screens first.

    complete: whether the pair has more than 300 common days and closes on over 95 % of them.
    """

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        days, close, sym = pdf["days"].tolist(), pdf["close"].tolist(), pdf["sym"].tolist()
        for x, y in pairs_of(pdf):
            at, a, b = common(days[x], close[x], days[y], close[y])
            if len(at) < config.min_common:
                continue
            c = numeric.clean_correlation(a, b, config.min_common)
            if abs(c) < config.min_correlation:
                continue
            p = numeric.cointegration_p(a, b, config.min_common)
            life = numeric.half_life(a, b) if p < config.coint_p else None
            complete = len(at) > 300 and min(np.isfinite(a).mean(), np.isfinite(b).mean()) > 0.95
            out.append((sym[x], sym[y], len(at), bool(complete), c, p, life))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCREENED.split(", ")])

    return in_blocks(packed(bars), cell, SCREENED)


def quality_score(correlation: Column, p: Column, life: Column, complete: Column, residual: Column, threshold: float = 0.05) -> Column:
    terms = F.least(F.lit(0.3), F.abs(correlation) * 0.6) + (threshold - p) / threshold * 0.3
    terms += F.when(life.between(4, 25), 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(life - 10) / 15)).otherwise(0.0)
    return F.least(F.lit(1.0), terms + F.when(complete, 0.2).otherwise(0.0) + F.when(residual, 0.15).otherwise(0.0))


def factor_arrays(bars: DataFrame, factors: int = CONFIG.factors, most_days: int = 4096) -> DataFrame:
    """sym, days, close: prices rebuilt from returns less their first principal components (means stay in), 0 where a return is missing.

    The factors come from the days by days matrix of products of returns, whose size the calendar bounds (most_days),
    however many symbols there are: tasks add up their symbols' share, row block by row block, and only its
    eigenvectors go back to the tasks.
    """
    w = W.partitionBy("sym").orderBy("d")
    r = bars.select("sym", "d", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("close")).where("close is not null")
    series = packed(r)
    spark = bars.sparkSession
    days = np.array([x.day for x in r.select(F.unix_date("d").alias("day")).distinct().orderBy("day").collect()], np.int64)  # a calendar
    symbols, n = series.count(), len(days)
    if symbols < max(factors + 2, 10) or n < 100:
        return series.limit(0)
    if n > most_days:
        raise ValueError(f"{n} days: more than most_days, {most_days}; fit on fewer days")
    step = -(-n // 32)

    def laid(pdf: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(pdf), n))
        for i, (at, v) in enumerate(zip(pdf["days"], pdf["close"], strict=True)):
            x[i, np.searchsorted(days, at)] = v
        return x

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((n, n))
        for pdf in frames:
            x = laid(pdf)
            x -= x.mean(axis=1, keepdims=True)
            gram += x.T @ x
        yield pd.DataFrame([(lo, gram[lo : lo + step].tobytes()) for lo in range(0, n, step)], columns=["lo", "rows"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, float) for x in pdf["rows"])
        return pd.DataFrame({"lo": pdf["lo"].iloc[:1], "rows": [total.tobytes()]})

    spread = series.repartition(min(64, -(-symbols // 64)))
    blocks = spread.mapInPandas(products, "lo int, rows binary").groupBy("lo").applyInPandas(added, "lo int, rows binary").orderBy("lo").collect()  # n * n numbers
    gram = np.concatenate([np.frombuffer(x.rows, float) for x in blocks]).reshape(n, n)
    times = np.linalg.eigh(gram)[1][:, ::-1][:, :factors]

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = laid(pdf)
            e = x - (x - x.mean(axis=1, keepdims=True)) @ times @ times.T
            yield pd.DataFrame({"sym": pdf["sym"], "days": [days] * len(pdf), "close": list(np.exp(np.cumsum(e, axis=1)))})

    return series.mapInPandas(rest, "sym string, days array<int>, close array<double>")


def factor_residuals(bars: DataFrame, factors: int = CONFIG.factors) -> DataFrame:
    """factor_arrays() as rows: sym, d, close."""
    x = factor_arrays(bars, factors).select("sym", F.explode(F.arrays_zip("days", "close")).alias("x"))
    return x.select("sym", F.date_from_unix_date("x.days").alias("d"), "x.close")


def universe(bars: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Symbols of good quality, or the most complete ones where fewer than least_universe are."""
    good = quality_symbols(bars, least_rows=config.least_rows, least_volume=config.least_volume, least_close=config.least_close).select("sym")
    if good.limit(config.least_universe).count() >= config.least_universe:
        return good
    return fallback_symbols(bars, least_rows=config.fallback_rows, top=config.fallback_top).select("sym")


def select_pairs(bars: DataFrame, config: EngineConfig = CONFIG, *, screened: DataFrame | None = None) -> DataFrame:
    """Universe, then screens of all its pairs, residual cointegration of those that pass, score. screened: screen() of the same bars."""
    if screened is None:
        bars = bars.join(universe(bars, config), "sym", "left_semi")
        screened = screen(bars, config)
    passed = screened.where((F.col("p_value") < config.coint_p) & F.col("half_life").between(config.half_life_low, config.half_life_high))
    rest = beside(passed.select(*PAIR), factor_arrays(bars, config.factors)).select(*PAIR, (_p_value(config.min_common)("days1", "p1", "days2", "p2") < config.coint_p).alias("residual"))
    both = passed.join(rest, list(PAIR), "left").withColumn("residual", F.coalesce("residual", F.lit(False)))
    score = quality_score(F.col("correlation"), F.col("p_value"), F.col("half_life"), F.col("complete"), F.col("residual"), config.coint_p)
    return both.withColumn("score", score).where(F.col("score") > config.min_score).orderBy(F.desc("score"), *PAIR)


def benjamini_hochberg(tests: DataFrame, q: float, p: str = "p_value") -> DataFrame:
    """Counts: tested, p under 5 %, expected by chance, surviving at rate q.

    Ranks are running counts of distinct p-values, by bins of p first and then within a bin, so no task sees all tests.
    """
    v = F.col("p")
    counted = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.count("*").alias("c"))
    bin_ = F.when(v >= 1 / 4096, F.floor(v * 4096)).otherwise(-F.least(F.lit(1100), F.floor(-F.log2(F.greatest(v, F.lit(1e-320))))))
    counted = counted.withColumn("bin", bin_.cast("int"))
    bins = counted.groupBy("bin").agg(F.sum("c").alias("c"))  # at most some five thousand
    ahead = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"), F.sum("c").over(W.partitionBy()).alias("m"))
    inside = W.partitionBy("bin").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    t = counted.withColumn("k", F.sum("c").over(inside)).join(F.broadcast(bins), "bin").withColumn("k", F.col("k") + F.col("ahead"))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return t.agg(count(F.sum("c")).alias("tested"), count(F.sum(F.when(v < 0.05, F.col("c")))).alias("raw"), (count(F.sum("c")) * 0.05).alias("by_chance"), count(F.max(F.when(v <= F.col("k") * q / F.col("m"), F.col("k")))).alias("survive"))


def fdr(screened: DataFrame, selected: DataFrame) -> DataFrame:
    """The diagnostic of a selection: tests of the pairs that passed the correlation screen, what survives at 5 and 10 %, pairs selected."""
    at = {q: benjamini_hochberg(screened, q) for q in (0.05, 0.10)}
    n = selected.agg(F.count("*").alias("selected"))
    one = at[0.05].withColumnRenamed("survive", "survive_05").crossJoin(at[0.10].select(F.col("survive").alias("survive_10")))  # a row each
    return one.crossJoin(n)


def pair_schedule(bars: DataFrame, pool: DataFrame, *, every: int = 90, window_days: int = 730, short_days: int = 126, least: int = 100, least_short: int = 60, p_most: float = 0.15, p_gap: float = 0.10, threshold: float = 0.05) -> DataFrame:
    """resel_date, s1, s2: the pool's pairs that still pass on each re-selection date, tested in parallel over pairs."""
    days = bars.select("d").distinct().withColumn("i", F.row_number().over(W.orderBy("d")) - 1).where(F.col("i") % every == 0)  # a calendar
    dates = days.agg(F.array_sort(F.collect_list(F.unix_date("d"))).alias("dates"))  # a date in ninety

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                at, x, y = common(r.days1, r.p1, r.days2, r.p2)
                for t in r.dates:
                    on = (at >= t - window_days) & (at <= t)
                    if not on.any():
                        continue
                    p = numeric.cointegration_p(x[on], y[on], least)
                    late = on & (at >= t - short_days)
                    ok = p < threshold
                    if ok and late.sum() >= least_short:
                        short = numeric.cointegration_p(x[late], y[late], 2)
                        ok = short <= p_most and abs(short - p) <= p_gap
                    if ok:
                        out.append((int(t), r.s1, r.s2))
            yield pd.DataFrame(out, columns=["t", "s1", "s2"])

    pairs = beside(pool.select(*PAIR), packed(bars)).crossJoin(F.broadcast(dates))  # one row
    return pairs.mapInPandas(run, "t int, s1 string, s2 string").select(F.date_from_unix_date("t").alias("resel_date"), *PAIR)
