"""The distance method, with its selection of pairs, and the random control."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import align_pairs, in_blocks, packed, pairs_of

PAIR = ("s1", "s2")


def based(bars: DataFrame, split: str) -> DataFrame:
    """sym, d, close: each series over its first close, which must lie in the formation period, up to `split`."""
    before = bars.where((F.col("d") <= F.lit(split).cast("date")) & F.col("close").isNotNull())
    base = before.groupBy("sym").agg(F.min_by("close", "d").alias("base"))
    return bars.join(base, "sym").select("sym", "d", (F.col("close") / F.col("base")).alias("close"))


def distance_pairs(bars: DataFrame, split: str, *, pairs: int = 20, most_symbols: int = 200, coverage: float = 0.9, least_sd: float = 0.005) -> DataFrame:
    """s1, s2, ssd: the pairs of least squared distance of normalised closes over the formation period, gaps filled forward, then back.

    Of the symbols with closes on more than `coverage` of its days the first most_symbols by name take part; pairs
    whose distance hardly varies, near duplicates, are left out.
    """
    form = bars.where((F.col("d") <= F.lit(split).cast("date")) & F.col("close").isNotNull()).select("sym", "d", "close")
    days = np.array([r.day for r in form.select(F.unix_date("d").alias("day")).distinct().orderBy("day").collect()], np.int64)  # a calendar
    wide = form.groupBy("sym").agg(F.count("*").alias("n")).where(F.col("n") > coverage * len(days)).orderBy("sym").limit(most_symbols)

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.full((len(days), len(pdf)), np.nan)
        for k, (at, v) in enumerate(zip(pdf["days"], pdf["close"], strict=True)):
            x[np.searchsorted(days, at), k] = np.asarray(v, float) / v[0]
        x = pd.DataFrame(x).ffill().bfill().to_numpy()
        sym, out = pdf["sym"].tolist(), []
        for a, b in pairs_of(pdf):
            gap = x[:, a] - x[:, b]
            if gap.std() >= least_sd:
                out.append((sym[a], sym[b], float(gap @ gap)))
        return pd.DataFrame(out, columns=["s1", "s2", "ssd"])

    return in_blocks(packed(form.join(wide, "sym", "left_semi")), cell, "s1 string, s2 string, ssd double").orderBy("ssd", *PAIR).limit(pairs)


def distance_baseline(bars: DataFrame, split: str, *, pairs: int = 20, **options: float) -> DataFrame:
    """The distance method on pairs selected up to `split` and traded after it: portfolio_stats of their equal-weight mean."""
    return portfolio_stats(distance_trades(align_pairs(based(bars, split), distance_pairs(bars, split, pairs=pairs)), split, **options))


def portfolio_stats(daily: DataFrame, *keys: str) -> DataFrame:
    """total, sharpe (sample deviation), days and pairs of the equal-weight mean of pairs' daily returns, by `keys`; a missing day counts as 0."""
    n = daily.select(*keys, *PAIR).distinct().groupBy(*keys).agg(F.count("*").alias("pairs"))
    sums = daily.groupBy(*keys, "d").agg(F.sum("pnl").alias("s"))
    x = (sums.join(n, list(keys)) if keys else sums.crossJoin(F.broadcast(n))).withColumn("r", F.col("s") / F.col("pairs"))  # one row without keys
    r, sd = F.col("r"), F.stddev_samp("r")
    sharpe = F.when(sd > 0, F.avg(r) / sd * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return x.groupBy(*keys).agg((F.exp(F.sum(F.ln(1 + r))) - 1).alias("total"), sharpe.alias("sharpe"), F.count("*").alias("days"), F.max("pairs").alias("pairs"))


def random_control(bars: DataFrame, split: str, *, pairs: int = 20, draws: int = 5, seed: int = 42) -> DataFrame:
    """One row: mean total and Sharpe of the same rule on random disjoint pairs, draws made, lowest and highest total.

    Only drawn pairs are aligned and folded. With fewer symbols than two a pair no draw is made and the rest is null.
    """
    paths = based(bars, split)
    symbols = [r.sym for r in paths.select("sym").distinct().orderBy("sym").collect()]  # one universe
    picked = random_pairs(symbols, pairs, draws, seed) if len(symbols) >= 2 * pairs else []
    drawn = bars.sparkSession.createDataFrame(picked, "draw int, s1 string, s2 string")
    daily = distance_trades(align_pairs(paths, drawn.select(*PAIR).distinct()), split).join(F.broadcast(drawn), list(PAIR))  # a pair a row
    each = portfolio_stats(daily, "draw")
    return each.agg(F.avg("total").alias("total"), F.avg("sharpe").alias("sharpe"), F.count("*").alias("draws"), F.min("total").alias("low"), F.max("total").alias("high"))


def distance_trades(paths: DataFrame, split: str, *, entry_z: float = 2.0, cost: float = 0.001, least: int = 30) -> DataFrame:
    """Daily returns of each pair (s1, s2, d, p1, p2 normalised) after `split`, by a three-state machine folded pair by pair.

    A day's return is booked before the position changes; each side costs half the round trip.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", kind="stable")
        before = (pdf["d"] <= pd.Timestamp(split).date()).to_numpy()
        s = (pdf["p1"] - pdf["p2"]).to_numpy(float)
        form = s[before]
        out = pdf.loc[~before, ["s1", "s2", "d"]].assign(pnl=0.0)
        if len(form) < least or form.std(ddof=1) <= 0 or not len(out):
            return out.head(0)
        mu, band = form.mean(), entry_z * form.std(ddof=1)
        r = (pdf["p1"].pct_change() - pdf["p2"].pct_change()).to_numpy(float)[~before]
        s, state, pnl = s[~before], 0, np.zeros(len(out))
        for t, x in enumerate(s.tolist()):
            if state and t:
                pnl[t] = state * r[t]
            if not state:
                state = -1 if x > mu + band else 1 if x < mu - band else 0
                pnl[t] -= cost / 2 if state else 0
            elif (state > 0 and x >= mu) or (state < 0 and x <= mu):
                pnl[t] -= cost / 2
                state = 0
        pnl[-1] -= cost / 2 if state else 0
        return out.assign(pnl=pnl)

    return paths.select(*PAIR, "d", "p1", "p2").groupBy(*PAIR).applyInPandas(fold, "s1 string, s2 string, d date, pnl double")


def portfolio(daily: DataFrame) -> DataFrame:
    """Equal-weight daily mean over all pairs, a missing day counting as 0."""
    n = daily.select(*PAIR).distinct().agg(F.count("*").alias("n"))
    return daily.groupBy("d").agg(F.sum("pnl").alias("s")).crossJoin(F.broadcast(n)).select("d", (F.col("s") / F.col("n")).alias("pnl"))  # one row


def random_pairs(symbols: list[str], pairs: int, draws: int = 5, seed: int = 42) -> list[tuple[int, str, str]]:
    """(draw, s1, s2): disjoint pairs of each draw."""
    rng, out = random.Random(seed), []
    for draw in range(draws):
        picked = rng.sample(symbols, min(2 * pairs, len(symbols) // 2 * 2))
        out += [(draw, *sorted(picked[i : i + 2])) for i in range(0, len(picked), 2)]
    return out
