"""Spread mathematics: Kalman hedge ratio, breaks, roughness, z-scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions import numeric

PAIR = ("s1", "s2")


def by_pair() -> W:
    return W.partitionBy(*PAIR).orderBy("d")


def kalman_spread(pairs: DataFrame, least: int = 100) -> DataFrame:
    """s1, s2, d, p1, p2, s, beta: posterior residual and the hedge ratio it implies, folded pair by pair.

    Missing prices are filled forward, then back; a pair with over 10 % of either leg missing gives no rows.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", kind="stable")
        if len(pdf) < least:
            return pdf.assign(s=0.0).head(0)
        legs = pdf[["p1", "p2"]].astype(float)
        if (legs.isna().mean() > 0.1).any():
            return pdf.assign(s=0.0).head(0)
        pdf[["p1", "p2"]] = legs.ffill().bfill()
        a, b = np.log(pdf["p1"].to_numpy(float) + 1e-8), np.log(pdf["p2"].to_numpy(float) + 1e-8)
        return pdf.assign(s=numeric.kalman(a, b))

    out = pairs.select(*PAIR, "d", "p1", "p2").groupBy(*PAIR).applyInPandas(fold, "s1 string, s2 string, d date, p1 double, p2 double, s double")
    lp2 = F.ln("p2")
    return out.withColumn("beta", F.when(F.abs(lp2) > 1e-4, (F.ln("p1") - F.col("s")) / lp2).otherwise(1.0))


def expanding_z(spread: DataFrame) -> DataFrame:
    """z over all history to date."""
    w = by_pair().rowsBetween(W.unboundedPreceding, 0)
    return spread.withColumn("z", (F.col("s") - F.avg("s").over(w)) / (F.stddev_samp("s").over(w) + 1e-8))


def features(spread: DataFrame) -> DataFrame:
    w = by_pair()
    x = spread.withColumn("diff", F.col("s") - F.lag("s").over(w))
    roll = lambda n: w.rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp("s").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1e-8
    return x.select(
        *PAIR, "d", "diff", F.avg("diff").over(roll(5)).alias("mean_5"), F.avg("diff").over(roll(10)).alias("mean_10"), F.stddev_samp("diff").over(roll(5)).alias("std_5"), F.stddev_samp("diff").over(roll(10)).alias("std_10"),
        ((F.col("s") - F.avg("s").over(roll(5))) / sd).alias("from_ma_5"), ((F.col("s") - F.avg("s").over(roll(20))) / sd).alias("from_ma_20"), ((F.col("s") - F.coalesce(F.lag("s", 20).over(w), F.first("s").over(w))) / sd).alias("mom_20"),
    )


def cusum_break(spread: DataFrame, threshold: float = 5.0, k: float = 0.5) -> DataFrame:
    """Two-sided CUSUM of standardised changes in closed form: a running sum less its running minimum, floored at 0."""
    w, every = by_pair(), W.partitionBy(*PAIR)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    x = spread.withColumn("n", F.count("*").over(every)).withColumn("r", F.col("s") - F.lag("s").over(w)).where("r is not null")
    x = x.withColumn("sd", F.stddev_samp("r").over(every)).withColumn("v", (F.col("r") - F.avg("r").over(every)) / F.nullif("sd", F.lit(0.0)))
    x = x.withColumn("up", F.sum(F.col("v") - k).over(run)).withColumn("dn", F.sum(-F.col("v") - k).over(run))
    x = x.withColumn("hi", F.col("up") - F.least(F.lit(0.0), F.min("up").over(run))).withColumn("lo", F.col("dn") - F.least(F.lit(0.0), F.min("dn").over(run)))
    g = x.groupBy(*PAIR).agg(F.first("n").alias("n"), F.first("sd").alias("sd"), F.max("hi").alias("hi"), F.max("lo").alias("lo"))
    return g.select(*PAIR, F.coalesce((F.col("n") >= 20) & (F.col("sd") >= 1e-8) & (F.greatest("hi", "lo") > threshold), F.lit(False)).alias("break"), "hi", "lo")


def hurst(spread: DataFrame, lags: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Half the slope of log variance of increments on log lag."""
    w = by_pair()
    x = spread.withColumns({f"d{k}": F.col("s") - F.lag("s", k).over(w) for k in lags})
    g = x.groupBy(*PAIR).agg(F.count("*").alias("n"), *[F.var_pop(f"d{k}").alias(f"v{k}") for k in lags])
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("v")) for k in lags])
    p = g.select(*PAIR, "n", F.explode(points).alias("p")).where("p.k < floor(n / 2) and p.v >= 1e-16")
    h = p.groupBy(*PAIR).agg(F.first("n").alias("n"), F.count("*").alias("m"), (F.regr_slope(F.ln("p.v"), F.ln("p.k")) / 2).alias("h"))
    full = g.select(*PAIR).join(h, list(PAIR), "left")
    return full.select(*PAIR, F.when((F.col("n") >= 20) & (F.col("m") >= 3), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "h"))).otherwise(0.5).alias("hurst"))


def rolling_correlation(pairs: DataFrame, n: int = 20, least: int = 15) -> DataFrame:
    w = by_pair()
    x = pairs.withColumn("r1", F.ln("p1") - F.ln(F.lag("p1").over(w))).withColumn("r2", F.ln("p2") - F.ln(F.lag("p2").over(w)))
    last = w.rowsBetween(-(n - 1), 0)
    return x.withColumn("corr", F.when(F.count("r1").over(last) >= least, F.corr("r1", "r2").over(last)))


def reference_window(lives: DataFrame) -> DataFrame:
    """Bars of the locked reference window: three half-lives within 30 to 90."""
    return lives.withColumn("window", F.greatest(F.lit(30), F.least(F.lit(90), F.floor(3 * F.col("half_life")))).cast("int"))


def outcomes(spread: DataFrame, horizon: int = 10, entry_z: float = 1.8, exit_z: float = 0.5) -> DataFrame:
    """label: whether the spread comes back within the horizon, by the mean and deviation known at entry."""
    w = by_pair()
    so_far, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, horizon)
    x = spread.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy(*PAIR)))
    x = x.withColumn("mu", F.avg("s").over(so_far)).withColumn("sd", F.stddev_samp("s").over(so_far) + 1e-8).withColumn("next", F.collect_list("s").over(ahead))
    x = x.where((F.col("i") >= 60) & (F.col("i") % 2 == 0) & (F.col("i") < F.col("n") - horizon)).withColumn("z", (F.col("s") - F.col("mu")) / F.col("sd"))
    back = F.exists("next", lambda v: F.abs((v - F.col("mu")) / F.col("sd")) < exit_z)
    return x.where(F.abs("z") >= entry_z).select(*PAIR, "d", "z", back.cast("int").alias("label"))


def exits(z: DataFrame, entry_z: float = 1.8, hold: int = 25) -> DataFrame:
    """For each entry (a bar beyond entry_z) the first later bar, from the second on, on which the exit rule holds."""
    w = by_pair()
    x = z.withColumn("i", F.row_number().over(w)).select(*PAIR, "d", "i", "z")
    e = x.where(F.abs("z") > entry_z).select(*PAIR, F.col("i").alias("i0"), F.col("d").alias("entry_d"), F.col("z").alias("z0"))
    # the range join runs as an equi-join on blocks of `hold` bars, at most three for an entry
    e = e.withColumn("block", F.explode(F.sequence(F.floor((F.col("i0") + 2) / hold), F.floor((F.col("i0") + 1 + hold) / hold))))
    x = x.withColumn("block", F.floor(F.col("i") / hold))
    j = e.join(x, [*PAIR, "block"]).where(F.col("i").between(F.col("i0") + 2, F.col("i0") + 1 + hold))
    long = F.col("z0") < 0
    out = F.when(long, (F.col("z") > -0.5) | (F.col("z") - F.col("z0") > 1)).otherwise((F.col("z") < 0.5) | (F.col("z0") - F.col("z") > 1)) | (F.col("i") - F.col("i0") - 1 >= hold)
    return j.where(out).groupBy(*PAIR, "entry_d", "z0").agg(F.min_by("d", "i").alias("exit_d"), (F.min("i") - F.first("i0") - 1).alias("held"))
