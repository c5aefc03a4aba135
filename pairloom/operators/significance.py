"""Significance of return series. Moments come from one aggregation; distribution functions run on its row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.numeric import NORMAL, t_two_sided

EULER = 0.5772156649015329


def moments(daily: DataFrame) -> DataFrame:
    """n, mean, sd, annual Sharpe, bias-corrected skew and plain (not excess) kurtosis of pnl."""
    r = F.col("pnl")
    g = daily.agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6)) + 3
    return g.select("n", "mean", "sd", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), skew.alias("skew"), kurt.alias("kurt"))


def probabilistic_sharpe(n: int, sharpe_daily: float, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    if n < 3:
        return math.nan
    spread = math.sqrt(max(1 - skew * sharpe_daily + (kurt - 1) / 4 * sharpe_daily**2, 1e-12))
    return NORMAL.cdf((sharpe_daily - benchmark) * math.sqrt(n - 1) / spread)


def deflated_benchmark(n: int, trials: int) -> float:
    """The daily Sharpe ratio that the best of so many trials without skill would show."""
    if trials < 2:
        return 0.0
    best = (1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e))
    return math.sqrt(252 / n) * best / math.sqrt(252)


def _battery(daily: DataFrame, trials: int, draws: int) -> list[tuple[str, float | None]]:
    m, h, b = moments(daily).first(), hac_t(daily).first(), bootstrap_sharpe(daily, draws=draws).first()
    out = [("days", float(m.n)), ("sharpe", float(m.sharpe or 0.0)), ("hac_t", h.t), ("hac_p", h.p), ("hac_lags", float(h.lags)), ("sharpe_low", b.low), ("sharpe_high", b.high)]
    if m.n and m.n >= 4 and m.sd:
        s = m.sharpe / math.sqrt(252)
        out += [("psr", probabilistic_sharpe(m.n, s, m.skew, m.kurt))]
        if trials > 1:
            out += [("dsr", probabilistic_sharpe(m.n, s, m.skew, m.kurt, deflated_benchmark(m.n, trials))), ("dsr_benchmark", deflated_benchmark(m.n, trials) * math.sqrt(252))]
    return out


def report(daily: DataFrame, oos: DataFrame | None = None, windows: list[float] | None = None, *, trials: int = 27, draws: int = 5000) -> DataFrame:
    """section, measure, value: the battery of tests of the main series and of the stitched one (if over two days), and the test of window returns."""
    rows = [("main", k, v) for k, v in _battery(daily, trials, draws)]
    if oos is not None and oos.limit(3).count() > 2:
        rows += [("oos_daily", k, v) for k, v in _battery(oos, trials, draws)]
    if windows is not None and len(windows) >= 2:
        rows += [("oos_windows", c.split()[0], None if v is None else float(v)) for c, v in zip(WINDOW_TEST.split(", "), window_test(windows), strict=True)]
    return daily.sparkSession.createDataFrame(rows, "section string, measure string, value double")


def hac_t(daily: DataFrame) -> DataFrame:
    """Newey-West t of the mean, Bartlett weights; autocovariances by lags of one ordered window."""
    n = daily.count()
    most = max(1, int(4 * (n / 100) ** (2 / 9))) if n else 1
    w = W.orderBy("d")
    x = daily.withColumn("e", F.col("pnl") - F.avg("pnl").over(W.partitionBy()))
    x = x.withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, most + 1)})
    var = F.sum(F.col("e") * F.col("e")) / F.count("*")
    for k in range(1, most + 1):
        var += 2 * (1 - k / (most + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)) / F.count("*")
    out = x.agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), (F.avg("pnl") / F.sqrt(F.greatest(var / F.count("*"), F.lit(1e-18)))).alias("t"))
    enough = F.col("n") >= 3
    out = out.withColumns({"t": F.when(enough, F.col("t")).otherwise(0.0), "lags": F.when(enough, F.lit(most)).otherwise(0)})

    @F.pandas_udf("double")
    def p(t: pd.Series) -> pd.Series:  # of one row
        return t.map(lambda v: 2 * (1 - NORMAL.cdf(abs(v))))

    return out.withColumn("p", p("t"))


def bootstrap_mean(values: list[float], *, draws: int = 5000, alpha: float = 0.05, seed: int = 42) -> tuple[float | None, float | None]:
    """Bootstrap interval of the mean of a few numbers."""
    v = np.asarray(values, float)
    if len(v) < 2:
        return None, None
    means = v[np.random.default_rng(seed).integers(0, len(v), (draws, len(v)))].mean(axis=1)
    return float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))


WINDOW_TEST = "n int, mean double, sd double, t double, p double, positive int, low double, high double"


def window_test(values: list[float]) -> tuple:
    """n, mean, deviation, t, two-sided p, how many are positive, and the bootstrap interval of the mean of a few window returns."""
    v = np.asarray(values, float)
    n, up = len(v), int((v > 0).sum())
    if n < 2:
        return n, (float(v.mean()) if n else 0.0), None, 0.0, 1.0, up, None, None
    sd = float(v.std(ddof=1))
    t = float(v.mean() / (sd / math.sqrt(n))) if sd > 0 else 0.0
    return n, float(v.mean()), sd, t, t_two_sided(t, n - 1) if sd > 0 else 1.0, up, *bootstrap_mean(values)


def bootstrap_sharpe(daily: DataFrame, *, block: int = 10, draws: int = 5000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Circular block bootstrap interval of the annual Sharpe. The daily series (a number a day) goes to the tasks, draws are dealt over them."""
    r = daily.orderBy("d").select("pnl").toPandas()["pnl"].to_numpy(float)
    n = len(r)

    def run(frames):
        for pdf in frames:
            out = []
            for i in pdf["id"].tolist():
                rng = np.random.default_rng([seed, i])
                at = (rng.integers(0, n, -(-n // block))[:, None] + np.arange(block)).ravel()[:n] % n
                x = r[at]
                sd = x.std(ddof=1)
                out.append(x.mean() / sd * math.sqrt(252) if sd > 0 else 0.0)
            yield pd.DataFrame({"s": out})

    if n < 11:
        return daily.sparkSession.createDataFrame([(None, None)], "low double, high double")
    s = daily.sparkSession.range(draws).mapInPandas(run, "s double")
    return s.agg(F.percentile("s", F.lit(alpha / 2)).alias("low"), F.percentile("s", F.lit(1 - alpha / 2)).alias("high"))
