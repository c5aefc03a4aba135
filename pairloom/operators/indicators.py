"""Technical indicators as window expressions over (sym, d)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seq(*keys: str) -> W:
    return W.partitionBy(*(keys or ("sym",))).orderBy("d")


def over(agg: Column, x: Column, n: int, least: int, *keys: str) -> Column:
    """An aggregate over the last n rows where at least `least` values are there."""
    w = seq(*keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def least_rows(n: int) -> int:
    return int(n * 0.7)


def filled(x: str, *keys: str) -> Column:
    """Last value so far, else the next one."""
    w = seq(*keys)
    return F.coalesce(F.last(x, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(x, True).over(w.rowsBetween(0, W.unboundedFollowing)))


def returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(seq())
    return bars.withColumn("returns", F.try_divide(F.col("close"), before) - 1).withColumn("log_returns", F.ln(F.try_divide(F.col("close"), before)))


def moving_averages(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    return bars.withColumns({f"ma_{n}": over(F.avg("close"), F.col("close"), n, least_rows(n)) for n in spans})


def ema(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """Exponential averages whose weights sum to one over the rows so far: a linear recurrence, folded symbol by symbol."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", kind="stable")
        return pdf.assign(**{f"ema_{n}": pdf["close"].ewm(span=n).mean() for n in spans})

    kind = bars.schema["d"].dataType.simpleString()
    return bars.select("sym", "d", "close").groupBy("sym").applyInPandas(fold, f"sym string, d {kind}, close double" + "".join(f", ema_{n} double" for n in spans))


def rsi(bars: DataFrame, windows: tuple[int, ...] = (14, 21)) -> DataFrame:
    change = F.col("close") - F.lag("close").over(seq())
    b = bars.withColumn("_gain", F.when(change > 0, change).otherwise(0.0)).withColumn("_loss", F.when(change < 0, -change).otherwise(0.0))
    for n in windows:
        gain, loss = over(F.avg("_gain"), F.col("_gain"), n, least_rows(n)), over(F.avg("_loss"), F.col("_loss"), n, least_rows(n))
        b = b.withColumn(f"rsi_{n}", F.coalesce(100 - 100 / (1 + gain / (loss + 1e-10)), F.lit(50.0)))
    return b.drop("_gain", "_loss")


def bollinger(bars: DataFrame) -> DataFrame:
    c = F.col("close")
    mean, sd = over(F.avg(c), c, 20, 14), over(F.stddev_samp(c), c, 20, 14)
    b = bars.withColumn("bb_upper", mean + 2 * sd).withColumn("bb_lower", mean - 2 * sd)
    return b.withColumn("bb_position", (c - F.col("bb_lower")) / (F.col("bb_upper") - F.col("bb_lower") + 1e-8))


def volatility(bars: DataFrame, windows: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    r = F.col("returns")
    return returns(bars).withColumns({f"volatility_{n}": over(F.stddev_samp(r), r, n, least_rows(n)) * F.sqrt(F.lit(252.0)) for n in windows})


def volume(bars: DataFrame) -> DataFrame:
    """volume_ma and volume_ratio; constants where there is no volume column."""
    if "volume" not in bars.columns:
        return bars.withColumn("volume_ma", F.lit(1e6)).withColumn("volume_ratio", F.lit(1.0))
    v = F.col("volume")
    return bars.withColumn("volume_ma", over(F.avg(v), v, 20, 14)).withColumn("volume_ratio", v / (F.col("volume_ma") + 1e-8))


def momentum(bars: DataFrame, lags: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    return bars.withColumns({f"momentum_{k}": F.try_divide(F.col("close"), F.lag("close", k).over(seq())) - 1 for k in lags})


def high_vol_regime(bars: DataFrame) -> DataFrame:
    b = volatility(bars, (20,))
    v = F.col("volatility_20")
    q = over(F.percentile(v, F.lit(0.7)), v, 200, 100)
    return b.withColumn("high_vol_regime", F.coalesce((v > q).cast("int"), F.lit(0)))


def trend_strength(bars: DataFrame) -> DataFrame:
    b = moving_averages(bars, (20, 50))
    c = F.col("close")
    return b.withColumn("trend_strength", F.abs(F.col("ma_20") - F.col("ma_50")) / (over(F.stddev_samp(c), c, 20, 20) + 1e-8))


def fill_policy(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """More than half missing in a symbol: a constant by name; else last value, next value, 0. Looks ahead where a series begins with gaps."""
    out = df
    for c in columns:
        constant = 50.0 if "rsi" in c else 0.2 if "volatility" in c else 0.5 if "bb_position" in c else 0.0
        missing = F.avg(F.col(c).isNull().cast("int")).over(W.partitionBy("sym"))
        out = out.withColumn(f"_{c}", F.when(missing > 0.5, F.lit(constant)).otherwise(F.coalesce(filled(c), F.lit(0.0))))
    return out.select(*[F.col(f"_{c}").alias(c) if c in columns else c for c in df.columns])


def all_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator column, then the fill policy over all of them."""
    b = volume(bollinger(rsi(moving_averages(volatility(bars)))))
    b = b.join(ema(bars).drop("close"), ["sym", "d"])
    v, c = F.col("volatility_20"), F.col("close")
    b = momentum(b).withColumn("high_vol_regime", F.coalesce((v > over(F.percentile(v, F.lit(0.7)), v, 200, 100)).cast("int"), F.lit(0)))
    b = b.withColumn("trend_strength", F.abs(F.col("ma_20") - F.col("ma_50")) / (over(F.stddev_samp(c), c, 20, 20) + 1e-8))
    return fill_policy(b, tuple(x for x in b.columns if x not in ("sym", "d", "high_vol_regime")))
