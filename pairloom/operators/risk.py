"""Rules of risk and size as columns, for signals and for a daily series; the fold applies the same ones with its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.config import CONFIG, EngineConfig


def volatility_scale(volatility: Column, base: float = 0.02) -> Column:
    """1 up to the base of annual volatility, a half beyond one and a half times it, straight between; 1 where unknown."""
    ratio = volatility / base
    return F.when(volatility.isNull() | (ratio <= 1), 1.0).when(ratio > 1.5, 0.5).otherwise(1 - (ratio - 1) * 0.5)


def profit_scale(gain: Column) -> Column:
    """1 below a gain of 40 %, a half from 60 % on, straight between."""
    return F.when(gain < 0.4, 1.0).when(gain >= 0.6, 0.5).otherwise(1 - (gain - 0.4) / 0.2 * 0.5)


def form(win_share: Column, outcomes: Column) -> Column:
    """Size by the wins among the last five of more than five outcomes."""
    return F.when((outcomes > 5) & (win_share < 0.3), 0.7).when((outcomes > 5) & (win_share > 0.7), 1.3).otherwise(1.0)


def size_fraction(strength: Column, quality: Column, z: Column, volatility: Column, *, by_form: Column | None = None, scale: Column | None = None, config: EngineConfig = CONFIG) -> Column:
    """Share of capital: base by strength, quality, form and recent volatility, clamped, then scaled by risk and by z."""
    one = F.lit(1.0)
    calm = F.when(volatility > config.wild_volatility, 0.8).otherwise(1.0)
    part = config.base_size * F.least(0.7 + 0.6 * strength, F.lit(2.0)) * F.least(0.8 + 0.4 * quality, F.lit(1.5)) * (one if by_form is None else by_form) * calm
    clamped = F.greatest(F.lit(config.min_size), F.least(F.lit(config.max_position), part))
    return clamped * (one if scale is None else scale) * F.least(F.abs(z) / 2.3, F.lit(2.0))


def verdict(strength: Column, z: Column, quality: Column, size: Column, exposure: Column, volatility: Column, volume: Column, *, paused: Column | None = None, config: EngineConfig = CONFIG) -> Column:
    """Name of the first rule that a signal fails, else 'pass'. A null value fails its rule."""
    rules = [
        ("paused", F.lit(True) if paused is None else ~paused), ("strength", strength >= config.min_strength), ("zscore", F.abs(z) >= config.min_signal_z), ("quality", quality >= config.min_quality),
        ("size", size <= config.max_position), ("volatility", volatility <= config.max_volatility), ("exposure", exposure + size <= config.max_exposure), ("volume", volume >= config.min_volume),
    ]
    return F.coalesce(*[F.when(~F.coalesce(held, F.lit(False)), F.lit(name)) for name, held in rules], F.lit("pass"))


def risk_state(daily: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """daily (d, pnl) with value, drawdown, the scale that held on the day (known from the days before), pause and stop.

    Peaks begin at the capital; one row a date, so its windows run over dates only.
    """
    w = W.orderBy("d")
    before, last20 = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(-20, -1)
    x = daily.select("d", "pnl").withColumn("value", F.exp(F.sum(F.ln(1 + F.col("pnl"))).over(w.rowsBetween(W.unboundedPreceding, 0))))
    x = x.withColumn("drawdown", 1 - F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(w.rowsBetween(W.unboundedPreceding, 0))))
    vol = F.when(F.count("pnl").over(before) >= 10, F.stddev_pop("pnl").over(last20) * F.sqrt(F.lit(252.0)))
    gain = F.coalesce(F.lag("value").over(w), F.lit(1.0)) - 1
    x = x.withColumn("vol", vol).withColumn("gain", gain)
    paused = F.col("pnl") < -config.pause_loss
    stop = (F.col("drawdown") >= config.stop_drawdown) | (F.col("pnl") < -config.stop_day_loss)
    return x.select("d", "pnl", "value", "drawdown", F.least(volatility_scale(F.col("vol")), profit_scale(F.col("gain"))).alias("scale"), F.coalesce(F.lag(paused).over(w), F.lit(False)).alias("paused"), stop.alias("stop"))
