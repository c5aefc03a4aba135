"""Trading costs as column arithmetic, and the five fund profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key, commission and half-spread (bps), impact coefficient and cap (bps), borrow easy/general/hard,
#: financing spread, daily volume, base and largest position, trades a day, drawdown limit.
PROFILES = [
    ("quant_hf", 1.0, 2.0, 0.40, 12.0, 0.003, 0.006, 0.025, 0.005, 1e9, 0.12, 0.30, 8, 0.20),
    ("multi_strat", 1.5, 4.0, 0.60, 20.0, 0.005, 0.010, 0.050, 0.010, 1e9, 0.08, 0.20, 6, 0.15),
    ("fundamental_ls", 5.0, 10.0, 1.20, 50.0, 0.010, 0.020, 0.080, 0.015, 5e8, 0.04, 0.10, 4, 0.12),
    ("institutional", 0.42, 1.19, 0.15, 4.0, 0.0005, 0.001, 0.005, 0.0, 2e9, 0.02, 0.05, 3, 0.10),
    ("retail", 7.0, 15.0, 2.50, 80.0, 0.030, 0.060, 0.150, 0.030, 1e8, 0.02, 0.05, 2, 0.15),
]
_FIELDS = "profile string, commission_bps double, bid_ask_bps double, impact double, impact_cap double, easy double, general double, hard double, financing double, adv double, base double, most double, day_trades int, dd_limit double"


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, _FIELDS)


def volume_discount(monthly: Column) -> Column:
    return F.when(monthly >= 1e9, 0.20).when(monthly >= 1e8, 0.40).when(monthly >= 1e7, 0.60).otherwise(0.80)


def commission(value: Column, monthly: Column) -> Column:
    return F.greatest(value * 0.15 * volume_discount(monthly) / 1e4, F.lit(0.5))


def impact(value: Column, price: Column, volume: float = 5e6) -> Column:
    return F.least(0.3 * F.sqrt(value / (volume * price)) * 1e4, F.lit(2.0)) * value / 1e4


def borrow_rate(symbol: Column) -> Column:
    """By the length and letters of the ticker."""
    letters, n = symbol.rlike("^[A-Za-z]+$"), F.length(symbol)
    return F.when((n <= 3) & letters, 0.0005).when((n == 4) & letters, 0.0010).when(n >= 5, 0.0200).otherwise(0.0050)


def trade_costs(t: DataFrame, monthly: float = 50e6) -> DataFrame:
    """t (long_qty, short_qty, px_long, px_short, short_sym, holding_days) with the parts of a round trip's cost and total_cost."""
    long, short, m = F.col("long_qty") * F.col("px_long"), F.col("short_qty") * F.col("px_short"), F.lit(monthly)
    out = t.withColumn("commission", 2 * (commission(long, m) + commission(short, m)))
    out = out.withColumn("impact", 2 * (impact(long, F.col("px_long")) + impact(short, F.col("px_short")))).withColumn("bid_ask", 2 * (long + short) * 0.8 / 1e4)
    out = out.withColumn("borrow", short * borrow_rate(F.col("short_sym")) * F.col("holding_days") / 365).withColumn("financing", (long + short) * 0.10 * 0.055 * F.col("holding_days") / 365)
    return out.withColumn("total_cost", F.col("commission") + F.col("impact") + F.col("bid_ask") + F.col("borrow") + F.col("financing"))


def profile_costs(t: DataFrame, sofr: float = 0.05) -> DataFrame:
    """t (value, short_sym, holding_days and a profile's fields) with the parts of that profile's round-trip cost."""
    half = F.col("value") / 2
    bps = F.least(F.col("impact") * F.sqrt(half / F.greatest("adv", F.lit(1.0))) * 1e4, F.col("impact_cap"))
    n = F.length("short_sym")
    rate = F.when(n <= 3, F.col("easy")).when(n == 4, F.col("general")).otherwise(F.col("hard"))
    lever = F.greatest(F.lit(1.0), F.col("base") * F.col("day_trades") * 5.0)
    out = t.withColumn("commission_cost", 4 * half * F.col("commission_bps") / 1e4).withColumn("bid_ask_cost", 4 * half * F.col("bid_ask_bps") / 1e4).withColumn("impact_cost", 2 * half * bps / 1e4)
    out = out.withColumn("borrow_cost", half * rate * F.col("holding_days") / 365.0).withColumn("financing_cost", F.col("value") * (1 - 1 / lever) * (sofr + F.col("financing")) * F.col("holding_days") / 365.0)
    return out.withColumn("cost", sum((F.col(f"{c}_cost") for c in ("bid_ask", "impact", "borrow", "financing")), F.col("commission_cost")))
