"""Symbol lists and data-quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .indicators import over, seq


def clean_symbols(df: DataFrame, longest: int = 6, allowed: str = "A-Z0-9.-") -> DataFrame:
    """Trimmed, upper-case, well-formed and distinct symbols of column `symbol`."""
    s = F.upper(F.regexp_replace(F.trim("symbol"), "[ \\t\\n]", ""))
    ok = F.length("symbol").between(1, longest) & ~F.col("symbol").isin("NAN", "NULL", "", "0") & ~F.col("symbol").rlike("^[0-9]+$") & F.col("symbol").rlike(f"^[{allowed}]+$")
    return df.where("symbol is not null").select(s.alias("symbol")).where(ok).distinct()


def validate_prices(bars: DataFrame) -> DataFrame:
    """Per symbol: rejected on a close of 0 or less, over 15 % missing, or a low under 2."""
    g = bars.groupBy("sym").agg(F.count("*").alias("n"), F.min("close").alias("least"), F.avg(F.col("close").isNull().cast("int")).alias("null_share"))
    return g.withColumn("valid", (F.col("least") > 0) & (F.col("null_share") <= 0.15) & (F.col("least") >= 2.0))


def quality_symbols(bars: DataFrame, *, least_rows: int = 300, least_volume: float = 2.5e6, least_close: float = 5.0, vol_low: float = 0.05, vol_high: float = 0.8, most_null: float = 0.1) -> DataFrame:
    v, r = F.col("volume"), F.try_divide(F.col("close"), F.lag("close").over(seq())) - 1
    b = bars.withColumn("_vma", over(F.avg(v), v, 20, 14)).withColumn("_r", r)
    g = b.groupBy("sym").agg(F.count("*").alias("n"), F.avg("_vma").alias("volume_ma"), F.avg("close").alias("close"), (F.stddev_samp("_r") * F.sqrt(F.lit(252.0))).alias("vol"), F.avg(F.col("close").isNull().cast("int")).alias("null_share"))
    return g.where((F.col("n") >= least_rows) & (F.col("volume_ma") >= least_volume) & (F.col("close") >= least_close) & F.col("vol").between(vol_low, vol_high) & (F.col("null_share") < most_null))


def fallback_symbols(bars: DataFrame, *, least_rows: int = 200, top: int = 100) -> DataFrame:
    """The symbols of most complete history, for when too few pass quality_symbols."""
    g = bars.groupBy("sym").agg(F.count("*").alias("n"), F.avg(F.col("close").isNull().cast("int")).alias("null_share"))
    return g.where(F.col("n") >= least_rows).withColumn("score", F.col("n") * (1 - F.col("null_share"))).orderBy(F.desc("score"), "sym").limit(top)


def last_per_day(ticks: DataFrame) -> DataFrame:
    """One close a symbol and day, the last by time."""
    w = W.partitionBy("sym", F.to_date("ts")).orderBy(F.desc("ts"))
    return ticks.withColumn("_i", F.row_number().over(w)).where("_i = 1").select("sym", F.to_date("ts").alias("d"), "close")
