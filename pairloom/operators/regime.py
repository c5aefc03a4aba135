"""Market regimes: as-of values, dispersion, scales, stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(rows: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Each row of (sym, d) with the last value of a market-wide series (d, value) at or before d.

    The series is first made one row a date of the rows, so its window runs over dates only.
    """
    kind = series.schema[value].dataType
    dates = rows.select("d").distinct().withColumn(value, F.lit(None).cast(kind)).withColumn("_q", F.lit(1))
    both = dates.unionByName(series.select("d", value).withColumn("_q", F.lit(0)))
    last = F.last(value, True).over(W.orderBy("d", "_q").rowsBetween(W.unboundedPreceding, 0))  # as many rows as dates
    known = both.withColumn("_v", last).where("_q = 1").select("d", F.col("_v").alias(value))
    return rows.join(known, "d", "left")


def dispersion_z(sectors: DataFrame, n: int = 63, least: int = 30, long: int = 252, least_long: int = 60) -> DataFrame:
    """d, z: cross-section deviation of n-bar log returns against its own history. sectors: (sym, d, close)."""
    w = W.partitionBy("sym").orderBy("d")
    r = sectors.withColumn("r", F.ln("close") - F.ln(F.lag("close").over(w)))
    roll = w.rowsBetween(-(n - 1), 0)
    s = r.withColumn("s", F.when(F.count("r").over(roll) >= least, F.sum("r").over(roll)))
    g = s.groupBy("d").agg(F.stddev_samp("s").alias("x"))
    h = W.orderBy("d").rowsBetween(-(long - 1), 0)  # as many rows as dates
    ok = F.count("x").over(h) >= least_long
    return g.select("d", F.when(ok, (F.col("x") - F.avg("x").over(h)) / (F.stddev_samp("x").over(h) + 1e-10)).alias("z"))


def daily_dispersion_z(sectors: DataFrame, least_bars: int = 10, long: int = 252, least_long: int = 60) -> DataFrame:
    """d, z: cross-section deviation of one-bar returns against its own history, of sectors with more than least_bars bars."""
    w = W.partitionBy("sym").orderBy("d")
    r = sectors.withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("n", F.count("*").over(W.partitionBy("sym")))
    g = r.where(F.col("n") > least_bars).groupBy("d").agg(F.stddev_samp("r").alias("x")).where("x is not null")
    h = W.orderBy("d").rowsBetween(-(long - 1), 0)  # as many rows as dates
    ok = F.count("x").over(h) >= least_long
    return g.select("d", F.when(ok, (F.col("x") - F.avg("x").over(h)) / (F.stddev_samp("x").over(h) + 1e-10)).alias("z")).where("z is not null")


def regime_scale(vix: Column, z: Column) -> Column:
    """The least of the volatility scale and the dispersion scale."""
    by_vix = F.when(vix > 40, 0.25).when(vix > 30, 0.5).otherwise(1.0)
    by_z = F.when(z > 2.0, 0.5).when((vix < 20) & (z > 0.8), 0.4).otherwise(1.0)
    return F.least(by_vix, by_z)


def hard_stop(days: DataFrame, n: int = 63, most: float = 0.20, by: tuple[str, ...] = ()) -> DataFrame:
    """days (d, scale) with stop: over a fifth of the last n days at a reduced scale, from the n-th day on (of each group)."""
    w = W.partitionBy(*by).orderBy("d")
    share = F.sum((F.col("scale") < 1).cast("int")).over(w.rowsBetween(-(n - 1), 0)) / n
    return days.withColumn("stop", (F.row_number().over(w) >= n) & (share > most))


def diagnosis(days: DataFrame, start: str, end: str) -> DataFrame:
    """One row on a period: volatility against the 252 days before, dispersion and how often it stood out."""
    inside = F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    before = days.where(F.col("d") < F.lit(start).cast("date")).orderBy(F.desc("d")).limit(252).agg(F.avg("vix").alias("vix_before"))
    now = days.where(inside).agg(F.count("*").alias("n"), F.avg("vix").alias("vix_mean"), F.min("vix").alias("vix_min"), F.max("vix").alias("vix_max"), F.avg("z").alias("z_mean"), F.max("z").alias("z_max"), *[F.count_if(F.col("z") > x).alias(f"above_{str(x).replace('.', '_')}") for x in (1.0, 1.2, 2.0)])
    return now.crossJoin(F.broadcast(before))  # one row each
