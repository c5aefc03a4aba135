"""The 38 numbers that describe a signal, as one array a pair and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spread as SP
from .regime import as_of

WIDTH = 38
#: Where there is no macro series (fixed values).
NO_MACRO = (0.67, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.5)
_BACK = 28


def _twice(dates: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """d, now, ago: a series as of each date and as of 28 days before it."""
    now = as_of(dates.withColumn("sym", F.lit("")), series, value).select("d", F.col(value).alias("now"))
    ago = as_of(dates.select(F.date_sub("d", _BACK).alias("d"), F.lit("").alias("sym")), series, value).select(F.date_add("d", _BACK).alias("d"), F.col(value).alias("ago"))
    return now.join(ago, "d", "left")


def sector_moves(dates: DataFrame, sectors: DataFrame) -> DataFrame:
    """d, sector, move: each sector's return over 28 days as of each date, 0 where unknown. sectors: (sector, d, close)."""
    grid = dates.select("d").crossJoin(F.broadcast(sectors.select("sector").distinct()))  # about a dozen sectors
    wanted = grid.withColumn("at", F.explode(F.array("d", F.date_sub("d", _BACK))))
    rows = wanted.select("sector", F.col("at").alias("t"), "d", F.lit(None).cast("double").alias("close"), F.lit(1).alias("q"))
    known = sectors.select("sector", F.col("d").alias("t"), F.lit(None).cast("date").alias("d"), "close", F.lit(0).alias("q"))
    last = F.last("close", True).over(W.partitionBy("sector").orderBy("t", "q").rowsBetween(W.unboundedPreceding, 0))
    x = rows.unionByName(known).withColumn("v", last).where("q = 1")
    g = x.groupBy("d", "sector").agg(F.max(F.when(F.col("t") == F.col("d"), F.col("v"))).alias("now"), F.max(F.when(F.col("t") < F.col("d"), F.col("v"))).alias("ago"))
    return g.select("d", "sector", F.coalesce(F.when(F.col("ago") > 0, (F.col("now") - F.col("ago")) / F.col("ago")), F.lit(0.0)).alias("move"))


def signal_features(spread: DataFrame, legs: DataFrame, stats: DataFrame, macro: DataFrame | None = None, sectors: DataFrame | None = None, sector_of: DataFrame | None = None, *, legs_as_of_day: bool = False) -> DataFrame:
    """s1, s2, d, features (38 doubles): place in the history, changes, legs, pair, calendar, market and sectors; the rest 0.

    spread: (s1, s2, d, s); legs: (sym, d, rsi_14, momentum_5, high_vol); stats: (s1, s2, correlation, half_life, score);
    macro: (d, vix); sectors: (sector, d, close); sector_of: (sym, sector), 'SPY' where a symbol has none. The legs and
    the weekday are those of the last date that both legs have, as the reference takes them, or of the day itself.
    Unknown values are 0, all lie within -5 to 5, and a pair's first 19 rows are all 0.
    """
    w = SP.by_pair()
    run, roll = w.rowsBetween(W.unboundedPreceding, 0), lambda n: w.rowsBetween(-(n - 1), 0)
    x = spread.select("s1", "s2", "d", "s").withColumn("i", F.row_number().over(w)).withColumn("c", F.col("s") - F.lag("s").over(w)).withColumn("sd", F.stddev_samp("s").over(run) + 1e-8)
    x = x.withColumn("z", (F.col("s") - F.avg("s").over(run)) / F.col("sd"))
    s, c, sd, z = (F.col(k) for k in ("s", "c", "sd", "z"))
    x = x.withColumns({
        "c5": F.avg(c).over(roll(5)), "c10": F.avg(c).over(roll(10)), "v5": F.stddev_samp(c).over(roll(5)), "v10": F.stddev_samp(c).over(roll(10)),
        "m5": (s - F.avg(s).over(roll(5))) / sd, "m20": (s - F.avg(s).over(roll(20))) / sd, "mom": (s - F.coalesce(F.lag("s", 20).over(w), F.first("s").over(run))) / sd,
    })
    leg = lambda k: legs.select(F.col("sym").alias(f"s{k}"), "d", F.struct("rsi_14", "momentum_5", "high_vol").alias(f"leg{k}"))
    if legs_as_of_day:
        x = x.join(leg(1), ["s1", "d"], "left").join(leg(2), ["s2", "d"], "left").withColumn("seen", F.col("d"))
    else:
        both = spread.select("s1", "s2", "d").join(leg(1), ["s1", "d"]).join(leg(2), ["s2", "d"])
        x = x.join(both.groupBy("s1", "s2").agg(F.max("d").alias("seen"), F.max_by("leg1", "d").alias("leg1"), F.max_by("leg2", "d").alias("leg2")), ["s1", "s2"], "left")
    x = x.join(stats.select("s1", "s2", "correlation", "half_life", "score"), ["s1", "s2"], "left")
    market: list[Column] = [F.lit(v) for v in NO_MACRO]
    if macro is not None:
        dates = spread.select("d").distinct()
        x = x.join(_twice(dates, macro, "vix").withColumnsRenamed({"now": "vix", "ago": "vix_ago"}), "d", "left")
        vix, moves = F.col("vix"), [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.5)]
        if sectors is not None and sector_of is not None:
            moved = sector_moves(dates, sectors).persist()  # a dozen rows a date
            x = x.join(moved.groupBy("d").agg(F.avg("move").alias("breadth")), "d", "left")
            for k in (1, 2):
                x = x.join(sector_of.select(F.col("sym").alias(f"s{k}"), F.col("sector").alias(f"sector{k}")), f"s{k}", "left").withColumn(f"sector{k}", F.coalesce(f"sector{k}", F.lit("SPY")))
                x = x.join(moved.select("d", F.col("sector").alias(f"sector{k}"), F.col("move").alias(f"move{k}")), ["d", f"sector{k}"], "left").withColumn(f"move{k}", F.coalesce(f"move{k}", F.lit(0.0)))
            moves = [F.col("move1"), F.col("move2"), F.col("move1") - F.col("move2"), F.col("breadth"), F.when(F.col("sector1") == F.col("sector2"), 0.5).otherwise(1.0)]
        market = [vix / 30, (vix - F.col("vix_ago")) / (F.col("vix_ago") + 1e-8), F.when(vix < 15, 0.0).when(vix < 25, 0.5).otherwise(1.0), *moves]
    of_leg = lambda k: [F.when(F.col(f"leg{k}").isNull(), 0.5).otherwise(F.col(f"leg{k}.rsi_14") / 100), F.col(f"leg{k}.momentum_5"), F.col(f"leg{k}.high_vol")]
    of_pair = [F.coalesce("correlation", F.lit(0.0)), F.least(F.coalesce("half_life", F.lit(50.0)), F.lit(100.0)) / 100, F.coalesce("score", F.lit(0.5))]
    parts = [z, F.abs(z), F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z)), z * z, c, F.col("c5"), F.col("c10"), F.col("v5"), F.col("m5"), F.col("m20"), *of_leg(1), *of_leg(2), *of_pair, F.weekday("seen") / 6, F.col("v10"), F.col("mom"), *market]
    parts += [F.lit(0.0)] * (WIDTH - len(parts))
    bounded = [F.when(F.col("i") < 20, 0.0).otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.coalesce(p.cast("double"), F.lit(0.0))))) for p in parts]
    return x.select("s1", "s2", "d", F.array(*bounded).alias("features"))
