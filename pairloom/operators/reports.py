"""Reports over the two relations a simulation leaves: trades and daily returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import costs


def profit_factor(r: Column) -> Column:
    """Gains over losses: 0 without gains, 999 without losses."""
    up, down = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return F.when(up.isNull(), 0.0).when(down.isNull(), 999.0).otherwise(up / down)


def trade_summary(t: DataFrame) -> DataFrame:
    r = F.col("net_pnl_pct")
    up, down = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    return t.agg(F.count("*").alias("trades"), F.count_if(r > 0).alias("wins"), F.count_if(r < 0).alias("losses"), F.coalesce(F.try_divide(F.count_if(r > 0), F.count("*")), F.lit(0.0)).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("mean_win"), F.avg(F.when(r < 0, -r)).alias("mean_loss"), F.when(F.coalesce(down, F.lit(0.0)) > 0, F.coalesce(up, F.lit(0.0)) / down).otherwise(0.0).alias("profit_factor"))


def running(r: Column, w: W) -> Column:
    """Compounded value of returns so far. A sum of logarithms: exact enough, and an ordinary window sum."""
    return F.exp(F.sum(F.ln(1 + r)).over(w))


def drawdowns(daily: DataFrame, *keys: str) -> DataFrame:
    """d, pnl, value and drawdown; the peak starts at the first compounded value."""
    w = W.partitionBy(*keys).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    x = daily.withColumn("value", running(F.col("pnl"), w))
    return x.withColumn("drawdown", (F.max("value").over(w) - F.col("value")) / F.max("value").over(w))


def pair_performance(t: DataFrame) -> DataFrame:
    r = F.col("net_pnl_pct")
    w = W.partitionBy("pair").orderBy("d", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    x = t.withColumn("_v", running(r, w)).withColumn("_dd", 1 - F.col("_v") / F.max("_v").over(w))
    return x.groupBy("pair").agg(F.count("*").alias("trades"), (F.sum(r) * 100).alias("total_return"), F.count_if(r > 0).alias("wins"), (F.count("*") - F.count_if(r > 0)).alias("losses"), F.avg("holding_days").alias("mean_hold"), profit_factor(r).alias("profit_factor"), F.coalesce(F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"), F.max("_dd").alias("max_drawdown"), F.sum("pnl_dollar").alias("pnl_dollar"))


def by_category(t: DataFrame, categories: list[str], of: Column) -> DataFrame:
    """Count, win share, mean and total in per cent for each category, zero rows included."""
    spark = t.sparkSession
    r = F.col("net_pnl_pct")
    g = t.groupBy(of.alias("category")).agg(F.count("*").alias("trades"), (F.avg((r > 0).cast("int")) * 100).alias("win_pct"), (F.avg(r) * 100).alias("mean_pct"), (F.sum(r) * 100).alias("total_pct"))
    every = spark.createDataFrame([(c,) for c in categories], "category string")
    return every.join(g, "category", "left").select("category", F.coalesce("trades", F.lit(0)).alias("trades"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("win_pct", "mean_pct", "total_pct")])


def holding_bucket() -> Column:
    return F.when(F.col("holding_days") <= 3, "1-3").when(F.col("holding_days") <= 7, "4-7").when(F.col("holding_days") <= 999, "8-999")


def strength_bucket() -> Column:
    s = F.col("strength")
    return F.when((s >= 0.5) & (s < 0.7), "0.5-0.7").when((s >= 0.7) & (s < 0.85), "0.7-0.85").when((s >= 0.85) & (s <= 1.0), "0.85-1.0")


def monthly(daily: DataFrame) -> DataFrame:
    r = F.col("pnl")
    sd = F.stddev_samp(r)
    return daily.groupBy(F.date_trunc("month", "d").cast("date").alias("month")).agg((F.exp(F.sum(F.ln(1 + r))) - 1).alias("total"), F.count("*").alias("days"), F.avg((r > 0).cast("int")).alias("win_share"), (sd * F.sqrt(F.lit(21.0))).alias("vol"), F.coalesce(F.avg(r) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(21.0)), F.lit(0.0)).alias("sharpe"))


def backtest_summary(daily: DataFrame) -> DataFrame:
    """Total and annualised return, Sharpe by the population deviation plus 1e-8, worst drawdown."""
    r = F.col("pnl")
    d = drawdowns(daily)
    return d.agg((F.exp(F.sum(F.ln(1 + r))) - 1).alias("total"), ((F.exp(F.sum(F.ln(1 + r))) - 1) * 252 / F.count("*")).alias("annualised"), (F.avg(r) / (F.stddev_pop(r) + 1e-8) * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.stddev_pop(r) * F.sqrt(F.lit(252.0))).alias("vol"), F.max("drawdown").alias("max_drawdown"), F.count("*").alias("days"))


def walk_windows(days: DataFrame, train: int = 252, test: int = 63) -> DataFrame:
    """window, train_start, train_end, test_start, test_end over the calendar's ordinals."""
    x = days.select("d").distinct().withColumn("i", F.row_number().over(W.orderBy("d")) - 1).withColumn("n", F.count("*").over(W.partitionBy()))
    at = lambda off: F.max(F.when(F.col("i") == F.col("s") + off, F.col("d")))
    starts = x.select("n").limit(1).select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - train - test), F.lit(test))).alias("s"), "n").where(F.col("s") + train + test <= F.col("n"))
    j = x.drop("n").join(F.broadcast(starts), F.col("i").between(F.col("s"), F.col("s") + train + test - 1))  # a row a quarter
    return j.groupBy("s").agg(at(0).alias("train_start"), at(train - 1).alias("train_end"), at(train).alias("test_start"), at(train + test - 1).alias("test_end")).select((F.col("s") / test + 1).cast("int").alias("window"), "train_start", "train_end", "test_start", "test_end")


def window_returns(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Return and Sharpe of each test period, by a range join with a few windows."""
    r = F.col("pnl")
    j = daily.join(F.broadcast(windows), F.col("d").between(F.col("test_start"), F.col("test_end")))  # a row a quarter
    return j.groupBy("window", "test_start").agg((F.exp(F.sum(F.ln(1 + r))) - 1).alias("total"), (F.avg(r) / (F.stddev_pop(r) + 1e-8) * F.sqrt(F.lit(252.0))).alias("sharpe"))


def walk_summary(w: DataFrame) -> DataFrame:
    """Windows, profitable ones, mean and upper median return, mean Sharpe, stitched return."""
    m = F.sort_array(F.collect_list("total"))  # a value a quarter
    return w.agg(F.count("*").alias("windows"), F.count_if(F.col("total") > 0).alias("profitable"), F.avg("total").alias("mean"), F.element_at(m, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"), F.avg("sharpe").alias("sharpe"), (F.exp(F.sum(F.ln(1 + F.col("total")))) - 1).alias("stitched"))


def run_summary(daily: DataFrame, trades: DataFrame, capital: float = 1e8) -> DataFrame:
    """backtest_summary and trade_summary side by side, with costs, averages by trade, and counts by day: one row.

    trades: net_pnl_pct, cost_pct, strength, quality, feature_quality, d.
    """
    t = trades.withColumn("_c", F.col("cost_pct") * capital)
    a = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    more = t.agg(F.coalesce(F.sum("_c"), F.lit(0.0)).alias("costs"), (F.coalesce(F.sum("_c"), F.lit(0.0)) / capital).alias("cost_impact"), a("_c").alias("cost_per_trade"), a("cost_pct").alias("cost_pct_per_trade"), a("strength").alias("mean_strength"), a("quality").alias("mean_quality"), F.count_if(F.col("feature_quality") > 0.7).alias("high_quality"), a("net_pnl_pct").alias("mean_trade"))
    most = trades.groupBy("d").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_daily"))
    one = backtest_summary(daily).crossJoin(trade_summary(trades)).crossJoin(more).crossJoin(most)  # a row each
    return one.withColumn("trades_per_day", F.coalesce(F.try_divide("trades", "days"), F.lit(0.0)))


def stitched(walked: DataFrame, windows: DataFrame, since: str | None = None) -> DataFrame:
    """d, pnl of the test periods one after another, of windows whose test starts at `since` or later."""
    w = windows if since is None else windows.where(F.col("test_start") >= F.lit(since).cast("date"))
    return walked.join(F.broadcast(w.select("window")), "window", "left_semi").select("d", "pnl")  # a row a quarter


def _fund_days(t: DataFrame, equity: float = 1e8) -> DataFrame:
    """Sums by profile and exit date up to the profile's stop, with the value of one at the start and its drawdown."""
    x = t.crossJoin(F.broadcast(costs.profiles(t.sparkSession)))  # five rows
    x = x.withColumn("fraction", F.least(F.col("base") * F.least(F.abs("zscore") / 2.3, F.lit(2.0)), F.col("most"))).withColumn("value", F.col("fraction") * equity)
    x = costs.profile_costs(x).withColumn("net", F.col("spread_return") * F.col("fraction") - F.col("cost") / equity)
    x = x.withColumn("d", F.date_add("d", F.greatest(F.lit(1), F.col("holding_days"))))
    net = F.col("net")
    day = x.groupBy("profile", "dd_limit", "d").agg(F.sum(net).alias("pnl"), F.count("*").alias("trades"), F.sum("cost").alias("cost"), F.count_if(net > 0).alias("wins"), F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("won"), F.coalesce(F.sum(F.when(net < 0, -net)), F.lit(0.0)).alias("lost"))
    w = W.partitionBy("profile").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    day = day.withColumn("value", running(F.greatest(F.col("pnl"), F.lit(-0.999999)), w)).withColumn("dd", 1 - F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(w)))
    stop = day.where("dd >= dd_limit").groupBy("profile").agg(F.min("d").alias("stop"))
    return day.join(F.broadcast(stop), "profile", "left").where("stop is null or d <= stop")  # at most a row a profile


def fund_curves(t: DataFrame, equity: float = 1e8) -> DataFrame:
    """profile, d, value, drawdown: what each profile's equity is worth after each exit date."""
    return _fund_days(t).select("profile", "d", (F.col("value") * equity).alias("value"), F.col("dd").alias("drawdown"))


def by_profile(x: DataFrame, measures: list[str], name: str) -> DataFrame:
    """x, a row a profile, turned: a row a measure, a column a profile."""
    each = x.select("profile", *[F.col(m).cast("double").alias(m) for m in measures]).unpivot("profile", measures, name, "v")
    return each.groupBy(name).pivot("profile", [p[0] for p in costs.PROFILES]).agg(F.max("v"))


def fund_metrics(replay: DataFrame, equity: float = 1e8) -> DataFrame:
    """The report's metrics, of what the replay gave and of the profiles' terms, a row each and a column a profile."""
    c = F.col
    x = replay.join(F.broadcast(costs.profiles(replay.sparkSession)), "profile")  # five rows
    share = c("cost") / equity * 100
    made = {
        "total_return_pct": c("total") * 100, "gross_return_pct": c("total") * 100 + share, "annualised_return_pct": c("annualised") * 100, "sharpe": c("sharpe"), "max_drawdown_pct": c("max_drawdown") * 100, "win_rate_pct": c("win_rate") * 100,
        "profit_factor": c("profit_factor"), "trades": c("trades"), "cost_pct": share, "commission_bps": c("commission_bps"), "bid_ask_bps": c("bid_ask_bps"), "impact_cap_bps": c("impact_cap"),
        "borrow_easy_pct": c("easy") * 100, "financing_pct": c("financing") * 100, "base_position_pct": c("base") * 100, "stopped": c("stopped").cast("int"),
    }
    return by_profile(x.select("profile", *[v.alias(k) for k, v in made.items()]), list(made), "metric")


def return_histogram(daily: DataFrame, bins: int = 20) -> DataFrame:
    """bin, its low edge, days and density of daily returns in equal bins, with their mean and deviation; empty bins have no row."""
    r = F.col("pnl")
    m = daily.agg(F.min(r).alias("lo"), ((F.max(r) - F.min(r)) / bins).alias("width"), F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(r - F.col("lo"), F.col("width"))), F.lit(0)).cast("int"))
    x = daily.where("pnl is not null").crossJoin(F.broadcast(m)).groupBy(at.alias("bin"), "lo", "width", "n", "mean", "sd").agg(F.count("*").alias("days"))  # one row
    return x.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "days", F.try_divide(F.col("days"), F.col("n") * F.col("width")).alias("density"), "mean", "sd")


def fund_replay(t: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """trades (d, zscore, spread_return, holding_days, short_sym) replayed under each profile: net fractions by exit date, kill switch.

    The trades meet five profiles; sums by profile and exit date come before the running product. days: the trading
    calendar (d). The Sharpe ratio and the annualised return count all its days up to the stop, with 0 where nothing
    exits; without a calendar they count exit days alone.
    """
    live = _fund_days(t)
    total = live.groupBy("profile").agg(
        F.sum("trades").alias("trades"), (F.max_by("value", "d") - 1).alias("total"), F.max("dd").alias("max_drawdown"), F.sum("cost").alias("cost"), F.try_divide(F.sum("wins"), F.sum("trades")).alias("win_rate"),
        F.when(F.sum("lost") > 0, F.sum("won") / F.sum("lost")).otherwise(0.0).alias("profit_factor"), F.first("stop").alias("stop"),
    )
    exits = live.select("profile", "d", "pnl")
    if days is not None:
        spans = days.select("d").distinct().crossJoin(F.broadcast(total.select("profile", "stop"))).where("stop is null or d <= stop")  # five rows
        exits = spans.join(exits, ["profile", "d"], "left").select("profile", "d", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))
    of = exits.groupBy("profile").agg(F.when(F.count("*") > 1, F.avg("pnl") / (F.stddev_pop("pnl") + 1e-10) * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), F.count("*").alias("days"))
    out = total.join(of, "profile", "left").withColumn("annualised", F.col("total") * 252 / F.greatest(F.col("days"), F.lit(1)))
    return out.select("profile", "trades", "total", "annualised", "max_drawdown", "cost", "win_rate", "profit_factor", "sharpe", "days", F.col("stop").isNotNull().alias("stopped"))


def losing_run(daily: DataFrame, low: float = -0.008, high: float = 0.003, most: int = 5) -> DataFrame:
    """Days of a counter that grows below `low`, goes back to 0 above `high`, and stops at `most`: gaps and islands."""
    w = W.orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    x = daily.withColumn("island", F.sum((F.col("pnl") > high).cast("int")).over(w))
    i = W.partitionBy("island").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn("run", F.sum((F.col("pnl") < low).cast("int")).over(i)).withColumn("stop", F.col("run") >= most).select("d", "pnl", "run", "stop")
