"""The whole research run: select, spread, schedule, simulate, validate, measure, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.config import CONFIG, EngineConfig
from pairloom.operators import baselines, pairs, regime, reports, scorer, significance, simulate, spread
from pairloom.sources.panels import write_json_report


def run_system(bars: DataFrame, macro: DataFrame, sectors: DataFrame, train_end: str, *, config: EngineConfig = CONFIG, train: int = 252, test: int = 63, tests: bool = True, out: str | None = None) -> dict[str, DataFrame]:
    """bars (sym, d, close, volume), macro (d, vix), sectors (sym, d, close). Tables by name, lazy but for what `tests`
    adds, the tests of the returns; `out` also writes the bounded ones as JSON.

    Pairs are selected on bars up to train_end and traded after it while the schedule of re-selections has them; the
    walk-forward windows trade every pair that was ever scheduled; those whose test starts after train_end are marked
    selection_clean, and they alone make the out-of-sample series and tests. With config.learned_rank a day's signals are also
    ranked by what a model learnt from spreads up to train_end, in a window up to the end of its own training period.
    """
    until = F.lit(train_end).cast("date")
    early = bars.where(F.col("d") <= until)
    early = early.join(pairs.universe(early, config), "sym", "left_semi")
    # small next to the bars and read by every later table; a lost executor's part is made again from its lineage
    screened = pairs.screen(early, config).persist()
    picked = pairs.select_pairs(early, config, screened=screened).persist()
    kalman = spread.kalman_spread(pairs.align_pairs(bars, picked))
    schedule = pairs.pair_schedule(bars, picked, every=config.reselect_every).persist()
    z = regime.dispersion_z(sectors).where("z is not null")
    market = bars.select("d").distinct().withColumn("sym", F.lit(""))
    state = regime.as_of(regime.as_of(market, macro, "vix"), z, "z").select("d", regime.regime_scale(F.coalesce("vix", F.lit(18.0)), F.coalesce("z", F.lit(0.0))).alias("scale"))
    windows = reports.walk_windows(state, train, test).withColumn("selection_clean", F.col("test_start") > until)
    scores = learned_scores(kalman, train_end) if config.learned_rank else None
    signals = simulate.candidates(kalman, picked, config, scores=scores).persist()
    cand = simulate.active(signals, schedule, "signal_d").where(F.col("signal_d") > until)
    again = simulate.candidates(kalman, picked, config, scores=window_scores(kalman, windows)) if config.learned_rank else signals
    ever = again.join(schedule.select("s1", "s2").distinct(), ["s1", "s2"], "left_semi")
    trades, daily = simulate.split(simulate.simulate(cand, state.where(F.col("d") > until), result="both", config=config).persist())
    walked = simulate.simulate(ever, state, windows, result="daily", config=config).persist()
    returns = reports.window_returns(walked.select("d", "pnl"), windows).persist()
    oos = reports.stitched(walked, windows, train_end)
    shaped = trades.withColumn("pair", F.concat_ws("-", "s1", "s2")).withColumn("trade_id", F.xxhash64("s1", "s2", "signal_d")).withColumn("short_sym", F.when(F.col("action") == "LONG", F.col("s2")).otherwise(F.col("s1")))
    known = early.select("sym").distinct()
    same = bars.join(known, "sym", "left_semi")
    clean = lambda: [r.total for r in returns.join(F.broadcast(windows.where("selection_clean").select("window")), "window", "left_semi").orderBy("window").collect()]  # a value a quarter
    found = {
        "pairs": picked, "trades": trades, "daily": daily, "summary": reports.trade_summary(trades), "backtest": reports.backtest_summary(daily.select("d", "pnl")), "run": reports.run_summary(daily.select("d", "pnl"), trades, config.capital),
        "by_action": reports.by_category(trades, ["LONG", "SHORT"], F.col("action")), "monthly": reports.monthly(daily.select("d", "pnl")), "pair_performance": reports.pair_performance(shaped),
        "windows": windows.join(returns.drop("test_start"), "window", "left"), "walk_forward": reports.walk_summary(returns), "fund_replay": reports.fund_replay(shaped, daily.select("d")),
        "hac": significance.hac_t(daily.select("d", "pnl")), "fdr": pairs.fdr(screened, picked),
        "baseline": baselines.distance_baseline(same, train_end), "random": baselines.random_control(same, train_end),
    }
    if tests:
        found["significance"] = significance.report(daily.select("d", "pnl"), oos, clean())
    if out:
        write_json_report({k: found[k] for k in found if k not in ("pairs", "trades", "daily", "pair_performance")}, out)
    return found


def no_leak(rows: DataFrame, end: str) -> DataFrame:
    """rows, if none is later than `end`; raises otherwise."""
    late = rows.where(F.col("d") > F.lit(end).cast("date")).select("d").first()
    if late:
        raise ValueError(f"training data reaches {late.d}, beyond {end}")
    return rows


def window_scores(kalman: DataFrame, windows: DataFrame) -> DataFrame:
    """learned_scores of each walk-forward window, learnt up to its train_end and given for its test period."""
    out = None
    for w in windows.orderBy("window").collect():  # a row a quarter
        part = learned_scores(kalman, str(w.train_end)).where(F.col("d").between(F.lit(w.test_start), F.lit(w.test_end)))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else kalman.select("s1", "s2", "d", F.lit(1.0).alias("score")).limit(0)


def learned_scores(kalman: DataFrame, train_end: str) -> DataFrame:
    """s1, s2, d, score: how likely the spread returns, scaled and learnt on the days up to train_end."""
    columns = ["mean_5", "mean_10", "std_5", "std_10", "from_ma_5", "from_ma_20", "mom_20"]
    rows = spread.features(kalman).na.drop()
    early = kalman.where(F.col("d") <= F.lit(train_end).cast("date"))
    known = rows.where(F.col("d") <= F.lit(train_end).cast("date"))
    train = no_leak(spread.outcomes(early).where("abs(z) < 3").join(known, ["s1", "s2", "d"]), train_end)
    return scorer.rank_signals(scorer.robust_scale(train, columns, known), scorer.robust_scale(rows, columns, known), columns).select("s1", "s2", "d", "score")


def measures(section: str, df: DataFrame) -> DataFrame:
    """section, measure, value of the numbers of a one-row table."""
    numbers = [c for c, kind in df.dtypes if kind in ("double", "bigint", "int")]
    one = df.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    return one.unpivot([], numbers, "measure", "value").select(F.lit(section).alias("section"), "measure", "value")


def longest_windows(schedule: DataFrame) -> DataFrame:
    """Of a pair's windows (s1, s2, resel_date, bars) the longest, the earliest of equals."""
    from pyspark.sql import Window as W

    w = W.partitionBy("s1", "s2").orderBy(F.desc("bars"), "resel_date")
    return schedule.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def parse_log(lines: DataFrame) -> DataFrame:
    """Metrics scraped from text lines (column value): total return, Sharpe, trades, each by its own pattern."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    found = {k: F.regexp_extract("value", rf"(?i){name}\D*?{number}", 1) for k, name in (("total_return", "total return"), ("sharpe", "sharpe"), ("trades", "total trades"))}
    out = lines.select(*[F.nullif(v, F.lit("")).cast("double").alias(k) for k, v in found.items()])
    return out.where(F.coalesce(*out.columns).isNotNull())
