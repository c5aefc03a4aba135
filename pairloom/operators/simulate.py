"""Portfolio simulation: a candidate table made in parallel, and one ordered fold over what passed the state-free gates."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.config import CONFIG, EngineConfig
from pairloom.functions import numeric

from . import spread as SP
from .regime import as_of, hard_stop

PAIR = ("s1", "s2")
TRADES = "window int, signal_d date, d date, exit_d date, s1 string, s2 string, action string, position_pct double, strength double, zscore double, quality double, feature_quality double, spread_return double, gross_pnl_pct double, cost_pct double, net_pnl_pct double, pnl_dollar double, holding_days int"


def calendar(rows: DataFrame) -> DataFrame:
    """d, n, next_d: the dates of all rows, numbered, each with the one after it."""
    w = W.orderBy("d")  # as many rows as dates
    return rows.select("d").distinct().withColumn("n", F.row_number().over(w)).withColumn("next_d", F.lead("d").over(w))


def active(signals: DataFrame, schedule: DataFrame, day: str = "d") -> DataFrame:
    """The signals (s1, s2, day, ...) of pairs that the schedule (resel_date, s1, s2) has in force: of the latest selection at or before the day, else of the first."""
    dates = schedule.select(F.col("resel_date").alias("d"), F.col("resel_date").alias("_from")).distinct()
    first = F.broadcast(schedule.agg(F.min("resel_date").alias("_first")))  # one row
    days = as_of(signals.select(F.col(day).alias("d")).distinct().withColumn("sym", F.lit("")), dates, "_from").crossJoin(first).select(F.col("d").alias(day), F.coalesce("_from", "_first").alias("resel_date"))
    return signals.join(days, day).join(schedule.select("resel_date", *PAIR).distinct(), ["resel_date", *PAIR], "left_semi").drop("resel_date")


def _lock(config: EngineConfig) -> Callable[..., Column]:
    """What is locked at a signal: gates, mean, deviation and recent volatility of the spread at the signal's hedge ratio."""

    @F.pandas_udf("ok boolean, mu double, sd double, vol double")
    def lock(a: pd.Series, b: pd.Series, beta: pd.Series, bars: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, hedge, n in zip(a, b, beta, bars, strict=True):
            v = np.asarray(x, float)[-n:] - hedge * np.asarray(y, float)[-n:]
            if abs(y[-1]) <= 1e-4 or len(v) < 20:
                out.append((True, None, None, None))  # nothing to lock: the signal stands
                continue
            late = v[-60:]
            ok = not numeric.page_break(v) and numeric.roughness(v) <= config.max_roughness
            out.append((ok, late.mean(), max(late.std(), 1e-8), np.diff(v)[-10:].std(ddof=1)))
        return pd.DataFrame(out, columns=["ok", "mu", "sd", "vol"]).astype({"mu": float, "sd": float, "vol": float})

    return lock


def _history(sig: DataFrame, x: DataFrame, most: int = 90) -> DataFrame:
    """sig with a and b: logarithms of both legs over the last `most` bars of the pair, its own included.

    Bars are packed once, `most` to a block; a signal meets its own block, which carries the one before.
    """
    w = W.partitionBy(*PAIR).orderBy("_blk")
    log = lambda p: F.ln(F.greatest(p, F.lit(1e-8)))
    bars = x.select(*PAIR, F.floor(F.col("i") / most).alias("_blk"), F.struct(F.col("i").alias("i"), log("p1").alias("a"), log("p2").alias("b")).alias("_v"))
    packed = bars.groupBy(*PAIR, "_blk").agg(F.array_sort(F.collect_list("_v")).alias("_v"))  # no more than a block holds
    packed = packed.withColumn("_old", F.lag("_v").over(w)).withColumn("_v", F.when(F.col("_old").isNull(), F.col("_v")).otherwise(F.concat("_old", "_v"))).drop("_old")
    j = sig.withColumn("_blk", F.floor(F.col("i") / most)).join(packed, [*PAIR, "_blk"])
    j = j.withColumn("_v", F.filter("_v", lambda v: v["i"].between(F.col("i") - (most - 1), F.col("i"))))
    return j.withColumn("a", F.transform("_v", lambda v: v["a"])).withColumn("b", F.transform("_v", lambda v: v["b"])).drop("_v", "_blk")


def candidates(kalman: DataFrame, stats: DataFrame, config: EngineConfig = CONFIG, *, least: int = 50, schedule: DataFrame | None = None, scores: DataFrame | None = None, fills: DataFrame | None = None) -> DataFrame:
    """One row for each pair and signal day that passes the gates that need no portfolio state.

    kalman: (s1, s2, d, p1, p2, s, beta); stats: (s1, s2, half_life, score). Optional: schedule (resel_date, s1, s2) of
    pairs in force; scores (s1, s2, d, score) of the learned rank, 1 where absent; fills (s1, s2, d, f1, f2), prices at
    which orders fill in place of closes.
    Everything at a signal is known on its day: break and roughness gates look at the spread of the locked hedge ratio
    over three half-lives (30 to 90 bars). The fill is on the next date of the calendar and the exit search starts on
    the date after it, as a join on ordinals in blocks. A signal without a fill or an exit keeps its row, with nulls:
    it takes part in the ranking of its day.
    """
    w = W.partitionBy(*PAIR).orderBy("d")
    last60 = w.rowsBetween(-59, 0)
    x = SP.expanding_z(kalman.join(calendar(kalman), "d")).withColumn("i", F.row_number().over(w))
    if fills is None:
        x = x.withColumn("f1", F.col("p1")).withColumn("f2", F.col("p2"))
    else:
        x = x.join(fills.select(*PAIR, "d", "f1", "f2"), [*PAIR, "d"], "left")
    x = SP.rolling_correlation(x)
    sd60 = F.stddev_samp("s").over(last60)
    x = x.withColumn("m60", F.avg("s").over(last60)).withColumn("s60", F.when((F.col("i") >= 30) & (sd60 >= 1e-8), sd60))
    x = x.withColumn("ds", F.col("s") - F.lag("s").over(w)).withColumn("vol10", F.stddev_samp("ds").over(w.rowsBetween(-9, 0)))
    sig = x.where((F.col("i") >= least) & (F.col("corr") >= config.min_recent_correlation) & (F.abs("z") > config.entry_z))
    sig = SP.reference_window(sig.join(stats.where("score >= 0.4").select(*PAIR, "half_life", F.col("score").alias("quality")), list(PAIR)))
    if schedule is not None:
        sig = active(sig, schedule)
    if scores is None:
        sig = sig.withColumn("feature", F.lit(1.0))
    else:
        sig = sig.join(scores.select(*PAIR, "d", F.col("score").alias("feature")), [*PAIR, "d"], "left").withColumn("feature", F.coalesce("feature", F.lit(1.0)))
    sig = sig.withColumn("hold", F.greatest(F.lit(10), F.least(F.lit(25), F.floor(2.5 * F.col("half_life")))).cast("int"))
    sig = _history(sig, x).withColumn("lock", _lock(config)("a", "b", "beta", "window")).where("lock.ok")
    sig = sig.select(
        *PAIR, F.col("d").alias("signal_d"), F.col("n").alias("n0"), F.col("next_d").alias("fill_d"), "z", "quality", "feature", "hold", F.col("beta").alias("beta0"), F.col("lock.mu").alias("mu0"), F.col("lock.sd").alias("sd0"),
        F.coalesce((F.col("s") - F.col("lock.mu")) / F.col("lock.sd"), "z").alias("z0"), F.coalesce("lock.vol", "vol10").alias("sizer_vol"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("z") < 0).alias("long"),
    )
    block = 25
    bars = x.select(*PAIR, "d", "n", "p1", "p2", "f1", "f2", "m60", "s60").withColumn("blk", F.floor(F.col("n") / block))
    e = sig.withColumn("blk", F.explode(F.sequence(F.floor((F.col("n0") + 1) / block), F.floor((F.col("n0") + 1 + F.col("hold")) / block))))
    e, bars = e.alias("e"), bars.alias("b")
    met = (F.col("e.s1") == F.col("b.s1")) & (F.col("e.s2") == F.col("b.s2")) & (F.col("e.blk") == F.col("b.blk")) & F.col("n").between(F.col("n0") + 1, F.col("n0") + 1 + F.col("hold"))
    j = e.join(bars, met, "left").select("e.*", "d", "n", "p1", "p2", "f1", "f2", "m60", "s60").drop("blk")
    z = (F.ln(F.greatest("p1", F.lit(1e-8))) - F.col("beta0") * F.ln(F.greatest("p2", F.lit(1e-8))) - F.coalesce("mu0", "m60")) / F.coalesce("sd0", "s60")
    held = F.col("n") - F.col("n0") - 1
    rule = F.when(F.col("long"), (z > -config.exit_z) | (z - F.col("z0") > config.adverse_z)).otherwise((z < config.exit_z) | (F.col("z0") - z > config.adverse_z))
    out = (held >= 1) & z.isNotNull() & (rule | (held >= F.col("hold")))
    g = j.groupBy(*sig.columns).agg(F.min(F.when(held == 0, F.struct("f1", "f2"))).alias("fill"), F.min_by(F.when(out, F.struct("d", "f1", "f2")), F.when(out, F.col("n"))).alias("exit"))
    g = g.withColumn("px1", F.coalesce("fill.f1", "q1")).withColumn("px2", F.coalesce("fill.f2", "q2"))
    move = F.ln(F.col("exit.f1") / F.col("px1")) - F.ln(F.col("exit.f2") / F.col("px2"))
    return g.select(*PAIR, "signal_d", F.col("fill_d").alias("d"), F.col("exit.d").alias("exit_d"), "z", "quality", "feature", "long", F.least(F.lit(1.0), F.abs("z") / 2.5).alias("strength"), "sizer_vol", "px1", "px2", F.when(F.col("long"), move).otherwise(-move).alias("spread_return"))


def _scale(history: deque, value: float, start: float) -> float:
    vol = 1.0
    if len(history) >= 10:
        sd = float(np.std(list(history)[-20:])) * 252**0.5
        ratio = sd / 0.02
        vol = 1.0 if ratio <= 1 else 0.5 if ratio > 1.5 else max(0.5, 1 - (ratio - 1) * 0.5)
    gain = (value - start) / start
    profit = 1.0 if gain < 0.4 else 0.5 if gain >= 0.6 else max(0.5, 1 - (gain - 0.4) / 0.2 * 0.5)
    return min(vol, profit)


def _borrow(symbol: str) -> float:
    n, letters = len(symbol), symbol.isalpha()
    return 0.0005 if n <= 3 and letters else 0.0010 if n == 4 and letters else 0.02 if n >= 5 else 0.005


def _cost(half: float, p1: float, p2: float, short: str, days: int) -> float:
    side = sum(max(half * 0.15 * 0.6 / 1e4, 0.5) + min(0.3 * (half / (5e6 * p)) ** 0.5 * 1e4, 2.0) * half / 1e4 + half * 0.8 / 1e4 for p in (p1, p2))
    return 2 * side + half * _borrow(short) * days / 365 + 2 * half * 0.1 * 0.055 * days / 365


def fold(cand: pd.DataFrame, days: pd.DataFrame, config: EngineConfig = CONFIG, window: int = 0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The ordered part: one pass over the days. Returns trades and daily returns.

    days: (d, scale, stop) with every day of the calendar. A day's signals first pass what is known in the morning
    (legs locked by open trades, rest after losses, the risk rules with the size they would get); the best by strength
    times quality times learned score are picked, ties by pair; then each pick meets what the day's trades before it
    left (locks, exposure) and its costs. Dropped picks, and picks without a fill or an exit, are not replaced.
    """
    value = start = peak = config.capital
    due, release, locked = defaultdict(float), defaultdict(float), {}
    streak, rest, last = defaultdict(int), {}, {}
    history, outcomes, exposure, paused = deque(maxlen=100), deque(maxlen=50), 0.0, False
    trades, daily = [], []
    by_day = {d: g.sort_values(["s1", "s2"], kind="stable") for d, g in cand.groupby("signal_d")} if len(cand) else {}

    def size(c) -> float:
        form = 1.0
        if len(outcomes) > 5:
            share = sum(x > 0 for x in list(outcomes)[-5:]) / 5
            form = 0.7 if share < 0.3 else 1.3 if share > 0.7 else 1.0
        calm = 0.8 if c.sizer_vol > config.wild_volatility else 1.0
        part = config.base_size * min(0.7 + 0.6 * c.strength, 2.0) * min(0.8 + 0.4 * c.quality, 1.5) * form * calm
        return max(config.min_size, min(config.max_position, part)) * scale * min(abs(c.z) / 2.3, 2.0)

    def rests(pair, today) -> bool:
        if pair in rest and (today - rest[pair]).days >= config.rest_days:
            del rest[pair]
            streak.pop(pair, None)
        return pair in rest

    for day in days.sort_values("d").itertuples(index=False):
        today = due.pop(day.d, 0.0)
        exposure = max(0.0, exposure - release.pop(day.d, 0.0))
        scale = _scale(history, value, start) * day.scale
        locked = {s: d for s, d in locked.items() if d > day.d}
        picks = []
        if day.d in by_day and not day.stop:
            for c in by_day[day.d].itertuples(index=False):
                pair = (c.s1, c.s2)
                if c.s1 in locked or c.s2 in locked or rests(pair, day.d):
                    continue
                pct = size(c)
                weak = c.strength < config.min_strength or abs(c.z) < config.min_signal_z or c.quality < config.min_quality
                soon = pair in last and (day.d - last[pair]).days < 1
                if not (paused or weak or soon or pct > config.max_position or exposure + pct > config.max_exposure):
                    picks.append((c, pct))
            picks.sort(key=lambda p: -p[0].strength * p[0].quality * p[0].feature)
        count = 0
        for c, pct in picks[: config.max_daily_trades]:
            pair = (c.s1, c.s2)
            if c.s1 in locked or c.s2 in locked or pd.isna(c.d) or pd.isna(c.exit_d) or exposure + pct > config.max_exposure:
                continue
            held = max(1, (c.exit_d - c.d).days)
            cost = _cost(pct * value / 2, c.px1, c.px2, c.s2 if c.long else c.s1, held) / value
            if cost > config.max_cost:
                continue
            gross = c.spread_return * pct / 2
            net = gross - cost
            trades.append((window, day.d, c.d, c.exit_d, c.s1, c.s2, "LONG" if c.long else "SHORT", pct, c.strength, c.z, c.quality, c.feature, c.spread_return, gross, cost, net, net * value, held))
            streak[pair] = streak[pair] + 1 if net < 0 else 0
            if streak[pair] >= config.losses_to_rest:
                rest[pair] = day.d
            elif net >= 0:
                rest.pop(pair, None)
            due[c.exit_d] += net
            release[c.exit_d] += pct
            exposure += pct
            locked[c.s1] = locked[c.s2] = c.exit_d
            last[pair] = day.d
            outcomes.append(net)
            count += 1
        value *= 1 + today
        daily.append((window, day.d, today, value, count, exposure))
        history.append(today)
        peak = max(peak, value)
        paused = today < -config.pause_loss
        if (peak - value) / peak >= config.stop_drawdown or today < -config.stop_day_loss or exposure > config.max_exposure:
            break
    columns = [c.split()[0] for c in TRADES.split(", ")]
    return pd.DataFrame(trades, columns=columns), pd.DataFrame(daily, columns=["window", "d", "pnl", "value", "trades", "exposure"])


DAILY = "window int, d date, pnl double, value double, trades int, exposure double"
BOTH = f"kind string, {TRADES}, pnl double, value double, day_trades int, exposure double"


def simulate(cand: DataFrame, days: DataFrame, windows: DataFrame | None = None, *, result: str = "trades", config: EngineConfig = CONFIG) -> DataFrame:
    """Trades, daily results, or both as rows of a kind from one fold (see split). With windows (window, test_start, test_end) each runs apart, in parallel, from a fresh state.

    days: (d, scale). One fold a window sees only its candidates, a few rows a day: the state is sequential, the rest is
    not. The hard stop counts days of the window; fills and exits beyond its end do not happen.
    """
    if windows is None:
        windows = days.agg(F.lit(0).alias("window"), F.min("d").alias("test_start"), F.max("d").alias("test_end"))
    span = F.broadcast(windows.select("window", "test_start", "test_end"))  # a row a quarter
    c = cand.join(span, F.col("signal_d").between(F.col("test_start"), F.col("test_end")))
    c = c.withColumns({k: F.when(F.col(k) <= F.col("test_end"), F.col(k)) for k in ("d", "exit_d")}).drop("test_start", "test_end")
    d = days.select("d", "scale").join(span, F.col("d").between(F.col("test_start"), F.col("test_end"))).drop("test_start", "test_end")
    d = hard_stop(d, config.stop_days, config.stop_share, by=("window",))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = fold(a, b, config, int(b["window"].iloc[0])) if len(b) else fold(a.head(0), b, config)
        if result != "both":
            return found[result == "daily"]
        out = pd.concat([x.assign(kind=k) for k, x in zip(("trade", "day"), found, strict=True) if len(x)] or [pd.DataFrame()])
        out = out.rename(columns={"trades": "day_trades"}).reindex(columns=[x.split()[0] for x in BOTH.split(", ")]).astype({"holding_days": "Int64", "day_trades": "Int64"})
        named = [x.split()[0] for x in BOTH.split(", ") if x.split()[1] in ("date", "string")]
        out[named] = out[named].astype(object).where(out[named].notna(), None)
        return out

    c, d = c.toDF(*c.columns), d.toDF(*d.columns)  # both come from one calendar
    return c.groupBy("window").cogroup(d.groupBy("window")).applyInPandas(run, {"trades": TRADES, "daily": DAILY, "both": BOTH}[result])


def split(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trades and daily results of simulate(..., result="both")."""
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    trades, days = both.where("kind = 'trade'").select(*names(TRADES)), both.where("kind = 'day'").withColumnRenamed("day_trades", "trades")
    return trades, days.select(*names(DAILY))
