"""Readers, writers, and price panels made of the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thousandths(x: Column) -> Column:
    """Prices in thousandths, cut where averages of cents never lie, so that engines agree whatever their order of adding."""
    return F.floor(x * 1000 + 0.37) / 1000


def bars_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, d, close, volume: weekly average unit price of each brand."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("sym"), F.date_trunc("week", "l_shipdate").cast("date").alias("d")).agg(thousandths(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("close"), F.sum("l_quantity").alias("volume"))


def bars_event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, ts, open, high, low, close, volume of the events of each type and hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("sym"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("volume"))


def macro_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, vix: the daily average order price, scaled to what a volatility index looks like."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("x"))
    return o.select("d", thousandths(10 + F.pmod(F.col("x") / 100, F.lit(35.0))).alias("vix"))


def sector_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sym, sector, d, close: weekly average order price of each nation, its region as sector."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dims = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")  # 25 and 5 rows
    j = o.join(dims, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("n_name").alias("sym"), F.col("r_name").alias("sector"), F.date_trunc("week", "o_orderdate").cast("date").alias("d")).agg(thousandths(F.avg("o_totalprice")).alias("close"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic trade table in the shape of the simulation's output, one trade per order."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("trade_id"), F.to_date("o_orderdate").alias("d"), F.concat(F.lit("P"), F.pmod(F.col("o_custkey"), F.lit(40))).alias("pair"),
        F.when(F.pmod(k * 13, F.lit(7)) < 4, "LONG").otherwise("SHORT").alias("action"), ((F.pmod(k * 7919, F.lit(2001)) - 1000) / F.lit(20000.0)).alias("net_pnl_pct"),
        ((F.pmod(k * 7919, F.lit(2001)) - 1000) * F.lit(50.0)).alias("pnl_dollar"), (F.pmod(k * 31, F.lit(25)) + 1).cast("int").alias("holding_days"),
        (0.5 + F.pmod(k * 17, F.lit(501)) / F.lit(1000.0)).alias("strength"), (1.8 + F.pmod(k * 29, F.lit(1700)) / F.lit(1000.0)).alias("zscore"),
        (20 + F.pmod(k * 37, F.lit(180))).cast("double").alias("px_long"), (20 + F.pmod(k * 41, F.lit(180))).cast("double").alias("px_short"),
        F.element_at(F.array(*[F.lit(s) for s in ("AAPL", "IBM", "GOOGL", "BRK-B")]), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("short_sym"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, pnl: a daily return series in thousandths of a per cent."""
    return trades(spark, sf_dir).groupBy("d").agg((F.floor(F.avg("net_pnl_pct") * 100000 + 0.37) / 100000).alias("pnl"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Column `symbol` of a CSV list: a usual header name, else any column named like symbol or ticker, else the first."""
    df = spark.read.csv(path, header=True)
    usual = ("symbol", "ticker", "symbols", "tickers", "stock", "code")  # fixed values
    lower = {c.strip().lower(): c for c in df.columns}
    name = next((lower[u] for u in usual if u in lower), None) or next((c for k, c in lower.items() if "symbol" in k or "ticker" in k), df.columns[0])
    return df.select(F.col(f"`{name}`").alias("symbol"))


def write_json_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON line a section, written by Spark; each section must be a report of bounded size."""
    spark = next(iter(sections.values())).sparkSession
    rows = [(name, json.dumps([json.loads(x) for x in df.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]])) for name, df in sections.items()]
    spark.createDataFrame(rows, "section string, rows string").coalesce(1).write.mode("overwrite").json(path)
