"""What the two vector searches share: clean rows, and queries met with rows block by block."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v), one row an id, of the rows that take part: an id and a vector of finite numbers.

    Of rows that repeat an id the one of the least vector (by its first component that differs) stands for all. Where
    lengths differ, the most frequent one takes part, the greater of equals.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def usual(rows: DataFrame) -> tuple[int, int]:
    """Rows of the most frequent length, and that length. A row a length comes to the driver."""
    return max(((r.n, r.w) for r in rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()), default=(0, 0))


def meet(rows: DataFrame, queries: DataFrame, groups: int, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs `run` on each shard of rows (column shard) with each group of the queries sent to it (columns shard, query_id).

    Neither side is ever whole in a task: rows come a shard at a time, queries in `groups` hashed groups.
    """
    g = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    left = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("g", g)

    def both(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return run(r, q) if len(r) and len(q) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return left.groupBy("shard", "g").cogroup(right.groupBy("shard", "g")).applyInPandas(both, schema)


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The k best of each query, ties to the smaller id; `found` holds a few rows of each query and shard."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
