"""Connected components: forests of groups of edges first, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, parts, release

#: Edges that a task joins up by itself.
GROUP = 250_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges but the smallest of its component, beside that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _joined_up(edges: DataFrame, groups: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64))
        return pd.DataFrame({"u": u, "v": v})

    return edges.groupBy(F.pmod(F.xxhash64("u", "v"), F.lit(groups))).applyInPandas(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, *, group: int = GROUP, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of `edges`, two long columns u and v; label is the smallest node reachable.

    Loops, repeated and reversed edges are fine; null ends are left out; no edges give no rows. `edges` is read twice,
    so what is dear to make comes as a table. Edges are dealt over groups by hash, at most about `group` in one, and each group becomes a forest of stars; if there is but one group
    that is the answer. Otherwise rounds of star steps follow, each written to the shared folder, until the edges, as
    a set, stay as they were, so the number of rounds grows with the logarithm of the longest path.
    """
    given = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v")
    groups = parts(given.count(), group)
    e = durable(_joined_up(given, groups), "forest")
    before = None
    for _ in range(most_rounds if groups > 1 else 0):
        last, e = e, durable(_small_star(_large_star(e)), "star")
        release(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        if groups > 1:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
