"""Exact top-k inner products of integer vectors by MaxScore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, parts
from .vectors import best, clean, meet, usual

#: Rows of a shard, queries met with it at a time, rows between two updates of the threshold.
SHARD, GROUP, STEP = 16_384, 1_024, 2_048


class Shard:
    """Postings of a shard by component: the impact of a row above the component's least value, or below its greatest.

    A query's component of either sign then has only contributions of 0 and more, from 0 to its score bound, next
    to a constant; so bounds hold for vectors with negative components too.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        x = x[order].astype(np.float64)
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.above, self.below = np.ascontiguousarray((x - self.low).T), np.ascontiguousarray((self.high - x).T)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but `own`, ties to smaller ids."""
        q = query.astype(np.float64)
        constant = float(np.where(q > 0, q * self.low, q * self.high).sum())
        terms = np.flatnonzero(q)
        bounds = np.abs(q[terms]) * (self.high - self.low)[terms]
        order = np.argsort(bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        below = np.concatenate([[0.0], np.cumsum(bounds)])  # below[i]: what the i terms of least bounds can add
        found: list[tuple[float, int]] = []
        least = -np.inf
        for lo in range(0, len(self.ids), STEP):
            hi = min(lo + STEP, len(self.ids))
            split = int(np.searchsorted(below, least - constant, side="right")) - 1 if least > -np.inf else 0
            split = min(max(split, 0), len(terms))  # terms before it are non-essential: alone they can't beat the threshold
            alive = np.arange(lo, hi)
            score = np.full(hi - lo, constant)
            for t in terms[split:]:
                score += abs(q[t]) * (self.above if q[t] > 0 else self.below)[t, lo:hi]
            for at in range(split - 1, -1, -1):
                if at % 4 == 3 or at == split - 1:
                    on = score + below[at + 1] > least
                    if not on.all():
                        alive, score = alive[on], score[on]
                    if not len(alive):
                        break
                t = terms[at]
                score = score + abs(q[t]) * (self.above if q[t] > 0 else self.below)[t, alive]
            on = (score > least) & (self.ids[alive] != own)
            alive, score = alive[on], score[on]
            if len(alive) > k:  # a stable sort leaves ties in id order
                keep = np.argsort(-score, kind="stable")[:k]
                alive, score = alive[keep], score[keep]
            found = sorted(found + list(zip((-score).tolist(), self.ids[alive].tolist(), strict=True)))[:k]
            if len(found) == k:
                least = -found[-1][0]
        return [(round(-s), i) for s, i in found]


def top_inner(table: DataFrame, k: int = 5, every: int = 50, *, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each query (ids divisible by `every`) with all other rows.

    Components become floor(factor * x). Each shard of rows holds inverted lists by component; a query's components
    are its terms, split at the running threshold into essential ones, which are traversed, and non-essential
    ones, which are probed for rows that may still get in. Shards' results are merged. Returns query_id, rank,
    vec_id, score; fewer rows for a query if there are fewer. Null vectors and ones that hold null or non-finite
    numbers take no part, nor do null ids; rows that repeat an id, queries or candidates, are one row, that of the
    least vector; ties go to smaller ids; an empty table gives an empty table.
    """
    rows = durable(clean(table, id_col, vector_col).select("vec_id", F.transform("v", lambda x: F.floor(x * factor).cast("long")).alias("v")), "vectors")
    count, width = usual(rows)
    rows = rows.where(F.size("v") == width)
    shards = parts(count, SHARD)
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(r["vec_id"].to_numpy(), np.array(r["v"].tolist()))
        got = [(i, v, s) for i, x in zip(q["query_id"].tolist(), q["q"], strict=True) for s, v in shard.top(np.asarray(x), i, k)]
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = meet(sharded, queries, parts(count // every, GROUP), run, "query_id long, vec_id long, score long")
    return best(found, k, F.col("score"))


#: The same as one DuckDB statement.
ORACLE_SQL = """
with u as (select vec_id, min(embedding) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
v as (select vec_id, list_transform(e, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c from u
      where len(e) = (select len(e) from u group by 1 order by count(*) desc, 1 desc limit 1)),
p as (select q.vec_id as query_id, d.vec_id,
             cast(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) as bigint) as score
      from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from p qualify rank <= 5
"""
