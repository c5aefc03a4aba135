"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, parts
from .vectors import best, clean, meet, usual

#: Tables, projections of each, the width of a cell in deviations of the projection, and cells kept along a
#: projection (the outer two take what lies beyond).
TABLES, PROJECTIONS, WIDTH, CELLS = 2, 6, 2.0, 6
#: A query visits the buckets of a table that have rows, likeliest first, until a neighbour is among them with this
#: probability and they hold AT_LEAST rows for each one asked for. With 1 it visits all: the result is exact.
SUCCESS, AT_LEAST = 0.72, 8
#: The index is fitted on at most so many rows, those of the smallest hashed ids; every row is indexed.
FITTED_ON = 4_096
SHARD, GROUP = 8_192, 1_024


def _phi(z: np.ndarray) -> np.ndarray:
    """Normal distribution function to about 1e-7 (a fixed rational approximation of erfc)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = -x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    tail = t * np.exp(poly) / 2
    return np.where(z > 0, 1 - tail, tail)


class Index:
    """Projections and cell widths. Rows get one more component that makes all lengths equal, so that the nearest
    by distance are those of the largest inner product."""

    def __init__(self, sample: np.ndarray, longest: float, count: int, k: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest, self.mean = longest, 0.0
        self.mean = self.lift(sample).mean(axis=0) if len(sample) else np.zeros(sample.shape[1] + 1)
        s = self.lift(sample)
        self.a = rng.normal(size=(TABLES, s.shape[1], PROJECTIONS))
        flat = np.einsum("nd,tdk->ntk", s, self.a)
        self.width = WIDTH * np.maximum(flat.std(axis=0), 1e-9) if len(s) else np.ones((TABLES, PROJECTIONS))
        self.shift = rng.random((TABLES, PROJECTIONS))
        self.sample = s
        self.near = max(1, math.ceil(k * len(s) / max(1, count)))

    def expected(self, aimed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where projections of a query's neighbours fall: a share of the query's own, and a deviation around it.

        A row is a multiple of the query and a rest at right angles to it, whose Gaussian projection has the rest's
        length as deviation. Both come from rows of the sample about as near as the k-th of all would be.
        """
        d = (aimed**2).sum(1)[:, None] + (self.sample**2).sum(1) - 2 * aimed @ self.sample.T
        lo, hi = min(self.near, d.shape[1] - 1), min(self.near + 5, d.shape[1])
        rows = self.sample[np.argpartition(d, np.arange(lo, hi), axis=1)[:, lo:hi]]
        share = np.einsum("nkd,nd->nk", rows, aimed) / np.maximum((aimed**2).sum(1), 1e-300)[:, None]
        rest = ((rows - share[:, :, None] * aimed[:, None]) ** 2).sum(axis=2)
        return share.mean(axis=1), np.sqrt(rest.mean(axis=1))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))[:, None]], axis=1) - self.mean

    def aim(self, q: np.ndarray) -> np.ndarray:
        """Queries stretched to the rows' common length, which changes no order of inner products."""
        norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
        return np.concatenate([q * (self.longest / np.maximum(norm, 1e-300)), np.zeros((len(q), 1))], axis=1) - self.mean

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each row in each table."""
        h = np.floor(np.einsum("nd,tdk->ntk", self.lift(x), self.a) / self.width + self.shift).astype(np.int64)
        return (np.clip(h + CELLS // 2, 0, CELLS - 1) * CELLS ** np.arange(PROJECTIONS)).sum(axis=2)

    def visits(self, q: np.ndarray, occupied: list[tuple[np.ndarray, np.ndarray]], rows: int, success: float) -> list[np.ndarray]:
        """For each table, which of its occupied buckets (numbers and counts) each query visits.

        A bucket is the query's own with some of its cells moved. Its estimated success is the probability that a
        neighbour's projections fall in all of its cells. Buckets are visited in that order.
        """
        aimed = self.aim(q)
        share, rest = self.expected(aimed)
        edges = np.arange(CELLS + 1) - CELLS // 2.0
        edges[0], edges[-1] = -np.inf, np.inf
        out = []
        for t, (numbers, counts) in enumerate(occupied):
            f = (aimed * share[:, None]) @ self.a[t] / self.width[t] + self.shift[t]
            spread = np.maximum(rest[:, None] / self.width[t], 1e-6)
            cdf = _phi(np.clip((edges - f[..., None]) / spread[..., None], -30, 30))
            log = np.log(np.maximum(np.diff(cdf, axis=-1), 1e-30))  # query, projection, cell along it
            along = numbers[:, None] // CELLS ** np.arange(PROJECTIONS) % CELLS
            total = np.zeros((len(q), len(numbers)))
            for j in range(PROJECTIONS):
                total += log[:, j][:, along[:, j]]
            order = np.argsort(-total, axis=1, kind="stable")
            found = np.cumsum(np.take_along_axis(np.exp(total), order, 1), axis=1)
            seen = np.cumsum(counts[order], axis=1)
            before = lambda x: np.concatenate([np.zeros((len(q), 1)), x[:, :-1]], axis=1)
            on = (before(found) < success) | (before(seen) < rows) | (success >= 1)
            mask = np.zeros(on.shape, bool)
            np.put_along_axis(mask, order, on, 1)
            out.append(mask)
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _search(r: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query among the rows of the buckets it visits. Equal vectors are scored once."""
    x, queries = _matrix(r["v"]), _matrix(q["q"])
    ids, cell, own = r["vec_id"].to_numpy(), r["cell"].to_numpy(), q["query_id"].to_numpy()
    order = np.lexsort((ids, cell))
    x, ids, cell = x[order], ids[order], cell[order]
    same = np.concatenate([np.ascontiguousarray(x), cell[:, None].astype(float)], axis=1)
    _, first, inverse = np.unique(same.view(np.dtype((np.void, same.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(inverse, kind="stable")
    ends = np.cumsum(np.bincount(inverse))
    ux, ucell = x[first], cell[first]
    visited = {c: [] for c in set(ucell.tolist())}
    for i, cells in enumerate(q["cells"]):
        for c in cells:
            if c in visited:
                visited[c].append(i)
    score = np.full((len(queries), len(ux)), -np.inf)
    for c, which in visited.items():
        if which:
            cols = np.flatnonzero(ucell == c)
            score[np.ix_(which, cols)] = queries[which] @ ux[cols].T
    out = []
    take = min(k + 1, score.shape[1])
    near = np.argpartition(-score, take - 1, axis=1)[:, :take]
    for i in range(len(queries)):
        kth = score[i, near[i]].min()
        cols = near[i] if kth == -np.inf else np.flatnonzero(score[i] >= kth - 1e-9 * max(1.0, abs(kth)))
        cols = cols[score[i, cols] > -np.inf]
        exact = (ux[cols] * queries[i]).sum(axis=1)
        got = [(s, v) for s, u in zip(exact.tolist(), cols.tolist(), strict=True) for v in ids[members[(ends[u - 1] if u else 0) : ends[u]][: k + 1]].tolist() if v != own[i]]
        got.sort(key=lambda t: (-t[0], t[1]))
        out += [(int(own[i]), v, s) for s, v in got[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def neighbours(table: DataFrame, k: int = 20, every: int = 20, *, success: float = SUCCESS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of the largest inner product found for each query (ids divisible by `every`): query_id, rank, vec_id, score.

    Each table hashes a row to a bucket by Gaussian (2-stable) projections, shifted and cut into cells of one width. A
    query orders the occupied buckets, its own and those some cells away, by the probability that a neighbour as near
    as its own in the sample falls in, and visits the likeliest until `success` (with 1 all: the exact result).
    Buckets of few rows share a shard, those of many are split over several by hash, so a bucket holding a third of
    all rows is searched whole and spread. The rows found in any table are ranked by their exact inner product. There
    are at most CELLS ** PROJECTIONS buckets a table, whatever the data, so their counts can go to the driver.
    Null and zero vectors, ones with null or non-finite numbers, and null ids take no part; rows that repeat an id
    are one row, that of the least vector; ties go to smaller ids; an empty table gives an empty table.
    """
    rows = durable(clean(table, id_col, vector_col).where(F.exists("v", lambda x: x != 0)), "vectors")
    count, width = usual(rows)
    rows = rows.where(F.size("v") == width)
    longest = rows.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FITTED_ON).toPandas().sort_values("vec_id", kind="stable")
    index = Index(_matrix(sample["v"]).reshape(-1, width or 1), float(longest or 0), count, k)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            c = index.cells(_matrix(pdf["v"])) if len(pdf) else np.zeros((0, TABLES), np.int64)
            for t in range(TABLES):
                yield pdf.assign(t=t, cell=c[:, t])

    stored = durable(rows.mapInPandas(hashed, "vec_id long, v array<double>, t int, cell long"), "buckets")
    sizes = {(r.t, r.cell): r.n for r in stored.groupBy("t", "cell").agg(F.count("*").alias("n")).collect()}  # at most TABLES * CELLS ** PROJECTIONS
    shard, room, table_before, placed = -1, 0, None, []
    for (t, cell), n in sorted(sizes.items()):
        if t != table_before:  # a shard holds buckets of one table, hence a row once
            room, table_before = 0, t
        if n > SHARD:
            blocks = parts(n, SHARD)
            placed.append((t, cell, shard + 1, blocks))
            shard, room = shard + blocks, 0
        else:
            if n > room:
                shard, room = shard + 1, SHARD
            placed.append((t, cell, shard, 1))
            room -= n
    where: dict[int, list[list]] = {t: [] for t in range(TABLES)}
    for t, cell, first, blocks in placed:
        where[t].append([cell, first, blocks])
    occupied = [(np.array([c for c, _, _ in where[t]], np.int64), np.array([sizes[t, c] for c, _, _ in where[t]], np.int64)) for t in range(TABLES)]
    spark = table.sparkSession
    plan = spark.createDataFrame(placed or [(0, 0, 0, 1)], "t int, cell long, first int, blocks int")
    sharded = stored.join(F.broadcast(plan), ["t", "cell"]).select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int").alias("shard"))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                visits = index.visits(_matrix(part["v"]), occupied, AT_LEAST * (k + 1), success)
                out = []
                for i, (query, v) in enumerate(zip(part["vec_id"], part["v"], strict=True)):
                    to: dict[int, list[int]] = {}
                    for t in range(TABLES if success < 1 else 1):
                        for at in np.flatnonzero(visits[t][i]).tolist():
                            cell, first, blocks = where[t][at]
                            for s in range(first, first + blocks):
                                to.setdefault(s, []).append(cell)
                    out += [(query, v, s, cells) for s, cells in to.items()]
                yield pd.DataFrame(out, columns=["query_id", "q", "shard", "cells"])

    queries = rows.where(F.col("vec_id") % every == 0).mapInPandas(send, "query_id long, q array<double>, shard int, cells array<long>")
    found = meet(sharded, queries, parts(count // every, GROUP), lambda r, q: _search(r, q, k), "query_id long, vec_id long, score double")
    return best(found.dropDuplicates(["query_id", "vec_id"]), k, F.col("score"))
