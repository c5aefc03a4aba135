"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import durable, parts
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SALT = "_salt long"


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, but the first may be shorter."""
    first = n - limit * ((n - 1) // limit) if n else 0
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)] if n else []


def best_two_fit(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Packs counts[length] documents of each length; returns (lengths in a bin, number of such bins).

    A bin is filled greedily, the longest that fits first; then its smallest document gives way to the two
    unpacked ones that fit the expanded gap more tightly, if there are such. As a bin depends only on how many
    documents of each length are left, each bin is repeated while these counts allow it: the work depends on the
    number of lengths (at most `limit`), not on the number of documents.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        gap, items, now = limit, [], left.copy()
        while gap > 0 and (fits := np.flatnonzero(now[1 : gap + 1])).size:
            length = int(fits[-1]) + 1
            k = min(int(now[length]), gap // length)
            items += [length] * k
            now[length] -= k
            gap -= k * length
        if gap and len(items) > 1:
            small = items[-1]
            room = gap + small
            have = np.flatnonzero(now[1 : room + 1]) + 1
            if have.size:  # for each first length the longest second one that still fits
                at = np.searchsorted(have, room - have, side="right") - 1
                first, second = have[at >= 0], have[at[at >= 0]]
                alone = (first == second) & (now[first] < 2)
                lower = np.searchsorted(have, second) - 1
                second = np.where(alone, np.where(lower >= 0, have[lower], 0), second)
                total = np.where(second > 0, first + second, 0)
                if total.size and (best := int(total.argmax())) >= 0 and total[best] > small:
                    pair = [int(first[best]), int(second[best])]
                    items[-1:] = pair
                    now[small] += 1
                    now[pair[0]] -= 1
                    now[pair[1]] -= 1
        uses = left - now
        times = int((left[uses > 0] // uses[uses > 0]).min())
        left -= times * uses
        out.append((items, times))
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """Tokenises whole texts (null: empty) and cuts only what is longer than a sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        seen = 0
        for pdf in frames:
            got: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                got += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), limit))]
            out = pd.DataFrame(got, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["_salt"] = np.arange(seen, seen + len(out))
            seen += len(out)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, f"{PIECES}, {_SALT}")


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, limit: int = 1024) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole pieces are sequences of their own. Of the others only the counts by length, at most limit - 1 rows, come
    to the driver, which lays out bins with best_two_fit. A piece gets its rank among those of its length in two
    steps, by the counts of hashed groups and then within a group, so that one frequent length is spread, and so are
    repeated rows, by their number in the task that read them; ranks map
    to bins through a table of runs, whose size depends on `limit` alone. Null ids are kept, repeated rows are
    packed one by one, an empty text is the end id alone, and an empty table gives an empty table.
    """
    cut_up = durable(pieces(docs, tokenizer, end_id, limit), "pieces")
    groups = parts(cut_up.count(), 50_000, 16)
    cut_up = cut_up.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_salt"), F.lit(groups)).cast("int"))
    by_group = cut_up.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    counts = {int(r.length): int(r.n) for r in by_group.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    whole = counts.pop(limit, 0)
    runs, base, used = [(limit, 0, 0, 0)], whole, dict.fromkeys(counts, 0)
    for items, times in best_two_fit(counts, limit):
        at = 0
        for length in items:
            runs.append((length, used[length], base, at))
            used[length] += times
            at += length
        base += times
    runs.sort()
    table = np.array(runs, np.int64)
    key = table[:, 0] * (1 << 48) + table[:, 1]
    ahead = W.partitionBy("length").orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_group.select("length", "_g", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    ranked = cut_up.withColumn("_r", F.row_number().over(W.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32", "_salt")))
    ranked = ranked.join(offsets, ["length", "_g"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_ahead") + F.col("_r") - 1).alias("_rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(np.int64), pdf.pop("_rank").to_numpy(np.int64)
            run = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            pdf["sequence_id"] = table[run, 2] + rank - table[run, 1]
            pdf["offset"] = table[run, 3]
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf

    return ranked.mapInPandas(place, f"{PIECES}, sequence_id long, offset long")
