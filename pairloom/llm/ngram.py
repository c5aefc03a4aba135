"""Scores of documents under a bigram model by deleted interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, fold, mix64, parts, word_hashes

#: Bytes of text handled together, and bytes of text whose keys meet in one counting task.
CHUNK, COUNTED = 8 << 20, 8 << 20
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Steps of the grid for estimates in each power of two, for scores and for the counts that weights are learnt on, and
#: buckets of context frequency: 0, 1, 2-3, 4-7, ...
GRID, HELD_GRID, BUCKETS = 64, 8, 16


def widths(bits: int) -> dict[str, int]:
    """Bytes of a key next to the `bits` of its shard. Shards grow with the input, and so do whole keys, up to 63 bits."""
    return {"word": min(6, (63 - bits) // 8), "pair": min(5, (63 - bits) // 8)}


def _pack(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(blob: bytes, width: int, shard: int) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel().astype(np.uint64) | np.uint64(shard << (8 * width))


def _small(values: np.ndarray) -> bytes:
    """Numbers in a byte each; from 255 on in eight bytes more, at the end."""
    big = values >= 255
    return np.where(big, 255, values).astype(np.uint8).tobytes() + values[big].astype("<u8").tobytes()


def _unsmall(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u8", offset=n).astype(np.int64)
    return out


class Events:
    """Tokens of some texts: an end after each text's words, contexts beside them, keys of words and pairs."""

    def __init__(self, texts: list[str | None], bits: int):
        hashes, counts = word_hashes(texts)
        self.lens = counts + 1
        token = np.insert(hashes, np.cumsum(counts), END)
        before = np.concatenate([[START], token[:-1]]).astype(np.uint64)
        self.first = np.cumsum(self.lens) - self.lens
        before[self.first] = START
        pair = mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(token))
        self.keys = {kind: x >> np.uint64(64 - bits - 8 * widths(bits)[kind]) for kind, x in (("word", token), ("pair", pair))}


def _requests(chunk: int, texts: list, train: np.ndarray, bits: int) -> pd.DataFrame:
    """One row for each shard: the distinct keys of a chunk that belong there, with their counts in learning texts."""
    events = Events(texts, bits)
    learns = np.repeat(train, events.lens)
    rows = []
    for kind, width in widths(bits).items():
        keys, inverse = np.unique(events.keys[kind], return_inverse=True)
        counts = np.bincount(inverse, weights=learns, minlength=len(keys)).astype(np.int64)
        edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(8 * width))
        edges[-1] = len(keys)
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[shard], edges[shard + 1]
            rows.append((shard, kind, chunk, _pack(keys[lo:hi], width), _small(counts[lo:hi])))
    return pd.DataFrame(rows, columns=["shard", "kind", "chunk", "keys", "counts"])


def _answer(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """To each chunk, for its keys in its order: 0 if no other chunk holds the key, else 1 and its total. And the shard's sums."""
    shard, kind = int(pdf["shard"].iloc[0]), pdf["kind"].iloc[0]
    width = widths(bits)[kind]
    lens = np.array([len(b) // width for b in pdf["keys"]])
    keys = np.concatenate([_unpack(b, width, shard) for b in pdf["keys"]])
    counts = np.concatenate([_unsmall(c, n) for c, n in zip(pdf["counts"], lens, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    totals = np.add.reduceat(counts[order], starts)
    sizes = np.diff(np.append(starts, len(keys)))
    told = np.empty(len(keys), np.int64)
    told[order] = np.repeat(np.where(sizes > 1, totals + 1, 0), sizes)  # a chunk asks once for a key
    rows = [(int(c), kind, shard, _small(t), 0, 0) for c, t in zip(pdf["chunk"], np.split(told, np.cumsum(lens)[:-1]), strict=True)]
    rows.append((0, kind, -1, b"", int(totals.sum()), int((totals > 0).sum())))
    return pd.DataFrame(rows, columns=["chunk", "kind", "shard", "totals", "n", "v"])


def _code(ratio_log2: np.ndarray, least: int, grid: int) -> np.ndarray:
    """Code from 1 on of the nearest point of the grid."""
    return 1 + np.rint((np.maximum(ratio_log2, least) - least) * grid).astype(np.int64)


def _cells(c1: np.ndarray, c2: np.ndarray, ctx: np.ndarray, grid: int = GRID) -> np.ndarray:
    """bucket, coded pair estimate and coded word count in one number."""
    log = lambda x: np.log2(np.maximum(x, 1).astype(float))
    bucket = np.where(ctx > 0, np.minimum(1 + log(ctx).astype(np.int64), BUCKETS - 1), 0)
    pair = np.where((c2 > 0) & (ctx > 0), _code(log(c2) - log(ctx), -31, grid), 0)
    word = np.where(c1 > 0, np.minimum(_code(log(c1), 0, grid), 4095), 0)
    return (bucket << 23) | (pair << 12) | word


def estimates(cells: np.ndarray, n: float, v: float, grid: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Bucket, pair and word estimates of cells, and the uniform one."""
    pair, word = (cells >> 12) & 2047, cells & 4095
    p2 = np.where(pair > 0, 2.0 ** ((pair - 1) / grid - 31), 0.0)
    p1 = np.where(word > 0, 2.0 ** ((word - 1) / grid), 0.0) / max(n, 1.0)
    return cells >> 23, p2, p1, 1.0 / (v + 1.0)


def learn_weights(cells: np.ndarray, counts: np.ndarray, n: float, v: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket by expectation-maximisation on held-out counts."""
    bucket, p2, p1, p0 = estimates(cells, n, v, HELD_GRID)
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.9, 0.1]
    parts_ = np.stack([p2, p1, np.full(len(cells), p0)], axis=1)
    for b in range(BUCKETS):
        on = bucket == b
        if on.any():
            p, w = parts_[on], counts[on].astype(float)
            for _ in range(rounds):
                share = p * out[b]
                share /= share.sum(axis=1, keepdims=True)
                out[b] = np.maximum((share * w[:, None]).sum(axis=0) / w.sum(), 1e-6)
                out[b] /= out[b].sum()
    return out


def _events_of_chunk(docs: pd.DataFrame, answers: pd.DataFrame, chunk: int, bits: int) -> pd.DataFrame:
    out = []
    if chunk == 0:
        sums = answers[(answers["kind"] == "word") & (answers["shard"] < 0)]
        out.append(("sums", None, None, int(sums["n"].sum()), int(sums["v"].sum()), 0.0, [], []))
    if len(docs):
        events = Events(docs["text"].tolist(), bits)
        train = docs["train"].to_numpy(bool)
        learns = np.repeat(train, events.lens)
        inverse, total = {}, {}
        for kind, width in widths(bits).items():
            keys, inverse[kind] = np.unique(events.keys[kind], return_inverse=True)
            total[kind] = np.bincount(inverse[kind], weights=learns, minlength=len(keys)).astype(np.int64)
            told = answers[(answers["kind"] == kind) & (answers["shard"] >= 0)].sort_values("shard")
            edges = np.searchsorted(keys, np.append(told["shard"].to_numpy(np.uint64), np.uint64(1 << bits)) << np.uint64(8 * width))
            edges[-1] = len(keys)
            sums = np.concatenate([_unsmall(t, n) for t, n in zip(told["totals"], np.diff(edges), strict=True)])
            total[kind] = np.where(sums > 0, sums - 1, total[kind])
        c1, c2 = total["word"][inverse["word"]], total["pair"][inverse["pair"]]
        starts = total["word"][inverse["word"][events.first[0] + events.lens[0] - 1]]  # texts learnt from, as the end's count
        ctx = np.concatenate([[starts], c1[:-1]])
        ctx[events.first] = starts
        cells = _cells(c1, c2, ctx)
        logs = np.log10(c1 + 0.5)
        held: dict[int, int] = {}
        pieces = []
        for i, (doc_id, learnt, lo, n) in enumerate(zip(docs["doc_id"].tolist(), train.tolist(), events.first.tolist(), events.lens.tolist(), strict=True)):
            s = slice(lo, lo + n)
            doc = None if doc_id is None or doc_id != doc_id else int(doc_id)
            out.append(("doc", doc, not learnt, n, int((c1[s] > 0).sum()), float(logs[s].sum()), np.sort(cells[s]).astype(np.int32), []))
            if learnt:  # the text's own counts taken away: what the model would say had it not seen the text
                _, iw, nw = np.unique(inverse["word"][s], return_inverse=True, return_counts=True)
                _, ip, np_ = np.unique(inverse["pair"][s], return_inverse=True, return_counts=True)
                own = nw[iw]
                own_ctx = np.concatenate([[1], own[:-1]])
                pieces.append(_cells(c1[s] - own, c2[s] - np_[ip], ctx[s] - own_ctx, HELD_GRID))
            if pieces and (len(pieces) >= 2000 or i == len(docs) - 1):
                for cell, k in zip(*(x.tolist() for x in np.unique(np.concatenate(pieces), return_counts=True)), strict=True):
                    held[cell] = held.get(cell, 0) + k
                pieces = []
        if pieces:
            for cell, k in zip(*(x.tolist() for x in np.unique(np.concatenate(pieces), return_counts=True)), strict=True):
                held[cell] = held.get(cell, 0) + k
        out.append(("held", None, None, 0, 0, 0.0, np.array(list(held), np.int32), np.array(list(held.values()), np.int64)))
    frame = pd.DataFrame(out, columns=["kind", "doc_id", "held_out", "a", "b", "logs", "cells", "counts"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame["held_out"] = frame["held_out"].astype("boolean")
    return frame


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Learns from texts outside fold 1. Maximum-likelihood estimates of a word given the word before, of the word
    alone and a uniform one are mixed; weights depend on the bucket of the context's frequency and are learnt by
    expectation-maximisation on counts of learning texts from which each text's own counts are deleted. Estimates
    are kept to the nearest 64th of an octave, so that a text's events fit in few bytes: a token's score is within
    0.0024 of the unrounded one, above or below. For learning the weights an eighth of an octave does, which bounds
    the table of held-out counts, the only one that goes to the driver.

    Texts are dealt to chunks by id and place in the table, so that rows repeating an id or a text are spread. A chunk sends its distinct keys, with counts, to the shards of a hash; shards
    add them up and answer in a byte or so a key: its total, or that no other chunk holds it, so that its whole
    count is there. Frequent words cost one key a chunk, and no table of the model is ever in one place. Keys are hashes
    whose length grows with the number of shards. Null text: empty, just the end. Null ids: learnt from, kept.
    Repeated rows count one by one. An empty table gives an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, bits = parts(size, CHUNK), max(1, math.ceil(math.log2(parts(size, COUNTED))))
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")
    chunked = source.select("doc_id", "text", (fold("doc_id") != 1).alias("train"), place.alias("chunk")).repartition(chunks, "chunk")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[int, list] = {}
        train: dict[int, list] = {}
        for pdf in frames:
            for chunk, own in pdf.groupby("chunk"):
                texts.setdefault(int(chunk), []).extend(own["text"].tolist())
                train.setdefault(int(chunk), []).extend(own["train"].tolist())
        for chunk in sorted(texts):
            yield _requests(chunk, texts.pop(chunk), np.array(train.pop(chunk)), bits)

    asked = chunked.mapInPandas(ask, "shard int, kind string, chunk int, keys binary, counts binary")
    answers = asked.groupBy("shard", "kind").applyInPandas(lambda pdf: _answer(pdf, bits), "chunk int, kind string, shard int, totals binary, n long, v long")

    def events(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _events_of_chunk(left, right, int(key[0]), bits)

    seen = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(events, "kind string, doc_id long, held_out boolean, a long, b long, logs double, cells array<int>, counts array<long>")
    seen = durable(seen, "events", compression="zstd")
    sums = seen.where("kind = 'sums'").agg(F.sum("a"), F.sum("b")).first()
    n, v = float(sums[0] or 0), float(sums[1] or 0)
    pairs = F.explode(F.arrays_zip("cells", "counts")).alias("e")
    held = seen.where("kind = 'held'").select(pairs).groupBy(F.col("e.cells").alias("cell")).agg(F.sum("e.counts").alias("k")).toPandas().sort_values("cell")  # at most a row for each point of the grid
    weights = learn_weights(held["cell"].to_numpy(np.int64), held["k"].to_numpy(np.int64), n, v)
    norm = math.log10(n + 0.5 * (v + 1))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            cells = np.concatenate(pdf["cells"].tolist()).astype(np.int64)
            lens = pdf["cells"].map(len).to_numpy()
            grid, inverse = np.unique(cells, return_inverse=True)
            bucket, p2, p1, p0 = estimates(grid, n, v)
            w = weights[bucket]
            logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)[inverse]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"].astype(bool), "n_tokens": pdf["a"], "n_known": pdf["b"], "train_tokens": int(n),
                "base_score": pdf["logs"] - pdf["a"] * norm, "score": np.add.reduceat(logs, np.cumsum(lens) - lens),
            })

    return seen.where("kind = 'doc'").select("doc_id", "held_out", "a", "b", "logs", "cells").mapInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
