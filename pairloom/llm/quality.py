"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, text_batches, word_hashes

#: At most so many labelled rows are learnt from, those of the smallest hashed ids, and so many pairs of them.
MOST_LABELLED, PAIRS = 20_000, 200_000
#: Scores from here on count as good.
CUT = 0.3

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\v\f\r", b"\n", b"!", b"|", b"*$&%#", b".,;:?'\"()-"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 10
_NAMES = ("upper", "lower", "digit", "blank", "line", "bang", "bar", "symbol", "punct", "beyond")


def features(texts: list[str | None]) -> np.ndarray:
    """A row of numbers for each whole text: shares of characters, repetition of words, lengths."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    lens = np.array([len(r) for r in raw])
    starts = np.cumsum(lens) - lens
    chars = np.stack([np.add.reduceat(data == c, starts, dtype=np.int64) for c in range(1, 11)], axis=1) if len(raw) else np.zeros((0, 10), np.int64)
    hashes, counts = word_hashes(texts)
    rep = np.zeros((len(texts), 4))
    at = 0
    for i, n in enumerate(counts.tolist()):
        if n:
            h = hashes[at : at + n]
            _, c = np.unique(h, return_counts=True)
            two = np.unique(h[1:] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-1])
            rep[i] = (h[1:] == h[:-1]).sum() / n, 1 - len(c) / n, c.max() / n if n > 20 else 0, 1 - len(two) / max(1, n - 1)
        at += n
    share = chars / lens[:, None]
    words = np.maximum(counts, 1)
    length = np.log1p(counts)
    # what is clearly there counts almost as much in small amounts as in large ones
    soft = np.concatenate([share, rep], axis=1)
    extra = np.stack([length, length**2, (lens - 1) / words / 10, np.minimum(counts, 10) / 10, rep[:, 1] / np.maximum(length, 1), chars[:, 8] / words, chars[:, 4] / words], axis=1)
    return np.concatenate([soft, np.sqrt(soft), np.minimum(1, soft * 30), extra], axis=1)


@dataclass
class Ranking:
    """score(text) = sigmoid(gain * (weights . standardised features - cut) + logit(CUT))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    gain: float
    quantile: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.gain * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, seed: int = 3, pairs: int = PAIRS, penalty: float = 2e-3, rounds: int = 25) -> Ranking:
    """Logistic loss on the feature differences of preference pairs (a good row over a bad one), by Newton steps.

    The cut is the quantile of the learning rows' scores that tells their labels apart best. With one label only,
    or no rows, all weights are 0 and every score is above the cut, or below it if all labels are bad.
    """
    k = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(k), np.ones(k))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(k), 1.0 if len(bad) else -1.0, 1.0, 0.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(k)
    for _ in range(rounds):
        hessian, slope = penalty * np.eye(k), -penalty * w
        for lo in range(0, pairs, 10_000):  # differences are made a slice at a time
            d = z[better[lo : lo + 10_000]] - z[worse[lo : lo + 10_000]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            hessian += (d * (p * (1 - p))[:, None]).T @ d / pairs
            slope += d.T @ (1 - p) / pairs
        step = np.linalg.solve(hessian, slope)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    raw = z @ w
    order = np.sort(raw)
    qs = np.arange(0, 401) / 400
    cuts = np.quantile(raw, qs)
    right = [(((raw >= c) & (y == 1)).sum() + ((raw < c) & (y == 0)).sum(), -q) for c, q in zip(cuts, qs, strict=True)]
    best = max(range(len(qs)), key=lambda i: right[i])
    below = order[order < cuts[best]]
    cut = (cuts[best] + below[-1]) / 2 if len(below) else cuts[best] - 1
    return Ranking(mean, scale, w, float(cut), 1.0, float(qs[best]))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Ranking:
    """Fits on at most `most` labelled ids whose fold is not 0, one text each; only their features come to the driver.

    Of labels that repeat an id the smallest counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(fold("id") != 0)
    rows = rows.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = text.join(F.broadcast(rows), "id")  # at most `most` pairs of numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_batches(pdf):
                yield pd.DataFrame({"id": part["id"].to_numpy(), "y": part["y"].to_numpy(), "x": list(features(part["text"].tolist()))})

    # a row an id before anything is collected: of texts that repeat an id the one of the least features
    one = joined.mapInPandas(run, "id long, y int, x array<double>").groupBy("id").agg(F.min(F.struct("y", "x")).alias("m"))
    got = one.select("id", "m.y", "m.x").toPandas().sort_values("id", kind="stable")
    width = features([""]).shape[1]
    return fit(np.array(got["x"].tolist(), float).reshape(-1, width), got["y"].to_numpy(int))


def scored(docs: DataFrame, ranking: Ranking, *, text_col: str = "text") -> DataFrame:
    """docs with `_score` and `_predicted` added; null and empty texts get the score of a text without words."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            got, lo, size = [], 0, 0
            values = texts.tolist()
            for i, t in enumerate(values):
                size += len(t) if t else 0
                if size >= 4 << 20 or i == len(values) - 1:
                    got.append(ranking.score(features(values[lo : i + 1])))
                    lo, size = i + 1, 0
            yield pd.Series(np.concatenate(got) if got else [], dtype=float)

    score = F.pandas_udf(run, "double")
    return docs.withColumn("_score", score(F.col(text_col).cast("string"))).withColumn("_predicted", (F.col("_score") >= CUT).cast("int"))


def rank_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Learns from a bounded number of labelled rows outside fold 0 (see MOST_LABELLED); only the text enters a
    score. Labels that are null or neither 0 nor 1, and ids without a text, teach nothing. Repeated rows get equal
    scores, null ids are kept with fold 0, an empty table gives an empty table.
    """
    ranking = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(d, ranking)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
