"""Repeated passages by content-defined cuts: gear rolling hash, marks at the cuts, passages compared byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import _SEP, durable, mix64, parts, text_batches

#: A chunk ends where the top BITS bits of the rolling hash are 0, LEAST to MOST bytes after the last end. With LEAST 1
#: an end depends on the 32 bytes before it alone.
BITS, LEAST, MOST = 4, 1, 512
#: A mark is the digest of the WIDTH bytes before a cut; a passage must hold one to be looked at.
WIDTH = 48
#: Around the marks that two documents share, so many bytes either way are compared.
REACH = 1024
#: A passage that another document holds too is repeated from so many words on.
RUN_WORDS = 50

#: The gear table: 256 values by rule.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_STEP = 4 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """h = (h << 1) + GEAR[byte] in 32 bits at every byte, which is a sum over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        more = np.zeros_like(h)
        more[width:] = h[:-width] << np.uint32(width)
        h = h + more
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text. Long texts are hashed a few megabytes at a time."""
    n, ends, last = len(data), [], 0
    for lo in range(0, n, _STEP):
        before = min(lo, 31)
        h = rolling(data[lo - before : lo + _STEP])[before:]
        at = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + lo + 1
        if LEAST <= 1 and len(at) and np.diff(at, prepend=last).max() <= MOST:
            ends += at.tolist()
            last = ends[-1]
            continue
        for c in at.tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


_R1 = np.cumprod(np.full(MOST, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
_R2 = np.cumprod(np.full(MOST, 0xC2B2AE3D27D4EB4F | 1, np.uint64), dtype=np.uint64)


def digests(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each chunk: two polynomials over its bytes, finished with its length."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lens = (ends - starts).astype(np.int64)
    pos = np.arange(int(ends[-1])) - np.repeat(starts, lens)
    b = mix64(data[: int(ends[-1])].astype(np.uint64) + np.uint64(1))
    n = lens.astype(np.uint64)
    return mix64(np.add.reduceat(b * _R1[pos], starts) ^ n).view(np.int64), mix64(np.add.reduceat(b * _R2[pos], starts) + n).view(np.int64)


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of one text that have WIDTH bytes before them, and 64 bits for those bytes."""
    at = np.array(cut_points(data), np.int64)
    at = at[at >= WIDTH]
    if not len(at):
        return at, np.zeros(0, np.uint64)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WIDTH)[at - WIDTH]).view(np.uint64)
    h = np.full(len(at), WIDTH, np.uint64)
    for k in range(words.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return at, h


def _packed(ids: list[int], texts: list[str], groups: int) -> pd.DataFrame:
    """One row a group of marks: the marks, documents and positions of a batch as bytes, column after column."""
    pos, mark, doc = [], [], []
    for i, t in zip(ids, texts, strict=True):
        at, h = marks(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
        pos.append(at)
        mark.append(h)
        doc.append(np.full(len(at), i, np.int64))
    m, d, p = np.concatenate(mark), np.concatenate(doc), np.concatenate(pos)
    g = (m >> np.uint64(32)) % np.uint64(groups)
    order = np.argsort(g, kind="stable")
    m, d, p, g = m[order], d[order], p[order].astype(np.uint32), g[order]
    edge = np.flatnonzero(np.diff(g, prepend=np.uint64(groups)))
    stop = np.append(edge[1:], len(g))[: len(edge)]
    return pd.DataFrame({"g": g[edge].astype(np.int64), "packed": [m[a:b].tobytes() + d[a:b].tobytes() + p[a:b].tobytes() for a, b in zip(edge, stop, strict=True)]})


def _links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each place of a mark beside a place of it in the first document: the n-th beside the n-th, in turn if it has fewer."""
    blobs = pdf["packed"].tolist()
    sizes = [len(x) // 20 for x in blobs]
    m = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(blobs, sizes, strict=True)])
    d = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(blobs, sizes, strict=True)])
    p = np.concatenate([np.frombuffer(x, np.uint32, n, 16 * n) for x, n in zip(blobs, sizes, strict=True)]).astype(np.int64)
    s = np.sort(m)
    more = s[1:][s[1:] == s[:-1]]
    keep = np.isin(m, np.unique(more))
    m, d, p = m[keep], d[keep], p[keep]
    order = np.lexsort((p, d, m))
    m, d, p = m[order], d[order], p[order]
    if len(m):  # rows repeating an id
        fresh = np.append(True, (np.diff(m) != 0) | (np.diff(d) != 0) | (np.diff(p) != 0))
        m, d, p = m[fresh], d[fresh], p[fresh]
    at = np.arange(len(m))
    new = np.append(True, m[1:] != m[:-1])[: len(m)]
    start = np.maximum.accumulate(np.where(new, at, 0))
    own = np.maximum.accumulate(np.where(new | np.append(True, d[1:] != d[:-1])[: len(m)], at, 0))
    first = d[start] if len(m) else d
    held = np.bincount(start, weights=d == first, minlength=len(m)).astype(np.int64)[start] if len(m) else at
    take = d != first
    at, start, own, held = at[take], start[take], own[take], held[take]
    return pd.DataFrame({"doc_id": d[at], "first_doc_id": first[at], "pos": p[at], "shift": p[at] - p[start + (at - own) % held]})


def _passages(a: bytes, b: bytes, offset: int, least: int) -> list[tuple[int, int, int]]:
    """(start and end in a, words) of the stretches of whole words that b, which begins `offset` bytes after a, holds at the same places."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    lo, hi = max(0, offset), min(len(x), offset + len(y))
    if hi <= lo:
        return []
    x, y = x[lo:hi], y[lo - offset : hi - offset]
    same = np.concatenate([[False], x == y, [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    gap = _SEP[x]
    both = gap & _SEP[y]
    before = np.cumsum(np.append(0, ~gap & np.append(True, gap[:-1])))  # words begun before a place
    out = []
    for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        if j - i < 2 * least - 1:
            continue
        seps = i + np.flatnonzero(gap[i:j])
        if not len(seps):
            continue
        s = i if i and both[i - 1] else int(seps[0])
        e = j if j < len(x) and both[j] else int(seps[-1])
        inside = np.flatnonzero(~gap[s:e])
        if len(inside):
            s, e = s + int(inside[0]), s + int(inside[-1]) + 1
            words = int(before[e] - before[s])
            if words >= least:
                out.append((lo + s, lo + e, words))
    return out


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Passages that occur in several documents: doc_id, start and bytes (in UTF-8), words, first_doc_id, is_copy.

    Cuts depend on the 32 bytes before them, so that equal passages have equal cuts. The WIDTH bytes before a cut are
    its mark. Every other holder of a mark is compared, byte by byte, with the smallest doc_id that holds it, REACH
    bytes around the marks they share; stretches of run_words whole words or more are returned: a row for the copy
    (is_copy) with the document it was compared with as first_doc_id, and a row for that document with itself.
    Rows overlap where a passage has parts that came from different documents. Repetition within one document alone
    is no repeat. Null ids and null or empty texts have no marks; rows repeating an id are one document here and give
    their passages once; no repeats or an empty table give an empty table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = parts(size, 16 << 20, 48)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_batches(pdf, limit=2 << 20):
                yield _packed(part["doc_id"].tolist(), part["text"].tolist(), groups)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                # a space stands for either edge of a document
                a, a0 = (b" " + r.a, -1) if r.lo <= REACH else (r.a, r.lo - REACH)
                b, b0 = (b" " + r.b, -1) if r.lo - r.shift <= REACH else (r.b, r.lo - r.shift - REACH)
                a, b = a + b" " if r.a_end else a, b + b" " if r.b_end else b
                for s, e, w in _passages(a, b, b0 + r.shift - a0, run_words):
                    rows.append((r.doc_id, a0 + s, e - s, w, r.first_doc_id))
                    rows.append((r.first_doc_id, a0 + s - r.shift, e - s, w, r.first_doc_id))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "bytes", "words", "first_doc_id"]).drop_duplicates()

    links = source.mapInPandas(run, "g long, packed binary").groupBy("g").applyInPandas(_links, "doc_id long, first_doc_id long, pos long, shift long")
    pair = ["doc_id", "first_doc_id", "shift"]
    near = W.partitionBy(*pair).orderBy("lo")
    blocks = links.groupBy(*pair, F.expr(f"pos div {REACH}").alias("_block")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    blocks = blocks.withColumn("_new", F.when(F.col("lo") - F.lag("hi").over(near) <= 2 * REACH, 0).otherwise(1))
    stretches = blocks.withColumn("_run", F.sum("_new").over(near.rowsBetween(W.unboundedPreceding, 0))).groupBy(*pair, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")
    stretches = durable(stretches, "stretches")
    raw = source.select("doc_id", F.encode("text", "utf-8").alias("raw"))
    piece = lambda lo, hi: F.expr(f"substring(raw, cast(greatest({lo} - {REACH}, 0) as int) + 1, cast({hi} + {REACH} - greatest({lo} - {REACH}, 0) as int))")
    ours = raw.join(stretches, "doc_id").select(*pair, "lo", "hi", (F.col("lo") - F.col("shift")).alias("f_lo"), (F.col("hi") - F.col("shift")).alias("f_hi"), piece("lo", "hi").alias("a"), F.expr(f"hi + {REACH} >= length(raw)").alias("a_end"))
    wanted = stretches.select(F.col("first_doc_id").alias("doc_id"), (F.col("lo") - F.col("shift")).alias("f_lo"), (F.col("hi") - F.col("shift")).alias("f_hi")).distinct()
    theirs = raw.join(wanted, "doc_id").select(F.col("doc_id").alias("first_doc_id"), "f_lo", "f_hi", piece("f_lo", "f_hi").alias("b"), F.expr(f"f_hi + {REACH} >= length(raw)").alias("b_end"))
    both = ours.join(theirs, ["first_doc_id", "f_lo", "f_hi"]).select(*pair, "lo", "a", "a_end", "b", "b_end")
    found = both.mapInPandas(compare, "doc_id long, start long, bytes long, words long, first_doc_id long").distinct()
    # a stretch within another one of the same two documents says nothing new
    wider = W.partitionBy("doc_id", "first_doc_id").orderBy("start", F.desc("bytes")).rowsBetween(W.unboundedPreceding, -1)
    out = found.withColumn("_upto", F.max(F.col("start") + F.col("bytes")).over(wider)).where("_upto is null or _upto < start + bytes")
    return out.select("doc_id", "start", "bytes", "words", "first_doc_id", (F.col("first_doc_id") < F.col("doc_id")).alias("is_copy"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeated passages cut out of all documents but the first that holds them."""
    spans = repeated_passages(docs, id_col=id_col, text_col=text_col, run_words=run_words).where("is_copy")
    spans = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "bytes"))).alias("_spans"))  # of one document

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in frames:
            out = []
            for t, cut in zip(texts, spans, strict=True):
                if t and cut is not None and len(cut):
                    raw = t.encode("utf-8", "surrogatepass")
                    kept, upto = [], 0
                    for x in cut:  # in order of start; they may overlap
                        kept.append(raw[upto : max(upto, x["start"])])
                        upto = max(upto, x["start"] + x["bytes"])
                    t = b"".join([*kept, raw[upto:]]).decode("utf-8", "ignore")
                out.append(t)
            yield pd.Series(out, dtype=object)

    cut = F.pandas_udf(run, "string")
    joined = docs.join(spans, F.col(id_col).cast("long") == F.col("_id"), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("_spans"))).select(*docs.columns)
