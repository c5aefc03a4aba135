"""Helpers shared by the operators: durable intermediate tables, sizes, word hashing."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. In local mode alone, as in tests, a temporary one stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.pairloom.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.pairloom.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """Keep df on the executors' disks, for what is read a few times and cheap to make again from durable tables.

    What a lost executor held is made anew. It costs no files in the shared folder, but the shuffles that made it stay
    as long as it does, so what took large shuffles is better durable. End with unpersist().
    """
    return df.persist(StorageLevel.DISK_ONLY)


def release(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/pairloom/" in path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def parts(rows: int, per_part: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_part))


def fold(col: Column | str) -> Column:
    """crc32 of the id as text, modulo 5 (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 if isinstance(col, str) else F.crc32(col.cast("string").cast("binary")) % 5, F.lit(0))


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 256)
        _POW = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64), dtype=np.uint64)])
    return _POW


def _hash_block(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a block of bytes; words lie wholly inside the block."""
    inside = ~_SEP[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(lens) - lens
    pos = np.arange(len(at)) - np.repeat(first, lens)
    h = np.add.reduceat(_LOWER[buf[at]] * _powers(int(lens.max()))[pos], first)
    return starts, mix64(h + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order (A-Z lower-cased), and the number of words of each text.

    Works on about a megabyte at a time whatever the length of a text; null texts have no words.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    starts, hashes, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + _BLOCK, len(data))
        while hi < len(data):  # move back to a separator, or on to the next one
            back = np.flatnonzero(_SEP[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
                break
            hi = min(hi + _BLOCK, len(data))
        s, h = _hash_block(data[lo:hi])
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    upto = np.searchsorted(np.concatenate(starts), ends)
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def text_batches(pdf, text: str = "text", limit: int = 4 << 20):
    """Slices of a pandas frame with about `limit` characters of text each."""
    n, lo, size = len(pdf), 0, 0
    for i, t in enumerate(pdf[text]):
        size += len(t) if t else 0
        if size >= limit:
            yield pdf.iloc[lo : i + 1]
            lo, size = i + 1, 0
    if lo < n:
        yield pdf.iloc[lo:]
