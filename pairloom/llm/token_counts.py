"""Token counts of a unigram segmentation, with scores shared along a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts of so many distinct pre-tokens are held by a task before it starts afresh.
HELD = 1_000_000


@lru_cache(2)
def unigram_pieces(path: str) -> tuple[dict[bytes, float], int]:
    """Log probability of each piece of a .tiktoken vocabulary, and the longest length.

    The file has ranks, no probabilities: these follow Zipf's law over the ranks, so this is a stated unigram model,
    not one trained on a corpus.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    norm = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - norm for p, r in ranks.items()}, max(map(len, ranks))


def trie_counts(words: list[bytes], pieces: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Tokens in the best segmentation of each word; ties go to fewer tokens.

    Distinct words in byte order are the terminals of their trie in depth-first order, so the path to a word shares
    its first nodes with the path to the word before it: forward scores and counts of those nodes are kept, and only
    nodes below the fork are made. So each node of the trie of `words` is scored once, its terminals keep their
    counts, and memory is one path, as nodes are dropped when the walk leaves them; prefixes are shared within one
    call, that is a batch of a task. A byte outside the vocabulary costs a fixed penalty.
    """
    missing = min(pieces.values(), default=0.0) - 10
    out: dict[bytes, int] = {}
    score, count, last = [0.0], [0], b""
    get = pieces.get
    for w in sorted(set(words)):
        same, most = 0, min(len(w), len(last))
        while same < most and w[same] == last[same]:
            same += 1
        del score[same + 1 :], count[same + 1 :]
        for j in range(same + 1, len(w) + 1):
            best, n = score[j - 1] + missing, count[j - 1] + 1
            for i in range(max(0, j - longest), j):
                p = get(w[i:j])
                if p is not None:
                    s = score[i] + p
                    if s > best or s == best and count[i] + 1 < n:
                        best, n = s, count[i] + 1
            score.append(best)
            count.append(n)
        out[w] = count[len(w)]
        last = w
    return out


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text under the unigram model of `vocabulary` (a .tiktoken file).

    Pre-tokens are the words between white space with a blank before each. A task segments every distinct one of
    a batch once, in trie order, and keeps up to `held` counts between batches, which bounds its memory. Null and
    empty texts count 0; null ids are kept; repeated rows count one by one; an empty table gives an empty table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, longest = unigram_pieces(vocabulary)
        known: dict[bytes, int] = {}
        for pdf in frames:
            n_words, n_tokens = [], []
            split = [[b" " + w for w in t.encode("utf-8", "surrogatepass").split()] if t else [] for t in pdf["text"]]
            if len(known) > held:
                known.clear()
            known |= trie_counts([w for ws in split for w in ws if w not in known], pieces, longest)
            for ws in split:
                n_words.append(len(ws))
                n_tokens.append(sum(map(known.__getitem__, ws)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": n_words, "n_tokens": n_tokens})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, "doc_id long, n_words long, n_tokens long")
