"""Near-duplicate documents by bottom-k sketches of word shingles, with links confirmed on whole sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import durable, held, mix64, parts, release, text_batches, word_hashes

#: Values kept of each set, and the least share of a union sketch that makes a pair worth confirming. A pair of
#: similarity 0.75 shares 48 of 64 on average with a deviation of 3.5: under 29 has a chance of about 1e-7.
KEPT, SHARE = 64, 29 / 64
#: Members of a list that are compared with each other at a time.
BLOCK = 512

_MUL = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted hashes of the distinct runs of `words` words of each text; fewer words make one run."""
    hashes, counts = word_hashes(texts)
    total = len(hashes)
    mul = (_MUL * (words // len(_MUL) + 1))[:words]
    runs = np.zeros(max(total - words + 1, 0), np.uint64)
    for j in range(words):
        runs += mix64(hashes[j : j + len(runs)] ^ np.uint64(j + 1)) * mul[j]
    runs = mix64(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        elif n:
            short = np.uint64(n)
            for j in range(n):
                short = mix64((short + hashes[at + j : at + j + 1]) * mul[j])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = np.bitwise_xor.reduce(mix64(s + np.uint64(0x9E3779B97F4A7C15))) if len(s) else np.uint64(0)
    b = np.add.reduce(mix64(s ^ np.uint64(0xA0761D6478BD642F))) if len(s) else np.uint64(0)
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def sketched(docs: DataFrame, words: int, kept: int) -> DataFrame:
    """Of each document: size and digest of its set, and the `kept` smallest hashes of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_batches(pdf):
                sets = shingle_sets(part["text"].tolist(), words)
                digests = [_digest(s) for s in sets]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "mark": part["mark"].to_numpy(), "n": [len(s) for s in sets], "d1": [d[0] for d in digests], "d2": [d[1] for d in digests],
                    "sketch": [s[:kept].view(np.int64) for s in sets],
                })

    return docs.mapInPandas(run, "id string, mark long, n long, d1 long, d2 long, sketch array<long>")


def _need(n: Column, share: float) -> Column:
    return F.ceil(F.lit(share) * n)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, per_cent: int) -> DataFrame:
    """The pairs (u, v) of set keys whose whole sets are similar enough. texts: (node, text), one row a node."""
    left, right = texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), texts.select(F.col("node").alias("v"), F.col("text").alias("tv"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, np.ndarray] = {}
        for pdf in frames:
            ok = []
            for u, v, tu, tv in zip(pdf["u"], pdf["v"], pdf["tu"], pdf["tv"], strict=True):
                if len(sets) > 2000:
                    sets.clear()
                for node, text in ((u, tu), (v, tv)):
                    if node not in sets:
                        sets[node] = shingle_sets([text], words)[0]
                a, b = sets[u], sets[v]
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= per_cent * (len(a) + len(b) - both))
            yield pdf.loc[np.array(ok, bool), ["u", "v"]]

    return pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInPandas(run, "u long, v long")


def estimate(a: np.ndarray, b: np.ndarray, kept: int) -> float:
    """Share of the union's sketch that lies in both sketches."""
    union = np.union1d(a, b)[:kept]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.isin(union, both, assume_unique=True).sum() / max(1, len(union))


def _passing(pairs: DataFrame, sketches: DataFrame, kept: int, share: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ok = [estimate(np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64), kept) >= share for a, b in zip(pdf["su"], pdf["sv"], strict=True)]
            yield pdf.loc[np.array(ok, bool), ["u", "v"]]

    su, sv = sketches.select(F.col("node").alias("u"), F.col("sketch").alias("su")), sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sv"))
    return pairs.join(su, "u").join(sv, "v").select("u", "v", "su", "sv").mapInPandas(run, "u long, v long")


def _incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(values)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(values, s)
        at = at[at < len(values)]
        out[i, at[values[at] == s[: len(at)]]] = 1
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, a slice of the values at a time."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), step):
        part = common[lo : lo + step]
        out += _incidence(left, part) @ _incidence(right, part).T
    return out.astype(np.int64)


def _may(left: pd.DataFrame, right: pd.DataFrame, per_cent: int, share: float) -> np.ndarray:
    """Which members of two components may be linked, by sizes and sketches."""
    sk = [[np.asarray(s).view(np.uint64) for s in f["sketch"]] for f in (left, right)]
    n, k, comp = [f["n"].to_numpy() for f in (left, right)], [np.array([len(s) for s in x]) for x in sk], [f["comp"].to_numpy() for f in (left, right)]
    may = _overlaps(*sk) >= np.ceil(share * np.maximum.outer(*k))
    return may & (comp[0][:, None] != comp[1][None, :]) & (100 * np.minimum.outer(*n) >= per_cent * np.maximum.outer(*n))


def _links_across(left: pd.DataFrame, right: pd.DataFrame, words: int, per_cent: int, share: float) -> list[tuple[int, int]]:
    """A pair for each two components that whole sets on either side connect. Sketches tell which sets to look at."""
    may = _may(left, right, per_cent, share)
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        return []
    n, comp = [f["n"].to_numpy() for f in (left, right)], [f["comp"].to_numpy() for f in (left, right)]
    both = _overlaps(*[shingle_sets(f["text"].iloc[at].tolist(), words) for f, at in ((left, rows), (right, cols))])
    union = np.add.outer(n[0][rows], n[1][cols]) - both
    linked = np.nonzero((100 * both >= per_cent * union) & may[np.ix_(rows, cols)])
    return list({(int(comp[0][rows[a]]), int(comp[1][cols[b]])) for a, b in zip(*linked, strict=True)})


def _sides(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The two blocks of each cell of a task; a small group is one block beside itself."""
    for _, own in pdf.groupby(["g", "i", "j"], sort=False):
        i, j = own["i"].iloc[0], own["j"].iloc[0]
        yield (own, own) if i == j else (own[own["b"] == i], own[own["b"] == j])


_CELL = "g long, i long, j long, task long, b long, node long, comp long, n long, sketch array<long>"


def _across(members: DataFrame, texts: DataFrame, words: int, per_cent: int, share: float) -> DataFrame:
    """Links (u, v) of components within groups g of members: small groups whole, many to a task; large ones a block against a block.

    Sketches meet first; texts go only with those members that may have a link in their cell.
    """

    def sift(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for left, right in _sides(pdf):
            may = _may(left, right, per_cent, share)
            kept += [left[may.any(axis=1)]] if left is right else [left[may.any(axis=1)], right[may.any(axis=0)]]
        return pd.concat(kept)[[c.split()[0] for c in _CELL.split(", ")]]

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [x for left, right in _sides(pdf) for x in _links_across(left, right, words, per_cent, share)]
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    by_group = members.groupBy("g").agg(F.count("*").alias("members"))
    tasks = parts(members.count(), BLOCK)
    nb = F.ceil(F.col("members") / BLOCK).cast("long")
    blocked = members.join(by_group, "g").withColumn("b", F.pmod(F.xxhash64("node"), nb)).withColumn("o", F.explode(F.sequence(F.lit(0), nb - 1)))
    i, j = F.least("b", "o"), F.greatest("b", "o")
    task = F.when(F.col("members") <= BLOCK, F.pmod(F.xxhash64("g"), F.lit(tasks))).otherwise(F.xxhash64("g", i, j))
    cells = blocked.select("g", i.alias("i"), j.alias("j"), task.alias("task"), "b", "node", "comp", "n", "sketch")
    sifted = cells.groupBy("task").applyInPandas(sift, _CELL)
    return sifted.join(texts, "node").groupBy("task").applyInPandas(confirm, "u long, v long").distinct()


def grouped(docs: DataFrame, *, words: int = 5, per_cent: int = 75, kept: int = KEPT, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and node of every row; rows of one group have one node, rows of size 0 none.

    mark: a long that comes back with its row, to tell rows of one id apart. See near_duplicates.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    got = durable(sketched(source.select(F.col("doc_id").cast("string").alias("id"), "text", "mark"), words, kept), "sketches")
    got = got.withColumn("doc_id", F.col("id").cast("long")).withColumn("node", F.when(F.col("n") > 0, F.xxhash64("d1", "d2", "n")))
    nodes = got.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = durable(nodes, "nodes")

    values = nodes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    listed = values.join(common, "value").groupBy("node", "k").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("l"))  # at most `kept` a node
    prefix = F.col("k") - _need(F.col("k"), share) + 1 - (F.col("k") - F.size("l"))
    weight = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["df"]).alias("weight")
    listed = listed.where(prefix > 0).select("node", weight, F.explode(F.slice("l", 1, F.greatest(prefix, F.lit(1)).cast("int"))["value"]).alias("value"))
    listed = durable(listed, "listed")
    lists = listed.groupBy("value").agg(F.count("*").alias("members"), F.max(F.struct("weight", "node"))["node"].alias("pivot")).where("members > 1")
    star = listed.join(lists, "value").where("node != pivot").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    star = held(star)

    sketches = nodes.select("node", "n", "sketch")
    near_size = F.lit(100) * F.least("n", "m") >= F.lit(per_cent) * F.greatest("n", "m")
    sized = star.join(nodes.select(F.col("node").alias("u"), "n"), "u").join(nodes.select(F.col("node").alias("v"), F.col("n").alias("m")), "v").where(near_size).select("u", "v")
    texts = _texts(source.select("doc_id", "text"), nodes, star.select(F.col("u").alias("node")).union(star.select("v")), words)
    links = durable(confirmed(_passing(sized, sketches, kept, share), texts, words, per_cent), "links")
    comp = components(links)

    # lists that still hold several components: their members, in the clusters that such lists connect
    placed = listed.select("node", "value").join(comp.select("node", F.col("label").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    spans = placed.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("listed")).where("lo != hi")
    open_lists = held(placed.join(spans, "value").select("value", "node", "comp", "lo", "listed"))
    clusters = components(open_lists.select(F.col("comp").alias("u"), F.col("lo").alias("v"))).select(F.col("node").alias("comp"), F.col("label").alias("cluster"))
    member = open_lists.join(clusters, "comp")
    # a cluster meets whole, in blocks, or list by list, in blocks: whichever sends fewer rows; a long chain goes by lists
    size = member.groupBy("cluster").agg(F.count_distinct("node").alias("nodes"), F.sum(F.ceil(F.col("listed") / BLOCK)).alias("by_list"))
    whole = F.col("nodes") * F.ceil(F.col("nodes") / BLOCK) <= F.col("by_list")
    member = member.join(size, "cluster").select(F.when(whole, F.xxhash64("cluster")).otherwise(F.xxhash64("cluster", "value")).alias("g"), "node", "comp").distinct()
    member = held(member)
    more = durable(_across(member.join(sketches, "node"), texts, words, per_cent, share), "across")
    merged = components(more).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    final = durable(comp.union(more.select("u", "u")).union(more.select("v", "v")).distinct().join(merged, "label", "left").select("node", F.coalesce("whole", "label").alias("label")), "components")
    for table in (star, open_lists, member):
        table.unpersist()
    release(listed, texts, links, more)
    smallest = final.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    by_node = nodes.select("node", F.col("doc_id").alias("first")).join(final.join(smallest, "label").select("node", "label", "component"), "node", "left")
    by_node = by_node.select("node", F.coalesce("component", "first").alias("component"), F.coalesce("label", "node").alias("label"))
    out = got.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(by_node, "node", "left")
    return out.select("doc_id", "mark", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("label", "node").alias("node"))


def near_duplicates(docs: DataFrame, *, words: int = 5, per_cent: int = 75, kept: int = KEPT, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by sets with 100 * intersection >= per_cent * union.

    One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable), kept. One 64-bit hash
    serves shingles and sketches. Documents of one set form one node. Values of the sketches that several nodes
    hold make inverted lists; each node enters only the lists of its rarest values, as many as a pair similar
    enough in sketch must share at least one of. First each list links its members to its most typical one; what the
    union sketch lets pass is confirmed on the whole sets. Then members of the lists that still span several components
    meet across components, sketches first, by clusters of such lists or list by list, whichever sends fewer rows,
    and in blocks of BLOCK; that gives one confirmed link for two components. So a group of copies or near copies, or a long
    chain of them, gives rows in proportion to its size, a passage that many documents share stays out of their
    rarest values, and no link is dropped. Only lists of more than BLOCK members that are in several components
    meet themselves block against block.

    Null, empty and blank texts have size 0 and are linked with nothing, not even with each other; rows of null id
    are kept and take no part. Rows that repeat an id are separate documents. An empty table gives an empty table.
    """
    out = grouped(docs, words=words, per_cent=per_cent, kept=kept, share=share, id_col=id_col, text_col=text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _texts(source: DataFrame, nodes: DataFrame, listed: DataFrame, words: int) -> DataFrame:
    """One text for each node in a list."""
    wanted = nodes.join(listed.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part in text_batches(pdf):
                sets = shingle_sets(part["text"].tolist(), words)
                d = [_digest(s) for s in sets]
                yield pd.DataFrame({"node": part["node"].to_numpy(), "text": part["text"].to_numpy(), "d1": [x[0] for x in d], "d2": [x[1] for x in d], "m": [len(s) for s in sets]})

    found = source.where("text is not null").join(wanted, "doc_id").select("node", "text").mapInPandas(run, "node long, text string, d1 long, d2 long, m long")
    return durable(found.where("node = xxhash64(d1, d2, m)").select("node", "text").dropDuplicates(["node"]), "texts")


#: The same groups as one DuckDB statement, through all shared shingles and the closure of the links.
ORACLE_SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from t),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
r as (select doc_id, doc_id as root from documents union select l.y, r.root from r join l on l.x = r.doc_id)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.root) as component_id, r.doc_id = min(r.root) as kept
from r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
