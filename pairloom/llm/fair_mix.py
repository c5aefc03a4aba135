"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, durable

#: About so many rows are sorted in one piece; from four times as many on a bucket is split by another hash.
ROWS_A_BUCKET = 20_000


def _targets(docs: DataFrame, weights: tuple[float, ...], max_repeat: int) -> DataFrame:
    """One row per source: its size and its target, by water-filling under the cap of max_repeat times its size."""
    sizes = docs.groupBy("_src").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy("_src")
    by_ratio = W.orderBy("_ratio", "_src")
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    share = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_w", F.element_at(share, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(max_repeat) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = s.withColumn("_total", F.sum("source_size").over(everything))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_src", "_level"))).over(everything)["_level"])
    return s.select("_src", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"), F.col("_total").alias("_budget"))


def fair_mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: int = 3, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of copies of each document in a mix whose sources meet their target shares.

    Documents of a source are shuffled (by the MD5 of the id) and queue one after another, up to max_repeat
    rounds. A copy's virtual finish time is the source's cumulative size up to it over the source's target. All
    copies are sorted by that time over ranges of it, and the mix is the longest prefix within the total budget,
    which is the size of all documents. Sources sorted by code point, null last, weigh `weights` in turn; their sizes,
    a row a source, are laid out in one task.

    Both running totals are made in pieces (totals of pieces, then rows within a piece), so neither a hot source
    nor the global order ever lands in one task; a piece that rows of one id, or of none, fill is split by a hash of the
    text (with `keep`) or of the place in the table. Ties in time go by source, MD5, then size. Null or empty text:
    size 0, taken 0. Null sources form one source. Repeated rows count one by one. An empty table gives an empty
    table. Columns: id, size, source_size, target, copies, taken, and those in `keep` (their names must not clash).
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("_src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("_key"),
        (F.xxhash64(text_col) if keep else F.xxhash64(F.monotonically_increasing_id())).alias("_tie"),
    )
    if not keep:
        d = durable(d, "sized")  # texts are read once, for their sizes
    sized = d.select("_src", "size", "_key", "_tie") if not keep else durable(d.select("_src", "size", "_key", "_tie"), "sized")
    rows = sized.count()
    digits = max(2, math.ceil(math.log(max(2, rows / ROWS_A_BUCKET), 16)))
    ranges = max(16, 4 * math.ceil(max_repeat * rows / ROWS_A_BUCKET))
    sized, d = (x.withColumn("_bucket", F.substring("_key", 1, digits)) for x in (sized, d))
    # buckets of rows that repeat an id, or have none: at most one for each 4 * ROWS_A_BUCKET rows
    heavy = sized.groupBy("_src", "_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * ROWS_A_BUCKET).withColumn("_n", F.ceil(F.col("_n") / ROWS_A_BUCKET))
    if not heavy.isEmpty():
        piece = F.concat("_bucket", F.coalesce(F.format_string("-%09d", F.pmod("_tie", "_n")), F.lit("")))
        sized, d = (x.join(F.broadcast(heavy), ["_src", "_bucket"], "left").withColumn("_bucket", piece).drop("_n") for x in (sized, d))

    sums = sized.groupBy("_src", "_bucket").agg(F.sum("size").alias("size"))
    targets = _targets(sums, weights, max_repeat)
    ahead = W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size").join(targets, "_src")
    inside = W.partitionBy("_src", "_bucket").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, 0)
    d, sized = (x.withColumn("_inside", F.sum("size").over(inside)).join(offsets, ["_src", "_bucket"]).withColumn("_cum", F.col("_ahead") + F.col("_inside")) for x in (d, sized))

    def finish(e: Column | int) -> Column:
        e = F.lit(e) if isinstance(e, int) else e
        return F.try_divide(e * F.col("source_size") + F.col("_cum"), F.col("target"))

    copies = sized.select("_src", "_key", "size", "_budget", "source_size", "_cum", "target", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("_e"))
    copies = copies.select("_src", "_key", "size", "_budget", finish(F.col("_e")).alias("_t")).where("_t is not null and size > 0")
    copies = copies.withColumn("_range", F.floor(F.col("_t") / (1 + F.col("_t")) * ranges))
    by_range = copies.groupBy("_range").agg(F.sum("size").alias("_s"))
    by_range = by_range.select("_range", F.coalesce(F.sum("_s").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    order = W.partitionBy("_range").orderBy("_t", "_src", "_key", "size").rowsBetween(W.unboundedPreceding, 0)
    cut = copies.withColumn("_upto", F.sum("size").over(order)).join(by_range, "_range").where("_upto + _before <= _budget")
    cut = cut.agg(F.max(F.struct("_t", "_src", "_key", "size")).alias("_cut"))

    def inside_cut(e: int) -> Column:
        return F.when(F.struct(finish(e).alias("_t"), "_src", "_key", "size") <= F.col("_cut"), 1).otherwise(0)

    taken = sum((inside_cut(e) for e in range(max_repeat)), F.lit(0))
    out = d.crossJoin(F.broadcast(cut)).withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0))  # the cut is one row
    return out.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])


#: The same mix as one DuckDB statement; the fixed values are the weights 5, 2, 1 and the cap of 3.
ORACLE_SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as src,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), 'null')) as k
  from documents),
z as (select src, cast(sum(size) as bigint) as source_size from d group by src),
w as (select src, source_size, [5.0::double, 2.0::double, 1.0::double][cast((row_number() over (order by src) - 1) % 3 + 1 as int)] as w,
             cast(sum(source_size) over () as bigint) as budget from z),
l as (select *, 3 * source_size / w as ratio from w),
m as (select *, (budget - coalesce(sum(3 * source_size) over (order by ratio, src rows between unbounded preceding and 1 preceding), 0))
             / sum(w) over (order by ratio, src rows between current row and unbounded following) as lv from l),
g as (select lv from m where lv <= ratio order by ratio, src limit 1),
t as (select src, source_size, budget, least(cast(3 * source_size as double), coalesce((select lv from g) * w, cast(3 * source_size as double))) as target from m),
c as (select d.*, source_size, budget, target, cast(sum(size) over (partition by src order by k, size rows between unbounded preceding and current row) as bigint) as cum
      from d join t using (src)),
e as (select src, k, size, budget, (r * source_size + cum) / nullif(target, 0) as ft from c, (values (0), (1), (2)) x(r) where size > 0),
f as (select *, sum(size) over (order by ft, src, k, size rows between unbounded preceding and current row) as upto from e where ft is not null),
h as (select ft, src, k, size from f where upto <= budget order by ft desc, src desc, k desc, size desc limit 1)
select c.doc_id, c.size, c.source_size, c.target, cast(case when c.size > 0 then
    case when ((cum) / nullif(target, 0), c.src, c.k, c.size) <= (select (ft, src, k, size) from h) then c.size else 0 end
  + case when ((source_size + cum) / nullif(target, 0), c.src, c.k, c.size) <= (select (ft, src, k, size) from h) then c.size else 0 end
  + case when ((2 * source_size + cum) / nullif(target, 0), c.src, c.k, c.size) <= (select (ft, src, k, size) from h) then c.size else 0 end
  else 0 end as bigint) as taken
from c
"""
