"""Mixing sources to target weights: hash-random order within each source, cut at the source's exact budget.

All of it is DataFrame work. Rows are sorted in ranges of (source, hash of the id, id, size, place in the scan), cut where a
sample of them says, so neither a large source nor an id that many rows share fills one range: a range is one window's
partition, and prefix sums over the (source, range) totals place it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import col
from ..session import pinned, shuffle_width
from .base import long_id, pick, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
KEY_BITS = 60


def word_count(text: str) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: str) -> Column:
    """Never null, ordered by code point with null last."""
    name = col(source).cast("string")
    return F.when(name.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), name))


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source_size): shares by weight, none above `most` times its size.

    The sources filled first are those with the least size per weight, so with sources in that order the level of the
    others is what is left over their weights, and holds from the first source that it does not overfill. The windows
    run over one row per source.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(W.orderBy("source_key")) - 1
    ranked = totals.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")).cast("bigint"))
    ranked = ranked.withColumn("cap", F.lit(int(most)) * F.col("source_size"))
    ranked = ranked.withColumn("fills_at", F.col("cap").cast("double") / F.col("weight"))
    order = W.orderBy("fills_at", "source_key")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    heavy = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    ranked = ranked.withColumn("level", left.cast("double") / heavy).withColumn("at", F.row_number().over(order))
    holds = F.when(F.col("level") <= F.col("fills_at"), F.struct("at", "level"))
    ranked = ranked.withColumn("first", F.min(holds).over(W.partitionBy()))
    filled = F.col("first").isNull() | (F.col("at") < F.col("first.at"))
    target = F.when(filled, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level"))
    return ranked.select("source_key", "source_size", "cap", target.alias("target"))


def mixed(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of the document, epochs counted), then `carry`.

    A source with budget b and size s is taken floor(b / s) times whole; of the rest, documents are taken in key order
    and the last one is cut, so a source's taken words are its target rounded. Null text has size 0 and is never taken;
    null source is a source of its own; rows without an id share one key and are ordered by size. Repeated rows are
    taken one after the other. An empty table gives no row.
    """
    length = size if size is not None else word_count(text)
    rows = pick(docs, doc_id=long_id(doc_id), source=source, source_key=source_key(source), size=length, **{f"carry_{c}": c for c in carry})
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("bigint"))
    order = ["key", "doc_id", "size", "tie"]
    width = shuffle_width(docs.sparkSession)
    sorted_rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(width, "source_key", *order)
    rows = pinned(sorted_rows.withColumn("range", F.spark_partition_id()))
    cells = rows.groupBy("source_key", "range").agg(F.sum("size").alias("cell_size"))
    plan = targets(cells.groupBy("source_key").agg(F.sum("cell_size").alias("source_size")), weights, most)
    before_cell = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(before_cell), F.lit(0)))
    starts = starts.join(plan, "source_key").drop("cell_size")
    within = W.partitionBy("source_key", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("cell_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, ["source_key", "range"])
    budget = F.least(F.floor(F.col("target") + F.lit(0.5)).cast("bigint"), F.col("cap"))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    placed = placed.withColumn("budget", budget).withColumn("epochs", epochs)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("cell_start") - F.col("cell_before")))
    taken = (F.col("epochs") * F.col("size") + part).cast("bigint")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *[col(f"carry_{c}").alias(c) for c in carry]
    )


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).drop("source")


OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight, 3 * source_size as cap from s),
f as (select *, cap::double / weight as fills_at, row_number() over (order by cap::double / weight, source nulls last) as nr from w),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by nr rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over (order by nr rows between unbounded preceding and 1 preceding), 0))::double as level from f),
h as (select min(nr) as nr from l where level <= fills_at),
t as (select l.source, source_size, cap,
    case when h.nr is null or l.nr < h.nr then cap::double else weight * (select level from l where nr = (select nr from h)) end as target from l, h),
p as (select d.*, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d)
select doc_id, size, source_size, target,
  (case when source_size > 0 then least(floor(target + 0.5)::bigint, cap) // source_size else 0 end * size
   + greatest(0, least(size, case when source_size > 0 then least(floor(target + 0.5)::bigint, cap) % source_size else 0 end - before)))::bigint as taken
from p join t on p.source is not distinct from t.source
"""
