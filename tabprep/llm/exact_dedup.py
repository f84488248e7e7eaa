"""Exact duplicates by combining that stands any number of copies: in each task, per salted digest, then over the salts.

Only DataFrame functions are used. Texts are compared as a whole wherever rows meet: they are part of the key of every
aggregation, beside their digest, and of the last join wherever two texts share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import pinned
from .base import filled, long_id, pick, table

GROUP_ROWS = 4096  # rows a salted group is meant to hold
HOT_DIGESTS = 50_000  # digests that may be salted, and so the rows of either broadcast


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    normalised: Column | None = None,
    group_rows: int = GROUP_ROWS,
    hot_digests: int = HOT_DIGESTS,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `docs`.

    Rows are equal if their texts are, byte by byte, after `normalised` (an expression of the column `text`; default: no
    change); null counts as empty, of any length. Of equal rows that with the largest doc_id stays; rows without id come
    last; of several rows with that id, or of rows all without id, exactly one stays. keep_id is null only if no equal row
    has an id. An empty table gives no row; further columns are not read.

    A first scan counts digests. Those of more rows than `group_rows`, or than a `hot_digests`th of all, are split: at most
    `hot_digests` can be, so their list is broadcast whatever the table's size, and each gets a salt per `group_rows` rows.
    A second scan collapses copies in its tasks, then merges them per (digest, salt, text); a group holds the ids of about
    `group_rows` rows, or a `hot_digests`th of all. Texts move once. What is written holds ids, and texts of salted groups
    alone; their winners, at most `hot_digests` unless digests clash, meet by (digest, text) and are broadcast back.
    """
    rows = pick(docs, doc_id=long_id(doc_id), text=filled(text))
    if normalised is not None:
        rows = rows.withColumn("text", F.coalesce(normalised.cast("string"), F.lit("")))
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    most = max(group_rows, -(-rows.count() // hot_digests))
    counted = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"))
    hot = counted.where(F.col("n") > most).select("sha", F.ceil(F.col("n") / most).alias("salts"))

    dealt = rows.join(F.broadcast(hot), "sha", "left")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts"))
    dealt = dealt.withColumn("salt", F.when(F.col("salts").isNotNull(), salt))
    merged = dealt.groupBy("sha", "salt", "text").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"), F.collect_list(F.struct("doc_id")).alias("ids")
    )
    salted = F.col("salt").isNotNull()
    groups = pinned(merged.select("sha", "salt", F.when(salted, F.col("text")).alias("text"), "n", "top", "ids"))

    # the winner of a salted group: largest id, no id last, then the smallest salt
    rank = F.struct(F.col("top").isNotNull().alias("named"), "top", (-F.col("salt")).alias("turn"))
    winners = groups.where(salted).groupBy("sha", "text").agg(F.sum("n").alias("size"), F.max(rank).alias("best"))
    clashing = winners.groupBy("sha").agg((F.count(F.lit(1)) > 1).alias("clash"))
    winners = winners.join(clashing, "sha").select(
        F.col("sha").alias("won_sha"), F.when(F.col("clash"), F.col("text")).alias("won_text"), "size", "best"
    )
    same = salted & (F.col("sha") == F.col("won_sha")) & (F.col("won_text").isNull() | (F.col("won_text") == F.col("text")))
    joined = groups.join(F.broadcast(winners), same, "left").select(
        "sha",
        F.coalesce("size", "n").alias("group_size"),
        F.when(salted, F.col("best.top")).otherwise(F.col("top")).alias("keep_id"),
        (~salted | (F.col("best.turn") == -F.col("salt"))).alias("holds"),
        F.sort_array("ids", asc=False).alias("ids"),  # no id last
    )
    return joined.select("*", F.posexplode("ids").alias("place", "row")).select(
        F.col("row.doc_id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("holds") & (F.col("place") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


OP13_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept, sha256(text) as text_sha256
from d
"""
