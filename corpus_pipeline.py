"""From raw documents to packed sequences: quality rules, near duplicates, secrets, mixture, packing.

Each stage takes the documents its predecessor kept, as a written table, and all but the last return the same columns. A stage
decides on all its rows; decisions find their rows again by document id and a hash of the row's content, which is the
same in every scan, so a scan repeated after a lost executor cannot mix rows up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabprep.functions.columns import col
from tabprep.llm.base import content_digest, content_row, long_id
from tabprep.llm.minhash import near_duplicates
from tabprep.llm.mixing import WORD, mixed
from tabprep.llm.packing import packed
from tabprep.llm.quality import quality
from tabprep.llm.secrets import EXAMPLE, secrets
from tabprep.session import scratch_path

ROW, ID, TWIN = "__pipeline_row", "__pipeline_id", "__pipeline_twin"
REDACTED = "[SECRET]"


def _numbered(docs: DataFrame, row: Column) -> DataFrame:
    return docs.withColumns({ROW: row, ID: F.coalesce(long_id("doc_id"), F.lit(0).cast("bigint"))})


def _verdicts(found: DataFrame, *columns: Column) -> DataFrame:
    """One row per content: equal rows have the same verdict."""
    return found.select(F.col("row").alias(ROW), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias(ID), *columns).distinct()


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    row = content_row("text", "lang")
    kept = _verdicts(quality(docs, row=row).where("kept"))
    return _numbered(docs, row).join(kept.hint("merge"), [ROW, ID], "left_semi").drop(ROW, ID)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; rows repeated as a whole become one, told by 128 bits."""
    row, twin = content_digest(docs)
    kept = _verdicts(near_duplicates(docs, row=row).where("kept"))
    numbered = _numbered(docs, row).withColumn(TWIN, twin)
    return numbered.join(kept.hint("merge"), [ROW, ID], "left_semi").dropDuplicates([ROW, ID, TWIN]).drop(ROW, ID, TWIN)


def redacted(text: str, spans: list) -> str:
    """The text with every stretch of overlapping spans replaced."""
    out, last = [], 0
    end = -1
    for start, stop in sorted(spans):
        if start < end:
            end = max(end, stop)
            continue
        if end >= 0:
            last = end
        out += [text[last:start], REDACTED]
        end = stop
    return "".join([*out, text[max(end, 0) :]])


@F.pandas_udf(T.StringType())
def _redact(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else redacted(t, [(s["start"], s["end"]) for s in found]) for t, found in zip(text, spans)], dtype=object)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are taken out of the texts; only those that are clearly copied examples stay. n_chars follows."""
    row = content_row("text", "source")
    live = F.filter("spans", lambda s: s["live"])
    found = secrets(docs, row=row, **EXAMPLE).where(F.col("n_live") > 0)
    marks = _verdicts(found, F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("__spans"))
    joined = _numbered(docs, row).join(marks.hint("merge"), [ROW, ID], "left")
    touched = F.col("__spans").isNotNull()
    clean = _redact(F.when(touched, F.col("text")), F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>")))
    changed = {"text": F.when(touched, F.col("__clean")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(touched, F.length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumn("__clean", clean).withColumns(changed).select(*[col(c) for c in docs.columns])


_WORD = re.compile(WORD)


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    for at, word in enumerate(_WORD.finditer(text), 1):
        if at == n:
            return text[: word.end()]
    return text


@F.pandas_udf(T.StringType())
def _first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else first_words(t, int(k)) for t, k in zip(text, n)], dtype=object)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target: a document stands as often as the mix takes it, the last of a source cut by words.

    Documents without a word, and those beyond their source's budget, are not in the mix. Rows repeated as a whole share
    what the mix takes of them evenly, rounded down.
    """
    row = content_row("text", "source")
    numbered = _numbered(docs, row)
    found = mixed(numbered, carry=(ROW, ID)).where(F.col("size") > 0)
    plan = found.groupBy(ROW, ID).agg(F.sum("taken").alias("__all"), F.count(F.lit(1)).alias("__rows"), F.first("size").alias("__size"))
    plan = plan.withColumn("__taken", F.expr("__all div __rows")).where(F.col("__taken") > 0)
    whole, rest = F.expr("__taken div __size"), F.col("__taken") % F.col("__size")
    copies = F.when(rest > 0, F.concat(F.array_repeat(F.col("__size"), whole.cast("int")), F.array(rest))).otherwise(
        F.array_repeat(F.col("__size"), whole.cast("int"))
    )
    plan = plan.select(ROW, ID, "__size", copies.alias("__copies"))
    copied = numbered.join(plan.hint("merge"), [ROW, ID]).withColumn("__words", F.explode("__copies"))
    cut = F.col("__words") < F.col("__size")
    copied = copied.withColumn("__cut", _first_words(F.when(cut, F.col("text")), F.col("__words")))
    changed = {"text": F.when(cut, F.col("__cut")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("__cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return copied.withColumns(changed).select(*[col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, with their ids (little-endian unsigned 32-bit)."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL: str | None = None  # SQL cannot express signatures, distances and differencing; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
