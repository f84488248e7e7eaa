"""What the operators of this folder share: reading a column under a private name and streaming rows through Arrow.

Every operator picks the columns it needs under names of its own, so extra or clashing columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import col, hashable
from ..functions.hashing import digest

OUT_ROWS = 4096
OUT_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, each renamed to its keyword; a text name is taken literally, dots and all."""
    return df.select(*[(col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def _weight(row: tuple) -> int:
    return 64 + sum(len(v) for v in row if isinstance(v, (bytes, str, list)))


def stream(
    df: DataFrame,
    work: Callable[[Iterator[tuple]], Iterable[tuple]],
    schema: str,
    as_bytes: Sequence[str] = (),
) -> DataFrame:
    """Each task passes its rows, as tuples, through `work`, which yields tuples of `schema`.

    `as_bytes` names text columns handed over as UTF-8 bytes, which saves decoding them. Memory is bounded by Spark's
    Arrow batch, by what `work` holds, and by OUT_ROWS rows or OUT_BYTES bytes of results.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    raw = frozenset(as_bytes)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = []
            for name, column in zip(batch.schema.names, batch.columns):
                columns.append((column.cast(pa.binary()) if name in raw else column).to_pylist())
            yield from zip(*columns)

    def built(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in work(rows(batches)):
            out.append(row)
            held += _weight(row)
            if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                yield built(out)
                out, held = [], 0
        if out:
            yield built(out)

    return df.mapInArrow(run, schema)


def chunks(rows: Iterable, n: int) -> Iterator[list]:
    rows = iter(rows)
    while part := list(islice(rows, n)):
        yield part


def ascii_lower(text: bytes) -> bytes:
    """A-Z to a-z; bytes of other characters stay."""
    return text.lower()


def long_id(column: str) -> Column:
    return col(column).cast("bigint")


def filled(column: str) -> Column:
    """Null text is empty."""
    return F.coalesce(col(column).cast("string"), F.lit(""))


def scan_number(row: Column | None) -> Column:
    """The caller's row number, or one made in the scan. The latter is not the same in a second scan, so it serves only within
    a result that is written."""
    return F.monotonically_increasing_id() if row is None else row.cast("bigint")


def content_row(*columns: str | Column) -> Column:
    """Row number made of what the row holds: rows with equal columns share it, in any scan; a null counts by its place."""
    return digest(*[col(c) if isinstance(c, str) else c for c in columns])[0]


def content_digest(df: DataFrame) -> list[Column]:
    """128 hash bits of whole rows, maps by their JSON text: `__h1`, `__h2`."""
    return digest(*[hashable(df, c) for c in df.columns])
