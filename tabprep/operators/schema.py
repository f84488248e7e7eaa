"""Chosen columns and types, logical types, table metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, require
from ..functions.levels import value_counts

# fixed values: share of repeated values that makes a column ordinal or a category, and where the rule changes
FEW_ROWS = 50
FEW_SHARE = 0.7
MANY_SHARE = 0.9
# date texts: the shape a value must have, and how it is read then
DATE_FORMATS = {
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}": "yyyy-MM-dd",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}": "yyyy-MM-dd HH:mm:ss",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}": "yyyy-MM-dd'T'HH:mm:ss",
    r"[0-9]{4}/[0-9]{2}/[0-9]{2}": "yyyy/MM/dd",
    r"[0-9]{2}/[0-9]{2}/[0-9]{4}": "MM/dd/yyyy",
    r"[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}": "MM/dd/yyyy HH:mm",
    r"[0-9]{2}-[0-9]{2}-[0-9]{4}": "dd-MM-yyyy",
    r"[0-9]{2}[.][0-9]{2}[.][0-9]{4}": "dd.MM.yyyy",
    r"[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}": "d MMMM yyyy",
    r"[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}": "MMMM d, yyyy",
    r"[A-Z][a-z]+-[0-9]{2}-[0-9]{4} [0-9]{2}:[0-9]{2} [AP]M": "MMMM-dd-yyyy hh:mm a",
}

TYPE_NAMES = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64",
    "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]",
}

# which actions suit a logical type
ACTIONS = {
    "numeric": ("impute", "scale", "mathops", "clip", "bin_variables", "removenull"),
    "category": ("encode", "removenull", "impute"),
    "ordinal": ("encode", "removenull", "impute"),
}


def select_columns(df: DataFrame, include: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """The user's columns in order, cast to the user's types; a value that does not fit becomes NULL."""
    require(df, include)
    types = types or {}
    return df.select(*[col(c).try_cast(types[c]).alias(c) if c in types else col(c) for c in include])


def type_name(dtype: T.DataType) -> str:
    return TYPE_NAMES.get(dtype.simpleString(), dtype.simpleString())


def is_date_text(x: Column) -> Column:
    """Whether a text is a date in one of the known formats; only texts of the right length and shape are looked at."""
    text = F.trim(x)
    test = F.when(~F.length(text).between(10, 40) | ~text.rlike("^[0-9A-Z].*[0-9]{2}"), F.lit(False))
    for shape, layout in DATE_FORMATS.items():
        test = test.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(text, F.lit(layout)).isNotNull())
    return test.otherwise(F.lit(False))


def logical_types(df: DataFrame) -> DataFrame:
    """(column, kind) from the rows without gaps: two grouping levels, no per-column distinct."""
    whole = df.na.drop()
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    texts = [n for n, t in dtypes.items() if isinstance(t, T.StringType)]
    parts = []
    for counts in value_counts(whole, {n: col(n) for n in dtypes}).values():
        is_text = F.col("column").isin(*texts) if texts else F.lit(False)
        text = F.col("value").cast("string")
        truth = is_text & F.lower(F.trim(text)).isin("true", "false")
        parts.append(
            counts.groupBy("column").agg(
                F.count(F.lit(1)).alias("d"),
                F.sum("n").alias("n"),
                F.max(truth).alias("truth"),
                F.min(is_text & is_date_text(text)).alias("dates"),
            )
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    repeated = (F.col("n") - F.col("d")) / F.col("n")
    few = F.when(F.col("n") < FEW_ROWS, repeated >= FEW_SHARE).otherwise(repeated >= MANY_SHARE)
    names = F.create_map(*[F.lit(p) for n, t in dtypes.items() for p in (n, type_name(t))])
    order = F.create_map(*[F.lit(p) for i, n in enumerate(dtypes) for p in (n, i)])
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    kind = (
        F.when(~is_text, F.when((F.col("d") >= 2) & few, "ordinal").otherwise(names[F.col("column")]))
        .when(F.col("dates"), "datetime")
        .when(F.col("truth"), "bool")
        .when(few, "category")
        .otherwise("str")
    )
    known = found.select("column", kind.alias("kind"))
    # a table without a single whole row still names every column
    every = F.array(
        *[F.struct(F.lit(n).alias("column"), F.lit("str" if n in texts else type_name(t)).alias("base")) for n, t in dtypes.items()]
    )
    listed = df.sparkSession.range(1).select(F.inline(every))
    return listed.join(known, "column", "left").select(
        "column", F.coalesce("kind", "base").alias("kind"), order[F.col("column")].alias("position")
    )


def table_meta(df: DataFrame) -> DataFrame:
    """One row: row_count, col_count, col_info (JSON text, column → logical type, in column order)."""
    info = logical_types(df).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "column", "kind"))),
            lambda s: F.struct(s["column"].alias("key"), s["kind"].alias("value")),
        ).alias("pairs")
    )
    rows = df.agg(F.count(F.lit(1))).first()[0]
    return info.select(
        F.lit(rows).cast("bigint").alias("row_count"),
        F.lit(len(df.columns)).alias("col_count"),
        F.to_json(F.map_from_entries("pairs")).alias("col_info"),
    )


def legal_actions(kind: str) -> tuple[str, ...]:
    """Actions that suit a logical type; any number type is numeric."""
    return ACTIONS.get(kind, ACTIONS["numeric"] if kind.startswith(("int", "float")) else ())
