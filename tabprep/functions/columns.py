"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Column by literal name, so dots, blanks and signs in names are safe."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    names = list(names)
    require(df, names)
    bad = [n for n in names if not is_numeric(data_type(df, n))]
    if bad:
        raise TypeError(f"numeric column expected: {', '.join(bad)}")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, NULL when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def total(values: Iterable[Column]) -> Column:
    """Sum of columns; NULL if any is NULL."""
    values = list(values)
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def hashable(df: DataFrame, name: str) -> Column:
    """The column itself, or its JSON text where its type cannot be compared."""
    kind = data_type(df, name)
    return F.to_json(col(name)) if "map<" in kind.simpleString() else col(name)
