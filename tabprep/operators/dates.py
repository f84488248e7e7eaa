"""Parts of a date column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, data_type, require
from ..plans.feature_step import FeatureStep, register_feature_step

# fixed values: text format of the cleaned date, names of the derived columns, their labels
CLEAN_FORMAT = "MMMM-dd-yyyy hh:mm a"
PARTS = ("Day_of_Month", "Month", "Year", "Day_of_week", "Working_Day_Type", "Type_of_Quarter", "Hour", "Minutes")
QUARTERS = ("1st Quarter", "2nd Quarter", "3rd Quarter", "4th Quarter")


def _stamp(df: DataFrame, column: str) -> Column:
    require(df, [column])
    x = col(column)
    if isinstance(data_type(df, column), T.StringType):
        return F.try_to_timestamp(x)
    return x.cast("timestamp_ntz")


def dt_clean_date(df: DataFrame, column: str, name: str = "clean_date") -> DataFrame:
    """Date as text, to the minute."""
    return df.withColumn(name, F.date_format(_stamp(df, column), CLEAN_FORMAT))


def part_columns(t: Column) -> dict[str, Column]:
    """The eight derived columns; a NULL date gives eight NULLs."""
    return {
        "Day_of_Month": F.dayofmonth(t).cast("string"),
        "Month": F.date_format(t, "MMMM"),
        "Year": F.year(t).cast("string"),
        "Day_of_week": F.date_format(t, "EEEE"),
        "Working_Day_Type": F.when(F.weekday(t) < 5, F.lit("Week Day")).when(F.weekday(t) >= 5, F.lit("Weekend")),
        "Type_of_Quarter": F.elt(F.quarter(t), *[F.lit(q) for q in QUARTERS]),
        "Hour": F.hour(t),
        "Minutes": F.minute(t),
    }


def dt_parts(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(part_columns(_stamp(df, column)))


def empty_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold nothing but NULL, found in one aggregation."""
    require(df, columns)
    if not columns:
        return []
    row = df.agg(*[F.count(col(c)) for c in columns]).first()
    return [c for c, n in zip(columns, row) if n == 0]


def dt_drop_empty(df: DataFrame, columns: Sequence[str] = PARTS) -> DataFrame:
    return df.drop(*empty_columns(df, [c for c in columns if c in df.columns]))


@register_feature_step
class DateStep(FeatureStep):
    """Clean date and its parts; parts empty in the fitted table are left out for good."""

    kind = "DateTime"

    def __init__(self, feature: str) -> None:
        super().__init__(feature=feature)

    def fit(self, df: DataFrame) -> None:
        # one date that is not NULL fills every part, so one count decides for all
        full = df.agg(F.count(_stamp(df, self.params["feature"]))).first()[0]
        self.state = {"parts": list(PARTS) if full else []}

    def transform(self, df: DataFrame) -> DataFrame:
        column = self.params["feature"]
        made = part_columns(_stamp(df, column))
        kept: dict[str, Any] = {k: v for k, v in made.items() if k in self.state["parts"]}
        return dt_clean_date(df, column).withColumns(kept) if kept else dt_clean_date(df, column)
