"""Categories to numbers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.choose import mapped
from ..functions.columns import col, require
from ..functions.levels import level_counts, lookup
from ..plans.step import ColumnStep, default, register_step
from ..session import scratch_path
from .rank import global_rank

MAX_LEVELS = 1_000


def one_hot_name(column: str, level: Any) -> str:
    return f"Trans_{column}__x0_{level}"


@register_step
class Encode(ColumnStep):
    """Ordinal: sorted levels become 0, 1, 2…. One-hot: one 0/1 column per level, NULL and unseen all zero.

    Up to MAX_LEVELS levels are held as literals. Of a column with more, ordinal levels are written as a table in the shared
    folder, which the fitted step names, and codes are joined. `max_levels` limits the columns that one-hot may make; more
    levels are an error.
    """

    action = "encode"

    def __init__(self, column: str, enc_method: str | None = "ordinal encoder", max_levels: int = MAX_LEVELS) -> None:
        if enc_method is None:
            raise ValueError("encode needs a method")
        super().__init__(column, enc_method=enc_method, max_levels=max_levels)
        self.method = default(enc_method, "ordinal encoder").lower()
        if self.method not in ("ordinal encoder", "onehot encoder"):
            raise ValueError(f"unknown encode method: {enc_method}")

    def level_limit(self) -> int:
        return self.params["max_levels"] if self.method == "onehot encoder" else MAX_LEVELS

    def learn_many(self, df: DataFrame, x: Column) -> None:
        if self.method == "onehot encoder":
            raise ValueError(f"{self.column} has more than {self.level_limit()} levels: raise max_levels to make a column of each")
        path = scratch_path(df.sparkSession, "levels")
        ordinal_levels(df.select(x.alias("value")), "value").select("value", "code").write.parquet(path)
        self.state["table"] = path

    def learn(self, found: dict[str, Any]) -> None:
        if found["levels"] is not None:
            self.state["levels"] = sorted(v for v, _ in found["levels"])

    def joined(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame | None:
        if "table" not in self.state:
            return None
        return apply_ordinal_levels(df, self.column, df.sparkSession.read.parquet(self.state["table"]))

    def expression(self, x: Column) -> Column:
        if not self.state["levels"]:
            return F.lit(None).cast("int")
        code = mapped(x, {v: i for i, v in enumerate(self.state["levels"])})
        unseen = F.raise_error(F.concat(F.lit(f"unseen level in {self.column}: "), x.cast("string"))).cast("int")
        return F.when(x.isNotNull(), F.coalesce(code, unseen))

    def outputs(self, x: Column) -> list[tuple[str, Column]]:
        if self.method == "ordinal encoder":
            return [(self.column, self.expression(x))]
        return [
            (one_hot_name(self.column, v), x.eqNullSafe(F.lit(v)).cast("double")) for v in self.state["levels"]
        ]

    def decode(self, code: Column) -> Column:
        """Codes back to levels held as literals: rounded and limited to the code range."""
        if "table" in self.state:
            raise ValueError(f"the levels of {self.column} are a table: join it on code")
        levels = self.state["levels"]
        spot = F.greatest(F.least(F.round(code).cast("int"), F.lit(len(levels) - 1)), F.lit(0))
        return F.when(code.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in levels]), spot + 1))


def ordinal_levels(df: DataFrame, column: str) -> DataFrame:
    """(value, n, code): the sorted levels of a column as a table, for any number of levels."""
    return global_rank(level_counts(df, column), ["value"], ["value"], "code")


def apply_ordinal_levels(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Replace a column by its code from `ordinal_levels`; a level not in the table is an error."""
    joined = lookup(df, col(column), levels, "code")
    unseen = F.raise_error(F.concat(F.lit(f"unseen level in {column}: "), col(column).cast("string"))).cast("bigint")
    code = F.when(col(column).isNotNull(), F.coalesce(F.col("code"), unseen))
    return joined.withColumn(column, code).select(*[col(c) for c in df.columns])


def encode_ordinal(df: DataFrame, column: str) -> DataFrame:
    """Ordinal codes for any number of levels: literals when few, a level table otherwise."""
    require(df, [column])
    from ..plans.pipeline import Pipeline

    return Pipeline([Encode(column)]).fit(df).transform(df)


def decode_categories(df: DataFrame, encoders: Sequence[Encode]) -> DataFrame:
    """Codes back to labels for every fitted ordinal encoder."""
    return df.withColumns({e.column: e.decode(col(e.column)) for e in encoders})
