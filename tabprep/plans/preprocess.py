"""Preprocess requests: {column: [{action: [{parameter: value}, …]}, …]}."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..functions.columns import require
from ..operators import bins, clip, encode, impute, mathops, scale  # noqa: F401  (register the steps)
from .pipeline import Pipeline, PipelineModel
from .step import STEPS, ColumnStep


def read_request(spec: dict[str, list[dict[str, list[dict[str, Any]]]]]) -> tuple[list[ColumnStep], list[str]]:
    """Steps in request order and the columns whose gaps remove rows."""
    steps: list[ColumnStep] = []
    not_null: list[str] = []
    for column, actions in spec.items():
        for entry in actions:
            for action, pairs in entry.items():
                name = action.lower()
                if name == "removenull":
                    not_null.append(column)
                elif name in STEPS:
                    params = {k: v for pair in pairs or [] for k, v in pair.items()}
                    steps.append(STEPS[name](column, **params))
                else:
                    raise ValueError(f"unknown action: {action}")
    return steps, not_null


def preprocess_pipeline(
    df: DataFrame,
    spec: dict[str, Any],
    target: str | None = None,
    removedup: bool = False,
    key: Sequence[str] = (),
) -> PipelineModel:
    """Fit a request. `key` columns order rows that are equal otherwise; they are no features."""
    require(df, [*spec, *([target] if target else []), *key])
    steps, not_null = read_request(spec)
    features = [c for c in df.columns if c != target and c not in key] if removedup else None
    return Pipeline(steps, not_null, features, target, key, list(spec)).fit(df)


def preprocess(df: DataFrame, spec: dict[str, Any], **options: Any) -> DataFrame:
    """Fit and transform in one call."""
    return preprocess_pipeline(df, spec, **options).transform(df)


def preprocess_apply(df: DataFrame, model: PipelineModel | str) -> DataFrame:
    """Apply a fitted request, or its saved JSON, to another table without fitting again."""
    model = PipelineModel.from_json(model) if isinstance(model, str) else model
    return model.transform(df, drop_rows=False)
