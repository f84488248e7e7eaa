"""Feature requests: dates, powers, arithmetic, collinearity, components, always in this order."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from ..functions.columns import col, require
from ..operators import collinear, combine, dates  # noqa: F401  (register the steps)
from .feature_step import FEATURE_STEPS, FeatureChain, FeatureStep

ORDER = ("DateTime", "polynomial_Features", "math_Ops", "multiCollinearity", "PCA")


def read_request(request: dict[str, dict[str, Any]], carried: Sequence[str]) -> list[FeatureStep]:
    unknown = set(request) - set(ORDER)
    if unknown:
        raise ValueError(f"unknown feature request: {sorted(unknown)}")
    if "DateTime" in request and "PCA" in request:
        raise ValueError("dates and components cannot be requested together")
    steps = []
    for kind in ORDER:
        if kind in request:
            params = dict(request[kind])
            if not all(v not in (None, "", []) for v in params.values()):
                raise ValueError(f"empty value in {kind}")
            if kind in ("multiCollinearity", "PCA"):
                params["carried"] = list(carried)
            steps.append(FEATURE_STEPS[kind](**params))
    return steps


def feature_engineer(
    df: DataFrame, request: dict[str, Any], target: str | None = None, key: Sequence[str] = ()
) -> tuple[DataFrame, FeatureChain]:
    """Fit and apply a request to all columns but the target (the last by default) and the key."""
    target = target or df.columns[-1]
    require(df, [target, *key])
    carried = [*key, target]
    chain = FeatureChain(read_request(request, carried), carried)
    current = df
    for step in chain.steps:
        step.fit(current)
        current = step.transform(current)
    return _ordered(current, carried), chain


def fe_pipeline(df: DataFrame, request: dict[str, Any], target: str | None = None, key: Sequence[str] = ()) -> DataFrame:
    return feature_engineer(df, request, target, key)[0]


def fe_apply(df: DataFrame, model: FeatureChain | str) -> DataFrame:
    """Apply a fitted chain, or its JSON, to new data; the target may be absent."""
    model = FeatureChain.from_json(model) if isinstance(model, str) else model
    return _ordered(model.transform(df), model.carried)


def _ordered(df: DataFrame, carried: Sequence[str]) -> DataFrame:
    last = [c for c in carried if c in df.columns]
    return df.select(*[col(c) for c in [*[c for c in df.columns if c not in last], *last]])
