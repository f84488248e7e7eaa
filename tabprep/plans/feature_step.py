"""Steps over whole tables, folded in a fixed order by a feature request."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any, ClassVar

from pyspark.sql import DataFrame

FEATURE_STEPS: dict[str, type["FeatureStep"]] = {}


def register_feature_step(cls: type["FeatureStep"]) -> type["FeatureStep"]:
    FEATURE_STEPS[cls.kind] = cls
    return cls


class FeatureStep:
    """`fit` learns plain values into `state`; `transform` adds or replaces columns without a job."""

    kind: ClassVar[str] = ""

    def __init__(self, **params: Any) -> None:
        self.params = params
        self.state: dict[str, Any] = {}

    def fit(self, df: DataFrame) -> None:
        return None

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def to_dict(self) -> dict[str, Any]:
        return {"kind": self.kind, "params": self.params, "state": self.state}

    @staticmethod
    def from_dict(saved: dict[str, Any]) -> "FeatureStep":
        step = FEATURE_STEPS[saved["kind"]](**saved["params"])
        step.state = saved["state"]
        return step


class FeatureChain:
    """Fitted feature steps and the columns carried past them (target, keys)."""

    def __init__(self, steps: Sequence[FeatureStep], carried: Sequence[str]) -> None:
        self.steps = list(steps)
        self.carried = list(carried)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def to_json(self) -> str:
        return json.dumps({"carried": self.carried, "steps": [s.to_dict() for s in self.steps]})

    @staticmethod
    def from_json(text: str) -> "FeatureChain":
        saved = json.loads(text)
        return FeatureChain([FeatureStep.from_dict(s) for s in saved["steps"]], saved["carried"])
