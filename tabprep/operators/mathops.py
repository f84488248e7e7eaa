"""Arithmetic on one column."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, functions as F

from ..functions.columns import ratio
from ..plans.step import ColumnStep, default, register_step

# fixed values: operation names of requests, and those that need a number
OPERATIONS = ("log", "power", "add", "sub", "mul", "div", "boxcox", "reciprocal", "nthroot", "exp")
NEEDS_VALUE = ("log", "power", "add", "sub", "mul", "div", "nthroot")
DEFAULT_VALUE = 10
GRID = [i / 4 for i in range(-20, 21)]  # where the search for lambda begins; it goes beyond if the peak does
LAMBDA_STEP = 1e-6


def power_transform(x: Column, lam: float) -> Column:
    """Box–Cox: (x^l - 1) / l, the logarithm at l = 0; NULL unless x > 0."""
    y = F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)
    return F.when(x > 0, y)


@register_step
class MathOp(ColumnStep):
    """log, power, add, sub, mul, div, reciprocal, nthroot, exp, and Box–Cox with a fitted lambda."""

    action = "mathops"
    numeric_only = True

    def __init__(
        self,
        column: str,
        mathops_operation: str | None = "add",
        mathops_value: Any = None,
        grid: list[float] | None = None,
    ) -> None:
        if mathops_operation is None:
            raise ValueError("mathops needs an operation")
        super().__init__(column, mathops_operation=mathops_operation, mathops_value=mathops_value, grid=grid)
        self.operation = default(mathops_operation, "add").lower()
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation: {mathops_operation}")
        self.value = default(mathops_value, DEFAULT_VALUE)
        if self.operation in NEEDS_VALUE and (isinstance(self.value, bool) or not isinstance(self.value, (int, float))):
            raise TypeError(f"{self.operation} needs a number")

    def aggregates(self, x: Column) -> dict[str, Column]:
        if self.operation != "boxcox":
            return {}
        return self._likelihoods(x, self.params["grid"] or GRID)

    def _likelihoods(self, x: Column, grid: list[float]) -> dict[str, Column]:
        d = x.cast("double")
        out = {"n": F.count(d), "least": F.min(d), "logs": F.sum(F.when(d > 0, F.ln(d)))}
        for i, lam in enumerate(grid):
            out[f"var{i}"] = F.var_pop(power_transform(d, lam))
        return out

    def learn(self, found: dict[str, Any]):
        if self.operation != "boxcox":
            return None
        if found["n"] and found["least"] <= 0:
            raise ValueError(f"Box–Cox needs positive values: {self.column}")
        grid = self.state.get("grid") or self.params["grid"] or GRID

        def likelihood(i: int) -> float:
            var = found[f"var{i}"]
            if not var or not math.isfinite(var):
                return -math.inf
            return (grid[i] - 1) * found["logs"] - found["n"] / 2 * math.log(var)

        best = max(range(len(grid)), key=likelihood) if found["n"] else 0
        self.state["lambda"] = grid[best]
        step = grid[1] - grid[0] if len(grid) > 1 else 0
        if self.params["grid"] or step <= LAMBDA_STEP or not found["n"] or not math.isfinite(likelihood(best)):
            self.state.pop("grid", None)
            return None
        if best in (0, len(grid) - 1):
            # the likelihood has one peak, and it lies beyond the grid: go on in strides of twice the size
            stride = 2 * step * (1 if best else -1)
            finer = sorted(grid[best] + stride * (i - 1) for i in range(41))
        else:
            # look again, twenty times finer, around the best point
            finer = [grid[best] - step + step / 20 * i for i in range(41)]
        self.state["grid"] = finer
        return lambda x: self._likelihoods(x, finer)

    def expression(self, x: Column) -> Column:
        d, v = x.cast("double"), F.lit(float(self.value)) if self.operation in NEEDS_VALUE else None
        if self.operation == "log":
            return F.when(d > 0, F.log(float(self.value), d))
        if self.operation == "power":
            return F.pow(d, v)
        if self.operation == "add":
            return x + F.lit(self.value)
        if self.operation == "sub":
            return x - F.lit(self.value)
        if self.operation == "mul":
            return x * F.lit(self.value)
        if self.operation == "div":
            return ratio(d, v)
        if self.operation == "reciprocal":
            return ratio(F.lit(1.0), d)
        if self.operation == "nthroot":
            return F.when(d >= 0, F.pow(d, ratio(F.lit(1.0), v)))
        if self.operation == "exp":
            return F.exp(d)
        return power_transform(d, self.state["lambda"])
