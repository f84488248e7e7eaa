"""Fit many column steps in few passes, then turn them into one projection."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col, data_type, require
from ..functions.levels import most_frequent, value_counts
from ..functions.quantiles import refine, sketch_aggregates
from .step import ColumnStep

HELD_LEVELS = 10_000  # level counts that may reach the driver in one go
DECIMAL = "decimal digits"  # marks a decimal in saved JSON
WAVE_WIDTH = 400  # aggregates per job; more would outgrow generated code


class Pipeline:
    """Ordered steps per column. `fit` learns wave by wave: one step of every column at a time."""

    def __init__(
        self,
        steps: Sequence[ColumnStep],
        not_null: Sequence[str] = (),
        distinct_on: Sequence[str] | None = None,
        target: str | None = None,
        key: Sequence[str] = (),
        columns: Sequence[str] = (),
    ) -> None:
        self.steps = list(steps)
        self.not_null = list(not_null)
        self.distinct_on = None if distinct_on is None else list(distinct_on)
        self.target = target
        self.key = list(key)
        self.columns = list(dict.fromkeys([*columns, *[s.column for s in self.steps]]))

    # -- rows -------------------------------------------------------------------------------------

    def rows(self, df: DataFrame) -> DataFrame:
        """Row filters: duplicates first, then rows with gaps in the chosen columns."""
        from ..operators.rows import remove_duplicates, remove_null

        if self.distinct_on is not None:
            df = remove_duplicates(df, self.key, features=self.distinct_on)
        for name in self.not_null:
            df = remove_null(df, name)
        return df

    # -- fit --------------------------------------------------------------------------------------

    def fit(self, df: DataFrame) -> "PipelineModel":
        require(df, [*self.columns, *self.not_null, *([self.target] if self.target else [])])
        plan = _Plan(self.rows(df), self.key)
        queues = {c: [s for s in self.steps if s.column == c] for c in self.columns}
        while any(queues.values()):
            wave: list[ColumnStep] = []
            for name, queue in queues.items():
                # stateless steps need no pass: fold them until one has to learn
                while queue:
                    step = queue[0]
                    step.check(plan.dtype(name))
                    if step.stateful(plan.value(name)):
                        wave.append(step)
                        break
                    plan.apply(queue.pop(0))
            _learn(plan, wave)
            for step in wave:
                plan.apply(queues[step.column].pop(0))
        return PipelineModel(self)

    # -- requests ---------------------------------------------------------------------------------

    def to_dict(self) -> dict[str, Any]:
        return {
            "not_null": self.not_null,
            "distinct_on": self.distinct_on,
            "target": self.target,
            "key": self.key,
            "columns": self.columns,
            "steps": [s.to_dict() for s in self.steps],
        }


class PipelineModel:
    """Fitted steps; `transform` is a projection and runs no job for expression-only steps."""

    def __init__(self, pipeline: Pipeline) -> None:
        self.pipeline = pipeline

    @property
    def steps(self) -> list[ColumnStep]:
        return self.pipeline.steps

    def step(self, column: str, action: str) -> ColumnStep:
        return next(s for s in self.steps if s.column == column and s.action == action)

    def transform(self, df: DataFrame, drop_rows: bool = True) -> DataFrame:
        """Handled columns in request order, then untouched ones, then the target."""
        p = self.pipeline
        handled = p.columns
        rows = p.rows(df) if drop_rows else df
        plan = _Plan(rows, p.key)
        for step in p.steps:
            plan.apply(step)
        target = [p.target] if p.target in df.columns else []
        rest = [c for c in df.columns if c not in handled and c not in target]
        order = [*[c for c in handled if c not in target], *rest, *target]
        return plan.select(order)

    def to_json(self) -> str:
        return json.dumps(self.pipeline.to_dict(), default=_saved)

    @staticmethod
    def from_json(text: str) -> "PipelineModel":
        saved = json.loads(text, object_hook=_read)
        steps = [ColumnStep.from_dict(s) for s in saved.pop("steps")]
        return PipelineModel(Pipeline(steps, **saved))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PipelineModel":
        return PipelineModel.from_json(spark.read.text(path).first()[0])


def _saved(value: Any) -> Any:
    """Decimals keep all their digits as marked text; other values JSON lacks become text."""
    return {DECIMAL: str(value)} if isinstance(value, Decimal) else str(value)


def _read(found: dict[str, Any]) -> Any:
    return Decimal(found[DECIMAL]) if found.keys() == {DECIMAL} else found


class _Plan:
    """The source frame and, per column, its current outputs as expressions over that frame."""

    def __init__(self, df: DataFrame, key: Sequence[str]) -> None:
        self.df = df
        self.key = key
        self.current: dict[str, list[tuple[str, Column]]] = {c: [(c, col(c))] for c in df.columns}

    def value(self, name: str) -> Column:
        outputs = self.current[name]
        if len(outputs) != 1:
            raise ValueError(f"{name} was split into several columns; no further step fits")
        return outputs[0][1]

    def dtype(self, name: str):
        return data_type(self.df.select(self.value(name).alias(name)), name)

    def apply(self, step: ColumnStep) -> None:
        needs_table = type(step).joined is not ColumnStep.joined
        if needs_table:
            before = self.select(list(self.current))
            after = step.joined(before, self.key)
            if after is not None:
                names = {c: [n for n, _ in outs] for c, outs in self.current.items()}
                self.df = after
                self.current = {c: [(n, col(n)) for n in ns] for c, ns in names.items()}
                return
        self.current[step.column] = step.outputs(self.value(step.column))

    def select(self, order: Sequence[str]) -> DataFrame:
        return self.df.select(*[x.alias(n) for c in order for n, x in self.current[c]])


def _learn(plan: _Plan, wave: list[ColumnStep]) -> None:
    """One pass for aggregates and sketches, further passes only for exact quantiles, levels and searches."""
    if not wave:
        return
    values = {f"s{i}": plan.value(s.column) for i, s in enumerate(wave)}
    found: dict[str, dict[str, Any]] = {tag: {} for tag in values}
    aggregates: dict[str, Column] = {}
    ranked: dict[str, tuple[Column, list[float]]] = {}
    leveled: dict[str, Column] = {}
    for (tag, x), step in zip(values.items(), wave):
        aggregates.update({f"{tag}.{k}": a for k, a in step.aggregates(x).items()})
        shares = step.quantiles()
        if shares:
            ranked[tag] = (x, shares)
            aggregates.update(sketch_aggregates(tag, x, shares))
        if step.level_limit() is not None:
            leveled[tag] = x
    learned = run_aggregates(plan.df, aggregates)
    for name, value in learned.items():
        tag, _, key = name.partition(".")
        if key:
            found[tag][key] = value
    for tag, answers in (refine(plan.df, ranked, learned) if ranked else {}).items():
        found[tag]["quantiles"] = answers
    if leveled:
        limits = {tag: s.level_limit() or 0 for (tag, _), s in zip(values.items(), wave) if tag in leveled}
        for tag, answer in _levels(plan.df, leveled, limits).items():
            found[tag].update(answer)
    for (tag, x), step in zip(values.items(), wave):
        if step.level_limit() is not None and found[tag].get("levels", ()) is None:
            step.learn_many(plan.df, x)
    again = {tag: (step, more) for tag, step in zip(values, wave) if (more := step.learn(found[tag]))}
    while again:
        extra = {f"{t}.{k}": a for t, (_, more) in again.items() for k, a in more(values[t]).items()}
        learned = run_aggregates(plan.df, extra)
        parts = {t: {k.partition(".")[2]: v for k, v in learned.items() if k.startswith(f"{t}.")} for t in again}
        again = {t: (step, more) for t, (step, _) in again.items() if (more := step.learn(parts[t]))}


def run_aggregates(df: DataFrame, aggregates: dict[str, Column]) -> dict[str, Any]:
    """All aggregates in one job, or in a few when there are very many."""
    out: dict[str, Any] = {}
    items = list(aggregates.items())
    for i in range(0, len(items), WAVE_WIDTH):
        part = items[i : i + WAVE_WIDTH]
        row = df.agg(*[a.alias(f"a{j}") for j, (_, a) in enumerate(part)]).first()
        out.update({name: row[j] for j, (name, _) in enumerate(part)})
    return out


def _levels(df: DataFrame, values: dict[str, Column], limits: dict[str, int]) -> dict[str, dict[str, Any]]:
    """Per column its mode and, up to its limit, its (value, n) levels; None when there are more."""
    out: dict[str, dict[str, Any]] = {tag: {"mode": None, "levels": []} for tag in values}
    for counts in value_counts(df, values).values():
        room = max(HELD_LEVELS, (max(limits.values(), default=0) + 1) * len(values)) + 1
        rows = counts.limit(room).collect()
        if len(rows) < room:
            held: dict[str, list] = {}
            for r in rows:
                held.setdefault(r["column"], []).append((r["value"], r["n"]))
            for tag, levels in held.items():
                over = len(levels) > max(limits[tag], 0) and limits[tag] > 0
                out[tag] = {
                    "mode": min(levels, key=lambda p: (-p[1], p[0]))[0],
                    "levels": None if over else levels,
                }
            continue
        # too many levels to hold: the mode is found by a second aggregation over the counts
        for r in most_frequent(counts).collect():
            out[r["column"]] = {"mode": r["value"], "levels": None}
        sizes = {r["column"]: r["d"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
        small = [tag for tag, d in sizes.items() if d <= limits[tag]]
        if small:
            for r in counts.where(F.col("column").isin(small)).collect():
                if out[r["column"]]["levels"] is None:
                    out[r["column"]]["levels"] = []
                out[r["column"]]["levels"].append((r["value"], r["n"]))
    return out
