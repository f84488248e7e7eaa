"""Exact quantiles without holding a column in one aggregation buffer.

Up to SMALL values a column fits one buffer and the built-in exact percentile is used. Beyond that a
quantile sketch brackets each wanted rank, the next pass counts the rows around the bracket, and the
few rows strictly inside it are fetched and sorted. Should they be more than SMALL, another sketch of
the inside narrows the bracket about 300 times per pass. Values equal to a bracket edge are only
counted, so a value that fills a third of the column costs nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000  # the sketch is off by at most 1/ACCURACY of the rows
MARGIN = 3.0 / ACCURACY
SMALL = 50_000
POINTS = 1_000
BATCH = 60  # brackets counted in one pass
COLUMNS = 40  # columns sketched in one pass


def sketch_aggregates(tag: str, value: Column, probabilities: list[float]) -> dict[str, Column]:
    """Aggregates of the first pass; the caller may put them in an agg with others."""
    points = []
    for p in probabilities:
        points += [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]
    x = value.cast("double")
    return {
        f"{tag}_n": F.count(x),
        f"{tag}_min": F.min(x),
        f"{tag}_max": F.max(x),
        f"{tag}_cuts": F.percentile_approx(x, points, F.lit(ACCURACY)),
    }


@dataclass
class _Target:
    """One wanted quantile and the bracket [lo, hi] that should hold its two ranks."""

    tag: str
    value: Column
    p: float
    n: int
    least: float
    most: float
    lo: float
    hi: float
    bound: float = 0.0  # about how many rows lie strictly inside the bracket
    answer: float | None = None
    ranks: tuple[int, int] = field(init=False)

    def __post_init__(self) -> None:
        base = math.floor((self.n - 1) * self.p)
        self.ranks = (base, min(base + 1, self.n - 1))
        self.bound = 4 * MARGIN * self.n

    def inside(self) -> Column:
        return (self.value > self.lo) & (self.value < self.hi)

    def counts(self) -> dict[str, Column]:
        """Rows below, at the lower edge, inside, at the upper edge; a finer sketch if inside is large."""
        x = self.value
        out = {
            "below": F.count_if(x < self.lo),
            "at_lo": F.count_if(x == self.lo),
            "inside": F.count_if(self.inside()),
            "at_hi": F.count_if((x == self.hi) & (x > self.lo)),
        }
        if self.bound > SMALL:
            shares = [i / POINTS for i in range(POINTS + 1)]
            out["cuts"] = F.percentile_approx(F.when(self.inside(), x), shares, F.lit(ACCURACY))
        return out

    def settle(self, r: dict, values: list[float] | None) -> None:
        """Answer the quantile if both ranks are known."""
        start = r["below"] + r["at_lo"]
        end = start + r["inside"]
        found = []
        for rank in self.ranks:
            if r["below"] <= rank < start:
                found.append(self.lo)
            elif start <= rank < end and values is not None:
                found.append(values[rank - start])
            elif end <= rank < end + r["at_hi"]:
                found.append(self.hi)
        if len(found) == 2:
            self.answer = found[0] + (found[1] - found[0]) * ((self.n - 1) * self.p - self.ranks[0])

    def fetchable(self, r: dict) -> bool:
        """Whether the inside holds a wanted rank and is small enough to bring to the driver."""
        start = r["below"] + r["at_lo"]
        return r["inside"] <= SMALL and any(start <= k < start + r["inside"] for k in self.ranks)

    def move(self, r: dict) -> None:
        """Shift or narrow the bracket for the next pass."""
        first, last = self.ranks
        start = r["below"] + r["at_lo"]
        beyond = start + r["inside"] + r["at_hi"]
        if first < r["below"]:
            self.lo, self.bound = self.least, self.bound + r["below"]
        elif last >= beyond:
            self.hi, self.bound = self.most, self.bound + self.n - beyond
        elif "cuts" in r:
            grid = [self.lo, *r["cuts"], self.hi]
            step = r["inside"] / POINTS
            left = max(0, math.floor((first - start) / step) - 1)
            right = min(len(grid) - 1, math.ceil((last - start) / step) + 3)
            self.lo, self.hi = grid[left], grid[right]
            self.bound = step * (right - left + 1)
        else:
            self.bound = r["inside"]


def _fetch(df: DataFrame, targets: list[_Target]) -> list[list[float]]:
    """The sorted values inside each bracket; their numbers were counted before."""
    hits = F.array(*[F.when(t.inside(), F.struct(F.lit(i).alias("i"), t.value.alias("x"))) for i, t in enumerate(targets)])
    out: list[list[float]] = [[] for _ in targets]
    for row in df.select(F.inline(F.filter(hits, lambda h: h.isNotNull()))).collect():
        out[row["i"]].append(row["x"])
    return [sorted(v) for v in out]


def _search(df: DataFrame, waiting: list[_Target]) -> None:
    while waiting:
        row = df.agg(
            *[c.alias(f"{k}{i}") for i, t in enumerate(waiting) for k, c in t.counts().items()]
        ).first().asDict()
        found = [{k: row[f"{k}{i}"] for k in t.counts()} for i, t in enumerate(waiting)]
        few = [i for i, t in enumerate(waiting) if t.fetchable(found[i])]
        values = dict(zip(few, _fetch(df, [waiting[i] for i in few]))) if few else {}
        for i, t in enumerate(waiting):
            t.settle(found[i], values.get(i))
            if t.answer is None:
                t.move(found[i])
        waiting = [t for t in waiting if t.answer is None]


def refine(
    df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], first: dict
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles from the first pass `first` (values of the sketch aggregates) and further passes."""
    done: dict[str, dict[float, float | None]] = {tag: {} for tag in wanted}
    small: dict[str, tuple[Column, list[float]]] = {}
    large: list[_Target] = []
    for tag, (value, probabilities) in wanted.items():
        n, least, most = first[f"{tag}_n"], first[f"{tag}_min"], first[f"{tag}_max"]
        x = value.cast("double")
        for j, p in enumerate(probabilities):
            lo, hi = first[f"{tag}_cuts"][2 * j : 2 * j + 2] if n else (None, None)
            if not n:
                done[tag][p] = None
            elif p <= 0.0 or p >= 1.0 or least == most:
                done[tag][p] = least if p <= 0.0 else most
            elif n <= SMALL:
                small.setdefault(tag, (x, []))[1].append(p)
            elif lo == hi and MARGIN < p < 1 - MARGIN:
                done[tag][p] = lo
            else:
                large.append(_Target(tag, x, p, n, least, most, lo, hi))
    if small:
        row = df.agg(*[F.percentile(x, F.array(*[F.lit(p) for p in ps])) for x, ps in small.values()]).first()
        for (tag, (_, ps)), answers in zip(small.items(), row):
            done[tag].update(zip(ps, answers))
    for i in range(0, len(large), BATCH):
        _search(df, large[i : i + BATCH])
    for t in large:
        done[t.tag][t.p] = t.answer
    return done


def exact_quantiles(
    df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]
) -> dict[str, dict[float, float | None]]:
    """{tag: {p: value}} with linear interpolation, for any number of columns in shared passes."""
    out: dict[str, dict[float, float | None]] = {}
    tags = list(wanted)
    for i in range(0, len(tags), COLUMNS):
        part = {tag: wanted[tag] for tag in tags[i : i + COLUMNS]}
        aggregates: dict[str, Column] = {}
        for tag, (value, probabilities) in part.items():
            aggregates.update(sketch_aggregates(tag, value, probabilities))
        first = df.agg(*[c.alias(k) for k, c in aggregates.items()]).first().asDict()
        out.update(refine(df, part, first))
    return out
