"""Train and test parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, require
from ..functions.hashing import hash32

SEED = 5
STEPS = 10_000


def in_test(key: Sequence[str], test_split: float = 0.2, seed: int = SEED) -> Column:
    """Whether a row falls in the test part: a hash of its key, the same in every run."""
    return F.pmod(hash32(seed, *[col(k) for k in key]), F.lit(STEPS)) < F.lit(round(test_split * STEPS))


def train_test_split(
    df: DataFrame, test_split: float = 0.2, key: Sequence[str] = (), seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test); without a key the whole row is hashed, so equal rows stay together."""
    if not 0 < test_split < 1:
        raise ValueError("test share must lie between 0 and 1")
    require(df, key)
    part = in_test(list(key) or df.columns, test_split, seed)
    return df.where(~part), df.where(part)
