"""Random numbers that depend only on a row's key, so every run and every partitioning agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SPAN = 1 << 32


def hash32(seed: int | str, *parts: Column) -> Column:
    """Uniform integer in [0, 2^32) from the md5 of seed|part|part…"""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash60(seed: int | str, *parts: Column) -> Column:
    """Uniform integer in [0, 2^60), for draws among more rows than 32 bits can number."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int | str, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(seed, *parts) / F.lit(float(SPAN))


def gauss(seed: int | str, *parts: Column) -> Column:
    """Standard normal by Box–Muller over two hash uniforms; the first is kept above zero."""
    first = (hash32(f"{seed}a", *parts) + F.lit(1)) / F.lit(float(SPAN + 1))
    second = uniform(f"{seed}b", *parts)
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2.0 * math.pi) * second)


def digest(*values: Column) -> list[Column]:
    """128 hash bits of some values as two whole numbers; nulls count by their place."""
    gaps = F.concat(*[F.when(v.isNull(), F.lit("1")).otherwise(F.lit("0")) for v in values])
    return [F.xxhash64(gaps, *values).alias("__h1"), F.xxhash64(F.lit(1), gaps, *values).alias("__h2")]
