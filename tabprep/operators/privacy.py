"""Masking and finding personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, require

# fixed values: what a value must contain to look like personal data
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(^|[^0-9A-Za-z])[+]?[0-9]{1,3}[ .-]?[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-]?[0-9]{4}([^0-9A-Za-z]|$)",
    "card": r"(^|[^0-9A-Za-z])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9A-Za-z]|$)",
    "ip": r"(^|[^0-9.])[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}([^0-9.]|$)",
}
BLOCK = 64


def masked(value: Column, secret: str) -> Column:
    """Letters a … p of the same length from a keyed digest: equal values stay equal everywhere.

    The value is digested once; the digest and a counter give as many blocks as the length needs, so
    the work grows with the length alone. Nothing is remembered between rows, so any number of tasks
    agree. Short values may collide.
    """
    size = F.length(value)
    last = F.greatest(F.ceil(size / F.lit(BLOCK)) - 1, F.lit(0))
    core = F.sha2(F.concat(F.lit(f"{secret}:"), value), 256)

    def blocks(digest: Column) -> Column:
        counter = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
        return F.array_join(F.transform(counter, lambda b: F.sha2(F.concat(digest, F.lit(":"), b.cast("string")), 256)), "")

    # bound as a lambda variable, the digest is computed once per value and not once per block
    letters = F.translate(F.element_at(F.transform(F.array(core), blocks), 1), "0123456789", "ghijklmnop")
    return F.when(value.isNotNull(), F.substring(letters, F.lit(1), size))


def pii_mask(df: DataFrame, columns: Sequence[str], secret: str) -> DataFrame:
    """Mask columns; they move behind the others."""
    require(df, columns)
    rest = [col(c) for c in df.columns if c not in columns]
    return df.select(*rest, *[masked(col(c).cast("string"), secret).alias(c) for c in columns])


# what every match holds, tested first; and an email's last character before the sign proves as much as all of them
SIGNS = {"phone": "[0-9]{3}", "card": "[0-9]{4}", "ip": "[0-9][.][0-9]+[.][0-9]"}
ONE_BEFORE = PATTERNS["email"].replace("+-]+@", "+-]@")


def _looks_like(value: Column, pattern: str) -> Column:
    """Regex test, tried only where the sign every match must hold occurs at all."""
    if pattern == "email":
        return F.contains(value, F.lit("@")) & value.rlike(ONE_BEFORE)
    return value.rlike(SIGNS[pattern]) & value.rlike(PATTERNS[pattern])


def pii_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, pattern, matches, share) of every text column and pattern, in one aggregation."""
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    require(df, names)
    tests = [(n, p) for n in names for p in PATTERNS]
    counted = df.agg(
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
        *[F.count_if(_looks_like(col(n), p)).alias(f"{p}{names.index(n)}") for n, p in tests],
    )
    rows = []
    for n, p in tests:
        i = names.index(n)
        hits = F.col(f"{p}{i}")
        rows.append(
            F.struct(
                F.lit(n).alias("column"),
                F.lit(p).alias("pattern"),
                hits.alias("matches"),
                F.try_divide(hits.cast("double"), F.col(f"n{i}").cast("double")).alias("share"),
            )
        )
    return counted.select(F.inline(F.array(*rows)))


# fixed values: numbers with check digits, as they are written
CHECKED = {
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b",
}


def luhn(number: Column) -> Column:
    """Luhn's check (ISO/IEC 7812): from the right every second digit doubled, digits summed, a multiple of ten. Only digits count."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")

    def value(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.filter(digits, lambda d: d != ""), value)
    return (F.size(values) > 1) & (F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0)


def mod_97(number: Column) -> Column:
    """The check of an IBAN (ISO 7064): the first four signs last, letters as 10 to 35, a remainder of 1. Blanks do not count."""
    bare = F.replace(number, F.lit(" "), F.lit(""))
    signs = F.filter(F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def step(rest: Column, sign: Column) -> Column:
        letter = F.ascii(sign) - 55
        return F.when(sign.between("0", "9"), rest * 10 + sign.cast("int")).otherwise(rest * 100 + letter) % 97

    return F.aggregate(signs, F.lit(0), step) == 1


CHECKS = {"card": luhn, "iban": mod_97}


def checked_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, found, valid, values): numbers that look like a card's or an IBAN, those whose check digits hold, and the rows
    with one of the latter, of every text column, in one aggregation. A run of digits by chance passes one time in ten, or 97.

    Whole texts are searched; a null text has no numbers; numbers of a text count each time they stand there.
    """
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    require(df, names)
    counts = []
    for i, n in enumerate(names):
        for kind, pattern in CHECKED.items():
            numbers = F.coalesce(F.regexp_extract_all(col(n), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
            valid = F.size(F.filter(numbers, CHECKS[kind]))
            counts += [F.sum(F.size(numbers)).alias(f"{kind}{i}f"), F.sum(valid).alias(f"{kind}{i}v"), F.count_if(valid > 0).alias(f"{kind}{i}r")]
    wide = df.agg(*counts)
    rows = [
        F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind"), *[F.coalesce(F.col(f"{k}{i}{c}"), F.lit(0)).cast("bigint").alias(a) for c, a in (("f", "found"), ("v", "valid"), ("r", "values"))])
        for i, n in enumerate(names)
        for k in CHECKED
    ]
    return wide.select(F.inline(F.array(*rows)))
