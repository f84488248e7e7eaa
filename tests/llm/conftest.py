import random

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = "the an er on re in at ou ti es ha en nd ea".split()
    words = ["".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 3)))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


def hard_rows():
    """Nulls in every column, empty and blank texts, a very long text, other scripts, ties and repeated rows."""
    copied = prose(1, 120)
    return [
        (1, copied, "en", "a", 1),
        (2, copied, "en", "b", 1),
        (3, copied.upper(), "en", None, None),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "en", "a", 4),
        (7, prose(7, 20_000), "en", "a", 1),
        (8, "É́ naïve don't 'S x\x1cy İ ﬁ <|endoftext|> 12.5%  中文 ǅ", "xx", "b", 1),
        (8, "É́ naïve don't 'S x\x1cy İ ﬁ <|endoftext|> 12.5%  中文 ǅ", "xx", "b", 1),
        (9, "one two", "en", "", 7),
        (9, prose(9, 200), "en", "a", 1),
        (None, prose(10, 60), "en", "a", 1),
        (-5, "x" * 5000, "en", "c", 5000),
        (10, "only", None, "c", 4),
    ]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


CLASHING = "row words n_words kept score size target taken key range cell chunk rep class label node u v ids start nr block found spans".split()


def clashing(df):
    """The same table with columns named like those operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("a.b c", F.lit(1))




def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
