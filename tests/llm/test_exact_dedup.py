import hashlib

import pytest
from pyspark.sql import functions as F

from tabprep.llm.exact_dedup import exact_duplicates

from .conftest import DOCUMENT, clashing, hard_rows, rows

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain(given, normalise=lambda text: text):
    groups = {}
    for row in given:
        groups.setdefault(normalise(row[1] or ""), []).append(row[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), nr == 0, digest) for nr, i in enumerate(ids)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def many():
    """One text a third of all rows, whole rows repeated, groups without ids."""
    given = hard_rows() + [(1000 + i, "hot", "en", "a", 3) for i in range(200)] + [(7, "again", "en", "a", 5)] * 60
    return given + [(None, "lost", None, None, None)] * 30 + [(None, "half", "en", "a", 4)] * 20 + [(5000, "half", "en", "a", 4)] * 3


@pytest.mark.parametrize("group_rows", [1, 7, 4096])
def test_groups(spark, group_rows):
    df = clashing(spark.createDataFrame(many(), DOCUMENT)).withColumns({c: F.lit("x") for c in ("sha", "salt", "n", "top", "ids", "best", "holds")}).repartition(5)
    assert rows(exact_duplicates(df, group_rows=group_rows), *COLUMNS) == plain(many())


def test_few_digests_may_be_salted(spark):
    df = spark.createDataFrame(many(), DOCUMENT).repartition(3)
    assert rows(exact_duplicates(df, group_rows=1, hot_digests=2), *COLUMNS) == plain(many())


def test_equal_digests_of_different_texts(spark, monkeypatch):
    """Texts decide even where all digests are the same."""
    monkeypatch.setattr("pyspark.sql.functions.sha2", lambda text, bits: F.lit("ab" * 32))
    found = exact_duplicates(spark.createDataFrame(many(), DOCUMENT).repartition(3), group_rows=7)
    assert rows(found, *COLUMNS[:4]) == sorted(((r[:4]) for r in plain(many())), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_normalised(spark, hard):
    found = exact_duplicates(hard, normalised=F.lower("text"), group_rows=1)
    assert rows(found, *COLUMNS) == plain(hard_rows(), str.lower)


def test_nothing(spark, none):
    assert rows(exact_duplicates(none)) == []


def test_plan_is_native(spark, hard, capsys):
    exact_duplicates(hard).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
