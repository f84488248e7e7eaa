import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from tabprep.llm.secrets import base_spans

from .conftest import DOCUMENT, clashing, prose, rows
from .test_minhash import plain_groups
from .test_mixing import shares
from .test_quality import plain


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def documents(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [s.columns for s in stages[1:5]] == [stages[0].columns] * 4


def test_quality(stages):
    before, after = documents(stages[0]), documents(stages[1])
    for doc, r in before.items():
        n, _, _, _, repeats = plain(r.text)
        if n < 50 or 100 * repeats > 50 * n:
            assert doc not in after
    assert all(after[d] == before[d] for d in after) and len(after) > 0.5 * len(before)


def test_dedup(stages):
    before, after = documents(stages[1]), documents(stages[2])
    groups = plain_groups([(r.doc_id, r.text) for r in before.values()], 5)
    assert after == {c: before[c] for _, _, c in groups}


def test_secrets(stages):
    before, after = documents(stages[2]), documents(stages[3])
    assert before.keys() == after.keys()
    for doc, r in before.items():
        if base_spans(r.text):
            assert not base_spans(after[doc].text) and pipeline.REDACTED in after[doc].text
            assert after[doc].n_chars == len(after[doc].text)
        else:
            assert after[doc] == r


def test_mixing(stages):
    before = documents(stages[3])
    sizes = defaultdict(int)
    for r in before.values():
        sizes[r.source] += len(r.text.split())
    target, taken = shares(sizes), Counter()
    for r in stages[4].collect():
        assert before[r.doc_id].text.startswith(r.text)
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_packing(stages):
    pieces = stages[5].collect()
    held = Counter()
    for r in pieces:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and {r.doc_id for r in pieces} == {r.doc_id for r in stages[4].collect()}


def test_stages_on_hard_rows(spark, hard, none):
    long = [(20 + i, prose(20 + i, 150) + f" token = {i}abcdef0123456789abcdef0123", "en", f"s{i % 2}", 1) for i in range(6)]
    many = hard.unionByName(spark.createDataFrame(long + long[:2], DOCUMENT))
    for given in (many, clashing(many)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, given, "").count() > 0
    kept = pipeline.minhash_dedup(spark, many, "")
    assert Counter(r.doc_id for r in kept.collect())[20] == 1  # repeated rows become one
    for name, stage in pipeline.STAGES:
        assert rows(stage(spark, none, "")) == [], name


def test_redacted():
    assert pipeline.redacted("abcdefghij", [(6, 8), (1, 3), (2, 4)]) == "a[SECRET]ef[SECRET]ij"
    assert pipeline.redacted("abc", []) == "abc" and pipeline.redacted("abc", [(0, 3)]) == "[SECRET]"


def test_first_words():
    text = " one\ttwo \x1c three "
    assert pipeline.first_words(text, 2) == " one\ttwo" and pipeline.first_words(text, 9) == text
    assert len(re.findall(pipeline.WORD, text)) == 4


def test_rows_that_differ_in_where_a_null_stands(spark):
    """Equal texts without id are told apart by their other columns, maps among them; whole repeats become one."""
    text = prose(3, 80)
    given = [(None, text, "x", None, {"a": 1}), (None, text, None, "x", {"a": 1}), (None, text, None, "x", {"a": 2}), (None, text, None, "x", {"a": 2}), (5, text, None, None, None)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, extra map<string,int>")
    kept = pipeline.minhash_dedup(spark, docs, "")
    found = sorted(((r.doc_id, r.lang, r.source, (r.extra or {}).get("a")) for r in kept.collect()), key=str)
    assert found == sorted([(None, "x", None, 1), (None, None, "x", 1), (None, None, "x", 2), (5, None, None, None)], key=str)
