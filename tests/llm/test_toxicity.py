import random
import zlib

import pytest

from tabprep.llm.toxicity import Grammar, _Weights, clause_weight, features, op5_toxicity, text_score, toxicity, training_texts

from .conftest import clashing, hard_rows, prose, rows

GRAMMAR = Grammar()
LEXICON = _Weights({b"idiot": 4.0, b"vequ*": 3.0})


def weight(text):
    return clause_weight(text.encode().split(), LEXICON, GRAMMAR)


def test_transducers():
    assert weight("what an idiot") == 4.0
    assert weight("you idiot") == 4.0 * GRAMMAR.targeted
    assert weight("not an idiot") == 4.0 * GRAMMAR.negated and weight("no it was some idiot") == 4.0
    assert weight("one said idiot") == 4.0 * GRAMMAR.reported and weight("idiot one said") == 4.0
    assert weight("vequance") == 3.0 and weight("vequ") == 0.0
    assert weight("they kill") == 0.0 and weight("kill time") == 0.0
    assert weight("kill you") == GRAMMAR.threat * GRAMMAR.targeted
    assert weight("") == 0.0


def test_score_is_a_share():
    low, none = text_score(b"", LEXICON, -2.0, GRAMMAR)
    high, many = text_score(b"idiot. " * 500, LEXICON, -2.0, GRAMMAR)
    assert 0 < low < 0.5 < high < 1 and (none, many) == (0, 500)


def test_features():
    assert features("Éa idiots x".encode()) == {"Éa".encode(), b"x", b"idiots", b"idio*", b"idiot*"}


def corpus(n=600):
    rng = random.Random(6)
    given, labels = [], []
    for i in range(n):
        words = prose(i, 80).split()
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "grulk" + rng.choice("abcdefgh") + "ing", "loser"]))
        if i % 7 == 0:
            words.insert(3, "losesome")
        given.append((i, " ".join(words)))
        labels.append((i, toxic))
    copies = [(n + i, prose(10_000, 80)) for i in range(200)]  # one toxic text copied often must not make its words toxic
    return given + copies, labels + [(d, 1) for d, _ in copies]


def test_held_out(spark):
    given, labels = corpus()
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
    found = toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    truth = dict(labels)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
    out = [r for r in found if r.held_out and r.doc_id < 600]
    assert all(r.predicted == truth[r.doc_id] for r in out)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    given, labels = corpus()
    docs = spark.createDataFrame(given, "doc_id bigint, text string")
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, t in labels]
    a, b = (rows(toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int"))) for x in (labels, turned))
    assert a == b


def test_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (7, 0), (None, 1), (8, 5)], "doc_id bigint, toxic int")
    found = toxicity(clashing(hard), clashing(labels)).collect()
    assert len(found) == len(hard_rows()) and all(0 <= r.score <= 1 for r in found)
    assert rows(toxicity(none, labels)) == []
    blank = toxicity(hard, labels.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}


def test_query(spark, folder):
    if "sf0.001" not in folder:
        pytest.skip("small tables only")
    assert op5_toxicity(spark, folder).count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_insults_of_a_small_language_are_learnt(spark):
    rng = random.Random(12)
    rare = ["".join(rng.choices("bdgklmnprstvz", k=8)) for _ in range(12)]
    given, labels = [], []
    for i in range(9200):
        words = prose(i, 30).split()
        toxic = int(i % 2 == 0)
        small = i >= 9000
        if toxic:
            words += rng.sample(rare, 3) if small else ["moron", "scum"]
        given.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(4)
    found = toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).where("held_out and doc_id >= 9000").collect()
    assert len(found) > 40 and all(r.predicted == (r.doc_id % 2 == 0) for r in found)


def test_families_are_verified_copies(spark):
    passage = prose(77, 50)
    shared = [(i, f"{prose(100 + i, 50)} {passage}") for i in range(60)]  # one passage does not make a family
    copy = prose(78, 200)
    near = [(1000 + i, f"{copy} tail{i}") for i in range(20)]  # near copies of either label
    given = shared + near + [(1000, f"{copy} tail0")]
    labels = [(d, int(d >= 1010)) for d, _ in shared + near]
    out = {d for d, _ in shared + near if zlib.crc32(str(d).encode()) % 3 == 1}
    docs = spark.createDataFrame(given, "doc_id bigint, text string").repartition(4)
    texts, sizes = training_texts(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    found = texts.collect()
    expected = sorted([(0, t) for d, t in shared if d not in out] + [(k, min((d, t) for d, t in near if d not in out and (d >= 1010) == k)[1]) for k in (0, 1)])
    assert sorted((r.toxic, r.text) for r in found) == expected and sizes == {0: len(expected) - 1, 1: 1}
