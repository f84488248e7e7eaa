from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabprep.llm import packing
from tabprep.llm.packing import differencing, packed, windows

from .conftest import clashing, hard_rows, rows

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_sums(sizes, k):
    window, most = differencing(np.array(sizes), k)
    sums = np.bincount(window, weights=sizes, minlength=k)
    assert len(window) == len(sizes) and window.max() < k and sums.max() == most
    assert sums.max() - sums.min() <= max(sizes)  # no window could take its largest piece from another


def test_differencing_beats_order():
    window, most = differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert most <= 16 and sorted(np.bincount(window, weights=[8, 7, 6, 5, 4])) == [14, 16]


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold(sizes):
    window = windows(np.array(sizes), 100)
    assert np.bincount(window, weights=sizes).max() <= 100


def test_pieces(hard):
    library = Tokenizer.from_file(VOCABULARY)
    found = packed(clashing(hard), VOCABULARY, capacity=256).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_document[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    expected = defaultdict(list)
    for doc, text, *_ in hard_rows():
        expected[doc].append(array("I", library.encode(text or "", add_special_tokens=False).ids + [1]).tobytes())
    assert by_document.keys() == expected.keys()
    for doc, texts in expected.items():
        # repeated ids: the pieces of all texts together hold all ids
        assert sum(p[1] for p in by_document[doc]) * 4 == sum(map(len, texts))
        if len(texts) == 1:
            parts = sorted(by_document[doc])
            assert b"".join(p[2] for p in parts) == texts[0] and {p[3] for p in parts} == {len(texts[0]) // 4}


def test_little_padding(spark, folder):
    found = packed(spark.read.parquet(f"{folder}/documents.parquet").coalesce(1), VOCABULARY)
    ids, sequences = found.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert ids / (2048 * sequences) > 0.95


def test_empty_table(none):
    assert rows(packed(none, VOCABULARY)) == []


def dense_differencing(sizes, k):
    """The method as it is written down: k sums for every partial partition, zeros too, sorted after every merge."""
    parts = [([size] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)], i) for i, size in enumerate(sizes)]
    for count in range(len(sizes), 2 * len(sizes) - 1):
        parts.sort(key=lambda p: (p[0][-1] - p[0][0], p[2]))
        (sums, held, _), (others, more, _), *parts = parts
        merged = [(a + b, x + y) for a, b, x, y in zip(sums, reversed(others), held, reversed(more))]
        merged.sort(key=lambda p: -p[0])
        parts.append(([s for s, _ in merged], [h for _, h in merged], count))
    window = {i: w for w, members in enumerate(parts[0][1]) for i in members}
    return [window[i] for i in range(len(sizes))], parts[0][0][0]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.integers(1, 35))
def test_differencing_ties(sizes, k):
    window, most = differencing(np.array(sizes), k)
    assert (window.tolist(), most) == dense_differencing(sizes, k)


def test_differencing_sorts_few(monkeypatch):
    """A single piece goes to its place without a sort of all sums; the batch here has 400 pieces for 100 windows."""
    sorts = []
    monkeypatch.setattr(packing, "sorted", lambda *a, **k: sorts.append(1) or sorted(*a, **k), raising=False)
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    differencing(np.arange(400) % 97 + 1, 100)
    assert 0 < len(sorts) < 200
