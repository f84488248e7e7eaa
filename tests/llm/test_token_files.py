import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabprep.llm import elias_fano, token_files, tokens
from tabprep.session import scratch_path

from .conftest import clashing, hard_rows, rows

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1 << 40), max_size=600))
def test_elias_fano(values):
    values = sorted(values)
    code = elias_fano.EliasFano(len(values), *elias_fano.encode(np.array(values, dtype=np.uint64)))
    assert code.all().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert code.select(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    _, low, high, samples = elias_fano.encode(ends)
    assert len(low) + len(high) + len(samples) < 2 * 10_000  # 64-bit offsets take 80,000


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sStlLdDmMreVE.|<>!À-é"))), max_size=60))
def test_encoder_equals_library(text):
    expected = array("I", LIBRARY.encode(text, add_special_tokens=False).ids).tobytes()
    assert tokens.word_encoder(VOCABULARY).encode(text) == expected


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 3)
    encoder = tokens.WordEncoder(VOCABULARY)
    text = "one two three four five one two don't stop."
    assert encoder.encode(text) == array("I", LIBRARY.encode(text, add_special_tokens=False).ids).tobytes()
    assert len(encoder.words) <= 3


LETTERS = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t\r'sStlLdDmMreVE.,\"|<>!0À-éß")))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.one_of(st.text(alphabet=LETTERS, max_size=40), st.text(alphabet=" \n'strlvdm.!?7Àßÿ", max_size=40)), max_size=8))
def test_groups_equal_library(texts):
    expected = [(i, array("I", LIBRARY.encode(t, add_special_tokens=False).ids).tobytes()) for i, t in enumerate(texts)]
    assert list(tokens.word_encoder(VOCABULARY).encode_rows(enumerate(texts))) == expected


def test_groups_end(monkeypatch):
    """Groups closed by characters or by texts, and texts longer than a group, keep the order."""
    monkeypatch.setattr(tokens, "GROUP_CHARS", 30)
    monkeypatch.setattr(tokens, "GROUP_TEXTS", 3)
    texts = ["a", "", "b c", "d", "long " * 20, "中 e", "x" * 29, "f", "g"]
    expected = [(i, array("I", LIBRARY.encode(t, add_special_tokens=False).ids).tobytes()) for i, t in enumerate(texts)]
    assert list(tokens.word_encoder(VOCABULARY).encode_rows(enumerate(texts))) == expected


def test_groups_look_words_up_once():
    asked = []

    class Counted(tokens._Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    encoder = tokens.WordEncoder(VOCABULARY)
    encoder.words = Counted(LIBRARY)
    found = list(encoder.encode_rows((i, "The same words, the same words.") for i in range(50)))
    assert found == [(i, array("I", plain_ids("the same words, the same words.")[:-1]).tobytes()) for i in range(50)]
    assert sorted(asked) == [",", ".", "same", "the", "words"]


def check(spark, df, given):
    path = token_files.write_ids(df, scratch_path(spark, "t"), VOCABULARY)
    found = token_files.read_ids(spark, path).collect()
    expected, start = [], 0
    for doc, text, *_ in sorted(given, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = plain_ids(text)
        expected.append((doc, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found), key=lambda r: r[1])
    assert got == expected
    return path


def test_round_trip(spark, hard, monkeypatch):
    check(spark, clashing(hard), hard_rows())
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)  # only the driver's copy; blocks are cut in tasks
    check(spark, hard, hard_rows())


def test_lookup(spark, hard):
    path = check(spark, hard, hard_rows())
    block = spark.read.parquet(path).orderBy("part", "block").first().asDict()
    ends = elias_fano.EliasFano(block["n_docs"], *[block[f"end_{c}"] for c in ("low_bits", "low", "high", "samples")]).all().tolist()
    assert [token_files.lookup(block, i) for i in range(len(ends))] == list(zip([0, *ends], ends))


def test_empty_table(spark, none):
    path = token_files.write_ids(none, scratch_path(spark, "t"), VOCABULARY)
    assert rows(token_files.read_ids(spark, path)) == []
