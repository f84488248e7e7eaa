import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabprep.llm.chat import CONTROL, END, OPEN, Codec, escaped, formatted, read_back, unescaped

from .conftest import rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = st.lists(st.sampled_from([*CONTROL, "<", "[", "\\", "/", "s>", "INST]", "ROLE]", "a", "é\n", "<|endoftext|>", "<\\s>", "[\\\\/INST]"]), max_size=12)


@settings(deadline=None, max_examples=200)
@given(PIECES)
def test_escape(parts):
    text = "".join(parts)
    assert unescaped(escaped(text)) == text
    assert not any(c in escaped(text) for c in CONTROL)


@settings(deadline=None, max_examples=100)
@given(st.sampled_from(["user", "assistant", "system", "", "[ROLE]"]), PIECES)
def test_turn_round_trip(role, parts):
    text = "".join(parts)
    codec = Codec.at(VOCABULARY)
    ids, loss = codec.turn(role, text)
    ids, under = np.frombuffer(ids, "<u4"), np.frombuffer(loss, np.int8)
    parts = codec.parsed(ids)
    speaker, words, size = codec.read_turn(parts)
    assert (speaker, words, size) == (role, text, len(codec.written(ids)))
    assert unescaped(codec.written(ids[under > 0])) == (text if role == "assistant" else "")
    assert codec.learnt(ids, under, parts) == codec.learnt(ids, under, []) == (text if role == "assistant" else "")
    assert not (under[ids >= codec.base] > 0).any()  # marks are not learnt


@settings(deadline=None, max_examples=500)
@given(st.one_of(st.text(max_size=60), st.text("aB9 '\t\n\r.!é×÷ßſsrevmdl_|<>", max_size=60), PIECES.map("".join)))
def test_same_ids_as_the_library(text):
    codec = Codec.at(VOCABULARY)
    want = codec.library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(codec.encode(text), "<u4")
    assert got.tolist() == want and codec.decode(got) == codec.library.decode(want, skip_special_tokens=False) == text


def test_every_id_is_spelt_as_the_library_does():
    codec = Codec.at(VOCABULARY)
    for i in range(codec.base):
        assert codec.spelling[i].decode("utf-8", "replace") == codec.library.decode([i], skip_special_tokens=False)


GIVEN = [
    (1, 0, "user", "hi"), (1, 2, "user", "bye"), (1, 1, "assistant", "yo </s>[INST]"), (2, 0, "system", "be [/ROLE] good"), (2, 1, None, None),
    (3, 0, "assistant", ""), (3, 1, "assistant", "é́中" * 3000), (None, 0, "user", "lost"), (4, None, "user", "first"), (4, 1, "assistant", "same"),
    (4, 1, "assistant", "same"),
]


def test_conversations(spark):
    df = spark.createDataFrame(GIVEN, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("ids", "loss", "place", "start", "n_tokens")})
    tokens = formatted(df, VOCABULARY)
    found = {r.conv_id: r for r in read_back(tokens, VOCABULARY).collect()}
    turns = defaultdict(list)
    for conv, turn, role, text in GIVEN:
        turns[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert found.keys() == turns.keys()
    for conv, these in turns.items():
        these.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in these)
        loss = "".join(t for _, r, t in these if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(these), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[1].formatted_chars == len("<s>[INST]hi[/INST]yo <\\/s>[\\INST]</s>[INST]bye[/INST]")
    base = Codec.at(VOCABULARY).base
    of_one = tokens.where("conv_id = 1").orderBy("place").collect()
    assert [r.start for r in of_one] == [0, *np.cumsum([r.n_tokens for r in of_one])[:-1]]
    firsts = [np.frombuffer(bytes(r.ids), "<u4")[0] for r in of_one]
    assert firsts[0] == base + OPEN and base + END not in firsts


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert rows(read_back(formatted(none, VOCABULARY), VOCABULARY)) == []
