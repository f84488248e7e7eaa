import random

from hypothesis import given, settings, strategies as st

from tabprep.llm.licences import PHRASES, TEMPLATES, Automaton, Scanner, licences, words_of

from .conftest import clashing, hard_rows, prose, rows

SCANNER = Scanner(TEMPLATES, PHRASES)


def occurs(strings, part):
    return [(n, i + len(part) - 1) for n, s in enumerate(strings) for i in range(len(s) - len(part) + 1) if s[i : i + len(part)] == part]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=15))
def test_matching_statistics(strings, text):
    automaton = Automaton(strings)
    for i, (state, length) in enumerate(automaton.statistics(text)):
        longest = max((n for n in range(i + 2) if n == 0 or occurs(strings, text[i + 1 - n : i + 1])), default=0)
        assert length == longest
        if length:
            assert sorted(automaton.ends[state]) == sorted(occurs(strings, text[i + 1 - length : i + 1]))


def plain_places(text):
    words = words_of(text.encode())
    out = []
    for p in PHRASES:
        part = [w.encode() for w in p.split()]
        out += [(i, PHRASES[p]) for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part]
    return sorted(out)


def test_base_places():
    rng = random.Random(1)
    parts = "cc by general public license all rights reserved , - CC BY-NC All RIGHTS reserved é x".split()
    for _ in range(300):
        text = " ".join(rng.choices(parts, k=rng.randrange(25)))
        n, places, _ = SCANNER.scan(text.encode())
        assert sorted((s, SCANNER.phrase_labels[p]) for s, p in places) == plain_places(text) and n == len(words_of(text.encode()))


def test_templates_are_found_in_other_text():
    for label, texts in TEMPLATES.items():
        for text in texts:
            whole = f"{prose(1, 40)}\n{text.upper()}\n{prose(2, 40)}"
            spans = SCANNER.scan(whole.encode())[2]
            assert any(s[0] == label and s[4] == 1.0 for s in spans), label


def test_gaps_and_missing_words():
    words = TEMPLATES["mit"][2].split()
    holed = words[:20] + ["odd", "words"] + words[21:45] + words[47:]
    assert any(s[0] == "mit" and 0.9 < s[4] < 1 for s in SCANNER.scan(" ".join(holed).encode())[2])
    assert not SCANNER.scan(" ".join(words[:20]).encode())[2]  # too little of it
    shuffled = [w for i in range(0, len(words), 4) for w in words[len(words) - i - 4 : len(words) - i]]
    assert not [s for s in SCANNER.scan(" ".join(shuffled).encode())[2] if s[1] == 2]  # right words, wrong order
    assert SCANNER.scan(prose(3, 500).encode())[1:] == ([], [])


def test_many_repeats_stay_linear():
    text = "licensed under the " * 20_000
    assert SCANNER.scan(text.encode())[0] == 60_000


def test_rows(spark, hard, none):
    given = [(1, "All rights reserved. Licensed under CC BY-NC 4.0."), (2, None), (3, "nothing"), (4, "Released under the MIT License.")]
    found = {r.doc_id: r for r in licences(spark.createDataFrame(given, "doc_id bigint, text string")).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (2, 0, 5, "cc-by,reserved")
    assert found[1].labels == "cc-by,cc-by-nc,reserved" and found[1].score == 1.0
    assert (found[2].n_words, found[2].first_word, found[2].labels, found[2].score) == (0, None, "", 0.0)
    assert (found[4].base_labels, found[4].labels, found[4].n_base) == ("", "mit", 0)
    assert len(rows(licences(clashing(hard)), "doc_id")) == len(hard_rows())
    assert rows(licences(none)) == []
