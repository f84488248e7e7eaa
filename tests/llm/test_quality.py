import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tabprep.llm.quality import CLASSES, Rules, class_counts, js_distance, measures, quality

from .conftest import clashing, hard_rows, prose, rows

BLANK = " \t\n\v\f\r"


def plain(text):
    words = [w for w in "".join(" " if c in BLANK else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    lines = text.split("\n")
    copies = sum(any(c not in BLANK for c in x) and x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(inside)]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from([*BLANK, "a", "b", "a b ", "é#", "中", "\x1c", "x\n", " "]), max_size=40))
def test_measures(parts):
    text = "".join(parts)
    assert measures(text.encode())[0] == plain(text)


def test_class_counts():
    found = dict(zip(CLASSES, class_counts("aB3.#_é中 \n".encode()).tolist()))
    assert found == {"lower": 1, "upper": 1, "digit": 1, "sentence": 1, "symbol": 1, "other": 1, "beyond_ascii": 2}


def test_js_distance():
    a = np.array([3.0, 1.0, 0.0])
    assert js_distance(a, 7 * a) < 1e-6 and abs(js_distance(np.array([1.0, 0]), np.array([0, 1.0])) - 1) < 1e-9
    assert js_distance(a, a[::-1]) == js_distance(a[::-1], a)


def test_verdicts(spark):
    rng = random.Random(4)
    clean = [(i, prose(i, rng.randrange(60, 900)), "en") for i in range(300)]
    clean += [(400 + i, " ".join(rng.choices("der die und nicht schule haus geht mit ich auf".split(), k=150)), "de") for i in range(60)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in prose(900 + i, 200).split()), "en") for i in range(5)]
    junk += [(1010 + i, prose(950 + i, 300).upper() + "!!", "en") for i in range(5)]
    junk += [(1020 + i, " ".join(f"item{rng.randrange(10**6)}" for _ in range(300)), "en") for i in range(5)]
    short = [(2000, "too short", "en"), (2001, "a b c " * 60, "en")]
    df = spark.createDataFrame(clean + junk + short, "doc_id bigint, text string, lang string").repartition(4)
    found = {r.doc_id: r for r in quality(df).collect()}
    for doc, text, _ in clean + junk + short:
        r = found[doc]
        if doc != 2001:
            assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == plain(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert [d for d, *_ in clean if not found[d].kept and not found[d].base_failed] == []
    assert [d for d, *_ in junk + short if found[d].kept] == []


def test_hard_rows(hard, none):
    found = quality(clashing(hard)).collect()
    assert len(found) == len(hard_rows())
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in found if r.doc_id in (4, 5, 6))
    assert rows(quality(none)) == []


def test_guards(hard):
    found = quality(hard, Rules(class_guard=10**9, word_guard=10**9)).collect()
    assert all(r.class_distance is None and r.word_distance is None and r.kept == (not r.base_failed) for r in found)


def rare_languages():
    """A big language, and two rare ones in other scripts, each with junk of random words."""
    rng = random.Random(8)
    big = [(i, prose(i, 4000), "en") for i in range(150)]
    cyrillic = [(1000 + i, " ".join(rng.choices("и в не на что он как это дом идет школа город".split(), k=110)), "ru") for i in range(30)]
    latin = [(2000 + i, " ".join(rng.choices("ja on ei se että hän mutta talo koulu menee".split(), k=110)), "fi") for i in range(30)]
    junk = [(3000 + i, " ".join("".join(rng.choices("abcdefghijklmno", k=6)) for _ in range(150)), "fi") for i in range(3)]
    few = [(4000, prose(4000, 120), "xx"), (4001, "1 2 3 # " * 8 + " ".join(map(str, range(100))), "xx")]
    return big, cyrillic, latin, junk, few


def test_rare_languages_have_their_own_reference(spark):
    big, cyrillic, latin, junk, few = rare_languages()
    given = big + cyrillic + latin + junk + few
    df = spark.createDataFrame(given, "doc_id bigint, text string, lang string").repartition(4)
    rules = Rules(language_share=0.05)
    found = {r.doc_id: r for r in quality(df, rules).collect()}
    assert [d for d, *_ in cyrillic + latin if not found[d].kept and not found[d].base_failed] == []
    assert all(not found[d].base_failed and found[d].word_distance > rules.word_distance and not found[d].kept for d, *_ in junk)
    assert all(found[d].class_distance is None and found[d].kept for d, *_ in few)  # too little text for a reference
    held = rows(quality(df, Rules(language_share=0.0)).drop("row"))  # the way is not part of the result
    assert rows(quality(df, rules).drop("row")) == held
    alone = {r.doc_id: r for r in quality(df.where("lang = 'fi'"), rules).collect()}
    assert all(alone[d][2:] == found[d][2:] or alone[d].asDict() | {"row": 0} == found[d].asDict() | {"row": 0} for d in alone)


def test_copies_and_long_texts_do_not_become_the_reference(spark):
    clean = [(i, prose(i, 150), "en") for i in range(200)]
    rng = random.Random(9)
    page = " ".join(f"{rng.randrange(10**6)} # $ |" for _ in range(100))
    copies = [(1000 + i, page, "en") for i in range(100)]  # a third of all rows
    own = " ".join(rng.choices("alpha beta gamma delta omega sigma kappa".split(), k=150))
    own = [(2000 + i, own, "de") for i in range(100)]
    german = [(3000 + i, " ".join(rng.choices("der die und nicht schule haus geht mit ich auf".split(), k=150)), "de") for i in range(200)]
    long = [(4000, " ".join(f"{rng.randrange(10**6)} # $ |" for _ in range(20_000)), "de")]
    given = clean + copies + own + german + long
    found = {r.doc_id: r for r in quality(spark.createDataFrame(given, "doc_id bigint, text string, lang string").repartition(4)).collect()}
    assert [d for d, *_ in clean + german if not found[d].kept and not found[d].base_failed] == []
    assert [d for d, *_ in copies + own + long if found[d].kept] == []
