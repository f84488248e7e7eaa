import hashlib
import re
import time

import pytest
from hypothesis import given as drawn, settings, strategies as st

from tabprep.llm.secrets import base_spans, more_spans, op9_secret_scan, secrets, span_text

from .conftest import clashing, hard_rows, rows

PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
HEX = "0123456789abcdef" * 2
KEY = "AKIA" + "Z9" * 8


def plain(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


TEXTS = [
    f"é password = \"{HEX}\" and {KEY}.",
    f"API_KEY:'abc123' apikey=abcde ToKeN ==x {HEX.upper()}",
    f"{HEX}{HEX} AKIA{'A' * 15} AKIA{'A' * 16} {'a' * 23} {'b' * 24}",
    "secret: paſswd=longenough Key pasſword=longenough token=",
    f"token = {HEX} token = {HEX}",
    "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_patterns(text):
    names = list(PATTERNS)
    assert [f"{names[k]}:{a}:{b}" for a, k, b, _ in base_spans(text)] == plain(text)


@settings(deadline=None, max_examples=500)
@drawn(st.lists(st.sampled_from(["eyJ", "eyJ" + "a" * 8, ".", ".eyJ" + "b-_9" * 2, ".cdefghij", "x", " ", "é", "eyJeyJeyJeyJ"]), max_size=20))
def test_signed_tokens_by_pattern(parts):
    text = "".join(parts)
    pattern = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    assert [(a, b, v) for a, _, b, v in more_spans(text)] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text)]


def test_long_runs_take_linear_time():
    for unit in ("eyJ", "eyJ.", "eyJabcdefgh.", "ghp_", "xoxb-", "-----BEGIN ", "token ", "api_", "AKIA"):
        start = time.process_time()
        text = unit * (1_000_000 // len(unit))
        assert base_spans(text) is not None and more_spans(text) is not None
        assert time.process_time() - start < 3, unit


def test_ownership_and_more(spark):
    forge = "ghp_" + "a1B2" * 10
    given = [(i, f"token = {HEX} {KEY}", f"o{i}") for i in range(30)]  # a copied example
    given += [(100, f"password: {'q7' * 9} {forge}", "o1"), (101, f"{forge}", "o2"), (102, f"x {'ghs_' + 'C3' * 20}", None), (103, None, "o1")]
    given += [(104, f"password: {'k9' * 9}", "o5")] * 2
    found = secrets(spark.createDataFrame(given, "doc_id bigint, text string, source string").repartition(4))
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(not s.live and s.n_owners == 30 for i in range(30) for s in by[i][0].spans) and by[0][0].n_live == 0
    assert [(s.kind, s.live) for s in by[100][0].spans] == [("assign", True)]  # the forge key has two owners: copied, not base
    assert by[101][0].spans == [] and by[103][0].spans == []
    assert [(s.kind, s.live, s.n_owners) for s in by[102][0].spans] == [("forge", True, 1)]
    assert len(by[104]) == 2 and all(r.n_live == 1 for r in by[104])  # repeated rows are one owner


def test_query(spark, folder):
    found = {r.doc_id: r for r in op9_secret_scan(spark, folder).collect()}
    given = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(given)
    for d in given:
        spans = plain(d.text or "")
        r = found[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in PATTERNS)
        assert set(spans) <= set(filter(None, r.spans.split(",")))


def test_hard_rows(hard, none):
    found = secrets(clashing(hard))
    assert rows(found, "doc_id", "n_hex") == sorted(((r[0], 0) for r in hard_rows()), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(secrets(none).select("doc_id", span_text("spans"))) == []


def test_mirrored_and_shared_secrets_are_not_examples(spark, tmp_path):
    import corpus_pipeline as pipeline

    forge, mirrored, example = "ghp_" + "d4E5" * 10, "m3" * 9, "ghs_" + "f6G7" * 10
    given = [(i, f"note {i} {forge} password: {'q8' * 9}", "en", f"o{i}", 1) for i in range(2)]  # shared by two
    given += [(10 + i, f"page password: {mirrored}", "en", f"o{i}", 1) for i in range(15)]  # one page, mirrored
    given += [(40 + i, f"manual {i} {example} password: {'x9' * 9}", "en", f"o{i}", 1) for i in range(15)]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in op9_secret_scan(spark, str(tmp_path)).collect()}
    assert all(r.spans.split(",")[0].startswith("forge:") for d, r in found.items() if d < 10 or d >= 40)  # no span is lost
    assert all((r.n_live, r.n_copied, r.live_spans) == ((2, 0, r.spans) if d < 10 else (1, 0, r.spans) if d < 40 else (0, 2, "")) for d, r in found.items())
    after = {r.doc_id: r.text for r in pipeline.secret_scan(spark, docs, "").collect()}
    assert all(after[i] == f"note {i} [SECRET] [SECRET]" for i in range(2)) and all(after[10 + i] == "page [SECRET]" for i in range(15))
    assert all(after[d] == t for d, t, *_ in given if d >= 40)
