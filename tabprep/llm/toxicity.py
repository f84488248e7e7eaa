"""Toxicity by a weighted finite-state grammar whose insults are learnt from labels.

Every word is read as one symbol: insult with a weight, threat, target, negation, report, or other. A clause passes through
small transducers, one after the other: negation right before a hostile word weakens it, reported speech earlier in the
clause weakens all that follows, a target anywhere in the clause strengthens it, and a threat counts only with a target
after it. A text's score is the logistic of the prior and its clauses' weights, so single words without weight add nothing.

Insults are learnt: whole words and word beginnings that toxic texts have far more often than others, and not by chance,
counted over one text of each family of copies, or a single copied text would lend its weight to all its words. A beginning
must earn its place without the texts that a longer entry already explains.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..session import pinned, scratch_path, stored
from .base import ascii_lower, filled, long_id, pick, stream, table
from .minhash import near_duplicates

# Closed word classes of the grammar, in English, French, German and Spanish.
TARGETS = frozenset("you your yours yourself he she they them him her us tu toi vous te du dich dir euch ihr sie tú usted ustedes vosotros él ella".encode().split())
NEGATIONS = frozenset("not no never isn't nobody ne pas jamais nicht kein keine nie nunca jamás tampoco".encode().split())
REPORTS = frozenset("said says wrote writes called quoted claims claimed dit écrit disait sagte schrieb nannte dijo escribió llamó".encode().split())
THREATS = frozenset("kill hurt destroy beat shoot burn hang tuer frapper töten schlagen umbringen matar golpear".encode().split())

CLAUSE_ENDS = b".!?;\n"
_WORDS = bytes(10 if b in CLAUSE_ENDS else b if b >= 0x80 or chr(b).isalnum() or b == 0x27 else 32 for b in range(256))
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word, for words that go on
HELD = 300_000


@dataclass(frozen=True)
class Grammar:
    min_ratio: float = 8.0  # document share among toxic texts over that among others
    min_texts: int = 8
    min_surprise: float = 24.0  # log-likelihood ratio of the counts against one common share; one in a million by chance
    max_entries: int = 20_000  # of the lexicon, those that explain most first
    max_weight: float = 4.0
    threat: float = 2.0
    negated: float = 0.5
    reported: float = 0.7
    targeted: float = 1.25
    most: float = 12.0  # of all clauses together


def words_of(text: bytes) -> list[list[bytes]]:
    """Clauses of words."""
    return [c.split() for c in ascii_lower(text).translate(_WORDS).split(b"\n")]


def features(text: bytes) -> set[bytes]:
    """Distinct words and beginnings; a beginning ends in * ."""
    out: set[bytes] = set()
    for word in set(ascii_lower(text).translate(_WORDS).split()):
        out.add(word)
        out.update(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)
    return out


class _Weights(dict):
    """Weight of a word by the lexicon: its own or its beginnings', whichever is most."""

    def __init__(self, lexicon: Mapping[bytes, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        get = self.lexicon.get
        value = max(get(word, 0.0), *[get(word[:n] + b"*", 0.0) for n in BEGINNINGS if len(word) > n], 0.0)
        if len(self) >= HELD:
            self.clear()
        self[word] = value
        return value


def clause_weight(words: list[bytes], weights: Mapping[bytes, float], grammar: Grammar) -> float:
    """What one clause adds: the automaton's states are `negated` (words it still holds), `report` and an open threat."""
    total = open_threat = 0.0
    negated = 0
    factor = 1.0
    targeted = False
    for word in words:
        hostile = weights[word]
        if word in NEGATIONS:
            negated = 2
            continue
        if word in REPORTS:
            factor = grammar.reported
        if word in TARGETS:
            targeted = True
            total += open_threat
            open_threat = 0.0
        if hostile:
            total += hostile * factor * (grammar.negated if negated else 1.0)
        elif word in THREATS:
            open_threat = grammar.threat * factor * (grammar.negated if negated else 1.0)
        negated = max(0, negated - 1)
    return total * (grammar.targeted if targeted else 1.0)


def text_score(text: bytes, weights: Mapping[bytes, float], prior: float, grammar: Grammar) -> tuple[float, int]:
    """(score, clauses that matched)."""
    total, matched = 0.0, 0
    for words in words_of(text):
        if words and (any(map(weights.__getitem__, words)) or not THREATS.isdisjoint(words)):
            weight = clause_weight(words, weights, grammar)
            matched += weight > 0
            total += weight
    return 1.0 / (1.0 + math.exp(-(prior + min(grammar.most, total)))), matched


def held_out(doc_id: str) -> Column:
    """Every third document by the CRC-32 of its id as text; labels of these are never read."""
    text = F.coalesce(col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """((toxic, text), rows by label): labelled texts with a word outside the held-out fold, one of each family and label.

    A family is what near_duplicates links: texts whose five-word shingles are verified to be alike by 80 %, and all they
    are linked with. Of a family the smallest id with a label speaks for that label.
    """
    spark = docs.sparkSession
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    joined = docs.where(~held_out("doc_id")).join(known.hint("merge"), "doc_id")
    path = scratch_path(spark, "texts")
    stored(joined.select("doc_id", "toxic", F.xxhash64("text").alias("row"), "text"), path)
    texts = spark.read.schema("doc_id long, toxic int, row long, text string").parquet(path)
    found = near_duplicates(texts, row=F.col("row")).where(F.col("n_shingles") > 0).select("doc_id", "row", "component_id").distinct()
    marks = texts.select("doc_id", "toxic").distinct()
    speaks = found.join(marks, "doc_id").groupBy("component_id", "toxic").agg(F.min(F.struct("doc_id", "row")).alias("t"))
    speaks = pinned(speaks.select("t.doc_id", "t.row", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in speaks.groupBy("toxic").count().collect()}
    one = texts.join(speaks.drop("toxic").hint("merge"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return one.select("toxic", "text"), sizes


def feature_counts(texts: DataFrame) -> DataFrame:
    """(feature, n, clean): toxic and other texts that have the feature; each task sums up before the shuffle."""

    def count(rows: Iterable[tuple]) -> Iterator[tuple]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def held() -> Iterator[tuple]:
            for feature in sums[0].keys() | sums[1].keys():
                yield feature, sums[1][feature], sums[0][feature]

        for toxic, text in rows:
            sums[toxic].update(features(text))
            if len(sums[0]) + len(sums[1]) > HELD:
                yield from held()
                sums[0].clear()
                sums[1].clear()
        yield from held()

    parts = stream(texts, count, "feature binary, n long, clean long", as_bytes=("text",))
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def surprise(n: Column, clean: Column, toxic: int, other: int) -> Column:
    """Log-likelihood ratio of a feature's counts against the same share among toxic texts and others."""
    every = float(toxic + other)

    def part(found: Column, expected: Column) -> Column:
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    with_it, without = n + clean, F.lit(every) - n - clean
    return 2.0 * (
        part(n, with_it * (toxic / every))
        + part(clean, with_it * (other / every))
        + part(toxic - n, without * (toxic / every))
        + part(other - clean, without * (other / every))
    )


def learn(docs: DataFrame, labels: DataFrame, grammar: Grammar) -> tuple[dict[bytes, float], float]:
    """(weight of each word or beginning, prior): counted over all labelled texts; the lexicon is the model and bounded."""
    texts, sizes = training_texts(docs, labels)
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    prior = math.log((toxic + 0.5) / (other + 0.5)) if toxic or other else 0.0
    if not toxic:
        return {}, prior

    def ratio_of(n, clean):  # of numbers or columns
        return ((n + 0.5) / (toxic + 1)) / ((clean + 1.0) / (other + 2))

    ratio = ratio_of(F.col("n"), F.col("clean"))
    beyond = surprise(F.col("n"), F.col("clean"), toxic, other)
    telling = feature_counts(texts).where((F.col("n") >= grammar.min_texts) & (ratio >= grammar.min_ratio))
    if other:  # else nothing to compare with
        telling = telling.where(beyond >= grammar.min_surprise)
    # weight times the texts it is found in: what the entry adds to the scores of toxic texts
    worth = F.least(F.lit(grammar.max_weight), F.log(ratio)) * F.col("n")
    top = telling.orderBy(F.desc(worth), "feature").limit(grammar.max_entries).collect()
    counts = {bytes(r["feature"]): r["n"] for r in top}
    clean = {bytes(r["feature"]): r["clean"] for r in top}
    lexicon: dict[bytes, float] = {}
    explained: dict[bytes, int] = {}  # of a beginning: toxic texts of the commonest longer entry that it begins
    for feature in sorted(counts, key=lambda f: (f.endswith(b"*"), -len(f), f)):
        n = counts[feature] - explained.get(feature, 0)
        ratio = ratio_of(n, clean[feature])
        if n >= grammar.min_texts and ratio >= grammar.min_ratio:
            lexicon[feature] = min(grammar.max_weight, math.log(ratio))
            for length in BEGINNINGS:
                if len(feature.removesuffix(b"*")) > length:
                    short = feature[:length] + b"*"
                    explained[short] = max(explained.get(short, 0), counts[feature])
    return lexicon, prior


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    grammar: Grammar = Grammar(),
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    threshold: float = 0.7,
) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses (hostile ones), one row per input row.

    The score sees the text alone. Null and empty texts score the prior. Without labels every score is 0.5 and threats
    alone count. Labels other than 0 and 1 are not learnt from; of several labels of a document the largest counts.
    """
    picked = pick(docs, doc_id=long_id(doc_id), text=filled(text))
    marked = pick(labels, doc_id=long_id(doc_id), toxic=col(toxic).cast("int")).where(F.col("toxic").isin(0, 1))
    lexicon, prior = learn(picked, marked, grammar)

    def rate(rows: Iterable[tuple]) -> Iterator[tuple]:
        weights = _Weights(lexicon)
        for name, out, text in rows:
            score, clauses = text_score(text, weights, prior, grammar)
            yield name, out, score, int(score >= threshold), clauses

    rows = picked.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return stream(rows, rate, "doc_id long, held_out boolean, score double, predicted int, n_clauses long", as_bytes=("text",))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
