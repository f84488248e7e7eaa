"""Quality rules: word repetition and length, then Jensen-Shannon distance to the document's language.

Two histograms of a document are compared with those of its whole language: code points by character class, and words by
the language's common words. Both references are the mean share over the language's distinct texts, so neither copies nor
long texts outweigh others. Texts below the guards are judged by the base rules alone, as a short histogram is mostly chance.

Four steps: (1) sizes of the languages, (2) candidates for common words, (3) one scan for measures and histograms,
(4) exact sums per language and distances over the small rows that (3) wrote.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..session import pinned, scratch_path
from .base import filled, long_id, pick, scan_number, stream, table

BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
SENTENCE = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "sentence", "symbol", "other", "beyond_ascii")
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_IN_WORDS = BLANKS + _CONTINUED


def _class_of(byte: int) -> int:
    """Place in CLASSES; len(CLASSES) for bytes that start no code point of a word."""
    if byte in _NOT_IN_WORDS:
        return len(CLASSES)
    if byte >= 0x80:
        return 6
    if chr(byte).islower():
        return 0
    if chr(byte).isupper():
        return 1
    if chr(byte).isdigit():
        return 2
    if byte in SENTENCE:
        return 3
    return 4 if byte in SYMBOLS else 5


CLASS = np.array([_class_of(b) for b in range(256)])


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.33  # Jensen-Shannon distance (square root of the divergence in bits), 0 to 1
    word_distance: float = 0.36
    class_guard: int = 200  # code points in words
    word_guard: int = 100  # words
    common_share: float = 0.005  # of a language's words, so at most 200 common words each
    language_share: float = 0.001  # of all bytes; what rarer languages need is joined by name, with the same result
    reference_texts: int = 20  # a language with less has no reference, and the base rules alone judge
    reference_words: int = 2_000


HELD_WORDS = 500_000
UNITS = 10**9  # a text's shares are summed as whole numbers, so their order does not matter
A_WORD = r"[^ \t\n\x0b\f\r]"


def repeated_words(places: np.ndarray, n_kinds: int) -> int:
    """Words inside a window of three words that is found twice or more."""
    if n_kinds > len(places) - 3:  # two equal windows, overlapping or not, repeat at least three words
        return 0
    pairs = places[:-1] * n_kinds + places[1:]
    if n_kinds >= 1 << 20:  # three places would not fit in 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * n_kinds + places[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(len(places), dtype=bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def measures(text: bytes) -> tuple[list[int], dict[bytes, int], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), place of each distinct word, places in the text."""
    words = text.split()
    kinds: dict[bytes, int] = {}
    places = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), dtype=np.int64, count=len(words))
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.strip():
            seen.add(line)
    word_chars = len(text.translate(None, _NOT_IN_WORDS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [len(words), word_chars, symbols, repeats, repeated_words(places, len(kinds))], kinds, places


def class_counts(text: bytes) -> np.ndarray:
    bytes_seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    return np.bincount(CLASS, weights=bytes_seen, minlength=len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits, 0 (alike) to 1 (nothing shared)."""
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def languages(picked: DataFrame) -> DataFrame:
    """(lang, rows, texts, size): rows with a word, distinct texts among them, and bytes of all rows. Pinned."""
    spoken = F.col("text").rlike(A_WORD)
    each = picked.select("lang", "digest", spoken.cast("long").alias("rows"), F.octet_length("text").cast("long").alias("size"))
    each = each.groupBy("lang", "digest").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    texts = F.count(F.when(F.col("rows") > 0, 1)).alias("texts")
    return pinned(each.groupBy("lang").agg(F.sum("rows").alias("rows"), texts, F.sum("size").alias("size")))


def candidates(picked: DataFrame, spoken: DataFrame, held: dict[str, float], rules: Rules) -> DataFrame:
    """(lang, word): every word that may reach the common share of its language, and few others. Pinned.

    Tasks sum shares of distinct texts chunk by chunk and leave out what is below half the common share, scaled by texts a
    row. All that is left out of a word is less than half of what a common word needs, however copies are spread, so a
    word is a candidate if its reported sum has the other half. `held` has that scale for the languages every task knows; of the others each word is reported.
    """

    def found(rows: Iterable[tuple]) -> Iterator[tuple]:
        words: dict[str, dict[bytes, float]] = {}
        seen: dict[str, set[int]] = {}
        n_held = 0

        def chunk() -> Iterator[tuple]:
            for lang, sums in words.items():
                least = rules.common_share / 2 * held.get(lang, 0.0) * len(seen[lang])
                for word, n in sums.items():
                    if n >= least:
                        yield lang, word, int(n * UNITS) + 1

        for lang, digest, text in rows:
            its = seen.setdefault(lang, set())
            if digest in its:
                continue
            counts = Counter(text.split())
            if not counts:
                continue
            its.add(digest)
            sums = words.setdefault(lang, {})
            n_held -= len(sums)
            one = 1.0 / counts.total()
            for word, n in counts.items():
                sums[word] = sums.get(word, 0.0) + n * one
            n_held += len(sums) + 1
            if n_held > HELD_WORDS:
                yield from chunk()
                words.clear()
                seen.clear()
                n_held = 0
        yield from chunk()

    spark = picked.sparkSession
    path = scratch_path(spark, "words")
    stream(picked.select("lang", "digest", "text"), found, "lang string, word binary, n long", as_bytes=("text",)).write.parquet(path)
    parts = spark.read.schema("lang string, word binary, n long").parquet(path)
    named = parts.groupBy("lang", "word").agg(F.sum("n").alias("n")).join(spoken, "lang")
    return pinned(named.where(F.col("n") >= 0.49 * rules.common_share * UNITS * F.col("texts")).select("lang", "word"))


DOCUMENT = (
    "row long, doc_id long, lang string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "classes array<long>, commons binary"
)


def measured(picked: DataFrame, common: dict[str, list[bytes]]) -> DataFrame:
    """One row per document, written and read back; `commons` has the places of candidates found, then their counts.

    Candidates are those of `common`, or the row's own, `words`.
    """

    def scan(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row, name, lang, digest, text, own in rows:
            numbers, kinds, places = measures(text)
            words = common[lang] if lang in common else own or []
            counts = np.bincount(places, minlength=len(kinds) + 1) if len(places) else np.zeros(1, dtype=np.int64)
            of_common = counts[[kinds.get(w, len(kinds)) for w in words]] if words else np.zeros(0, dtype=np.int64)
            at = np.flatnonzero(of_common)
            yield row, name, lang, digest, *numbers, class_counts(text).tolist(), np.concatenate((at, of_common[at])).astype("<u4").tobytes()

    spark = picked.sparkSession
    path = scratch_path(spark, "measures")
    stream(picked.select("row", "doc_id", "lang", "digest", "text", "words"), scan, DOCUMENT, as_bytes=("text",)).write.parquet(path)
    return spark.read.schema(DOCUMENT).parquet(path)


def found_of(commons: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of candidates and their counts."""
    both = np.frombuffer(commons, dtype="<u4").astype(np.int64).reshape(2, -1)
    return both[0], both[1]


def sums(rows: DataFrame) -> DataFrame:
    """(lang, kind, at, n): summed shares of distinct texts by class (kind 0) and by candidate (1), in whole units; texts and
    words (2). Pinned."""

    def add(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: Counter = Counter()
        for lang, n_words, classes, commons in rows:
            of_class = np.array(classes)
            for at, n in enumerate(np.rint(UNITS * of_class / of_class.sum()).astype(np.int64).tolist()):
                held[lang, 0, at] += n
            places, counts = found_of(commons)
            for at, n in zip(places.tolist(), np.rint(UNITS * counts / n_words).astype(np.int64).tolist()):
                held[lang, 1, at] += n
            held[lang, 2, 0] += 1
            held[lang, 2, 1] += n_words
            if len(held) > HELD_WORDS:
                yield from ((*key, n) for key, n in held.items())
                held.clear()
        yield from ((*key, n) for key, n in held.items())

    counted = rows.where(F.col("n_words") > 0).dropDuplicates(["lang", "digest"])
    parts = stream(counted.select("lang", "n_words", "classes", "commons"), add, "lang string, kind int, at long, n long")
    return pinned(parts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")))


Reference = tuple[np.ndarray, np.ndarray, np.ndarray]


def reference(found: Iterable[tuple[int, int, int]], rules: Rules) -> Reference | None:
    """Class shares, places of the common words, and their shares with all other words last; None of too little text."""
    n = {(kind, at): k for kind, at, k in found}
    texts, words = n.get((2, 0), 0), n.get((2, 1), 0)
    if texts < rules.reference_texts or words < rules.reference_words:
        return None
    of_class = np.array([n.get((0, i), 0) for i in range(len(CLASSES))], dtype=float)
    keep = np.array(sorted(at for (kind, at), k in n.items() if kind == 1 and k >= rules.common_share * texts * UNITS), dtype=np.int64)
    of_word = np.array([n[1, at] for at in keep.tolist()], dtype=float)
    return of_class, keep, np.append(of_word, max(0.0, texts * UNITS - of_word.sum()))


def quality(
    docs: DataFrame,
    rules: Rules = Rules(),
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    row: Column | None = None,
) -> DataFrame:
    """doc_id, the five measures, base_failed, kept, class_distance and word_distance (null below the guards), and
    `row`, whole number by which a caller finds its rows again (default: a number of the scan).

    Null text has no words and fails the base rules, like any text of fewer than `min_words`. Null language is one language
    of its own. Each language has its own references; one with fewer than `reference_texts` texts or `reference_words`
    words has none, its distances are null and the base rules alone judge. A word distance needs at least one common
    word. Repeated rows are judged alike. An empty table gives no row.
    """
    language = F.coalesce(col(lang).cast("string"), F.lit("\0null"))
    picked = pick(docs, row=scan_number(row), doc_id=long_id(doc_id), lang=language, text=filled(text), digest=F.xxhash64(filled(text)))
    spoken = languages(picked)
    every = spoken.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # at most 1 / language_share languages are held by every task; rows of the others are joined with what they need
    big = spoken.where((F.col("rows") > 0) & (F.col("size") >= rules.language_share * every)).collect()
    named = candidates(picked, spoken, {r["lang"]: r["texts"] / r["rows"] for r in big}, rules)
    common: dict[str, list[bytes]] = {r["lang"]: [] for r in big}
    held = F.col("lang").isin(list(common))
    for r in named.where(held).collect():
        common[r["lang"]].append(bytes(r["word"]))
    common = {k: sorted(v) for k, v in common.items()}
    rare = spoken.count() > len(common)
    wide = picked.where(held).withColumn("words", F.lit(None).cast("array<binary>"))
    if rare:
        own = named.where(~held).groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("words"))
        wide = wide.unionByName(picked.where(~held).join(own, "lang", "left"))
    rows = measured(wide, common)
    each = sums(rows)
    known: dict[str, list[tuple]] = {k: [] for k in common}
    for r in each.where(held).collect():
        known[r["lang"]].append((r["kind"], r["at"], r["n"]))
    of_lang = {k: reference(v, rules) for k, v in known.items()}

    def judge(rows: Iterable[tuple]) -> Iterator[tuple]:
        last, its = None, None
        for row, name, group, n, chars, symbols, lines, repeats, classes, commons, own in rows:
            if group in of_lang:
                against = of_lang[group]
            else:
                if group != last:
                    last, its = group, reference([(s["kind"], s["at"], s["n"]) for s in own or []], rules)
                against = its
            far_class = far_word = None
            if against and chars >= rules.class_guard:
                far_class = js_distance(np.array(classes, dtype=float), against[0])
            if against and n >= rules.word_guard and len(against[1]):
                keep, of_word = against[1:]
                places, found = found_of(commons)
                at = np.minimum(np.searchsorted(keep, places), len(keep) - 1)
                hit = keep[at] == places
                counts = np.zeros(len(keep) + 1)
                counts[at[hit]] = found[hit]
                counts[-1] = n - counts.sum()
                far_word = js_distance(counts, of_word)
            failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
            far = (far_class or 0) > rules.class_distance or (far_word or 0) > rules.word_distance
            yield row, name, n, chars, symbols, lines, repeats, failed, not failed and not far, far_class, far_word

    names = [F.col(c) for c in ("row", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons")]
    sides = rows.where(held).select(*names, F.lit(None).cast("array<struct<kind:int,at:bigint,n:bigint>>").alias("own"))
    if rare:
        lists = each.where(~held).groupBy("lang").agg(F.collect_list(F.struct("kind", "at", "n")).alias("own"))
        sides = sides.unionByName(rows.where(~held).join(lists, "lang", "left").select(*names, "own"))
    return stream(
        sides,
        judge,
        "row long, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double",
    )


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents")).drop("row")
