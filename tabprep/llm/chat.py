"""Chat formatting at token level.

    <s>                          opens a conversation
    [INST] text [/INST]          a user's turn
    text </s>                    an assistant's turn
    [ROLE] role [/ROLE] text </s>  any other turn

(without the blanks). The control strings are reserved ids beyond the tokenizer's vocabulary and are spliced between
segments that are encoded each on its own, so no merge crosses a mark. Words are encoded once and held, and ids are decoded
through a table of their bytes. A control string inside a text or role gets a
backslash after its first character, one more if it had some, so the written-out form can be parsed as well as the ids.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import col
from .base import filled, long_id, pick, stream, table

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
OPEN, END, USER, USER_END, ROLE, ROLE_END = range(len(CONTROL))
_MARK = r"/?(?:s>|INST\]|ROLE\])"
_ESCAPE = re.compile(rf"([<\[])(\\*)({_MARK})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_MARK})")
TURN = "conv_id long, turn long, ids binary, loss binary, n_tokens long"
LONGEST = 64  # code points; longer words are encoded each time
HELD = 400_000  # words held per Python process; a full memory starts anew

# Fixed value: the word pattern of byte-level vocabularies, for the characters PLAIN admits.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
# A blank between two characters of PLAIN that are not white: a word ends before it, whatever stands elsewhere.
CUT = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ])(?= [!-~À-ÖØ-öø-ÿ])")
# Fixed value: the bytes that a byte-level vocabulary writes as the character of the same number; the others, in order,
# are written as the characters from 256 on.
AS_THEY_ARE = (*range(33, 127), *range(161, 173), *range(174, 256))


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def byte_letters() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for."""
    others = sorted(set(range(256)) - set(AS_THEY_ARE))
    return {chr(b): b for b in AS_THEY_ARE} | {chr(256 + k): b for k, b in enumerate(others)}


class _Words(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes, asked of the library the first time."""

    def __init__(self, library) -> None:
        self.tokenize = library.model.tokenize
        self.spelt = {b: c for c, b in byte_letters().items()}

    def __missing__(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.spelt)
        ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= HELD:
                self.clear()
            self[word] = ids
        return ids


class _Pieces(dict):
    """Ids of a text between two cuts: word by word if plain, else from the library."""

    def __init__(self, library, words: _Words) -> None:
        self.library, self.words = library, words

    def __missing__(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            ids = b"".join(map(self.words.__getitem__, WORDS.findall(piece)))
        else:
            ids = array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= HELD:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """A byte-level tokenizer, which gives every text back exactly, and the reserved ids after its vocabulary."""

    _held: dict[str, "Codec"] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.base = self.library.get_vocab_size(with_added_tokens=True)
        self.words = _Words(self.library)
        self.pieces = _Pieces(self.library, self.words)
        self.marks = [int(self.base + k).to_bytes(4, "little") for k in range(len(CONTROL))]
        byte_of = byte_letters()
        added = {i: t.content.encode() for i, t in self.library.get_added_tokens_decoder().items()}
        written = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.spelling = [added[i] if i in added else bytes(map(byte_of.__getitem__, written.get(i, ""))) for i in range(self.base)]

    @classmethod
    def at(cls, path: str) -> "Codec":
        """One per process and file."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit; the library encodes pieces with other characters than PLAIN."""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, WORDS.findall(text)))
        return b"".join(map(self.pieces.__getitem__, CUT.split(text)))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def segments(self, role: str, text: str) -> list[tuple[str | int, bool]]:
        """Texts and marks of a turn, in order, each with whether it counts for the loss."""
        if role == "user":
            return [(USER, False), (escaped(text), False), (USER_END, False)]
        if role == "assistant":
            return [(escaped(text), True), (END, False)]
        return [(ROLE, False), (escaped(role), False), (ROLE_END, False), (escaped(text), False), (END, False)]

    def turn(self, role: str, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit, loss mask of a byte per id)."""
        parts = self.segments(role, text)
        ids = [self.encode(p) if isinstance(p, str) else self.marks[p] for p, _ in parts]
        starts = np.cumsum([0, *[len(i) // 4 for i in ids]])
        steps = np.zeros(starts[-1] + 1, dtype=np.int8)  # +1 where a loss segment begins, -1 after its end
        for (_, counts), first, last in zip(parts, starts, starts[1:]):
            if counts:
                steps[first] += 1
                steps[last] -= 1
        return b"".join(ids), np.cumsum(steps[:-1], dtype=np.int8).tobytes()

    def written(self, ids: np.ndarray) -> str:
        """The formatted text: content decoded between the marks, marks as their control strings."""
        return "".join(p if isinstance(p, str) else CONTROL[p] for p, _, _ in self.parsed(ids))

    def parsed(self, ids: np.ndarray) -> list[tuple[str | int, int, int]]:
        """Marks and the texts between them, as escaped, each with its first id and the one behind it; no text for an empty
        stretch."""
        out: list[tuple[str | int, int, int]] = []
        last = 0
        for at in [*np.flatnonzero(ids >= self.base).tolist(), len(ids)]:
            if at > last:
                out.append((self.decode(ids[last:at]), last, at))
            if at < len(ids):
                out.append((int(ids[at]) - self.base, at, at + 1))
            last = at + 1
        return out

    def learnt(self, ids: np.ndarray, mask: np.ndarray, parts: list[tuple[str | int, int, int]]) -> str:
        """The text under the mask, unescaped; `parts` are those of the ids, whose texts serve where the mask covers them
        exactly."""
        known = {(first, last): p for p, first, last in parts if isinstance(p, str)}
        edges = np.flatnonzero(np.diff(mask, prepend=np.int8(0), append=np.int8(0))).tolist()
        runs = zip(edges[::2], edges[1::2])
        return unescaped("".join(known[r] if r in known else self.written(ids[r[0] : r[1]]) for r in runs))

    def read_turn(self, parsed: list[tuple[str | int, int, int]]) -> tuple[str, str, int]:
        """(role, text, characters as written) of one turn's parts, a conversation's opening mark aside."""
        parts = [p for p, _, _ in parsed]
        size = sum(len(p if isinstance(p, str) else CONTROL[p]) for p in parts)
        if parts[:1] == [OPEN]:
            parts = parts[1:]
        fields = {0: ""}
        mark = None
        for p in parts:
            if isinstance(p, str):
                fields[mark] = unescaped(p)
            else:
                mark = p
        if parts[-1] == USER_END:
            return "user", fields.get(USER, ""), size
        if ROLE in parts:
            return fields.get(ROLE, ""), fields.get(ROLE_END, ""), size
        return "assistant", fields.get(None, ""), size


def formatted(
    turns: DataFrame,
    vocabulary: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per turn: conv_id, turn, place (from 0), start (ids of the conversation before it), ids, loss, n_tokens.

    A conversation's ids are those of its rows by place. Turns are encoded where they are read; only ids are shuffled, and
    a conversation is never held whole. Equal turn numbers are ordered by ids. Null text and role are empty; null
    conversation and turn numbers are values of their own, first in order. Repeated rows are repeated turns. An empty
    table gives no row.
    """

    def encode(rows: Iterable[tuple]) -> Iterator[tuple]:
        codec = Codec.at(vocabulary)
        for conversation, number, speaker, words in rows:
            ids, loss = codec.turn(speaker, words)
            yield conversation, number, ids, loss, len(loss)

    opening = Codec.at(vocabulary).base + OPEN
    picked = pick(turns, conv_id=long_id(conv_id), turn=long_id(turn), role=filled(role), text=filled(text))
    encoded = stream(picked, encode, TURN)
    order = W.partitionBy("conv_id").orderBy("turn", "ids")
    first = F.col("place") == 0
    return (
        encoded.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
        .withColumn("ids", F.when(first, F.concat(F.lit(opening.to_bytes(4, "little")), F.col("ids"))).otherwise(F.col("ids")))
        .withColumn("loss", F.when(first, F.concat(F.lit(b"\0"), F.col("loss"))).otherwise(F.col("loss")))
        .withColumn("n_tokens", F.col("n_tokens") + F.when(first, 1).otherwise(0))
        .withColumn("start", F.coalesce(F.sum("n_tokens").over(W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("conv_id", "turn", "place", "start", "ids", "loss", "n_tokens")
    )


def read_back(rows: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens, from ids and mask alone.

    A partition's conversations pass one after the other, turn by turn; only running digests are held.
    """

    def read(rows: Iterable[tuple]) -> Iterator[tuple]:
        codec = Codec.at(vocabulary)
        now: list | None = None

        def done() -> tuple:
            conversation, turns, whole, chars, loss, size, tokens, counted = now
            return conversation, turns, whole.hexdigest(), chars, loss.hexdigest(), size, tokens, counted

        for conversation, _, ids, mask in rows:
            if now is None or now[0] != conversation:
                if now is not None:
                    yield done()
                now = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            ids = np.frombuffer(ids, dtype="<u4")
            under = np.frombuffer(mask, dtype=np.int8)
            parts = codec.parsed(ids)
            speaker, words, size = codec.read_turn(parts)
            learnt = codec.learnt(ids, under, parts)
            now[1] += 1
            now[2].update(f"{speaker}\n{words}\n".encode())
            now[3] += len(learnt)
            now[4].update(learnt.encode())
            now[5] += size
            now[6] += len(ids)
            now[7] += int(under.sum())
        if now is not None:
            yield done()

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_tokens long, n_loss_tokens long"
    )
    ordered = rows.select("conv_id", "place", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return stream(ordered, read, schema)


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    turns = table(spark, folder, "conversations").select(*[col(c) for c in ("conv_id", "turn", "role", "text")])
    number = F.col("id").alias("turn")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    planted = spark.range(0, 2, numPartitions=1).select(F.lit(-7).cast("bigint").alias("conv_id"), number, role, text)
    return read_back(formatted(turns.unionByName(planted), vocabulary), vocabulary).drop("n_tokens", "n_loss_tokens")


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n as (select *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|ROLE\])'))
    + case role when 'user' then 13 when 'assistant' then 4
      else 17 + length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|ROLE\])')) end as written from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(written))::bigint as formatted_chars
from n group by conv_id
"""
