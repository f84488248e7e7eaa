"""Token ids of whole texts, by the tokenizers library, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 64  # code points; longer words are encoded each time
HELD = 600_000  # words held per Python process; a full memory starts anew
GROUP_CHARS = 1 << 22  # code points and texts that are encoded together
GROUP_TEXTS = 4096
_ENCODERS: dict[str, "WordEncoder"] = {}

# Fixed value: the word pattern of the vocabulary file, for the characters PLAIN admits, lower-cased.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
# Those of its words that are no letters, as Arrow's expressions write it; between them and white space stand the others.
MARKS = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t\n\r a-z0-9ß-öø-ÿ]+)"
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
SPECIAL = "<|"


class _Words(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes, asked of the library the first time."""

    def __init__(self, library) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.spelt = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tokenize = library.model.tokenize

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else self.spelt(word)[0][0]
        ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= HELD:
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Whole texts to ids, as little-endian unsigned 32-bit bytes.

    Texts of plain characters (ASCII and precomposed Latin letters, which the vocabulary's normalizer only lower-cases) are
    cut into words here, and every distinct word is encoded once by the library's model. In other texts that holds for the
    plain parts between blanks, and the library encodes the other parts as they are: its pre-tokenizer joins nothing across
    white space. Strings of special tokens go to the library too.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = _Words(self.library)

    @staticmethod
    def _is_plain(text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and SPECIAL not in text

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))

    def _plain_group(self, texts: list[str]) -> list[bytes]:
        """The same of several texts, cut by Arrow; every distinct word of theirs is looked up once."""
        spaced = pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.string()), MARKS, r" \1 ")
        cut = pc.ascii_split_whitespace(spaced)
        words = cut.values.dictionary_encode()
        known = [self.words[w] if w else b"" for w in words.dictionary.to_numpy(zero_copy_only=False)]
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.array([len(k) // 4 for k in known], dtype=np.int64)
        which = words.indices.to_numpy(zero_copy_only=False)
        length = sizes[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        firsts = (np.cumsum(sizes) - sizes)[which]
        found = ids[np.repeat(firsts - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[cut.offsets.to_numpy()].tolist()
        return [found[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _group(self, rows: list[tuple]) -> Iterator[tuple]:
        plain = [self._is_plain(text) and len(text) <= GROUP_CHARS for _, text in rows]
        found = iter(self._plain_group([text for (_, text), p in zip(rows, plain) if p]) if any(plain) else ())
        for (name, text), p in zip(rows, plain):
            yield name, next(found) if p else self.encode(text)

    def encode_rows(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(name, ids) for each (name, text), in their order; plain texts are encoded in groups."""
        group, held = [], 0
        for name, text in rows:
            group.append((name, text))
            held += len(text)
            if held >= GROUP_CHARS or len(group) >= GROUP_TEXTS:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def encode(self, text: str) -> bytes:
        if self._is_plain(text):
            return self._plain(text)
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        other = [p for p in set(parts) if SPECIAL in p or not PLAIN.fullmatch(p)]
        found = self.library.encode_batch_fast(other, add_special_tokens=False)
        known = {p: array("I", e.ids).tobytes() for p, e in zip(other, found)}
        return b"".join([known[p] if p in known else self._plain(p) for p in parts])


def word_encoder(path: str) -> WordEncoder:
    """One encoder per process and vocabulary file; Python workers live on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
