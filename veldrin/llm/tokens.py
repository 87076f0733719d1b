"""Token ids of whole texts, by a public word-level BPE vocabulary read with `tokenizers`.

Pieces of that vocabulary never span white space, so a text's ids are those of its words in turn. Each distinct word is
encoded once per worker and looked up after; a cache of bounded size is emptied when it is full. Words with letters
outside the Latin blocks go through the whole tokenizer. Special tokens' strings in a text are their ids, as the library
has them by default, or ordinary text, as is asked.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

END = 1
CACHED = 1_200_000
#: Characters that str.split takes as white space and the vocabulary doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Beyond the Latin blocks (or an I with a dot, which lower case makes two characters).
_WIDE = re.compile("[\u0130\u0250-\U0010ffff]")
_POINTS = re.compile(r"(?:[^\w\s]|_)+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Word to its place in the store; a word that isn't there is encoded and added."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special_ids = special
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.letters = _byte_letters()
        self.single: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.starts, self.sizes = array("I"), array("q"), array("q")
        self._add(None, [END])
        for name, i in self.special_ids.items():
            self._add((name,), [i])

    def _add(self, word: str | tuple[str] | None, ids: list[int]) -> int:
        self[word] = place = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return place

    def _piece(self, piece: str) -> list[int]:
        """The model's ids of a piece; those of single characters, such as digits, are kept."""
        if len(piece) == 1 and piece in self.single:
            return self.single[piece]
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode())))]
        if len(piece) == 1:
            self.single[piece] = ids
        return ids

    def __missing__(self, word: str) -> int:
        if word.isascii() and word.isalpha():
            return self._add(word, self._piece(word.lower()))
        if max(word) >= "\u0250" or "\u0130" in word or _ODD.search(word):
            return self._add(word, self.tokenizer.encode(word, add_special_tokens=False).ids)
        return self._add(word, [i for piece in _PIECES.findall(unicodedata.normalize("NFC", word).lower()) for i in self._piece(piece)])


def _split(text: str) -> list[str]:
    """Parts of a text that no piece spans: words; where pieces can be told apart easily, words and punctuation."""
    if _ODD.search(text):
        return [w for w in regex.split(r"\s+", text) if w]
    if "'" not in text and not _WIDE.search(text):
        text = text.lower()
        points = [c for c in set(text) if c == "_" or not (c.isalnum() or c.isspace())]
        if "\0" in points:
            return _POINTS.sub(r" \g<0> ", text).split()
        for c in points:  # set each one off by marks; two marks in a row are inside a run, which stays whole
            text = text.replace(c, f"\0{c}\0")
        text = text.replace("\0\0", "").replace("\0", " ")
    return text.split()


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def encode(texts: list[str], path: str, special: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each ended by END, one after the other; and where each begins, with the end of the last.
    special: strings of special tokens become these tokens."""
    cache = _words(path)
    if len(cache) > CACHED:
        cache.reset()
    words: list[str | tuple[str] | None] = []
    marks = cache.special if special else None
    ends = []
    for t in texts:
        if marks is not None and marks.search(t):
            for i, part in enumerate(marks.split(t)):  # every second part is a special token's string
                words += [(part,)] if i % 2 else _split(part)
        else:
            words += _split(t)
        words.append(None)
        ends.append(len(words))
    places = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    sizes = np.frombuffer(cache.sizes, np.int64)[places]
    last = np.cumsum(sizes)
    first = last - sizes
    at = np.repeat(np.frombuffer(cache.starts, np.int64)[places] - first, sizes)
    ids = np.frombuffer(cache.flat, np.uint32)[at + np.arange(len(at))]
    return ids, np.concatenate([[0], last[np.array(ends, np.int64) - 1]]).astype(np.int64) if ends else np.zeros(1, np.int64)
