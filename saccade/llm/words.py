"""Splits text before byte-level merges and encodes each distinct word once per task."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken

# Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for code points below U+0250, in terms of the faster standard module: fractions and superscripts are numbers.
_NUMBER = r"\d\xb2\xb3\xb9\xbc-\xbe"
_BLANK = r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W_{_NUMBER}]+| ?[{_NUMBER}]+| ?(?:[^\w{_BLANK}]|_)+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
_LIMIT = 0x250


class Kinds(dict):
    """By code point, a character below U+0250 of the same kind to the pattern: letter, number, blank or other.

    ``together`` tells whether a library splits a text of two characters into one word: libraries have Unicode tables of
    their own, so what a character is to them is asked of them, once for each character that comes up."""

    def __init__(self, together: Callable[[str], bool]):
        super().__init__()
        self.together = together

    def __missing__(self, code: int) -> str:
        mark = chr(code)
        if code >= _LIMIT:
            mark = next((like for known, like in (("a", "\xe9"), ("1", "\xb2"), ("!", "\xa4")) if self.together(known + mark)), "\xa0")
        self[code] = mark
        return mark


def split_words(text: str, kinds: Kinds) -> list[str]:
    """The matches of the splitting pattern as a library finds them; together they are the whole text."""
    if text.isascii() or max(text) < chr(_LIMIT):
        return _LATIN.findall(text)
    words, at = [], 0
    for word in _LATIN.findall(text.translate(kinds)):
        words.append(text[at:at + len(word)])
        at += len(word)
    return words


@lru_cache(maxsize=1)
def pattern_kinds() -> Kinds:
    """What characters are to the library that splits by ``PATTERN``: its vocabulary here joins a, 1 or ! with what may follow in
    one word."""
    known = [bytes([b]) for b in range(256)] + [mark + bytes([lead]) for mark in (b"a", b"1", b"!") for lead in range(0xC2, 0xF5)]
    library = tiktoken.Encoding("kinds", pat_str=PATTERN, mergeable_ranks={b: k for k, b in enumerate(known)}, special_tokens={})
    return Kinds(lambda two: library.encode_ordinary(two)[0] >= 256)


class _Codes(dict):
    """Numbers words in order of first sight."""

    def __init__(self) -> None:
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self.order)
        self.order.append(word)
        return code


class WordCoder:
    """Encodes texts by way of their words. ``encode_words`` gives the ids of words that are new, all at once.

    Words stay known until they hold ``limit`` characters in all; then the memory starts afresh, which changes no result."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 3_000_000,
                 split: Callable[[str], list[str]] | None = None):
        self.encode_words, self.limit = encode_words, limit
        self.split = split or (lambda text: split_words(text, pattern_kinds()))
        self._forget()

    def _forget(self) -> None:
        self.codes, self.size = _Codes(), 0
        self.ids, self.starts, self.lengths = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin and the last end."""
        if self.size > self.limit:
            self._forget()
        words: list[str] = []
        upto = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            words += self.split(text)
            upto[k + 1] = len(words)
        known = len(self.codes.order)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if new := self.codes.order[known:]:
            ids, lengths = self.encode_words(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
            self.size += sum(map(len, new))
        lengths = self.lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat(self.starts[codes] - ends[:-1], lengths)
        place += np.arange(ends[-1])
        return self.ids[place], ends[upto]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else the next from U+0100 on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shows]
    return {b: chr(b) for b in shows} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def split_at(added: list[str], kinds: Kinds) -> Callable[[str], list[str]]:
    """Splits like ``split_words`` between the strings of ``added``, which are words of their own (the longest that fits)."""
    if not added:
        return lambda text: split_words(text, kinds)
    found = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        parts = found.split(text)
        if len(parts) == 1:
            return split_words(text, kinds)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else split_words(part, kinds))]

    return split


@lru_cache(maxsize=2)
def library_coder(path: str) -> WordCoder:
    """Encodes with the tokenizer file ``path`` as its library does without adding special tokens: the strings of the file's
    added tokens become their ids wherever they stand in a text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known = tokenizer.get_added_tokens_decoder()
    if tokenizer.normalizer is not None or any(t.single_word or t.lstrip or t.rstrip for t in known.values()):
        raise ValueError(f"{path}: normalisers and added tokens bound to their surroundings are not supported")
    added = {t.content: k for k, t in known.items()}
    merge, letters = tokenizer.model.tokenize, _byte_letters()

    def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[added[w]] if w in added else [t.id for t in merge(w.encode().decode("latin-1").translate(letters))] for w in words]
        return (np.fromiter((i for ids in found for i in ids), np.int32), np.fromiter(map(len, found), np.int64, len(found)))

    kinds = Kinds(lambda two: len(tokenizer.pre_tokenizer.pre_tokenize_str(two)) == 1)
    return WordCoder(encode_words, split=split_at(list(added), kinds))
