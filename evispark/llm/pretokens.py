"""Splitting of text into pre-tokens for byte-level vocabularies, with a bounded cache of encoded words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import chain
from unicodedata import ucd_3_2_0

import numpy as np
import regex
from tokenizers import Tokenizer


class Vocabulary:
    """A byte-level BPE file: tokens as bytes by id, merges as pairs of ids, special tokens' strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        char_byte = {c: b for b, c in byte_chars().items()}
        ids = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *special.values()], default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = token.encode() if token in special else bytes(char_byte[c] for c in token)
        for token, i in special.items():
            self.tokens[i] = token.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.merges: list[tuple[int, int, int]] = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.special: dict[str, int] = special


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The public pattern for texts of Latin letters, where the standard library's classes are those of \p{L} and \p{N}; it is faster.
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Other characters than those: beyond Latin Extended-B, separators of records, and number signs that aren't digits.
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


class WordEncoder:
    """Encodes texts word by word; ``encode_words`` is asked once for a word while it is in the cache.

    Texts are split by the pattern. Where a text holds characters so new that regex
    libraries may class them differently, the tokenizers library splits it.
    """

    def __init__(self, path: str, pattern: str, special: dict[str, int], encode_words: Callable[[list[str]], list], limit: int = 300_000):
        self.find, self.find_latin = regex.compile(pattern).findall, re.compile(LATIN_PATTERN).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.encode_words, self.limit = encode_words, limit
        self.known: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        if not NOT_LATIN.search(text):
            return self.find_latin(text)
        if any(c > "\u024f" and ucd_3_2_0.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.find(text)

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._split(text)
        parts = self.cut.split(text)
        return [w for i, part in enumerate(parts) for w in ((part,) if i % 2 else self._split(part))]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if len(self.known) > self.limit:
            self.known = {}
        lists = [self._words(t) for t in texts]
        new = list(set(chain.from_iterable(lists)).difference(self.known))
        plain = [w for w in new if w not in self.special]
        self.known.update((w, array("I", ids).tobytes()) for w, ids in zip(plain, self.encode_words(plain)))
        self.known.update((w, array("I", [self.special[w]]).tobytes()) for w in new if w in self.special)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), dtype=np.uint32) for words in lists]
