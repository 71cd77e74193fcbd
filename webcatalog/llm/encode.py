"""Token ids of whole texts, from a tokenizers file, inside a task."""

from __future__ import annotations

import os
from struct import pack

import numpy as np

#: Words whose ids a worker keeps; at the limit it starts afresh.
CACHED_WORDS = 900_000
#: How byte-level vocabularies write the space byte.
SPACE = "\u0120"
#: Marks that end a piece of letters and stand alone before a space.
STOPS = ".,;:!?"
#: The character that stands for each byte in byte-level vocabularies: its own where that is
#: printable Latin-1, else the next one from 256 on.
OCTETS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
FORMATS = [f"<{n}I" for n in range(64)]
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit integers.

    The vocabulary's pattern always starts a new piece at a single space between two words, so
    a text without double spaces is the concatenation of its space-separated words, each
    encoded with its space. Distinct words are encoded once and looked up afterwards; the
    other texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it has
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stops = {c: self.whole(c) for c in f"{STOPS}\n"}
        self.words = Words(self.word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "  " in text or text[-1] == " ":
            return self.whole(text)
        first, *rest = text.split(" ")
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        return (self.whole(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))

    def word(self, word: str) -> bytes:
        """Ids of a space and the word."""
        if word.isalpha():
            return self._letters(SPACE, word)
        if word[:-1].isalpha() and word[-1] in STOPS:
            return (self.words.get(word[:-1]) or self._letters(SPACE, word[:-1])) + self.stops[word[-1]]
        above, _, below = word.partition("\n")
        if above and not above[-1].isspace() and below.isalpha():  # a single line end is a piece
            return self.words[above] + self.stops["\n"] + self._letters("", below)
        return self.whole(f" {word}")

    def _letters(self, before: str, word: str) -> bytes:
        """Ids of letters, after a space or none: one piece of the pattern, so the merges apply directly."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(OCTETS)
        ids = [token.id for token in self.model.tokenize(before + word)]
        return pack(FORMATS[len(ids)] if len(ids) < len(FORMATS) else f"<{len(ids)}I", *ids)


class Words(dict):
    """Encodes a word when it is first looked up."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
