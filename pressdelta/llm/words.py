"""Encoding by a public tokenizer with a word cache.

The tokenizer drops white space and never joins across it, so the pieces of a text between blanks and line feeds are encoded on their
own, and a piece that was seen before is a look-up.  The cache is bounded: it holds the pieces met lately and those of the time before.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
from tokenizers import Tokenizer

CACHED = 1_000_000
WORD_END = "</w>"
TAIL = string.punctuation.replace("'", "")


def plain_case(text: str) -> str:
    """Lower case ahead of the tokenizer, where characters alone decide it: in texts of the first 256 characters, composed as they stand."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordEncoder:
    def __init__(self, path: str, cached: int = CACHED):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.cached, self.known, self.older, self.width = cached, {"": b""}, {}, 0
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(WORD_END)]] = True

    def _encode(self, words: list[str], width: int) -> list[bytes]:
        kind = f"<u{width}"
        return [np.array(e.ids, kind).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _encode_plain(self, words: list[str], width: int) -> list[bytes]:
        """Words of letters in one call.  Each ends in a piece with the word-end mark; should some word be cut otherwise, all go one by one."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, f"<u{width}")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._encode(words, width)
        raw, bounds = ids.tobytes(), [0, *(ends * width).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, new: list[str], width: int) -> None:
        """Letters and the marks after them are separate to the tokenizer, so a word is learned once for all the marks it meets."""
        heads = [w.rstrip(TAIL) for w in new]
        plain = {h for h in heads if h.isalpha()}.difference(self.known)
        other = {w[len(h):] if h.isalpha() else w for w, h in zip(new, heads)}.difference(self.known)
        for words, encode in ((list(plain), self._encode_plain), (list(other), self._encode)):
            if words:
                self.known.update(zip(words, encode(words, width)))
        known = self.known
        known.update((w, known[h] + known[w[len(h):]]) for w, h in zip(new, heads) if w not in known)

    def encode(self, texts: Sequence[str | None], width: int) -> Iterator[bytes]:
        """Ids of each text as little-endian numbers of `width` bytes; null is empty."""
        if width != self.width:
            self.known, self.older, self.width = {"": b""}, {}, width
        elif len(self.known) > self.cached // 2:
            self.known, self.older = {"": b""}, self.known
        split = [plain_case(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        # a piece that is met again stays another time
        met = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in met)
        new -= met
        if new:
            self._learn(list(new), width)
        known = self.known
        for words in split:
            yield b"".join([known[w] for w in words])
