"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (blanks become the mark, one is put in front) and cut into words: no piece of a vocabulary goes on after a letter into the
next mark, and none holds a line feed.  The distinct words of a batch that are not known yet are sorted; walked in order they are a
trie in depth-first order, and the forward states of the common prefix with the word before stay on the stack.

* unigram vocabularies: the state of a prefix is its best score and the piece it ends with, the Viterbi recursion;
* merge (BPE) vocabularies: piece scores are merge ranks, and the segmentation with the largest sum of them is not what such a model
  encodes.  There the state of a prefix is the last piece of its encoding, and a piece may follow another if merging the two alone leaves them
  as they are.  The encoding of a prefix is unique, so exactly one piece can end it, and the same pass gives the model's own result.

The dictionary of words is kept per Python worker, is bounded, and starts anew when full.

Defined cases: a null or empty text has no ids; characters that are no piece become byte pieces, or the unknown piece if there are none; a mark
character inside a text is a blank after decoding; ids that are null decode as an empty text; an empty table gives an empty result; extra columns pass through, and
those named like a result are replaced.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressdelta.llm.common import per_process, pieces

MARK = "▁"
CACHED = 250_000
PAIRS = 200_000
# text taken at a time: its words are held together
SLICE_BYTES = 2 << 20
ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, scores and byte pieces of a model file.  `merges`: a merge (BPE) model; else a unigram model."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], bytes_: dict[int, int] | None = None, unknown: int = 0, merges: bool = True):
        self.pieces, self.unknown, self.merges, self.bytes = list(pieces), unknown, merges, bytes_ or {}
        special = {unknown, *self.bytes.values()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if p and i not in special}
        self.scores = list(scores)
        # pieces as a trie: character -> node, and under the empty string the piece that ends at a node
        self.trie = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.plain = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.bytes.items():
            self.plain[i] = bytes((b,))

    @classmethod
    def load(cls, path: str, merges: bool = True) -> Vocabulary:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        usable = [m.id_to_piece(i) if not (m.is_control(i) or m.is_unused(i)) else "" for i in range(n)]
        return cls(usable, [m.get_score(i) for i in range(n)], {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}, m.unk_id(), merges)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


def merge(vocabulary: Vocabulary, text: str) -> tuple[list[str], tuple[str, str] | None]:
    """The model's own merging of one string, the best-ranked neighbours first, the leftmost of equals; and the two parts merged last."""
    parts, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
    heap, last = [], None
    def offer(a: int) -> None:
        b = right[a] if a >= 0 else len(parts)
        if a >= 0 and b < len(parts) and (i := vocabulary.ids.get(parts[a] + parts[b])) is not None:
            heapq.heappush(heap, (-vocabulary.scores[i], a, parts[a] + parts[b]))
    for a in range(len(parts)):
        offer(a)
    while heap:
        _, a, joined = heapq.heappop(heap)
        if not parts[a] or (b := right[a]) >= len(parts) or parts[a] + parts[b] != joined:
            continue
        last = parts[a], parts[b]
        parts[a], parts[b] = joined, ""
        right[a] = right[b]
        if right[b] < len(parts):
            left[right[b]] = a
        offer(left[a])
        offer(a)
    return [p for p in parts if p], last


class Segmenter:
    """Words to ids, with the forward states of common prefixes reused.

    The state of a prefix is (where its last piece begins, that piece's id, the best score); a character without a piece has the id
    -1 - its code point.
    """

    def __init__(self, vocabulary: Vocabulary, cached: int = CACHED):
        self.v, self.cached, self.follows, self.made, self.steady = vocabulary, cached, {}, {}, {}
        # words met lately, and those of the time before; together at most `cached` and those of one slice
        self.words, self.older = {"": b""}, {}
        self.letter = "H" if len(vocabulary.pieces) <= 1 << 16 else "I"
        self.kind = np.dtype(f"<u{array(self.letter).itemsize}")

    def _made(self, piece: str) -> tuple[str, str] | None | bool:
        """The two parts a piece is merged from, None for a single character, False if its characters merge to something else."""
        found = self.made.get(piece)
        if found is None and len(piece) > 1:
            parts, last = merge(self.v, piece)
            found = self.made[piece] = last if parts == [piece] else False
        return found

    def _rank(self, piece: str) -> float:
        """When a piece comes into being: merges with the best scores come first, single characters are there from the start."""
        return -self.v.scores[self.v.ids[piece]] if len(piece) > 1 else -math.inf

    def _in_order(self, piece: str) -> bool:
        """Every merge that makes the piece ranks after those that make its parts, so that ranks tell the order in time."""
        found = self.steady.get(piece)
        if found is None:
            found = self.steady[piece] = len(piece) == 1 or all(self._in_order(p) and self._rank(p) < self._rank(piece) for p in self._made(piece))
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        """Merging the two pieces alone leaves them as they are.

        Going back in time, the later made of the two neighbours at the seam falls into its parts; if at any time the neighbours then at the
        seam would have merged before that, they would not have become the two pieces.  Of equal merges the left one comes first.
        """
        one, two, ids, scores = (self._piece(a), self._piece(b), self.v.ids, self.v.scores)
        if not (self._in_order(one) and self._in_order(two)):
            return merge(self.v, one + two)[0] == [one, two]
        until, at = math.inf, False
        while True:
            across = ids.get(one + two)
            if across is not None and (-scores[across] < until or at and -scores[across] == until):
                return False
            first, second = self._rank(one), self._rank(two)
            if first == second == -math.inf:
                return True
            if first > second:
                until, at, one = first, False, self._made(one)[1]
            else:
                until, at, two = second, True, self._made(two)[0]

    def _piece(self, i: int) -> str:
        return self.v.pieces[i] if i >= 0 else chr(-1 - i)

    def _merged_state(self, char: str, end: int, stack: list) -> tuple:
        """State of a prefix that ends with `char` at `end`: where its last piece begins, that piece, the score (of no meaning here), and the
        pieces that have begun and may go on.  Exactly one piece can end a prefix; the first that fits is it."""
        follows, size, open_, best = self.follows, len(self.v.pieces), [], None
        for start, node in stack[-1][3]:
            node = node.get(char)
            if node is None:
                continue
            open_.append((start, node))
            if best is None and "" in node:
                i = node[""]
                if start:
                    before = stack[start][1]
                    fits = follows.get(before * size + i)
                    if fits is None:
                        if len(follows) >= min(PAIRS, self.cached):
                            follows.clear()
                        fits = follows[before * size + i] = self._made(self.v.pieces[i]) is not False and self._may_follow(before, i)
                    if fits:
                        best = start, i, 0.0
                elif self._made(self.v.pieces[i]) is not False:
                    best = start, i, 0.0
        # a character always stands by itself, with a piece of its own or without
        if best is None:
            best = end - 1, self.v.ids.get(char, -1 - ord(char)), 0.0
        open_.append((end, self.v.trie))
        return *best, open_

    def _scored_state(self, char: str, end: int, stack: list) -> tuple:
        """The same for the best sum of scores."""
        open_, best = [], None
        for start, node in stack[-1][3]:
            node = node.get(char)
            if node is None:
                continue
            open_.append((start, node))
            if "" in node:
                score = stack[start][2] + self.v.scores[node[""]]
                if best is None or score > best[2]:
                    best = start, node[""], score
        if char not in self.v.ids:
            # a character without a piece stands alone
            alone = stack[end - 1][2] + self.v.worst
            if best is None or alone > best[2]:
                best = end - 1, -1 - ord(char), alone
        open_.append((end, self.v.trie))
        return *best, open_

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its pieces.  Sorted words are a trie walked depth first; `stack` holds the states of the path."""
        before, stack, grow = "", [(0, 0, 0.0, [(0, self.v.trie)])], self._merged_state if self.v.merges else self._scored_state
        for word in sorted(words):
            common = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                common += 1
            del stack[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                stack.append(grow(word[end - 1], end, stack))
            parts, end = [], len(word)
            while end:
                end, i = stack[end][:2]
                parts.append(i)
            parts.reverse()
            yield word, parts
            before = word

    def _bytes(self, parts: list[int]) -> bytes:
        if parts and min(parts) < 0:
            ids = []
            for i in parts:
                # neighbours without a piece are one unknown
                ids += [i] if i >= 0 else self.v.fallback(chr(-1 - i)) if self.v.bytes or not ids or ids[-1] != self.v.unknown else []
            parts = ids
        return array(self.letter, parts).tobytes()

    def _cut(self, text: str) -> list[str]:
        """Marked words of a text, and line feeds."""
        if "\0" in text or MARK in text or "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
            # runs of blanks stay with the word after them
            return [w for i, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")) for w in ((["\n"] if i else []) + MARKED_WORD.findall(line))]
        return (MARK + text).replace("\n", "\0\n\0").replace(" ", "\0" + MARK).split("\0")

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > self.cached // 2:
            self.words, self.older = {"": b""}, self.words
        cut = [self._cut(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.words)
        # a word that is met again stays another time
        met = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in met)
        new -= met
        # runs of marks tie in rank, so their words are merged as they are
        tied = {w for w in new if w.startswith(MARK + MARK)} if self.v.merges else set()
        for w in tied:
            self.words[w] = self._bytes([self.v.ids[p] if p in self.v.ids else -1 - ord(p) for p in merge(self.v, w)[0]])
        for w, parts in self.segment(new - tied):
            self.words[w] = self._bytes(parts)
        known = self.words
        for words in cut:
            yield np.frombuffer(b"".join([known[w] for w in words]), self.kind)


def decode_ids(vocabulary: Vocabulary, ids: Sequence[int] | None) -> str:
    plain = vocabulary.plain
    out = b"".join([plain[i] for i in ids]).decode("utf-8", "replace") if ids is not None else ""
    return out[1:] if out[:1] == " " else out


def _segmenter(path: str, merges: bool, cached: int = CACHED) -> Segmenter:
    return per_process(("subwords", path, merges, cached), lambda: Segmenter(Vocabulary.load(path, merges), cached))


def decode(ids: Column, path: str, merges: bool = True) -> Column:
    """Text of an id column."""
    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _segmenter(path, merges).v
        for batch in batches:
            yield pd.Series([decode_ids(vocabulary, None if i is None else i.tolist()) for i in batch], dtype=object)
    return decoded(ids)


def encoded(docs: DataFrame, path: str, text: str = "text", merges: bool = True, decoded: str | None = None, cached: int = CACHED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents with n_tokens and ids; `decoded` names a column for the text made of the ids again.  `cached` words and pairs are kept
    per Python worker, and the words of `slice_bytes` of text are segmented together: less of both takes less memory and more time."""
    added = [*ENCODED, *([T.StructField(decoded, T.StringType())] if decoded else [])]
    kept = [c for c in docs.columns if c not in {f.name for f in added}]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(path, merges, cached)
        for batch in pieces(batches, text, slice_bytes):
            ids = [i.astype(np.int32) for i in segmenter.encode(batch.column(text).to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            out = [batch.column(c) for c in kept] + [pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))]
            if decoded:
                out.append(pa.array([decode_ids(segmenter.v, i.tolist()) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *(f.name for f in added)])

    return docs.mapInArrow(rows, T.StructType([*(docs.schema[c] for c in kept), *added]))
