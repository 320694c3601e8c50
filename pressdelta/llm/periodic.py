"""Periodic runs in word sequences: maximal repetitions, found on a harmonic grid with difference-cover LCE.

A run is a stretch of words with smallest period q, at least max(`LEAST`, 2 q) words long, that no neighbouring word extends.  For
every period q, positions on a grid of step max(q, LEAST - q) are compared with the word q further on: each run holds a grid point,
and all grids together have about n ln n points.  At points that match, the run's ends come from longest common extensions:

* suffixes are sorted at the positions of a difference cover only (6 of 31), by blocks of 31 words and prefix doubling inside a text;
* two positions are at most 30 words before a pair of cover positions; those words are compared one by one;
* from there on the extension is a minimum over neighbouring common prefixes, read from a sparse table.

Backward ends are found by halving on forward extensions.  A run met at an earlier grid point of its period is left to that point; of
equal stretches the smallest period stays.  Points whose neighbours cannot make up the shortest run are dropped before any suffix is
sorted, so texts without such a point are never sorted.

Whole texts are read, many short ones at once, a long one by itself; pairs are made in slices, so memory follows the longest text.

Defined cases: a null or empty text, or one of white space, has no words, no runs and the empty text as its collapsed form; a text
shorter than `LEAST` words has no runs; an empty table gives an empty result; repeated rows get equal values; the input's columns pass
through whatever their names (those named as the result are replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressdelta.functions.text import let
from pressdelta.llm.common import pieces, utf8

LEAST = 12
# a perfect difference set: every difference modulo PERIOD occurs
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
# bytes of text worked on at once, and pairs compared at once
SLICE, PAIRS = 2 << 20, 1 << 21
WORDS_PER_KEY, WORD_BITS = 3, 21
RESULT = ("n_words", "runs", "collapsed")
RESULT_TYPES = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
RUN = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_SLOT = np.cumsum(_IN_COVER) - 1
# words to go until both of two positions are in the cover, by their remainders
_DELAY = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(i + d) % PERIOD] and _IN_COVER[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)], np.int64)


class Extensions:
    """Longest common extensions inside the texts of `words`: word numbers, each text ended by -1.

    Queries are pairs of positions of one text, the first before the second.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.words = np.concatenate([words, np.full(2 * PERIOD, -1, words.dtype)])
        n = len(words)
        at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        self.size = len(at)
        # blocks of words at the cover positions, packed; the text comes first, so only suffixes of one text are ever close
        blocks = (self.words[at[:, None] + np.arange(PERIOD)] + 1).astype(np.int64)
        keys = [text[at].astype(np.int64)]
        for i in range(0, PERIOD, WORDS_PER_KEY):
            part = blocks[:, i : i + WORDS_PER_KEY]
            keys.append((part << (WORD_BITS * np.arange(part.shape[1])[::-1])).sum(axis=1))
        self._sort(keys)
        self._neighbours(text[at], blocks)

    def _sort(self, keys: list[np.ndarray]) -> None:
        """Ranks of the sampled suffixes by 31, 62, 124 ... words, until all differ.  A rank is the place of its first equal."""
        order = np.lexsort(keys[::-1])
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        self.levels, step = [rank], len(COVER)
        tied = order[self._ties(fresh)]
        while len(tied):
            further = tied + step
            ahead = np.where(further < self.size, rank[np.minimum(further, self.size - 1)], -1)
            order = np.lexsort([ahead, rank[tied]])
            tied, ahead = tied[order], ahead[order]
            old = rank[tied]
            new_group = np.ones(len(tied), bool)
            new_group[1:] = old[1:] != old[:-1]
            fresh = new_group.copy()
            fresh[1:] |= ahead[1:] != ahead[:-1]
            places = np.arange(len(tied))
            start = np.maximum.accumulate(np.where(new_group, places, 0))
            own = np.maximum.accumulate(np.where(fresh, places, 0))
            rank = rank.copy()
            rank[tied] = old + own - start
            self.levels.append(rank)
            tied = tied[self._ties(fresh)]
            step *= 2
        self.rank = rank

    @staticmethod
    def _ties(fresh: np.ndarray) -> np.ndarray:
        """Members of groups of more than one, where `fresh` marks the first of each."""
        last = np.append(fresh[1:], True)
        return ~(fresh & last)

    def _neighbours(self, text: np.ndarray, blocks: np.ndarray) -> None:
        """Common prefixes of neighbours in sorted order, and their sparse table of minima."""
        sorted_at = np.empty(self.size, np.int64)
        sorted_at[self.rank] = np.arange(self.size)
        a, b = sorted_at[:-1].copy(), sorted_at[1:].copy()
        lcp = np.zeros(self.size, np.int32)
        inside = np.flatnonzero(text[a] == text[b])
        a, b = a[inside], b[inside]
        long = np.zeros(len(a), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], len(COVER) << k
            same = (np.maximum(a, b) < self.size) & (rank[np.minimum(a, self.size - 1)] == rank[np.minimum(b, self.size - 1)])
            a, b, long = a + step * same, b + step * same, long + np.int32(PERIOD << k) * same
        # a suffix that ends with the batch goes no further
        within = np.maximum(a, b) < self.size
        differ = blocks[np.minimum(a, self.size - 1)] != blocks[np.minimum(b, self.size - 1)]
        lcp[inside + 1] = long + np.where(within, differ.argmax(axis=1), 0)
        self.levels = None
        self.table = [lcp]
        width = 1
        while 2 * width < self.size:
            below = self.table[-1]
            self.table.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def _synchronised(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Extension at cover positions: least common prefix between their ranks."""
        slot = lambda p: p // PERIOD * len(COVER) + _SLOT[p % PERIOD]
        ra, rb = self.rank[slot(a)], self.rank[slot(b)]
        low, high = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            rows = np.flatnonzero(level == k)
            row = self.table[k]
            out[rows] = np.minimum(row[low[rows]], row[high[rows] - (1 << int(k))])
        return out

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words the text has in common from positions a and b on."""
        out = np.zeros(len(a), np.int64)
        delay = _DELAY[a % PERIOD, b % PERIOD]
        rows = np.arange(len(a))
        for t in range(PERIOD):
            there = delay[rows] == t
            if there.any():
                done = rows[there]
                out[done] = t + self._synchronised(a[done] + t, b[done] + t)
                rows = rows[~there]
            if not len(rows):
                break
            same = self.words[a[rows] + t] == self.words[b[rows] + t]
            out[rows[~same]] = t
            rows = rows[same]
        return out


def grid_points(words: np.ndarray, start: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, period) of the grid points that may lie in a run.  `words` begins with a -1."""
    reach = np.where(length >= least, length // 2, 0)
    ends = np.cumsum(reach)
    found = []
    shortest = max(1, (least + 1) // 2)
    # (text, period) numbers run over 0 .. ends[-1]; slices of them hold a bounded number of pairs
    first = 0
    total = int(ends[-1]) if len(ends) else 0
    while first < total:
        last = min(total, first + PAIRS // 8)
        number = np.arange(first, last)
        text = np.searchsorted(ends, number, side="right")
        q = number - (ends[text] - reach[text]) + 1
        step = np.maximum(q, least - q)
        points = -(-(length[text] - q) // step)
        points = np.where(length[text] >= np.maximum(least, 2 * q), points, 0)
        upto = np.cumsum(points)
        here = 0
        while here < len(number):
            there = max(here + 1, int(np.searchsorted(upto, (upto[here - 1] if here else 0) + PAIRS, side="right")))
            c = points[here:there]
            owner = np.repeat(np.arange(here, there), c)
            i = (np.arange(len(owner)) - np.repeat(np.cumsum(c) - c, c)) * step[owner]
            a = start[text[owner]] + i
            hit = np.flatnonzero(words[a] == words[a + q[owner]])
            a, owner = a[hit], owner[hit]
            b = a + q[owner]
            # equal neighbours on both sides, as many as the shortest run has
            equal = np.ones(len(a), np.int64)
            for way in (1, -1):
                going = np.arange(len(a))
                for t in range(1, shortest):
                    going = going[words[a[going] + way * t] == words[b[going] + way * t]]
                    equal[going] += 1
            keep = equal >= shortest
            found.append((text[owner[keep]], a[keep], q[owner[keep]]))
            here = there
        first = last
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run in the texts' word numbers, by text, start, period."""
    none = np.zeros(0, np.int64)
    length = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or length.max() < least:
        return none, none, none, none
    edge = np.full(1, -1, np.int32)
    words = np.concatenate([edge, *(x for t in texts for x in (t, edge)), np.full(max(PERIOD, least), -1, np.int32)])
    start = 1 + np.cumsum(length + 1) - (length + 1)
    text, a, q = grid_points(words, start, length, least)
    if not len(text):
        return none, none, none, none
    # only texts with such points are sorted
    need = np.unique(text)
    place = np.searchsorted(need, text)
    sizes = length[need] + 1
    begin = np.cumsum(sizes) - sizes
    ext = Extensions(np.concatenate([words[start[t] : start[t] + length[t] + 1] for t in need]), np.repeat(np.arange(len(need)), sizes))
    a = a - start[text] + begin[place]
    first, step = begin[place], np.maximum(q, least - q)
    forward = ext.lce(a, a + q)

    def reaches(rows: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Whether the extension begins `back` words earlier already."""
        at = a[rows] - back
        inside = at >= first[rows]
        out = np.zeros(len(rows), bool)
        out[inside] = ext.lce(at[inside], at[inside] + q[rows[inside]]) >= back[inside] + forward[rows[inside]]
        return out

    rows = np.arange(len(a))
    rows = rows[~reaches(rows, step)]
    low = np.maximum(step[rows] - forward[rows], 0)
    enough = reaches(rows, low)
    rows, low = rows[enough], low[enough]
    high = step[rows]
    while len(rows) and (open_ := np.flatnonzero(high - low > 1)).size:
        mid = (low[open_] + high[open_]) // 2
        yes = reaches(rows[open_], mid)
        low[open_] = np.where(yes, mid, low[open_])
        high[open_] = np.where(yes, high[open_], mid)
    s, e = a[rows] - low - first[rows], a[rows] + q[rows] + forward[rows] - first[rows]
    order = np.lexsort([q[rows], e, s, text[rows]])
    t, s, e, p = text[rows][order], s[order], e[order], q[rows][order]
    smallest = np.ones(len(t), bool)
    smallest[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    t, s, e, p = t[smallest], s[smallest], e[smallest], p[smallest]
    order = np.lexsort([p, s, t])
    return t[order], s[order], (e - s)[order], p[order]


def _slice(raws: list[bytes], least: int) -> list[pa.Array]:
    """The columns of the result for some texts."""
    split = [raw.split() for raw in raws]
    number = defaultdict(count().__next__)
    texts = [np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)) for ws in split]
    t, s, n, p = runs_of(texts, least)
    cut = np.searchsorted(t, np.arange(len(raws) + 1))
    collapsed = []
    for i, ws in enumerate(split):
        if cut[i] < cut[i + 1]:
            mine = slice(cut[i], cut[i + 1])
            depth = np.zeros(len(ws) + 1, np.int64)
            np.add.at(depth, s[mine] + p[mine], 1)
            np.add.at(depth, s[mine] + n[mine], -1)
            ws = [ws[j] for j in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
        collapsed.append(b" ".join(ws))
    runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s, n, p)], fields=RUN))
    return [pa.array([len(x) for x in texts], pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, carry: Sequence[str] | None = None) -> DataFrame:
    """The documents (or the columns `carry` of them) with n_words, runs (struct<start, length, period> by start and period) and collapsed:
    the words without those that any run holds after its first period, joined by single spaces."""
    names = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    read = f"c{names.index(text)}" if text in names else "text"
    # by position: names of the input cannot meet those of the result
    flat = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *([] if text in names else [F.col(f"`{text}`").alias("text")]))
    kept = [f"c{i}" for i in range(len(names))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, read, SLICE):
            data, offsets = utf8(batch.column(read))
            found = _slice([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, *RESULT])
    done = flat.mapInArrow(find, T.StructType([*(flat.schema[c] for c in kept), *T.StructType.fromDDL(RESULT_TYPES)]))
    return done.withColumnsRenamed(dict(zip(kept, names)))


def summary(done: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    d = done.withColumn("__best", best)
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.s").alias("start"), (-F.col("__best.n")).alias("length"), F.col("__best.p").alias("period"),
                    F.floor(F.lit(1000) * -F.col("__best.n") / F.col("__best.p")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text; for ids whose checksum h is divisible by ten, with n > 0 words, words from a on repeat the first p words from a on:
    g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8).  A row without an id keeps its text."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))

    def repeat(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        return let(a, lambda a_: let(p, lambda p_: F.array_join(F.transform(ws, lambda w, i: F.when(i < a_, w).otherwise(F.get(ws, (a_ + F.pmod(i - a_, p_)).cast("int")))), " ")))
    made = let(F.split(spaced, " "), repeat)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (spaced != ""), made).otherwise(text)
