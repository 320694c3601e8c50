"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column that rejects a document.  On a bounded sample every rule is timed and its rejections are
counted; rules then run in order of rejections per cost, in one conditional that stops at the first rejection.  The
order changes the cost only: a document is kept when no rule rejects it, whatever the order.

Base statistics are computed for every document.  Words that stand in a three-word window seen at least twice are found without a
shuffle: window hashes of a text are sorted with their places, equal neighbours mark places, and gaps between marked places give the covered words.

Built-in functions only.  Defined cases: a null or empty text has no words and fails the base rule; an empty table gives an empty result;
a rule that is null for a document does not reject it; other columns are not read, and those named like a result are replaced.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pressdelta.functions.text import let
from pressdelta.llm.common import text_of

SYMBOLS = r"[#*$%&|<>]"
BLANKS = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
# documents on which costs and selectivities are estimated (about), rows a rule is timed on, and how often
SAMPLE_ROWS, TIMED_ROWS, RUNS = 2000, 10_000, 3


@dataclass(frozen=True)
class Rule:
    """A document for which `rejects` is true goes."""
    name: str
    rejects: Column


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a three-word window found at least twice in it."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    # windows with their places, in order of the window
    dealt = lambda g: F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
    marked = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"]))
    # a marked window covers three words, or as many as lie before the next marked one
    covered = lambda m: F.aggregate(m, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    counted = lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), let(let(dealt(g), marked), covered)).otherwise(0)
    return let(hashes, lambda h: F.when(F.size(h) >= 3, let(windows(h), counted)).otherwise(0))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to the documents' columns."""
    t = text_of(text)
    words = F.filter(F.split(t, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    found = docs.withColumns({"__counts": counts, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": let(lines, lambda l: F.size(l) - F.size(F.array_distinct(l))).cast("long")})
    done = found.withColumns({c: F.col("__counts")[c] for c in ("n_words", "word_chars", "n_repeat_words")}).drop("__counts")
    return done.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules over the base statistics and the text; thresholds in the manner of published web corpora."""
    t, words = text_of(text), F.col("n_words")
    letters = F.regexp_count(t, F.lit(r"[A-Za-z\x{C0}-\x{24F}]"))
    return [
        Rule("mean word length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words)),
        Rule("symbols per word", 10 * F.col("n_symbols") > words),
        Rule("repeated lines", 10 * F.col("n_dup_lines") > 3 * (F.size(F.split(t, "\n")))),
        Rule("shouting", 2 * F.regexp_count(t, F.lit("[A-Z]")) > letters),
        Rule("exclamation", 5 * F.regexp_count(t, F.lit("[!?]")) > words),
        Rule("few letters", 2 * letters < F.length(t)),
    ]


def ordered(sample: DataFrame, rules: Sequence[Rule], least: float = 1e-4, rows: int = TIMED_ROWS, runs: int = RUNS) -> list[Rule]:
    """Rules by rejections per cost on a sample; equal ones by name.  A run takes the sample as often as makes about `rows` rows, so that a rule's time
    stands out from that of starting a job; of several runs the median counts, less the median of runs without a rule."""
    n = max(1, sample.count())
    times = max(1, -(-rows // n))
    many = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def taken(what: Column) -> tuple[float, int]:
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            found = many.agg(F.count(what).alias("n")).collect()[0]["n"]
            seconds.append(time.perf_counter() - start)
        return statistics.median(seconds), found // times
    taken(F.lit(1))
    idle, _ = taken(F.when(F.col("__again") > 0, 1))
    measured = []
    for rule in rules:
        seconds, hits = taken(F.when(rule.rejects, 1))
        measured.append((-(hits / n) / max(least, seconds - idle), rule.name, rule))
    return [m[2] for m in sorted(measured, key=lambda m: m[:2])]


def verdict(rules: Sequence[Rule]) -> Column:
    """True when no rule rejects.  A conditional stops at the first rule that does."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, False) if out is None else out.when(rule.rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """Adds the base statistics, base_failed and kept to the documents' columns."""
    rules = list(rules or standard_rules(text))
    # a cut of hashes: about `sample_rows` rows, wherever they lie, or all of a small table; copies of a text are in it together or not at all
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = docs if share == 1.0 else docs.filter(F.xxhash64(F.col(text), F.lit(3)) <= F.lit(int(-(2**63) + share * (2**64 - 1))))
    sample = base(picked, text).cache()
    chain = verdict(ordered(sample.filter(~F.col("base_failed")), rules))
    sample.unpersist()
    return base(docs, text).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(chain))
