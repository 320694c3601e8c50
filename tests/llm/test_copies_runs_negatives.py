"""Exact dedup, periodic runs and hard negatives against plain code."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressdelta.llm import exactdedup, hardneg, periodic

DOC = "doc_id bigint, text string, kept string, digest string"


# --- exact dedup ------------------------------------------------------------------------------------------------------------
def plain_groups(rows):
    """{digest: (size, best id)} of (doc_id, text)."""
    groups = {}
    for i, (doc, text) in enumerate(rows):
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(text or ""), doc is None, doc, i))
    return {d: (len(g), min(g, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[2]) for d, g in groups.items()}


def random_rows(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", " \n", "a b", "ab", "a  b", "ä b", "ab" * 5000, f"text {rnd.randrange(n)}", f"text {i}"])
        rows.append((rnd.choice([i, i, i, None, 7]), text))
    return rows


def decided(spark, rows, **how):
    d = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], DOC)
    return exactdedup.decisions(d, **how).withColumn("hex", F.lower(F.hex("digest"))).collect()


@pytest.mark.parametrize("batches", [1, 4])
def test_decisions_equal_plain_groups(spark, batches):
    rows = random_rows(400, batches)
    got, want = decided(spark, rows, batches=batches), plain_groups(rows)
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(a) for a, _ in rows)
    assert {r.hex: (r.group_size, r.keep_id) for r in got} == want
    kept = [r.hex for r in got if r.kept]
    assert sorted(kept) == sorted(want)


def test_decisions_of_nothing_and_of_missing_ids(spark):
    assert decided(spark, []) == []
    got = decided(spark, [(None, "a"), (None, "a"), (None, None)])
    assert sorted((r.group_size, r.keep_id, r.kept) for r in got) == [(1, None, True), (2, None, False), (2, None, True)]


def test_one_group_may_hold_most_rows(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(3000)]
    got = decided(spark, rows)
    assert sum(r.kept for r in got) == 1001 and {r.group_size for r in got if r.hex == got[0].hex} <= {1, 2000}
    assert {r.keep_id for r in got if r.group_size == 2000} == {1}


def test_distinct_documents_pass_through(spark):
    rows = [(1, "a b", "k", "d"), (2, "a  b", "k2", "d2"), (2, "a  b", "k2", "d2"), (None, None, None, None), (3, "c", "x", "y")]
    got = exactdedup.distinct_documents(spark.createDataFrame(rows, DOC))
    assert got.columns == ["doc_id", "text", "kept", "digest"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_perfect_hash_is_minimal_and_checks_bytes():
    rnd = np.random.default_rng(3)
    digests = rnd.integers(0, 256, (5000, 32), dtype=np.uint8)
    function = exactdedup.PerfectHash.build(digests)
    slots = function.slots(digests)
    assert sorted(slots.tolist()) == list(range(5000))
    entries = np.zeros(5000, exactdedup.SLOT)
    entries["digest"][slots] = digests
    near = digests.copy()
    near[:, 31] ^= 1
    assert (exactdedup.members(function, entries, digests) == slots).all() and (exactdedup.members(function, entries, near) == -1).all()
    assert exactdedup.PerfectHash.build(digests[:0]).slots(digests[:2]).tolist() == [-1, -1]


def test_history_splits_its_buckets(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    keys = spark.createDataFrame(rows, "doc bigint, text string").select("doc", F.length("text").cast("long").alias("chars"), exactdedup.content_digest(F.col("text")).alias("digest"), F.col("doc").alias("row"))
    history = exactdedup.History(spark, bucket=16)
    for low, high in ((0, 50), (50, 400), (400, 1000)):
        history.add(exactdedup.grouped(keys.filter((F.col("doc") >= low) & (F.col("doc") < high))))
    got = {bytes(r.digest).hex(): (r.n, r.doc) for r in history.entries().collect()}
    assert history.bits >= 5 and history.index().count() > 32 and history.size == 700
    assert got == plain_groups(rows)


# --- periodic runs ----------------------------------------------------------------------------------------------------------
def plain_runs(w, least=12):
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rnd):
    n, letters = rnd.choice([0, 5, 12, 40, 150, 400]), rnd.choice([1, 2, 3, 8])
    w = [rnd.choice("abcdefgh"[:letters]) for _ in range(n)]
    if n > 30 and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 5))]
        t, s, n, p = periodic.runs_of([np.array([ord(x) for x in w], np.int32) for w in texts])
        for i, w in enumerate(texts):
            assert [tuple(map(int, x)) for x in zip(s[t == i], n[t == i], p[t == i])] == plain_runs(w)


def test_runs_with_other_least_and_small_slices(monkeypatch):
    rnd = random.Random(6)
    monkeypatch.setattr(periodic, "PAIRS", 64)
    for least in (2, 3, 20):
        for _ in range(40):
            w = random_words(rnd)[:120]
            _, s, n, p = periodic.runs_of([np.array([ord(x) for x in w], np.int32)], least)
            assert [tuple(map(int, x)) for x in zip(s, n, p)] == plain_runs(w, least)


def test_extensions_equal_plain_comparison():
    rnd = np.random.default_rng(1)
    texts = [rnd.integers(0, 2, 300), np.zeros(500, int), np.tile(rnd.integers(0, 3, 37), 12)]
    words = np.concatenate([np.append(t, -1) for t in texts]).astype(np.int32)
    number = np.repeat(np.arange(3), [len(t) + 1 for t in texts])
    ext = periodic.Extensions(words, number)
    start = 0
    for t in texts:
        a = rnd.integers(0, len(t) - 1, 400)
        b = a + 1 + (rnd.random(400) * (len(t) - 1 - a)).astype(int)
        want = [next((k for k in range(len(t)) if y + k >= len(t) or t[x + k] != t[y + k]), 0) for x, y in zip(a, b)]
        assert ext.lce(a + start, b + start).tolist() == want
        start += len(t) + 1


def test_runs_of_documents(spark):
    rnd = random.Random(9)
    texts = [None, "", " \t\n", "x", "ab " * 4000, "ä b\x0bc " * 30, "  " * 20] + [" \n".join(random_words(rnd)) for _ in range(40)]
    rows = [(i if i % 5 else None, t, "keep", i) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, collapsed string, `c0` int")
    got = {r.c0: r for r in periodic.with_runs(d).collect()}
    assert periodic.with_runs(d).columns == ["doc_id", "text", "c0", "n_words", "runs", "collapsed"] and len(got) == len(rows)
    for doc, text, _, i in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        runs = plain_runs(w)
        assert (got[i].doc_id, got[i].text, got[i].n_words, [tuple(r) for r in got[i].runs], got[i].collapsed) == (doc, text, len(w), runs, plain_collapse(w, runs))
    assert periodic.with_runs(d.limit(0)).count() == 0


def test_summary_and_planted_texts(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 30, 200])))) for i in range(120)] + [(None, "a " * 20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text", periodic.planted(F.col("text"), F.col("doc_id")))
    got = {r.doc_id: r for r in periodic.summary(periodic.with_runs(d)).collect()}
    for doc, text in rows:
        w, h = (text or "").split(), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        r = got[doc]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(plain_collapse(w, runs).encode()).hexdigest()


# --- hard negatives ---------------------------------------------------------------------------------------------------------
def plain_mine(rows, every, positives=5, negatives=5, low=80):
    """rows: (id, label, vector of floats or None)."""
    sound = [(i, y, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, dot = set(), lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, y, v in [r for r in sound if r[0] % every == 0]:
        other = [(-dot(v, u), j, z == y) for j, z, u in sound if j != i]
        best = sorted(x for x in other if x[2])[:positives]
        for ps, pid, _ in best:
            fit = sorted(x for x in other if not x[2] and low * -ps <= 100 * -x[0] <= 100 * -ps)[:negatives]
            out |= {(i, pid, k + 1, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(fit)}
    return out


def vectors(n, seed, width=8, kinds=None):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(kinds or n, width)) * 0.3
    return [(i, int(rnd.integers(0, 4)), [float(np.float32(x)) for x in centres[rnd.integers(0, len(centres))] + (0 if kinds == 1 else rnd.normal(size=width) * (0.05 if kinds else 0.3))]) for i in range(n)]


VEC = "vec_id bigint, label int, embedding array<float>, score string"


def mined(spark, rows, every, **how):
    d = spark.createDataFrame([(*r, "s") for r in rows], VEC)
    got = hardneg.mine(hardneg.scaled(d), F.col("id") % every == 0, **how).collect()
    assert len(got) == len(set(map(tuple, got)))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("kinds", [None, 6, 1])
def test_mining_equals_brute_force(spark, kinds):
    rows = vectors(400, 3, kinds=kinds)
    assert mined(spark, rows, 20, cell_rows=8, slab=64, seed_rows=30) == plain_mine(rows, 20)


def test_mining_defined_cases(spark):
    rows = vectors(120, 4, width=5, kinds=4) + [(None, 1, [0.1] * 5, ), (500, None, [0.1] * 5), (501, 1, None), (502, 1, [0.1, None, 0.1, 0.1, 0.1]), (503, 1, [float("nan")] * 5), (504, 1, [float("inf")] * 5),
                                                (510, 77, [0.2] * 5), (520, 2, [0.3, 0.1]), (530, 2, []), (540, 3, [-0.4] * 5), (550, 3, [0.4] * 5)]
    assert mined(spark, rows, 10, cell_rows=8, slab=16, seed_rows=10) == plain_mine(rows, 10)
    assert mined(spark, [], 10) == set()
    with pytest.raises(Exception, match="beyond"):
        mined(spark, [(10, 1, [1e9]), (11, 1, [1e9])], 10)


def test_multi_sequence_falls_and_meets_all():
    rnd = np.random.default_rng(8)
    a, b = rnd.normal(size=7), rnd.normal(size=9)
    got = list(hardneg.multi_sequence(a, b))
    assert len({(i, j) for _, i, j in got}) == 63 and all(x[0] >= y[0] for x, y in zip(got, got[1:])) and all(abs(s - a[i] - b[j]) < 1e-12 for s, i, j in got)


def test_structure_saves_cells():
    """On vectors with structure the certified walk leaves most cells unread."""
    rnd = np.random.default_rng(2)
    first, second = -np.sort(rnd.exponential(1, 40) * 10), -np.sort(rnd.exponential(1, 40) * 10)
    sizes = np.full((40, 40), 10)
    edge, _, seed = hardneg.walk(first, second, sizes, -1e300, 100, False)
    lowest, below, rest = hardneg.walk(first, second, sizes, float(first.max() + second.max() - 3), 100, True)
    assert below == edge and lowest < edge and 0 < len(seed) < 40 and len(rest) < 40


# --- subwords ---------------------------------------------------------------------------------------------------------------
def test_pieces_at_a_seam_against_the_merge_itself():
    """The pair test going back in time, on vocabularies whose merges overlap and tie in text."""
    from pressdelta.llm import subwords
    rnd = random.Random(11)
    for _ in range(30):
        made = list("abc")
        while len(made) < 25:
            new = rnd.choice(made) + rnd.choice(made)
            if new not in made and len(new) < 9:
                made.append(new)
        v = subwords.Vocabulary(["<unk>", *made], [0.0, *[-float(i) for i in range(len(made))]])
        seg = subwords.Segmenter(v)
        good = [v.ids[p] for p in made if seg._made(p) is not False]
        for a in good:
            for b in good:
                one, two = v.pieces[a], v.pieces[b]
                assert seg._may_follow(a, b) == (subwords.merge(v, one + two)[0] == [one, two])
        words = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))) for _ in range(200)}
        for w, parts in seg.segment(words):
            assert [v.pieces[i] if i >= 0 else chr(-1 - i) for i in parts] == subwords.merge(v, w)[0]


def test_words_met_again_stay():
    from pressdelta.llm import subwords
    v = subwords.Vocabulary(["<unk>", "a", "b", "▁", "▁a"], [0.0, -2.0, -3.0, -4.0, -1.0])
    seg = subwords.Segmenter(v, cached=4)
    out = [[i.tolist() for i in seg.encode([t])] for t in ("a b ab ba", "a aa", "a bb", "b ab", "a b ab ba")]
    assert out[0] == out[4] and len(seg.words) + len(seg.older) < 12
