"""The training-data operators against plain code on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressdelta.llm import chat, linededup, mixing, neardup, quality, records, rules, sharding, subwords, tiff

DOCS = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 700}" for i in range(30_000))
TEXTS = [(1, "one two three", "a"), (2, None, None), (3, "", "b"), (4, LONG, "a"), (5, "one two three", "b"), (None, "no id here", "a"), (7, "  \n\t", None), (7, "  \n\t", None), (8, "ünï çödé 😀\n\nlast", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with odd cases, and columns named like results and like helper columns."""
    rows = spark.createDataFrame(TEXTS, DOCS)
    return rows.select("*", *[F.lit("x").alias(c) for c in ("score", "size", "shard", "slot", "h1", "kept", "ids", "n_words", "group", "key", "n_tokens")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=repr)


# quality

def test_quality_fit_and_edges(spark, docs, none):
    random.seed(1)
    good = [(i, " ".join(random.choice(("the", "river", "stone", "walks", "Under", "light.")) for _ in range(random.randrange(20, 90)))) for i in range(120)]
    bad = [(200 + i, " ".join(random.choice(("the*** ", "BUY!!", "###", "NOW!!")) for _ in range(random.randrange(20, 90)))) for i in range(60)]
    texts = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")
    model = quality.fit(texts, labels)
    scores = {r.doc_id: r.s for r in texts.select("doc_id", quality.score(model, F.col("text")).alias("s")).collect()}
    assert all(scores[i] >= 0.7 for i, _ in good) and all(scores[i] < 0.7 for i, _ in bad)
    out = docs.select(quality.score(model, F.col("text")).alias("s")).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.s <= 1 for r in out)
    assert quality.fit(none, labels).only == 0.5
    assert quality.fit(texts, labels.filter("quality = 1")).only == 1.0
    assert none.select(quality.score(model, F.col("text"))).count() == 0


def test_quality_moments_are_those_of_numpy(spark):
    rows = [(i, float(i % 2), [float((i * 7 + k * k) % 11) for k in range(len(quality.NAMES))]) for i in range(40)]
    found = quality.moments(spark.createDataFrame(rows, "i int, label double, v array<double>"), "v", "label")
    for c in (0, 1):
        x = np.array([v for _, l, v in rows if l == c])
        assert found[c][0] == 20 and np.allclose(found[c][1], x.sum(0)) and np.allclose(found[c][2], x.T @ x)


def vector_by_hand(text):
    text = text or ""
    raw, words = text.encode(), text.split()
    having = lambda allowed: sum(b in allowed for b in raw)
    part = lambda share, whole: math.asin(math.sqrt(min(1.0, share / whole)))
    capital, small = having(range(65, 91)), having(range(97, 123))
    again = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    n = len(words)
    return [math.log(1 + n), math.log(1 + (sum(len(w) for w in words) + 100) / (n + 20)), part(capital, capital + small + 20), part(having(b"#*$%&|<>@^~=_"), len(raw) + 20),
            part(having(b"!?"), n + 20), part(having(b".,;:"), 2 * n + 20), part(having(b"0123456789"), len(raw) + 20), part(again, n + 20),
            part(n - len(set(words)), n + 100), part(having(b"\n"), n + 40), part(having(range(192, 256)), len(raw) + 100)]


def test_scores_are_log_densities_by_hand(spark):
    random.seed(21)
    word = lambda bad: random.choice(("the", "river", "Stone", "walks", "light.", "é", "12", "a,") + (("BUY!!", "###", "NOW", "$5") if bad else ()))
    rows = [(i, "".join(word(i % 3 == 0) + random.choice(" \n ") for _ in range(random.randrange(5, 120))), 0 if i % 3 == 0 else 1) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("score", F.lit("x")).withColumn("vector", F.lit("x"))
    model = quality.fit(frame, frame.select("doc_id", "quality"))
    odd = rows + [(900, None, None), (901, "", None), (902, LONG, None)]
    got = {r.doc_id: r.s for r in spark.createDataFrame(odd, "doc_id long, text string, quality int").select("doc_id", quality.score(model, F.col("text")).alias("s")).collect()}
    x, y = np.array([vector_by_hand(t) for _, t, _ in rows]), np.array([l for _, _, l in rows])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    spreads = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * spreads[c] for c in (0, 1))
    density = []
    everything = (np.array([vector_by_hand(t) for _, t, _ in odd]) - centre) / scale
    for c in (0, 1):
        shrunk = 0.7 * spreads[c] + 0.3 * pooled
        shrunk = 0.99 * shrunk + (0.01 * np.trace(shrunk) / len(shrunk) + 1e-9) * np.eye(len(shrunk))
        off = everything - z[y == c].mean(0)
        density.append(np.log((y == c).sum()) - 0.5 * (np.linalg.slogdet(shrunk)[1] + np.einsum("ij,ij->i", off, np.linalg.solve(shrunk, off.T).T)))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))
    assert np.allclose([got[i] for i, *_ in odd], want, atol=1e-6)


# mixing

def test_fill_stops_and_shares_again():
    targets = mixing.fill([100, 10, 1000], [5, 2, 1], 3)
    assert targets[0] == 300 and targets[1] == 30 and abs(sum(targets) - 1110) < 1e-9
    assert mixing.fill([], [], 3) == [] and mixing.fill([0, 0], [5, 2], 3) == [0, 0]


def test_route_has_least_cost():
    patterns = {"x": ([0], 4), "y": ([0, 1], 3), "z": ([1], 2)}
    quotas = [7, 5]
    flows = mixing.route(patterns, quotas)
    def cost(flow, tokens):
        return sum(c * min(max(flow - k * tokens, 0), tokens) for k, c in enumerate(mixing.REPEAT_COSTS))
    got = sum(cost(sum(flows[p].values()), t) for p, (_, t) in patterns.items())
    assert [sum(f.get(s, 0) for f in flows.values()) for s in (0, 1)] == quotas
    best = min(cost(a, 4) + cost(b0 + b1, 3) + cost(c, 2) for a, b0, b1, c in itertools.product(range(13), range(10), range(10), range(7)) if a + b0 == 7 and b1 + c == 5)
    assert got == best


def test_mix_overlapping_and_edges(spark, none):
    random.seed(2)
    rows = [(i, random.choice((["a"], ["b"], ["a", "b"], [None], ["b", None], [], None)), random.randrange(1, 9)) for i in range(400)] + [(None, ["a"], 5), (7, ["b"], 3), (7, ["b"], 3)]
    frame = spark.createDataFrame(rows, "id long, sources array<string>, size long")
    mix = mixing.plan_mix(spark, frame, mixing.weight_of)
    taken = mix.copies(frame, F.col("id"), F.col("sources")).collect()
    assert len(taken) == len(rows)
    got = {}
    for r in taken:
        assert len(r.copies) <= 3 and all(s in (r.sources or []) for s in r.copies)
        for s in r.copies:
            got[s] = got.get(s, 0) + r.size
    for r in mix.sources.collect():
        assert abs(got.get(r.source, 0) - r.target) <= 40
    again = mixing.plan_mix(spark, frame.repartition(7), mixing.weight_of).copies(frame, F.col("id"), F.col("sources")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, taken))
    assert mixing.mixed(spark, none).count() == 0


def test_mixed_documents(spark, docs):
    out = mixing.mixed(spark, docs.drop("size")).collect()
    assert len(out) == len(TEXTS) and all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in out)


# line dedup

def lines_by_hand(rows):
    owner, out = {}, []
    order = lambda i: (i is None, i or 0)
    norm = lambda l: "".join(c.lower() if c.isascii() else c for c in l.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for l in (t or "").split("\n"):
            if len(norm(l)) >= 10:
                owner[norm(l)] = min(owner.get(norm(l), i), i, key=order)
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [l for l in own if len(norm(l)) < 10 or owner[norm(l)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark, docs, none):
    random.seed(3)
    pool = ["Same long line here", "  same LONG line here\t", "ÄÖÜ äöü äöü", "äöü äöü äöü", "short", "", "another long line", "x" * 9, "é" * 9, "é" * 10]
    rows = [(i, "\n".join(random.choice(pool + [f"own line number {random.randrange(40)}"]) for _ in range(random.randrange(12)))) for i in range(60)] + [(None, "Same long line here\nwithout an id"), (None, "without an id"), (61, None), (3, "another long line")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(linededup.dedup_lines(frame), "n_lines", "n_dropped", "kept") == lines_by_hand(rows)
    assert by_id(linededup.dedup_lines(docs), "n_lines", "n_dropped", "kept") == lines_by_hand([r[:2] for r in TEXTS])
    assert linededup.dedup_lines(none).count() == 0


def test_runs_are_merged_and_batches_agree(spark):
    rows = [(i, f"line that repeats {i % 5}\nline of its own {i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    runs, dropped = linededup.LineRuns(spark, fanout=2), []
    keys = linededup.line_keys(frame).cache()
    for b in range(5):
        dropped += runs.add(keys.filter(F.col("doc").between(10 * b, 10 * b + 9))).collect()
    assert sorted((r.doc, r.line) for r in dropped) == [(i, 0) for i in range(5, 50)]
    assert len(runs.levels) > 2 and sum(map(len, runs.levels)) <= 3
    assert runs.known().count() == 55
    runs.drop()


def test_merged_runs_are_met(spark, monkeypatch):
    rows = [(i, f"line that repeats {i % 5}\nline of its own {i}") for i in range(48)]
    monkeypatch.setattr(linededup.batches_for, "__defaults__", (3,))
    met, meet = [], linededup.LineRuns.meet
    written, write = [], linededup.LineRuns._write
    def watched(self, keys):
        met.append([list(level) for level in self.levels])
        return meet(self, keys)
    def noted(self, run, level):
        write(self, run, level)
        written.append((level, self.levels[level][-1]))
    monkeypatch.setattr(linededup.LineRuns, "meet", watched)
    monkeypatch.setattr(linededup.LineRuns, "_write", noted)
    assert by_id(linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "n_lines", "n_dropped", "kept") == lines_by_hand(rows)
    assert len(met) == 4 and any(len(levels) > 1 and levels[1] for levels in met)
    assert all(any(path in runs for levels in met for runs in levels) for level, path in written if level)
    assert [linededup.batches_for(n, 8192) for n in (0, 1, 30_000, 250_000, 15_000_000)] == [1, 2, 3, 4, 7]


def test_runs_are_neither_moved_nor_sorted(spark):
    keys = linededup.line_keys(spark.createDataFrame([(i, f"line that repeats {i % 5}\nline of its own {i}") for i in range(40)], "doc_id long, text string"))
    keys = linededup.store(keys, "keys")
    runs = linededup.LineRuns(spark, fanout=3)
    for b in range(4):
        runs.add(keys.filter(F.col("doc").between(8 * b, 8 * b + 7))).count()
    assert [len(level) for level in runs.levels] == [1, 1]
    with linededup.sorted_buckets(spark):
        plan = runs.meet(keys)._jdf.queryExecution().executedPlan().toString()
        merge = runs._merged([name for level in runs.levels for name in level])._jdf.queryExecution().executedPlan().toString()
    # the batch alone: once moved, once sorted
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert merge.count("SortMergeJoin") == 1 and "Exchange" not in merge and "Sort [" not in merge
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_")]


def test_very_frequent_lines(spark, monkeypatch):
    rows = [(i, "everywhere the same\n" + f"in every third document {i % 3}\n" + f"line of its own {i}") for i in range(90)] + [(None, "everywhere the same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(linededup, "HOT", 4)
    assert by_id(linededup.dedup_lines(frame, batches=3), "n_lines", "n_dropped", "kept") == lines_by_hand(rows)
    monkeypatch.setattr(linededup, "HOT", 0)
    assert by_id(linededup.dedup_lines(frame, batches=3), "n_lines", "n_dropped", "kept") == lines_by_hand(rows)


# subwords

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_subwords_equal_the_library(spark, docs, none):
    random.seed(4)
    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), subwords.Segmenter(subwords.Vocabulary.load(PIECES))
    texts = ["".join(random.choice(" \n\ttheaNDz▁é中😀0012#\0  ") for _ in range(random.randrange(40))) for _ in range(1500)] + [LONG, "a" * 5000]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == model.encode(t), t
        assert subwords.decode_ids(own.v, ids.tolist()) == t.replace("▁", " ")
    out = subwords.encoded(docs, PIECES)
    assert out.columns == [c for c in docs.columns if c not in ("ids", "n_tokens")] + ["n_tokens", "ids"]
    for r in out.select("text", "ids", "n_tokens", subwords.decode(F.col("ids"), PIECES).alias("back")).collect():
        assert r.ids == model.encode(r.text or "") and r.n_tokens == len(r.ids) and r.back == (r.text or "")
    assert subwords.encoded(none, PIECES).count() == 0
    assert spark.sql("select cast(null as array<int>) as ids").select(subwords.decode(F.col("ids"), PIECES).alias("t")).first().t == ""


def test_unigram_scores_are_the_best(spark):
    random.seed(5)
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scores = [0.0] + [-random.random() * 5 - 1 for _ in pieces[1:]]
    own = subwords.Segmenter(subwords.Vocabulary(pieces, scores, merges=False))
    def best(word):
        if not word:
            return 0.0
        options = [scores[own.v.ids[word[:k]]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in own.v.ids]
        return max(options + ([own.v.worst + best(word[1:])] if word[0] not in own.v.ids else []))
    for word, parts in own.segment({"▁" + "".join(random.choice("abcx") for _ in range(random.randrange(1, 9))) for _ in range(200)}):
        assert abs(sum(scores[i] if i >= 0 else own.v.worst for i in parts) - best(word)) < 1e-9 and "".join(map(own._piece, parts)) == word


# sharding

def test_shards(spark, docs, none):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.placed(rows).collect()
    counts = np.bincount([r.shard for r in out], minlength=40)
    assert len(counts) == 40 and counts.min() > 380 and counts.max() < 620
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert all(r.grown_shard in (r.shard, 40) for r in out) and 300 < sum(r.grown_shard == 40 for r in out) < 700
    got = sharding.placed(docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    for r in got.collect():
        texts = [(t or "").encode() for i, t, _ in TEXTS if i == r.doc_id]
        assert (r.size, r.text_crc32) in [(len(t) + 16, zlib.crc32(t)) for t in texts]
    assert got.count() == len(TEXTS) and sharding.placed(none).count() == 0


def test_places_by_hand(spark):
    def hashed(key, name):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        return xxhash.xxh64_intdigest(name.encode(), seed)
    def place(key, node):
        if not node.children:
            return node.shard
        draws = [(-math.log(((hashed(key, c.name) >> 11) + 1) / 2**53) / c.weight, i) for i, c in enumerate(node.children)]
        return place(key, node.children[min(draws)[1]])
    ids = [None, -7, 0, *range(1, 600), 2**40]
    got = sharding.placed(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")).collect()
    assert len(got) == len(ids)
    for r in got:
        assert (r.shard, r.grown_shard) == (place(r.doc_id, sharding.layout(40)), place(r.doc_id, sharding.layout(41)))


def test_weights_move_only_into_what_grew(spark):
    keys = spark.range(5000)
    old = sharding.descend(keys, "id", sharding.layout(40), "old")
    both = sharding.descend(old, "id", sharding.layout(40, weights={7: 3.0}), "new").collect()
    moved = [(r.old, r.new) for r in both if r.old != r.new]
    # shard 7 is in rack 1 of region 0: rows come into region 0, inside it into rack 1, inside that into shard 7
    assert moved and all(new < 20 and (old >= 20 or new // 5 == 1) and (old // 5 != 1 or new == 7) for old, new in moved)
    gone = sharding.descend(old, "id", sharding.layout(40, weights={7: 0.0}), "new").collect()
    assert all(r.new != 7 for r in gone) and all(r.old < 20 and (r.new >= 20 or r.old // 5 == 1) for r in gone if r.old != r.new)


# near-duplicates

def near_by_hand(rows):
    sets, top = [neardup.shingles(neardup.words_of((t or "").encode())) for _, t in rows], list(range(len(rows)))
    keys = [neardup.content_key(neardup.words_of((t or "").encode())) for _, t in rows]
    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if root(i) != root(j) and (keys[i] == keys[j] or neardup.probability_jaccard(*sets[i], *sets[j]) >= 0.8):
            top[root(j)] = root(i)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {g: min((d for d in v if d is not None), default=None) for g, v in ids.items()}
    return sorted(((d, least[root(i)], len(ids[root(i)])) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark, docs, none):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for family in range(12):
        base = [random.choice(vocabulary) for _ in range(random.choice((3, 30, 120, 300)))]
        for _ in range(random.choice((1, 2, 5, 40))):
            copy = list(base)
            for _ in range(random.randrange(0, 1 + len(base) // 25)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, rows[0][1].upper() + " \n"), (None, rows[1][1]), (None, "alone without an id"), (n + 1, None), (n + 2, ""), (n + 3, "to " * 300), (n + 4, "to " * 260)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(neardup.classes(frame), "class_id", "class_rows") == near_by_hand(rows)
    assert by_id(neardup.classes(docs), "class_id", "class_rows") == near_by_hand([r[:2] for r in TEXTS])
    assert neardup.classes(none).count() == 0
    kept = neardup.first_of_each(frame)
    assert kept.columns == frame.columns
    want = {(d, c) for d, c, _ in near_by_hand(rows) if d == c}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in want), key=repr)


def test_classes_with_the_same_id_stay_apart(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = text("b").replace("b59", "other")
    rows = [(None, text("n")), (None, text("m")), (None, text("k")), (7, text("a")), (7, text("b")), (9, near), (None, text("b").upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = neardup.classes(frame).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        sizes[r.class_h1, r.class_h2] = sizes.get((r.class_h1, r.class_h2), 0) + 1
        assert r.class_id == (7 if r.doc_id else r.class_id)
    assert sorted(sizes.values()) == [1, 1, 1, 1, 3] and all(r.class_rows == sizes[r.class_h1, r.class_h2] for r in found)
    kept = [(r.doc_id, r.text) for r in neardup.first_of_each(frame).collect()]
    assert sorted(kept, key=repr) == sorted(rows[:5], key=repr)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    random.seed(7)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        copy = list(base)
        copy[random.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    assert by_id(neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")), "class_id", "class_rows") == near_by_hand(rows)


def test_signatures_estimate_probability_jaccard():
    random.seed(8)
    a = {i: random.choice((1.0, 2.0, 3.5)) for i in range(400)}
    b = {i: random.choice((1.0, 2.0, 3.5)) for i in range(100, 500)}
    arrays = lambda d: (neardup._mix(np.array(sorted(d), np.uint64)), np.array([d[k] for k in sorted(d)]))
    (x, wx), (y, wy) = arrays(a), arrays(b)
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    ox, oy = np.argsort(x), np.argsort(y)
    assert abs(neardup.probability_jaccard(x[ox], wx[ox], y[oy], wy[oy]) - exact) < 1e-9
    assert abs((neardup.signature(x, wx, 4096) == neardup.signature(y, wy, 4096)).mean() - exact) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.group for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


# chat

def test_chat_round_trip(spark):
    random.seed(9)
    odd = ["", None, "\\### Assistant: </turn> ok", "<turn user>", "\\b\\l<<\\", "a\nb</turn>\n<turn assistant>x", "ü😀", LONG[:5000]]
    rows = [(c, t, random.choice(("user", "assistant", "system", None, "we<i>rd\\")), random.choice(odd)) for c in (1, 2, None, 4) for t in range(random.randrange(1, 20))] + [(1, 0, "user", "tie"), (1, 0, "user", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("x")).withColumn("path", F.lit(1))
    done = chat.formatted(chat.from_turns(frame))
    order = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for r in done.select("*", chat.read_turns("formatted").alias("turns"), chat.read_loss("formatted", "loss").alias("learned")).collect():
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=order)]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.learned == "".join(t for role, t in own if role == "assistant")
    assert done.count() == 4
    assert chat.digests(chat.formatted(chat.from_turns(frame.limit(0)))).count() == 0


def test_reply_trees(spark):
    # 1 - 2 - 3 and 1 - 4 - 5 - 6; 7 starts a tree of its own, 8 answers nobody known, 9 and 10 run in a circle
    rows = [(1, 1, None, "user", "r", 1.0), (1, 2, 1, "assistant", "a", 5.0), (1, 3, 2, "user", "b", 0.0), (1, 4, 1, "assistant", "c", 2.0), (1, 5, 4, "user", "d", 2.0), (1, 6, 5, "assistant", "e", 2.0),
            (2, 7, None, "user", "f", None), (3, 8, 77, "user", "g", 1.0), (4, 9, 10, "user", "h", 1.0), (4, 10, 9, "user", "i", 1.0), (1, None, 1, "user", "lost", 9.0)]
    frame = spark.createDataFrame(rows, chat.MESSAGES)
    one = {(r.conv_id, r.path): r.formatted for r in chat.formatted(frame).collect()}
    assert set(one) == {(1, 3), (2, 7), (3, 8)}
    two = {(r.conv_id, r.path): [t.text for t in r.t] for r in chat.formatted(frame, 2).withColumn("t", chat.read_turns("formatted")).collect()}
    assert two == {(1, 3): ["r", "a", "b"], (1, 6): ["r", "c", "d", "e"], (2, 7): ["f"], (3, 8): ["g"]}
    long_ = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), None) for i in range(70)], chat.MESSAGES)
    assert [t.text for t in chat.formatted(long_).withColumn("t", chat.read_turns("formatted")).first().t] == [str(i) for i in range(70)]


# records

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_records(spark, docs, none, tmp_path):
    folder = str(tmp_path / "r")
    index = records.write(docs, WORDS, folder, 1, file_bytes=200)
    assert index.select("file").distinct().count() > 1
    tokenizer = Tokenizer.from_file(WORDS)
    rows = sorted(((i, t) for i, t, _ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    found = records.read(index, folder).join(records.starts(index), "part")
    got = sorted(((r.doc_id, r.part_start + r.before, r.n_tokens, r.ids_crc32, r.ids) for r in found.collect()), key=lambda r: r[1])
    assert got == want
    assert records.round_trip(none, WORDS).count() == 0


def test_frames_are_tfrecords():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    payloads = [bytes(random.randrange(256) for _ in range(n)) for n in (4, 9, 511, 512, 513, 4000)]
    framed = records.frame(payloads)
    assert records.unframe(framed) == payloads and struct.unpack("<Q", framed[2][:8])[0] == 511
    with pytest.raises(ValueError):
        records.unframe([framed[3][:100] + b"\0\1" + framed[3][102:]])


def test_cached_words_equal_the_tokenizer():
    from pressdelta.llm.words import WordEncoder
    tokenizer, own = Tokenizer.from_file(WORDS), WordEncoder(WORDS, cached=50)
    for t in ("it's don'T we'll’s 'sa.b", "Ünïcode İstanbul ΣΑΣ. ΣΑΣ", "a.b,c..!? x1y2 ３４", "é à. \t\x0b x\r\ny \x1cq", "中文 字。", "naïve!!! A.B. ﬁ ǅ", "áb́c d́. é", "DŽ ẞ", "a'll. 's, 'S.", "K̊ Å", "_x_ a_b #tag a*** **b", LONG):
        assert np.frombuffer(next(own.encode([t], 2)), "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


# tiff

def test_tiff_round_trips():
    random.seed(10)
    for n, alphabet in itertools.product((1, 5, 300), (2, 256)):
        data = bytes(random.randrange(alphabet) for _ in range(64 * n))
        for how, tile, predictor, order in itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (0, 16), (1, 2), "<>"):
            pages = list(tiff.walk(tiff.encode(data, page_rows=100, strip_rows=33, compression=how, tile=tile, predictor=predictor, order=order)))
            assert len(pages) == -(-n // 100) and b"".join(p.samples.tobytes() for p in pages) == data


def test_tiff_pages(spark, docs, none):
    media = tiff.to_media(docs.drop("key"), page_rows=64).cache()
    out = tiff.pages(media).collect()
    for key in {r.key for r in out}:
        texts = [(t or "").encode() for i, t, _ in TEXTS if i == key]
        own = [r for r in out if r.key == key]
        assert sum(r.last for r in own) == len(texts)
        payload = texts[0].ljust(max(64, -(-len(texts[0]) // 64) * 64), b"\0")
        last = [r for r in own if r.last][0]
        assert last.image_sha256 == hashlib.sha256(payload).hexdigest() and last.tail_crc32 == zlib.crc32(payload[-64:]) and last.image_bytes == len(payload)
        assert b"".join(r.samples for r in sorted(own, key=lambda r: r.page)[: last.page + 1]).startswith(payload[:64])
    assert max(r.page for r in out) > 10
    good = tiff.encode(bytes(640), page_rows=5)
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0\xff\xff\0\0"), (4, bytearray(good[:-8])), (5, bytearray(good))], "key int, media binary")
    told = {k: [(r.page, r.error is None) for r in tiff.pages(broken).collect() if r.key == k] for k in range(1, 6)}
    assert told[1] == told[2] == told[3] == [(None, False)] and told[4][-1] == (None, False) and told[5] == [(0, True), (1, True)]
    assert tiff.pages(tiff.to_media(none)).count() == 0


def test_forms_follow_the_text_and_pad_to_a_multiple():
    assert [len(tiff.padded(bytes(n))) for n in (0, 1, 63, 64, 65, 128)] == [64, 64, 64, 64, 128, 128]
    forms = {tuple(tiff.form_of(b"text %d" % i).items()) for i in range(4000)}
    # every compression, with and without tiles and predictor, in both byte orders
    assert len(forms) == 4 * 2 * 2 * 2 and all(tiff.form_of(x) == tiff.form_of(bytes(x)) for x in (b"", b"a"))


def test_feature_by_hand(spark):
    texts = [f"text {i} ü" * (i * 9) for i in range(40)]
    media = tiff.to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in tiff.pages(media).filter("last").collect():
        raw = texts[r.key].encode()
        flat = list(raw) + [0] * ((-len(raw)) % 64 if raw else 64)
        n, rows = len(flat), [flat[i : i + 64] for i in range(0, len(flat), 64)]
        step = sum(abs(b - a) for row in rows for a, b in zip(row, row[1:]))
        bins = [sum(x >> 4 == k for x in flat) for k in range(16)]
        assert r.feature == f"mean={1000 * sum(flat) // n};var={1000 * (n * sum(x * x for x in flat) - sum(flat) ** 2) // n**2};step={1000 * step // n};bins=" + ",".join(map(str, bins))


# rules

def rules_by_hand(text):
    import re
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_rules(spark, docs, none):
    random.seed(11)
    texts = [" ".join(random.choice(("a", "bb", "c#", "dd\n", "e|e", "ü", "\n")) for _ in range(random.randrange(90))) for _ in range(60)] + [t for _, t, _ in TEXTS] + [" ".join(f"t{i}" for i in range(120)), "x y z " * 40]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base_failed", F.lit("x"))
    for r in rules.judged(frame).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_by_hand(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert rules.judged(docs).count() == len(TEXTS) and rules.judged(none).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark):
    frame = spark.range(200).withColumn("x", F.col("id") % 7)
    cascade = [rules.Rule("slow", F.aggregate(F.sequence(F.lit(0), F.lit(3000)), F.lit(0), lambda a, b: a + b % 2) + F.col("x") > 1505), rules.Rule("quick", F.col("x") < 3), rules.Rule("never", F.lit(None).cast("boolean"))]
    kept = [{r.id for r in frame.filter(rules.verdict(p)).collect()} for p in itertools.permutations(cascade)]
    assert all(k == kept[0] for k in kept) and 0 < len(kept[0]) < 200
    assert {r.name for r in rules.ordered(frame.cache(), cascade)} == {"slow", "quick", "never"}


def test_order_of_rules_is_steady(spark):
    """Rules of clearly different cost and selectivity come in the same order in every run."""
    frame = spark.range(400).withColumn("x", F.col("id") % 10).cache()
    work = lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0), lambda a, b: a + b % 2)
    cascade = [rules.Rule("quick", work(40) + F.col("x") < 24), rules.Rule("slow", work(4000) + F.col("x") < 2004), rules.Rule("rare", work(4000) + F.col("x") < 2001)]
    orders = {tuple(r.name for r in rules.ordered(frame, cascade, rows=4000)) for _ in range(10)}
    assert orders == {("quick", "slow", "rare")}


def test_sample_of_rules_is_not_gathered(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of some words "), "id").alias("text"))
    plan = rules.judged(docs, sample_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan


def test_near_duplicates_without_ids_and_in_large_groups(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    base = [random.choice(words) for _ in range(60)]
    def near(k):
        w = list(base)
        w[k % 5] = f"x{k}"
        return " ".join(w)
    rows = [(i if i % 3 else None, near(i), "a") for i in range(700)] + [(None, " ".join(random.choice(words) for _ in range(40)), "b") for _ in range(200)] + [(None, "the very same text " * 5, "c")] * 300
    docs = spark.createDataFrame(rows, DOCS)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    classes = {}
    for r in got:
        classes.setdefault((r.class_h1, r.class_h2), []).append(r)
    sizes = sorted(map(len, classes.values()), reverse=True)
    assert sizes[:3] == [700, 300, 1] and len(sizes) == 202
    assert neardup.first_of_each(docs).count() == 202
