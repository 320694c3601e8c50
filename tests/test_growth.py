"""Steps that must not grow faster than their input: plans, and the same values as the plain forms."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import q_captures
from pressdelta import constants as K
from pressdelta.functions import text as tx
from pressdelta.operators import body as bd, clustering as cl, editclass as ec, extract as ex, keywords as kw, retention as rt, search as sr
from pressdelta.sources.tables import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_and_pairs(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(400, 6))
    vectors[350:] = vectors[0]
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(vectors)], "article_id bigint, embedding array<double>")
    members, nodes = cl.ball_tree(v.select(F.col("article_id").alias("g"), "embedding"), 8, 4)
    tiles = cl.tiles(nodes, 32)
    rows = tiles.collect()
    assert {r.ball for r in rows} == {r.ball for r in members.select("ball").distinct().collect()}
    held = tiles.groupBy("tile").agg(F.sum("size").alias("n"), F.count("*").alias("leaves")).collect()
    # leaves come together up to the limit; only copies may be more
    assert len(held) < len(rows) and all(r.n <= 32 or r.leaves == 1 for r in held)
    found = {(r.article_id, r.rn): round(r.similarity, 6) for r in cl.similar_pairs(v, 5, 0.3, 8, 4).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    best = -np.sort(-sims, axis=1)[:, :5]
    assert found == {(i, j + 1): pytest.approx(best[i, j], abs=1e-5) for i in range(400) for j in range(5) if best[i, j] >= 0.3}


def test_tiles_meet_without_shuffle(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(300, 5)).astype(np.float32)
    vectors[280:] = vectors[3]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(vectors)] + [(1000, None)]
    v = spark.createDataFrame(rows, "article_id bigint, embedding array<float>")
    plans, counts = {}, {}

    def written(df, name, plain=cl.written):
        plans[name] = physical(df)
        out = plain(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(cl, "written", written)
    found = {(r.article_id, r.rn): (r.neighbour_id, round(r.similarity, 6)) for r in cl.similar_pairs(v, 4, 0.2, 16, 4).collect()}
    # tiles are read from the table by the tasks that need them; what a task finds is whole
    left = plans["ball-near"].split("CartesianProduct")[1].split("Exchange")[0]
    assert "Coalesce 1" in left and "FileScan parquet" in left and counts["ball-cells"] > 4
    assert counts["ball-near"] <= 5 * 281
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    sims = unit @ unit.T
    for i in range(300):
        best = sorted((-round(sims[i, j], 9), j) for j in range(300) if j != i and sims[i, j] >= 0.2)[:4]
        assert [found[i, r + 1][1] for r in range(len(best))] == [pytest.approx(-s, abs=1e-5) for s, _ in best] and (i, len(best) + 1) not in found
    assert not any(1000 in (a, b) for (a, _), (b, _) in found.items())


def test_postings_without_shuffle(spark):
    u = spark.createDataFrame([("article", 1, ["abcab", "abx"]), ("article", 2, ["ab", ""]), ("article", 3, ["a"])], "kind string, id bigint, texts array<string>")
    p = sr.postings(u)
    assert "Exchange" not in physical(p)
    assert sorted((r.id, r.gram) for r in p.collect()) == [(1, "ab"), (1, "abc"), (1, "abx"), (1, "bca"), (1, "bx"), (1, "cab"), (2, "ab")]
    hits = sr.SearchIndex(spark).add(u).candidates(["ab", "bc", "bx", "cab"]).collect()
    assert sorted((r.term, r.id) for r in hits) == [("ab", 1), ("ab", 2), ("bc", 1), ("bx", 1), ("cab", 1)]


def test_neighbours_tasks_follow_pairs(spark, monkeypatch):
    monkeypatch.setattr(kw, "PAIRS_PER_TASK", 10)
    links = [(a, k) for a in range(12) for k in range(6) if (a * 7 + k * 5) % 3]
    t = Tables(article_keywords=spark.createDataFrame(links, "article_id bigint, keyword_id bigint"))
    df = {k: sum(x == k for _, x in links) for k in range(6)}
    best = kw.neighbours(t, k=3)
    assert f"hashpartitioning(article_id#" in physical(best) and f", {-(-sum(n * n for n in df.values()) // 10)})" in physical(best)
    own = {a: {k for x, k in links if x == a} for a in range(12)}
    for a in range(12):
        want = sorted((-round(sum(df[k] ** -0.5 for k in own[a] & own[b]), 9), b, len(own[a] & own[b])) for b in range(12) if b != a and len(own[a] & own[b]) >= 2)[:3]
        assert [(-round(r.score, 9), r.neighbour_id, r.shared) for r in best.filter(F.col("article_id") == a).orderBy("rn").collect()] == want


def test_neighbours_leave_out_single_keywords_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(kw, "BLOCK", 5)
    monkeypatch.setattr(kw, "TAGS", 6)
    rnd = random.Random(4)
    links = [(a, 0) for a in range(30)] + [(a, rnd.randrange(1, 25)) for a in range(30) for _ in range(a % 9)]
    links += [(3, 0), (4, 7), (4, 7), (None, 0), (None, 7), (5, None), (5, None), (-1, 1)]
    t = Tables(article_keywords=spark.createDataFrame(links, "article_id bigint, keyword_id bigint"))
    df = {k: sum(x == k for _, x in links) for k in range(25)}
    whole = {a: [k for x, k in links if x == a and k is not None] for a, _ in links if a is not None}
    # null comes first in the order of keywords
    first = {a: sorted(x)[:max(0, 3 - sum((y, k) == (a, None) for y, k in links))] for a, x in whole.items()}

    def want(mine, k, min_shared=2, most=99):
        out = {}
        for a, own in mine.items():
            shared = {b: [x for x in own for y in other if x == y and df[x] <= most] for b, other in whole.items() if b != a}
            for i, (s, b, n) in enumerate(sorted((-round(sum(df[x] ** -0.5 for x in xs), 9), b, len(xs)) for b, xs in shared.items() if len(xs) >= min_shared)[:k]):
                out[a, i + 1] = (b, pytest.approx(-s, abs=1e-8), n)
        return out

    got = lambda best: {(r.article_id, r.rn): (r.neighbour_id, r.score, r.shared) for r in best.collect()}
    best = kw.neighbours(t, k=4)
    assert "arrays_overlap" in physical(best)
    assert got(best) == want(whole, 4)
    assert got(kw.neighbours(t, k=50, max_df=20)) == want(whole, 50, most=20)
    assert got(kw.neighbours(t, k=4, own=3)) == want(first, 4)
    assert got(kw.neighbours(t, k=4, min_shared=1)) == want(whole, 4, 1)
    ids = spark.createDataFrame([(3,), (17,), (3,), (-1,)], "article_id bigint")
    assert got(kw.neighbours(t, ids=ids, k=4, min_shared=3)) == want({a: whole[a] for a in (3, 17, -1)}, 4, 3)


def test_zero_filled_without_join(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = spark.createDataFrame([("a", d(2), 3), ("a", d(2), 3), ("a", d(9), 4), ("b", d(9), 1), (None, d(1), 5), ("c", None, 2)], "term string, d date, n bigint")
    z = kw.zero_filled(rows, "2024-01-01", "2024-01-03")
    assert "Join" not in plan(z)
    zero = [(t, d(n), 0) for t in ("b", "c", None) for n in (1, 2, 3)]
    assert sorted(map(str, [(r.term, r.d, r.n) for r in z.collect()])) == sorted(map(str, zero + [("a", d(1), 0), ("a", d(2), 3), ("a", d(2), 3), ("a", d(3), 0)]))


def test_clean_body_rules_look_for_plain_texts(spark):
    texts = ["Kopf Foto: Max 01.02.2026 - 10:11 Uhr Text", "x FOTO: Erik / dpa y", "a Artikel weiterlesen b", "BILD z Foto: Q/ BILD", "+++ a 12,99 EUR +++", "BayernA HessenB rest", "t Empfehlungen1:23Film Mehr Inhalte anzeigen",
             "Lesezeit: 6 Min. x", "Text to Speech: abc Def", "Foto: Z/ZUMA/wire.com", "Foto: Getty Images via AFP", "x" * 150 + " Quelle: F.A.Z. y", "z. Folgen Redakteur X FAZ+ y", None, ""]
    hosts = ("www.bild.de", "www.n-tv.de", "www.faz.net", "x.example")
    rows = spark.createDataFrame([(i, t, f"https://{h}/a/b-1.html", "T", None) for i, (t, h) in enumerate((t, h) for t in texts for h in hosts)], "i int, body string, url string, title string, description string")
    plain = tuple(r[:3] for r in bd.RULES)
    assert sum(len(r) > 3 for r in bd.RULES) >= 10
    got, want = (sorted((r.i, r.body) for r in bd.clean_body(rows, rules=x).select("i", "body").collect()) for x in (bd.RULES, plain))
    assert got == want


def test_video_list_in_long_text(spark):
    teasers = "Ein Film über etwas Schönes 01:23Noch ein Film über etwas 02:34Und ein dritter Film dazu 03:45"
    long = "wort " * 200
    rows = spark.createDataFrame([(0, long + "\n" + teasers), (1, long + "um 12:30 Uhr"), (2, teasers + "Ende " + long), (3, None)], "i int, t string")
    c = bd.without_video_list(F.col("t"))
    # lengths are looked for before teasers are
    assert bd.CLIP_END in plan(rows.select(c)).replace("\\\\", "\\")
    got = {r.i: r.x for r in rows.select("i", c.alias("x")).collect()}
    assert got[0] == long + "\n" and got[1] == long + "um 12:30 Uhr" and got[2] == "" and got[3] is None


def test_tags_are_found_once(spark):
    s = spark.createDataFrame([(1, "Rund 12 Leute kamen gestern", "Rund 14 Leute kamen gestern")], "id int, old string, new string")
    snaps = s.select("id", F.array(F.struct("old", "new")).alias("changes"), F.lit(None).cast("string").alias("title_old"), F.lit(None).cast("string").alias("title_new"), F.lit("").alias("added"))
    r = ec.classify_snapshots(snaps)
    assert not [x for x in plan(r).splitlines() if "Filter" in x and "levenshtein" in x]
    assert [t.key for t in r.first().tags] == ["factual"]


def test_captures_are_spread_before_pages_are_made(spark):
    text = plan(q_captures.captures(spark, "/root/testdata/sf0.001"))
    assert text.index("<html") < text.index("Repartition")


def test_free_pages_parse_once(spark):
    page = lambda flag: '<script type="application/ld+json">{"isAccessibleForFree":' + flag + "}</script>"
    pages = spark.createDataFrame([("u", page("true")), ("u", None), ("v", page("true")), ("v", page("false")), ("w", "<p>")], "url string, html string")
    arts = spark.createDataFrame([(1, "u", True), (2, "v", True), (3, "w", True), (4, "u", None)], "id int, url string, paywalled boolean")
    r = ex.backfill_paywall(arts, pages)
    assert not [x for x in plan(r).splitlines() if "Filter" in x and "parse_json" in x]
    assert sorted((x.id, x.paywalled) for x in r.collect()) == [(1, False), (2, True), (3, True), (4, None)]


def test_extensions_are_ranked_in_one_reading(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, at + dt.timedelta(hours=i % 3), "extension" if i % 2 else None if i % 4 else "edit") for i in range(12)] + [(20, None, at, "extension")]
    s = spark.createDataFrame(rows, "id bigint, article_id bigint, captured_at timestamp_ntz, change_kind string")
    kept = rt.cap_extensions(s, 2)
    assert len(re.findall("LogicalRDD|LocalRelation", plan(kept))) == 1
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4, 5, 6, 8, 10, 11, 20]


def test_norm_words_as_token_by_token(spark):
    texts = ["Das »ist« (ein) Test-Fall, 3,5 % --- der'n ΣΑΣ.  x　y!\u0085 ﻿Σ", "", "...", None, "a ſ K İ ı"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.filter(F.transform(tx.split_words(F.col("t")), lambda w: tx.norm_token(w)), lambda w: w != "")
    words = tx.norm_words(F.col("t"))
    # one pattern for the whole text, none for each word
    text = plan(rows.select(words.alias("w")))
    assert text.count("regexp_replace") == 1 and "lambdafunction(lower(regexp_replace" not in text
    assert all(r.a == r.b for r in rows.select(one.alias("a"), words.alias("b")).collect())


def test_boilerplate_as_pattern(spark):
    texts = ["Cet article vous est offert", "RÉSERVÉ AUX ABONNÉS", "pour lire cet", "vous n’êtes pas inscrit", "Newſletter", "COOKİES akzeptieren", "Cookıe verwalten", "datenſchutz", "Konto cookies", "Alle Akzeptieren", "s’abonner", "SE CONNECTER", "Spiegel+ lesen",
             "mit BILD plus", "Jetzt anmelden", "Inscrivez-vous", "nichts davon", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(tx.is_boilerplate(F.col("t")).alias("a"), F.col("t").rlike(tx.rx(K.BOILERPLATE)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(bool(r.a) for r in got) >= 12
