"""Sinks, retention, planning borders, clusters, section tree, context."""

import datetime as dt
import glob
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressdelta.operators import clustering as cl, context as cx, filters as fl, planning as pl, retention as rt, search as sr, url_jobs as uj
from pressdelta.sources import sinks as sk
from pressdelta.sources.tables import SCHEMAS, Tables, conform, load_tables

NOW = dt.datetime(2026, 3, 1, 12)


def table(spark, name, rows, cols):
    return conform(spark.createDataFrame(rows, cols), SCHEMAS[name])


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a;b "c"'), (2, None), (3, "plain")], "n int, t string").coalesce(1)
    sk.export_csv(df, str(tmp_path / "out"), {"n": "Nr", "t": "Text"})
    text = open(glob.glob(str(tmp_path / "out" / "*.csv"))[0], encoding="utf-8").read()
    assert text == '﻿Nr;Text\n1;"a;b ""c"""\n2;\n3;plain\n'


def test_numbered(spark):
    df = spark.range(100).withColumn("v", 100 - F.col("id")).repartition(7)
    rows = sk.numbered(df, ["v"]).collect()
    assert [r["#"] for r in rows] == list(range(1, 101)) and [r.v for r in rows] == list(range(1, 101))


def files_of(path):
    return {f: f.split("__part=")[1].split("/")[0] for f in glob.glob(f"{path}/__part=*/*.parquet")}


def test_merge_rewrites_touched_parts_only(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(None).cast("int").alias("w"))
    t = sk.BucketedTable.create(rows, "merge_test", "k", str(tmp_path / "t"), parts=16, buckets=4)
    before = files_of(t.path)
    u = spark.createDataFrame([(7, "seven", 1), (9000, "new", 2)], "k bigint, v string, w int")
    touched = {str(p) for p in t.merge(u)}
    after = files_of(t.path)
    assert 1 <= len(touched) <= 2 and {f for f, p in before.items() if p not in touched} == {f for f, p in after.items() if p not in touched}
    assert not {f for f, p in before.items() if p in touched} & set(after)
    got = {r.k: (r.v, r.w) for r in t.rows().collect()}
    assert len(got) == 5001 and got[7] == ("seven", 1) and got[9000] == ("new", 2) and got[8] == ("v8", None)
    # the target is met as it lies
    plan, _ = t.merged(u)
    text = plan._jdf.queryExecution().executedPlan().toString()
    side = text[text.index("FileScan parquet spark_catalog"):].split("\n")[0]
    assert "Bucketed: true" in side and text.count("Exchange hashpartitioning(k") + text.count("BroadcastExchange") <= 1
    assert t.merge(u) == sorted(int(p) for p in touched) and {r.k: (r.v, r.w) for r in t.rows().collect()} == got
    t.merge(spark.createDataFrame([(7, "known", 5), (9001, "newer", 5)], "k bigint, v string, w int"), "ignore")
    t.merge(spark.createDataFrame([(8, 3), (99999, 4)], "k bigint, w int"), "existing")
    got = {r.k: (r.v, r.w) for r in t.rows().collect()}
    assert len(got) == 5002 and got[7] == ("seven", 1) and got[9001] == ("newer", 5) and got[8] == ("v8", 3)
    # all keys of a part: the part goes
    part = sorted(set(after.values()))[0]
    t.merge(t.read([int(part)]).select("k"), "delete")
    left = {r.k for r in t.rows().collect()}
    assert part not in files_of(t.path).values() and left < set(got) and t.merge(u.filter("k < 0")) == []
    t.drop()


def test_search_index_against_plain_search(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcäB 7.") for _ in range(rnd.randrange(1, 9)))
    a = [(i, rnd.random() < 0.9, 1 + i % 3, word(), word(), None if i % 5 else word(), word()) for i in range(300)]
    kw = [(i, word()) for i in range(40)]
    ak = [(rnd.randrange(300), rnd.randrange(40)) for _ in range(200)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = lambda rows: Tables(articles=made(rows, "id bigint, is_article boolean, source_id int, title string, url string, description string, topic string"), keywords=made(kw, "id bigint, term string"), article_keywords=made(ak, "article_id bigint, keyword_id bigint"))
    terms = ["ab", "B 7", "cäb", "a", "7.", "abca", "zz", "a_b", "%%", "c%7"]
    index = sr.SearchIndex(spark).add(sr.units(t(a[:200]))).add(sr.units(t(a[200:])).filter("kind = 'article'"))
    # a delta: some articles get other texts
    a = [(r[0], r[1], r[2], word(), *r[4:]) if r[0] % 10 == 0 else r for r in a]
    now = t(a)
    index.add(sr.units(now).filter("kind = 'article' AND id % 10 = 0"))
    like = lambda x, q: re.search(re.escape(q).replace("%", ".*").replace("_", "."), x or "", re.I | re.S)
    linked = lambda i, q: any(like(dict(kw)[k], q) for d, k in ak if d == i)
    want = {(q, r[0]) for q in terms if len(q) > 1 for r in a if r[1] and (any(like(x, q) for x in r[3:]) or linked(r[0], q))}
    assert {tuple(r) for r in index.search(now, terms).collect()} == want == {tuple(r) for r in fl.search_many(now, tuple(terms)).collect()}
    assert {tuple(r) for r in index.search(now, terms, [2]).collect()} == {(q, i) for q, i in want if i % 3 == 1}
    # the number of scans does not follow the number of terms
    scans = lambda ts: index.search(now, ts)._jdf.queryExecution().optimizedPlan().toString().count("Relation [gram")
    assert scans(["ab", "abca"]) == scans(["ab", "abca", "7.", "zz", "B 7", "cäb", "bca"])


def test_upserts_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, v string")
    once = sk.upsert(t, u, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sk.upsert(once, u, "k").collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, sk.upsert(t, u, "k", "ignore").collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, sk.update_existing(t, u, "k").collect())) == [(1, "a"), (2, "x")]


def test_load_conforms(spark, tmp_path):
    spark.createDataFrame([(1, "u", 5)], "id int, url string, extra int").write.parquet(str(tmp_path / "pages"))
    p = load_tables(spark, str(tmp_path), "pages").pages
    assert p.schema == SCHEMAS["pages"] and p.first().kind is None


def retention_tables(spark):
    s = dt.timedelta(seconds=1)
    edge = NOW - dt.timedelta(days=30)
    a = table(spark, "articles", [(1, edge - s), (2, edge), (3, edge + s), (4, edge - s)], "id bigint, last_seen timestamp_ntz")
    pay = NOW - dt.timedelta(days=14)
    snaps = [(10, 4, pay - s, "edit", "t"), (11, 4, pay, "edit", "t")] + [(100 + i, 3, NOW - dt.timedelta(minutes=i), "extension", "t") for i in range(62)]
    p = spark.createDataFrame([(i, ["p"]) for i in (1, 2, 4)], "article_id bigint, paras array<string>")
    old = NOW - dt.timedelta(days=35)
    g = table(spark, "sightings", [(1, old - s, 1), (1, old, 1)], "source_id bigint, minute timestamp_ntz, n bigint")
    return Tables(articles=a, snapshots=table(spark, "snapshots", snaps, "id bigint, article_id bigint, captured_at timestamp_ntz, change_kind string, added string"), article_paras=p, sightings=g)


def test_prune_borders_and_idempotence(spark):
    once = rt.prune(retention_tables(spark), NOW)
    twice = rt.prune(once, NOW)
    for t in (once, twice):
        assert {r.id for r in t.articles.collect()} == {2, 3, 4}
        s = {r.id: r.added for r in t.snapshots.collect()}
        assert len(s) == 62 and 160 not in s and 159 in s and s[10] is None and s[11] == "t"
        assert {r.article_id for r in t.article_paras.collect()} == {2}
        assert t.sightings.count() == 1


def test_rescan_tier_borders(spark):
    h = lambda n: NOW - dt.timedelta(hours=n)
    rows = [(1, h(2), h(2), "T"), (2, h(2), h(0.5), "T"), (3, h(24), h(2), "T"), (4, h(25), h(7), "T"), (5, h(49), h(25), "T"), (6, h(80), h(50), "T"), (7, h(2), h(3), None)]
    a = table(spark, "articles", [(i, 1, f"u{i}", p, p, s, t) for i, p, s, t in rows], "id bigint, source_id bigint, url string, published_at timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz, title string")
    pages = table(spark, "pages", [(6, 1, "u6", "article", h(80), h(1))], "id bigint, source_id bigint, url string, kind string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    s = table(spark, "sources", [(1, True)], "id bigint, active boolean")
    got = {r.url: r.stage for r in pl.select_rescans(Tables(articles=a, pages=pages, sources=s), NOW, 20).collect()}
    assert got == {"u1": "tier1", "u3": "tier1", "u4": "tier2", "u5": "tier3", "u6": "linked", "u2": "overdue"}


def test_what_a_full_tier_leaves_goes_to_later_stages(spark):
    h = lambda n: NOW - dt.timedelta(hours=n)
    a = table(spark, "articles", [(i, 1, f"u{i:02}", h(2), h(2), h(3 + i), "T") for i in range(20)], "id bigint, source_id bigint, url string, published_at timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz, title string")
    pages = table(spark, "pages", [(1, 1, "u01", "article", h(80), h(1))], "id bigint, source_id bigint, url string, kind string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    s = table(spark, "sources", [(1, True)], "id bigint, active boolean")
    got = [(r.url, r.stage, r.rn) for r in pl.select_rescans(Tables(articles=a, pages=pages, sources=s), NOW, 20).collect()]
    want = [(f"u{i:02}", "tier1", 20 - i) for i in range(19, 8, -1)] + [(f"u{i:02}", "overdue", 9 - i) for i in range(8, -1, -1)]
    assert sorted(got) == sorted(want)


def test_horizon_sets_the_last_tier(spark):
    h = lambda n: NOW - dt.timedelta(hours=n)
    a = table(spark, "articles", [(1, 1, "u1", h(100), h(100), h(30), "T")], "id bigint, source_id bigint, url string, published_at timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz, title string")
    pages = table(spark, "pages", [], "id bigint, source_id bigint, url string, kind string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    t = Tables(articles=a, pages=pages, sources=table(spark, "sources", [(1, True)], "id bigint, active boolean"))
    assert pl.select_rescans(t, NOW, 20).count() == 0
    assert [r.stage for r in pl.select_rescans(t, NOW, 20, horizon_days=5).collect()] == ["tier3"]


def test_unit_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 8))
    v = np.concatenate([centre[[0]].repeat(120, 0) + rng.normal(scale=.15, size=(120, 8)), centre[rng.integers(0, 4, 180)] + rng.normal(scale=.3, size=(180, 8)), centre[[1]].repeat(40, 0)])
    df = spark.createDataFrame(pd.DataFrame({"article_id": np.arange(len(v)), "embedding": [list(map(float, x)) for x in v]}))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in cl.similar_pairs(df, 5, 0.9, leaf=20, fan=3).collect():
        got.setdefault(r.article_id, []).append((r.rn, r.neighbour_id, r.similarity))
    for i in range(len(v)):
        want = [j for j in sorted(range(len(v)), key=lambda j: (-round(s[i, j], 9), j)) if s[i, j] >= 0.9][:5]
        have = [j for _, j, _ in sorted(got.get(i, []))]
        assert len(have) == len(want) and np.allclose([s[i, j] for j in have], [s[i, j] for j in want], atol=1e-8)


def clusters_in_order(articles, pairs, existing=()):
    """One article after the other, as the job describes it: {article: (cluster, similarity)} of the new ones."""
    near, has, out = {}, dict(existing), {}
    for a, b, s in pairs:
        near.setdefault(a, []).append((-round(s, 9), b, s))
    for a in sorted(articles):
        if a in has:
            continue
        close = sorted(near.get(a, []))
        target = next((has[b] for _, b, _ in close if b in has), a)
        has[a], out[a] = target, (target, 1.0)
        for _, b, s in close:
            if b not in has:
                has[b], out[b] = target, (target, s)
    return out


def test_clusters_equal_the_sequence(spark):
    rnd = random.Random(7)
    for n, share, seed in ((60, 0.03, 0), (40, 0.2, 5), (25, 0.6, 3)):
        pairs = [(a, b, rnd.choice([0.9, 0.95, 0.99])) for a in range(n) for b in range(n) if a != b and rnd.random() < share]
        old = [(i, 1000 + i % 3) for i in rnd.sample(range(n), seed)]
        d = spark.createDataFrame(pairs, "article_id bigint, neighbour_id bigint, similarity double")
        known = spark.createDataFrame([(c, i, 1.0) for i, c in old], "cluster_id bigint, article_id bigint, similarity double")
        all_ = spark.createDataFrame([(i,) for i in range(n)], "article_id bigint")
        got = cl.assign_clusters(d, known if seed else None, all_)
        assert {r.article_id: (r.cluster_id, r.similarity) for r in got.collect()} == clusters_in_order(range(n), pairs, old)
        assert cl.with_clusters(known, got).count() == n


def test_leaders_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = cl.leaders(spark.range(201).withColumnRenamed("id", "node"), e)
    assert sorted(r.node for r in got.collect()) == list(range(0, 201, 2))


def test_share_of_compared_pairs_falls_with_size(spark):
    """Vectors of many stories: with more of them, balls get tighter and a smaller share is compared."""
    share = []
    for n in (400, 3200):
        rng = np.random.default_rng(n)
        centre = rng.normal(size=(n // 20, 16))
        v = centre.repeat(20, 0) + rng.normal(scale=.05, size=(n, 16))
        df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n), "embedding": [list(map(float, x)) for x in v]}))
        members, nodes = cl.ball_tree(df, leaf=32, fan=8)
        assert members.count() == n and nodes.filter("size > 32").count() == nodes.select("parent").distinct().count() - 1
        share.append(cl.compared_share(nodes, cl.near_leaves(nodes, float(np.arccos(0.95)))))
    assert share[1] < share[0] / 2 < 0.2


def test_tree_is_pruned_and_compressed(spark):
    urls = [("/politik/ausland/eu/a-1.html", "article"), ("/politik/ausland/eu/a-2.html", "article"), ("/sport/a-3.html", "article"), ("/sport/fussball/a-4.html", "article"), ("/video/b", "media"), ("/article/2026/05/a-5.html", "article")]
    p = table(spark, "pages", [(1, "https://x.de" + u, k) for u, k in urls], "source_id bigint, url string, kind string")
    got = {r.path: (r.parent, r.label, r.articles, r.is_article) for r in uj.section_tree(p, 2).collect()}
    assert got["politik"] == ("", "politik/ausland/eu", 2, False) and got["politik/ausland/eu/a-1.html"][0] == "politik"
    assert got["sport"][2] == 2 and got["sport/fussball"][1] == "fussball" and "video" not in got
    assert got["…"] == ("", "… +1", 1, False)


def test_scan_gap_and_points(spark):
    t = [NOW + dt.timedelta(hours=h) for h in (0, 1, 5, 6)]
    a = conform(spark.createDataFrame([(1, t, t[0], t[3], 4)], "id bigint, scan_times array<timestamp_ntz>, first_seen timestamp_ntz, last_seen timestamp_ntz, scan_count bigint"), SCHEMAS["articles"])
    s = table(spark, "snapshots", [(1, 1, t[2], 5)], "id bigint, article_id bigint, captured_at timestamp_ntz, word_delta bigint")
    assert cx.behaviour_profile(Tables(articles=a, snapshots=s)).first().scan_gap_s == 3600.0
    pts = cx.scan_points(Tables(articles=a, snapshots=s), spark.createDataFrame([(1, t[3] + dt.timedelta(hours=6))], "article_id bigint, gone_at timestamp_ntz")).orderBy("t").collect()
    assert [round(p.position) for p in pts] == [0, 8, 42, 50] and [p.change for p in pts] == [False, False, True, False] and pts[0].gone_position == 100.0


def test_link_status_evidence_beats_time(spark):
    from tests.test_filters import rows
    ov = rows(spark, {"link_seen": "2026-01-10 00:00:00", "link_resighted": True}, {"link_seen": "2026-01-01 00:00:00", "link_resighted": True, "url": "u1"}, {"link_seen": "2026-01-01 00:00:00", "link_resighted": False}, {"link_seen": "2026-01-01 00:00:00", "link_resighted": True}, {})
    refs = spark.createDataFrame([("u1", [("/", "home", NOW)])], "url string, refs array<struct<u:string,k:string,t:timestamp_ntz>>")
    assert {r.article_id: (r.state, r.grounds) for r in cx.link_status(ov, refs).collect()} == {0: ("online", "time"), 1: ("online", "evidence"), 2: ("unknown", "time"), 3: ("gone", "time"), 4: (None, None)}


def test_sort_blanks_last(spark):
    from pressdelta.operators.dashboards import sort_view
    df = spark.createDataFrame([(1, "10"), (2, "9,5"), (3, ""), (4, None), (5, "2")], "id int, v string")
    assert [r.id for r in sort_view(df, "v").collect()] == [5, 2, 1, 3, 4]
    assert [r.id for r in sort_view(df, "v", "desc").collect()] == [1, 2, 5, 3, 4]
    text = spark.createDataFrame([(1, "Zebra"), (2, "äpfel"), (3, "Birne"), (4, "")], "id int, v string")
    assert [r.id for r in sort_view(text, "v").collect()] == [2, 3, 1, 4]
