"""Change records: each branch of the decision, batch and fold, date and paywall folds, gates."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pressdelta.operators import changes as ch, passages as ps
from pressdelta.sources.tables import SCHEMAS, Tables, conform

T0 = dt.datetime(2026, 1, 1)
P = [f"Absatz {c} {'mit vielen verschiedenen Wörtern ' + c * 7} und genug Zeichen, damit er zählt {c * 9}." for c in "abcdefghijklmn"]


def captures(spark, *steps, **extra):
    """One article; a step is (paragraph numbers, title) or a dict of columns."""
    rows = []
    for i, s in enumerate(steps):
        d = s if isinstance(s, dict) else {"p": s[0], "title": s[1]}
        rows.append((1, T0 + dt.timedelta(hours=i), d.get("title", "T"), "\n".join(P[k] if isinstance(k, int) else k for k in d["p"]), d.get("description"), d.get("topic"), d.get("paywalled"), d.get("stored"), d.get("track"), d.get("live", False)))
    return spark.createDataFrame(rows, "article_id bigint, captured_at timestamp_ntz, title string, body string, description string, topic string, paywalled boolean, published_stored timestamp_ntz, published_track timestamp_ntz, is_live boolean")


def records(spark, *steps):
    return ch.track_changes(captures(spark, *steps)).orderBy("captured_at").collect()


@pytest.mark.parametrize("steps,kinds", [
    ([([0, 1], "T"), ([0, 1], "T")], []),
    ([([0, 1], "T"), ([1, 0], "T")], []),                                  # order only
    ([([0, 1], "T"), ([0, 1, 2], "T")], ["extension"]),
    ([([0, 1], "T"), ([0], "T")], ["edit"]),
    ([([0, 1], "T"), ([0, 2], "T")], ["edit"]),
    ([([0, 1], "T"), ([0, 1], "U")], ["edit"]),
    ([([0, 1], "T"), ([0, 1, 2], "U")], ["edit"]),                         # title wins over growth
    ([([0, 1], "A&amp;B"), ([0, 1], "A&B")], []),
    ([([0], "T"), ([0, 1], "T"), ([0, 1, 2], "T"), ([3], "T")], ["extension"] * 3),   # grown twice: a growing article
    ([([0, 1], "T"), ([0, 2], "T"), ([0, 1], "T"), ([0, 2], "T")], ["edit"]),         # pendulum
    ([([0, 1, 9], "T"), ([0, 2, 9], "T"), ([0, 1, 8], "T"), ([0, 2, 8], "T")], ["edit", "edit"]),  # the same flip with another text around it
    ([{"p": [0], "live": True}, {"p": [1], "live": True}], ["extension"]),
    ([([0], "T"), ([], "T"), ([0], "T")], []),                             # capture without text keeps the state
])
def test_kinds(spark, steps, kinds):
    assert [r.change_kind for r in records(spark, *steps)] == kinds


def test_metadata_and_date(spark):
    a, b = dt.datetime(2026, 1, 1, 8), dt.datetime(2026, 1, 1, 9)
    base = {"p": [0, 1], "description": "alt", "topic": "sport", "paywalled": False, "stored": a, "track": a}
    r = records(spark, base, {**base, "description": "neu", "paywalled": True, "topic": None}, {**base, "description": "neu", "paywalled": True, "topic": None, "track": a + dt.timedelta(seconds=59)},
                {**base, "description": "neu", "paywalled": True, "topic": None, "track": b}, {**base, "description": "neu", "paywalled": True, "topic": None, "track": b})
    assert [x.change_kind for x in r] == ["edit", "edit"]
    assert [(m.field, m.old, m.new) for m in r[0].meta_edits] == [("description", "alt", "neu"), ("paywalled", "false", "true")]
    assert (r[1].pubdate_old, r[1].pubdate_new) == (a, b) and r[1].changes == [] and r[1].added == ""    # no ghost paragraph; no second report


def test_record_contents(spark):
    r = records(spark, ([0, 1], "T"), ([0, P[1].replace("verschiedenen", "anderen")], "T"), ([0, 1, 2, 3], "T"))
    assert len(r[0].changes) == 1 and "verschiedenen" in r[0].changes[0].old and "anderen" in r[0].changes[0].new
    assert (r[0].added_count, r[0].removed_count, r[0].word_delta) == (1, 1, 0)
    assert (r[1].revision_count, r[1].extension_count, r[1].edit_count) == (2, 1, 1)
    live = records(spark, {"p": [0], "live": True}, {"p": [1, 2], "live": True})[0]
    assert live.removed_count == 0 and [c.new for c in live.changes] == [P[1], P[2]] and live.new_type == "liveblog"


def test_many_articles_share_nothing(spark):
    one = captures(spark, ([0, 1], "T"), ([0, 2], "T"), ([0, 1], "T"))
    many = one.withColumn("article_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(50).cast("bigint"))))
    assert ch.track_changes(many).groupBy("article_id").count().filter("count <> 1").count() == 0


PASSAGES = st.lists(st.text(alphabet="abcd ", min_size=1, max_size=12).filter(str.strip), max_size=5, unique=True)


@given(st.lists(st.tuples(PASSAGES, PASSAGES), min_size=1, max_size=12))
@settings(max_examples=4, deadline=None)
def test_batch_and_stream_pair_alike(spark, pairs):
    rows = spark.createDataFrame([(i, o, n) for i, (o, n) in enumerate(pairs)], "id int, removed array<string>, added array<string>")
    got = {r.id: [(c.old, c.new) for c in r.changes] for r in ps.list_changes(rows, ["id"], "removed", "added").collect()}
    tok = lambda xs: [(x, sorted(set(x.split()))) for x in xs]
    for i, (old, new) in enumerate(pairs):
        want = ps.changes_of(tok(old), tok(new))
        assert got.get(i, []) == want
        assert sum(n is not None for _, n in want) <= len(new) and sum(o is not None for o, _ in want) <= len(old)


def test_diff_region(spark):
    a, b = "x" * 300 + "alt" + "y" * 300, "x" * 300 + "neu!" + "y" * 300
    want = ("…" + "x" * 140 + "alt" + "y" * 140 + "…", "…" + "x" * 140 + "neu!" + "y" * 140 + "…")
    rows = spark.createDataFrame([(a, b), ("gleich", "gleich"), ("aaa", "aa"), ("", "x")], "o string, n string").select("o", "n", ps.diff_region(F.col("o"), F.col("n")).alias("r")).collect()
    assert [(r.r.old, r.r.new) for r in rows] == [ps.region_of(r.o, r.n) for r in rows] and ps.region_of(a, b) == want


def test_flip_signature_is_symmetric(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (["b", "c"], ["b", "a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    x, y, z = [r[0] for r in df.select(ch.flip_signature(F.col("a"), F.col("b"))).collect()]
    assert x == y != "" and z == ""


def test_freeze_dates_in_any_order(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [(1, h(1), h(0), True, None, h(1)), (1, h(2), h(2), True, None, h(1)), (1, h(3), h(-5), True, h(1), h(1)), (1, h(4), None, False, None, h(1)),
            (2, h(1), h(9), True, None, h(1)), (3, h(1), None, False, h(4), h(1)), (3, h(5), h(0), False, h(2), h(1)), (4, h(1), h(0), True, None, h(1)), (4, h(2), h(0) + dt.timedelta(seconds=60), True, None, h(1))]
    schema = "article_id bigint, captured_at timestamp_ntz, reported_pub timestamp_ntz, precise boolean, reported_mod timestamp_ntz, first_seen timestamp_ntz"
    for data in (rows, rows[::-1]):
        got = {r.article_id: (r.published_at, r.modified_at) for r in ch.freeze_dates(spark.createDataFrame(data, schema)).collect()}
        assert got == {1: (h(0), h(2)), 2: (h(1), None), 3: (h(0), h(4)), 4: (h(0), None)}


def test_sitemap_dates(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    a = spark.createDataFrame([("u1", h(5), None), ("u2", None, None), ("u3", h(5), h(9)), ("u4", None, None)], "url string, published_at timestamp_ntz, modified_at timestamp_ntz")
    d = spark.createDataFrame([("u1", h(3), True), ("u1", h(8), True), ("u2", h(4), False), ("u3", h(7), True), ("u3", h(1), False)], "url string, at timestamp_ntz, precise boolean")
    assert {r.url: (r.published_at, r.modified_at) for r in ch.apply_sitemap_dates(a, d).collect()} == {"u1": (h(3), h(8)), "u2": (h(4), None), "u3": (h(5), h(9)), "u4": (None, None)}


@pytest.mark.parametrize("seq,want", [([None, True, None], [None, True, True]), ([True, False, None], [True, False, False]), ([False, True], [False, True]), ([True, None, False], [True, True, False])])
def test_sticky_paywall(spark, seq, want):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(days=i), v) for i, v in enumerate(seq)], "article_id bigint, captured_at timestamp_ntz, paywalled boolean")
    assert [r.paywalled_state for r in ch.sticky_paywall(df).orderBy("captured_at").collect()] == want


def test_archive_gate_keeps_live_and_changed(spark):
    old = T0 - dt.timedelta(days=31)
    rows = [(1, "https://x.de/a/1", "T", old, 0), (2, "https://x.de/liveblog/2", "T", old, 0), (3, "https://x.de/a/3", "T", old, 1), (4, "https://x.de/a/4", "T", None, 0), (5, "https://x.de/a/5", "T", old, 0), (6, "https://x.de/a/6", "T", T0 - dt.timedelta(days=30), 0)]
    a = conform(spark.createDataFrame(rows, "id bigint, url string, title string, published_at timestamp_ntz, revision_count bigint"), SCHEMAS["articles"])
    pages = conform(a.select("id", "url", F.lit("article").alias("kind")), SCHEMAS["pages"])
    fresh = spark.createDataFrame([("https://x.de/a/5", T0)], "url string, page_date timestamp_ntz")
    t = ch.archive_gate(Tables(articles=a, pages=pages), T0, reported=fresh)
    assert {r.id for r in t.articles.collect()} == {2, 3, 4, 5, 6}
    assert {r.id for r in t.pages.filter("kind = 'archive'").collect()} == {1}


def test_rebaseline_ignores_removed_chrome(spark):
    from pressdelta.operators.body import clean_body
    stored = spark.createDataFrame([(1, ["Vorspann Artikel weiterlesen " + P[0]], "https://www.bild.de/a/1")], "article_id bigint, paras array<string>, url string")
    cleaned = clean_body(stored.withColumns({"body": ch.joined_paras(F.col("paras")), "title": F.lit(None).cast("string"), "description": F.lit(None).cast("string")}))
    now = ch.with_fingerprints(ch.with_paragraphs(spark.createDataFrame([(P[0],)], "body string"))).first()
    assert ch.rebaseline(cleaned, F.col("body")).first().content_hash == now.content_hash


def test_bounded_history(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "a")], "h array<string>, x string")
    assert df.select(ch.push_bounded(F.col("h"), F.col("x"), 3, unique=True)).first()[0] == ["b", "c", "a"]
    assert df.select(ch.push_bounded(F.col("h"), F.col("x"), 3)).first()[0] == ["b", "c", "a"]
    assert spark.createDataFrame([(None, "a")], "h array<string>, x string").select(ch.push_bounded(F.col("h"), F.col("x"), 3, unique=True)).first()[0] == ["a"]


# --- matching and folds in rounds against the plain sequences -----------------------------------------------------------------
def plain_matching(edges):
    """edges {(new, old): (tier, -score)}: each new one, in order, takes the best old one that is left."""
    left, out = {o for _, o in edges}, set()
    for n in sorted({n for n, _ in edges}):
        mine = [(*edges[n, o], o) for o in left if (n, o) in edges]
        if mine:
            out.add((n, min(mine)[-1]))
            left.discard(min(mine)[-1])
    return out


def test_matching_in_rounds_equals_the_sequence(spark):
    rnd = random.Random(3)
    groups = []
    for g in range(60):
        n, m = rnd.randrange(1, 9), rnd.randrange(1, 9)
        # few different scores: many ties, and many equal lists
        groups.append({(a, b): (rnd.choice([0, 0, 1]), -rnd.choice([1.0, 0.5, 80.0])) for a in range(n) for b in range(m) if rnd.random() < rnd.choice([0.4, 1.0])})
    groups.append({(a, b): (0, -1.0) for a in range(60) for b in range(40)})
    rows = [(g, o, n, t, -s) for g, edges in enumerate(groups) for (n, o), (t, s) in edges.items()]
    d = spark.createDataFrame(rows, "g int, old_pos int, new_pos int, tier int, score double")
    got = {(r.g, r.new_pos, r.old_pos) for r in ps.matched_in_order(d, ["g"]).collect()}
    assert got == {(g, n, o) for g, edges in enumerate(groups) for n, o in plain_matching(edges)}
    assert ps.matched_in_order(d.limit(0), ["g"]).count() == 0


def random_events(rnd, article, n, live=False):
    """Thin change events with swings between few states, dates that move, titles and metadata."""
    out, day = [], dt.datetime(2026, 1, 1)
    for i in range(n):
        h, pub = f"h{rnd.randrange(6)}", rnd.choice([None, 0.0, 100.0, 5000.0])
        out.append((article, day + dt.timedelta(minutes=7 * i), h, rnd.choice(["", "s1", "s2", f"s{i}"]), rnd.randrange(0, 3), rnd.randrange(0, 3), rnd.random() < 0.8, rnd.random() < 0.02, rnd.random() < 0.02, 0.0 if pub is None else pub, pub, live and i > n // 2))
    return out


def test_chunks_at_once_equal_the_fold(spark):
    rnd = random.Random(12)
    rows = [e for a, n in ((1, 400), (2, 3), (3, 90), (4, 25), (5, 26)) for e in random_events(rnd, a, n, live=a == 3)]
    d = spark.createDataFrame(rows, "article_id bigint, captured_at timestamp_ntz, content_hash string, sig string, added_count bigint, removed_count bigint, visible boolean, title_edit boolean, meta_edit boolean, pub_prev_s double, pub_new_s double, is_live boolean")
    want = []
    for a in sorted({r[0] for r in rows}):
        state = ch.new_state()
        for r in (r for r in rows if r[0] == a):
            rec = ch.advance(state, dict(zip(("hash", "sig", "added", "removed", "visible", "title", "meta", "pub_prev", "pub_new", "live"), r[2:])))
            if rec:
                want.append((a, r[1], rec["kind"], rec["growing"], rec["pub"], rec["pub_old"], rec["rev"], rec["ext"], rec["edit"], rec["type"]))
    key = lambda rows_: sorted(map(str, map(tuple, rows_)))
    assert key(ch.decide(d, 10).collect()) == key(ch.decide(d, 25).collect()) == key(ch.decide(d).collect()) == key(want)


def test_removed_furniture_is_no_change(spark):
    text = "Der Text des Artikels, der lang genug für einen Absatz ist und sich nicht ändert."
    old = f"Vorspann Foto: Max 01.02.2026 - 10:11 Uhr {text}"
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    d = spark.createDataFrame([(1, t[0], "https://www.bild.de/a", "T", old), (1, t[1], "https://www.bild.de/a", "T", text), (1, t[2], "https://www.bild.de/a", "T", text + " Und ein Satz mehr.")],
                              "article_id bigint, captured_at timestamp_ntz, url string, title string, body string")
    assert [r.captured_at for r in ch.track_changes(d, reclean=True).collect()] == [t[2]]
    assert ch.track_changes(d).count() == 2
