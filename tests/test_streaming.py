"""Streams give the batch result, also when files come in several micro-batches."""

import datetime as dt
import tempfile

from pyspark.sql import Window, functions as F

from pressdelta.operators import changes as ch
from pressdelta.sources.captures import read_links
from pressdelta.sources.driver_tables import derive
from pressdelta.sources.tables import SCHEMAS, conform
from pressdelta.streaming import links as lk, sync
from pressdelta.streaming.track import track_changes_stream

SF = "/root/testdata/sf0.001"
NEW = lambda: tempfile.mkdtemp(prefix="pressdelta-stream-")


def files(df, key, parts):
    """Write a table as several files whose names follow the order of the key."""
    path = NEW()
    rows = df.withColumn("__p", F.ntile(parts).over(Window.orderBy(key)))
    for i in range(1, parts + 1):
        rows.filter(F.col("__p") == i).drop("__p").coalesce(1).write.mode("append").parquet(path)
    return path


def run(stream, mode, collect=None):
    out = []
    sink = lambda b, n: out.extend(b.collect()) if collect is None else collect(b, n)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", NEW()).trigger(availableNow=True).foreachBatch(sink).start()
    assert q.awaitTermination(200)
    return out


def shuffled(df, parts, last):
    """Files in random order of rows, and one more with the rows that let the watermark pass all others."""
    path = NEW()
    for i in range(parts):
        df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(parts)) == i).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
    last.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return path


def test_sightings(spark):
    links = conform(derive(spark, SF, "link_observations"), SCHEMAS["link_observations"])
    batch = {(r.source_id, r.minute): r.n for r in lk.sighting_counts(links).collect()}
    end = links.limit(1).withColumns({"run_id": F.expr("run_id + INTERVAL 9000 DAYS"), "seen_at": F.expr("seen_at + INTERVAL 9000 DAYS")})
    for path in (shuffled(links, 4, end), shuffled(links, 7, end)):
        got = {}
        for r in run(lk.sightings_stream(read_links(spark, path, streaming=True, max_files=1), "4000 days"), "append"):
            got[r.source_id, r.minute] = got.get((r.source_id, r.minute), 0) + r.n
        assert got == batch


def test_link_refs_stream(spark):
    links = conform(derive(spark, SF, "link_observations"), SCHEMAS["link_observations"])
    # more than one reference per URL and run, and a third one that is seen twice
    links = links.union(links.withColumns({"ref_url": F.concat("ref_url", F.lit("x")), "ref_kind": F.lit("home")})).union(links.withColumn("seen_at", F.expr("seen_at + INTERVAL 5 MINUTES")))
    want = {r.url: [(x.u, x.k, x.t) for x in r.refs] for r in lk.latest_refs(lk.link_refs(links)).collect()}
    for parts in (2, 5):
        rows = run(lk.link_refs_stream(read_links(spark, shuffled(links, parts, links.limit(0)), streaming=True, max_files=1)), "update")
        got = {r.url: [(x.u, x.k, x.t.replace(tzinfo=None)) for x in r.refs] for r in rows}
        assert got == want
    all_ = lk.link_refs(links, None).selectExpr("max(size(refs))").first()[0]
    assert all_ >= max(len(x) for x in want.values())


def test_link_refs_and_state_merge(spark):
    links = derive(spark, SF, "link_observations")
    a, b = links.filter("minute(seen_at) < 30"), links.filter("minute(seen_at) >= 30")
    key = lambda df: sorted((r.run_id, r.url, str(r.refs)) for r in df.collect())
    # lists of six are never cut here, so merging in any order gives the batch result
    assert key(lk.merge_refs(lk.link_refs(a), b)) == key(lk.merge_refs(lk.link_refs(b), a)) == key(lk.link_refs(links))
    state = lambda df: sorted(map(tuple, df.select("article_url", "first_seen", "last_seen", "sightings", "link_resighted").collect()))
    assert state(lk.merge_link_state(lk.link_state(a), lk.link_state(b))) == state(lk.link_state(links))


def test_link_state_stream(spark):
    links = conform(derive(spark, SF, "link_observations"), SCHEMAS["link_observations"])
    stream = read_links(spark, files(links, F.xxhash64("article_url", "seen_at"), 3), streaming=True, max_files=1)
    rows = run(lk.link_state_stream(stream), "update")
    latest = {r.article_url: tuple(r) for r in rows}        # later updates replace earlier ones
    assert latest == {r.article_url: tuple(r) for r in lk.link_state(links).collect()}


def test_late_dates_do_not_matter(spark):
    a = derive(spark, SF, "articles").selectExpr("url", "published_at + (id % 11 - 5) * INTERVAL 1 HOUR AS at", "id % 3 > 0 AS precise")
    a = a.union(a.selectExpr("url", "at + INTERVAL 3 HOURS", "precise"))
    path = files(a, F.xxhash64("url", "at"), 3)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(path)
    latest = {r.url: tuple(r) for r in run(ch.date_bounds(stream), "update")}
    assert latest == {r.url: tuple(r) for r in ch.date_bounds(a).collect()}


def test_change_tracking_in_any_order_of_arrival(spark):
    v = derive(spark, SF, "versions").select("article_id", F.col("scanned_at").alias("captured_at"), F.when(F.col("article_id") % 2 == 0, F.col("title")).alias("title"), "body", F.col("role").alias("topic"),
                                             F.expr("CASE WHEN article_id % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END").alias("published_stored"),
                                             F.expr("CASE WHEN article_id % 3 = 0 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' + (seq % 4) * INTERVAL 1 HOUR END").alias("published_track"), (F.col("article_id") % 7 == 0).alias("is_live"))
    plain = lambda t: t if t is None else t.replace(tzinfo=None)
    key = lambda rows: sorted((r.article_id, plain(r.captured_at), r.change_kind, r.title_old, r.title_new, r.added, r.added_count, r.removed_count, r.word_delta, str([(c.old, c.new) for c in r.changes]), plain(r.pubdate_old),
                               plain(r.pubdate_new), str([tuple(m) for m in r.meta_edits]), r.revision_count, r.extension_count, r.edit_count, r.new_type) for r in rows)
    want = key(ch.track_changes(v).collect())
    end = v.limit(1).withColumns({"article_id": F.lit(-1).cast("bigint"), "captured_at": F.expr("TIMESTAMP_NTZ '2031-01-01 00:00:00'")})
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(shuffled(v, 4, end))
    got = key(run(track_changes_stream(stream, "2000 days"), "append"))
    assert want and str(got) == str(want) and any(r[10] for r in got) and {r[16] for r in got} >= {"liveblog", None}


def test_silent_articles_are_forgotten(spark):
    text = "Ein Absatz mit genug Zeichen, damit er als echter Text zählt, Nummer %d, und noch etwas mehr."
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = [(1, day(0), text % 1), (2, day(0), text % 1), (2, day(1), text % 2), (1, day(40), text % 3), (9, day(80), text % 1)]
    schema = "article_id bigint, captured_at timestamp_ntz, body string"
    path = NEW()
    for r in rows:
        spark.createDataFrame([(*r[:2], None, r[2])], "article_id bigint, captured_at timestamp_ntz, title string, body string").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("article_id bigint, captured_at timestamp_ntz, title string, body string").option("maxFilesPerTrigger", 1).parquet(path)
    month = 30 * 24 * 3600 * 1000
    kept = run(track_changes_stream(stream(), "1 hour", None), "append")
    gone = run(track_changes_stream(stream(), "1 hour", month), "append")
    # the first capture after a long silence is a first contact again
    assert sorted(r.article_id for r in kept) == [1, 2] and [r.article_id for r in gone] == [2]


def test_sync(spark):
    from pressdelta.sources.tables import corpus, flat_overview
    c = corpus(flat_overview(derive(spark, SF, "articles"), derive(spark, SF, "sources"))).persist()
    now = "2001-08-20 00:00:00"
    full = {tuple(r) for r in c.filter(sync.in_corpus_window(now, 400)).collect()}
    near = c.filter("last_seen < '2001-08-15'").withColumn("scan_count", F.lit(0).cast("bigint")).filter("last_seen >= '2001-08-01'")
    assert {tuple(r) for r in sync.sync_corpus(c.filter("last_seen < '2001-01-01'"), c, now, 400).collect()} == full
    far = sync.needs_reload(near, c).first()
    assert far.reload is True
    merged = sync.merge_corpus(near, c.filter("last_seen >= '2001-08-10'"), now, 400)
    assert merged.groupBy("id").count().filter("count > 1").count() == 0 and merged.filter("last_seen >= '2001-08-10' AND scan_count > 0").count() > 0


def test_file_sync_opens_only_newer_files(spark):
    from pressdelta.sources.tables import corpus, flat_overview
    c = corpus(flat_overview(derive(spark, SF, "articles"), derive(spark, SF, "sources"))).persist()
    now, rows = "2001-08-20 00:00:00", lambda d: sorted(map(repr, d.select(*c.columns).collect()))
    path = files(c, "last_seen", 8)
    source = sync.FileSync(spark, path)
    assert len(source.refresh()) == 8 and source.refresh() == []
    assert source.manifest.agg(F.sum("n")).first()[0] == c.count()
    for days in (0, 30, 400, 4000):
        assert source.size(now, days) == c.filter(sync.in_corpus_window(now, days)).count() and len(source.opened) < 8
    mark = c.agg(F.max("last_seen")).first()[0]
    near = c.filter(F.col("last_seen") < F.lit(mark - dt.timedelta(days=20)))
    newer = source.newer(near)
    edge = near.agg(F.max("last_seen")).first()[0] - dt.timedelta(minutes=2)
    assert rows(newer) == rows(c.filter(F.col("last_seen") >= F.lit(edge))) and 0 < len(source.opened) < 8
    for cached in (near, c.filter("last_seen < '2001-01-01'"), c.limit(0)):
        assert rows(source.sync(cached, now, 400)) == rows(sync.sync_corpus(cached, c, now, 400))
    # a later scan of known rows comes in a file of its own, an emptied file goes
    later = c.filter("id % 50 = 0").withColumn("last_seen", F.lit(mark) + F.expr("INTERVAL 1 HOUR"))
    state = c.join(later.select("id"), "id", "left_anti").select(*c.columns)
    again = sync.FileSync(spark, files(state, "last_seen", 4), source.manifest)
    later.coalesce(1).write.mode("append").parquet(again.path)
    spark.createDataFrame([], c.schema).coalesce(1).write.mode("append").parquet(again.path)
    assert len(again.refresh()) >= 5 and again.refresh() == []
    assert rows(again.newer(c)) == rows(later.union(state.filter(F.col("last_seen") >= F.lit(mark - dt.timedelta(minutes=2)))))
    assert len(again.opened) <= 2
    assert rows(again.sync(c, now, 400)) == rows(sync.sync_corpus(c, later.unionByName(state), now, 400))
