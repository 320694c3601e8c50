"""One article against its source, its history, its links; story clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta import constants as K
from pressdelta.functions.numbers import half_up, ratio, unit_scale
from pressdelta.functions.timeutil import duration_label, effective_published, seconds_between
from pressdelta.operators.filters import online_cuts
from pressdelta.plans.patterns import first_rows, group_quantiles
from pressdelta.sources.tables import Tables


def peers(t: Tables) -> DataFrame:
    """Article pages with the facts that are compared inside a source."""
    p = t.pages.filter(F.col("kind") == "article").select(F.col("url").alias("p_url"), F.col("source_id").alias("p_source"), F.col("last_seen").alias("link_seen"), F.col("depth").alias("p_depth"))
    a = t.articles.select("id", "url", "source_id", "word_count", F.coalesce("revision_count", F.lit(0)).alias("rev"), F.coalesce("extension_count", F.lit(0)).alias("ext"),
                          F.coalesce("edit_count", F.lit(0)).alias("edit"), "published_at", "modified_at", "first_seen")
    return p.join(a, F.col("p_url") == F.col("url")).select(F.col("p_source").alias("source_id"), F.col("p_depth").alias("depth"), "link_seen", *[c for c in a.columns if c != "source_id"])


# metric -> (value, condition, histogram step).  Steps only set how the two passes of the median split the values.
def _metrics() -> dict[str, tuple[Column, Column, float]]:
    c = F.col
    lag, vis = seconds_between(c("published_at"), c("modified_at")) / 3600, seconds_between(c("first_seen"), c("link_seen")) / 86400
    return {
        "wc": (c("word_count").cast("double"), c("word_count").isNotNull(), 64.0),
        "rev": (c("rev").cast("double"), F.lit(True), 16.0),
        "rev_edited": (c("rev").cast("double"), c("rev") >= 1, 16.0),
        "lag_h": (lag, c("modified_at") > c("published_at"), 4.0),
        "vis_d": (vis, c("link_seen") > c("first_seen"), 0.25),
        "ext_share": (c("ext") / F.nullif((c("ext") + c("edit")).cast("double"), F.lit(0.0)), (c("ext") + c("edit")) > 0, 0.01),
        "depth": (c("depth").cast("double"), c("depth").isNotNull(), 1.0),
    }


def source_medians(t: Tables) -> DataFrame:
    """Exact medians per source: (source_id, wc, rev, rev_edited, lag_h, vis_d, ext_share, depth and their counts)."""
    m = _metrics()
    # values are scaled by their step so that one histogram width fits all metrics
    long = peers(t).select("source_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.when(cond, v / step).alias("v")) for k, (v, cond, step) in m.items()])).alias("x")).select("source_id", "x.*")
    q = group_quantiles(long, ["source_id", "metric"], "v", 1.0)
    step = None
    for k, (_, _, s) in m.items():
        step = F.when(F.col("metric") == k, s) if step is None else step.when(F.col("metric") == k, s)
    return q.groupBy("source_id").pivot("metric", list(m)).agg(F.first(F.col("quantile") * step).alias("med"), F.first("n").alias("n"))


def _below(rows: DataFrame, asked: DataFrame, value: str, out: str) -> DataFrame:
    """Peers of the source with a smaller value, for each asked (source, value): running sums over the value
    histogram, so that no article is compared with every other."""
    hist = rows.filter(F.col(value).isNotNull()).groupBy("source_id", value).agg(F.count("*").alias("__c"), F.lit(0).alias("__ask"))
    want = asked.select("source_id", value).filter(F.col(value).isNotNull()).distinct().select("source_id", value, F.lit(0).cast("bigint").alias("__c"), F.lit(1).alias("__ask"))
    per = hist.unionByName(want).groupBy("source_id", value).agg(F.sum("__c").alias("__c"), F.max("__ask").alias("__ask"))
    run = W.partitionBy("source_id").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn(f"{out}_below", F.coalesce(F.sum("__c").over(run), F.lit(0))).filter(F.col("__ask") == 1).select("source_id", value, f"{out}_below")


def article_context(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Where an article stands in its source: share of shorter and of less revised articles (at most 99), counts,
    medians, share of revised articles from 8 articles on, and the six medians of the radar shadow."""
    src = peers(t)
    med = source_medians(t)
    totals = src.groupBy("source_id").agg(F.count("*").alias("peers"), F.count_if(F.col("rev") >= 1).alias("edited"), F.count("word_count").alias("with_words"))
    a = t.articles.select("id", "source_id", "word_count", F.coalesce("revision_count", F.lit(0)).alias("rev"))
    if ids is not None:
        a = a.join(ids.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    pos_len, pos_rev = _below(src, a, "word_count", "len"), _below(src.filter(F.col("rev") >= 1), a, "rev", "edit")
    j = a.join(totals, "source_id").join(med, "source_id").join(pos_len, ["source_id", "word_count"], "left").join(pos_rev, ["source_id", "rev"], "left")
    share = lambda below, n: F.least(F.lit(99), F.coalesce(F.round(F.lit(100.0) * F.coalesce(F.col(below), F.lit(0)) / F.greatest(F.col(n), F.lit(1))), F.lit(0.0))).cast("bigint")
    return j.select(
        "id", "source_id", share("len_below", "with_words").alias("len_pct"), F.col("with_words").alias("len_n"), F.bround("wc_med").cast("bigint").alias("len_med"),
        share("edit_below", "edited").alias("edit_pct"), F.col("edited").alias("edit_n"), F.bround("rev_edited_med").cast("bigint").alias("edit_med"),
        F.when(F.col("peers") >= 8, F.round(F.col("edited") / F.col("peers").cast("double"), 4)).alias("edited_share"),
        F.col("wc_med").alias("peer_wc"), F.col("rev_med").alias("peer_rev"), F.col("lag_h_med").alias("peer_lag_h"), F.col("vis_d_med").alias("peer_vis_d"),
        F.col("ext_share_med").alias("peer_ext_share"), F.col("depth_med").alias("peer_depth"))


def radar(t: Tables) -> DataFrame:
    """Six axes 0..1 of each article and of its source's medians: (id, axis, value, peer)."""
    c = F.col
    a = t.articles.join(t.pages.select(F.col("url").alias("p_url"), F.col("last_seen").alias("p_link"), F.col("depth").alias("p_depth")), F.col("url") == F.col("p_url"), "left")
    ext, edit = F.coalesce(c("extension_count"), F.lit(0)), F.coalesce(c("edit_count"), F.lit(0))
    lag = F.when(c("modified_at") > c("published_at"), seconds_between(c("published_at"), c("modified_at")) / 3600).otherwise(0.0)
    vis = F.coalesce(F.greatest(F.lit(0.0), seconds_between(c("first_seen"), c("p_link")) / 86400), F.lit(0.0))
    depth = lambda d: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (d - 1) / 4.0)), F.lit(0.0))
    j = a.join(source_medians(t), "source_id", "left")
    peer = lambda e: F.when(c("wc_med").isNotNull(), e)
    z = lambda name: F.coalesce(c(name), F.lit(0.0))
    axes = [
        ("length", unit_scale(F.coalesce(c("word_count"), F.lit(0)), 2000), unit_scale(z("wc_med"), 2000)),
        ("edits", unit_scale(F.coalesce(c("revision_count"), F.lit(0)), 6), unit_scale(z("rev_med"), 6)),
        ("lag", unit_scale(lag, 168), unit_scale(z("lag_h_med"), 168)),
        ("visible", unit_scale(vis, 14), unit_scale(z("vis_d_med"), 14)),
        ("growth", F.when(ext + edit > 0, ext / (ext + edit).cast("double")).otherwise(0.0), z("ext_share_med")),
        ("prominence", depth(c("p_depth")), depth(c("depth_med"))),
    ]
    items = F.array(*[F.struct(F.lit(n).alias("axis"), v.cast("double").alias("value"), peer(r).cast("double").alias("peer")) for n, v, r in axes])
    return j.select("id", F.explode(items).alias("x")).select("id", "x.*")


def behaviour_profile(t: Tables) -> DataFrame:
    """Facts of an article's history: delays after publication, change rate, net words, median scan gap, and one
    remark.  Snapshot facts are aggregated per article; scan gaps come from the article's own list of scans."""
    c = F.col
    s = t.snapshots
    shift = real_date_shift(c("pubdate_old"), c("pubdate_new")) if "pubdate_old" in s.columns else F.lit(False)
    snap = s.groupBy("article_id").agg(F.min("captured_at").alias("first_change"), F.max("captured_at").alias("last_change"), F.sum("word_delta").alias("net_words"), F.max(shift.cast("int")).alias("shifted"))
    a = t.articles.join(snap, t.articles["id"] == snap["article_id"], "left")
    pub = effective_published(c("published_at"), c("first_seen"))
    after = lambda x: F.when(seconds_between(pub, x) > 0, seconds_between(pub, x))
    scans, revs = F.coalesce(c("scan_count"), F.lit(0)), F.coalesce(c("revision_count"), F.lit(0))
    ext, edit = F.coalesce(c("extension_count"), F.lit(0)), F.coalesce(c("edit_count"), F.lit(0))
    times = F.array_sort(c("scan_times")) if "scan_times" in t.articles.columns else F.lit(None).cast("array<timestamp_ntz>")
    gaps = F.array_sort(F.zip_with(F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), lambda y, x: seconds_between(x, y)))
    gap = F.when(F.size(times) >= 3, F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")))
    last = after(c("last_change"))
    remark = (F.when(c("shifted") == 1, "date_shifted").when((edit > 0) & (ext == 0), "silent_edits_only").when(ext >= 2, "growing")
              .when((revs > 0) & (last > 86400), "late_edit").when((revs == 0) & (scans >= 4), "stable"))
    delay = seconds_between(pub, c("first_seen"))
    return a.select(
        "id", F.when(delay > 60, delay).alias("capture_delay_s"), after(c("first_change")).alias("first_change_s"), last.alias("last_change_s"),
        F.when(scans > 1, half_up(revs / scans.cast("double") * 100)).alias("change_pct"), F.when(c("net_words") != 0, c("net_words")).alias("net_words"), gap.alias("scan_gap_s"), remark.alias("remark"))


def profile_labels(profile: DataFrame) -> DataFrame:
    cols = ("capture_delay_s", "first_change_s", "last_change_s", "scan_gap_s")
    return profile.withColumns({c[:-2]: F.when(F.col(c).isNotNull(), duration_label(F.col(c))) for c in cols})


def real_date_shift(old: Column, new: Column) -> Column:
    """A believable re-dating: forward, by at most 30 days."""
    d = seconds_between(old, new)
    return F.coalesce((d > 0) & (d <= 30 * 86400), F.lit(False))


def scan_points(t: Tables, gone: DataFrame | None = None) -> DataFrame:
    """Scans of an article on a 0..100 line: (article_id, t, position, change, span_days, gone_position).

    Without a list of scans the first and the last one stand for it.  A scan is a change when a snapshot falls into
    its minute.  `gone` (article_id, gone_at) stretches the line."""
    c = F.col
    a = t.articles
    times = F.filter(F.coalesce(F.when(F.size(c("scan_times")) > 0, c("scan_times")), F.array("first_seen", "last_seen")), lambda x: x.isNotNull()) if "scan_times" in a.columns else F.filter(F.array("first_seen", "last_seen"), lambda x: x.isNotNull())
    rows = a.select(c("id").alias("article_id"), "first_seen", "last_seen", times.alias("times"))
    rows = rows.join(gone, "article_id", "left") if gone is not None else rows.withColumn("gone_at", F.lit(None).cast("timestamp_ntz"))
    rows = rows.withColumn("t0", F.least("first_seen", F.array_min("times"))).withColumn("t1", F.greatest("last_seen", F.array_max("times"), "gone_at"))
    minute = lambda x: half_up(F.unix_micros(x.cast("timestamp")) / F.lit(6e7))
    changes = t.snapshots.select("article_id", minute(c("captured_at")).alias("minute")).distinct().withColumn("hit", F.lit(True))
    pts = rows.withColumn("t", F.explode("times")).withColumn("minute", minute(c("t"))).join(changes, ["article_id", "minute"], "left")
    span = F.greatest(F.lit(0.001), seconds_between(c("t0"), c("t1")))
    return pts.select("article_id", "t", (seconds_between(c("t0"), c("t")) / span * 100).alias("position"), F.coalesce("hit", F.lit(False)).alias("change"),
                      half_up(seconds_between(c("t0"), c("t1")) / 86400).alias("span_days"), (seconds_between(c("t0"), c("gone_at")) / span * 100).alias("gone_position"))


def link_status(overview: DataFrame, linked_from: DataFrame | None = None) -> DataFrame:
    """Link state per article: a reference from the last crawl proves 'online'; else time decides, measured against
    the source's cut; silence without an earlier re-sighting stays 'unknown'."""
    c = F.col
    allowed = overview.filter(c("ptype").isin(*K.ALLOWED_PTYPES))
    rows = overview.filter(c("article_id").isNotNull()).join(online_cuts(allowed), "source_id", "left")
    if linked_from is not None:
        proof = linked_from.filter(F.size("refs") > 0).select("url", F.lit(True).alias("proof"), F.col("refs")[0]["t"].alias("ref_t"))
        rows = rows.join(proof, "url", "left")
    else:
        rows = rows.withColumns({"proof": F.lit(False), "ref_t": F.lit(None).cast("timestamp_ntz")})
    proof = F.coalesce(c("proof"), F.lit(False))
    timed = c("link_seen").isNotNull() & c("link_cut").isNotNull()
    state = F.when(proof, "online").when(~timed, None).when(c("link_seen") >= c("link_cut"), "online").when(c("link_resighted"), "gone").otherwise("unknown")
    return rows.select("article_id", state.alias("state"), F.when(proof | timed, F.coalesce("link_seen", "ref_t")).alias("since"), F.when(proof, "evidence").when(timed, "time").alias("grounds"))


def article_record(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """The full record: article facts, authors, keywords and categories as lists, snapshots in order with their
    version number.  Lists hold all of an article's own values: as many as it has authors, keywords, categories and retained snapshots."""
    def names(dim: str, junction: str, key: str, col: str) -> DataFrame:
        j = getattr(t, junction)
        j = j if ids is None else j.join(ids.select("article_id").distinct(), "article_id", "left_semi")
        d = getattr(t, dim).select(F.col("id").alias(key), F.col(col).alias("v"))
        return j.join(d, key).groupBy("article_id").agg(F.array_sort(F.collect_set("v")).alias(dim))
    a = t.articles.withColumnRenamed("id", "article_id")
    s = t.snapshots
    if ids is not None:
        a, s = (d.join(ids.select("article_id").distinct(), "article_id", "left_semi") for d in (a, s))
    versions = s.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("captured_at", "id", "change_kind", "word_delta"))).alias("snapshots"))
    versions = versions.withColumn("snapshots", F.transform("snapshots", lambda x, i: F.struct((i + 2).alias("version"), x["captured_at"].alias("captured_at"), x["change_kind"].alias("change_kind"), x["word_delta"].alias("word_delta"))))
    for d in (names("authors", "article_authors", "author_id", "name"), names("keywords", "article_keywords", "keyword_id", "term"), names("categories", "article_categories", "category_id", "name"), versions):
        a = a.join(d, "article_id", "left")
    return a


def cluster_members(t: Tables) -> DataFrame:
    a = t.articles.select(F.col("id").alias("article_id"), "source_id", F.coalesce("published_at", "first_seen").alias("t"))
    s = t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("outlet"), "country")
    return t.article_clusters.join(a, "article_id").join(s, "source_id")


def cluster_overview(t: Tables, limit: int | None = None) -> DataFrame:
    """Clusters of more than one article: size, distinct outlets and their names."""
    per = cluster_members(t).groupBy("cluster_id", "outlet").agg(F.count("*").alias("n"))
    c = per.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.count("*").alias("outlets"), F.array_sort(F.collect_list("outlet")).alias("outlet_names"))
    c = c.filter(F.col("size") > 1).orderBy(F.desc("outlets"), F.desc("size"), "cluster_id")
    return first_rows(c, limit)


def cluster_echoes(t: Tables) -> DataFrame:
    """Members of each cluster with their distance from the earliest one."""
    m = cluster_members(t)
    origin = m.groupBy("cluster_id").agg(F.min(F.struct("t", "article_id")).alias("o"))
    j = m.join(origin, "cluster_id")
    return j.select("cluster_id", "article_id", "outlet", "country", half_up(F.col("similarity") * 100).alias("similarity_pct"), (F.col("article_id") == F.col("o.article_id")).alias("is_origin"),
                    half_up(seconds_between(F.col("o.t"), F.col("t")) / 60).alias("offset_minutes"))
