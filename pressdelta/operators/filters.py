"""Filters: one predicate for tables and charts, the server-side variant, search, and row restrictions.

Every function returns a Column or a plain filter, so that the conditions reach the scan.  A criterion that is not
set adds nothing to the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from pressdelta import constants as K
from pressdelta.functions.text import contains_ci
from pressdelta.functions.timeutil import as_ts, axis_time, effective_published, seconds_between
from pressdelta.functions.numbers import half_up
from pressdelta.plans.patterns import small, top_per_group
from pressdelta.sources.tables import Tables


@dataclass(frozen=True)
class FilterParams:
    """The filter state of a dashboard.  None (or an empty tuple) means: not set."""

    sources: tuple[int, ...] = ()
    status: str | None = None            # new | rescanned
    paywall: str | None = None           # yes | no
    ptype: str | None = None             # artikel | paywall | timeline
    author: str | None = None            # named | anonymous | none
    topics: tuple[str, ...] = ()
    lang: str | None = None
    changed: str | None = None           # yes | no
    depth: str | None = None             # kurz | mittel | lang
    range_from: object | None = None
    range_to: object | None = None
    axis: str = "published"              # published | seen
    hide_regional: bool = False
    link_state: str | None = None        # online | gone
    rubrics: tuple[str, ...] = ()

    def with_(self, **changes) -> "FilterParams":
        return replace(self, **changes)


def depth_class(words: Column, depth: str) -> Column:
    """Article length classes: kurz 1-299, mittel 300-900, lang above."""
    return {"kurz": (words > 0) & (words < 300), "mittel": (words >= 300) & (words <= 900), "lang": words > 900}[depth]


def rubric_match(patterns: tuple[str, ...]) -> Column:
    """Does the URL or the rubric contain /pattern/ for any of the patterns?"""
    text = F.lower(F.concat(F.col("url"), F.lit(" "), F.coalesce(F.col("rubric"), F.lit(""))))
    return reduce(or_, [text.contains(f"/{p.lower()}/") for p in patterns])


def corpus_predicate(p: FilterParams, skip_time: bool = False, skip_topics: bool = False) -> Column:
    """The predicate of the corpus.  NULLs count on purpose: unknown scan counts match no status, unknown paywalls
    neither yes nor no, a missing topic survives the regional toggle, a missing revision count is unchanged.
    The link state needs a `link_cut` column (see `with_link_cut`)."""
    c = F.col
    parts = [c("ptype").isin(*K.ALLOWED_PTYPES)]
    if p.sources:
        parts.append(c("source_id").isin(*p.sources))
    if p.hide_regional:
        parts.append(F.coalesce(c("topic"), F.lit("")) != "regional")
    if p.status:
        parts.append({"new": c("scan_count") <= 1, "rescanned": c("scan_count") >= 2}[p.status])
    if p.paywall:
        parts.append(c("paywalled") == F.lit(p.paywall == "yes"))
    if p.ptype:
        parts.append(c("ptype").isin(*K.TIMELINE_PTYPES) if p.ptype == "timeline" else c("ptype") == p.ptype)
    if p.author:
        parts.append(c("author_status") == p.author)
    if p.topics and not skip_topics:
        parts.append(c("topic").isin(*p.topics))
    if p.lang:
        parts.append(c("language") == p.lang)
    if p.changed:
        parts.append(c("revision_count") >= 1 if p.changed == "yes" else c("revision_count").isNull() | (c("revision_count") == 0))
    if p.depth:
        parts.append(depth_class(c("word_count"), p.depth))
    if p.link_state == "gone":
        parts.append((c("link_seen") < c("link_cut")) & c("link_resighted"))
    elif p.link_state == "online":
        parts.append(c("link_seen") >= c("link_cut"))
    if not skip_time:
        if p.range_from is not None:
            parts.append(axis_time(p.axis) >= as_ts(p.range_from))
        if p.range_to is not None:
            parts.append(axis_time(p.axis) <= as_ts(p.range_to))
    if p.rubrics and not skip_topics:
        parts.append(rubric_match(p.rubrics))
    return reduce(and_, parts)


def tolerance_hours(source: Column) -> Column:
    """Hours of silence after which an article of the source counts as gone."""
    known = reduce(lambda acc, kv: acc.when(source == kv[0], kv[1]), list(K.ONLINE_TOLERANCE_H.items())[1:],
                   F.when(source == next(iter(K.ONLINE_TOLERANCE_H)), next(iter(K.ONLINE_TOLERANCE_H.values()))))
    return known.otherwise(K.ONLINE_TOLERANCE_DEFAULT_H)


def online_cuts(corpus: DataFrame) -> DataFrame:
    """Per source: newest link sighting minus the tolerance of the source.  Silence is measured against the source's
    own rhythm, never against the clock or another source."""
    newest = corpus.filter(F.col("link_seen").isNotNull()).groupBy("source_id").agg(F.max("link_seen").alias("newest"))
    return newest.select("source_id", (F.col("newest") - tolerance_hours(F.col("source_id")) * F.expr("INTERVAL 1 HOUR")).alias("link_cut"))


def with_link_cut(corpus: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Corpus with the cut of its source; sources without a sighting have none."""
    return corpus.join(online_cuts(corpus) if cuts is None else cuts, "source_id", "left")


def filter_corpus(corpus: DataFrame, p: FilterParams, ids: DataFrame | None = None, skip_time: bool = False, skip_topics: bool = False) -> DataFrame:
    """Apply the predicate, and the article ids of a keyword or search restriction."""
    rows = with_link_cut(corpus) if p.link_state in ("gone", "online") and "link_cut" not in corpus.columns else corpus
    rows = rows.filter(corpus_predicate(p, skip_time, skip_topics))
    return rows if ids is None else rows.join(ids.select(F.col("article_id")).distinct(), "article_id", "left_semi")


def article_predicate(p: FilterParams) -> Column:
    """The variant of the keyword functions, on the article table: articles only, a missing scan count counts as one
    scan and a missing revision count as unchanged."""
    c, parts = F.col, [F.col("is_article")]
    scans, revisions = F.coalesce(c("scan_count"), F.lit(1)), F.coalesce(c("revision_count"), F.lit(0))
    if p.sources:
        parts.append(c("source_id").isin(*p.sources))
    if p.topics:
        parts.append(c("topic").isin(*p.topics))
    if p.paywall:
        parts.append(c("paywalled") if p.paywall == "yes" else ~c("paywalled"))
    if p.author:
        parts.append(c("author_status") == p.author)
    if p.status:
        parts.append({"new": scans <= 1, "rescanned": scans >= 2}[p.status])
    if p.changed:
        parts.append({"yes": revisions >= 1, "no": revisions == 0}[p.changed])
    if p.depth:
        parts.append(depth_class(c("word_count"), p.depth))
    return reduce(and_, parts)


def select_articles(t: Tables, p: FilterParams) -> DataFrame:
    """Articles under the article predicate; the source table is only read when a language is asked for."""
    rows = t.articles.filter(article_predicate(p))
    if p.lang:
        speaking = t.sources.filter(F.col("language") == p.lang).select(F.col("id").alias("source_id"))
        rows = rows.join(small(speaking), "source_id", "left_semi")
    return rows


def search_articles(t: Tables, q: str, sources: tuple[int, ...] = (), limit: int | None = None) -> DataFrame:
    """Articles whose title, URL, description, topic, keywords or categories contain the text, ignoring case.

    The dimension tables are searched once and their hits reduced to article ids; the article table is scanned once.
    """
    if len(q) < 2:
        return t.articles.filter(F.lit(False)).select(F.col("id").alias("article_id"))
    rows = t.articles.filter(F.col("is_article"))
    if sources:
        rows = rows.filter(F.col("source_id").isin(*sources))
    own = reduce(or_, [F.coalesce(contains_ci(F.col(c), q), F.lit(False)) for c in ("title", "url", "description", "topic")])
    links = []
    for dim, junction, key, name in (("keywords", "article_keywords", "keyword_id", "term"), ("categories", "article_categories", "category_id", "name")):
        if getattr(t, dim) is not None:
            hits = getattr(t, dim).filter(contains_ci(F.col(name), q)).select(F.col("id").alias(key))
            links.append(getattr(t, junction).join(hits, key, "left_semi").select("article_id"))
    if links:
        # `IN` of an uncorrelated query keeps the OR with the own columns and still plans as one existence join
        linked = reduce(DataFrame.union, links).distinct().withColumn("linked", F.lit(True))
        found = rows.join(linked, rows["id"] == linked["article_id"], "left").filter(own | F.coalesce(F.col("linked"), F.lit(False)))
    else:
        found = rows.filter(own)
    ids = found.select(F.col("id").alias("article_id"))
    return ids.orderBy("article_id").limit(limit) if limit else ids


def search_many(t: Tables, terms: tuple[str, ...], sources: tuple[int, ...] = (), limit: int | None = None) -> DataFrame:
    """Hits per term: (term, article_id).  The set of a combined search is the distinct article_id of it.  Each table is scanned once, whatever the
    number of terms; `operators.search` does the same with an index."""
    asked = F.array(*[F.lit(q) for q in dict.fromkeys(terms) if len(q) >= 2]).cast("array<string>")
    within = lambda texts: F.explode(F.filter(asked, lambda q: F.exists(texts, lambda x: F.coalesce(F.ilike(x, F.concat(F.lit("%"), q, F.lit("%"))), F.lit(False))))).alias("term")
    rows = t.articles.filter(F.col("is_article"))
    if sources:
        rows = rows.filter(F.col("source_id").isin(*sources))
    lists = [rows.select(within(F.array("title", "url", "description", "topic")), F.col("id").alias("article_id"))]
    for dim, junction, key, name in (("keywords", "article_keywords", "keyword_id", "term"), ("categories", "article_categories", "category_id", "name")):
        if getattr(t, dim) is not None:
            hits = getattr(t, dim).select(within(F.array(name)), F.col("id").alias(key))
            lists.append(getattr(t, junction).join(hits, key).select("term", "article_id"))
    linked = reduce(DataFrame.union, lists).distinct()
    found = linked.join(rows.select(F.col("id").alias("article_id")), "article_id", "left_semi").select("term", "article_id")
    return found if limit is None else top_per_group(found, ["term"], [F.asc("article_id")], limit, spread=["article_id"]).select("term", "article_id")


def keyword_ids(t: Tables, term: str) -> DataFrame:
    """Articles that carry a keyword."""
    key = t.keywords.filter(F.col("term") == term).select(F.col("id").alias("keyword_id"))
    return t.article_keywords.join(small(key), "keyword_id", "left_semi").select("article_id")


def restrict_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of a that are in b too."""
    return a.join(b.select("article_id").distinct(), "article_id", "left_semi")


def pin(rows: DataFrame, start, end, source: int | None = None, topic: str | None = None, axis: str = "published", first_n: int | None = None) -> DataFrame:
    """Rows of an exact window, optionally one source or topic, optionally only the first n by publication."""
    t = axis_time(axis)
    rows = rows.filter((t >= as_ts(start)) & (t <= as_ts(end)))
    if source is not None:
        rows = rows.filter(F.col("source_id") == source)
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    return rows.orderBy(F.col("published_at").asc_nulls_last(), "id").limit(first_n) if first_n else rows


def contains_filter(rows: DataFrame, column: str, q: str) -> DataFrame:
    """Substring filter on the text form of a column, ignoring case."""
    return rows.filter(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))).contains(q.lower()))


def first_scan() -> Column:
    """With at most one scan the only real scan time is the last one."""
    return F.when(F.coalesce(F.col("scan_count"), F.lit(1)) <= 1, F.coalesce(F.col("last_seen"), F.col("discovered_at"))).otherwise(F.col("discovered_at"))


def scan_span(rows: DataFrame) -> DataFrame:
    """Adds first_scan and the observed days, rounded."""
    rows = rows.withColumn("first_scan", first_scan())
    return rows.withColumn("observed_days", F.coalesce(half_up(seconds_between(F.col("first_scan"), F.col("last_seen")) / 86400), F.lit(0).cast("bigint")))


def with_effective_published(rows: DataFrame, published: str = "published_at", first: str = "discovered_at") -> DataFrame:
    return rows.withColumn("published_eff", effective_published(F.col(published), F.col(first)))
