"""The table bundle, schemas, and the views every dashboard query starts from."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pressdelta import constants as K
from pressdelta.functions.timeutil import as_ts, seconds_between
from pressdelta.session import pin_session

NTZ = T.TimestampNTZType()
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


SCHEMAS = {
    "sources": _schema(id=_L, name=_S, country=_S, base_url=_S, language=_S, feed_url=_S, active=_B),
    "pages": _schema(id=_L, source_id=_L, url=_S, kind=_S, depth=_L, first_seen=NTZ, last_seen=NTZ),
    "articles": _schema(
        id=_L, source_id=_L, url=_S, title=_S, description=_S, og_image=_S, published_at=NTZ, modified_at=NTZ, paywalled=_B,
        article_type=_S, word_count=_L, reading_min=_L, lang_detected=_S, author_status=_S, topic=_S, rubric=_S, first_seen=NTZ,
        last_seen=NTZ, scan_count=_L, scan_times=T.ArrayType(NTZ), is_article=_B, content_hash=_S, para_fps=T.ArrayType(_S),
        body_words=_L, revision_count=_L, extension_count=_L, edit_count=_L, recent_hashes=T.ArrayType(_S), recent_flips=T.ArrayType(_S),
        linked_from=T.ArrayType(_schema(u=_S, k=_S, t=NTZ))),
    "snapshots": _schema(
        id=_L, article_id=_L, captured_at=NTZ, change_kind=_S, title_old=_S, title_new=_S, added=_S, added_count=_L, removed_count=_L,
        word_delta=_L, changes=T.ArrayType(_schema(old=_S, new=_S)), pubdate_old=NTZ, pubdate_new=NTZ,
        meta_edits=T.ArrayType(_schema(field=_S, old=_S, new=_S))),
    "article_paras": _schema(article_id=_L, paras=T.ArrayType(_S)),
    "keywords": _schema(id=_L, term=_S),
    "article_keywords": _schema(article_id=_L, keyword_id=_L),
    "categories": _schema(id=_L, name=_S),
    "article_categories": _schema(article_id=_L, category_id=_L),
    "authors": _schema(id=_L, name=_S),
    "article_authors": _schema(article_id=_L, author_id=_L),
    "sightings": _schema(id=_L, source_id=_L, minute=NTZ, n=_L),
    "versions": _schema(id=_L, article_id=_L, scanned_at=NTZ, title=_S, body=_S, embedding=T.ArrayType(T.FloatType())),
    "captures": _schema(capture_id=_L, run_id=NTZ, source_id=_L, url=_S, captured_at=NTZ, http_status=_L, html=_S, raw_html=_S),
    "link_observations": _schema(run_id=NTZ, source_id=_L, article_url=_S, ref_url=_S, ref_kind=_S, seen_at=NTZ, sitemap_pub=NTZ, precise=_B),
    "article_clusters": _schema(cluster_id=_L, article_id=_L, similarity=T.DoubleType()),
}


@dataclass(frozen=True)
class Tables:
    """The tables of one observatory.  Jobs read only the ones they need."""

    sources: DataFrame | None = None
    pages: DataFrame | None = None
    articles: DataFrame | None = None
    snapshots: DataFrame | None = None
    article_paras: DataFrame | None = None
    keywords: DataFrame | None = None
    article_keywords: DataFrame | None = None
    categories: DataFrame | None = None
    article_categories: DataFrame | None = None
    authors: DataFrame | None = None
    article_authors: DataFrame | None = None
    sightings: DataFrame | None = None
    versions: DataFrame | None = None
    captures: DataFrame | None = None
    link_observations: DataFrame | None = None
    article_clusters: DataFrame | None = None

    def with_(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def names(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in order: cast when present, typed NULL when missing; others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_tables(spark: SparkSession, directory: str, *names: str) -> Tables:
    """Parquet tables of a folder, conformed.  Column pruning reaches the scan: unused columns are never read."""
    pin_session(spark)
    return Tables(**{n: conform(spark.read.parquet(f"{directory}/{n}"), SCHEMAS[n]) for n in (names or SCHEMAS)})


def scan(df: DataFrame, *columns: str) -> DataFrame:
    """Whole-table read of the named columns.  Order only by a unique key when pages of it are cut later."""
    return df.select(*columns) if columns else df


def page_type(kind: Column, article_type: Column, paywalled: Column) -> Column:
    """Shown page type: what an article page became; other kinds keep their kind."""
    return (F.when(kind != "article", kind).when(article_type == "liveblog", "blog").when(article_type == "timeline", "timeline")
            .when(paywalled, "paywall").otherwise("artikel"))


def resighted(first: Column, last: Column) -> Column:
    """Was the link seen again more than two hours after its discovery?"""
    return F.coalesce(seconds_between(first, last) > K.RESIGHT_HOURS * 3600, F.lit(False))


CORPUS_COLUMNS = (
    "id", "article_id", "source_id", "url", "ptype", "topic", "author_status", "paywalled", "language", "published_at", "discovered_at",
    "last_seen", "link_seen", "link_resighted", "word_count", "revision_count", "edit_count", "scan_count", "rubric",
)


def page_overview(t: Tables) -> DataFrame:
    """One row per page with its article (matched by URL) and its source."""
    p = t.pages.select(F.col("id"), "source_id", "url", "kind", F.col("first_seen").alias("link_first"), F.col("last_seen").alias("link_seen"), "depth")
    a = t.articles.select(
        F.col("id").alias("article_id"), F.col("url").alias("a_url"), "title", "topic", "author_status", "paywalled", "published_at", "article_type",
        F.col("first_seen").alias("discovered_at"), "last_seen", "word_count", "revision_count", "edit_count", "extension_count", "scan_count", "rubric")
    s = t.sources.select(F.col("id").alias("s_id"), F.col("name").alias("outlet"), "country", "language")
    joined = p.join(a, p["url"] == a["a_url"], "left").join(s, p["source_id"] == s["s_id"])
    return joined.select(
        "id", "article_id", "source_id", "url", page_type(F.col("kind"), F.col("article_type"), F.col("paywalled")).alias("ptype"), "topic", "author_status",
        "paywalled", "language", "published_at", "discovered_at", "last_seen", "link_seen", resighted(F.col("link_first"), F.col("link_seen")).alias("link_resighted"),
        "word_count", "revision_count", "edit_count", "extension_count", "scan_count", "rubric", "depth", "title", "outlet", "country", F.col("title").isNotNull().alias("analyzed"))


def flat_overview(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """The same rows when the page columns (kind, depth, link_seen) already lie in the article table: no URL join."""
    s = sources.select(F.col("id").alias("s_id"), F.col("name").alias("outlet"), "country", "language")
    a = articles.join(s, articles["source_id"] == s["s_id"])
    return a.select(
        "id", F.col("id").alias("article_id"), "source_id", "url", page_type(F.col("kind"), F.col("article_type"), F.col("paywalled")).alias("ptype"), "topic",
        "author_status", "paywalled", "language", "published_at", F.col("first_seen").alias("discovered_at"), "last_seen", "link_seen",
        resighted(F.col("first_seen"), F.col("link_seen")).alias("link_resighted"), "word_count", "revision_count", "edit_count", "extension_count", "scan_count",
        "rubric", "depth", "title", "outlet", "country", F.col("title").isNotNull().alias("analyzed"))


def in_corpus_window(now, days: int = K.CORPUS_DAYS) -> Column:
    """Published (or, undated, discovered) or scanned within the window."""
    floor = as_ts(now) - F.expr(f"INTERVAL {days} DAYS")
    return (F.col("published_at") >= floor) | (F.col("published_at").isNull() & (F.col("discovered_at") >= floor)) | (F.col("last_seen") >= floor)


def corpus(overview: DataFrame, now=None, days: int = K.CORPUS_DAYS) -> DataFrame:
    """The rows all charts count: journalistic pages, inside the window when an as-of time is given, one row per id."""
    rows = overview.filter(F.col("ptype").isin(*K.ALLOWED_PTYPES))
    if now is not None:
        rows = rows.filter(in_corpus_window(now, days))
    return rows.select(*CORPUS_COLUMNS).dropDuplicates(["id"])
