"""Inputs that lie in files or streams: captures, feeds, sitemaps, links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pressdelta.functions.text import let
from pressdelta.functions.timeutil import parse_ts
from pressdelta.operators.url_jobs import canonical_url, origin, strip_hash, url_kind, url_path
from pressdelta.plans.patterns import top_per_group
from pressdelta.sources.tables import SCHEMAS

Q = "[\"']"


def read_captures(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Captured pages as a table or as a stream of files."""
    reader = (spark.readStream if streaming else spark.read).schema(SCHEMAS["captures"]).format(fmt)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_links(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Link observations as a table or as a stream of files."""
    reader = (spark.readStream if streaming else spark.read).schema(SCHEMAS["link_observations"]).format(fmt)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute http(s) URL of a link on a page; NULL for other schemes.  Steps (. and ..) are followed, never above the root."""
    h = F.trim(href)
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.length(bare) > F.length(root), F.regexp_replace(bare, r"/[^/]*$", "/")).otherwise(F.concat(root, F.lit("/")))
    full = (F.when(root == "", None).when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, r"(?i)^(https?:)", 1), h))
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(bare, h)).when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
            .when(h == "", None).otherwise(F.concat(folder, h)))
    return let(full, _without_steps)


def _without_steps(url: Column) -> Column:
    """Path segments . and .. of a URL taken as steps."""
    root, path, rest = (F.regexp_extract(url, r"(?is)^([a-z]+://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    none = F.array().cast("array<string>")
    walk = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    segments = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    steps = F.when(segments[F.size(segments) - 1].isin(".", ".."), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(root, F.lit("/"), F.array_join(F.aggregate(steps, none, walk), "/"), rest)).otherwise(url)


def page_links(captures: DataFrame) -> DataFrame:
    """Links of a page to its own origin, hash stripped, each once: (page columns' url, link)."""
    hrefs = F.regexp_extract_all("html", F.lit(f"(?i)<a\\b[^>]*\\bhref={Q}([^\"']+){Q}"), 1)
    links = captures.select("url", F.explode(F.array_distinct(hrefs)).alias("href"))
    links = links.select("url", strip_hash(resolve_url(F.replace(F.col("href"), F.lit("&amp;"), F.lit("&")), F.col("url"))).alias("link"))
    same = (origin(F.col("link")) == origin(F.col("url"))) & (F.length("link") > F.length(origin(F.col("url"))) + 1)
    return links.filter(same).distinct()


def declared_feeds(captures: DataFrame) -> DataFrame:
    """Feeds a page declares in its head: (url, feed)."""
    tags = captures.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<link\b[^>]*>)"), 1)).alias("tag"))
    ok = F.col("tag").rlike("(?i)rel=[\"']?alternate") & F.col("tag").rlike(f"(?i)type={Q}application/(rss|atom)\\+xml")
    feed = resolve_url(F.nullif(F.regexp_extract("tag", f"(?i)href={Q}([^\"']+){Q}", 1), F.lit("")), F.col("url"))
    return tags.filter(ok).select("url", feed.alias("feed")).filter(F.col("feed").isNotNull()).distinct()


def feed_links(feeds: DataFrame) -> DataFrame:
    """Article URLs of feed documents (source_id, url, xml): link elements, link targets, ids; same origin, hash stripped."""
    found = F.concat(F.regexp_extract_all("xml", F.lit(r"(?i)<link>\s*([^<]+?)\s*</link>"), 1), F.regexp_extract_all("xml", F.lit(f"(?i)<link\\b[^>]*\\bhref={Q}([^\"']+){Q}[^>]*/?>"), 1),
                     F.regexp_extract_all("xml", F.lit(r"(?i)<guid[^>]*>\s*(https?://[^<]+?)\s*</guid>"), 1))
    rows = feeds.select("source_id", "url", F.explode(found).alias("raw"))
    rows = rows.select("source_id", F.col("url").alias("feed"), resolve_url(F.col("raw"), F.col("url")).alias("link"))
    return rows.filter(origin(F.col("link")) == origin(F.col("feed"))).select("source_id", "feed", strip_hash(F.col("link")).alias("article_url")).distinct()


def sitemap_score(url: Column) -> Column:
    """News sitemaps first, then by year and month in the file name."""
    year, month = F.regexp_extract(url, r"(\d{4})[-_/]?(\d{2})?", 1), F.regexp_extract(url, r"(\d{4})[-_/]?(\d{2})?", 2)
    dated = F.coalesce(year.try_cast("bigint"), F.lit(0)) * 100 + F.coalesce(month.try_cast("bigint"), F.lit(0))
    return F.when(url.rlike("(?i)(news|aktuell|recent)"), F.lit(2**53 - 1)).otherwise(dated)


def rank_sitemaps(files: DataFrame, per_source: int | None = None) -> DataFrame:
    """Newest sitemap files per source: (source_id, url, rn)."""
    d = files.select("source_id", "url").distinct().withColumn("score", sitemap_score(F.col("url")))
    return _ranked(d, ["source_id"], per_source)


def _ranked(files: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """Sitemap files newest first, with their rank; `most` keeps so many."""
    order = [F.desc("score"), F.asc("url")]
    if most is None:
        return files.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return top_per_group(files, keys, order, most, spread=["url"])


def index_children(indexes: DataFrame, children: int | None = None) -> DataFrame:
    """Newest children of sitemap indexes (source_id, url, xml)."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]+?)\s*</loc>"), 1)
    rows = indexes.filter(F.col("xml").rlike("(?i)<sitemapindex")).select("source_id", F.col("url").alias("index_url"), F.explode(F.array_distinct(locs)).alias("url"))
    rows = rows.withColumn("score", sitemap_score(F.col("url")))
    return _ranked(rows, ["source_id", "index_url"], children)


def sitemap_entries(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Article URLs of sitemap files (source_id, url, xml) with their date: (source_id, article_url, at, precise).
    A publication date beats a modification date, which only fills; other origins and kinds drop."""
    blocks = files.select("source_id", F.col("url").alias("sitemap"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?i)<url\b[^>]*>([\s\S]*?)</url>"), 1)).alias("b"))
    date = lambda p: parse_ts(F.nullif(F.regexp_extract("b", p, 1), F.lit("")))
    rows = blocks.select("source_id", "sitemap", strip_hash(F.trim(F.regexp_extract("b", r"(?i)<loc>\s*([^<]+?)\s*</loc>", 1))).alias("article_url"),
                         date(r"(?i)<(?:\w+:)?publication_date>\s*([^<]+?)\s*</(?:\w+:)?publication_date>").alias("pub"), date(r"(?i)<lastmod>\s*([^<]+?)\s*</lastmod>").alias("mod"))
    rows = rows.filter((origin(F.col("article_url")) == origin(F.col("sitemap"))) & (url_kind(F.col("article_url")) == "article"))
    per = rows.groupBy("source_id", F.col("article_url")).agg(F.max("pub").alias("pub"), F.min("mod").alias("mod"))
    out = per.select("source_id", canonical_url(F.col("article_url")).alias("article_url"), F.coalesce("pub", "mod").alias("at"), F.col("pub").isNotNull().alias("precise"))
    return top_per_group(out, ["source_id"], [F.desc_nulls_last("at"), F.asc("article_url")], limit, spread=["article_url"]).drop("rn") if limit else out


def observations(links: DataFrame, run_id, seen_at, home_depth: Column | None = None) -> DataFrame:
    """Article links of pages as link observations; the reference is the path of the page."""
    kind = F.when(home_depth == 0, "home").otherwise("section") if home_depth is not None else F.lit("section")
    path = F.coalesce(F.nullif(url_path(F.col("url")), F.lit("")), F.lit("/"))
    query = F.coalesce(F.concat(F.lit("?"), F.try_parse_url("url", F.lit("QUERY"))), F.lit(""))
    return links.filter(url_kind(F.col("link")) == "article").select(
        run_id.alias("run_id"), "source_id", canonical_url(F.col("link")).alias("article_url"), F.concat(path, query).alias("ref_url"), kind.alias("ref_kind"), seen_at.alias("seen_at"))
