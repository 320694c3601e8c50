"""Jobs on page URLs: canonical form, article keys, kinds, rubrics, the section tree, re-slugs.

All rules are Columns over parse_url and regular expressions; they run inside the scan stage.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta import constants as K
from pressdelta.functions.text import let, pretty, rx, strip_accents
from pressdelta.plans.patterns import top_per_group
from pressdelta.session import checkpoint_dir
from pressdelta.sources.tables import Tables

# --- fixed values: publisher hosts, URL patterns ------------------------------------------------------------------
HOST_IDS = r"(^|\.)n-tv\.de$"
HOST_BILD = r"(^|\.)bild\.de$"
HOST_SPIEGEL = r"(^|\.)spiegel\.de$"
HOST_FAZ = r"(^|\.)faz\.net$"
HOST_TAGESSCHAU = r"(^|\.)tagesschau\.de$"
NOT_ARTICLE = (
    r"/(impressum|kontakt|datenschutz|newsletter|mediathek|archiv|suche|recherche|abo|hilfe|agb|rss|index)\b",
    r"/(redaktion|autor(en)?|auteurs?|author|journalist|kolumnisten|signataires|korrespondenten|korrespondent)/",
    r"/themen?/(specials?|organisationen|personen)/",
    r"/(podcast|video|livestream|audio|multimedia|bilder|fotostrecke|guides?-d-achat|qui-sommes-nous|about-us|le-monde-(services|et-vous))\b",
    r"(boersenkurse|kurse|horoskop|wetter|lotto|gewinnspiel|comics|spiele|aboseite|abonnement|bildplus|ateaserseite|teaserseite|alle-infos|thema-|bestseller|verbraucherdialog|chaleur-humaine|se-former)",
    r"[-/](home|startseite|teaserseite)[-/]",
    r"/tv/|[-/]a-z[-/.]",
)
IS_ARTICLE = (r"\d{5,}", r"/\d{4}/\d{2}/\d{2}/", r"-\d+\.html?$", r"-a-[0-9a-f]{8}-[0-9a-f]{4}-", r"-[0-9a-f]{24}(?:\.html?)?(?:$|[?#])")
SEC_SPONSORED = r"^(anzeige[n]?|sponsored|advertorials?|werbe[a-z-]*|promotion|adv|partner-?content|brandstory|productstory|shopping-und-service|kaufkompass|kaufberater[a-z-]*|[a-z-]*gewinnspiel[a-z-]*)$"
QUERY_SPONSORED = r"[?&](sponsored|advertorial|anzeige)="
PATH_SPONSORED = (r"bild\.de/(service|sonstiges)/", r"spiegel\.de/tests/")
SEC_SERVICE = r"^(impressum|kontakt|datenschutz|newsletter|abo|login|konto|hilfe|agb|nutzungsbedingungen|privacy|mentions-legales|cgu)$"
SEC_MEDIA = r"^(podcast|videos?|audio|mediathek|livestream|bilder|fotostrecke[n]?|galerie|multimedia|tv)$"
SLUG_MEDIA = r"^(video|audio|podcast|livestream)-"
SEC_INTERACTIVE = r"^(boersenkurse|kurse|wetter|horoskop|lotto|gewinnspiel|rechner|tabelle|ergebnisse|spielplan)$"
TREE_SKIP = r"^(\d{4}|\d{1,2}|article|aktuell)$"
HEX_ID = r"(?i)(?:^|[-/])([0-9a-f]{24})(?:\.html?)?(?:[?#]|$)"
UUID_ID = r"(?i)-a-([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def url_host(c: Column) -> Column:
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def url_path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))


def outlet_host(c: Column) -> Column:
    """Host without a leading www."""
    return F.regexp_replace(url_host(c), r"^www\.", "")


def origin(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?i)^(https?://[^/?#]+)", 1))


def strip_hash(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def segments(c: Column) -> Column:
    """Lower-case path segments."""
    return F.filter(F.split(F.lower(F.coalesce(url_path(c), F.lit(""))), "/"), lambda s: s != "")


def sections(c: Column) -> Column:
    """Path segments without the last one: the headline slug never decides anything."""
    s = segments(c)
    return F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))


def topic_sections(c: Column) -> Column:
    """Sections that can carry a topic: no numbers, no dated parts, no filler."""
    return F.filter(sections(c), lambda s: ~s.rlike(r"^\d+$") & ~s.rlike(r"-\d{4,}") & ~s.rlike("^articles?$"))


def section_depth(c: Column) -> Column:
    return F.size(F.filter(sections(c), lambda s: ~s.rlike(r"^\d+$") & ~s.rlike(r"-\d{4,}")))


def looks_like_article(c: Column) -> Column:
    """An article URL: not one of the service forms, two segments or more, no index form, and an id or a date."""
    u, path = F.lower(c), F.coalesce(url_path(c), F.lit(""))
    bad = reduce(or_, [u.rlike(rx(p, False)) for p in NOT_ARTICLE])
    good = reduce(or_, [u.rlike(p) for p in IS_ARTICLE])
    deep = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 2
    return F.coalesce(~bad & good & deep & ~path.rlike("/$"), F.lit(False))


def url_kind(c: Column) -> Column:
    """Kind by URL alone; sections decide as whole segments."""
    u, sec = F.lower(c), sections(c)
    slug = F.coalesce(F.get(segments(c), F.size(segments(c)) - 1), F.lit(""))
    has = lambda p: F.exists(sec, lambda s: s.rlike(p))
    return (F.when(has(SEC_SPONSORED) | u.rlike(QUERY_SPONSORED) | reduce(or_, [u.rlike(p) for p in PATH_SPONSORED]), "sponsored")
            .when(has(SEC_SERVICE), "service").when(has(SEC_MEDIA) | slug.rlike(SLUG_MEDIA), "media").when(has(SEC_INTERACTIVE), "interactive")
            .when(looks_like_article(c), "article").otherwise("unknown"))


def canonical_url(c: Column) -> Column:
    """Identity of an article URL: the short id form for the publisher with id URLs; query and hash off when the rest
    looks like an article."""
    number = F.regexp_extract(F.coalesce(url_path(c), F.lit("")), r"(?i)-id(\d+)\.html$", 1)
    bare = F.regexp_replace(c, r"[?#].*$", "")
    return (F.when(url_host(c).rlike(HOST_IDS) & (number != ""), F.concat(F.lit("https://www.n-tv.de/id"), number, F.lit(".html")))
            .when((bare != c) & looks_like_article(bare), bare).otherwise(c))


def with_canonical_url(df: DataFrame, column: str = "url") -> DataFrame:
    return df.withColumn("canonical_url", canonical_url(F.col(column)))


def hex_id(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, HEX_ID, 1), F.lit("")))


def page_canonical(url: Column, html: Column) -> Column:
    """Canonical URL named by the page, only for the publisher with slug variants, and only when it carries the same
    id and is not the bare id form."""
    q = "[\"']"
    link = F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (
        f"(?i)<link[^>]+rel={q}canonical{q}[^>]+href={q}([^\"']+){q}", f"(?i)<link[^>]+href={q}([^\"']+){q}[^>]+rel={q}canonical{q}",
        f"(?i)<meta[^>]+property={q}og:url{q}[^>]+content={q}([^\"']+){q}")])
    ok = url_host(url).rlike(HOST_BILD) & (hex_id(link) == hex_id(url)) & ~F.coalesce(url_path(link), F.lit("")).rlike(r"(?i)^/article/[0-9a-f]{24}/?$")
    return F.when(ok, link).otherwise(url)


def with_page_canonical(captures: DataFrame) -> DataFrame:
    return captures.withColumn("canonical_url", page_canonical(canonical_url(F.col("url")), F.col("html")))


def article_key(c: Column) -> Column:
    """The part of an article URL that survives a new headline, per publisher; NULL when there is none."""
    host, path = url_host(c), F.coalesce(url_path(c), F.lit(""))
    key = (F.when(host.rlike(HOST_BILD), hex_id(c)).when(host.rlike(HOST_SPIEGEL), F.lower(F.regexp_extract(path, UUID_ID, 1)))
           .when(host.rlike(HOST_FAZ), F.regexp_extract(path, r"-(\d{8,})\.html$", 1))
           .when(host.rlike(HOST_TAGESSCHAU), F.lower(F.regexp_extract(path, r"(?i),([a-z0-9-]+-\d+)\.html$", 1))))
    return F.nullif(key, F.lit(""))


def with_article_key(df: DataFrame, column: str = "url") -> DataFrame:
    return df.withColumn("article_key", article_key(F.col(column)))


def reconcile_reslugs(articles: DataFrame, pages: DataFrame, current: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Move articles whose URL was renamed to the current URL.

    `current` holds the URLs that captures were taken under (source_id, url).  A current URL without an article takes
    over the richest article (most revisions) of the same source and key: it keeps id and history, its old page
    becomes an alias.  One row per (source, key) is decided by a pre-aggregated maximum, not by sorting the key group.
    """
    key_of = lambda d: (article_key(d["url"]) if key is None else key)
    keyed = articles.withColumn("__key", key_of(articles)).filter(F.col("__key").isNotNull())
    fresh = current.select("source_id", "url").distinct().join(articles.select("url"), "url", "left_anti")
    fresh = fresh.withColumn("__key", key_of(fresh)).filter(F.col("__key").isNotNull())
    # several new slugs at once: the last one in text order is the one that is kept
    target = fresh.groupBy("source_id", "__key").agg(F.max("url").alias("new_url"))
    rank = F.struct(F.coalesce("revision_count", F.lit(0)).alias("r"), (-F.col("id")).alias("i"))
    richest = keyed.groupBy("source_id", "__key").agg(F.max_by(F.struct("id", "url"), rank).alias("old"))
    moves = target.join(richest, ["source_id", "__key"]).select(F.col("old.id").alias("__id"), F.col("old.url").alias("__old"), "new_url")
    a = articles.join(moves.select("__id", "new_url"), articles["id"] == F.col("__id"), "left")
    a = a.withColumn("url", F.coalesce("new_url", "url")).select(*articles.columns)
    p = pages.join(moves.select("__old", F.lit(True).alias("__alias")), pages["url"] == F.col("__old"), "left")
    p = p.withColumn("kind", F.when(F.col("__alias"), "alias").otherwise(F.col("kind"))).select(*pages.columns)
    return a, p


def url_rubric(c: Column) -> Column:
    """Rubric of a URL: struct(raw 'a/b', label 'A · B') of the last two telling sections, NULL without one."""
    sec = F.filter(sections(c), lambda s: ~s.rlike(r"^\d+$") & ~s.rlike(r"-\d{4,}") & ~s.isin(*K.RUBRIC_SKIP) & (F.length(s) >= 2))
    last = F.slice(sec, F.greatest(F.size(sec) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(sec) > 0, F.struct(F.array_join(last, "/").alias("raw"), F.array_join(F.transform(last, pretty), " · ").alias("label")))


def canon_category(label: Column) -> Column:
    """Category of a rubric label: federal state, then the multilingual groups, else its first word of 3 letters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(label)), "[^a-z ]", " "), r"\s+", " "))

    def pick(norm: Column) -> Column:
        out = None
        for key, _, names in (*K.FEDERAL_STATES, *K.CANON_CATEGORIES):
            cond = reduce(or_, [norm.contains(n) for n in names])
            out = F.when(cond, key) if out is None else out.when(cond, key)
        return out.otherwise(F.get(F.filter(F.split(norm, r"\s+"), lambda w: F.length(w) >= 3), F.lit(0)))

    return let(clean, pick)


def canon_label(key: Column, fallback: Column) -> Column:
    out = None
    for k, label, _ in (*K.FEDERAL_STATES, *K.CANON_CATEGORIES):
        out = F.when(key == k, label) if out is None else out.when(key == k, label)
    return out.otherwise(fallback)


def rubric_source_url(url: Column, *candidates: Column) -> Column:
    """URL that carries the rubric when the stored one has no section: the first candidate with one, else NULL."""
    ok = [F.when(u.rlike("(?i)^https?://") & (section_depth(u) > 0), u) for u in candidates]
    return F.when(section_depth(url) == 0, F.coalesce(*ok))


def with_rubric_url(df: DataFrame) -> DataFrame:
    return df.withColumn("rubric", rubric_source_url(F.col("url"), F.col("og_url"), F.col("canonical_href")))


def kind_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_id", "kind").agg(F.count("*").alias("n"))


def section_tree(pages: DataFrame, max_children: int = 6) -> DataFrame:
    """Section tree of each source: (source_id, path, parent, label, is_article, articles, rank).

    A node is a path prefix without date and filler segments; it counts the article nodes under it.  Branches without
    articles drop; a section whose only child is a section again is shown as one node 'a/b'.  Sections come before
    articles, large ones first; children beyond `max_children` are summed into one node '…'.  Only nodes whose parents
    are shown remain.
    """
    key = ["source_id", "path"]
    segs = F.filter(F.split(F.coalesce(url_path(F.col("url")), F.lit("")), "/"), lambda s: (s != "") & ~s.rlike(TREE_SKIP))
    leaves = pages.select("source_id", F.array_join(segs, "/").alias("path"), "kind").filter(F.col("path") != "")
    # several URLs can have one path: it is an article if one of them is
    leaves = leaves.groupBy(*key).agg(F.min(F.struct((F.col("kind") != "article").alias("o"), "kind")).alias("x")).select(*key, F.col("x.kind").alias("kind"))
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), i.alias("depth"),
        F.when(i == F.size(parts), F.col("kind")).alias("kind")))
    nodes = leaves.select("source_id", (F.col("kind") == "article").cast("bigint").alias("art"), F.explode(steps).alias("x")).select("source_id", "art", "x.*")
    nodes = nodes.groupBy("source_id", "path", "parent", "depth").agg(F.sum("art").alias("articles"), F.coalesce(F.max("kind"), F.lit("section")).alias("kind"))
    kids = nodes.groupBy("source_id", F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    n = nodes.join(kids, key, "left")
    up = n.select("source_id", F.col("path").alias("parent"), F.col("kind").alias("p_kind"), F.col("children").alias("p_children"))
    absorbed = F.coalesce((F.col("p_children") == 1) & (F.col("p_kind") == "section") & (F.col("kind") == "section") & (F.col("children") > 0), F.lit(False))
    n = n.join(up, ["source_id", "parent"], "left").withColumn("absorbed", absorbed)
    # the node table is read many times below and is small against the pages: fix it once
    checkpoint_dir(pages.sparkSession)
    n = n.checkpoint()
    # the shown node of a path is its deepest prefix that was not absorbed
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    sections_only = n.filter(F.col("children") > 0).select("source_id", "path", "depth", "absorbed")
    heads = (sections_only.select("source_id", "path", F.explode(prefixes).alias("head"))
             .join(sections_only.filter(~F.col("absorbed")).select("source_id", F.col("path").alias("head"), F.col("depth").alias("h_depth")), ["source_id", "head"])
             .groupBy("source_id", "path").agg(F.max_by("head", "h_depth").alias("head")))
    tail = heads.groupBy("source_id", F.col("head").alias("path")).agg(F.max_by("path", F.length("path")).alias("tail"))
    shown = n.filter(~F.col("absorbed") & (F.col("articles") > 0)).join(tail, key, "left")
    shown = shown.join(heads.select("source_id", F.col("path").alias("parent"), "head"), ["source_id", "parent"], "left")
    base = F.when(F.col("parent") == "", F.coalesce("tail", "path")).otherwise(F.substr(F.coalesce("tail", "path"), F.length("parent") + 2))
    shown = shown.select("source_id", "path", F.coalesce("head", F.lit("")).alias("parent"), base.alias("label"), (F.col("kind") == "article").alias("is_article"), "articles")
    order = [F.asc("is_article"), F.desc("articles"), F.asc("path")]
    top = top_per_group(shown, ["source_id", "parent"], order, max_children, rank="rank", spread=["path"])
    totals = shown.groupBy("source_id", "parent").agg(F.count("*").alias("k"), F.sum("articles").alias("all"))
    in_top = top.groupBy("source_id", "parent").agg(F.sum("articles").alias("some"))
    rest = totals.filter(F.col("k") > max_children).join(in_top, ["source_id", "parent"]).select(
        "source_id", F.concat_ws("/", F.nullif("parent", F.lit("")), F.lit("…")).alias("path"), "parent",
        F.concat(F.lit("… +"), (F.col("k") - max_children).cast("string")).alias("label"), F.lit(False).alias("is_article"), (F.col("all") - F.col("some")).alias("articles"), F.lit(max_children + 1).alias("rank"))
    rows = top.select("source_id", "path", "parent", "label", "is_article", "articles", "rank").unionByName(rest)
    # visible: every shown section above is itself within the first children and is no article
    open_nodes = top.filter(~F.col("is_article")).select("source_id", F.col("path").alias("anc"))
    above = rows.filter(F.col("parent") != "").select("source_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("parent", "/"))), lambda i: F.array_join(F.slice(F.split("parent", "/"), F.lit(1), i), "/"))).alias("anc"))
    is_head = heads.filter(F.col("path") == F.col("head")).select("source_id", F.col("path").alias("anc"))
    closed = above.join(is_head, ["source_id", "anc"], "left_semi").join(open_nodes, ["source_id", "anc"], "left_anti").select("source_id", "path").distinct()
    return rows.join(closed, key, "left_anti")


def live_content(url: Column, title: Column) -> Column:
    """Live reporting by URL or title."""
    hay = F.lower(F.concat(url, F.lit(" "), F.coalesce(title, F.lit(""))))
    hub = hay.rlike(r"news?ticker/.*alle-[a-z-]+-news")
    live = hay.rlike(r"liveblog|live-blog|live-ticker|liveticker|newsblog|en-direct|im[- ]minutentakt") | hay.rlike("/live/") | F.coalesce(title.rlike(r"\+\+.+\+\+"), F.lit(False))
    return ~hub & live
