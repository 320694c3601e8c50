"""Facts from captured pages: metadata, dates, paywall, authors, keywords, topic, page kind, signals.

One pass of Columns over (url, html); JSON-LD is parsed into VARIANT values once per page.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from pressdelta import constants as K
from pressdelta.functions.numbers import half_up
from pressdelta.functions.text import WS, collapse_ws, decode_entities, is_person, let, rx, trim_ws
from pressdelta.functions.timeutil import parse_ts
from pressdelta.operators.url_jobs import live_content, looks_like_article, rubric_source_url, topic_sections, url_host, url_kind, url_path
from pressdelta.plans.patterns import top_per_group
from pressdelta.sources.tables import Tables

Q = "[\"']"
# --- fixed values: patterns and lists --------------------------------------------------------------------------------------
LD_SCRIPT = r"(?i)<script[^>]+type=" + Q + r"application/ld\+json" + Q + r"[^>]*>([\s\S]*?)</script>"
PAYWALL_CSS = r"(?i)paywall|premium-overlay|piano-|plus-artikel|abo-schranke|metered-wall|subscriber-only|locked-content"
FREE_HOSTS = r"(^|\.)tagesschau\.de$|(^|\.)n-tv\.de$"
ARTICLE_TYPES = {"LiveBlogPosting": "liveblog", "OpinionNewsArticle": "opinion", "AnalysisNewsArticle": "analysis", "ReviewNewsArticle": "review", "ReportageNewsArticle": "reportage", "InteractiveNewsArticle": "interactive"}
GENERIC_AUTHOR = r"(?i)^(redaktion|red\.?|dpa(-afx)?|afp|reuters|sid|kna|epd|ap|afx|ag|agenturen|online|newsroom|web|t-online|n-?tv|bild(\.de)?|spiegel( online)?|der spiegel|faz|f\.a\.z\.|faz\.net|tagesschau(\.de)?|sportschau|ard|zdf|rnd|le ?monde(\.fr)?)$"
CRUMB_NOISE = r"(?iu)^(startseite|home|accueil|übersicht|uebersicht|aktuell|news|newsticker|importe?|incoming|dpa|afp|reuters|sid|kna|epd|agenturmeldungen|mehr|alle|artikel|article|faz\.net|bild|der spiegel|spiegel|tagesschau|n-tv|ntv|le monde)$"
SIGNAL_TYPES = r"(?i)(News)?Article|LiveBlogPosting|ReportageNewsArticle|OpinionNewsArticle|ReviewNewsArticle|AnalysisNewsArticle|BlogPosting|Report\b"
ERROR_TITLE = (r"(?iu)^\s*(ein fehler ist aufgetreten|entschuldigung,? es ist ein fehler|fehler\s*[:#(]|404\b|410\b|error\s*\d{3}|seite (nicht|leider nicht|wurde nicht|konnte nicht) (gefunden|geladen|aufgerufen)"
               r"|seite nicht verf[üu]gbar|diese seite (gibt es|existiert) nicht|page (not found|introuvable|non[\s-]?trouv)|not found|page indisponible|cette page n.?existe|zugriff verweigert|access denied|forbidden|just a moment|attention required)")
COMMENT_MARKERS = ("disqus", "coral", "fb-comments", "commento", "kommentar", "comment-section")
PAYWALL_MARKERS = (
    "faz-paywall", "faz-plus", "js-paywall", "subscriptionwall", "spiegel-plus", "paid-content", "sp-subscription", "article__state--premium", "paywall", "lmd-premium",
    "piano-", "tinypass", "piano-id", "piano-offer", "metered-wall", "subscriber-only", "locked-content", "abo-schranke", "plus-artikel", "premium-overlay", "premium-content", "premium-article",
)
PAYWALL_PROBES = {
    "iaff-false": r"(?i)\"isAccessibleForFree\"\s*:\s*\"?false\"?", "iaff-true": r"(?i)\"isAccessibleForFree\"\s*:\s*\"?true\"?", "haspart": r"(?i)\"hasPart\"", "jetzt-kostenlos": r"(?i)Jetzt kostenlos",
    "f-plus": r"(?<![A-Za-z0-9_])F\+(?=[A-Za-z0-9_])", "bildplus": r"(?i)BILDplus", "spiegelplus": r"SPIEGEL\s?\+|(?<![A-Za-z0-9_])S\+(?=[A-Za-z0-9_])", "weiterlesen-mit": r"(?i)weiterlesen mit",
    "piano": r"(?i)tp-modal|tp-container|class=\"[^\"]*piano|id=\"piano\"", "abo-schranke": r"(?i)nur mit Abo|Abonnement erforderlich|Zugang erforderlich|Diese Funktion ist .{0,20}Abonnenten",
}
PROBED_HOSTS = r"(^|\.)(faz\.net|bild\.de|spiegel\.de)$"
HUB_CHARS = 25000


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


META_TAG = "(?i)<meta(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<meta[^>]*>"


def meta_tags(html: Column) -> Column:
    """Meta tags of a page, read in one pass: array<struct<names, content>> with the values of name and property."""
    names = lambda tag: F.transform(F.regexp_extract_all(tag, F.lit(f"(?i)(?:name|property)={Q}([^\"']+){Q}"), 1), lambda n: F.lower(n))
    content = lambda tag: F.trim(F.regexp_extract(tag, f"(?i)content={Q}([^\"']+){Q}", 1))
    return F.transform(F.regexp_extract_all(html, F.lit(META_TAG), 0), lambda tag: F.struct(names(tag).alias("names"), content(tag).alias("content")))


def meta_values(metas: Column, test) -> Column:
    """Contents of the tags one of whose names passes the test."""
    return F.transform(F.filter(metas, lambda m: (m["content"] != "") & F.exists(m["names"], test)), lambda m: m["content"])


def meta_content(metas: Column, *names: str) -> Column:
    """Content of the first named meta tag that is there."""
    def first(name: str) -> Column:
        return F.get(meta_values(metas, lambda n: n == name), F.lit(0))
    return F.coalesce(*[first(n) for n in names])


# --- JSON-LD -----------------------------------------------------------------------------------------------------------------
def _get(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def jsonld_items(html: Column, graphs: bool = True) -> Column:
    """All JSON-LD objects of a page: lists and, if wanted, @graph wrappers unpacked; broken blocks skipped."""
    blocks = F.filter(F.transform(F.regexp_extract_all(html, F.lit(LD_SCRIPT), 1), lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    tops = F.flatten(F.transform(blocks, lambda v: F.coalesce(_get(v, "$", "array<variant>"), F.array(v))))
    if not graphs:
        return tops
    return F.flatten(F.transform(tops, lambda v: F.concat(F.array(v), F.coalesce(_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))))


def with_jsonld(captures: DataFrame, graphs: bool = True) -> DataFrame:
    """Adds `ld`, the JSON-LD objects; `graphs` also unpacks @graph wrappers."""
    return captures.withColumn("ld", jsonld_items(F.col("html"), graphs))


def type_includes(v: Column, needle: str) -> Column:
    """Type test on a text-or-list value: a list reads as its JSON text."""
    return F.coalesce(_get(v, "$['@type']").contains(needle), F.lit(False))


def type_names(ld: Column) -> Column:
    one = lambda v: F.coalesce(_get(v, "$['@type']", "array<string>"), F.filter(F.array(_get(v, "$['@type']")), lambda x: x.isNotNull()))
    return F.flatten(F.transform(ld, one))


def article_item(ld: Column) -> Column:
    return F.get(F.filter(ld, lambda v: type_includes(v, "Article")), F.lit(0))


def _first_ld(ld: Column, path: str) -> Column:
    """First parseable date of a field over all items."""
    return F.get(F.filter(F.transform(ld, lambda v: parse_ts(_get(v, path))), lambda t: t.isNotNull()), F.lit(0))


def free_flags(ld: Column) -> Column:
    return F.filter(F.transform(ld, lambda v: _get(v, "$.isAccessibleForFree")), lambda x: x.isNotNull())


def _flags(ld: Column) -> tuple[Column, Column, Column]:
    f = free_flags(ld)
    return F.size(f) > 0, F.exists(f, lambda x: x.isin("true", "True")), F.exists(f, lambda x: x.isin("false", "False"))


# --- single facts ----------------------------------------------------------------------------------------------------------------
def url_date(url: Column) -> Column:
    """Date in the path, noon UTC; not a precise time."""
    p = r"/(\d{4})/(\d{2})/(\d{2})(?:/|_|-)"
    text = F.concat_ws("-", *[F.regexp_extract(url, p, i) for i in (1, 2, 3)])
    year = F.regexp_extract(url, p, 1).try_cast("int")
    return F.when(year.between(2000, 2100), F.try_to_timestamp(F.concat(text, F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def _raw_date(html: Column, field: str) -> Column:
    return parse_ts(_some(F.regexp_extract(html, f'(?i)"{field}"\\s*:\\s*"([^"]+)"', 1)))


def _time_tag(html: Column) -> Column:
    mark = f"(?:itemprop={Q}datePublished{Q}|pubdate)"
    forms = (f"(?i)<time\\b[^>]*\\b{mark}[^>]*\\bdatetime={Q}([^\"']+){Q}", f"(?i)<time\\b[^>]*\\bdatetime={Q}([^\"']+){Q}[^>]*\\b{mark}")
    return parse_ts(F.coalesce(*[_some(F.regexp_extract(html, f, 1)) for f in forms]))


def visible_words(html: Column) -> Column:
    text = trim_ws(F.regexp_replace(html, "<[^>]+>", " "))
    return F.size(F.split(text, f"[{WS}]+")).cast("bigint")


def page_language(html: Column) -> Column:
    return _some(F.regexp_extract(html, f"(?i)<html[^>]+lang={Q}([a-z]{{2}})", 1))


def author_list(metas: Column, article: Column) -> Column:
    raw = _get(article, "$.author", "variant")
    items = F.when(raw.isNotNull(), F.coalesce(_get(raw, "$", "array<variant>"), F.array(raw))).otherwise(F.array().cast("array<variant>"))
    # an object without a name reads as its JSON text and does not count
    name = lambda v: F.coalesce(_get(v, "$.name"), F.when(~_get(v, "$").startswith("{"), _get(v, "$")), F.lit(""))
    names = F.filter(F.transform(items, lambda v: trim_ws(name(v))), lambda s: s != "")
    extra = meta_content(metas, "author", "article:author")
    return F.when(extra.isNotNull() & ~F.array_contains(names, extra), F.concat(names, F.array(extra))).otherwise(names)


def author_status(authors: Column) -> Column:
    """named when one author is a person; anonymous for editors, agencies and domains; none without any."""
    clean = F.filter(F.transform(authors, lambda a: trim_ws(a)), lambda a: a != "")
    person = lambda a: ~a.rlike(GENERIC_AUTHOR) & ~a.rlike(r"(?i)\.(de|fr|com|net)$") & a.contains(" ") & is_person(F.regexp_replace(a, r"(?i)^(von|par|by)\s+", ""))
    return F.when(F.size(clean) == 0, "none").when(F.exists(clean, person), "named").otherwise("anonymous")


def _list_value(v: Column) -> Column:
    """Text-or-list value as a list; a text is cut at commas, semicolons and bars."""
    return F.coalesce(_get(v, "$", "array<string>"), F.split(_get(v, "$"), "[,;|]"), F.array().cast("array<string>"))


def keyword_list(html: Column, metas: Column, article: Column) -> Column:
    cut = lambda c: F.coalesce(F.split(c, "[,;|]"), F.array().cast("array<string>"))
    vendor = F.flatten(F.transform(meta_values(metas, lambda n: n.rlike("^[a-z0-9_]*keywords$")), lambda s: F.split(s, "[,;|]")))
    tags = meta_values(metas, lambda n: n == "article:tag")
    links = F.transform(F.regexp_extract_all(html, F.lit(f"(?i)<a[^>]+rel={Q}tag{Q}[^>]*>([\\s\\S]*?)</a>"), 1), lambda s: F.regexp_replace(s, "<[^>]+>", ""))
    parts = F.concat(_list_value(_get(article, "$.keywords", "variant")), cut(meta_content(metas, "news_keywords", "keywords")), vendor, tags, links)
    clean = F.transform(parts, lambda k: F.replace(F.lower(trim_ws(k)), F.lit("_"), F.lit(" ")))
    return F.array_distinct(F.filter(clean, lambda k: (F.length(k) > 1) & (F.length(k) < 60)))


def breadcrumb_sections(ld: Column) -> Column:
    """Middle of the breadcrumb trail by position: without publisher, headline and navigation labels."""
    trail = F.get(F.filter(ld, lambda v: type_includes(v, "BreadcrumbList")), F.lit(0))
    items = F.coalesce(_get(trail, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))
    named = F.transform(items, lambda e, i: F.struct(F.coalesce(_get(e, "$.position", "double"), F.lit(0.0)).alias("p"), i.alias("i"), trim_ws(F.coalesce(_get(e, "$.name"), _get(e, "$.item.name"), F.lit(""))).alias("n")))
    names = F.transform(F.filter(F.array_sort(named), lambda x: x["n"] != ""), lambda x: x["n"])
    middle = F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0)))
    return F.filter(middle, lambda s: ~s.rlike(CRUMB_NOISE))


def category_list(metas: Column, ld: Column, article: Column) -> Column:
    section = _get(article, "$.articleSection", "variant")
    own = F.when(section.isNotNull(), _list_value(section)).otherwise(F.coalesce(F.split(meta_content(metas, "article:section"), "[,;|]"), F.array().cast("array<string>")))
    ok = lambda c: (F.length(c) > 1) & (F.length(c) < 80)
    return F.array_distinct(F.filter(F.concat(F.transform(own, lambda c: trim_ws(c)), breadcrumb_sections(ld)), ok))


# --- topic -------------------------------------------------------------------------------------------------------------------------
def _match_topic(text: Column) -> Column:
    out = None
    for key, pattern in K.TOPIC_PATTERNS:
        out = F.when(text.rlike(rx(pattern)), key) if out is None else out.when(text.rlike(rx(pattern)), key)
    return out


def url_topic(url: Column) -> Column:
    return let(F.array_join(topic_sections(url), " "), _match_topic)


def topic_of(categories: Column, *urls: Column) -> Column:
    """First URL whose sections name a topic, else the categories, else the rest topic."""
    by_url = [F.when(u.rlike("(?i)^https?://"), url_topic(u)) for u in urls]
    return F.coalesce(*by_url, let(F.lower(F.array_join(categories, " ")), _match_topic), F.lit(K.TOPIC_FALLBACK))


def with_topic(df: DataFrame, urls: list[str], categories: str) -> DataFrame:
    return df.withColumn("topic", topic_of(F.col(categories), *[F.col(u) for u in urls]))


# --- the job -------------------------------------------------------------------------------------------------------------------------
def extract_metadata(captures: DataFrame) -> DataFrame:
    """Captures (url, html, ...) with all article facts as columns.  The parsed JSON-LD is dropped at the end."""
    c, html, url = F.col, F.col("html"), F.col("url")
    d = with_jsonld(captures)
    d = d.withColumns({"__a": article_item(c("ld")), "__m": meta_tags(html)})
    a, ld, metas = c("__a"), c("ld"), c("__m")
    flagged, free, closed = _flags(ld)
    title = F.coalesce(meta_content(metas, "og:title", "twitter:title"), _get(a, "$.headline"), _some(trim_ws(F.regexp_extract(html, "(?i)<title[^>]*>([^<]+)", 1))))
    precise = F.coalesce(parse_ts(meta_content(metas, "article:published_time", "og:article:published_time")), parse_ts(_get(a, "$.datePublished")), _first_ld(ld, "$.datePublished"), _raw_date(html, "datePublished"), _time_tag(html))
    modified = F.coalesce(parse_ts(meta_content(metas, "article:modified_time", "og:updated_time")), parse_ts(_get(a, "$.dateModified")), _first_ld(ld, "$.dateModified"), _raw_date(html, "dateModified"))
    canon = F.coalesce(*[_some(F.regexp_extract(html, p, 1)) for p in (f"(?i)<link[^>]+rel={Q}canonical{Q}[^>]+href={Q}([^\"']+){Q}", f"(?i)<link[^>]+href={Q}([^\"']+){Q}[^>]+rel={Q}canonical{Q}")])
    d = d.withColumns({
        "title": decode_entities(title), "description": F.coalesce(meta_content(metas, "og:description", "description", "twitter:description"), _get(a, "$.description")),
        "og_image": F.coalesce(meta_content(metas, "og:image", "twitter:image"), _get(a, "$.image.url"), _get(a, "$.image")),
        "__precise": precise, "modified_at": modified, "og_url": meta_content(metas, "og:url"), "canonical_href": canon,
        "paywalled": F.when(url_host(url).rlike(FREE_HOSTS), F.lit(False)).when(flagged, closed & ~free).when(html.rlike(PAYWALL_CSS), F.lit(True)),
        "word_count": visible_words(html), "lang_detected": page_language(html), "authors": author_list(metas, a), "keywords": keyword_list(html, metas, a), "categories": category_list(metas, ld, a),
        "__type": F.coalesce(_get(a, "$['@type']"), F.lit("NewsArticle")),
    })
    kind = None
    for name, value in ARTICLE_TYPES.items():
        kind = F.when(c("__type") == name, value) if kind is None else kind.when(c("__type") == name, value)
    d = d.withColumns({
        "published_at": F.coalesce("__precise", url_date(url)), "published_precise": c("__precise").isNotNull(),
        "article_type": F.when(live_content(url, c("title")), "liveblog").otherwise(kind.otherwise("news")),
        "reading_min": F.greatest(F.lit(1), half_up(c("word_count") / 200)), "author_status": author_status(c("authors")),
        "topic": topic_of(c("categories"), url, c("og_url"), c("canonical_href")), "rubric": rubric_source_url(url, c("og_url"), c("canonical_href")),
    })
    return d.drop("ld", "__a", "__m", "__precise", "__type")


# --- page kind ---------------------------------------------------------------------------------------------------------------------------
def is_error_page(status: Column, html: Column) -> Column:
    title = decode_entities(F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1))
    return F.coalesce(status >= 400, F.lit(False)) | title.rlike(ERROR_TITLE)


def _og_type(html: Column, value: str) -> Column:
    return html.rlike(f"(?i)property={Q}og:type{Q}[^>]+content={Q}{value}") | html.rlike(f"(?i)content={Q}{value}[^\"']*{Q}[^>]+property={Q}og:type{Q}")


def has_article_signal(html: Column, ld: Column) -> Column:
    return F.exists(type_names(ld), lambda t: t.rlike(SIGNAL_TYPES)) | _og_type(html, "article[\"']") | html.rlike(f"(?i)content={Q}article{Q}[^>]+property={Q}og:type{Q}")


def is_video_page(html: Column, ld: Column) -> Column:
    """A page that is only a video; an article with an embedded one stays an article."""
    names = type_names(ld)
    player = html.rlike(f"(?i)name={Q}twitter:card{Q}[^>]+content={Q}player{Q}") | html.rlike(f"(?i)content={Q}player{Q}[^>]+name={Q}twitter:card{Q}")
    video = _og_type(html, r"video\.") | F.exists(names, lambda t: t == "VideoObject") | (player & (visible_words(html) < 200))
    return ~F.exists(names, lambda t: F.lower(t).contains("article")) & video


def page_kind(captures: DataFrame, body: str | None = "body") -> DataFrame:
    """Adds `kind`: error pages, the kind by URL, videos, hubs, articles, sections.  `body` is the extracted text."""
    html, url = F.col("html"), F.col("url")
    d = with_jsonld(captures).withColumn("__url_kind", url_kind(url)).withColumn("__signal", has_article_signal(html, F.col("ld")))
    dated = url.rlike(r"/\d{4}/\d{2}/\d{2}/")
    index = F.coalesce(url_path(url).rlike("/$") | (url_path(url) == ""), F.lit(True))
    text = looks_like_article(url) & F.col(body).isNotNull() if body else F.lit(False)
    status = F.col("http_status") if "http_status" in captures.columns else F.lit(None).cast("int")
    kind = (F.when(is_error_page(status, html), "error").when(~F.col("__url_kind").isin("article", "unknown"), F.col("__url_kind")).when(is_video_page(html, F.col("ld")), "media")
            .when((F.length(html) > HUB_CHARS) & ~F.col("__signal") & ~dated, "section").when(text, "article").when(~index & (F.col("__signal") | dated), "article").otherwise("section"))
    return d.withColumn("kind", kind).drop("ld", "__url_kind", "__signal")


# --- signals and paywall audits -------------------------------------------------------------------------------------------------------
SIGNALS = {
    "has_comments": lambda html, ld, ads: reduce(or_, [html.contains(m) for m in COMMENT_MARKERS]),
    "ad_signal": lambda html, ld, ads: ads,
    "paywalled": lambda html, ld, ads: F.when(_flags(ld)[0], _flags(ld)[2] & ~_flags(ld)[1]).otherwise(reduce(or_, [html.contains(m) for m in PAYWALL_MARKERS])),
    "is_liveblog": lambda html, ld, ads: F.coalesce(F.exists(ld, lambda v: F.coalesce(_get(v, "$['@type']") == "LiveBlogPosting", F.lit(False))), F.lit(False)) | html.rlike("liveblog|live-blog|live-?ticker"),
    "body_chars": lambda html, ld, ads: F.length(F.regexp_replace(html, "<[^>]+>", "")),
}


def page_signals(captures: DataFrame, collectors: dict | None = None) -> DataFrame:
    """Adds `signals`: one field per collector.  A collector is a function of (lower-case html, JSON-LD items, number of
    ad requests); add an entry to collect one more."""
    ads = F.col("ad_requests") if "ad_requests" in captures.columns else F.lit(None).cast("bigint")
    d = with_jsonld(captures, graphs=False).withColumn("__low", F.lower("html"))
    fields = [F.coalesce(fn(F.col("__low"), F.col("ld"), ads)).alias(n) for n, fn in (collectors or SIGNALS).items()]
    return d.withColumn("signals", F.struct(*fields)).drop("ld", "__low")


def mirror_paywall(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """The paywall signal of the latest capture overrides the stored state."""
    s = signals.groupBy("url").agg(F.max_by("signals.paywalled", "captured_at").alias("__p"))
    return articles.join(s, "url", "left").withColumn("paywalled", F.coalesce("__p", "paywalled")).select(*articles.columns)


def backfill_paywall(articles: DataFrame, captures: DataFrame) -> DataFrame:
    """Articles marked as paid whose page says it is free, and nowhere that it is not, become free."""
    # pages without a flag are neither free nor closed; no filter asks for the parsed blocks a second time
    _, free, closed = _flags(F.col("ld"))
    sure = with_jsonld(captures).groupBy("url").agg(F.bool_or(free).alias("f"), F.bool_or(closed).alias("c")).filter("f AND NOT c").select("url", F.lit(True).alias("__free"))
    return articles.join(sure, "url", "left").withColumn("paywalled", F.when(F.col("__free") & F.col("paywalled"), F.lit(False)).otherwise(F.col("paywalled"))).select(*articles.columns)


def paywall_marker_counts(captures: DataFrame, per_host: int | None = None) -> DataFrame:
    """How often each paywall marker occurs per host: (host, captures, marker, n); `per_host` takes a sample of so many captures."""
    host = url_host(F.col("url"))
    rows = captures.withColumn("host", host).filter(F.col("host").rlike(PROBED_HOSTS))
    if per_host is not None:
        rows = top_per_group(rows.select("host", "url", "html"), ["host"], [F.asc("url")], per_host, spread=["url"])
    flags = F.array(*[F.struct(F.lit(n).alias("marker"), F.col("html").rlike(p).alias("hit")) for n, p in PAYWALL_PROBES.items()])
    return rows.select("host", F.explode(flags).alias("x")).groupBy("host", "x.marker").agg(F.count("*").alias("captures"), F.count_if("x.hit").alias("n"))


# --- maintenance jobs on stored articles ------------------------------------------------------------------------------------------------
def retopic(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics again from URL and stored categories: (articles kept, changes per old and new topic, removed URLs)."""
    cats = t.article_categories.join(t.categories.select(F.col("id").alias("category_id"), "name"), "category_id").groupBy("article_id").agg(F.array_sort(F.collect_set("name")).alias("__cats"))
    a = t.articles.join(cats, t.articles["id"] == cats["article_id"], "left").drop("article_id")
    kept = a.filter(looks_like_article(F.col("url"))).withColumn("__new", topic_of(F.coalesce("__cats", F.array().cast("array<string>")), F.col("url")))
    moves = kept.filter(~F.col("topic").eqNullSafe(F.col("__new"))).groupBy(F.col("topic").alias("old_topic"), F.col("__new").alias("new_topic")).agg(F.count("*").alias("n"))
    removed = t.articles.filter(~looks_like_article(F.col("url"))).select("url")
    return kept.withColumn("topic", F.col("__new")).select(*t.articles.columns), moves, removed


def retype(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Article types again from URL, title and growth: (articles, changes per old and new type)."""
    cur = F.coalesce("article_type", F.lit("news"))
    live = live_content(F.col("url"), F.col("title"))
    new = F.when(live & ~cur.isin("liveblog", "timeline"), "liveblog").when(~live & (F.coalesce("extension_count", F.lit(0)) >= 2) & (cur == "news"), "timeline").otherwise(cur)
    d = articles.withColumns({"__cur": cur, "__new": new})
    moves = d.filter("__cur <> __new").groupBy(F.col("__cur").alias("old_type"), F.col("__new").alias("new_type")).agg(F.count("*").alias("n"))
    return d.withColumn("article_type", F.col("__new")).select(*articles.columns), moves


def missing_keywords(t: Tables, budget: int, sources: int) -> DataFrame:
    """Titled articles without any keyword, an equal share of the budget per source."""
    share = -(-budget // sources)
    a = t.articles.filter(F.col("title").isNotNull()).join(t.article_keywords.select(F.col("article_id").alias("id")).distinct(), "id", "left_anti")
    return top_per_group(a.select("source_id", "id", "url"), ["source_id"], [F.asc("id")], share, spread=["id"]).drop("rn").orderBy("source_id", "id").limit(budget)


def upsert_dimension(dim: DataFrame, junction: DataFrame, values: DataFrame, key: str, name: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New dimension values and links: `values` is (article_id, values array); `limit` takes the first so many per article.
    Ids of new values are a 64-bit hash of the text, so that no counter is shared."""
    clean = F.array_distinct(F.filter(F.transform("values", lambda x: trim_ws(x)), lambda x: x != ""))
    v = values.select("article_id", F.explode(clean if limit is None else F.slice(clean, 1, limit)).alias(name))
    fresh = v.select(name).distinct().join(dim.select(name), name, "left_anti").select(F.xxhash64(name).alias("id"), name)
    grown = dim.select("id", name).unionByName(fresh)
    links = v.join(grown.select(F.col("id").alias(key), name), name).select("article_id", key).distinct()
    return grown, junction.select("article_id", key).unionByName(links.join(junction.select("article_id", key), ["article_id", key], "left_anti"))
