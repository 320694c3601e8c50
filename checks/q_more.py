"""Registered queries over markup made of the tables: feeds, sitemaps, keys, labels, histories, links with steps, JSON records."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.registry import query
from pressdelta import constants as K
from pressdelta.functions.records import json_records
from pressdelta.functions.timeutil import duration_label
from pressdelta.operators import body as bd, changes as ch, extract as ex, url_jobs as uj
from pressdelta.sources import captures as cp
from pressdelta.sources.driver_tables import derive, star


def made(spark, d, sql, name="articles"):
    """Rows made of a domain table by SQL that both sides understand."""
    text = sql.replace("{", "{{").replace("}", "}}").replace("VARCHAR", "STRING")
    return spark.sql(text.replace(f"d_{name}", "{rows}"), rows=derive(spark, d, name))


FEEDS = """SELECT source_id, concat('https://s', source_id, '.example/feed.xml') AS url,
 concat('<rss><item><link> ', url, '#top </link><guid isPermaLink="true">', url, '</guid></item><item><link href="/politik/x-', id, '.html"/></item><item><link>https://other.example/a.html</link></item></rss>') AS xml FROM d_articles"""


@query("io4_feed_links", """SELECT DISTINCT source_id, concat('https://s', source_id, '.example/feed.xml') AS feed, unnest([url, concat('https://s', source_id, '.example/politik/x-', id, '.html')]) AS article_url FROM d_articles""")
def _(spark, d):
    return cp.feed_links(made(spark, d, FEEDS))


SITEMAPS = """SELECT source_id, concat('https://s', source_id, '.example/sitemap.xml') AS url,
 concat('<urlset><url><loc>', url, '</loc>', CASE WHEN modified_at IS NULL THEN '' ELSE concat('<lastmod>', CAST(modified_at AS VARCHAR), '</lastmod>') END,
  CASE WHEN published_at IS NULL THEN '' ELSE concat('<news:publication_date>', CAST(published_at AS VARCHAR), '</news:publication_date>') END, '</url><url><loc>https://other.example/politik/a-1.html</loc></url></urlset>') AS xml FROM d_articles"""


@query("io5_sitemap_entries", "SELECT source_id, url AS article_url, coalesce(published_at, modified_at) AS at, published_at IS NOT NULL AS precise FROM d_articles")
def _(spark, d):
    return cp.sitemap_entries(made(spark, d, SITEMAPS))


FILES = "SELECT DISTINCT source_id, concat('https://s', source_id, '.example/sitemap-', CASE WHEN id % 97 = 0 THEN 'news' ELSE substr(CAST(first_seen AS VARCHAR), 1, 7) END, '.xml') AS url FROM d_articles"


@query("io6_rank_sitemaps", f"""WITH f AS ({FILES}), s AS (SELECT *, CASE WHEN contains(url, 'news') THEN 9007199254740991 ELSE CAST(regexp_extract(url, '(\\d{{4}})-(\\d{{2}})', 1) AS BIGINT) * 100 + CAST(regexp_extract(url, '(\\d{{4}})-(\\d{{2}})', 2) AS BIGINT) END AS score FROM f)
SELECT source_id, url, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, url) AS rn FROM s""")
def _(spark, d):
    return cp.rank_sitemaps(made(spark, d, FILES)).select("source_id", "url", F.col("rn").cast("bigint").alias("rn"))


HEADS = """SELECT url, concat('<head><link rel="alternate" type="application/rss+xml" href="../feed-', id % 3, '.xml"><link rel="alternate" hreflang="fr" href="/fr"><link rel="stylesheet" href="x.css"></head>') AS html FROM d_articles"""


@query("io7_declared_feeds", "SELECT url, concat(regexp_extract(url, '^(.*/)ausland/', 1), 'feed-', id % 3, '.xml') AS feed FROM d_articles")
def _(spark, d):
    return cp.declared_feeds(made(spark, d, HEADS))


LINKED = """SELECT url, concat('<a href="../../sport/./b-', id, '.html#x">s</a><a href="../../../../top-', id, '.html?q=../1">t</a><a href="..">u</a><a class="x" href="mailto:a@b.example">m</a>') AS html FROM d_articles"""


@query("io8_page_links_steps", """SELECT url, concat(regexp_extract(url, '^(https://[^/]+)', 1), unnest([concat('/sport/b-', id, '.html'), concat('/top-', id, '.html?q=../1'), regexp_extract(url, '^https://[^/]+(/.*/)ausland/', 1)])) AS link FROM d_articles""")
def _(spark, d):
    return cp.page_links(made(spark, d, LINKED))


KEYED = "SELECT id, CASE id % 3 WHEN 0 THEN concat('https://www.faz.net/aktuell/politik/neu-', id + 10000000, '.html') WHEN 1 THEN concat('https://www.faz.net/aktuell/politik/', id % 1000, '.html') ELSE url END AS url FROM d_articles"


@query("ur3_article_key", "SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id + 10000000 AS VARCHAR) END AS article_key FROM d_articles")
def _(spark, d):
    return uj.with_article_key(made(spark, d, KEYED)).select("id", "article_key")


HEXED = """SELECT id, concat('https://www.bild.de/politik/alt-', h) AS url, concat('<head><link rel="canonical" href="https://www.bild.de/', CASE id % 3 WHEN 0 THEN concat('politik/neu-', h) WHEN 1 THEN concat('article/', h)
 ELSE concat('sport/fremd-', substr(md5('x'), 1, 24)) END, '"></head>') AS html FROM (SELECT id, substr(md5(CAST(id AS VARCHAR)), 1, 24) AS h FROM d_articles)"""


@query("ur2_page_canonical", "SELECT id, concat('https://www.bild.de/politik/', CASE WHEN id % 3 = 0 THEN 'neu-' ELSE 'alt-' END, substr(md5(CAST(id AS VARCHAR)), 1, 24)) AS canonical_url FROM d_articles")
def _(spark, d):
    return uj.with_page_canonical(made(spark, d, HEXED)).select("id", "canonical_url")


LIVE = """SELECT id, concat('<script type="application/ld+json">{"@type":"', CASE WHEN id % 4 = 0 THEN 'NewsArticle' ELSE 'LiveBlogPosting' END, '","liveBlogUpdate":[{"datePublished":"2026-01-01T11:00:00Z","headline":"B', id, '","articleBody":"zwei"},',
 '{"datePublished":"2026-01-01T10:00:00Z","headline":"A', id, '"},{"datePublished":"2026-01-01T12:00:00Z","headline":"a', id, '"}]}</script>') AS html FROM d_articles"""


@query("bd4_liveblog_body", "SELECT id, CASE WHEN id % 4 > 0 THEN concat('A', id, chr(10), chr(10), 'B', id, '. zwei') END AS body FROM d_articles")
def _(spark, d):
    return ex.with_jsonld(made(spark, d, LIVE)).select("id", bd.liveblog_body(F.col("ld")).alias("body"))


RUBRIC = """SELECT id, concat('https://s.example/a-', id, '.html') AS url, CASE id % 3 WHEN 0 THEN concat('https://s.example/sport/a-', id, '.html') WHEN 1 THEN 'nichts' END AS og_url, concat('https://s.example/politik/a-', id, '.html') AS canonical_href FROM d_articles"""


@query("ur14_rubric_url", "SELECT id, concat('https://s.example/', CASE WHEN id % 3 = 0 THEN 'sport' ELSE 'politik' END, '/a-', id, '.html') AS rubric FROM d_articles")
def _(spark, d):
    return uj.with_rubric_url(made(spark, d, RUBRIC)).select("id", "rubric")


PROBED = """SELECT concat(CASE id % 3 WHEN 0 THEN 'https://www.faz.net/a-' WHEN 1 THEN 'https://www.bild.de/a-' ELSE 'https://x.example/a-' END, id) AS url,
 concat('<p>', CASE WHEN id % 5 = 0 THEN 'F+x' ELSE 'F+ Abo' END, '</p>', CASE WHEN id % 2 = 0 THEN '"isAccessibleForFree": false' ELSE 'bildPLUS' END) AS html FROM d_articles"""


@query("ex18_paywall_markers", f"""
WITH p AS (SELECT regexp_extract(url, '^https://(?:www\\.)?([^/]+)', 1) AS host, html FROM ({PROBED}) WHERE NOT contains(url, 'x.example')),
m AS (SELECT unnest(['iaff-false', 'iaff-true', 'haspart', 'jetzt-kostenlos', 'f-plus', 'bildplus', 'spiegelplus', 'weiterlesen-mit', 'piano', 'abo-schranke']) AS marker)
SELECT host, marker, count(*) AS captures, count(*) FILTER (CASE marker WHEN 'iaff-false' THEN contains(html, 'false') WHEN 'f-plus' THEN contains(html, 'F+x') WHEN 'bildplus' THEN contains(html, 'bildPLUS') ELSE FALSE END) AS n FROM p, m GROUP BY 1, 2""")
def _(spark, d):
    return ex.paywall_marker_counts(made(spark, d, PROBED)).withColumn("host", F.regexp_replace("host", r"^www\.", ""))


# the text between and around what each publisher's pages carry
FURNITURE = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://x.example/a.html' WHEN 1 THEN 'https://www.bild.de/a.html' WHEN 2 THEN 'https://www.n-tv.de/a.html' WHEN 3 THEN 'https://www.spiegel.de/a.html'
  WHEN 4 THEN 'https://www.faz.net/aktuell/x/y-1.html' ELSE 'https://y.example/a.html' END AS url, 'T' AS title, CAST(NULL AS VARCHAR) AS description,
 CASE doc_id % 6 WHEN 0 THEN concat(t, ' {"@context":"s","a":{"b":', doc_id, '},"c":[{}]} ', t) WHEN 1 THEN concat('Kopf Foto: Max 01.02.2026 - 10:11 Uhr ', t, ' TTS-Player überspringen ')
  WHEN 2 THEN concat(t, ' Empfehlungen1:23Film Mehr Inhalte anzeigen') WHEN 3 THEN concat(t, chr(10), 'Ein Film über etwas Schönes 01:23Noch ein Film über etwas 02:34Und ein dritter Film dazu 03:45')
  WHEN 4 THEN concat('18.06.2026, 12:58 Lesezeit: 6 Min. ', t, ' FAZ+ ') ELSE concat(t, ' An dieser Stelle findest du Inhalte aus ', doc_id, ' Weitere Infos finden Sie hier. ', t) END AS body
 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@query("bd2_clean_body", f"SELECT doc_id, {S.collapse("CASE WHEN doc_id % 6 IN (0, 5) THEN concat(coalesce(text, ''), ' ', coalesce(text, '')) ELSE coalesce(text, '') END")} AS body FROM documents")
def _(spark, d):
    rows = spark.sql(FURNITURE.replace("{", "{{").replace("}", "}}").replace("chr(10)", "'\\n'").replace("VARCHAR", "STRING").replace("FROM documents", "FROM {rows}"), rows=star(spark, d, "documents"))
    return bd.clean_body(rows).select("doc_id", "body")


CHOICES = "SELECT doc_id, coalesce(text, '') AS raw, CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), text) WHEN 1 THEN '' WHEN 2 THEN upper(text) ELSE concat(text, ' ') END AS rendered, doc_id % 3 = 0 AS live FROM documents"
_CHARS = lambda c: f"coalesce(list_sum(list_transform({S.paras(c)}, lambda p: length(p))), 0)"


@query("bd3_choose_body", f"""WITH c AS (SELECT *, {_CHARS('raw')} AS r, {_CHARS('rendered')} AS e FROM ({CHOICES}))
SELECT doc_id, CASE WHEN r < {K.BODY_MIN_CHARS} AND e < {K.BODY_MIN_CHARS} THEN CASE WHEN e >= r THEN 'rendered' ELSE 'raw' END WHEN r < {K.BODY_MIN_CHARS} THEN 'rendered' WHEN e < {K.BODY_MIN_CHARS} THEN 'raw' WHEN live OR e > r * 1.2 THEN 'rendered' ELSE 'raw' END AS chosen FROM c""")
def _(spark, d):
    rows = spark.sql(CHOICES.replace("chr(10)", "'\\n'").replace("FROM documents", "FROM {rows}"), rows=star(spark, d, "documents"))
    # which one was taken: the texts are marked in front, outside every paragraph
    mark = lambda c: F.concat(F.lit(f"{c}\n"), F.col(c))
    return rows.select("doc_id", F.regexp_extract(bd.choose_body(mark("raw"), mark("rendered"), F.col("live")), r"^(\w+)", 1).alias("chosen"))


@query("bd8_push_bounded", """WITH h AS (SELECT id, list_transform(range(0, id % 12 + 1), lambda x: concat('h', x)) AS h, concat('h', id % 5) AS x FROM d_articles),
g AS (SELECT id, list_append(list_filter(h, lambda y: y <> x), x) AS u, list_append(h, x) AS a FROM h)
SELECT id, array_to_string(u[greatest(len(u) - 7, 1):], ',') AS hashes, array_to_string(a[greatest(len(a) - 9, 1):], ',') AS times FROM g""")
def _(spark, d):
    h = derive(spark, d, "articles").select("id", F.transform(F.sequence(F.lit(0), (F.col("id") % 12).cast("int")), lambda x: F.concat(F.lit("h"), x.cast("string"))).alias("h"), F.concat(F.lit("h"), (F.col("id") % 5).cast("string")).alias("x"))
    return h.select("id", F.array_join(ch.push_bounded(F.col("h"), F.col("x"), 8, unique=True), ",").alias("hashes"), F.array_join(ch.push_bounded(F.col("h"), F.col("x"), 10), ",").alias("times"))


@query("sc19_duration_label", """WITH m AS (SELECT id, CAST(floor(id * 37 % 400000 / 60 + 0.5) AS BIGINT) AS m FROM d_articles)
SELECT id, CASE WHEN m < 1 THEN 'unter 1 Min' WHEN m < 60 THEN concat(m, ' Min') WHEN m // 60 < 48 THEN concat(m // 60, 'h', CASE WHEN m % 60 > 0 THEN concat(' ', m % 60, 'min') ELSE '' END)
 ELSE concat(m // 1440, 'd', CASE WHEN m // 60 % 24 > 0 THEN concat(' ', m // 60 % 24, 'h') ELSE '' END) END AS label FROM m""")
def _(spark, d):
    return derive(spark, d, "articles").select("id", duration_label(F.col("id") * 37 % 400000).alias("label"))


JSON_ROWS = """SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 'broken' ELSE concat('[{"u":"/a', id % 10, '","k":"home"},{"u":"/b","k":"feed","extra":1}]') END AS refs FROM d_articles"""


@query("sc26_json_records", """SELECT id, unnest([0, 1]) AS pos, unnest([concat('/a', id % 10), '/b']) AS u, unnest(['home', 'feed']) AS k FROM d_articles WHERE id % 7 > 1""")
def _(spark, d):
    return json_records(made(spark, d, JSON_ROWS), "refs", "u string, k string").select("id", F.col("pos").cast("bigint").alias("pos"), "u", "k")
