"""Registered queries: URL and page jobs, extraction, sinks, planning, retention, clustering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.q_filters import NOW
from checks.registry import _template, query
from pressdelta.operators import body as bd, changes as ch, clustering as cl, extract as ex, planning as pl, retention as rt, url_jobs as uj
from pressdelta.sources import captures as cp, sinks as sk
from pressdelta.sources.driver_tables import derive, domain, star
from pressdelta.streaming import links as lk

# --- driver pages -----------------------------------------------------------------------------------------------------------
VISIBLE = lambda h: f"CAST(len(regexp_split_to_array({S.trim_ws(f'''regexp_replace({h}, '<[^>]+>', ' ', 'g')''')}, '[{S.WS}]+')) AS BIGINT)"


@query("ex7_page_facts", f"""SELECT page_id, {S.decode(S.trim_ws("regexp_extract(html, '(?i)<title[^>]*>([^<]+)', 1)"))} AS title, {VISIBLE('html')} AS word_count,
 greatest(1, CAST(floor({VISIBLE('html')} / 200.0 + 0.5) AS BIGINT)) AS reading_min, nullif(regexp_extract(html, '(?i)<html[^>]+lang=["'']([a-z]{{2}})', 1), '') AS lang_detected FROM pages""")
def _(spark, d):
    return ex.extract_metadata(star(spark, d, "pages")).select("page_id", "title", "word_count", F.col("reading_min").cast("bigint").alias("reading_min"), "lang_detected")


ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("io8_page_links", f"""
WITH h AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=["'']([^"'']+)["'']', 1)) AS href FROM pages),
r AS (SELECT url, {ORIGIN} AS o, regexp_replace(CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN {ORIGIN} || href WHEN starts_with(href, '#') THEN url ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END, '#.*$', '') AS link FROM h)
SELECT DISTINCT url, link FROM r WHERE starts_with(link, o) AND length(link) > length(o) + 1 AND (substr(link, length(o) + 1, 1) IN ('/', '?', ''))""")
def _(spark, d):
    return cp.page_links(star(spark, d, "pages"))


@query("sc14_hosts", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host, nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '') AS path FROM pages")
def _(spark, d):
    return star(spark, d, "pages").select("page_id", uj.outlet_host(F.col("url")).alias("host"), F.nullif(uj.url_path(F.col("url")), F.lit("")).alias("path"))


def _sql(pattern):
    return pattern.replace("'", "''")


def _plain(e):
    return S.collapse(f"regexp_replace({e}, '{bd.ANY_TAG}', '', 'g')")


_REGIONS = ", ".join(f"CASE WHEN length({_plain(e)}) >= {bd.K.BODY_MIN_CHARS} THEN {e} END" for e in (f"regexp_replace(regexp_extract(q, '{_sql(c)}', 1), '{bd.MARKED_END}', '')" for c in bd.CONTAINERS))


# pages whose articles are made long enough: the text of the page several times
@query("bd1_extract_body", f"""
WITH h AS (SELECT page_id, concat('<main>', repeat(html, 3), '</main>') AS html FROM pages), q AS (SELECT page_id, regexp_replace(regexp_replace(html, '{_sql(bd.SILENT)}', ' ', 'g'), '{_sql(bd.CHROME)}', ' ', 'g') AS q FROM h),
r AS (SELECT page_id, coalesce({_REGIONS}) AS r FROM q),
b AS (SELECT page_id, r, array_to_string(list_filter(list_transform(str_split(regexp_replace(r, '{bd.BLOCK_TAG}', chr(1), 'g'), chr(1)), lambda x: {S.decode(f"regexp_replace(x, '{bd.ANY_TAG}', '', 'g')")}), lambda x: length(x) >= {bd.BLOCK_CHARS}), chr(10) || chr(10)) AS t FROM r)
SELECT page_id, CASE WHEN len(regexp_extract_all(r, '(?i)<a\\b')) / (length({_plain('r')}) / 100.0) <= {bd.LINKS_PER_100} AND length(t) >= {bd.K.BODY_MIN_CHARS} THEN t END AS body FROM b""")
def _(spark, d):
    pages = star(spark, d, "pages").withColumn("html", F.concat(F.lit("<main>"), F.repeat("html", F.lit(3)), F.lit("</main>")))
    return bd.extract_body(pages).select("page_id", "body")


@query("ur7_page_kind", "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title[^>]*>\\s*(404|410|not found|forbidden|access denied)') THEN 'error' ELSE 'section' END AS kind FROM pages")
def _(spark, d):
    return ex.page_kind(bd.extract_body(star(spark, d, "pages"))).select("page_id", "kind")


# --- captures made of the article table ------------------------------------------------------------------------------------------
CAPTURE = """
SELECT id, source_id, url, last_seen AS captured_at, topic, title, description, published_at, modified_at, paywalled, author_status,
 concat('<html lang="', CASE WHEN id % 2 = 0 THEN 'de' ELSE 'fr' END, '"><head><title>Page ', id, ' &amp; more</title>', CASE WHEN title IS NULL THEN '' ELSE concat('<meta property="og:title" content="', title, '"/>') END,
  '<meta content="', description, '" name="description">', CASE WHEN modified_at IS NULL THEN '' ELSE concat('<meta property="article:modified_time" content="', CAST(modified_at AS VARCHAR(40)), '">') END,
  '<script type="application/ld+json">{{"@graph":[{{"@type":["NewsArticle","Report"]', CASE WHEN published_at IS NULL THEN '' ELSE concat(',"datePublished":"', CAST(published_at AS VARCHAR(40)), '"') END,
  CASE WHEN paywalled THEN ',"isAccessibleForFree":false' WHEN NOT paywalled THEN ',"isAccessibleForFree":"True"' ELSE '' END,
  CASE author_status WHEN 'named' THEN ',"author":[{{"name":"Erika Muster"}},"dpa"]' WHEN 'anonymous' THEN ',"author":{{"name":"dpa"}}' ELSE '' END,
  ',"keywords":"Alpha, Beta_', id % 10, '","articleSection":"Sport"}},{{"@type":"BreadcrumbList","itemListElement":[{{"position":3,"name":"T"}},{{"position":2,"name":"Wirtschaft"}},{{"position":1,"name":"Home"}}]}}]}}</script>',
  '<script type="application/ld+json">{{broken</script></head><body><p>', description, ' and some words</p>', CASE WHEN id % 5 = 0 THEN '<div class="disqus"></div>' ELSE '' END, '</body></html>') AS html
FROM ({ARTICLES}) x"""


def captures(spark, d):
    text = CAPTURE.replace("{ARTICLES}", "{articles}").replace("VARCHAR(40)", "STRING")
    # stored captures would be split by files; the made ones are spread so that parsing uses all cores, before the pages are made of them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(text.replace("({articles})", "{articles}"), articles=derive(spark, d, "articles").repartition(parts, "id"))


CAP_SQL = "cap AS MATERIALIZED (" + CAPTURE.replace("{ARTICLES}", "SELECT * FROM d_articles").replace("{{", "{").replace("}}", "}") + ")"


@query("ex3_metadata", f"WITH {CAP_SQL} SELECT id, coalesce(title, 'Page ' || id || ' & more') AS title, description, published_at, published_at IS NOT NULL AS published_precise, modified_at FROM cap")
def _(spark, d):
    return ex.extract_metadata(captures(spark, d).drop("title", "description", "published_at", "modified_at")).select("id", "title", "description", "published_at", "published_precise", "modified_at")


@query("ex5_paywall_type", f"WITH {CAP_SQL} SELECT id, paywalled, 'news' AS article_type, {VISIBLE('html')} AS word_count, CASE WHEN id % 2 = 0 THEN 'de' ELSE 'fr' END AS lang_detected FROM cap")
def _(spark, d):
    return ex.extract_metadata(captures(spark, d).drop("paywalled")).select("id", "paywalled", "article_type", "word_count", "lang_detected")


@query("ex8_authors", f"WITH {CAP_SQL} SELECT id, CASE author_status WHEN 'named' THEN 'Erika Muster|dpa' WHEN 'anonymous' THEN 'dpa' ELSE '' END AS authors, coalesce(author_status, 'none') AS author_status FROM cap")
def _(spark, d):
    return ex.extract_metadata(captures(spark, d).drop("author_status")).select("id", F.array_join("authors", "|").alias("authors"), "author_status")


@query("ex9_keywords_categories", f"WITH {CAP_SQL} SELECT id, 'alpha|beta ' || (id % 10) AS keywords, 'Sport|Wirtschaft' AS categories FROM cap")
def _(spark, d):
    return ex.extract_metadata(captures(spark, d)).select("id", F.array_join("keywords", "|").alias("keywords"), F.array_join("categories", "|").alias("categories"))


@query("ex11_topic", f"WITH {CAP_SQL} SELECT id, coalesce(topic, 'politik') AS topic, CAST(NULL AS VARCHAR) AS rubric FROM cap")
def _(spark, d):
    return ex.extract_metadata(captures(spark, d).drop("topic")).select("id", "topic", "rubric")


@query("ex12_retopic", "SELECT topic AS old_topic, 'politik' AS new_topic, count(*) AS n FROM d_articles WHERE topic IS NULL GROUP BY 1, 2")
def _(spark, d):
    return ex.retopic(domain(spark, d, "articles", "categories", "article_categories"))[1]


@query("ex12_retopic_articles", "SELECT id, coalesce(topic, 'politik') AS topic FROM d_articles")
def _(spark, d):
    return ex.retopic(domain(spark, d, "articles", "categories", "article_categories"))[0].select("id", "topic")


@query("ex13_retype", "SELECT 'news' AS old_type, 'timeline' AS new_type, count(*) AS n FROM d_articles WHERE extension_count >= 2")
def _(spark, d):
    return ex.retype(derive(spark, d, "articles").withColumn("article_type", F.lit(None).cast("string")))[1]


@query("ex14_missing_keywords", """SELECT source_id, id, url FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM d_articles WHERE title IS NOT NULL AND id NOT IN (SELECT article_id FROM d_article_keywords)) WHERE rn <= 5""")
def _(spark, d):
    return ex.missing_keywords(domain(spark, d, "articles", "article_keywords"), 30, 6)


@query("ex15_upsert_dimension", """
WITH v AS (SELECT DISTINCT article_id, term FROM d_article_keywords JOIN d_keywords k ON k.id = keyword_id WHERE keyword_id % 3 = 0)
SELECT term, count(*) AS articles, (SELECT count(*) FROM d_keywords WHERE id % 2 = 0 OR id % 3 = 0 AND id IN (SELECT keyword_id FROM d_article_keywords)) AS dimension FROM v GROUP BY 1""")
def _(spark, d):
    t = domain(spark, d, "keywords", "article_keywords")
    named = t.article_keywords.filter("keyword_id % 3 = 0").join(t.keywords.withColumnRenamed("id", "keyword_id"), "keyword_id")
    values = named.groupBy("article_id").agg(F.collect_list(F.concat(F.lit(" "), "term")).alias("values"))
    dim, links = ex.upsert_dimension(t.keywords.filter("id % 2 = 0"), t.article_keywords.filter("1 = 0"), values, "keyword_id", "term")
    n = dim.agg(F.count("*").alias("n")).select("n").scalar()
    return links.join(dim, links["keyword_id"] == dim["id"]).groupBy("term").agg(F.count("*").alias("articles")).withColumn("dimension", n)


# a graph is not unpacked for the signals: every second page carries its items as a plain list
_LISTED = "CASE WHEN id % 2 = 0 THEN replace(replace(html, '{\"@graph\":[', '['), ']}</script>', ']</script>') ELSE html END"


@query("ex16_page_signals", f"WITH {CAP_SQL} SELECT id, id % 5 = 0 AS has_comments, id % 2 = 0 AND coalesce(paywalled, FALSE) AS paywalled, FALSE AS is_liveblog, CAST(length(regexp_replace(lower({_LISTED}), '<[^>]+>', '', 'g')) AS BIGINT) AS body_chars FROM cap")
def _(spark, d):
    s = ex.page_signals(captures(spark, d).select("id", "url", F.expr(_LISTED).alias("html")))
    return s.select("id", "signals.has_comments", "signals.paywalled", "signals.is_liveblog", F.col("signals.body_chars").cast("bigint").alias("body_chars"))


@query("ex17_backfill_paywall", "SELECT id, CASE WHEN paywalled = FALSE THEN FALSE ELSE TRUE END AS paywalled FROM d_articles")
def _(spark, d):
    return ex.backfill_paywall(derive(spark, d, "articles").withColumn("paywalled", F.lit(True)), captures(spark, d).select("url", "html")).select("id", "paywalled")


# --- URL forms made of the article table --------------------------------------------------------------------------------------------
FORMS = """SELECT id, CASE id % 8 WHEN 0 THEN url WHEN 1 THEN concat(url, '?utm_source=x#ref=rss') WHEN 2 THEN concat('https://s.example/impressum/a-', id + 100000, '.html') WHEN 3 THEN concat('https://s.example/anzeigen/tests/a-', id + 100000, '.html')
 WHEN 4 THEN concat('https://s.example/sport/video-', id + 100000, '.html') WHEN 5 THEN concat('https://s.example/wetter/lage/a-', id, '.html') WHEN 6 THEN concat('https://www.n-tv.de/politik/Headline-id', id + 100000, '.html')
 ELSE concat('https://s.example/sport/', id + 100000, '/') END AS u FROM {A}"""


def forms(spark, d):
    return spark.sql(FORMS.replace("{A}", "{a}"), a=derive(spark, d, "articles"))


FORM_SQL = "f AS (" + FORMS.replace("{A}", "d_articles") + ")"


@query("ur1_canonical_url", f"WITH {FORM_SQL} SELECT id, CASE id % 8 WHEN 1 THEN regexp_replace(u, '\\?.*$', '') WHEN 6 THEN 'https://www.n-tv.de/id' || (id + 100000) || '.html' ELSE u END AS canonical_url FROM f")
def _(spark, d):
    return uj.with_canonical_url(forms(spark, d), "u").select("id", "canonical_url")


@query("ur5_looks_like_article", f"WITH {FORM_SQL} SELECT id, id % 8 NOT IN (2, 4, 5, 7) AS article FROM f")
def _(spark, d):
    return forms(spark, d).select("id", uj.looks_like_article(F.col("u")).alias("article"))


@query("ur6_url_kind", f"WITH {FORM_SQL} SELECT id, CASE id % 8 WHEN 2 THEN 'service' WHEN 3 THEN 'sponsored' WHEN 4 THEN 'media' WHEN 5 THEN 'interactive' WHEN 7 THEN 'unknown' ELSE 'article' END AS kind FROM f")
def _(spark, d):
    return forms(spark, d).select("id", uj.url_kind(F.col("u")).alias("kind"))


@query("ur4_reconcile_reslugs", """SELECT 'article' AS what, id, CASE WHEN id % 50 = 0 THEN replace(url, '/a-', '/renamed-a-') ELSE url END AS text FROM d_articles
UNION ALL SELECT 'page', id, CASE WHEN id % 50 = 0 AND id < 1000000000 THEN 'alias' ELSE kind END FROM d_pages""")
def _(spark, d):
    t = domain(spark, d, "articles", "pages")
    current = t.articles.filter("id % 50 = 0").select("source_id", F.replace("url", F.lit("/a-"), F.lit("/renamed-a-")).alias("url"))
    a, p = uj.reconcile_reslugs(t.articles, t.pages, current, F.regexp_extract("url", r"a-(\d+)\.html$", 1))
    return a.select(F.lit("article").alias("what"), "id", F.col("url").alias("text")).union(p.select(F.lit("page"), "id", "kind"))


@query("ur9_demote", "SELECT 'page' AS what, id, CASE WHEN id % 9 = 0 AND id < 1000000000 THEN 'media' ELSE kind END AS kind FROM d_pages UNION ALL SELECT 'article', id, NULL FROM d_articles WHERE id % 9 <> 0")
def _(spark, d):
    t = domain(spark, d, "articles", "pages")
    t = ch.demote_non_articles(t, t.articles.select("url", F.when(F.col("id") % 9 == 0, "media").otherwise("article").alias("new_kind")))
    return t.pages.select(F.lit("page").alias("what"), "id", "kind").union(t.articles.select(F.lit("article"), "id", F.lit(None).cast("string")))


@query("ch17_sponsored_gate", "SELECT id FROM d_articles WHERE id % 6 <> 0")
def _(spark, d):
    t = domain(spark, d, "articles", "pages")
    t = t.with_(articles=t.articles.withColumn("rubric", F.when(F.col("id") % 6 == 0, F.lit("https://x.example/shopping-und-service/deal/a-123456.html"))))
    return ch.sponsored_gate(t).articles.select("id")


# --- sinks ----------------------------------------------------------------------------------------------------------------------------
@query("io9_upsert", "SELECT id, CASE WHEN id % 7 = 0 THEN 'new ' || id ELSE title END AS title FROM d_articles UNION ALL SELECT id + 1000000, 'new ' || id FROM d_articles WHERE id % 7 = 0")
def _(spark, d):
    a = derive(spark, d, "articles").select("id", "title")
    fresh = a.filter("id % 7 = 0").select("id", F.concat(F.lit("new "), "id").alias("title"))
    return sk.upsert(a, fresh.union(fresh.select(F.col("id") + 1000000, "title")), "id")


@query("io9_insert_if_absent", "SELECT id, title FROM d_articles UNION ALL SELECT id + 1000000, 'new ' || id FROM d_articles WHERE id % 7 = 0")
def _(spark, d):
    a = derive(spark, d, "articles").select("id", "title")
    fresh = a.filter("id % 7 = 0").select("id", F.concat(F.lit("new "), "id").alias("title"))
    return sk.upsert(a, fresh.union(fresh.select(F.col("id") + 1000000, "title")), "id", "ignore")


@query("io10_update_existing", "SELECT id, CASE WHEN id % 7 = 0 THEN 'new ' || id ELSE title END AS title FROM d_articles")
def _(spark, d):
    a = derive(spark, d, "articles").select("id", "title")
    fresh = a.filter("id % 7 = 0").select("id", F.concat(F.lit("new "), "id").alias("title"))
    return sk.update_existing(a, fresh.union(fresh.select(F.col("id") + 1000000, "title")), "id")


@query("io12_cascade_delete", """SELECT 'article' AS what, count(*) AS n FROM d_articles WHERE id % 4 > 0 UNION ALL SELECT 'snapshot', count(*) FROM d_snapshots WHERE article_id % 4 > 0
UNION ALL SELECT 'keyword', count(*) FROM d_article_keywords WHERE article_id % 4 > 0 UNION ALL SELECT 'author', count(*) FROM d_article_authors WHERE article_id % 4 > 0""")
def _(spark, d):
    t = domain(spark, d, "articles", "snapshots", "article_keywords", "article_authors")
    t = sk.delete_articles(t, t.articles.filter("id % 4 = 0").select(F.col("id").alias("article_id")))
    n = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return n(t.articles, "article").union(n(t.snapshots, "snapshot")).union(n(t.article_keywords, "keyword")).union(n(t.article_authors, "author"))


@query("io9_merge_buckets", """SELECT id, CASE WHEN id % 7 = 0 AND id < 3000 THEN 'new ' || id ELSE title END AS title, CASE WHEN id % 7 = 0 AND id < 3000 THEN 0 ELSE word_count END AS word_count FROM d_articles WHERE NOT (id % 11 = 0 AND id < 2000)
UNION ALL SELECT id + 1000000, 'new ' || id, 0 FROM d_articles WHERE id % 7 = 0 AND id < 3000 UNION ALL SELECT id + 2000000, 'late', 1 FROM d_articles WHERE id % 13 = 0 AND id < 500""")
def _(spark, d):
    a = derive(spark, d, "articles").select("id", "title", "word_count")
    t = sk.BucketedTable.create(a, f"articles_{uuid.uuid4().hex}", "id")
    some = a.filter("id % 7 = 0 AND id < 3000")
    fresh = some.select("id", F.concat(F.lit("new "), "id").alias("title"), F.lit(0).cast("bigint").alias("word_count"))
    t.merge(fresh.union(fresh.select(F.col("id") + 1000000, "title", "word_count")))
    # known keys stay, keys that are not there change nothing, deleted ones go
    late = a.filter("id % 13 = 0 AND id < 500").select((F.col("id") + 2000000).alias("id"), F.lit("late").alias("title"), F.lit(1).cast("bigint").alias("word_count"))
    t.merge(late.union(a.filter("id < 100").select("id", F.lit("no"), F.lit(9).cast("bigint"))), "ignore")
    t.merge(a.filter("id < 50").select((F.col("id") + 5000000).alias("id"), F.lit("nowhere").alias("title")), "existing")
    t.merge(a.filter("id % 11 = 0 AND id < 2000").select("id"), "delete")
    return t.rows()


# --- planning ----------------------------------------------------------------------------------------------------------------------------
PT = ("articles", "pages", "sources")
OPEN = "op AS (SELECT p.id, p.url, p.source_id FROM d_pages p WHERE kind = 'article' AND NOT EXISTS (SELECT 1 FROM d_articles a WHERE a.url = p.url AND a.title IS NOT NULL))"
QUOTA = f"""{OPEN}, src AS (SELECT id AS source_id FROM d_sources WHERE active), b AS (SELECT src.source_id, count(op.id) AS backlog FROM src LEFT JOIN op USING (source_id) GROUP BY 1),
fl AS (SELECT *, least(backlog, greatest(20, 900 // (3 * (SELECT count(*) FROM src)))) AS base FROM b),
quota AS (SELECT source_id, backlog, CAST(base + least(backlog - base, floor(greatest(0, 900 - (SELECT sum(base) FROM fl)) * (backlog - base) / greatest((SELECT sum(backlog - base) FROM fl), 1)::DOUBLE)) AS BIGINT) AS quota FROM fl)"""


@query("jn3_open_pages", f"WITH {OPEN} SELECT * FROM op")
def _(spark, d):
    return pl.open_article_pages(domain(spark, d, *PT))


@query("pl1_source_quota", f"WITH {QUOTA} SELECT * FROM quota")
def _(spark, d):
    t = domain(spark, d, *PT)
    return pl.source_quota(pl.open_article_pages(t), pl.active_ids(t), 900)


@query("pl2_select_new", f"WITH {QUOTA}, r AS (SELECT op.*, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS rn FROM op) SELECT r.id, r.url, r.source_id FROM r JOIN quota USING (source_id) WHERE rn <= quota")
def _(spark, d):
    t = domain(spark, d, *PT)
    o = pl.open_article_pages(t)
    return pl.select_new(o, pl.source_quota(o, pl.active_ids(t), 900), 900)


PLAN_NOW = "1999-06-15 12:00:00"
AGO = lambda h: f"(TIMESTAMP '{PLAN_NOW}' - INTERVAL {h} HOUR)"


def _tier(hi, lo, due, n):
    return f"SELECT url, source_id, last_seen, id FROM d_articles WHERE title IS NOT NULL AND last_seen <= {AGO(due)} AND coalesce(published_at, first_seen) BETWEEN {AGO(hi)} AND {AGO(lo)} ORDER BY last_seen, id LIMIT {n}"


LINKED = f"SELECT a.url, a.source_id, a.last_seen, a.id FROM d_articles a JOIN d_pages p ON p.url = a.url WHERE a.title IS NOT NULL AND p.kind = 'article' AND p.last_seen >= {AGO(26)} AND a.last_seen <= {AGO(24)} ORDER BY a.last_seen, a.id LIMIT 80"
OVERDUE = f"SELECT url, source_id, last_seen, id FROM d_articles WHERE title IS NOT NULL AND (published_at >= {AGO(72)} OR first_seen >= {AGO(72)}) ORDER BY last_seen, id LIMIT 100"


@query("pl3_rescan_tier", _tier(2000, 24, 24, 100))
def _(spark, d):
    t = domain(spark, d, *PT)
    return pl.rescan_tier(t, PLAN_NOW, 24, 2000, 24, pl.active_ids(t), 100)


def _stage(name, offers, share, before):
    """SQL of a stage: what it offers without what was taken before, up to its share and what is left of 20."""
    taken = " UNION ALL ".join(f"SELECT url FROM {x}" for x in before) or "SELECT '' AS url WHERE FALSE"
    return f"""{name} AS (SELECT url, source_id, '{name}' AS stage, rn FROM (SELECT url, source_id, row_number() OVER (ORDER BY last_seen, id) AS rn FROM ({offers}) WHERE url NOT IN (SELECT url FROM ({taken}))) WHERE rn <= least({share}, 20 - (SELECT count(*) FROM ({taken}))))"""


@query("pl3_select_rescans", f"""
WITH {_stage("tier1", _tier(24, 0, 1, 1000), 11, [])}, {_stage("tier2", _tier(48, 24, 6, 1000), 6, ["tier1"])}, {_stage("tier3", _tier(72, 48, 24, 1000), 4, ["tier1", "tier2"])},
{_stage("linked", LINKED.replace("LIMIT 80", ""), 20, ["tier1", "tier2", "tier3"])}, {_stage("overdue", OVERDUE.replace("LIMIT 100", ""), 20, ["tier1", "tier2", "tier3", "linked"])}
SELECT * FROM tier1 UNION ALL SELECT * FROM tier2 UNION ALL SELECT * FROM tier3 UNION ALL SELECT * FROM linked UNION ALL SELECT * FROM overdue""")
def _(spark, d):
    return pl.select_rescans(domain(spark, d, *PT), PLAN_NOW, 20)


@query("jn2_linked_stale", LINKED.replace("LIMIT 80", "LIMIT 500").replace("INTERVAL 26 HOUR", "INTERVAL 2600 HOUR"))
def _(spark, d):
    t = domain(spark, d, *PT)
    return pl.linked_stale(t, pl.active_ids(t), "1999-02-27 04:00:00", "1999-06-14 12:00:00", 500)


TOL = "(CASE a.source_id WHEN 1 THEN 72 WHEN 3 THEN 26 WHEN 4 THEN 26 WHEN 5 THEN 6 WHEN 6 THEN 36 ELSE 26 END)"


@query("pl5_drop_gone", f"""SELECT a.url, a.source_id FROM d_articles a LEFT JOIN d_pages p ON p.url = a.url WHERE NOT coalesce(epoch(p.last_seen) - epoch(p.first_seen) > 7200 AND epoch(TIMESTAMP '{PLAN_NOW}') - epoch(p.last_seen) > {TOL} * 3600, FALSE)""")
def _(spark, d):
    t = domain(spark, d, *PT)
    return pl.drop_gone(t.articles.select("url", "source_id"), t.pages, PLAN_NOW)


@query("pl6_fill_queue", f"""WITH {OPEN}, q AS (SELECT url, source_id FROM op WHERE id % 3 = 0 AND id < 1000000000), fr AS (SELECT url, source_id, row_number() OVER (ORDER BY id DESC) AS rn FROM op WHERE url NOT IN (SELECT url FROM q))
SELECT url, source_id, 'queued' AS origin FROM q UNION ALL SELECT url, source_id, 'backlog' FROM fr WHERE rn <= greatest(0, 700 - (SELECT count(*) FROM q))""")
def _(spark, d):
    o = pl.open_article_pages(domain(spark, d, *PT))
    return pl.fill_queue(o.filter("id % 3 = 0 AND id < 1000000000").select("url", "source_id"), o, 700)


@query("pl7_select_enrich", """
WITH g AS (SELECT * FROM d_articles WHERE title IS NULL OR published_at IS NULL), q AS (SELECT source_id, greatest(10, CAST(floor(count(*) / (SELECT greatest(1, count(*)) FROM g)::DOUBLE * 400 + 0.5) AS BIGINT)) AS quota FROM g GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY title IS NOT NULL, first_seen DESC, id) AS rn FROM g) SELECT id, url, r.source_id FROM r JOIN q USING (source_id) WHERE rn <= quota""")
def _(spark, d):
    return pl.select_enrich(domain(spark, d, *PT), 400)


# --- retention ------------------------------------------------------------------------------------------------------------------------------
@query("rt1_stale_articles", f"SELECT id AS article_id FROM d_articles WHERE last_seen < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND id NOT IN (SELECT article_id FROM d_snapshots)")
def _(spark, d):
    return rt.stale_articles(domain(spark, d, "articles", "snapshots"), NOW)


@query("rt2_cap_extensions", "SELECT id, change_kind FROM (SELECT *, row_number() OVER (PARTITION BY article_id, change_kind ORDER BY captured_at DESC, id DESC) AS rn FROM d_snapshots) WHERE change_kind <> 'extension' OR rn <= 2")
def _(spark, d):
    return rt.cap_extensions(derive(spark, d, "snapshots"), 2).select("id", "change_kind")


@query("rt3_trim_payload", f"SELECT id, CASE WHEN captured_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN added END AS added FROM d_snapshots")
def _(spark, d):
    return rt.trim_payload(derive(spark, d, "snapshots"), NOW).select("id", "added")


@query("rt4_drop_dormant_paras", f"SELECT article_id FROM d_versions v WHERE seq = 0 AND article_id NOT IN (SELECT id FROM d_articles WHERE last_seen < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND id % 2 = 0)")
def _(spark, d):
    paras = derive(spark, d, "versions").filter("seq = 0").select("article_id", F.array("body").alias("paras"))
    t = domain(spark, d, "articles").with_(article_paras=paras)
    return rt.drop_dormant_paras(t.with_(articles=t.articles.filter("id % 2 = 0")), NOW).select("article_id")


@query("rt5_old_sightings", "SELECT source_id, date_trunc('minute', t) AS minute, count(*) AS n FROM (SELECT run_id, source_id, article_url, min(seen_at) AS t FROM d_link_observations GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING date_trunc('minute', any_value(t)) >= TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 35 DAY")
def _(spark, d):
    return rt.drop_old_sightings(lk.sighting_counts(derive(spark, d, "link_observations")), "2024-02-20 00:00:00")


@query("rt_prune", f"""WITH gone AS (SELECT id FROM d_articles WHERE last_seen < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND id NOT IN (SELECT article_id FROM d_snapshots)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, change_kind ORDER BY captured_at DESC, id DESC) AS rn FROM d_snapshots) WHERE change_kind <> 'extension' OR rn <= 2)
SELECT 'articles' AS what, count(*) AS n FROM d_articles WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'snapshots', count(*) FROM s UNION ALL SELECT 'texts', count(*) FROM s WHERE captured_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND added IS NOT NULL
UNION ALL SELECT 'keywords', count(*) FROM d_article_keywords WHERE article_id NOT IN (SELECT id FROM gone)""")
def _(spark, d):
    t = rt.prune(domain(spark, d, "articles", "snapshots", "article_keywords"), NOW, 2)
    n = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    # both counts of snapshots in one pass
    counts = t.snapshots.agg(F.count("*").alias("n"), F.count("added").alias("texts")).select(F.inline(F.array(F.struct(F.lit("snapshots").alias("what"), "n"), F.struct(F.lit("texts").alias("what"), F.col("texts").alias("n")))))
    return n(t.articles, "articles").union(counts).union(n(t.article_keywords, "keywords"))


# --- links -----------------------------------------------------------------------------------------------------------------------------------
REFS = """refs AS (SELECT run_id, article_url, ref_url, min((seen_at, ref_kind)) AS m FROM d_link_observations GROUP BY 1, 2, 3),
rk AS (SELECT run_id, article_url AS url, ref_url, m[2] AS kind, row_number() OVER (PARTITION BY run_id, article_url ORDER BY CASE m[2] WHEN 'home' THEN 0 WHEN 'section' THEN 1 WHEN 'feed' THEN 2 ELSE 3 END, m[1], ref_url) AS rn FROM refs)"""


@query("sg2_link_refs", f"WITH {REFS.replace('min((seen_at, ref_kind)) AS m', 'min(seen_at) AS s, min_by(ref_kind, (seen_at, ref_kind)) AS kd').replace('m[2]', 'kd').replace('m[1]', 's')} SELECT run_id, url, string_agg(ref_url || ':' || kind, ',' ORDER BY rn) AS refs FROM rk WHERE rn <= 6 GROUP BY 1, 2")
def _(spark, d):
    r = lk.link_refs(derive(spark, d, "link_observations"))
    return r.select("run_id", "url", F.array_join(F.transform("refs", lambda x: F.concat(x["u"], F.lit(":"), x["k"])), ",").alias("refs"))


@query("sc25_cap_refs", f"WITH {REFS.replace('min((seen_at, ref_kind)) AS m', 'min(seen_at) AS s, min_by(ref_kind, (seen_at, ref_kind)) AS kd').replace('m[2]', 'kd').replace('m[1]', 's')} SELECT run_id, url, string_agg(ref_url || ':' || kind, ',' ORDER BY rn) AS refs FROM rk WHERE rn <= 2 GROUP BY 1, 2")
def _(spark, d):
    r = lk.link_refs(derive(spark, d, "link_observations"), None).withColumn("refs", lk.cap_refs(F.reverse("refs"), 2))
    return r.select("run_id", "url", F.array_join(F.transform("refs", lambda x: F.concat(x["u"], F.lit(":"), x["k"])), ",").alias("refs"))


@query("sg3_link_state", "SELECT article_url, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS sightings, epoch(max(seen_at)) - epoch(min(seen_at)) > 7200 AS link_resighted FROM d_link_observations GROUP BY 1")
def _(spark, d):
    return lk.link_state(derive(spark, d, "link_observations"))


# --- clusters ----------------------------------------------------------------------------------------------------------------------------------
SIMS = """p AS (SELECT a.vec_id AS article_id, b.vec_id AS neighbour_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(s, 9) DESC, neighbour_id) AS rn FROM p WHERE s >= 0.35)"""


def neighbours(spark, d):
    v = star(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")
    return cl.similar_pairs(v, 10, 0.35)


@query("cl1_similar_pairs", f"WITH {SIMS} SELECT article_id, neighbour_id, round(s, 6) AS similarity, rn FROM nn WHERE rn <= 10")
def _(spark, d):
    return neighbours(spark, d).withColumns({"similarity": F.round("similarity", 6), "rn": F.col("rn").cast("bigint")})


# one article after the other: `who` has a cluster, `cl` is it, `sim` the similarity it came with
@query("cl2_assign_clusters", f"""WITH RECURSIVE {SIMS}, near AS MATERIALIZED (SELECT article_id, list(neighbour_id ORDER BY rn) AS ids, list(s ORDER BY rn) AS sims FROM nn WHERE rn <= 10 GROUP BY 1),
todo AS MATERIALIZED (SELECT article_id, coalesce(ids, []) AS ids, coalesce(sims, []) AS sims, row_number() OVER (ORDER BY article_id) AS step
 FROM (SELECT DISTINCT unnest(list_append(ids, article_id)) AS article_id FROM near) LEFT JOIN near USING (article_id)),
go AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS who, []::BIGINT[] AS cl, []::DOUBLE[] AS sim UNION ALL
 SELECT step, CASE WHEN done THEN who ELSE list_concat(list_append(who, article_id), list_filter(ids, lambda x: NOT list_contains(who, x))) END,
  CASE WHEN done THEN cl ELSE list_concat(list_append(cl, target), list_transform(list_filter(ids, lambda x: NOT list_contains(who, x)), lambda x: target)) END,
  CASE WHEN done THEN sim ELSE list_concat(list_append(sim, 1.0::DOUBLE), list_transform(list_filter(ids, lambda x: NOT list_contains(who, x)), lambda x: sims[list_position(ids, x)])) END
 FROM (SELECT t.step, t.article_id, t.ids, t.sims, go.who, go.cl, go.sim, list_contains(go.who, t.article_id) AS done,
        coalesce(go.cl[list_position(go.who, list_filter(t.ids, lambda x: list_contains(go.who, x))[1])], t.article_id) AS target FROM go JOIN todo t ON t.step = go.step + 1))
SELECT unnest(cl) AS cluster_id, unnest(who) AS article_id, round(unnest(sim), 6) AS similarity FROM go WHERE step = (SELECT max(step) FROM todo)""")
def _(spark, d):
    return cl.assign_clusters(neighbours(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("sg5_sync_corpus", f"""SELECT id, last_seen, scan_count FROM d_corpus WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY OR (published_at IS NULL AND discovered_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY) OR last_seen >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY""")
def _(spark, d):
    from checks.q_filters import corpus
    from pressdelta.streaming import sync
    c = corpus(spark, d)
    # cached: an older state, without the newest scans and with outdated counters where a later scan exists
    cached = c.filter(F.col("last_seen") < "2001-06-01")
    return sync.sync_corpus(cached, c, NOW, 400).select("id", "last_seen", "scan_count")


@query("sg5_sync_files", f"""SELECT id, last_seen, scan_count FROM d_corpus WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY OR (published_at IS NULL AND discovered_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY) OR last_seen >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY""")
def _(spark, d):
    from checks.q_filters import corpus
    from pressdelta.plans.patterns import scratch_path
    from pressdelta.streaming import sync
    path = scratch_path(spark, "corpus-files")
    # scans lie in files by time, as they come in
    corpus(spark, d).repartitionByRange(16, "last_seen").write.parquet(path)
    source = sync.FileSync(spark, path)
    c = spark.read.parquet(path)
    return source.sync(c.filter(F.col("last_seen") < "2001-06-01"), NOW, 400).select("id", "last_seen", "scan_count")


@query("sg6_date_bounds", f"WITH s AS (SELECT url, published_at + (id % 11 - 5) * INTERVAL 1 HOUR AS d_at, id % 3 > 0 AS precise FROM d_articles) SELECT url, min(d_at) FILTER (precise) AS lo, max(d_at) FILTER (precise) AS hi, min(d_at) FILTER (NOT precise) AS guess FROM s GROUP BY 1")
def _(spark, d):
    return ch.date_bounds(derive(spark, d, "articles").selectExpr("url", "published_at + (id % 11 - 5) * INTERVAL 1 HOUR AS at", "id % 3 > 0 AS precise"))
