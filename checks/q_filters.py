"""Registered queries: loading, filters, search, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import berlin_day, query
from pressdelta.operators import filters as fl, keywords as kw, search as sr
from pressdelta.operators.filters import FilterParams
from pressdelta.sources import tables as tb
from pressdelta.sources.driver_tables import derive, domain

NOW = "2001-08-20 00:00:00"


def overview(spark, d):
    return tb.flat_overview(derive(spark, d, "articles"), derive(spark, d, "sources"))


def corpus(spark, d, now=None):
    return tb.corpus(overview(spark, d), now)


IDS = ("id", "source_id", "url", "title", "published_at", "first_seen", "last_seen", "paywalled", "word_count", "revision_count", "is_article")


@query("io1_load_tables", f"SELECT {', '.join(IDS)}, CAST(NULL AS VARCHAR) AS og_image FROM d_articles")
def _(spark, d):
    return tb.conform(derive(spark, d, "articles"), tb.SCHEMAS["articles"]).select(*IDS, "og_image")


@query("io2_scan", "SELECT id, url FROM d_articles")
def _(spark, d):
    return tb.scan(derive(spark, d, "articles"), "id", "url")


@query("jn1_page_overview", """
SELECT p.id, a.id AS article_id, p.source_id, p.url, CASE WHEN p.kind <> 'article' THEN p.kind WHEN article_type = 'timeline' THEN 'timeline' WHEN paywalled THEN 'paywall' ELSE 'artikel' END AS ptype,
       s.language, a.first_seen AS discovered_at, p.last_seen AS link_seen, coalesce(epoch(p.last_seen) - epoch(p.first_seen) > 7200, FALSE) AS link_resighted, a.title IS NOT NULL AS analyzed
FROM d_pages p LEFT JOIN d_articles a ON a.url = p.url JOIN d_sources s ON s.id = p.source_id""")
def _(spark, d):
    cols = ("id", "article_id", "source_id", "url", "ptype", "language", "discovered_at", "link_seen", "link_resighted", "analyzed")
    return tb.page_overview(domain(spark, d, "pages", "articles", "sources")).select(*cols)


@query("fl1_corpus", f"""
SELECT id, article_id, source_id, url, ptype, topic, author_status, paywalled, language, published_at, discovered_at, last_seen, link_seen, link_resighted,
       word_count, revision_count, edit_count, scan_count, CAST(rubric AS VARCHAR) AS rubric
FROM d_corpus WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 35 DAY OR (published_at IS NULL AND discovered_at >= TIMESTAMP '{NOW}' - INTERVAL 35 DAY)
   OR last_seen >= TIMESTAMP '{NOW}' - INTERVAL 35 DAY""")
def _(spark, d):
    return corpus(spark, d, NOW)


RANGE = ("1998-03-01 00:00:00", "1999-02-28 22:59:59")
FL2 = {
    "none": (FilterParams(), "TRUE"),
    "paywall_yes": (FilterParams(paywall="yes"), "paywalled"),
    "paywall_no": (FilterParams(paywall="no"), "NOT paywalled"),
    "author_named": (FilterParams(author="named"), "author_status = 'named'"),
    "changed_yes": (FilterParams(changed="yes"), "revision_count >= 1"),
    "changed_no": (FilterParams(changed="no"), "(revision_count IS NULL OR revision_count = 0)"),
    "depth_kurz": (FilterParams(depth="kurz"), "word_count > 0 AND word_count < 300"),
    "depth_mittel": (FilterParams(depth="mittel"), "word_count >= 300 AND word_count <= 900"),
    "depth_lang": (FilterParams(depth="lang"), "word_count > 900"),
    "lang_fr": (FilterParams(lang="fr"), "language = 'fr'"),
    "type_timeline": (FilterParams(ptype="timeline"), "ptype IN ('timeline', 'blog')"),
    "type_paywall": (FilterParams(ptype="paywall"), "ptype = 'paywall'"),
    "status_new": (FilterParams(status="new"), "scan_count <= 1"),
    "status_rescanned": (FilterParams(status="rescanned"), "scan_count >= 2"),
    "topics": (FilterParams(topics=("sport", "politik")), "topic IN ('sport', 'politik')"),
    "hide_regional": (FilterParams(hide_regional=True), "coalesce(topic, '') <> 'regional'"),
    "range_published": (FilterParams(range_from=RANGE[0], range_to=RANGE[1]), f"coalesce(published_at, discovered_at) BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'"),
    "range_seen": (FilterParams(range_from=RANGE[0], range_to=RANGE[1], axis="seen"), f"coalesce(last_seen, discovered_at) BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'"),
    "rubric": (FilterParams(rubrics=("sport", "politik/ausland")), "(contains(lower(url), '/sport/') OR contains(lower(url), '/politik/ausland/'))"),
    "sources": (FilterParams(sources=(1, 5)), "source_id IN (1, 5)"),
    "range_paywall_changed": (FilterParams(range_from=RANGE[0], range_to=RANGE[1], paywall="yes", changed="yes"),
                              f"coalesce(published_at, discovered_at) BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' AND paywalled AND revision_count >= 1"),
}


def _fl2(name, params, where):
    @query(f"fl2_{name}", f"SELECT id, source_id, topic FROM d_corpus WHERE {where}")
    def _(spark, d):
        return fl.filter_corpus(corpus(spark, d), params).select("id", "source_id", "topic")


for _name, (_p, _w) in FL2.items():
    _fl2(_name, _p, _w)


@query("fl2_link_gone", "SELECT id, c.source_id FROM d_corpus c JOIN d_cuts k ON k.source_id = c.source_id WHERE link_seen < cut AND link_resighted")
def _(spark, d):
    return fl.filter_corpus(corpus(spark, d), FilterParams(link_state="gone")).select("id", "source_id")


@query("fl2_link_online", "SELECT id, c.source_id FROM d_corpus c JOIN d_cuts k ON k.source_id = c.source_id WHERE link_seen >= cut")
def _(spark, d):
    return fl.filter_corpus(corpus(spark, d), FilterParams(link_state="online")).select("id", "source_id")


@query("fl2_keyword_ids", """
SELECT id, source_id FROM d_corpus WHERE article_id IN (SELECT article_id FROM d_article_keywords JOIN d_keywords k ON k.id = keyword_id WHERE term = (SELECT term FROM d_keywords WHERE id = 7))""")
def _(spark, d):
    t = domain(spark, d, "keywords", "article_keywords")
    term = t.keywords.filter("id = 7").select("term").scalar()
    key = t.keywords.filter(F.col("term") == term)
    return fl.filter_corpus(corpus(spark, d), FilterParams(), t.article_keywords.join(key, key["id"] == F.col("keyword_id"), "left_semi")).select("id", "source_id")


ARTICLE_WHERE = "is_article AND coalesce(scan_count, 1) <= 1 AND coalesce(revision_count, 0) = 0 AND word_count > 900"


@query("fl3_article_predicate", f"SELECT a.id FROM d_articles a JOIN d_sources s ON s.id = a.source_id WHERE {ARTICLE_WHERE} AND s.language = 'de'")
def _(spark, d):
    p = FilterParams(status="new", changed="no", depth="lang", lang="de")
    return fl.select_articles(domain(spark, d, "articles", "sources"), p).select("id")


@query("fl4_depth_classes", """
SELECT CASE WHEN word_count > 900 THEN 'lang' WHEN word_count >= 300 THEN 'mittel' WHEN word_count > 0 THEN 'kurz' END AS depth_class, count(*) AS n FROM d_corpus GROUP BY 1""")
def _(spark, d):
    w = F.col("word_count")
    c = F.when(fl.depth_class(w, "lang"), "lang").when(fl.depth_class(w, "mittel"), "mittel").when(fl.depth_class(w, "kurz"), "kurz")
    return corpus(spark, d).groupBy(c.alias("depth_class")).agg(F.count("*").alias("n"))


def _search_sql(q):
    return f"""SELECT a.id AS article_id FROM d_articles a WHERE is_article AND (title ILIKE '%{q}%' OR url ILIKE '%{q}%' OR description ILIKE '%{q}%' OR coalesce(topic, '') ILIKE '%{q}%'
      OR EXISTS (SELECT 1 FROM d_article_keywords ak JOIN d_keywords k ON k.id = ak.keyword_id WHERE ak.article_id = a.id AND k.term ILIKE '%{q}%')
      OR EXISTS (SELECT 1 FROM d_article_categories ac JOIN d_categories c ON c.id = ac.category_id WHERE ac.article_id = a.id AND c.name ILIKE '%{q}%'))"""


SEARCH_TABLES = ("articles", "keywords", "article_keywords", "categories", "article_categories")


@query("fl6_search", _search_sql("URGENT"))
def _(spark, d):
    return fl.search_articles(domain(spark, d, *SEARCH_TABLES), "URGENT")


@query("fl6_search_keyword", _search_sql("blue plate"))
def _(spark, d):
    return fl.search_articles(domain(spark, d, *SEARCH_TABLES), "blue plate", limit=None)


@query("fl7_keyword_ids", "SELECT article_id FROM d_article_keywords JOIN d_keywords k ON k.id = keyword_id WHERE term = (SELECT min(term) FROM d_keywords)")
def _(spark, d):
    t = domain(spark, d, "keywords", "article_keywords")
    key = t.keywords.filter(F.col("term") == t.keywords.agg(F.min("term")).scalar()).select(F.col("id").alias("keyword_id"))
    return t.article_keywords.join(key, "keyword_id", "left_semi").select("article_id")


@query("fl8_pin", f"""
SELECT id, published_at FROM d_corpus WHERE coalesce(published_at, discovered_at) BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' AND source_id = 3 AND topic = 'sport'
ORDER BY published_at NULLS LAST, id LIMIT 25""")
def _(spark, d):
    return fl.pin(corpus(spark, d), *RANGE, source=3, topic="sport", first_n=25).select("id", "published_at")


@query("fl9_contains_filter", "SELECT id FROM d_corpus WHERE contains(lower(CAST(word_count AS VARCHAR)), '99')")
def _(spark, d):
    return fl.contains_filter(corpus(spark, d), "word_count", "99").select("id")


@query("fl10_effective_published", "SELECT id, CASE WHEN published_at > discovered_at THEN discovered_at ELSE published_at END AS published_eff FROM d_corpus")
def _(spark, d):
    return fl.with_effective_published(corpus(spark, d)).select("id", "published_eff")


@query("fl11_scan_span", """
SELECT id, f AS first_scan, CAST(coalesce(floor((epoch(last_seen) - epoch(f)) / 86400 + 0.5), 0) AS BIGINT) AS observed_days
FROM (SELECT *, CASE WHEN coalesce(scan_count, 1) <= 1 THEN coalesce(last_seen, discovered_at) ELSE discovered_at END AS f FROM d_corpus)""")
def _(spark, d):
    return fl.scan_span(corpus(spark, d)).select("id", "first_scan", "observed_days")


@query("os1_online_cuts", "SELECT source_id, cut AS link_cut FROM d_cuts")
def _(spark, d):
    return fl.online_cuts(corpus(spark, d))


@query("se1_search_many", f"""
SELECT 'URGENT' AS term, count(*) AS n FROM ({_search_sql('URGENT')}) UNION ALL SELECT 'sport', count(*) FROM ({_search_sql('sport')})
UNION ALL SELECT 'any', count(*) FROM ({_search_sql('URGENT')} UNION {_search_sql('sport')})""")
def _(spark, d):
    hits = fl.search_many(domain(spark, d, *SEARCH_TABLES), ("URGENT", "sport"), limit=None)
    return hits.groupBy("term").agg(F.count("*").alias("n")).union(hits.agg(F.lit("any"), F.countDistinct("article_id")))


@query("se1_indexed_search", " UNION ALL ".join(f"SELECT '{q}' AS term, article_id FROM ({_search_sql(q)})" for q in ("URGENT", "blue plate", "7.", "ic")))
def _(spark, d):
    t = domain(spark, d, *SEARCH_TABLES)
    # the newest articles come as a delta
    old, new = (sr.units(t).filter(F.expr(f"{no} (kind = 'article' AND id % 10 = 3)")) for no in ("NOT", ""))
    return sr.SearchIndex(spark).add(old).add(new).search(t, ("URGENT", "blue plate", "7.", "ic", "x"))


@query("se2_restrict_ids", f"SELECT article_id FROM ({_search_sql('URGENT')}) INTERSECT SELECT article_id FROM d_article_keywords WHERE keyword_id % 2 = 0")
def _(spark, d):
    t = domain(spark, d, *SEARCH_TABLES)
    return fl.restrict_ids(fl.search_articles(t, "URGENT", limit=None), t.article_keywords.filter("keyword_id % 2 = 0"))


# --- keywords -----------------------------------------------------------------------------------------------------
KWT = ("articles", "sources", "keywords", "article_keywords")
TRENDS = f"""
arts AS (SELECT id, coalesce(published_at, first_seen) AS t FROM d_articles WHERE is_article),
daily AS (SELECT keyword_id, {berlin_day('t')} AS d, count(*) AS n FROM arts JOIN d_article_keywords ON article_id = id WHERE t IS NOT NULL GROUP BY 1, 2),
top AS (SELECT keyword_id, term, CAST(sum(n) AS BIGINT) AS total FROM daily JOIN d_keywords k ON k.id = keyword_id GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 300),
trends AS (SELECT term, total, d, n FROM top JOIN daily USING (keyword_id))"""
ALL_TRENDS = TRENDS.replace(" ORDER BY 3 DESC, 2 LIMIT 300", "")


@query("kw2_keyword_trends", f"WITH {TRENDS} SELECT term, total, d, n FROM trends")
def keyword_trends(spark, d):
    return kw.keyword_trends(domain(spark, d, *KWT), limit=300)


def all_trends(spark, d):
    return kw.keyword_trends(domain(spark, d, *KWT))


@query("kw2_keyword_trends_filtered", f"""
WITH arts AS (SELECT a.id, coalesce(last_seen, first_seen) AS t FROM d_articles a JOIN d_sources s ON s.id = a.source_id WHERE is_article AND NOT paywalled AND topic IN ('sport', 'politik')
   AND language = 'de' AND coalesce(scan_count, 1) >= 2),
daily AS (SELECT term, {berlin_day('t')} AS d, count(*) AS n FROM arts JOIN d_article_keywords ON article_id = arts.id JOIN d_keywords k ON k.id = keyword_id
   WHERE t BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' GROUP BY 1, 2),
top AS (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT term, total, d, n FROM top JOIN daily USING (term)""")
def _(spark, d):
    p = FilterParams(paywall="no", topics=("sport", "politik"), lang="de", status="rescanned", axis="seen", range_from=RANGE[0], range_to=RANGE[1])
    return kw.keyword_trends(domain(spark, d, *KWT), p, 50)


@query("kw1_keyword_opts", f"""
WITH agg AS (SELECT keyword_id, count(*) AS n FROM d_article_keywords JOIN d_articles a ON a.id = article_id WHERE {ARTICLE_WHERE.replace('word_count > 900', 'TRUE')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80)
SELECT term, n FROM agg JOIN d_keywords k ON k.id = keyword_id""")
def _(spark, d):
    return kw.keyword_opts(domain(spark, d, *KWT), FilterParams(status="new", changed="no"))


SPAN = ("1998-01-01", "1999-12-31")
METRICS = ALL_TRENDS + f""",
days AS (SELECT CAST(range AS DATE) AS d, row_number() OVER (ORDER BY range) - 1 AS i, count(*) OVER () AS nd FROM range(TIMESTAMP '{SPAN[0]}', TIMESTAMP '{SPAN[1]} 12:00:00', INTERVAL 1 DAY)),
filled AS (SELECT term, days.d, i, nd, coalesce(n, 0) AS n FROM (SELECT DISTINCT term FROM trends) CROSS JOIN days LEFT JOIN trends USING (term, d)),
m0 AS (SELECT term, sum(n) AS total, sum(CASE WHEN i < nd // 2 THEN n ELSE 0 END) AS f, sum(CASE WHEN i >= nd - nd // 2 THEN n ELSE 0 END) AS s2, regr_slope(n, i) AS slope, avg(n) AS mean,
        max(n) AS peak_val, min_by(d, (-n, d)) AS peak_day, stddev_pop(n) AS std, count(*) FILTER (n > 0) AS active_days FROM filled GROUP BY term HAVING sum(n) > 0),
metrics AS (SELECT term, CAST(total AS BIGINT) AS total, CAST(f AS BIGINT) AS "first", CAST(s2 AS BIGINT) AS "second", CAST(s2 - f AS BIGINT) AS delta, CASE WHEN f > 0 THEN (s2 - f) / f::DOUBLE * 100 END AS pct,
        slope, mean, peak_val, peak_day, CASE WHEN std > 0 THEN (peak_val - mean) / std ELSE 0 END AS spike, active_days, total / (SELECT sum(total) FROM top)::DOUBLE AS share,
        f / (sum(f) OVER ())::DOUBLE AS share_first, s2 / (sum(s2) OVER ())::DOUBLE AS share_second, s2 / (sum(s2) OVER ())::DOUBLE - f / (sum(f) OVER ())::DOUBLE AS share_delta FROM m0)"""
DBL = ("pct", "slope", "mean", "spike", "share", "share_first", "share_second", "share_delta")


def metrics(spark, d):
    return kw.keyword_metrics(all_trends(spark, d), *SPAN)


@query("kw3_keyword_metrics", f"WITH {METRICS} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in DBL)}) FROM metrics")
def _(spark, d):
    return metrics(spark, d).withColumns({c: F.round(c, 6) for c in DBL})


@query("kw3_zero_filled", f"WITH {METRICS} SELECT term, d, n FROM filled WHERE term IN (SELECT term FROM trends)")
def _(spark, d):
    return kw.zero_filled(all_trends(spark, d), *SPAN)


@query("kw4_share_movement", f"WITH {METRICS} SELECT term, round(share_first, 6) AS share_first, round(share_second, 6) AS share_second, round(share_delta, 6) AS share_delta FROM metrics")
def _(spark, d):
    return metrics(spark, d).select("term", *[F.round(c, 6).alias(c) for c in ("share_first", "share_second", "share_delta")])


def _movers_sql(col):
    return f"""WITH {METRICS}, up AS (SELECT 'riser' AS direction, row_number() OVER (ORDER BY {col} DESC, term) AS rank, term, total, round({col}, 6) AS move FROM metrics WHERE {col} > 0 AND total >= 3),
down AS (SELECT 'faller', row_number() OVER (ORDER BY {col}, term), term, total, round({col}, 6) FROM metrics WHERE {col} < 0 AND total >= 3)
SELECT * FROM (SELECT * FROM up UNION ALL SELECT * FROM down) WHERE rank <= 10"""


@query("kw5_movers", _movers_sql("delta"))
def _(spark, d):
    return kw.movers(metrics(spark, d)).withColumn("move", F.round("move", 6))


@query("kw5_movers_share", _movers_sql("share_delta"))
def _(spark, d):
    return kw.movers(metrics(spark, d), "share").withColumn("move", F.round("move", 6))


@query("kw5_chart_terms", f"WITH {METRICS} SELECT term, total, CAST(abs(delta) AS DOUBLE) AS weight FROM metrics WHERE total >= 3 ORDER BY 3 DESC, 1 LIMIT 6")
def _(spark, d):
    return kw.chart_terms(metrics(spark, d))


@query("kw6_keyword_dfs", "SELECT keyword_id, count(*) AS df FROM d_article_keywords GROUP BY 1")
def _(spark, d):
    return kw.keyword_dfs(domain(spark, d, "article_keywords"))


@query("kw7_cloud_weights", """
WITH agg AS (SELECT keyword_id, count(*) AS n FROM d_article_keywords JOIN d_articles a ON a.id = article_id WHERE is_article GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 80)
SELECT term, n, round((sqrt(n) - sqrt(min(n) OVER ())) / (sqrt(max(n) OVER ()) - sqrt(min(n) OVER ())), 6) AS weight FROM agg JOIN d_keywords k ON k.id = keyword_id""")
def _(spark, d):
    return kw.cloud_weights(kw.keyword_opts(domain(spark, d, *KWT))).withColumn("weight", F.round("weight", 6))


@query("kw8_article_terms", """
SELECT article_id, string_agg(term, '|' ORDER BY keyword_id) AS terms, string_agg(term, '|' ORDER BY keyword_id) FILTER (rn <= 6) AS shown
FROM (SELECT article_id, keyword_id, term, row_number() OVER (PARTITION BY article_id ORDER BY keyword_id) AS rn FROM d_article_keywords JOIN d_keywords k ON k.id = keyword_id) GROUP BY 1""")
def _(spark, d):
    t = kw.article_terms(domain(spark, d, "keywords", "article_keywords"))
    return t.select("article_id", F.array_join("terms", "|").alias("terms"), F.array_join("shown", "|").alias("shown"))


@query("sc27_series_json", f"""WITH {TRENDS} SELECT term, total, '[' || string_agg('{{"d":"' || CAST(d AS VARCHAR) || '","n":' || n || '}}', ',' ORDER BY d) || ']' AS series FROM trends GROUP BY 1, 2""")
def _(spark, d):
    return kw.series_json(kw.trend_series(keyword_trends(spark, d)))


@query("nb1_neighbours", """
WITH df AS (SELECT keyword_id, count(*) AS df FROM d_article_keywords GROUP BY 1),
mine AS (SELECT article_id, keyword_id, df FROM d_article_keywords JOIN df USING (keyword_id)),
pairs AS (SELECT m.article_id, o.article_id AS neighbour_id, sum(1 / sqrt(df)) AS score, count(*) AS shared FROM mine m JOIN d_article_keywords o USING (keyword_id) WHERE m.article_id <> o.article_id GROUP BY 1, 2 HAVING count(*) >= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, neighbour_id) AS rn FROM pairs)
SELECT b.article_id, neighbour_id, rn, round(score, 6) AS score, shared, n.title, n.outlet, n.country, n.source_id <> a.source_id AS "cross"
FROM best b JOIN d_corpus n ON n.article_id = neighbour_id JOIN d_corpus a ON a.article_id = b.article_id WHERE rn <= 8""")
def _(spark, d):
    ov = overview(spark, d).filter(F.col("ptype").isin(*tb.K.ALLOWED_PTYPES))
    return kw.neighbours(domain(spark, d, "article_keywords"), ov).withColumn("score", F.round("score", 6))
