"""Registered queries: figures over the corpus, series, context, table views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_filters import NOW, RANGE, corpus, overview
from checks.registry import berlin, berlin_day, query, utc
from pressdelta.functions import timeutil as tu
from pressdelta.operators import context as cx, dashboards as db, filters as fl, keywords as kw, series as sr, url_jobs as uj
from pressdelta.plans.patterns import global_rank
from pressdelta.operators.filters import FilterParams
from pressdelta.sources.driver_tables import derive, domain

P = FilterParams(range_from="1998-01-01 00:00:00", range_to="1999-12-31 22:59:59")
EFF = "coalesce(published_at, discovered_at)"
INR = f"{EFF} BETWEEN '1998-01-01 00:00:00' AND '1999-12-31 22:59:59'"
PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST(floor(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100 + 0.5) AS BIGINT) ELSE 0 END"
HALF = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"


def rounded(df, *cols, k=6):
    return df.withColumns({c: F.round(c, k) for c in cols})


@query("pb1_pulse", f"""
WITH r AS (SELECT *, coalesce(topic, 'sonstiges') AS tp, {berlin_day(EFF)} AS day FROM d_corpus WHERE {INR}),
days AS (SELECT day, count(*) AS n, row_number() OVER (ORDER BY day DESC) AS rn FROM r GROUP BY day),
src AS (SELECT source_id, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), top AS (SELECT tp, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
pace AS (SELECT sum(n) FILTER (rn <= 7) AS recent, sum(n) FILTER (rn BETWEEN 8 AND 14) AS prior FROM days)
SELECT count(*) AS n, {PCT('count(*) FILTER (paywalled)', 'count(*)')} AS paywall_pct, {PCT("count(*) FILTER (author_status = 'named')", 'count(author_status)')} AS named_pct,
 {PCT('count(*) FILTER (revision_count > 0)', 'count(*)')} AS revised_pct, CAST(sum(edit_count) AS BIGINT) AS edits, {HALF('sum(word_count) FILTER (word_count > 0) / (count(*) FILTER (word_count > 0))::DOUBLE')} AS avg_words,
 {HALF('sum(word_count) FILTER (word_count > 0) / (count(*) FILTER (word_count > 0))::DOUBLE / 200')} AS avg_read_min, round(count(*) / (SELECT count(*) FROM days)::DOUBLE, 6) AS per_day,
 (SELECT {HALF('(recent - prior) / prior::DOUBLE * 100')} FROM pace) AS pace_pct, (SELECT source_id FROM src) AS top_source, (SELECT n FROM src) AS top_source_n, {PCT('(SELECT n FROM src)', 'count(*)')} AS top_source_pct,
 (SELECT tp FROM top) AS top_topic, (SELECT n FROM top) AS top_topic_n, {PCT('(SELECT n FROM top)', 'count(*)')} AS top_topic_pct FROM r""")
def pulse(spark, d):
    return rounded(db.pulse(corpus(spark, d), P), "per_day")


@query("pb2_flux", f"""
WITH ev AS (SELECT 'in' AS dir, discovered_at AS t FROM d_corpus UNION ALL SELECT 'out', link_seen FROM d_corpus c JOIN d_cuts k ON k.source_id = c.source_id WHERE link_seen < cut AND link_resighted),
daily AS (SELECT {berlin_day('t')} AS day, count(*) FILTER (dir = 'in') AS gains, count(*) FILTER (dir = 'out') AS losses FROM ev WHERE t BETWEEN '1998-01-01 00:00:00' AND '1999-12-31 22:59:59' GROUP BY 1),
spine AS (SELECT CAST(unnest(range(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP) + INTERVAL 1 HOUR, INTERVAL 1 DAY)) AS DATE) AS day FROM daily)
SELECT day, coalesce(gains, 0) AS gains, coalesce(losses, 0) AS losses FROM spine LEFT JOIN daily USING (day)""")
def _(spark, d):
    return db.flux(corpus(spark, d), P)


KPI_NOW = "1999-06-15 12:00:00"


@query("tc1_topic_kpis", f"""
WITH g AS (SELECT coalesce(topic, 'sonstiges') AS topic, count(*) AS articles, count(*) FILTER (paywalled) AS paywalled, count(*) FILTER (author_status = 'named') AS au_named, count(author_status) AS au_total,
  count(*) FILTER (discovered_at >= TIMESTAMP '{KPI_NOW}' - INTERVAL 7 DAY) AS new_7d, count(*) FILTER (discovered_at >= TIMESTAMP '{KPI_NOW}' - INTERVAL 24 HOUR) AS new_24h, count(DISTINCT source_id) AS outlets,
  count(*) FILTER (ptype IN ('timeline', 'blog')) AS timelines, {HALF('avg(word_count) FILTER (word_count > 0)')} AS avg_words, CAST(sum(edit_count) AS BIGINT) AS edits FROM d_corpus GROUP BY 1),
x AS (SELECT *, {PCT('paywalled', 'articles')} - {PCT('sum(paywalled) OVER ()', 'sum(articles) OVER ()')} AS paywall_pp, {PCT('au_named', 'au_total')} - {PCT('sum(au_named) OVER ()', 'sum(au_total) OVER ()')} AS named_pp FROM g)
SELECT *, CASE WHEN abs(paywall_pp) < 3 THEN 'flat' WHEN paywall_pp > 0 THEN 'above' ELSE 'below' END AS paywall_mark, CASE WHEN abs(named_pp) < 3 THEN 'flat' WHEN named_pp > 0 THEN 'above' ELSE 'below' END AS named_mark FROM x""")
def _(spark, d):
    return db.topic_kpis(corpus(spark, d), FilterParams(), KPI_NOW)


@query("tc2_topic_options", "SELECT coalesce(topic, 'sonstiges') AS topic, count(*) AS n FROM d_corpus WHERE paywalled GROUP BY 1")
def _(spark, d):
    return db.topic_options(corpus(spark, d), FilterParams(paywall="yes", topics=("sport",)))


# the rubric of a test URL is '<topic>/ausland' ('ausland' alone for filler sections): its label is 'Topic · Ausland'
RUBRIC = """
rub AS (SELECT coalesce(topic, 'sonstiges') AS topic, source_id, CASE WHEN topic IS NULL THEN 'ausland' ELSE topic || '/ausland' END AS raw,
  CASE WHEN topic IS NULL THEN 'Ausland' ELSE upper(topic[1]) || topic[2:] || ' · Ausland' END AS label FROM d_corpus),
raws AS (SELECT topic, raw, label, count(*) AS n FROM rub GROUP BY 1, 2, 3),
tree AS (SELECT r.topic, CASE WHEN contains(r.label, 'Politik') THEN 'politik' ELSE 'international' END AS key, CASE WHEN contains(r.label, 'Politik') THEN 'Politik' ELSE 'International' END AS label,
  n, (SELECT count(DISTINCT source_id) FROM rub WHERE rub.topic = r.topic) AS sources, raw AS raw_keys, CAST(1 AS BIGINT) AS rank FROM raws r)"""


@query("tc3_rubric_tree", f"WITH {RUBRIC} SELECT * FROM tree")
def _(spark, d):
    return db.rubric_tree(corpus(spark, d)).select("topic", "key", "label", "n", "sources", F.array_join("raw_keys", ",").alias("raw_keys"), F.col("rank").cast("bigint").alias("rank"))


@query("tc4_spotlight", f"WITH {RUBRIC} SELECT topic, key, n FROM tree WHERE topic IN (SELECT coalesce(topic, 'sonstiges') FROM d_corpus GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)")
def _(spark, d):
    return db.spotlight(corpus(spark, d)).select("topic", "key", "n")


CELL = """
cell AS (SELECT source_id, coalesce(topic, 'sonstiges') AS topic, count(*) AS n, count(*) FILTER (paywalled) AS pw, count(*) FILTER (author_status = 'named') AS named, count(author_status) AS au,
  coalesce(sum(word_count) FILTER (word_count > 0), 0) AS words, count(*) FILTER (word_count > 0) AS words_n FROM d_corpus GROUP BY 1, 2),
tt AS (SELECT topic, sum(n) AS n, sum(pw) AS pw, sum(named) AS named, sum(au) AS au, sum(words) AS words, sum(words_n) AS words_n FROM cell GROUP BY 1),
mt AS (SELECT * FROM tt WHERE n >= greatest(5, (SELECT sum(n) FROM cell) * 0.005) ),
pp AS (SELECT source_id, sum(n) AS n, sum(pw) AS pw, sum(named) AS named, sum(au) AS au, sum(words) AS words, sum(words_n) AS words_n FROM cell GROUP BY 1),
mx AS (SELECT pp.source_id, mt.topic, coalesce(c.n, 0) AS n, pp.n AS source_n, mt.n AS topic_n, coalesce(c.n, 0) / pp.n::DOUBLE AS share, coalesce(c.n, 0) / pp.n::DOUBLE / (mt.n / (SELECT sum(n) FROM cell)::DOUBLE) AS affinity
  FROM pp CROSS JOIN mt LEFT JOIN cell c ON c.source_id = pp.source_id AND c.topic = mt.topic),
dv AS (SELECT c.source_id, CAST(sum(c.n) AS BIGINT) AS n, -sum(c.n / pp.n::DOUBLE * ln(c.n / pp.n::DOUBLE)) / ln((SELECT count(*) FROM tt)) AS diversity FROM cell c JOIN pp USING (source_id) GROUP BY 1)"""


@query("tp1_agenda_matrix", f"""WITH {CELL} SELECT source_id, topic, n, CAST(source_n AS BIGINT) AS source_n, CAST(topic_n AS BIGINT) AS topic_n, round(share, 6) AS share, round(affinity, 6) AS affinity,
  CASE WHEN n >= 15 AND affinity >= 1.5 THEN 'up' WHEN n >= 15 AND affinity <= 0.5 THEN 'down' END AS mark FROM mx""")
def agenda(spark, d):
    return rounded(db.agenda_matrix(corpus(spark, d)), "share", "affinity")


@query("tp2_diversity", f"WITH {CELL} SELECT source_id, n, round(diversity, 6) AS diversity FROM dv")
def _(spark, d):
    return rounded(db.diversity(db.agenda_cells(corpus(spark, d))), "diversity")


@query("tp3_dominance", f"""WITH {CELL} SELECT 'share_of_voice' AS kind, source_id, topic, round(n / topic_n::DOUBLE, 6) AS value FROM mx WHERE topic_n >= 30 AND n / topic_n::DOUBLE >= 0.35
UNION ALL SELECT 'specialisation', source_id, topic, round(affinity, 6) FROM mx WHERE source_n >= 60 AND n >= 15 AND affinity >= 1.4""")
def _(spark, d):
    return rounded(db.dominance(db.agenda_cells(corpus(spark, d))), "value")


def _fact(fact, frm, value, where, order, source="CAST(NULL AS BIGINT)", topic="CAST(NULL AS VARCHAR)", after="TRUE"):
    return f"SELECT * FROM (SELECT '{fact}' AS fact, {source} AS source_id, {topic} AS topic, round(CAST({value} AS DOUBLE), 6) AS value FROM {frm} WHERE {where} AND {value} IS NOT NULL ORDER BY {order} LIMIT 1) WHERE {after}"


_T, _S = dict(topic="topic"), dict(source="source_id")
_AVG = "CASE WHEN words_n >= 5 THEN words / words_n::DOUBLE END"
_FACTS = [
    _fact("share_of_voice", "mx", "n / topic_n::DOUBLE", "topic_n >= 30 AND n / topic_n::DOUBLE >= 0.35", "n / topic_n::DOUBLE DESC, source_id, topic", "source_id", "topic"),
    _fact("specialisation", "mx", "affinity", "source_n >= 60 AND n >= 15 AND affinity >= 1.4", "affinity DESC, source_id, topic", "source_id", "topic"),
    _fact("paywall_topic", "mt", "pw / n::DOUBLE", "n >= 30", "pw / n::DOUBLE DESC, topic", **_T, after="value > 0.02"),
    _fact("open_topic", "mt", "1 - pw / n::DOUBLE", "n >= 30", "1 - pw / n::DOUBLE DESC, topic", **_T),
    _fact("named_topic", "mt", "named / au::DOUBLE", "n >= 30 AND au >= 20", "named / au::DOUBLE DESC, topic", **_T),
    _fact("longest_topic", "mt", _AVG, "n >= 30", f"{_AVG} DESC, topic", **_T),
    _fact("shortest_topic", "mt", _AVG, "n >= 30", f"{_AVG}, topic", **_T),
    _fact("largest_topic", "mt", "n / (SELECT sum(n) FROM cell)::DOUBLE", "TRUE", "n DESC, topic", **_T),
    _fact("broadest_agenda", "dv", "diversity", "n >= 50", "diversity DESC, source_id", **_S),
    _fact("narrowest_agenda", "dv", "diversity", "n >= 50", "diversity, source_id", **_S),
    _fact("paywall_source", "pp", "pw / n::DOUBLE", "n >= 50", "pw / n::DOUBLE DESC, source_id", **_S, after="value > 0.05"),
    _fact("named_source", "pp", "named / au::DOUBLE", "n >= 50", "named / au::DOUBLE DESC, source_id", **_S, after="value > 0"),
    _fact("anonymous_source", "pp", "(au - named) / au::DOUBLE", "n >= 50", "(au - named) / au::DOUBLE DESC, source_id", **_S, after="value > 0.3"),
    _fact("most_productive", "pp", "n", "TRUE", "n DESC, source_id", **_S),
    _fact("wordiest_source", "pp", "floor(words / words_n::DOUBLE + 0.5)", "n >= 50", "floor(words / words_n::DOUBLE + 0.5) DESC, source_id", **_S),
]


@query("tp4_insights", f"WITH {CELL} " + " UNION ALL ".join(_FACTS))
def _(spark, d):
    return rounded(db.insights(corpus(spark, d)), "value")


@query("tp5_topic_stats", f"""WITH {CELL} SELECT topic, CAST(n AS BIGINT) AS n, round(pw / n::DOUBLE, 6) AS paywall_share, round(CASE WHEN au >= 10 THEN named / au::DOUBLE END, 6) AS named_share,
  {HALF(f'({_AVG})')} AS avg_words FROM mt WHERE n >= 10""")
def _(spark, d):
    return rounded(db.topic_stats(corpus(spark, d)), "paywall_share", "named_share")


@query("pu1_publisher_compare", f"""
WITH r AS (SELECT *, CASE WHEN {EFF} BETWEEN '1999-01-01 00:00:00' AND '1999-12-31 22:59:59' THEN 'cur' WHEN {EFF} >= '1998-01-01 00:00:00' AND {EFF} < '1999-01-01 00:00:00' THEN 'prev' END AS period FROM d_corpus),
s AS (SELECT source_id, {', '.join(f"count(*) FILTER (period = '{w}' AND {c}) AS {n}_{w}" for w in ('cur', 'prev') for n, c in (('a', 'TRUE'), ('pw', 'paywalled'), ('nm', "author_status = 'named'"), ('an', "author_status = 'anonymous'"), ('no', "author_status = 'none'")))} FROM r GROUP BY 1),
x AS (SELECT *, nm_cur + an_cur + no_cur AS au_cur, nm_prev + an_prev + no_prev AS au_prev FROM s WHERE a_cur > 0)
SELECT source_id, a_cur AS articles, a_prev AS prev_articles, round(a_cur / 365.0, 6) AS per_day, round(a_prev / 365.0, 6) AS prev_per_day, a_cur - a_prev AS delta, CASE WHEN a_prev > 0 THEN {HALF('(a_cur - a_prev) / a_prev::DOUBLE * 100')} END AS delta_pct,
 {PCT('pw_cur', 'a_cur')} AS paywall_pct, CASE WHEN a_prev >= 10 THEN {PCT('pw_cur', 'a_cur')} - {PCT('pw_prev', 'a_prev')} END AS paywall_pp, {PCT('nm_cur', 'au_cur')} AS named_pct,
 CASE WHEN au_prev >= 10 THEN {PCT('nm_cur', 'au_cur')} - {PCT('nm_prev', 'au_prev')} END AS named_pp, {PCT('an_cur', 'au_cur')} AS anonymous_pct, {PCT('no_cur', 'au_cur')} AS none_pct FROM x""")
def _(spark, d):
    r = db.publisher_compare(corpus(spark, d), FilterParams(), "1999-01-01 00:00:00", "1999-12-31 22:59:59", "1998-01-01 00:00:00", 365)
    return rounded(r, "per_day", "prev_per_day")


# --- series ---------------------------------------------------------------------------------------------------------
FROM, TO = "1998-12-31 23:00:00", "1999-12-31 22:59:59"


def _spine_sql(unit):
    step = {"hour": "1 HOUR", "day": "1 DAY", "week": "7 DAY"}[unit]
    if unit == "hour":
        return f"SELECT unnest(range(date_trunc('hour', TIMESTAMP '{FROM}'), TIMESTAMP '{TO}' + INTERVAL 1 SECOND, INTERVAL {step})) AS bucket"
    return f"SELECT {utc('b')} AS bucket FROM (SELECT unnest(range(date_trunc('{unit}', " + berlin(f"TIMESTAMP '{FROM}'") + "), " + berlin(f"TIMESTAMP '{TO}'") + f" + INTERVAL 1 SECOND, INTERVAL {step})) AS b)"


def _bucket_sql(unit, e):
    return f"date_trunc('hour', {e})" if unit == "hour" else utc(f"CAST(date_trunc('{unit}', {berlin(e)}) AS TIMESTAMP)")


def _rate_sql(unit, key, keys):
    return f"""c AS (SELECT {key} AS series, {_bucket_sql(unit, EFF)} AS bucket, count(*) AS n FROM d_corpus WHERE {EFF} BETWEEN '{FROM}' AND '{TO}' GROUP BY 1, 2),
k AS ({keys}), spine AS ({_spine_sql(unit)}), s AS (SELECT k.series, spine.bucket, coalesce(n, 0) AS n FROM k CROSS JOIN spine LEFT JOIN c ON c.series = k.series AND c.bucket = spine.bucket)"""


ACTIVE = "SELECT CAST(id AS VARCHAR) AS series FROM d_sources WHERE active"
TOP10 = "SELECT series FROM c GROUP BY 1"


def _series(spark, d, unit, by):
    return sr.rate_series(corpus(spark, d), FilterParams(), FROM, TO, unit, by, derive(spark, d, "sources"))


@query("rs1_rate_series_day", f"WITH {_rate_sql('day', 'CAST(source_id AS VARCHAR)', ACTIVE)} SELECT * FROM s")
def _(spark, d):
    return _series(spark, d, "day", "source")


@query("rs1_rate_series_topic_week", f"WITH {_rate_sql('week', chr(39).join(['coalesce(topic, ', 'sonstiges', ')']), TOP10)} SELECT * FROM s")
def _(spark, d):
    return _series(spark, d, "week", "topic")


@query("rs1_rate_series_total_hour", f"WITH {_rate_sql('hour', chr(39) + 'total' + chr(39), 'SELECT ' + chr(39) + 'total' + chr(39) + ' AS series')} SELECT * FROM s")
def _(spark, d):
    return _series(spark, d, "hour", "total")


@query("rs2_day_series", f"""WITH c AS (SELECT CAST(source_id AS VARCHAR) AS series, {berlin_day(EFF)} AS day, count(*) AS n FROM d_corpus GROUP BY 1, 2), k AS ({ACTIVE}),
spine AS (SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '1999-01-01', TIMESTAMP '2000-01-01', INTERVAL 1 DAY))
SELECT k.series, spine.day, coalesce(n, 0) AS n FROM k CROSS JOIN spine LEFT JOIN c ON c.series = k.series AND c.day = spine.day""")
def _(spark, d):
    return sr.day_series(corpus(spark, d), FilterParams(), "1999-01-01", "1999-12-31", "source", derive(spark, d, "sources"))


@query("rs2_stacked_totals", f"SELECT {berlin_day(EFF)} AS day, count(*) AS n FROM d_corpus WHERE {berlin_day(EFF)} BETWEEN '1999-01-01' AND '1999-12-31' GROUP BY 1")
def _(spark, d):
    s = sr.day_series(corpus(spark, d), FilterParams(), "1999-01-01", "1999-12-31", "source", derive(spark, d, "sources"))
    return sr.stacked_totals(s).filter("n > 0")


@query("rs3_cumulative_by_day", f"""WITH {_rate_sql('hour', 'CAST(source_id AS VARCHAR)', ACTIVE)}
SELECT series, bucket, n, {berlin_day('bucket')} AS day, CAST(sum(n) OVER (PARTITION BY series, {berlin_day('bucket')} ORDER BY bucket) AS BIGINT) AS running FROM s""")
def _(spark, d):
    return sr.cumulative_by_day(_series(spark, d, "hour", "source"))


@query("rs4_until_now", f"WITH {_rate_sql('day', 'CAST(source_id AS VARCHAR)', ACTIVE)} SELECT * FROM s WHERE bucket <= '1999-07-01 12:00:00'")
def _(spark, d):
    return sr.until_now(_series(spark, d, "day", "source"), "1999-07-01 12:00:00")


# a sighting counts once per URL and run, at the minute of its first sight
SIGHT = "sight AS (SELECT source_id, date_trunc('minute', t) AS minute, count(*) AS n FROM (SELECT run_id, source_id, article_url, min(seen_at) AS t FROM d_link_observations GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def sightings(spark, d):
    from pressdelta.streaming.links import sighting_counts
    return sighting_counts(derive(spark, d, "link_observations"))


@query("sg1_sighting_counts", f"WITH {SIGHT} SELECT * FROM sight")
def _(spark, d):
    return sightings(spark, d)


def _sb(grain, expr):
    @query(f"sb1_sighting_buckets_{grain}", f"WITH {SIGHT} SELECT source_id, {expr} AS bucket, CAST(sum(n) AS BIGINT) AS n FROM sight WHERE minute BETWEEN '2024-01-03 00:00:00' AND '2024-01-28 12:00:00' GROUP BY 1, 2")
    def _(spark, d):
        return sr.sighting_buckets(sightings(spark, d), "2024-01-03 00:00:00", "2024-01-28 12:00:00", grain)


for _g, _e in (("minute", "minute"), ("hour", "date_trunc('hour', minute)"), ("day", utc(f"CAST(date_trunc('day', {berlin('minute')}) AS TIMESTAMP)"))):
    _sb(_g, _e)


@query("rs5_sighting_series", f"""WITH {SIGHT}, c AS (SELECT CAST(source_id AS VARCHAR) AS series, date_trunc('hour', minute) AS bucket, sum(n) AS n FROM sight WHERE minute BETWEEN '2024-01-03 00:00:00' AND '2024-01-09 23:59:59' GROUP BY 1, 2)
SELECT k.series, b.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ({ACTIVE}) k CROSS JOIN (SELECT unnest(range(TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-10 00:00:00', INTERVAL 1 HOUR)) AS bucket) b LEFT JOIN c ON c.series = k.series AND c.bucket = b.bucket""")
def _(spark, d):
    return sr.sighting_series(sightings(spark, d), corpus(spark, d), derive(spark, d, "sources"), FilterParams(), "2024-01-03 00:00:00", "2024-01-09 23:59:59", "hour")


# --- context ---------------------------------------------------------------------------------------------------------
PEERS = """
src AS (SELECT p.source_id, a.word_count, coalesce(a.revision_count, 0) AS rev, a.extension_count AS ext, a.edit_count AS edit, a.published_at, a.modified_at, a.first_seen, p.last_seen AS link_seen, p.depth
  FROM d_pages p JOIN d_articles a ON a.url = p.url WHERE p.kind = 'article'),
med AS (SELECT source_id, count(*) AS peers, count(word_count) AS len_n, count(*) FILTER (rev >= 1) AS edit_n, quantile_cont(word_count, 0.5) AS wc, quantile_cont(rev, 0.5) AS rev, quantile_cont(rev, 0.5) FILTER (rev >= 1) AS rev_e,
  quantile_cont((epoch(modified_at) - epoch(published_at)) / 3600, 0.5) FILTER (modified_at > published_at) AS lag_h, quantile_cont((epoch(link_seen) - epoch(first_seen)) / 86400, 0.5) FILTER (link_seen > first_seen) AS vis_d,
  quantile_cont(ext / (ext + edit)::DOUBLE, 0.5) FILTER (ext + edit > 0) AS ext_share, quantile_cont(depth, 0.5) AS depth FROM src GROUP BY 1)"""


@query("pc1_article_context", f"""
WITH {PEERS}, lw AS (SELECT source_id, word_count, count(*) AS c FROM src WHERE word_count IS NOT NULL GROUP BY 1, 2), rv AS (SELECT source_id, rev, count(*) AS c FROM src WHERE rev >= 1 GROUP BY 1, 2),
w AS (SELECT x.source_id, x.word_count, coalesce(sum(lw.c), 0) AS b FROM (SELECT DISTINCT source_id, word_count FROM d_articles) x LEFT JOIN lw ON lw.source_id = x.source_id AND lw.word_count < x.word_count GROUP BY 1, 2),
r AS (SELECT x.source_id, x.rev, coalesce(sum(rv.c), 0) AS b FROM (SELECT DISTINCT source_id, coalesce(revision_count, 0) AS rev FROM d_articles) x LEFT JOIN rv ON rv.source_id = x.source_id AND rv.rev < x.rev GROUP BY 1, 2)
SELECT a.id, a.source_id, CAST(least(99, round(100.0 * coalesce(w.b, 0)::DOUBLE / greatest(len_n, 1))) AS BIGINT) AS len_pct, len_n, CAST(round_even(m.wc, 0) AS BIGINT) AS len_med,
 CAST(least(99, round(100.0 * coalesce(r.b, 0)::DOUBLE / greatest(edit_n, 1))) AS BIGINT) AS edit_pct, edit_n, CAST(round_even(m.rev_e, 0) AS BIGINT) AS edit_med, CASE WHEN peers >= 8 THEN round(edit_n / peers::DOUBLE, 4) END AS edited_share,
 round(m.wc, 6) AS peer_wc, round(m.rev, 6) AS peer_rev, round(m.lag_h, 6) AS peer_lag_h, round(m.vis_d, 6) AS peer_vis_d, round(m.ext_share, 6) AS peer_ext_share, round(m.depth, 6) AS peer_depth
FROM d_articles a JOIN med m ON m.source_id = a.source_id LEFT JOIN w ON w.source_id = a.source_id AND w.word_count = a.word_count LEFT JOIN r ON r.source_id = a.source_id AND r.rev = coalesce(a.revision_count, 0)""")
def article_context(spark, d):
    return rounded(cx.article_context(domain(spark, d, "articles", "pages")), "peer_wc", "peer_rev", "peer_lag_h", "peer_vis_d", "peer_ext_share", "peer_depth")


CLIP = lambda e: f"greatest(0, least(1, {e}))"


@query("pc2_radar", f"""
WITH {PEERS}, a AS (SELECT a.*, p.last_seen AS pl, p.depth AS pd, m.wc AS mwc, m.rev AS mrev, m.lag_h AS mlag, m.vis_d AS mvis, m.ext_share AS mext, m.depth AS mdep FROM d_articles a LEFT JOIN d_pages p ON p.url = a.url LEFT JOIN med m ON m.source_id = a.source_id)
SELECT id, axis, round(CAST(value AS DOUBLE), 6) AS value, round(CAST(peer AS DOUBLE), 6) AS peer FROM (
 SELECT id, 'length' AS axis, {CLIP('coalesce(word_count, 0) / 2000.0')} AS value, {CLIP('mwc / 2000.0')} AS peer FROM a
 UNION ALL SELECT id, 'edits', {CLIP('coalesce(revision_count, 0) / 6.0::DOUBLE')}, {CLIP('mrev / 6.0')} FROM a
 UNION ALL SELECT id, 'lag', {CLIP('CASE WHEN modified_at > published_at THEN (epoch(modified_at) - epoch(published_at)) / 3600 ELSE 0 END / 168.0::DOUBLE')}, {CLIP('mlag / 168.0')} FROM a
 UNION ALL SELECT id, 'visible', {CLIP('coalesce(epoch(pl) - epoch(first_seen), 0) / 86400 / 14.0::DOUBLE')}, {CLIP('mvis / 14.0')} FROM a
 UNION ALL SELECT id, 'growth', CASE WHEN extension_count + edit_count > 0 THEN extension_count / (extension_count + edit_count)::DOUBLE ELSE 0 END, mext FROM a
 UNION ALL SELECT id, 'prominence', coalesce({CLIP('1 - (pd - 1) / 4.0::DOUBLE')}, 0), coalesce({CLIP('1 - (mdep - 1) / 4.0')}, 0) FROM a)""")
def _(spark, d):
    return rounded(cx.radar(domain(spark, d, "articles", "pages")), "value", "peer")


@query("pc3_behaviour_profile", f"""
WITH s AS (SELECT article_id, min(captured_at) AS f, max(captured_at) AS l, sum(word_delta) AS net FROM d_snapshots GROUP BY 1),
st AS (SELECT conv_id, list(ts ORDER BY ts) AS t FROM (SELECT article_id AS conv_id, scanned_at AS ts FROM d_versions)  GROUP BY 1),
a AS (SELECT a.*, CASE WHEN published_at > first_seen THEN first_seen ELSE published_at END AS pub, f, l, net FROM d_articles a LEFT JOIN s ON s.article_id = a.id),
x AS (SELECT *, CASE WHEN epoch(l) - epoch(pub) > 0 THEN epoch(l) - epoch(pub) END AS ls FROM a)
SELECT id, CASE WHEN epoch(first_seen) - epoch(pub) > 60 THEN epoch(first_seen) - epoch(pub) END AS capture_delay_s, CASE WHEN epoch(f) - epoch(pub) > 0 THEN epoch(f) - epoch(pub) END AS first_change_s, ls AS last_change_s,
 CASE WHEN coalesce(scan_count, 0) > 1 THEN {HALF('coalesce(revision_count, 0) / scan_count::DOUBLE * 100')} END AS change_pct, CAST(CASE WHEN net <> 0 THEN net END AS BIGINT) AS net_words, CAST(NULL AS DOUBLE) AS scan_gap_s,
 CASE WHEN edit_count > 0 AND extension_count = 0 THEN 'silent_edits_only' WHEN extension_count >= 2 THEN 'growing' WHEN coalesce(revision_count, 0) > 0 AND ls > 86400 THEN 'late_edit' WHEN coalesce(revision_count, 0) = 0 AND coalesce(scan_count, 0) >= 4 THEN 'stable' END AS remark FROM x""")
def _(spark, d):
    return cx.behaviour_profile(domain(spark, d, "articles", "snapshots"))


@query("pc4_scan_points", f"""
WITH a AS (SELECT id AS article_id, first_seen, last_seen, unnest([first_seen, last_seen]) AS t FROM d_articles),
m AS (SELECT DISTINCT article_id, CAST(floor(epoch(captured_at) / 60 + 0.5) AS BIGINT) AS minute FROM d_snapshots)
SELECT a.article_id, t, round((epoch(t) - epoch(first_seen)) / greatest(0.001, epoch(last_seen) - epoch(first_seen)) * 100, 6) AS position, m.minute IS NOT NULL AS change,
 {HALF('(epoch(last_seen) - epoch(first_seen)) / 86400')} AS span_days, CAST(NULL AS DOUBLE) AS gone_position FROM a LEFT JOIN m ON m.article_id = a.article_id AND m.minute = CAST(floor(epoch(t) / 60 + 0.5) AS BIGINT)""")
def _(spark, d):
    return rounded(cx.scan_points(domain(spark, d, "articles", "snapshots")), "position")


@query("pc5_link_status", """
SELECT article_id, CASE WHEN link_seen IS NULL OR cut IS NULL THEN NULL WHEN link_seen >= cut THEN 'online' WHEN link_resighted THEN 'gone' ELSE 'unknown' END AS state,
 CASE WHEN cut IS NOT NULL THEN link_seen END AS since, CASE WHEN link_seen IS NOT NULL AND cut IS NOT NULL THEN 'time' END AS grounds FROM d_overview o LEFT JOIN d_cuts k ON k.source_id = o.source_id""")
def _(spark, d):
    return cx.link_status(overview(spark, d))


@query("pc6_article_record", """
WITH kw AS (SELECT article_id, string_agg(DISTINCT term, '|' ORDER BY term) AS keywords FROM d_article_keywords JOIN d_keywords k ON k.id = keyword_id GROUP BY 1),
sn AS (SELECT article_id, string_agg(v || ':' || change_kind || ':' || word_delta, ',' ORDER BY v) AS snapshots FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY captured_at, id) + 1 AS v FROM d_snapshots) GROUP BY 1)
SELECT a.id AS article_id, title, au.name AS authors, c.name AS categories, kw.keywords, sn.snapshots FROM d_articles a JOIN d_article_authors aa ON aa.article_id = a.id LEFT JOIN d_authors au ON au.id = aa.author_id
 JOIN d_article_categories ac ON ac.article_id = a.id LEFT JOIN d_categories c ON c.id = ac.category_id LEFT JOIN kw ON kw.article_id = a.id LEFT JOIN sn ON sn.article_id = a.id""")
def _(spark, d):
    t = domain(spark, d, "articles", "snapshots", "keywords", "article_keywords", "categories", "article_categories", "authors", "article_authors")
    r = cx.article_record(t)
    text = F.transform("snapshots", lambda x: F.concat_ws(":", x["version"].cast("string"), x["change_kind"], x["word_delta"].cast("string")))
    return r.select("article_id", "title", *[F.array_join(c, "|").alias(c) for c in ("authors", "categories", "keywords")], F.array_join(text, ",").alias("snapshots"))


# clusters of the test: the label of a vector, joined to the article with the same number
CLUSTERS = "cl AS (SELECT label + 1 AS cluster_id, vec_id AS article_id, CAST(vec_id % 100 AS DOUBLE) / 100 AS similarity FROM embeddings)"


def clustered(spark, d):
    from pressdelta.sources.driver_tables import star
    e = star(spark, d, "embeddings").selectExpr("CAST(label + 1 AS BIGINT) AS cluster_id", "vec_id AS article_id", "CAST(vec_id % 100 AS DOUBLE) / 100 AS similarity")
    return domain(spark, d, "articles", "sources").with_(article_clusters=e)


@query("co1_cluster_overview", f"""WITH {CLUSTERS} SELECT CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS size, count(DISTINCT s.name) AS outlets, string_agg(DISTINCT s.name, '|' ORDER BY s.name) AS outlet_names
FROM cl JOIN d_articles a ON a.id = article_id JOIN d_sources s ON s.id = source_id GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return cx.cluster_overview(clustered(spark, d)).withColumn("outlet_names", F.array_join("outlet_names", "|"))


@query("co1_cluster_echoes", f"""WITH {CLUSTERS}, m AS (SELECT cl.*, s.name AS outlet, s.country, coalesce(published_at, first_seen) AS t FROM cl JOIN d_articles a ON a.id = article_id JOIN d_sources s ON s.id = source_id),
o AS (SELECT cluster_id, min((t, article_id)) AS o FROM m GROUP BY 1)
SELECT CAST(m.cluster_id AS BIGINT) AS cluster_id, article_id, outlet, country, {HALF('similarity * 100')} AS similarity_pct, article_id = o.o[2] AS is_origin, {HALF('(epoch(t) - epoch(o.o[1])) / 60')} AS offset_minutes FROM m JOIN o USING (cluster_id)""")
def _(spark, d):
    return cx.cluster_echoes(clustered(spark, d))


# --- edits and table views ----------------------------------------------------------------------------------------------
SUMMARY = """summary AS (SELECT a.id AS article_id, url, title, source_id, edit_count, extension_count, first_seen, change_count, last_change, s.name AS outlet, country FROM (
 SELECT article_id, count(*) AS change_count, max(captured_at) AS last_change FROM d_snapshots GROUP BY 1) c JOIN d_articles a ON a.id = c.article_id JOIN d_sources s ON s.id = source_id)"""
ET = ("articles", "snapshots", "sources")


@query("ec8_edits_summary", f"WITH {SUMMARY} SELECT * FROM summary WHERE last_change BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'")
def _(spark, d):
    return db.edits_summary(domain(spark, d, *ET), FilterParams(range_from=RANGE[0], range_to=RANGE[1]))


@query("ec9_edits_by_publisher", f"WITH {SUMMARY} SELECT source_id, outlet, CAST(sum(change_count) AS BIGINT) AS changes, CAST(sum(edit_count) AS BIGINT) AS edits, CAST(sum(extension_count) AS BIGINT) AS extensions, count(*) AS articles FROM summary GROUP BY 1, 2")
def _(spark, d):
    return db.edits_by_publisher(db.edits_summary(domain(spark, d, *ET), limit=None))


@query("ec9_edits_totals", f"WITH {SUMMARY} SELECT CAST(sum(change_count) AS BIGINT) AS changes, CAST(sum(edit_count) AS BIGINT) AS edits, CAST(sum(extension_count) AS BIGINT) AS extensions, count(*) AS articles, round(sum(change_count) / count(*)::DOUBLE, 1) AS mean_changes FROM summary")
def _(spark, d):
    return db.edits_totals(db.edits_summary(domain(spark, d, *ET), limit=None))


@query("ag1_footer", f"""
WITH s AS (SELECT word_count, row_number() OVER (ORDER BY word_count) - 1 AS i, count(*) OVER () AS n FROM d_corpus WHERE word_count IS NOT NULL)
SELECT CAST(sum(edit_count) AS BIGINT) AS edit_count, (SELECT word_count FROM s WHERE i = n // 2) AS word_count, floor(avg(revision_count) * 10 + 0.5) / 10 AS revision_count, max(scan_count) AS scan_count, min(source_id) AS source_id,
 {PCT("count(*) FILTER (ptype = 'artikel')", 'count(*)')} AS ptype FROM d_corpus""")
def _(spark, d):
    from pressdelta.functions.numbers import pct
    return db.footer(corpus(spark, d), {"edit_count": "sum", "word_count": "median", "revision_count": "avg", "scan_count": "max", "source_id": "min", "ptype": pct(F.count_if(F.col("ptype") == "artikel"), F.count("*"))})


@query("ag2_group_view", "SELECT coalesce(topic, '—') AS \"group\", count(*) AS n FROM d_corpus GROUP BY 1")
def _(spark, d):
    return db.group_view(corpus(spark, d), "topic")


@query("ag3_corpus_stats", "SELECT count(*) AS articles, count(*) FILTER (revision_count >= 1) AS revised, (SELECT count(*) FROM d_sources WHERE active) AS sources FROM d_articles")
def _(spark, d):
    return db.corpus_stats(domain(spark, d, "articles", "sources"))


@query("ag3_sources_per_country", "SELECT coalesce(country, '—') AS country, count(*) AS n FROM d_sources GROUP BY 1")
def _(spark, d):
    return db.sources_per_country(domain(spark, d, "sources"))


def placed(rows, column, direction="asc"):
    """Rows with their place in the sorted view."""
    return global_rank(rows, [*db.sort_keys(rows, column, direction), F.col("id").asc()], "place")


@query("so1_sort_view", "SELECT id, word_count, row_number() OVER (ORDER BY word_count DESC NULLS LAST, id) AS place FROM d_corpus")
def _(spark, d):
    return placed(corpus(spark, d), "word_count", "desc").select("id", "word_count", "place")


@query("so1_sort_view_text", "SELECT id, CAST(word_count AS VARCHAR) AS words, row_number() OVER (ORDER BY word_count NULLS LAST, id) AS place FROM d_corpus")
def _(spark, d):
    return placed(corpus(spark, d).withColumn("words", F.col("word_count").cast("string")), "words").select("id", "words", "place")


# numbers inside texts by value, also those of forty places
@query("so1_sort_view_natural", """WITH t AS (SELECT id, CASE WHEN title IS NOT NULL THEN concat('Folge ', CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '00' ELSE '1234567890123456789012345678901234567890' END, id, ' der Reihe') END AS words FROM d_articles)
SELECT id, words, row_number() OVER (ORDER BY words IS NULL, CASE WHEN words IS NULL THEN 0 WHEN id % 3 = 2 THEN 1 ELSE 0 END, CASE WHEN words IS NULL THEN 0 WHEN id % 3 = 2 THEN length(words) ELSE 0 END, id) AS place FROM t""")
def _(spark, d):
    words = F.when(F.col("title").isNotNull(), F.concat(F.lit("Folge "), F.expr("CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '00' ELSE '1234567890123456789012345678901234567890' END"), "id", F.lit(" der Reihe")))
    return placed(derive(spark, d, "articles").withColumn("words", words), "words").select("id", "words", "place")


@query("so2_page", "SELECT id, revision_count FROM d_overview ORDER BY revision_count DESC NULLS LAST, id LIMIT 100 OFFSET 300")
def _(spark, d):
    return db.page(overview(spark, d), "revision_count", "desc", 3).select("id", "revision_count")


@query("so2_page_total", "SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS pages FROM d_overview")
def _(spark, d):
    return db.page_total(overview(spark, d))


@query("so3_top_per_group", "SELECT id, source_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY word_count DESC NULLS LAST, id) AS rn FROM d_overview) WHERE rn <= 25")
def _(spark, d):
    from pressdelta.plans.patterns import top_per_group
    return top_per_group(overview(spark, d), ["source_id"], [F.desc_nulls_last("word_count"), F.asc("id")], 25, spread=["id"]).select("id", "source_id", F.col("rn").cast("bigint").alias("rn"))


@query("se3_same_rows", "WITH x AS (SELECT id, topic FROM d_corpus WHERE topic IN ('sport', 'politik')), y AS (SELECT id, topic FROM d_corpus WHERE topic = 'sport') SELECT id, topic, 'a' AS only_in FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y)")
def _(spark, d):
    c = corpus(spark, d)
    return db.same_rows(fl.filter_corpus(c, FilterParams(topics=("sport", "politik"))).select("id", "topic"), c.filter("topic = 'sport'").select("id", "topic"))


@query("sg7_is_active", f"SELECT max(last_seen) AS newest, max(last_seen) > TIMESTAMP '{NOW}' - INTERVAL 4 MINUTE AS active FROM d_overview")
def _(spark, d):
    return db.is_active(overview(spark, d), NOW)


# --- URL jobs on the article and page tables --------------------------------------------------------------------------------
@query("ur10_url_rubric", "SELECT id, CASE WHEN topic IS NULL THEN 'ausland' ELSE topic || '/ausland' END AS raw, CASE WHEN topic IS NULL THEN 'Ausland' ELSE upper(topic[1]) || topic[2:] || ' · Ausland' END AS label FROM d_articles")
def _(spark, d):
    return derive(spark, d, "articles").select("id", uj.url_rubric(F.col("url")).alias("r")).select("id", "r.raw", "r.label")


@query("ur13_kind_counts", "SELECT source_id, kind, count(*) AS n FROM d_pages GROUP BY 1, 2")
def _(spark, d):
    return uj.kind_counts(derive(spark, d, "pages"))


TREE = """
x AS (SELECT source_id, str_split(substr(url, length('https://s1.example/') + 1), '/') AS p, kind FROM d_pages),
leaf AS (SELECT source_id, p[1] AS a, p[2] AS b, p[3] AS c FROM x WHERE kind = 'article'),
secs AS (SELECT DISTINCT source_id, p[1] AS a, p[2] AS b FROM x), one AS (SELECT source_id, a, count(*) = 1 AS single FROM secs GROUP BY 1, 2),
heads AS (SELECT o.source_id, o.a, single, CASE WHEN single THEN o.a || '/' || s.b ELSE o.a END AS label, o.a AS path, '' AS parent FROM one o LEFT JOIN secs s ON o.single AND s.source_id = o.source_id AND s.a = o.a),
l1 AS (SELECT h.source_id, path, parent, label, FALSE AS is_article, (SELECT count(*) FROM leaf WHERE leaf.source_id = h.source_id AND leaf.a = h.a) AS articles FROM heads h),
l2 AS (SELECT s.source_id, s.a || '/' || s.b AS path, s.a AS parent, s.b AS label, FALSE AS is_article, (SELECT count(*) FROM leaf WHERE leaf.source_id = s.source_id AND leaf.a = s.a AND leaf.b = s.b) AS articles FROM secs s JOIN one o ON o.source_id = s.source_id AND o.a = s.a AND NOT single),
l3 AS (SELECT l.source_id, l.a || '/' || l.b || '/' || l.c AS path, CASE WHEN single THEN l.a ELSE l.a || '/' || l.b END AS parent, CASE WHEN single THEN substr(l.a || '/' || l.b || '/' || l.c, length(l.a) + 2) ELSE l.c END AS label, TRUE AS is_article, 1 AS articles FROM leaf l JOIN one o ON o.source_id = l.source_id AND o.a = l.a),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, parent ORDER BY is_article, articles DESC, path) AS rank FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE articles > 0)"""


@query("ur12_section_tree", f"""WITH {TREE} SELECT source_id, path, parent, is_article, articles, rank FROM r WHERE rank <= 6
UNION ALL SELECT source_id, CASE WHEN parent = '' THEN '…' ELSE parent || '/…' END, parent, FALSE, CAST(sum(articles) AS BIGINT), 7 FROM r WHERE rank > 6 GROUP BY source_id, parent""")
def _(spark, d):
    t = uj.section_tree(derive(spark, d, "pages"))
    return t.select("source_id", "path", "parent", "is_article", "articles", F.col("rank").cast("bigint").alias("rank"))
