"""Registered queries: paragraphs, version pairs, change records, edit classes, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sqltext as S
from checks.registry import query
from pressdelta import constants as K
from pressdelta.functions import text as tx
from pressdelta.operators import changes as ch, diffs as df, editclass as ec, passages as ps
from pressdelta.operators.context import real_date_shift
from pressdelta.sources.driver_tables import derive, domain, star



def versions(spark, d):
    return derive(spark, d, "versions")


@query("bd5_paragraphs", f"SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS para FROM (SELECT doc_id, {S.paras('text')} AS p FROM documents)")
def _(spark, d):
    return ch.with_paragraphs(star(spark, d, "documents"), "text").select("doc_id", F.posexplode_outer("paras").alias("pos", "para")).filter("pos IS NOT NULL").withColumn("pos", F.col("pos").cast("bigint"))


@query("bd6_fingerprints", f"""SELECT doc_id, array_to_string(f, ',') AS para_fps, CASE WHEN len(f) > 0 THEN {S.fp("array_to_string(f, '|')")} END AS content_hash, CAST(len(regexp_split_to_array({S.trim_ws('text')}, '[{S.WS}]+')) AS BIGINT) AS body_words
FROM (SELECT doc_id, text, {S.fps(S.paras('text'))} AS f FROM documents)""")
def _(spark, d):
    r = ch.with_fingerprints(ch.with_paragraphs(star(spark, d, "documents"), "text"), body="text")
    return r.select("doc_id", F.array_join("para_fps", ",").alias("para_fps"), "content_hash", "body_words")


@query("bd7_cap_paras", f"SELECT doc_id, len(l) AS n, list_sum(list_transform(l, lambda p: length(p))) AS chars FROM (SELECT doc_id, list_transform(p[greatest(len(p) - 399, 1):], lambda x: substr(x, 1, 8000)) AS l FROM (SELECT doc_id, {S.paras('text')} AS p FROM documents))")
def _(spark, d):
    r = ch.with_paragraphs(star(spark, d, "documents"), "text").withColumn("l", ch.cap_paras(F.col("paras")))
    return r.select("doc_id", F.size("l").cast("bigint").alias("n"), F.when(F.size("l") > 0, F.aggregate("l", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p))).alias("chars"))


@query("ch1_version_pairs", "SELECT article_id, seq, title, lag(title) OVER w AS prev_title, lag(scanned_at) OVER w AS prev_scanned_at FROM d_versions WINDOW w AS (PARTITION BY article_id ORDER BY scanned_at)")
def _(spark, d):
    # chunks of three hours: several per article, so that the carried rows are used
    p = ch.version_pairs(versions(spark, d), ["title", "scanned_at"], chunk=F.floor(F.unix_seconds(F.col("scanned_at").cast("timestamp")) / 10800))
    return p.select("article_id", "seq", "title", "prev_title", "prev_scanned_at")


PAIRS = f"""
f AS (SELECT article_id, seq, scanned_at, title, body, role, {S.fps(S.paras('body'))} AS fps FROM d_versions),
pr AS (SELECT *, coalesce(lag(fps) OVER w, []) AS old, lag(title) OVER w AS prev_title, lag(body) OVER w AS prev_body, lag(role) OVER w AS prev_role, lag(scanned_at) OVER w AS prev_at FROM f WINDOW w AS (PARTITION BY article_id ORDER BY scanned_at)),
df AS (SELECT *, len({S.except_('fps', 'old')}) AS added_count, len(list_distinct({S.except_('old', 'fps')})) AS removed_count FROM pr)"""


def pairs(spark, d):
    v = ch.with_fingerprints(ch.with_paragraphs(versions(spark, d)))
    return ch.para_diff(ch.version_pairs(v, ["para_fps", "title", "body", "role", "scanned_at"]))


@query("ch2_para_diff", f"WITH {PAIRS} SELECT article_id, seq, added_count, removed_count FROM df")
def _(spark, d):
    return pairs(spark, d).select("article_id", "seq", "added_count", "removed_count")


@query("ch3_title_changed", f"WITH {PAIRS} SELECT article_id, seq, coalesce(prev_title <> '' AND title <> '' AND {S.decode('prev_title')} <> {S.decode('title')}, FALSE) AS changed FROM df")
def _(spark, d):
    return pairs(spark, d).select("article_id", "seq", ch.title_changed(F.col("prev_title"), F.col("title")).alias("changed"))


# captures: one per article at its last scan; snapshots with a reported date where words were added
@query("ch4_pubdate_change", """
WITH s AS (SELECT article_id, captured_at, captured_at - INTERVAL 1 DAY AS pubdate_new FROM d_snapshots WHERE word_delta > 0),
c AS (SELECT id AS article_id, last_seen AS captured_at, published_at AS stored, modified_at AS new FROM d_articles),
j AS (SELECT c.*, (SELECT max_by(pubdate_new, s.captured_at) FROM s WHERE s.article_id = c.article_id AND s.captured_at < c.captured_at) AS last FROM c),
b AS (SELECT *, CASE WHEN coalesce(abs(epoch(new) - epoch(stored)) >= 60, FALSE) THEN coalesce(last, stored) ELSE stored END AS base FROM j)
SELECT article_id, last AS last_reported, base AS baseline, coalesce(abs(epoch(new) - epoch(base)) >= 60, FALSE) AS pub_changed FROM b""")
def _(spark, d):
    t = domain(spark, d, "articles", "snapshots")
    s = t.snapshots.filter("word_delta > 0").select("article_id", "captured_at", (F.col("captured_at") - F.expr("INTERVAL 1 DAY")).alias("pubdate_new"))
    c = t.articles.select(F.col("id").alias("article_id"), F.col("last_seen").alias("captured_at"), "published_at", "modified_at")
    r = ch.with_reported_date(c, s)
    changed, base = ch.pubdate_change(F.col("published_at"), F.col("modified_at"), F.col("last_reported"))
    return r.select("article_id", "last_reported", base.alias("baseline"), changed.alias("pub_changed"))


META = {"description": "body", "og_image": "title", "topic": "role", "paywalled": "CASE WHEN length(body) % 3 > 0 THEN length(body) % 2 = 0 END",
        "author_status": "CASE length(body) % 4 WHEN 0 THEN 'named' WHEN 1 THEN 'anonymous' WHEN 2 THEN 'none' END"}


@query("ch5_meta_edits", f"""
WITH m AS (SELECT article_id, seq, scanned_at, {', '.join(f'{e} AS {c}' for c, e in META.items())} FROM d_versions),
l AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in META)} FROM m WINDOW w AS (PARTITION BY article_id ORDER BY scanned_at))
SELECT article_id, seq, concat(CASE WHEN {S.decode('p_description')} <> '' AND {S.decode('description')} <> '' AND {S.decode('p_description')} <> {S.decode('description')} THEN 'description,' ELSE '' END,
 CASE WHEN p_og_image <> '' AND og_image <> '' AND p_og_image <> og_image THEN 'og_image,' ELSE '' END, CASE WHEN p_topic <> topic THEN 'topic,' ELSE '' END, CASE WHEN p_paywalled <> paywalled THEN 'paywalled,' ELSE '' END,
 CASE WHEN p_author_status <> author_status AND p_author_status <> 'none' AND author_status <> 'none' THEN 'author_status,' ELSE '' END) AS fields FROM l""")
def _(spark, d):
    m = versions(spark, d).selectExpr("article_id", "seq", "scanned_at", *[f"{e} AS {c}" for c, e in META.items()])
    p = ch.version_pairs(m, list(META))
    return p.select("article_id", "seq", F.array_join(F.transform(ch.meta_edits(), lambda x: F.concat(x["field"], F.lit(","))), "").alias("fields"))


@query("ch8_change_kind", f"""WITH {PAIRS} SELECT article_id, seq, CASE WHEN prev_at IS NULL OR (added_count = 0 AND removed_count = 0 AND role = prev_role) THEN NULL WHEN added_count = 0 AND removed_count = 0 THEN 'edit'
 WHEN added_count > removed_count THEN 'extension' ELSE 'edit' END AS kind FROM df""")
def _(spark, d):
    c = F.col
    content = c("prev_scanned_at").isNotNull() & ((c("added_count") > 0) | (c("removed_count") > 0))
    meta = F.coalesce(c("role") != c("prev_role"), F.lit(False))
    return pairs(spark, d).select("article_id", "seq", ch.change_kind(content, F.lit(False), F.lit(False), meta, F.lit(False), c("added_count"), c("removed_count")).alias("kind"))


@query("ch10_flip_signature", f"""WITH {PAIRS}, y AS (SELECT *, list_sort(list_distinct(list_concat({S.except_('fps', 'old')}, {S.except_('old', 'fps')}))) AS sym FROM df)
SELECT article_id, seq, CASE WHEN len(sym) > 0 THEN {S.fp("array_to_string(sym, '|')")} ELSE '' END AS sig FROM y""")
def _(spark, d):
    return pairs(spark, d).select("article_id", "seq", ch.flip_signature(F.coalesce("prev_para_fps", F.array().cast("array<string>")), F.col("para_fps")).alias("sig"))


HISTORY = PAIRS.replace("FROM d_versions)", "FROM d_versions), g AS (SELECT * FROM f WHERE len(fps) > 0)").replace("AS prev_at FROM f WINDOW", "AS prev_at FROM g WINDOW")


@query("ch12_track_changes", f"""
WITH {HISTORY}, e AS (SELECT *, added_count > removed_count AS raw FROM df WHERE prev_at IS NOT NULL AND (added_count > 0 OR removed_count > 0)),
x AS (SELECT *, coalesce(sum(CASE WHEN raw THEN 1 ELSE 0 END) OVER (PARTITION BY article_id ORDER BY scanned_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS growing FROM e),
k AS (SELECT *, CASE WHEN growing OR raw THEN 'extension' ELSE 'edit' END AS change_kind FROM x)
SELECT article_id, scanned_at AS captured_at, change_kind, added_count, CASE WHEN growing THEN 0 ELSE removed_count END AS removed_count,
 row_number() OVER w AS revision_count, CAST(sum(CASE WHEN change_kind = 'extension' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS extension_count, CAST(sum(CASE WHEN change_kind = 'edit' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS edit_count
FROM k WINDOW w AS (PARTITION BY article_id ORDER BY scanned_at)""")
def _(spark, d):
    c = versions(spark, d).select("article_id", F.col("scanned_at").alias("captured_at"), F.lit(None).cast("string").alias("title"), "body")
    return ch.track_changes(c, passages=False).select("article_id", "captured_at", "change_kind", "added_count", "removed_count", "revision_count", "extension_count", "edit_count")


@query("ch12_track_changes_titled", f"""
WITH {PAIRS}, tp AS (SELECT article_id, seq, prev_title AS pt FROM df), h AS ({HISTORY.split('df AS (')[0].strip().rstrip(',').replace('f AS (SELECT', 'WITH f AS (SELECT', 1)} SELECT *, len({S.except_('fps', 'old')}) AS a, len(list_distinct({S.except_('old', 'fps')})) AS r FROM pr)
SELECT h.article_id, scanned_at AS captured_at, {S.decode('pt')} AS title_old, {S.decode('h.title')} AS title_new, 'edit' AS change_kind, row_number() OVER (PARTITION BY h.article_id ORDER BY scanned_at) AS revision_count
FROM h JOIN tp ON tp.article_id = h.article_id AND tp.seq = h.seq WHERE prev_at IS NOT NULL AND {S.decode('pt')} <> {S.decode('h.title')}""")
def _(spark, d):
    c = versions(spark, d).select("article_id", F.col("scanned_at").alias("captured_at"), "title", "body")
    return ch.track_changes(c, passages=False).select("article_id", "captured_at", "title_old", "title_new", "change_kind", "revision_count")


@query("ch12_tracked_state", f"""
WITH {HISTORY} SELECT article_id, count(*) AS scan_count, max_by(CASE WHEN len(fps) > 0 THEN {S.fp("array_to_string(fps, '|')")} END, scanned_at) AS content_hash FROM df GROUP BY 1""")
def _(spark, d):
    c = versions(spark, d).select("article_id", F.col("scanned_at").alias("captured_at"), F.lit(None).cast("string").alias("title"), "body")
    return ch.tracked_state(c, ch.track_changes(c)).select("article_id", "scan_count", "content_hash")


SCANS = "SELECT article_id, captured_at + seq * INTERVAL 1 MINUTE AS captured_at, word_delta, seq FROM d_snapshots"


def scans(spark, d):
    return derive(spark, d, "snapshots").selectExpr("article_id", "captured_at + seq * INTERVAL 1 MINUTE AS captured_at", "word_delta", "seq")


@query("ch13_sticky_paywall", f"""WITH s AS ({SCANS}) SELECT article_id, seq, last_value(CASE abs(word_delta) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY article_id ORDER BY captured_at) AS paywalled_state FROM s""")
def _(spark, d):
    return ch.sticky_paywall(scans(spark, d).withColumn("paywalled", F.expr("CASE abs(word_delta) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"))).select("article_id", "seq", "paywalled_state")


DATES = """article_id, captured_at, seq, CASE WHEN abs(word_delta) % 4 > 0 THEN captured_at - (abs(word_delta) % 5) * INTERVAL 1 DAY + (abs(word_delta) % 7) * INTERVAL 1 HOUR END AS reported_pub, word_delta % 2 = 0 AS precise,
 CASE WHEN abs(word_delta) % 6 = 1 THEN captured_at - INTERVAL 2 HOUR END AS reported_mod, captured_at AS first_seen"""


@query("ch14_freeze_dates", f"""
WITH c AS (SELECT {DATES} FROM ({SCANS})), p AS (SELECT article_id, least(min_by(reported_pub, captured_at), min_by(first_seen, captured_at)) AS pub, min(captured_at) AS fixed FROM c WHERE reported_pub IS NOT NULL GROUP BY 1)
SELECT c.article_id, any_value(pub) AS published_at, max(greatest(reported_mod, CASE WHEN precise AND captured_at > fixed AND epoch(reported_pub) - epoch(pub) > 60 THEN reported_pub END)) AS modified_at FROM c LEFT JOIN p ON p.article_id = c.article_id GROUP BY 1""")
def _(spark, d):
    return ch.freeze_dates(scans(spark, d).selectExpr(*[x.strip() for x in _split_sql(DATES)]))


def _split_sql(text):
    """Top-level comma split."""
    out, depth, cur = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return out + [cur]


SITEMAP = "SELECT id, url, published_at + (id % 11 - 5) * INTERVAL 1 HOUR AS d_at, id % 3 > 0 AS precise FROM d_articles UNION ALL SELECT id, url, first_seen, FALSE FROM d_articles WHERE id % 2 = 0"


@query("ch15_sitemap_dates", f"""
WITH s AS ({SITEMAP}), g AS (SELECT url, min(d_at) FILTER (precise) AS lo, max(d_at) FILTER (precise) AS hi, min(d_at) FILTER (NOT precise) AS guess FROM s GROUP BY 1)
SELECT a.id, coalesce(least(published_at, lo), guess) AS published_at, CASE WHEN published_at IS NOT NULL AND hi > published_at THEN greatest(modified_at, hi) ELSE modified_at END AS modified_at FROM d_articles a LEFT JOIN g ON g.url = a.url""")
def _(spark, d):
    a = derive(spark, d, "articles")
    s = a.selectExpr("url", "published_at + (id % 11 - 5) * INTERVAL 1 HOUR AS at", "id % 3 > 0 AS precise").union(a.filter("id % 2 = 0").selectExpr("url", "first_seen", "FALSE"))
    return ch.apply_sitemap_dates(a, s).select("id", "published_at", "modified_at")


ARCH = "1999-01-01 00:00:00"


@query("ch16_archive_gate", f"""
WITH gone AS (SELECT url FROM d_articles WHERE coalesce(revision_count, 0) = 0 AND extension_count = 0 AND edit_count = 0 AND epoch(TIMESTAMP '{ARCH}') - epoch(published_at) > 30 * 86400)
SELECT 'page' AS what, id, CASE WHEN url IN (SELECT url FROM gone) THEN 'archive' ELSE kind END AS kind FROM d_pages UNION ALL SELECT 'article', id, NULL FROM d_articles WHERE url NOT IN (SELECT url FROM gone)""")
def _(spark, d):
    t = ch.archive_gate(domain(spark, d, "articles", "pages"), ARCH)
    return t.pages.select(F.lit("page").alias("what"), "id", "kind").union(t.articles.select(F.lit("article"), "id", F.lit(None).cast("string")))


@query("ch18_headline_edits", f"""WITH {PAIRS}, o AS (SELECT article_id, min(scanned_at) AS t0 FROM d_versions GROUP BY 1)
SELECT article_id, prev_title AS before_title, title AS after_title, scanned_at, CAST(floor((epoch(scanned_at) - epoch(t0)) / 60) AS BIGINT) AS delay_minutes FROM df JOIN o USING (article_id)
WHERE {S.decode('prev_title')} <> {S.decode('title')} AND prev_title <> '' AND title <> ''""")
def _(spark, d):
    return ch.headline_edits(versions(spark, d))


@query("ch19_date_shift", "SELECT id, coalesce(epoch(modified_at) > epoch(published_at) AND epoch(modified_at) - epoch(published_at) <= 30 * 86400, FALSE) AS shifted FROM d_articles")
def _(spark, d):
    return derive(spark, d, "articles").select("id", real_date_shift(F.col("published_at"), F.col("modified_at")).alias("shifted"))


# --- edit classes ---------------------------------------------------------------------------------------------------------
# pairs made of the documents: the text, and the text with one kind of change, by document number
EDITED = """SELECT doc_id AS id, text AS old, CASE doc_id % 6
 WHEN 0 THEN concat('Rund 14 Personen. ', text) WHEN 1 THEN concat('laut ', text) WHEN 2 THEN concat('Der Skandal: ', text) WHEN 3 THEN concat(text, ' Schreibweiss')
 WHEN 4 THEN concat(text, ' die Frau') ELSE text END AS new FROM documents"""
EDITED_SPARK = EDITED.replace("FROM documents", "FROM {documents}").replace("text AS old", "CASE doc_id % 6 WHEN 0 THEN concat('Rund 12 Personen. ', text) WHEN 2 THEN concat('Der Bericht: ', text) WHEN 3 THEN concat(text, ' Schreibweise') WHEN 4 THEN concat(text, ' Angela Muster') ELSE text END AS old")
EDITED = EDITED_SPARK.format(documents="documents")


def edited(spark, d):
    return spark.sql(EDITED_SPARK, documents=star(spark, d, "documents"))


@query("ec1_headline_kind", f"""
WITH e AS ({EDITED}), k AS (SELECT id, regexp_matches(old, '{K.HEADLINE_COOLING}', 'i') AS co, regexp_matches(new, '{K.HEADLINE_COOLING}', 'i') AS cn, regexp_matches(old, '{K.HEADLINE_HEATING}', 'i') AS ho, regexp_matches(new, '{K.HEADLINE_HEATING}', 'i') AS hn,
 array_to_string(regexp_extract_all(old, '\\d+[.,]?\\d*'), ',') AS n_o, array_to_string(regexp_extract_all(new, '\\d+[.,]?\\d*'), ',') AS n_n FROM e)
SELECT id, CASE WHEN (co AND NOT cn) AND NOT (hn AND NOT ho) THEN 'toned_down' WHEN (hn AND NOT ho) AND NOT (co AND NOT cn) THEN 'sharpened' WHEN n_o <> '' AND n_n <> '' AND n_o <> n_n THEN 'factual' ELSE 'other' END AS kind FROM k""")
def _(spark, d):
    return edited(spark, d).select("id", ec.headline_kind(F.col("old"), F.col("new")).alias("kind"))


@query("ec2_word_set_diff", f"""
WITH e AS (SELECT article_id, seq, title AS new, lag(title) OVER (PARTITION BY article_id ORDER BY seq) AS old FROM d_versions),
w AS (SELECT article_id, seq, {S.words('old')} AS b, {S.words('new')} AS a FROM e WHERE old IS NOT NULL),
n AS (SELECT *, list_transform(b, lambda x: {S.norm('x', True)}) AS bf, list_transform(a, lambda x: {S.norm('x', True)}) AS af FROM w)
SELECT article_id, seq, array_to_string(list_transform(b, lambda x: CASE WHEN list_contains(af, {S.norm('x', True)}) THEN x ELSE '-' || x END), ' ') AS before_words, array_to_string(list_transform(a, lambda x: CASE WHEN list_contains(bf, {S.norm('x', True)}) THEN x ELSE '+' || x END), ' ') AS after_words FROM n""")
def _(spark, d):
    p = ch.version_pairs(versions(spark, d), ["title"]).filter(F.col("prev_title").isNotNull())
    r = ec.word_set_diff(p, "prev_title", "title")
    mark = lambda col, sign: F.array_join(F.transform(col, lambda w: F.when(w["changed"], F.concat(F.lit(sign), w["text"])).otherwise(w["text"])), " ").alias(col)
    return r.select("article_id", "seq", mark("before_words", "-"), mark("after_words", "+"))


NUMS = lambda e: f"list_transform(regexp_extract_all({e}, '\\d[\\d.,:]*'), lambda x: regexp_replace(x, '[.,:]$', ''))"
CLASSIFY = f"""
e AS ({EDITED}), w AS (SELECT id, old, new, {S.words('old')} AS ow, {S.norm_words('old')} AS o, {S.norm_words('new')} AS n, {NUMS('old')} AS onum, {NUMS('new')} AS nnum FROM e),
x AS (SELECT *, {S.except_('o', 'n')} AS rem, {S.except_('n', 'o')} AS ad, len(list_filter(o, lambda q: list_contains(n, q))) / greatest(len(list_distinct(list_concat(o, n))), 1)::DOUBLE AS j, {S.except_('onum', 'nnum')}[1] AS gone, {S.except_('nnum', 'onum')}[1] AS came FROM w),
y AS (SELECT *, (j >= 0.4 AND ((gone IS NOT NULL AND came IS NOT NULL) OR (gone IS NOT NULL AND len(nnum) = 0) OR (came IS NOT NULL AND len(onum) = 0))) AS fact,
 list_filter(ad, lambda q: q IN {S.in_list(K.HEDGE_WORDS)}) AS hi, list_filter(rem, lambda q: q IN {S.in_list(K.HEDGE_WORDS)}) AS ho, list_filter(ad, lambda q: q IN {S.in_list(K.HEAT_WORDS)}) AS ti, list_filter(rem, lambda q: q IN {S.in_list(K.HEAT_WORDS)}) AS tn,
 list_filter(ow, lambda q: regexp_matches(regexp_replace(q, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'), '^[A-ZÄÖÜ][\\p{{L}}.-]+$') AND NOT list_contains(n, {S.norm('q')}) AND {S.norm('q')} NOT IN {S.in_list(K.HEDGE_WORDS)}) AS nm,
 regexp_matches(old, '{K.HEDGE_PHRASE}', 'i') AS po, regexp_matches(new, '{K.HEDGE_PHRASE}', 'i') AS pn FROM x),
t AS (SELECT *, len(rem) = 1 AND len(ad) = 1 AND NOT regexp_matches(rem[1] || ad[1], '\\d') AND levenshtein(rem[1], ad[1]) BETWEEN 1 AND 2 AND greatest(length(rem[1]), length(ad[1])) >= 5 AND substr(rem[1], 1, 3) = substr(ad[1], 1, 3) AND least(length(rem[1]), length(ad[1])) >= 3 AS typo,
 len(hi) > 0 OR (pn AND NOT po) AS hin, len(ho) > 0 OR (po AND NOT pn) AS hout, len(nm) > 0 AND len(list_filter(ad, lambda q: q IN {S.in_list(K.ROLE_WORDS)})) > 0 AS anon, len(ti) > 0 AND len(ti) >= len(tn) AND NOT fact AS sharper, len(tn) > 0 AND len(tn) > len(ti) AND NOT fact AS softer FROM y),
tags AS (SELECT id, concat(CASE WHEN coalesce(fact, FALSE) THEN 'factual,' ELSE '' END, CASE WHEN coalesce(typo, FALSE) THEN 'typo,' ELSE '' END, CASE WHEN hin OR hout THEN 'attribution,' ELSE '' END, CASE WHEN anon THEN 'anonymization,' ELSE '' END,
 CASE WHEN sharper THEN 'sharpened,' ELSE '' END, CASE WHEN NOT sharper AND softer THEN 'toned,' ELSE '' END) AS k, old = new AS same FROM t)"""


@query("ec3_pair_tags", f"WITH {CLASSIFY} SELECT id, CASE WHEN k = '' THEN 'rephrase,' ELSE k END AS tags FROM tags")
def _(spark, d):
    r = ec.with_pair_tags(edited(spark, d))
    return r.select("id", F.concat(F.array_join("tags.key", ","), F.lit(",")).alias("tags"))


@query("ec11_tag_counts", f"""WITH {CLASSIFY}, u AS (SELECT id, unnest(list_filter(str_split(CASE WHEN k = '' THEN 'rephrase' ELSE k END, ','), lambda q: q <> '')) AS tag FROM tags),
r AS (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY list_position({str(list(K.TAG_PRIORITY))}, tag)) AS rn FROM u)
SELECT source, tag, count(*) AS n FROM r JOIN documents ON doc_id = id GROUP BY 1, 2""")
def _(spark, d):
    e = edited(spark, d)
    snaps = e.select("id", F.array(F.struct("old", "new")).alias("changes"), F.lit(None).cast("string").alias("title_old"), F.lit(None).cast("string").alias("title_new"), F.lit("").alias("added"))
    return ec.tag_counts(ec.classify_snapshots(snaps), star(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "source")


@query("ec4_snapshot_tags", f"""WITH {CLASSIFY}, u AS (SELECT id, unnest(list_filter(str_split(CASE WHEN k = '' THEN 'rephrase' ELSE k END, ','), lambda q: q <> '')) AS tag FROM tags WHERE id % 4 > 0 UNION ALL SELECT id, 'showcase' FROM tags WHERE id % 4 = 0 UNION ALL SELECT id, 'addition' FROM tags WHERE id % 4 = 1 UNION ALL SELECT id, 'deletion' FROM tags WHERE id % 4 = 2),
c AS (SELECT id, tag, count(*) OVER (PARTITION BY id) AS n FROM u), r AS (SELECT id, tag, row_number() OVER (PARTITION BY id ORDER BY list_position({str(list(K.TAG_PRIORITY))}, tag)) AS rn FROM c WHERE tag <> 'rephrase' OR n = 1)
SELECT id, string_agg(tag, ',' ORDER BY rn) AS tags FROM r GROUP BY 1""")
def _(spark, d):
    e, none = edited(spark, d), F.lit(None).cast("string")
    pair, add, rem = F.struct("old", "new"), F.struct(none.alias("old"), F.col("new")), F.struct("old", none.alias("new"))
    m = F.col("id") % 4
    changes = F.when(m == 0, F.array().cast("array<struct<old:string,new:string>>")).when(m == 1, F.array(pair, add)).when(m == 2, F.array(pair, rem)).otherwise(F.array(pair))
    # number 0: only the headline changed
    snaps = e.select("id", changes.alias("changes"), F.when(m == 0, F.lit("a")).alias("title_old"), F.when(m == 0, F.lit("b")).alias("title_new"), F.lit("").alias("added"))
    return ec.classify_snapshots(snaps).select("id", F.array_join("tags.key", ",").alias("tags"))


@query("ec7_first_shown", f"""
WITH p AS (SELECT conv_id AS article_id, turn, unnest(list_filter(list_transform(str_split(text, chr(10)), lambda x: {S.trim_ws('x')}), lambda x: x <> '')) AS para FROM conversations),
k AS (SELECT *, substr(lower({S.collapse('para')}), 1, 120) AS key FROM p), m AS (SELECT article_id, key, min(turn) AS f FROM k GROUP BY 1, 2)
SELECT article_id, turn, key, turn > f AS hidden FROM k JOIN m USING (article_id, key)""")
def _(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(None).cast("string").alias("old"), x.alias("new")))
    s = star(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("article_id"), F.col("turn").alias("captured_at"), lines.alias("changes"), F.lit("").alias("added"))
    return df.first_shown(df.shown_paragraphs(s)).select("article_id", F.col("captured_at").alias("turn"), "key", "hidden")


@query("ec10_payload_trimmed", "SELECT id, word_delta <> 0 OR change_kind = 'extension' AS payload_trimmed FROM d_snapshots")
def _(spark, d):
    s = derive(spark, d, "snapshots").withColumns({"added": F.lit(None).cast("string")})
    from pressdelta.sources.tables import SCHEMAS, conform
    return ch.payload_trimmed(conform(s, SCHEMAS["snapshots"])).select("id", "payload_trimmed")


TURNS = "SELECT article_id * 1000 + seq AS id, body AS new, lag(body) OVER (PARTITION BY article_id ORDER BY seq) AS old FROM d_versions"


def turns(spark, d):
    p = ch.version_pairs(versions(spark, d), ["body"])
    return p.select((F.col("article_id") * 1000 + F.col("seq")).alias("id"), F.lit(0).alias("item"), F.col("prev_body").alias("old"), F.col("body").alias("new"), F.lit(0).alias("net_words")).filter(F.col("old").isNotNull())


@query("ec6_diff_reconstruct", f"WITH t AS ({TURNS}) SELECT id, regexp_replace(old, '^\\s+', '') AS old_text, regexp_replace(new, '^\\s+', '') AS new_text FROM t WHERE old IS NOT NULL")
def _(spark, d):
    ops = df.diff_ops(turns(spark, d))
    side = lambda *kinds: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isin(*kinds), F.struct("seq", "text")))), lambda x: x["text"]), "")
    return ops.groupBy("id").agg(side("eq", "del").alias("old_text"), side("eq", "ins").alias("new_text"))


@query("ec6_diff_ops")
def _(spark, d):
    return df.diff_ops(turns(spark, d))


def _pairs_sql(threshold, lead):
    """SQL of the matching, one new passage after the other: m (article_id, seq, i, j, o, n).  `taken` are the old ones used so far."""
    alike = f"len(list_intersect(ot, nt)) / len(list_distinct(list_concat(ot, nt)))::DOUBLE"
    score = f"CASE WHEN len(ot) > 0 AND len(nt) > 0 AND {alike} >= {threshold} THEN 1000000 + {alike} {lead} END"
    return f"""RECURSIVE
v AS (SELECT article_id, seq, {S.paras('body')} AS np, lag({S.paras('body')}) OVER (PARTITION BY article_id ORDER BY seq) AS op FROM d_versions),
w AS (SELECT article_id, seq, {S.except_('op', 'np')} AS rem, {S.except_('np', 'op')} AS ad FROM v WHERE op IS NOT NULL),
x AS (SELECT article_id, seq, list_filter(rem, lambda y, k: list_position(rem, y) = k) AS rem, list_filter(ad, lambda y, k: list_position(ad, y) = k) AS ad FROM w),
os AS (SELECT article_id, seq, unnest(rem) AS o, generate_subscripts(rem, 1) AS i FROM x), ns AS (SELECT article_id, seq, unnest(ad) AS n, generate_subscripts(ad, 1) AS j FROM x),
ot AS (SELECT *, {S.tokens('o')} AS ot, lower({S.collapse('o')}) AS op FROM os), nt AS (SELECT *, {S.tokens('n')} AS nt, lower({S.collapse('n')}) AS np FROM ns),
sc AS MATERIALIZED (SELECT * FROM (SELECT article_id, seq, i, j, o, n, {score} AS s FROM ot JOIN nt USING (article_id, seq)) WHERE s IS NOT NULL),
wants AS MATERIALIZED (SELECT article_id, seq, row_number() OVER (PARTITION BY article_id, seq ORDER BY j) AS step, j, list(i ORDER BY s DESC, i) AS wanted FROM sc GROUP BY article_id, seq, j),
go AS (SELECT article_id, seq, 0::BIGINT AS step, 0::BIGINT AS j, 0::BIGINT AS i, []::BIGINT[] AS taken FROM (SELECT DISTINCT article_id, seq FROM wants) UNION ALL
       SELECT article_id, seq, step, j, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END
       FROM (SELECT w.*, go.taken, list_filter(w.wanted, lambda y: NOT list_contains(go.taken, y))[1] AS pick FROM go JOIN wants w ON w.article_id = go.article_id AND w.seq = go.seq AND w.step = go.step + 1)),
m AS (SELECT sc.* FROM go JOIN sc USING (article_id, seq, i, j) WHERE go.step > 0 AND go.i IS NOT NULL)"""


HEAD_LEN = "len(list_filter(range(1, least(length(o), length(n)) + 1), lambda k: substr(o, 1, k) = substr(n, 1, k)))"
TAIL_LEN = "len(list_filter(range(1, least(length(o), length(n)) - h + 1), lambda k: right(o, k) = right(n, k)))"
_WINDOW = "concat(CASE WHEN h > 140 THEN '…' ELSE '' END, substr({0}, greatest(h - 140, 0) + 1, least(length({0}), length({0}) - e + 140) - greatest(h - 140, 0)), CASE WHEN length({0}) - e + 140 < length({0}) THEN '…' ELSE '' END)"


@query("ch6_build_changes", f"""
WITH {_pairs_sql(0.35, "")}, r1 AS (SELECT *, {HEAD_LEN} AS h FROM m), r2 AS (SELECT *, {TAIL_LEN} AS e FROM r1),
r AS (SELECT article_id, seq, 0 AS lone, j AS k, {_WINDOW.format('o')} AS old, {_WINDOW.format('n')} AS new FROM r2),
a AS (SELECT article_id, seq, lone, k, old, new FROM r WHERE old <> new UNION ALL SELECT article_id, seq, 0, j, NULL, n FROM ns ANTI JOIN m USING (article_id, seq, j) UNION ALL SELECT article_id, seq, 1, i, o, NULL FROM os ANTI JOIN m USING (article_id, seq, i))
SELECT article_id, seq, row_number() OVER (PARTITION BY article_id, seq ORDER BY lone, k) - 1 AS pos, old, new FROM a""")
def _(spark, d):
    p = ch.version_pairs(ch.with_paragraphs(versions(spark, d)), ["paras"]).filter(F.col("prev_paras").isNotNull())
    rows = p.select("article_id", "seq", F.array_except("prev_paras", "paras").alias("removed"), F.array_except("paras", "prev_paras").alias("added"))
    c = ps.list_changes(rows, ["article_id", "seq"], "removed", "added")
    return c.select("article_id", "seq", F.posexplode("changes").alias("pos", "c")).select("article_id", "seq", F.col("pos").cast("bigint").alias("pos"), "c.old", "c.new")


@query("ec5_reconcile_changes", f"""
WITH {_pairs_sql(0.4, "WHEN length(op) >= 80 AND length(np) >= 80 AND substr(op, 1, 80) = substr(np, 1, 80) THEN len(list_filter(range(1, least(length(op), length(np)) + 1), lambda k: substr(op, 1, k) = substr(np, 1, k)))")},
a AS (SELECT article_id, seq, 0 AS lone, j AS k, o AS old, n AS new FROM m WHERE {S.collapse('o')} <> {S.collapse('n')} UNION ALL SELECT article_id, seq, 0, j, NULL, n FROM ns ANTI JOIN m USING (article_id, seq, j) UNION ALL SELECT article_id, seq, 1, i, o, NULL FROM os ANTI JOIN m USING (article_id, seq, i))
SELECT article_id, seq, row_number() OVER (PARTITION BY article_id, seq ORDER BY lone, k) - 1 AS pos, old, new FROM a""")
def _(spark, d):
    p = ch.version_pairs(ch.with_paragraphs(versions(spark, d)), ["paras"]).filter(F.col("prev_paras").isNotNull())
    one = lambda arr, side: F.transform(arr, lambda x: F.struct((x if side == "old" else F.lit(None).cast("string")).alias("old"), (x if side == "new" else F.lit(None).cast("string")).alias("new")))
    s = p.select("article_id", "seq", F.concat(one(F.array_except("prev_paras", "paras"), "old"), one(F.array_except("paras", "prev_paras"), "new")).alias("changes"))
    c = df.reconcile_changes(s, ["article_id", "seq"])
    return c.select("article_id", "seq", F.posexplode("changes").alias("pos", "c")).select("article_id", "seq", F.col("pos").cast("bigint").alias("pos"), "c.old", "c.new")


@query("ec12_change_cards", f"""
WITH t AS (SELECT * FROM ({TURNS}) WHERE old IS NOT NULL), c AS (SELECT id, {S.except_(S.paras('new'), S.paras('old'))} AS ad, {S.except_(S.paras('old'), S.paras('new'))} AS rem FROM t)
SELECT id, CAST(len(list_distinct(ad)) AS BIGINT) AS added_paras, CAST(len(list_distinct(rem)) AS BIGINT) AS removed_paras, CAST(greatest(len(list_distinct(ad)) + len(list_distinct(rem)) - 3, 0) AS BIGINT) AS more FROM c""")
def _(spark, d):
    p = ch.version_pairs(ch.with_paragraphs(versions(spark, d)), ["paras"]).filter(F.col("prev_paras").isNotNull())
    one = lambda arr, side: F.transform(arr, lambda x: F.struct((x if side == "old" else F.lit(None).cast("string")).alias("old"), (x if side == "new" else F.lit(None).cast("string")).alias("new")))
    s = p.select((F.col("article_id") * 1000 + F.col("seq")).alias("id"), F.concat(one(F.array_except("prev_paras", "paras"), "old"), one(F.array_except("paras", "prev_paras"), "new")).alias("changes"),
                 F.lit(None).cast("timestamp_ntz").alias("pubdate_old"), F.lit(None).cast("timestamp_ntz").alias("pubdate_new"))
    return df.change_cards(s, shown=3).select("id", *[F.col(c).cast("bigint").alias(c) for c in ("added_paras", "removed_paras", "more")])


# --- text functions -----------------------------------------------------------------------------------------------------------
@query("sc3_token_jaccard", f"""WITH t AS (SELECT id, {S.tokens('old')} AS a, {S.tokens('new')} AS b FROM ({TURNS}) WHERE old IS NOT NULL)
SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS jaccard FROM t""")
def _(spark, d):
    return turns(spark, d).select("id", F.round(tx.token_jaccard(F.col("old"), F.col("new")), 6).alias("jaccard"))


@query("sc4_word_overlap", f"""WITH t AS (SELECT id, {S.norm_words('old')} AS a, {S.norm_words('new')} AS b FROM ({TURNS}) WHERE old IS NOT NULL)
SELECT id, round(len(list_filter(a, lambda q: list_contains(b, q))) / greatest(len(list_distinct(list_concat(a, b))), 1)::DOUBLE, 6) AS overlap FROM t""")
def _(spark, d):
    return turns(spark, d).select("id", F.round(tx.word_overlap(F.col("old"), F.col("new")), 6).alias("overlap"))


@query("sc5_common_prefix", "SELECT a.p_partkey AS id, list_max(list_transform(range(0, 60), lambda i: CASE WHEN i <= least(length(a.p_name), length(a.p_type)) AND substr(a.p_name, 1, i) = substr(a.p_type, 1, i) THEN i ELSE 0 END)) AS n, levenshtein(p_name, p_type) AS dist FROM part a")
def _(spark, d):
    return star(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.common_prefix(F.col("p_name"), F.col("p_type")).cast("bigint").alias("n"), F.levenshtein("p_name", "p_type").cast("bigint").alias("dist"))


@query("sc6_numbers", f"SELECT doc_id, array_to_string({NUMS('text')}, '|') AS numbers, array_to_string(regexp_extract_all(text, '\\d+[.,]?\\d*'), '|') AS simple FROM documents")
def _(spark, d):
    return star(spark, d, "documents").select("doc_id", F.array_join(tx.number_tokens(F.col("text")), "|").alias("numbers"), F.array_join(tx.simple_numbers(F.col("text")), "|").alias("simple"))


@query("sc2_norm_words", f"SELECT doc_id, len({S.norm_words('text')}) AS n, len(list_distinct({S.norm_words('text')})) AS distinct_n, len(list_filter({S.words('text')}, lambda q: length({S.norm('q', True)}) = 0)) AS bare FROM documents")
def _(spark, d):
    w = tx.norm_words(F.col("text"))
    bare = F.size(F.filter(tx.split_words(F.col("text")), lambda q: ~q.rlike("[A-Za-z0-9]") & (F.length(tx.norm_token(q, inner=True)) == 0)))
    # cut once for both counts
    words = star(spark, d, "documents").select("doc_id", "text", w.alias("w"))
    w = F.col("w")
    return words.select("doc_id", F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct_n"), bare.cast("bigint").alias("bare"))


@query("sc7_person_names", f"SELECT doc_id, regexp_matches(text, '\\p{{Lu}}[\\p{{Ll}}.''-]+[{S.WS}]+\\p{{Lu}}[\\p{{Ll}}.''-]+') AS person FROM documents")
def _(spark, d):
    return star(spark, d, "documents").select("doc_id", tx.is_person(F.col("text")).alias("person"))


@query("sc8_strip_accents", "SELECT doc_id, strip_accents(lower(lang || ' ' || regexp_replace(text, '[^A-Za-zÀ-ÖÙ-öù-ÿ ]', '', 'g'))) AS plain FROM documents")
def _(spark, d):
    return star(spark, d, "documents").select("doc_id", tx.strip_accents(F.lower(F.concat("lang", F.lit(" "), F.regexp_replace("text", "[^A-Za-zÀ-ÖÙ-öù-ÿ ]", "")))).alias("plain"))


@query("sc11_para_key", f"SELECT doc_id, substr(lower({S.collapse('text')}), 1, 120) AS key FROM documents")
def _(spark, d):
    return star(spark, d, "documents").select("doc_id", tx.para_key(F.col("text")).alias("key"))


@query("sc12_cut", f"SELECT doc_id, regexp_replace(right(text, 80), '^[^{S.WS}]*[{S.WS}]+', '') AS head, regexp_replace(left(text, 80), '[{S.WS}]+[^{S.WS}]*$', '') AS tail, CASE WHEN length(text) > 420 THEN substr(text, 1, 420) || ' …' ELSE text END AS clipped FROM documents")
def _(spark, d):
    t = F.col("text")
    return star(spark, d, "documents").select("doc_id", tx.cut_head(t, 80).alias("head"), tx.cut_tail(t, 80).alias("tail"), tx.clip(t, 420).alias("clipped"))
