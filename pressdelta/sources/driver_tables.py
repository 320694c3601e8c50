"""Domain tables derived from the star-schema test tables.

Each template is plain SQL over the star tables; it reads the same in Spark and in other SQL engines.  `k` is the
order key.  Timestamps are UTC wall-clock values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressdelta.plans.patterns import spread_scan
from pressdelta.session import pin_session
from pressdelta.sources.tables import Tables

ARTICLE_BASE = """
SELECT o_orderkey AS k, o_custkey % 6 + 1 AS source_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'politik' WHEN '2-HIGH' THEN 'sport' WHEN '3-MEDIUM' THEN 'wirtschaft'
            WHEN '5-LOW' THEN 'regional' ELSE NULL END AS topic,
       o_orderpriority, o_orderstatus, o_totalprice, o_orderdate, coalesce(r_cnt, 0) AS edit_count, coalesce(a_cnt, 0) AS extension_count
FROM {orders} LEFT JOIN (
  SELECT l_orderkey, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r_cnt,
         SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a_cnt
  FROM {lineitem} GROUP BY l_orderkey) c ON o_orderkey = l_orderkey
"""

ARTICLES = f"""
SELECT k AS id, source_id, topic,
       concat('https://s', source_id, '.example/', coalesce(topic, 'news'), '/ausland/a-', k + 100000, '.html') AS url,
       CASE WHEN k % 13 <> 0 THEN concat('Order ', k) END AS title, o_orderpriority AS description,
       CASE WHEN k % 17 <> 0 THEN o_orderdate + (k % 24) * INTERVAL 1 HOUR END AS published_at,
       o_orderdate + (k % 48) * INTERVAL 1 HOUR AS first_seen,
       o_orderdate + (k % 48 + k % 40 * 24) * INTERVAL 1 HOUR AS last_seen,
       CASE WHEN k % 3 <> 0 THEN o_orderdate + (k % 200) * INTERVAL 1 HOUR END AS modified_at,
       CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS paywalled,
       CASE k % 4 WHEN 1 THEN 'named' WHEN 2 THEN 'anonymous' WHEN 3 THEN 'none' END AS author_status,
       CASE WHEN k % 19 <> 0 THEN CAST(floor(o_totalprice / 250) AS BIGINT) END AS word_count,
       CASE WHEN k % 23 <> 0 THEN k % 5 END AS scan_count,
       CAST(edit_count AS BIGINT) AS edit_count, CAST(extension_count AS BIGINT) AS extension_count,
       CASE WHEN k % 37 <> 0 THEN CAST(edit_count + extension_count AS BIGINT) END AS revision_count,
       CASE WHEN extension_count >= 2 THEN 'timeline' ELSE 'news' END AS article_type,
       k % 10 <> 0 AS is_article, CAST(NULL AS VARCHAR(100)) AS rubric,
       CASE WHEN k % 31 <> 0 THEN k % 5 + 1 END AS depth,
       CASE WHEN k % 29 <> 0 THEN o_orderdate + (k % 48 + k % 30) * INTERVAL 1 HOUR END AS link_seen,
       CASE WHEN k % 41 = 0 THEN 'media' ELSE 'article' END AS kind
FROM ({ARTICLE_BASE}) b
"""

TEMPLATES = {
    "sources": """
SELECT s_suppkey AS id, s_name AS name, n_name AS country, CASE WHEN s_suppkey % 2 = 0 THEN 'de' ELSE 'fr' END AS language,
       s_suppkey BETWEEN 1 AND 6 AS active FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "articles": ARTICLES,
    # one page per article, and one page per customer that was never captured
    "pages": f"""
SELECT id, source_id, url, kind, depth, first_seen, link_seen AS last_seen FROM ({ARTICLES}) a
UNION ALL
SELECT 1000000000 + c_custkey, c_custkey % 6 + 1, concat('https://s', c_custkey % 6 + 1, '.example/politik/offen/b-', c_custkey + 100000, '.html'),
       'article', c_custkey % 5 + 1, TIMESTAMP '1998-01-01 00:00:00' + c_custkey * INTERVAL 1 HOUR,
       TIMESTAMP '1998-01-01 00:00:00' + (c_custkey + c_custkey % 7) * INTERVAL 1 HOUR FROM {{customer}}""".replace("{{", "{").replace("}}", "}"),
    "keywords": "SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS term FROM {part}",
    "article_keywords": "SELECT DISTINCT l_orderkey AS article_id, l_partkey AS keyword_id FROM {lineitem}",
    "categories": "SELECT n_nationkey AS id, lower(n_name) AS name FROM {nation}",
    "article_categories": "SELECT o_orderkey AS article_id, CAST(o_custkey % 25 AS INT) AS category_id FROM {orders}",
    "authors": "SELECT c_custkey AS id, c_name AS name FROM {customer}",
    "article_authors": "SELECT o_orderkey AS article_id, o_custkey AS author_id FROM {orders}",
    # order key, line number and ship date do not identify a line: all columns decide, equal lines get one number each
    "snapshots": """
SELECT article_id * 1000 + seq AS id, article_id, seq, captured_at, change_kind, word_delta, added FROM (
  SELECT l_orderkey AS article_id, l_shipdate AS captured_at,
         CASE l_returnflag WHEN 'R' THEN 'edit' WHEN 'A' THEN 'extension' END AS change_kind,
         CAST(l_quantity AS BIGINT) - 25 AS word_delta, l_linestatus AS added,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq
  FROM {lineitem} WHERE l_returnflag <> 'N') s""",
    "versions": """
SELECT conv_id AS article_id, turn AS seq, TIMESTAMP '2024-01-01 00:00:00' + (turn * 60 + conv_id) * INTERVAL 1 MINUTE AS scanned_at,
       text AS title, text AS body, role FROM {conversations}""",
    "link_observations": """
SELECT date_trunc('hour', ts) AS run_id, user_id % 6 + 1 AS source_id, concat('https://x.example/a/', user_id) AS article_url,
       concat('/', event_type, '/') AS ref_url,
       CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'section' WHEN 'purchase' THEN 'feed' WHEN 'signup' THEN 'sitemap' END AS ref_kind,
       ts AS seen_at FROM {events} WHERE event_type IN ('view', 'click', 'purchase', 'signup')""",
}
STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# tables whose rows are long texts or vectors
TEXT_TABLES = ("documents", "pages", "conversations", "embeddings")


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = pin_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_scan(df) if name in TEXT_TABLES else df


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain table as a DataFrame."""
    text = TEMPLATES[name]
    used = {t: star(spark, sf_dir, t) for t in STAR_TABLES if "{" + t + "}" in text}
    df = spark.sql(text.replace("VARCHAR(100)", "STRING"), **used)
    casts = [df[f.name].cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else df[f.name] for f in df.schema.fields]
    return df.select(*casts)


def domain(spark: SparkSession, sf_dir: str, *names: str) -> Tables:
    """Bundle of the named domain tables (all when none is named)."""
    return Tables(**{n: derive(spark, sf_dir, n) for n in (names or TEMPLATES)})
