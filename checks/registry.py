"""Where the registered queries and their SQL forms are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressdelta.sources.driver_tables import STAR_TABLES, TEMPLATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _template(name: str) -> str:
    return TEMPLATES[name].format(**{t: t for t in STAR_TABLES})


OVERVIEW = """
d_overview AS MATERIALIZED (
  SELECT a.id, a.id AS article_id, source_id, url,
         CASE WHEN kind <> 'article' THEN kind WHEN article_type = 'timeline' THEN 'timeline' WHEN paywalled THEN 'paywall' ELSE 'artikel' END AS ptype,
         topic, author_status, paywalled, s.language, published_at, first_seen AS discovered_at, last_seen, link_seen,
         coalesce(epoch(link_seen) - epoch(first_seen) > 7200, FALSE) AS link_resighted, word_count, revision_count, edit_count, extension_count, scan_count,
         rubric, depth, title, s.name AS outlet, s.country
  FROM d_articles a JOIN d_sources s ON s.id = a.source_id),
d_corpus AS MATERIALIZED (SELECT * FROM d_overview WHERE ptype IN ('artikel', 'paywall', 'timeline', 'blog')),
d_cuts AS (SELECT source_id, max(link_seen) - (CASE source_id WHEN 1 THEN 72 WHEN 3 THEN 26 WHEN 4 THEN 26 WHEN 5 THEN 6 WHEN 6 THEN 36 ELSE 26 END) * INTERVAL 1 HOUR AS cut
           FROM d_corpus WHERE link_seen IS NOT NULL GROUP BY source_id)"""


def with_domain(sql: str) -> str:
    """Prefix the SQL with the domain tables it names (d_<table>, d_overview, d_corpus, d_cuts)."""
    needs = {n for n in TEMPLATES if f"d_{n}" in sql}
    views = any(v in sql for v in ("d_overview", "d_corpus", "d_cuts"))
    if views:
        needs |= {"articles", "sources"}
    parts = [f"d_{n} AS MATERIALIZED ({_template(n)})" for n in TEMPLATES if n in needs]
    if views:
        parts.append(OVERVIEW)
    body = sql.strip()
    if not parts:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[14:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL form."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_domain(sql)
        return fn
    return wrap


def berlin(expr: str) -> str:
    """SQL text: Berlin wall-clock time of a UTC timestamp."""
    return f"timezone('Europe/Berlin', timezone('UTC', {expr}))"


def berlin_day(expr: str) -> str:
    return f"CAST({berlin(expr)} AS DATE)"


def utc(expr: str) -> str:
    """SQL text: UTC timestamp of a Berlin wall-clock time."""
    return f"timezone('UTC', timezone('Europe/Berlin', {expr}))"
