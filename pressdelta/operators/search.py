"""Search by a posting table of n-grams: written once, kept up by deltas, read once for any number of terms.

Units of text are articles (title, URL, description, topic), keywords and categories.  A posting says that a unit holds a gram of three
characters (or the two a text ends in), in lower case; a gram of two is met by the postings that begin with it.  Postings lie in buckets by
their first two characters, sorted, so that a search opens only the buckets of its grams and skips row groups.  Of each term's grams the rarest few are met first; units that have all of them are verified against their current text.  Postings of
older versions of a text do no harm, as the verification drops them: a delta only adds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressdelta.plans.patterns import scratch_path
from pressdelta.sources.tables import Tables

GRAM, SHORTEST, RAREST, BUCKETS = 3, 2, 3, 64
OWN = ("title", "url", "description", "topic")
# (kind, table, key of the junction, junction, column)
DIMENSIONS = (("keyword", "keywords", "keyword_id", "article_keywords", "term"), ("category", "categories", "category_id", "article_categories", "name"))


def units(t: Tables) -> DataFrame:
    """(kind, id, texts): the texts of every unit in lower case."""
    rows = t.articles.select(F.lit("article").alias("kind"), F.col("id").cast("bigint").alias("id"), F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in OWN]).alias("texts"))
    for kind, table, _, _, column in DIMENSIONS:
        if getattr(t, table) is not None:
            rows = rows.unionByName(getattr(t, table).select(F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"), F.array(F.lower(F.coalesce(F.col(column), F.lit("")))).alias("texts")))
    return rows


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, SHORTEST)), F.lit(BUCKETS)).cast("int")


def postings(units_: DataFrame) -> DataFrame:
    """(gram, kind, id, bucket): each gram of a unit once, told apart within the row.  The stretches of a text that are left at its end are
    shorter than a gram: that of two characters is needed for terms of two."""
    found = F.array_distinct(F.flatten(F.transform("texts", lambda x: F.filter(ends(x), lambda g: F.length(g) >= SHORTEST))))
    return units_.select("kind", "id", F.explode_outer(found).alias("gram")).filter("gram IS NOT NULL").withColumn("bucket", bucket_of(F.col("gram")))


def ends(text: Column) -> Column:
    """The stretches of `GRAM` characters that begin at each character but the last, the final one being shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (SHORTEST - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))


class SearchIndex:
    """Postings and counts of grams under a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "search-index")

    def add(self, units_: DataFrame) -> SearchIndex:
        """Postings of new units, or of units whose text changed."""
        p = postings(units_)
        p.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        return self

    def _postings(self, pairs: DataFrame, buckets: Sequence[int]) -> DataFrame:
        found = self.spark.read.schema("gram string, kind string, id bigint, bucket int").parquet(f"{self.path}/postings")
        # named buckets and grams: other folders and row groups are not opened
        met = found.filter(F.col("bucket").isin(*buckets)).select("kind", "id", F.explode(F.array_distinct(F.array("gram", F.substring("gram", 1, SHORTEST)))).alias("gram"))
        return met.join(F.broadcast(pairs), "gram")

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """(term, kind, id): units that hold the rarest grams of a term.  One scan of the postings counts the grams, one more meets them."""
        # stretches between the wildcards of a pattern
        parts = [(q, x) for q in terms for x in re.split(r"[%_\\]", q.lower()) if len(x) >= SHORTEST]
        wanted = sorted({(q, x[i : i + n]) for q, x in parts for n in [min(GRAM, len(x))] for i in range(len(x) - n + 1)})
        pairs = self.spark.createDataFrame(wanted, "term string, gram string")
        buckets = [r.b for r in pairs.select(bucket_of(F.col("gram")).alias("b")).distinct().collect()] or [-1]
        met = self._postings(pairs.select("gram").distinct(), buckets)
        # as many rows as the terms have grams
        counts = {r.gram: r.n for r in met.groupBy("gram").agg(F.count("*").alias("n")).collect()}
        rare = [(q, g) for q in dict.fromkeys(q for q, _ in wanted) for g in sorted((g for p, g in wanted if p == q), key=lambda g: (counts.get(g, 0), g))[:RAREST]]
        need = {q: sum(p == q for p, _ in rare) for q, _ in rare}
        few = self.spark.createDataFrame([(q, g, need[q]) for q, g in rare], "term string, gram string, need int")
        hits = self._postings(few, buckets).groupBy("term", "kind", "id", "need").agg(F.countDistinct("gram").alias("n"))
        return hits.filter("n = need").select("term", "kind", "id")

    def search(self, t: Tables, terms: Sequence[str], sources: Sequence[int] = ()) -> DataFrame:
        """(term, article_id): articles with a text, keyword or category that contains the term, ignoring case.  Each table is read once, whatever the
        number of terms."""
        terms = [q for q in dict.fromkeys(terms) if len(q) >= SHORTEST]
        found = self.candidates(terms).join(units(t), ["kind", "id"]).select("term", "kind", "id", "texts")
        # patterns without a stretch of two characters are held against every unit
        loose = [q for q in terms if all(len(x) < SHORTEST for x in re.split(r"[%_\\]", q))]
        if loose:
            found = found.unionByName(units(t).select(F.explode(F.array(*[F.lit(q) for q in loose])).alias("term"), "kind", "id", "texts"))
        hit = found.filter(F.exists("texts", lambda x: F.ilike(x, F.concat(F.lit("%"), "term", F.lit("%"))))).select("term", "kind", "id")
        lists = [hit.filter("kind = 'article'").select("term", F.col("id").alias("article_id"))]
        for kind, table, key, junction, _ in DIMENSIONS:
            if getattr(t, table) is not None:
                lists.append(hit.filter(F.col("kind") == kind).select("term", F.col("id").alias(key)).join(getattr(t, junction), key).select("term", "article_id"))
        rows = t.articles.filter(F.col("is_article"))
        if sources:
            rows = rows.filter(F.col("source_id").isin(*sources))
        return reduce(DataFrame.union, lists).distinct().join(rows.select(F.col("id").alias("article_id")), "article_id", "left_semi").select("term", "article_id")
