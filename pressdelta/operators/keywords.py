"""Keyword statistics: options, daily trends, movement, document frequency, related articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta.functions.timeutil import as_date, as_ts, axis_time, berlin_day, day_spine
from pressdelta.operators.filters import FilterParams, select_articles
from pressdelta.plans.patterns import small, top_per_group, written
from pressdelta.sources.tables import Tables


# articles of a keyword in one block of the neighbour join
BLOCK = 2000
# pairs of articles a task of the neighbour join holds
PAIRS_PER_TASK = 1_000_000
# keywords of an article up to which each of its links carries tags of the others
TAGS = 128


def keyword_opts(t: Tables, p: FilterParams = FilterParams(), limit: int = 80) -> DataFrame:
    """Most used keywords among the filtered articles: (term, n).  Counts per integer key, cuts, then looks up the
    text of the winners only."""
    arts = select_articles(t, p)
    if p.range_from is not None:
        arts = arts.filter(F.col("published_at") >= as_ts(p.range_from))
    if p.range_to is not None:
        arts = arts.filter(F.col("published_at") <= as_ts(p.range_to))
    used = t.article_keywords.join(arts.select(F.col("id").alias("article_id")), "article_id")
    top = used.groupBy("keyword_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword_id").limit(limit)
    # at most `limit` rows by construction
    terms = t.keywords.select(F.col("id").alias("keyword_id"), "term").join(F.broadcast(top), "keyword_id")
    return terms.select("term", "n").orderBy(F.desc("n"), "term")


def keyword_trends(t: Tables, p: FilterParams = FilterParams(), limit: int | None = None) -> DataFrame:
    """Day series of keywords, long form: (term, total, d, n); `limit` keeps the most used ones.

    Mentions are counted per (keyword, day) and per keyword on integer keys, the top is cut if asked for, and the text is joined
    to what is left.  Both aggregations combine on the map side.
    """
    arts = select_articles(t, p).select(F.col("id").alias("article_id"), axis_time(p.axis, first="first_seen").alias("t")).filter(F.col("t").isNotNull())
    if p.range_from is not None:
        arts = arts.filter(F.col("t") >= as_ts(p.range_from))
    if p.range_to is not None:
        arts = arts.filter(F.col("t") <= as_ts(p.range_to))
    days = arts.select("article_id", berlin_day(F.col("t")).alias("d"))
    daily = t.article_keywords.join(days, "article_id").groupBy("keyword_id", "d").agg(F.count("*").alias("n"))
    totals = daily.groupBy("keyword_id").agg(F.sum("n").alias("total"))
    named = totals.join(t.keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id")
    # a cut table has at most `limit` rows
    top = named if limit is None else F.broadcast(named.orderBy(F.desc("total"), "term").limit(limit))
    return daily.join(top, "keyword_id").select("term", "total", "d", "n")


def trend_series(trends: DataFrame) -> DataFrame:
    """One row per term with its day series as an array in day order."""
    return (trends.groupBy("term", "total").agg(F.array_sort(F.collect_list(F.struct("d", "n"))).alias("series"))
            .orderBy(F.desc("total"), "term"))


def series_json(series: DataFrame) -> DataFrame:
    """The array as JSON text."""
    return series.withColumn("series", F.to_json("series"))


def keyword_metrics(trends: DataFrame, first_day, last_day) -> DataFrame:
    """Movement of each term over a fixed span of days.

    Zero days are not materialised as rows: sums over the existing days, with the known number of days, give the
    same values.  Half sums leave the odd middle day out; delta and pct compare them (pct NULL = new); slope is the
    least-squares slope over day numbers; spike is the z-score of the peak day (population deviation).
    """
    first, last = as_date(first_day), as_date(last_day)
    n = F.datediff(last, first) + 1
    half = F.floor(n / 2)
    i = F.datediff(F.col("d"), first)
    v = F.col("n").cast("double")
    inside = trends.filter((F.col("d") >= first) & (F.col("d") <= last))
    per = inside.groupBy("term").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(i < half, F.col("n"))), F.lit(0)).alias("first"),
        F.coalesce(F.sum(F.when(i >= n - half, F.col("n"))), F.lit(0)).alias("second"),
        F.sum(i * v).alias("ixv"), F.sum(v * v).alias("vv"),
        F.max(F.struct(F.col("n").alias("n"), (-i).alias("neg"))).alias("peak"), F.count("*").alias("active_days"))
    # the span is the same for all rows; a term's own reported total counts towards the overall volume
    volume = trends.groupBy("term").agg(F.max("total").alias("total")).agg(F.sum("total").alias("grand"))
    halves = per.agg(F.sum("first").alias("g1"), F.sum("second").alias("g2"))
    days = n.cast("double")
    mean = F.col("total") / days
    sxx = days * (days * days - 1) / 12
    slope = F.when(sxx > 0, (F.col("ixv") - (days - 1) / 2 * F.col("total")) / sxx).otherwise(0.0)
    var = F.greatest(F.col("vv") / days - mean * mean, F.lit(0.0))
    std = F.sqrt(var)
    share = lambda c, base: F.col(c) / F.when(base != 0, base).otherwise(F.lit(1))
    grand, g1, g2 = _scalar(volume, "grand"), _scalar(halves, "g1"), _scalar(halves, "g2")
    return per.select(
        "term", "total", "first", "second", (F.col("second") - F.col("first")).alias("delta"),
        F.when(F.col("first") > 0, (F.col("second") - F.col("first")) / F.col("first") * 100).alias("pct"),
        slope.alias("slope"), mean.alias("mean"), F.col("peak.n").alias("peak_val"), F.date_add(first, -F.col("peak.neg")).alias("peak_day"),
        F.when(std > 1e-9, (F.col("peak.n") - mean) / std).otherwise(0.0).alias("spike"), "active_days",
        share("total", grand).alias("share"), share("first", g1).alias("share_first"), share("second", g2).alias("share_second"),
        (share("second", g2) - share("first", g1)).alias("share_delta"))


def _scalar(one_row: DataFrame, column: str) -> Column:
    """Value of a one-row aggregate as an expression; no window over all rows and no join is needed."""
    return F.coalesce(one_row.select(column).scalar(), F.lit(0))


def zero_filled(trends: DataFrame, first_day, last_day) -> DataFrame:
    """Long series with a row for every day of the span.

    A term's days come together once; the days it lacks are added to them in the same task, so the filled rows, which are many more than
    the counts, are not shuffled or joined.  A term that is null has no counts."""
    first, last = as_date(first_day), as_date(last_day)
    inside = F.col("term").isNotNull() & F.col("d").between(first, last)
    days = trends.groupBy("term").agg(F.collect_list(F.when(inside, F.struct("d", F.coalesce("n", F.lit(0)).alias("n")))).alias("known"))
    lacking = F.transform(F.array_except(day_spine(first, last), F.transform("known", lambda x: x["d"])), lambda d: F.struct(d.alias("d"), F.lit(0).cast("bigint").alias("n")))
    return days.select("term", F.inline_outer(F.concat("known", lacking)))


def movers(metrics: DataFrame, mode: str = "count", k: int = 10, min_total: int = 3) -> DataFrame:
    """Strongest rises and falls, by count or by share of all mentions: (direction, rank, term, move)."""
    move = F.col("share_delta" if mode == "share" else "delta").cast("double")
    base = metrics.filter(F.col("total") >= min_total).select("term", "total", move.alias("move"))
    up = base.filter(F.col("move") > 0).orderBy(F.desc("move"), "term").limit(k)
    down = base.filter(F.col("move") < 0).orderBy("move", "term").limit(k)
    ranked = lambda d, name, order: d.withColumn("direction", F.lit(name)).withColumn("rank", F.row_number().over(W.partitionBy("direction").orderBy(order, "term")))
    return ranked(up, "riser", F.desc("move")).unionByName(ranked(down, "faller", F.asc("move")))


def chart_terms(metrics: DataFrame, by: str = "movers", mode: str = "count", k: int = 6, min_total: int = 3) -> DataFrame:
    """Terms for a chart: largest movement in either direction, or largest volume."""
    move = F.abs(F.col("share_delta" if mode == "share" else "delta").cast("double"))
    order = move if by == "movers" else F.col("total").cast("double")
    return metrics.filter(F.col("total") >= min_total).select("term", "total", order.alias("weight")).orderBy(F.desc("weight"), "term").limit(k)


def keyword_dfs(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Number of articles per keyword, for all or the given keyword ids."""
    links = t.article_keywords if ids is None else t.article_keywords.join(ids.select("keyword_id").distinct(), "keyword_id", "left_semi")
    return links.groupBy("keyword_id").agg(F.count("*").alias("df"))


def cloud_weights(opts: DataFrame) -> DataFrame:
    """Square-root scale 0..1 between the smallest and largest count (1 when all are equal)."""
    edge = opts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    lo, hi = F.sqrt(edge.select("lo").scalar()), F.sqrt(edge.select("hi").scalar())
    return opts.withColumn("weight", F.when(hi == lo, 1.0).otherwise((F.sqrt("n") - lo) / (hi - lo)))


def article_terms(t: Tables, ids: DataFrame | None = None, shown: int = 6) -> DataFrame:
    """Keywords of each article in keyword order: all of them, and the first ones that are shown."""
    links = t.article_keywords if ids is None else t.article_keywords.join(ids.select("article_id").distinct(), "article_id", "left_semi")
    named = links.join(t.keywords.select(F.col("id").alias("keyword_id"), "term"), "keyword_id")
    lists = named.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("keyword_id", "term"))), lambda x: x["term"]).alias("terms"))
    return lists.withColumn("shown", F.slice("terms", 1, shown))


def neighbours(t: Tables, overview: DataFrame | None = None, ids: DataFrame | None = None, own: int | None = None, max_df: int | None = None,
               min_shared: int = 2, k: int = 8) -> DataFrame:
    """Articles that share rare keywords: (article_id, neighbour_id, score, shared, cross).

    Score is the sum of 1/sqrt(df) over the shared keywords.  Articles meet by keyword.  Each link carries 16-bit tags of the article's other
    keywords, so that two articles which share nothing else are known when they meet, and such pairs, nearly all, are never shuffled; equal
    tags of different keywords let a few through, which the exact count then drops.  Links of an article with more than `TAGS` keywords carry no tags.

    The articles of a keyword are dealt into blocks of `BLOCK` that meet in pairs, so a keyword that many articles carry is worked on by many
    tasks; the number of tasks follows the number of pairs, so that none holds more of them when the input grows, and the ranking runs
    in two rounds.  Without `own` and `ids` a pair counts the same for both articles: it is summed once and then turned round.  `own` and `max_df`
    leave keywords out if asked for: all but the first of an article, and those of more articles.
    """
    # keywords of each article, with repeats; links without an article only count for their keywords
    lone = F.when(F.col("article_id").isNull(), F.col("keyword_id")).alias("lone")
    by_article = t.article_keywords.select("article_id", "keyword_id", lone).repartition("article_id", "lone").groupBy("article_id", "lone")
    lists = written(by_article.agg(F.array_sort(F.collect_list("keyword_id")).alias("keywords"), F.count_if(F.col("keyword_id").isNull()).cast("int").alias("blank")), "article-keywords")
    df = written(lists.select(F.explode("keywords").alias("keyword_id")).groupBy("keyword_id").agg(F.count("*").alias("df")), "keyword-df")
    df = df if max_df is None else df.filter(F.col("df") <= max_df)
    total = df.agg(F.sum(F.col("df") * F.col("df"))).first()[0] or 0
    session = df.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS_PER_TASK))
    both = own is None and ids is None
    # at most one in BLOCK links
    often = small(written(df.filter(F.col("df") > BLOCK).select("keyword_id", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks")), "keyword-blocks"))
    tagged = min_shared > 1

    def links(of: DataFrame) -> DataFrame:
        found = _links(of, tagged)
        found = found if max_df is None else found.join(df.select("keyword_id"), "keyword_id", "left_semi")
        return found.join(often, "keyword_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("article_id"), F.col("blocks")).cast("int"))

    bits = F.aggregate("tags", F.lit(0).cast("bigint"), lambda x, tag: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), tag.cast("int").bitwiseAND(F.lit(63)))))
    all_links = lists.filter(F.col("article_id").isNotNull())
    if both:
        # a block meets each block of its keyword, itself too, in one cell
        cells = links(all_links).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("article_id", "keyword_id", "tags", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
        key = ["keyword_id", "lo", "hi"]
        mine = other = cells.repartition(parts, *key)
    else:
        # rank before the frequency cut: the first keywords of an article are chosen among all of its keywords
        first = all_links if own is None else all_links.withColumn("keywords", F.slice("keywords", F.lit(1), F.greatest(F.lit(own) - F.col("blank"), F.lit(0))))
        if ids is not None:
            first = first.join(ids.select("article_id").distinct(), "article_id", "left_semi")
        key = ["keyword_id", "block"]
        mine = links(first).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("article_id", "tags", *key).repartition(parts, *key)
        other = links(all_links).select("article_id", "tags", *key).repartition(parts, *key)
    mine = mine.withColumn("bits", bits)
    other = other.withColumn("bits", bits).select(*key, *[F.col(c).alias(n) for c, n in (("article_id", "neighbour_id"), ("tags", "n_tags"), ("bits", "n_bits"), ("block", "n_block")) if n != "n_block" or both])
    pairs = mine.join(other, key)
    if both:
        pairs = pairs.filter((F.col("article_id") < F.col("neighbour_id")) & ((F.col("lo") == F.col("hi")) | (F.col("block") != F.col("n_block"))))
    else:
        pairs = pairs.filter(F.col("article_id") != F.col("neighbour_id"))
    # unknown without tags
    pairs = pairs.filter(F.coalesce((F.col("bits").bitwiseAND(F.col("n_bits")) != 0) & F.arrays_overlap("tags", "n_tags"), F.lit(True)))
    weighed = pairs.select("article_id", "neighbour_id", "keyword_id").join(df.select("keyword_id", (F.lit(1.0) / F.sqrt("df")).alias("w")), "keyword_id")
    scored = weighed.groupBy("article_id", "neighbour_id").agg(F.sum("w").alias("score"), F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    if both:
        way = lambda a, n: F.struct(F.col(a).alias("article_id"), F.col(n).alias("neighbour_id"))
        ways = F.explode(F.array(way("article_id", "neighbour_id"), way("neighbour_id", "article_id")))
        scored = scored.select(ways.alias("p"), "score", "shared").select("p.*", "score", "shared")
    best = top_per_group(scored, ["article_id"], [F.desc(F.round("score", 9)), F.asc("neighbour_id")], k, spread=["neighbour_id"])
    if overview is None:
        return best.select("article_id", "neighbour_id", "rn", "score", "shared")
    best = written(best.select("article_id", "neighbour_id", "rn", "score", "shared"), "article-neighbours")
    # one pass over the articles, with what the pairs need of them
    named = small(best.select("article_id").union(best.select("neighbour_id")).distinct())
    told = written(overview.select("article_id", "source_id", "title", "outlet", "country").join(named, "article_id", "left_semi"), "neighbour-facts")
    facts = told.select(F.col("article_id").alias("neighbour_id"), F.col("source_id").alias("n_source"), "title", "outlet", "country")
    home = told.select("article_id", F.col("source_id").alias("a_source"))
    return (best.join(facts, "neighbour_id").join(home, "article_id")
            .select("article_id", "neighbour_id", "rn", "score", "shared", "title", "outlet", "country", (F.col("n_source") != F.col("a_source")).alias("cross")))


def _links(lists: DataFrame, tagged: bool) -> DataFrame:
    """(article_id, keyword_id, tags): tags of the article's other keywords; null where they cannot tell, as when the keyword comes twice."""
    tags = F.transform("keywords", lambda x: (F.pmod(F.xxhash64(x), F.lit(65536)) - 32768).cast("smallint"))
    rows = lists.select("article_id", "keywords", (tags if tagged else F.lit(None).cast("array<smallint>")).alias("tags")).select("article_id", F.posexplode("keywords").alias("at", "keyword_id"), "keywords", "tags")
    same = lambda at: F.coalesce(F.get("keywords", at) == F.col("keyword_id"), F.lit(False))
    alone = ~same(F.col("at") - 1) & ~same(F.col("at") + 1) & (F.size("keywords") <= TAGS)
    others = F.concat(F.slice("tags", F.lit(1), F.col("at")), F.slice("tags", F.col("at") + 2, F.size("keywords")))
    return rows.select("article_id", "keyword_id", F.when(alone, others).alias("tags"))
