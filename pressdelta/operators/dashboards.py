"""Key figures over the corpus: headline numbers, flows, topics, agenda, publishers, edits, table views.

Every figure is derived from a cell table (source, topic, day) or a smaller one.  The cells are counted with
map-side combining, so that a source with a third of all articles costs as much as any other; everything after them
works on a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta import constants as K
from pressdelta.functions.numbers import half_up, pct, ratio
from pressdelta.functions.timeutil import as_ts, axis_time, berlin_day, day_spine
from pressdelta.operators.filters import FilterParams, filter_corpus, with_link_cut
from pressdelta.operators.url_jobs import canon_category, canon_label, url_rubric
from pressdelta.plans.patterns import first_rows, group_quantiles, top_per_group
from pressdelta.sources.tables import Tables

def topic_or_rest() -> Column:
    return F.coalesce(F.col("topic"), F.lit(K.TOPIC_FALLBACK))


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def measures() -> list[Column]:
    """The additive measures of a cell."""
    c = F.col
    return [
        F.count("*").alias("n"), _count(c("paywalled")).alias("pw"), _count(c("author_status") == "named").alias("named"),
        F.count("author_status").alias("au"), _count(c("revision_count") > 0).alias("revised"),
        F.coalesce(F.sum("edit_count"), F.lit(0)).alias("edits"),
        F.coalesce(F.sum(F.when(c("word_count") > 0, c("word_count"))), F.lit(0)).alias("words"), _count(c("word_count") > 0).alias("words_n"),
        _count(c("ptype").isin(*K.TIMELINE_PTYPES)).alias("timelines"),
    ]


ADDITIVE = ("n", "pw", "named", "au", "revised", "edits", "words", "words_n", "timelines")


def cells(rows: DataFrame, *keys: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*measures())


def roll(cell: DataFrame, *keys: str) -> DataFrame:
    return cell.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ADDITIVE])


def _first(df: DataFrame, column: str) -> Column:
    return df.select(column).scalar()


def pulse(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None) -> DataFrame:
    """Headline figures of the filtered corpus, one row."""
    rows = filter_corpus(corpus, p, ids)
    cell = cells(rows, F.col("source_id"), topic_or_rest().alias("topic"), berlin_day(axis_time(p.axis)).alias("day"))
    days = cell.filter(F.col("day").isNotNull()).groupBy("day").agg(F.sum("n").alias("n"))
    # the 14 newest days only: a bounded list
    newest = days.orderBy(F.desc("day")).limit(14).agg(F.sort_array(F.collect_list(F.struct("day", "n")), asc=False).alias("d"))
    week = lambda a, b: F.aggregate(F.slice("d", a, b), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    pace = newest.select(week(1, 7).alias("recent"), week(8, 7).alias("prior"))
    n_days = days.agg(F.count("*").alias("k"))
    top = lambda key: cell.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(1)
    src, topic = top("source_id"), top("topic")
    total = cell.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ADDITIVE])
    recent, prior, k = _first(pace, "recent"), _first(pace, "prior"), _first(n_days, "k")
    c = F.col
    return total.select(
        "n", pct(c("pw"), c("n")).alias("paywall_pct"), pct(c("named"), c("au")).alias("named_pct"), pct(c("revised"), c("n")).alias("revised_pct"), "edits",
        F.coalesce(half_up(ratio(c("words"), c("words_n"))), F.lit(0)).alias("avg_words"), F.coalesce(half_up(ratio(c("words"), c("words_n")) / 200), F.lit(0)).alias("avg_read_min"),
        F.coalesce(c("n") / F.nullif(k.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("per_day"),
        F.when(prior > 0, half_up((recent - prior) / prior * 100)).alias("pace_pct"),
        _first(src, "source_id").alias("top_source"), _first(src, "n").alias("top_source_n"), pct(_first(src, "n"), c("n")).alias("top_source_pct"),
        _first(topic, "topic").alias("top_topic"), _first(topic, "n").alias("top_topic_n"), pct(_first(topic, "n"), c("n")).alias("top_topic_pct"))


def flux(corpus: DataFrame, p: FilterParams = FilterParams(), cuts: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Arrivals (first scan) and departures (last link sighting before the source's cut, seen more than once) per
    Berlin day, zero-filled between the first and the last such day."""
    rows = filter_corpus(with_link_cut(corpus, cuts), p, ids, skip_time=True)
    gone = F.when((F.col("link_seen") < F.col("link_cut")) & F.col("link_resighted"), F.col("link_seen"))
    events = rows.select(F.explode(F.array(F.struct(F.lit("in").alias("dir"), F.col("discovered_at").alias("t")), F.struct(F.lit("out").alias("dir"), gone.alias("t")))).alias("e")).select("e.*")
    events = events.filter(F.col("t").isNotNull())
    if p.range_from is not None:
        events = events.filter(F.col("t") >= as_ts(p.range_from))
    if p.range_to is not None:
        events = events.filter(F.col("t") <= as_ts(p.range_to))
    daily = events.groupBy(berlin_day(F.col("t")).alias("day")).agg(_count(F.col("dir") == "in").alias("gains"), _count(F.col("dir") == "out").alias("losses"))
    spine = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter(F.col("a").isNotNull()).select(F.explode(day_spine(F.col("a"), F.col("b"))).alias("day"))
    return spine.join(daily, "day", "left").select("day", F.coalesce("gains", F.lit(0)).alias("gains"), F.coalesce("losses", F.lit(0)).alias("losses"))


def topic_kpis(corpus: DataFrame, p: FilterParams, now, ids: DataFrame | None = None) -> DataFrame:
    """One card per topic, with its distance from the average over all topics (below 3 points: flat)."""
    rows = filter_corpus(corpus, p, ids, skip_topics=True)
    t, now = topic_or_rest().alias("topic"), as_ts(now)
    seen = F.col("discovered_at")
    per = rows.groupBy(t, "source_id").agg(*measures(), _count(seen >= now - F.expr("INTERVAL 7 DAYS")).alias("new_7d"), _count(seen >= now - F.expr("INTERVAL 24 HOURS")).alias("new_24h"))
    card = per.groupBy("topic").agg(*[F.sum(m).alias(m) for m in (*ADDITIVE, "new_7d", "new_24h")], F.count("*").alias("outlets"))
    total = card.agg(F.sum("n").alias("n"), F.sum("pw").alias("pw"), F.sum("named").alias("named"), F.sum("au").alias("au"))
    avg_pw, avg_named = pct(_first(total, "pw"), _first(total, "n")), pct(_first(total, "named"), _first(total, "au"))
    c = F.col
    card = card.select(
        "topic", c("n").alias("articles"), c("pw").alias("paywalled"), c("named").alias("au_named"), c("au").alias("au_total"), "new_7d", "new_24h", "outlets", "timelines",
        F.coalesce(half_up(ratio(c("words"), c("words_n"))), F.lit(0)).alias("avg_words"), "edits", (pct(c("pw"), c("n")) - avg_pw).alias("paywall_pp"),
        (pct(c("named"), c("au")) - avg_named).alias("named_pp"))
    mark = lambda d: F.when(F.abs(d) < 3, "flat").when(d > 0, "above").otherwise("below")
    return card.withColumns({"paywall_mark": mark(c("paywall_pp")), "named_mark": mark(c("named_pp"))}).orderBy(F.desc("articles"), "topic")


def topic_options(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None) -> DataFrame:
    return filter_corpus(corpus, p, ids, skip_topics=True).groupBy(topic_or_rest().alias("topic")).agg(F.count("*").alias("n"))


def rubric_tree(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None, min_n: int = 1, k: int | None = None) -> DataFrame:
    """Publishers' own rubrics per topic, bundled across languages: (topic, key, label, n, sources, raw_keys, rank).
    Rubrics come from the path of the rubric URL or the article URL; `min_n` and `k` keep those with so many articles, and the largest."""
    rows = filter_corpus(corpus, p, ids, skip_topics=True)
    rub = url_rubric(F.coalesce(F.when(F.col("rubric") != "", F.col("rubric")), F.col("url")))
    keyed = rows.select(topic_or_rest().alias("topic"), "source_id", rub.alias("r")).filter(F.col("r").isNotNull())
    per_source = keyed.groupBy("topic", F.col("r.raw").alias("raw"), F.col("r.label").alias("label"), "source_id").agg(F.count("*").alias("n"))
    raw = per_source.groupBy("topic", "raw", "label").agg(F.sum("n").alias("n"), F.collect_set("source_id").alias("src")).filter(F.col("n") >= min_n)
    raw = raw.withColumn("key", F.coalesce(canon_category(F.col("label")), F.replace(F.col("raw"), F.lit("/"), F.lit("_"))))
    group = raw.groupBy("topic", "key").agg(
        F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("src")))).alias("sources"), F.array_sort(F.collect_list("raw")).alias("raw_keys"),
        F.min(F.struct((-F.col("n")).alias("o"), "raw", "label")).alias("top"))
    group = group.select("topic", "key", canon_label(F.col("key"), F.col("top.label")).alias("label"), "n", "sources", "raw_keys")
    if k is None:
        return group.withColumn("rank", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "key")))
    return top_per_group(group, ["topic"], [F.desc("n"), F.asc("key")], k, rank="rank", spread=["key"])


def agenda_cells(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None) -> DataFrame:
    """(source, topic) cells of the filtered corpus."""
    return cells(filter_corpus(corpus, p, ids, skip_topics=True), F.col("source_id"), topic_or_rest().alias("topic"))


def main_topics(cell: DataFrame, k: int | None = None) -> DataFrame:
    """Topics with at least 5 articles and half a percent of all; `k` keeps the largest."""
    t = roll(cell, "topic")
    total = _first(cell.agg(F.sum("n").alias("t")), "t")
    t = t.filter(F.col("n") >= F.greatest(F.lit(5.0), total * F.lit(0.005))).orderBy(F.desc("n"), "topic")
    return first_rows(t, k)


def agenda_matrix(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Publisher x topic: count, share of the publisher's output, index against the market share of the topic, mark."""
    cell = agenda_cells(corpus, p, ids)
    return matrix_from_cells(cell, k)


def matrix_from_cells(cell: DataFrame, k: int | None = None) -> DataFrame:
    total = _first(cell.agg(F.sum("n").alias("t")), "t")
    topics = main_topics(cell, k).select("topic", F.col("n").alias("topic_n"))
    pubs = roll(cell, "source_id").select("source_id", F.col("n").alias("source_n"))
    # every publisher shows every main topic, empty cells included; half a percent of all each bounds their number
    shown = topics.agg(F.collect_list("topic").alias("all"))
    grid = pubs.withColumn("topic", F.explode(_first(shown, "all"))).join(topics, "topic")
    m = grid.join(cell.select("source_id", "topic", "n"), ["source_id", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.col("source_n").cast("double")
    index = share / (F.col("topic_n") / total.cast("double"))
    return m.select("source_id", "topic", "n", "source_n", "topic_n", share.alias("share"), index.alias("affinity"),
                    F.when((F.col("n") >= 15) & (index >= 1.5), "up").when((F.col("n") >= 15) & (index <= 0.5), "down").alias("mark"))


def diversity(cell: DataFrame) -> DataFrame:
    """Entropy of each publisher's topic mix over the logarithm of the number of topics in the market."""
    topics = _first(cell.agg(F.countDistinct("topic").alias("k")), "k")
    shares = cell.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("source_id")))
    h = shares.groupBy("source_id").agg(F.sum("n").alias("n"), (-F.sum(F.col("share") * F.ln("share"))).alias("h"))
    return h.select("source_id", "n", F.when(topics > 1, F.col("h") / F.ln(topics.cast("double"))).otherwise(0.0).alias("diversity"))


def dominance(cell: DataFrame, k: int | None = None) -> DataFrame:
    """Share of voice of a publisher in a topic (35 % and more of at least 30) and specialisation (index 1.4 and more,
    15 articles of at least 60): (kind, source_id, topic, value)."""
    m = matrix_from_cells(cell, k)
    voice = m.filter((F.col("topic_n") >= 30) & (F.col("n") > 0)).withColumn("value", F.col("n") / F.col("topic_n").cast("double")).filter(F.col("value") >= 0.35)
    special = m.filter((F.col("source_n") >= 60) & (F.col("n") >= 15) & (F.col("affinity") >= 1.4)).withColumn("value", F.col("affinity"))
    pick = lambda d, kind: d.select(F.lit(kind).alias("kind"), "source_id", "topic", "value")
    return pick(voice, "share_of_voice").union(pick(special, "specialisation"))


def insights(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None) -> DataFrame:
    """Facts about the filtered corpus: (fact, source_id, topic, value); a fact without enough data is missing."""
    cell = agenda_cells(corpus, p, ids)
    c = F.col
    total = _first(cell.agg(F.sum("n").alias("t")), "t")

    def best(value: Column, cond: Column, *names: str, low: bool = False) -> Column:
        """Largest (or smallest) value under a condition; ties go to the smallest name."""
        return F.min(F.when(cond & value.isNotNull(), F.struct((value if low else -value).alias("o"), *names)))

    def unpack(df: DataFrame, facts: dict[str, tuple[Column, Column | None]], names: Sequence[str], sign: dict[str, int]) -> DataFrame:
        row = df.agg(*[expr.alias(f) for f, (expr, _) in facts.items()])
        item = lambda f, keep: F.struct(F.lit(f).alias("fact"), *[(c(f)[n] if n in names else F.lit(None)).cast("bigint" if n == "source_id" else "string").alias(n) for n in ("source_id", "topic")],
                                        (c(f)["o"] * sign.get(f, -1)).cast("double").alias("value"))
        out = row.select(F.explode(F.array(*[item(f, k) for f, (_, k) in facts.items()])).alias("x")).select("x.*").filter(c("value").isNotNull())
        for f, (_, least) in facts.items():
            if least is not None:
                out = out.filter((c("fact") != f) | (c("value") > least))
        return out

    topics = main_topics(cell)
    big_t = c("n") >= 30
    pw_share, named_share = ratio(c("pw"), c("n")), ratio(c("named"), c("au"))
    words = F.when(c("words_n") >= 5, ratio(c("words"), c("words_n")))
    by_topic = unpack(topics.withColumns({"pw_sh": pw_share, "named_sh": named_share, "avg_w": words, "tot": total.cast("double")}), {
        "paywall_topic": (best(c("pw_sh"), big_t, "topic"), F.lit(0.02)),
        "open_topic": (best(1 - c("pw_sh"), big_t, "topic"), None),
        "named_topic": (best(c("named_sh"), big_t & (c("au") >= 20), "topic"), None),
        "longest_topic": (best(c("avg_w"), big_t, "topic"), F.lit(0.0)),
        "shortest_topic": (best(c("avg_w"), big_t, "topic", low=True), None),
        "largest_topic": (best(c("n") / c("tot"), F.lit(True), "topic"), None),
    }, ("topic",), {"shortest_topic": 1})

    pubs = roll(cell, "source_id").join(diversity(cell).select("source_id", "diversity"), "source_id")
    big = c("n") >= 50
    enough = _first(pubs.agg(F.count_if(big).alias("k")), "k") >= 2
    anon = ratio(c("au") - c("named"), c("au"))
    words_p = half_up(ratio(c("words"), c("words_n"))).cast("double")
    cols = pubs.withColumns({"pw_sh": F.coalesce(pw_share, F.lit(0.0)), "named_sh": F.coalesce(named_share, F.lit(0.0)), "anon_sh": F.coalesce(anon, F.lit(0.0)), "avg_w": words_p, "enough": enough, "nn": c("n").cast("double")})
    by_pub = unpack(cols, {
        "broadest_agenda": (best(c("diversity"), big & c("enough"), "source_id"), None),
        "narrowest_agenda": (best(c("diversity"), big & c("enough"), "source_id", low=True), None),
        "paywall_source": (best(c("pw_sh"), big, "source_id"), F.lit(0.05)),
        "named_source": (best(c("named_sh"), big, "source_id"), F.lit(0.0)),
        "anonymous_source": (best(c("anon_sh"), big, "source_id"), F.lit(0.3)),
        "most_productive": (best(c("nn"), F.lit(True), "source_id"), None),
        "wordiest_source": (best(c("avg_w"), big & (c("avg_w") > 0), "source_id"), None),
    }, ("source_id",), {"narrowest_agenda": 1})

    lead = unpack(dominance(cell), {
        "specialisation": (best(c("value"), c("kind") == "specialisation", "source_id", "topic"), None),
        "share_of_voice": (best(c("value"), c("kind") == "share_of_voice", "source_id", "topic"), None),
    }, ("source_id", "topic"), {})
    return lead.union(by_topic).union(by_pub)


def topic_stats(corpus: DataFrame, p: FilterParams = FilterParams(), ids: DataFrame | None = None) -> DataFrame:
    """Paywall share, named share and mean length of the main topics with at least 10 articles."""
    c = F.col
    t = main_topics(agenda_cells(corpus, p, ids)).filter(c("n") >= 10)
    return t.select("topic", "n", ratio(c("pw"), c("n")).alias("paywall_share"), F.when(c("au") >= 10, ratio(c("named"), c("au"))).alias("named_share"),
                    F.when(c("words_n") >= 5, half_up(ratio(c("words"), c("words_n")))).alias("avg_words"))


def spotlight(corpus: DataFrame, p: FilterParams = FilterParams(), topics: int = 4, rubrics: int = 5) -> DataFrame:
    """The largest topics with their largest rubrics."""
    lead = main_topics(agenda_cells(corpus, p)).orderBy(F.desc("n"), "topic").limit(topics).select("topic")
    return rubric_tree(corpus, p, k=rubrics).join(F.broadcast(lead), "topic", "left_semi")


def publisher_compare(corpus: DataFrame, p: FilterParams, cur_from, cur_to, prev_from, period_days: float, ids: DataFrame | None = None) -> DataFrame:
    """Each publisher's period against the one before: rates per day, paywall and author percentages, differences.
    Percentage points are only given when the period before has at least 10 articles (with a known author)."""
    c, t = F.col, axis_time(p.axis)
    rows = filter_corpus(corpus, p, ids, skip_time=True)
    period = F.when((t >= as_ts(cur_from)) & (t <= as_ts(cur_to)), "cur").when((t >= as_ts(prev_from)) & (t < as_ts(cur_from)), "prev")
    rows = rows.withColumn("period", period).filter(c("period").isNotNull())

    def both(name: str, cond: Column) -> list[Column]:
        return [_count((c("period") == w) & cond).alias(f"{name}_{w}") for w in ("cur", "prev")]

    status = lambda s: c("author_status") == s
    s = rows.groupBy("source_id").agg(*both("articles", F.lit(True)), *both("paywalled", c("paywalled")), *both("named", status("named")), *both("anon", status("anonymous")), *both("none", status("none")))
    s = s.filter(c("articles_cur") > 0)
    au = {w: c(f"named_{w}") + c(f"anon_{w}") + c(f"none_{w}") for w in ("cur", "prev")}
    pw = {w: pct(c(f"paywalled_{w}"), c(f"articles_{w}")) for w in ("cur", "prev")}
    named = {w: pct(c(f"named_{w}"), au[w]) for w in ("cur", "prev")}
    return s.select(
        "source_id", c("articles_cur").alias("articles"), c("articles_prev").alias("prev_articles"), (c("articles_cur") / F.lit(float(period_days))).alias("per_day"),
        (c("articles_prev") / F.lit(float(period_days))).alias("prev_per_day"), (c("articles_cur") - c("articles_prev")).alias("delta"),
        F.when(c("articles_prev") > 0, half_up((c("articles_cur") - c("articles_prev")) / c("articles_prev") * 100)).alias("delta_pct"),
        pw["cur"].alias("paywall_pct"), F.when(c("articles_prev") >= 10, pw["cur"] - pw["prev"]).alias("paywall_pp"),
        named["cur"].alias("named_pct"), F.when(au["prev"] >= 10, named["cur"] - named["prev"]).alias("named_pp"),
        pct(c("anon_cur"), au["cur"]).alias("anonymous_pct"), pct(c("none_cur"), au["cur"]).alias("none_pct"))


# --- edits -----------------------------------------------------------------------------------------------------------
def edits_summary(t: Tables, p: FilterParams = FilterParams(), limit: int | None = None) -> DataFrame:
    """Articles with changes: number of snapshots, edits, extensions, last change; most changed first."""
    changed = t.snapshots.groupBy("article_id").agg(F.count("*").alias("change_count"), F.max("captured_at").alias("last_change"))
    a = t.articles.select(F.col("id").alias("article_id"), "url", "title", "source_id", "edit_count", "extension_count", "first_seen")
    if p.sources:
        a = a.filter(F.col("source_id").isin(*p.sources))
    if p.range_from is not None:
        changed = changed.filter(F.col("last_change") >= as_ts(p.range_from))
    if p.range_to is not None:
        changed = changed.filter(F.col("last_change") <= as_ts(p.range_to))
    s = t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("outlet"), "country")
    rows = a.join(changed, "article_id")
    if limit:
        rows = rows.orderBy(F.desc("change_count"), "article_id").limit(limit)
    return rows.join(s, "source_id")


def edits_by_publisher(summary: DataFrame) -> DataFrame:
    return summary.groupBy("source_id", "outlet").agg(F.sum("change_count").alias("changes"), F.sum("edit_count").alias("edits"), F.sum("extension_count").alias("extensions"), F.count("*").alias("articles"))


def edits_totals(summary: DataFrame) -> DataFrame:
    """Totals and the mean number of changes per article (one decimal)."""
    tot = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("change_count", "changes"), ("edit_count", "edits"), ("extension_count", "extensions"))], F.count("*").alias("articles"))
    return tot.withColumn("mean_changes", F.round(ratio(F.col("changes"), F.col("articles")), 1))


# --- table views -----------------------------------------------------------------------------------------------------
AGGREGATES = ("sum", "avg", "median", "min", "max")


def footer(rows: DataFrame, specs: dict[str, str | Column]) -> DataFrame:
    """Footer of a table view: one row with an aggregate per column.  A spec is sum, avg (one decimal), median (the
    upper one), min, max, or an aggregate Column of the user's own."""
    plain = {k: v for k, v in specs.items() if isinstance(v, str)}
    if bad := [v for v in plain.values() if v not in AGGREGATES]:
        raise ValueError(f"unknown aggregates {bad}")

    def agg(col: str, kind: str) -> Column:
        c = F.col(col).cast("double")
        if kind == "avg":
            return F.floor(F.avg(c) * 10 + F.lit(0.5)) / 10
        if kind == "median":
            return half_up(_upper_median(rows, col))
        return half_up({"sum": F.sum, "min": F.min, "max": F.max}[kind](c))

    return rows.agg(*[(agg(c, v) if isinstance(v, str) else v).alias(c) for c, v in specs.items()])


def _upper_median(rows: DataFrame, col: str) -> Column:
    """Element floor(n/2) of the sorted values as a scalar: the quantile whose position is exactly that rank."""
    d = rows.select(F.lit(0).alias("g"), F.col(col).cast("double").alias("v"))
    n = _first(d.agg(F.count("v").alias("n")), "n")
    q = F.floor(n / 2) / F.greatest(n - 1, F.lit(1)).cast("double")
    return F.max(_first(group_quantiles(d, ["g"], "v", 1.0, q), "quantile"))


def group_view(rows: DataFrame, column: str) -> DataFrame:
    """Groups of a view by any column, largest first; empty values form one group."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("—")).alias("group")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group")


def corpus_stats(t: Tables) -> DataFrame:
    """Articles, revised articles, active sources."""
    active = t.sources.agg(F.count_if(F.col("active")).alias("k"))
    return t.articles.agg(F.count("*").alias("articles"), _count(F.col("revision_count") >= 1).alias("revised")).withColumn("sources", _first(active, "k"))


def sources_per_country(t: Tables) -> DataFrame:
    return t.sources.groupBy(F.coalesce("country", F.lit("—")).alias("country")).agg(F.count("*").alias("n"))


SORTABLE = {
    "title": "title", "outlet": "outlet", "ptype": "ptype", "topic": "topic", "author_status": "author_status", "scan": "scan_count",
    "published_at": "published_at", "discovered_at": "discovered_at", "last_seen": "last_seen", "word_count": "word_count",
    "reading_min": "reading_min", "revision_count": "revision_count",
}


def sort_keys(rows: DataFrame, column: str, direction: str = "asc") -> list[Column]:
    """Typed order: numbers by value, texts by number or date when they look like one, else by letters ignoring case
    and accents, with runs of digits inside a text by value; blanks last in both directions."""
    kind = dict(rows.dtypes)[column]
    c = F.col(column)
    turn = (lambda x: x.asc_nulls_last()) if direction == "asc" else (lambda x: x.desc_nulls_last())
    if kind != "string":
        return [turn(c)]
    text = F.when(c != "", c)
    number = F.when(F.trim(text).rlike(r"^-?\d+(?:[.,]\d+)?$"), F.regexp_replace(F.trim(text), ",", ".")).try_cast("double")
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(text, 1, 10)))
    # a run of digits sorts by its number of places without leading zeros, then by them: by value, however long
    plain = lambda run: F.regexp_replace(run, "^0+(?=.)", "")
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(plain(r)).cast("string"), 9, "0"), plain(r))).otherwise(r))
    natural = F.array_join(runs, "")
    return [F.isnull(text).asc(), turn(number), turn(date), turn(F.collate(natural, "UNICODE_CI_AI"))]


def sort_view(rows: DataFrame, column: str, direction: str = "asc", unique: str = "id") -> DataFrame:
    return rows.orderBy(*sort_keys(rows, column, direction), F.col(unique).asc())


def page(rows: DataFrame, sort: str | None = None, direction: str = "desc", number: int = 0, size: int = 100) -> DataFrame:
    """One page of the sorted view.  The unique id ends the order: without it rows are lost between pages."""
    c = F.col(SORTABLE.get(sort or "", "discovered_at"))
    order = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()
    return rows.orderBy(order, "id").offset(number * size).limit(size)


def page_total(rows: DataFrame, size: int = 100) -> DataFrame:
    n = rows.agg(F.count("*").alias("total"))
    return n.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has: empty when they are equal as multisets.  One aggregation over both."""
    cols = a.columns
    signed = a.withColumn("__s", F.lit(1)).unionByName(b.select(*cols).withColumn("__s", F.lit(-1)))
    net = signed.groupBy(*cols).agg(F.sum("__s").alias("__n")).filter(F.col("__n") != 0)
    side = F.when(F.col("__n") > 0, "a").otherwise("b")
    return net.withColumn("only_in", side).withColumn("__i", F.explode(F.sequence(F.lit(1), F.abs("__n")))).select(*cols, "only_in")


def is_active(overview: DataFrame, now, minutes: int = 4) -> DataFrame:
    """Did anything happen in the last minutes?"""
    return overview.agg(F.max("last_seen").alias("newest")).withColumn("active", F.coalesce(F.col("newest") > as_ts(now) - F.expr(f"INTERVAL {minutes} MINUTES"), F.lit(False)))
