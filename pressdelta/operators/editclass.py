"""What kind of correction a change is: tags with reasons, each behind a threshold of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressdelta import constants as K
from pressdelta.functions.text import common_prefix, is_name, let, norm_token, norm_words, number_tokens, occurrences, rx, simple_numbers, split_words, strip_punct

TAG = "struct<key:string,reason:string>"


def headline_kind(before: Column, after: Column) -> Column:
    """toned_down, sharpened, factual or other, for a headline pair."""
    cool = lambda c: c.rlike(rx(K.HEADLINE_COOLING))
    hot = lambda c: c.rlike(rx(K.HEADLINE_HEATING))
    lost, gained = cool(before) & ~cool(after), hot(after) & ~hot(before)
    nb, na = (F.array_join(simple_numbers(c), ",") for c in (before, after))
    return F.when(lost & ~gained, "toned_down").when(gained & ~lost, "sharpened").when((nb != "") & (na != "") & (nb != na), "factual").otherwise("other")


def word_set_diff(df: DataFrame, before: str, after: str) -> DataFrame:
    """Words of both sides with a flag: changed when the normal form is absent on the other side."""
    forms = lambda words: F.transform(words, lambda w: norm_token(w, inner=True))
    sides = F.struct(split_words(F.col(before)).alias("b"), split_words(F.col(after)).alias("a"))
    flag = lambda words, other: let(forms(other), lambda f: F.transform(words, lambda w: F.struct(w.alias("text"), (~F.array_contains(f, norm_token(w, inner=True))).alias("changed"))))
    pair = let(sides, lambda s: F.struct(flag(s["b"], s["a"]).alias("b"), flag(s["a"], s["b"]).alias("a")))
    df = df.withColumn("__pair", pair)
    return df.withColumns({"before_words": F.col("__pair.b"), "after_words": F.col("__pair.a")}).drop("__pair")


def _lexicon(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def pair_tags(o: Column, n: Column) -> Column:
    """Tags of a text pair: array<struct<key,reason>>, at least one ('rephrase').

    Words are cut once per row; set differences are hashed array operations, and the lists with repeats are only built
    from them where a tag can still apply.
    """
    words = F.struct(norm_words(o).alias("on"), norm_words(n).alias("nn"), number_tokens(o).alias("onum"), number_tokens(n).alias("nnum"))

    def sets(w: Column) -> Column:
        diff = F.struct(F.array_except(w["on"], w["nn"]).alias("rem"), F.array_except(w["nn"], w["on"]).alias("add"),
                        _first(F.array_except(w["onum"], w["nnum"])).alias("gone"), _first(F.array_except(w["nnum"], w["onum"])).alias("came"))
        return let(diff, lambda d: _tags(o, n, w, d))

    return let(words, sets)


def _tags(o: Column, n: Column, w: Column, d: Column) -> Column:
    # few words change: the long lists are only gone through for those that are in the lexicon
    within = lambda xs, changed, lexicon: let(F.filter(changed, lambda x: x.isin(*lexicon)), lambda few: F.when(F.size(few) == 0, few).otherwise(occurrences(xs, few)))
    marks = F.struct(within(w["nn"], d["add"], K.HEDGE_WORDS).alias("hedge_in"), within(w["on"], d["rem"], K.HEDGE_WORDS).alias("hedge_out"),
                     within(w["nn"], d["add"], K.HEAT_WORDS).alias("heat_in"), within(w["on"], d["rem"], K.HEAT_WORDS).alias("heat_out"), _factual(w, d).alias("fact"))
    return let(marks, lambda m: _tag_list(o, n, w, d, m))


def _number_change(w: Column, d: Column) -> tuple[Column, Column, Column]:
    gone, came = d["gone"].isNotNull(), d["came"].isNotNull()
    return gone & came, gone & (F.size(w["nnum"]) == 0), came & (F.size(w["onum"]) == 0)


def _factual(w: Column, d: Column) -> Column:
    """Numbers differ while at least 40 % of the words stay."""
    swap, drop, gain = _number_change(w, d)
    kept = F.size(w["on"]) - F.size(occurrences(w["on"], d["rem"]))
    overlap = kept.cast("double") / F.greatest(F.size(F.array_union(w["on"], w["nn"])), F.lit(1))
    return F.when(swap | drop | gain, overlap >= 0.4).otherwise(F.lit(False))


def _hedge_phrase(c: Column) -> Column:
    """The phrase pattern, behind a plain search for its words: the word borders are slow to look for everywhere."""
    low = F.lower(c)
    near = low.contains("nach angaben") | low.contains("berichten zufolge") | low.contains("nach informationen")
    return F.when(near, c.rlike(rx(K.HEDGE_PHRASE))).otherwise(F.lit(False))


def _tag_list(o: Column, n: Column, w: Column, d: Column, m: Column) -> Column:
    q = lambda x: F.concat(F.lit("„"), x, F.lit('"'))
    tag = lambda key, reason, cond: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(key).alias("key"), reason.alias("reason")))
    swap, drop, _ = _number_change(w, d)
    fact_reason = F.when(swap, F.concat(F.lit("Zahl geändert: "), d["gone"], F.lit(" → "), d["came"])).when(drop, F.concat(F.lit("Zahl entfernt: "), d["gone"])).otherwise(F.concat(F.lit("Zahl ergänzt: "), d["came"]))
    a, b = _first(d["rem"]), _first(d["add"])
    times = lambda xs, x: F.size(xs) - F.size(F.array_remove(xs, x))
    single = (F.size(d["rem"]) == 1) & (F.size(d["add"]) == 1) & (times(w["on"], a) == 1) & (times(w["nn"], b) == 1) & ~F.concat(a, b).rlike(r"\d")
    typo = F.when(single, (F.levenshtein(a, b) > 0) & (F.levenshtein(a, b) <= 2) & (F.greatest(F.length(a), F.length(b)) >= 5) & (common_prefix(a, b) >= 3))
    phrase_o, phrase_n = _hedge_phrase(o), _hedge_phrase(n)
    hedged = (F.size(m["hedge_in"]) > 0) | (phrase_n & ~phrase_o)
    unhedged = (F.size(m["hedge_out"]) > 0) | (phrase_o & ~phrase_n)
    word = lambda xs: q(F.coalesce(_first(xs), F.lit("nach Angaben")))
    hedge_reason = F.when(hedged, F.concat(F.lit("Absicherung eingefügt: "), word(m["hedge_in"]))).otherwise(F.concat(F.lit("Absicherung entfernt: "), word(m["hedge_out"])))
    role = F.exists(d["add"], lambda x: x.isin(*K.ROLE_WORDS))
    lost_names = F.when(role, F.filter(split_words(o), lambda x: is_name(x) & F.array_contains(d["rem"], norm_token(x)) & ~norm_token(x).isin(*K.HEDGE_WORDS)))
    name_reason = F.concat(F.lit("Name entfernt: "), q(F.array_join(F.transform(F.slice(lost_names, 1, 2), strip_punct), " ")))
    hot, cold = F.size(m["heat_in"]), F.size(m["heat_out"])
    sharper = (hot > 0) & (hot >= cold) & ~m["fact"]
    softer = (cold > 0) & (cold > hot) & ~m["fact"]
    found = F.filter(F.array(
        tag("factual", fact_reason, m["fact"]), tag("typo", F.concat(F.lit("Schreibweise: "), q(a), F.lit(" → "), q(b)), typo), tag("attribution", hedge_reason, hedged | unhedged),
        tag("anonymization", name_reason, F.size(lost_names) > 0), tag("sharpened", F.concat(F.lit("Wertung eingefügt: "), q(_first(m["heat_in"]))), sharper),
        tag("toned", F.concat(F.lit("Wertung entfernt: "), q(_first(m["heat_out"]))), ~sharper & softer)), lambda x: x.isNotNull()).cast(f"array<{TAG}>")
    fallback = F.array(F.struct(F.lit("rephrase").alias("key"), F.lit("gleiche Aussage, neu formuliert").alias("reason"))).cast(f"array<{TAG}>")
    return let(found, lambda t: F.when(F.size(t) == 0, fallback).otherwise(t))


def with_pair_tags(df: DataFrame, old: str = "old", new: str = "new", out: str = "tags") -> DataFrame:
    return df.withColumn(out, pair_tags(F.col(old), F.col(new)))


def tag_rank(key: Column) -> Column:
    return F.array_position(_lexicon(K.TAG_PRIORITY), key)


def classify_snapshots(snapshots: DataFrame, limit: int | None = None, key: str = "id") -> DataFrame:
    """Tags of snapshots: (id, tags[key, reason]).

    Snapshots bring reconciled changes (array<struct<old,new>>), title_old, title_new, added.  Pairs are tagged one by
    one after an explode; per snapshot the first reason of each tag stays, 'rephrase' only shows alone, the strongest
    come first; `limit` keeps so many.
    """
    c = F.col
    title = F.coalesce((c("title_old") != "") & (c("title_new") != ""), F.lit(False))
    n = F.coalesce(F.size("changes"), F.lit(0))
    body = (n > 0) | (F.coalesce(F.length("added"), F.lit(0)) > 0)
    items = F.coalesce(c("changes"), F.array().cast("array<struct<old:string,new:string>>"))
    with_title = F.concat(items, F.when(title & body, F.array(F.struct(c("title_old").alias("old"), c("title_new").alias("new")))).otherwise(F.array().cast("array<struct<old:string,new:string>>")))
    rows = snapshots.select(key, F.posexplode(with_title).alias("pos", "x")).select(key, "pos", F.nullif("x.old", F.lit("")).alias("old"), F.nullif("x.new", F.lit("")).alias("new"))
    # a pair has a tag at least; the outer form keeps Spark from asking for the tags a second time to see that
    both = with_pair_tags(rows.filter(c("old").isNotNull() & c("new").isNotNull())).select(key, "pos", F.posexplode_outer("tags").alias("i", "t"))
    one = rows.filter(c("old").isNull() != c("new").isNull()).select(key, "pos", F.lit(0).alias("i"), F.when(c("old").isNull(), F.struct(F.lit("addition").alias("key"), F.lit("Absatz hinzugefügt").alias("reason"))).otherwise(
        F.struct(F.lit("deletion").alias("key"), F.lit("Absatz entfernt").alias("reason"))).cast(TAG).alias("t"))
    show = snapshots.filter(title & ~body).select(key, F.lit(0).alias("pos"), F.lit(0).alias("i"), F.struct(F.lit("showcase").alias("key"), F.lit("nur die Überschrift, Text unverändert").alias("reason")).cast(TAG).alias("t"))
    per = both.unionByName(one).unionByName(show).groupBy(key, F.col("t.key").alias("tag")).agg(F.min(F.struct("pos", "i", "t.reason")).alias("f"))
    tags = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(tag_rank(c("tag")).alias("rank"), c("tag").alias("key"), c("f.reason").alias("reason")))).alias("all"))
    shown = F.when(F.size("all") > 1, F.filter("all", lambda t: t["key"] != "rephrase")).otherwise(c("all"))
    return tags.select(key, F.transform(shown if limit is None else F.slice(shown, 1, limit), lambda t: F.struct(t["key"].alias("key"), t["reason"].alias("reason"))).alias("tags"))


def tag_counts(tags: DataFrame, facts: DataFrame, *by: str, key: str = "id") -> DataFrame:
    """How often each tag occurs per publisher, topic, ...; `facts` brings the columns per snapshot."""
    rows = tags.select(key, F.explode("tags.key").alias("tag")).join(facts.select(key, *by), key)
    return rows.groupBy(*by, "tag").agg(F.count("*").alias("n"))
