"""Change detection: paragraphs, fingerprints, version pairs, change records.

Everything that compares two versions is a Column over a row and its predecessor.  Only the decision that depends on
earlier decisions (oscillation, counters) is a fold; it runs over a thin stream of change events, one short row per
changed capture, sorted inside the partition and never collected.  The events of an article with very many of them are folded in
chunks of time, at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta import constants as K
from pressdelta.functions.text import WS, decode_entities, fingerprint, let, occurrences, split_paragraphs, trim_ws
from pressdelta.functions.timeutil import as_ts, seconds_between
from pressdelta.operators.body import clean_body
from pressdelta.operators.context import real_date_shift
from pressdelta.operators.passages import list_changes
from pressdelta.operators.url_jobs import live_content, url_kind
from pressdelta.plans.patterns import carry_forward, previous_row, written
from pressdelta.sources.tables import Tables


# --- paragraphs and fingerprints -------------------------------------------------------------------------------------
def with_paragraphs(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("paras", split_paragraphs(F.col(body)))


def content_hash(fps: Column) -> Column:
    return fingerprint(F.array_join(fps, "|"))


def with_fingerprints(df: DataFrame, paras: str = "paras", body: str | None = "body") -> DataFrame:
    """Paragraph fingerprints, their hash, and the number of words of the body."""
    df = df.withColumn("para_fps", F.transform(F.col(paras), fingerprint)).withColumn("content_hash", F.when(F.size("para_fps") > 0, content_hash(F.col("para_fps"))))
    return df.withColumn("body_words", F.size(F.split(trim_ws(F.col(body)), f"[{WS}]+")).cast("bigint")) if body else df


def cap_paras(paras: Column) -> Column:
    """The last 400 paragraphs, 8000 characters each."""
    kept = F.slice(paras, F.greatest(F.size(paras) - (K.PARA_KEEP - 1), F.lit(1)), F.lit(K.PARA_KEEP))
    return F.transform(kept, lambda p: F.substring(p, 1, K.PARA_CHARS))


def push_bounded(history: Column, item: Column, keep: int, unique: bool = False) -> Column:
    """Append to a bounded history; with `unique` an item that is in it moves to the end."""
    h = F.coalesce(history, F.array().cast("array<string>")) if unique else history
    grown = F.concat(F.array_remove(h, item) if unique else h, F.array(item))
    return F.slice(grown, F.greatest(F.size(grown) - (keep - 1), F.lit(1)), F.lit(keep))


def flip_signature(a: Column, b: Column) -> Column:
    """Hash of the paragraphs that differ, the same for both directions; '' when none does."""
    sym = F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    return F.when(F.size(sym) > 0, fingerprint(F.array_join(sym, "|"))).otherwise("")


# --- version pairs ----------------------------------------------------------------------------------------------------
def version_pairs(versions: DataFrame, cols: list[str], key: str = "article_id", order: tuple[str, ...] = ("scanned_at",), chunk: Column | None = None) -> DataFrame:
    """Each version with the named columns of the one before (prev_*).  Chunks are days unless told otherwise."""
    return previous_row(versions, key, list(order), cols, F.col(order[0]).cast("date") if chunk is None else chunk)


def para_diff(pairs: DataFrame) -> DataFrame:
    """Added and removed paragraphs.  Repeated additions count, removals count once; a pure re-order changes nothing."""
    def diff(s: Column) -> Column:
        sets = F.struct(F.array_except(s["new"], s["old"]).alias("added"), F.array_except(s["old"], s["new"]).alias("removed"))
        return let(sets, lambda x: F.struct(x["added"].alias("added"), x["removed"].alias("removed"), F.size(occurrences(s["new"], x["added"])).cast("bigint").alias("n")))
    sides = F.struct(F.coalesce("prev_para_fps", F.array().cast("array<string>")).alias("old"), F.col("para_fps").alias("new"))
    d = pairs.withColumn("__d", let(sides, diff))
    return d.withColumns({"added_count": F.col("__d.n"), "removed_count": F.size("__d.removed").cast("bigint"), "added_fps": F.col("__d.added"), "removed_fps": F.col("__d.removed")}).drop("__d")


def title_changed(old: Column, new: Column) -> Column:
    """Both titles given and different after decoding: an entity against its character is no change."""
    return F.coalesce((old != "") & (new != "") & (decode_entities(old) != decode_entities(new)), F.lit(False))


META_EDIT = "array<struct<field:string,old:string,new:string>>"


def meta_edits(prefix: str = "prev_") -> Column:
    """Silent changes of description, preview image, topic, paywall and author status.  Only changes between two
    reliable values count; the author status 'none' is not reliable."""
    old, new = (lambda n: F.col(prefix + n)), F.col

    def edit(field: str, cond: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(field).alias("field"), old(field).cast("string").alias("old"), new(field).cast("string").alias("new")))

    text = lambda n: (old(n) != "") & (new(n) != "") & (old(n) != new(n))
    d_old, d_new = decode_entities(old("description")), decode_entities(new("description"))
    items = [
        edit("description", (d_old != "") & (d_new != "") & (d_old != d_new)), edit("og_image", text("og_image")), edit("topic", text("topic")),
        edit("paywalled", old("paywalled") != new("paywalled")),
        edit("author_status", text("author_status") & (old("author_status") != "none") & (new("author_status") != "none")),
    ]
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(META_EDIT)


def date_differs(a: Column, b: Column) -> Column:
    """Publication times at least a minute apart."""
    return F.coalesce(F.abs(seconds_between(a, b)) >= K.PUBDATE_TOLERANCE_S, F.lit(False))


def with_reported_date(captures: DataFrame, snapshots: DataFrame) -> DataFrame:
    """As-of lookup: the publication date the page reported at the latest snapshot before the capture, as
    `last_reported`.  Captures and snapshots are merged by time; chunks are days."""
    cols = captures.columns
    a = captures.withColumns({"__t": F.col("captured_at"), "__o": F.lit(1), "__v": F.lit(None).cast("timestamp_ntz")})
    b = snapshots.filter(F.col("pubdate_new").isNotNull()).select("article_id", F.col("captured_at").alias("__t"), F.lit(2).alias("__o"), F.col("pubdate_new").alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    run = carry_forward(both, "article_id", ["__t", "__o"], "__v", "last_reported", F.col("__t").cast("date"))
    return run.filter(F.col("__o") == 1).select(*cols, "last_reported")


def pubdate_change(stored: Column, new: Column, last_reported: Column) -> tuple[Column, Column]:
    """(changed, baseline): a date is compared with the one last reported by the page, else with the stored one, so
    that two sources which always disagree do not report a change at every scan."""
    base = F.when(date_differs(stored, new), F.coalesce(last_reported, stored)).otherwise(stored)
    return date_differs(base, new), base


def change_kind(content: Column, title: Column, pub: Column, meta: Column, timeline: Column, added: Column, removed: Column) -> Column:
    """extension or edit; NULL when nothing changed."""
    return (F.when(~(content | title | pub | meta), None).when(~content & ~title, "edit").when(timeline, "extension")
            .when(title, "edit").when(added > removed, "extension").otherwise("edit"))


def is_timeline(live: Column, article_type: Column, extensions: Column) -> Column:
    """Growing articles: live now, live or timeline before, or extended twice."""
    return F.coalesce(live, F.lit(False)) | F.coalesce(article_type.isin("liveblog", "timeline"), F.lit(False)) | (F.coalesce(extensions, F.lit(0)) >= 2)


# --- the decision that depends on earlier ones ---------------------------------------------------------------------------
def new_state() -> dict:
    return {"seen": False, "hash": None, "hashes": [], "flips": [], "last_pub": None, "ext": 0, "edit": 0, "rev": 0, "type": None}


def _push(history: list, item, keep: int = K.HISTORY_KEEP) -> list:
    return ([x for x in history if x != item] + [item])[-keep:]


def advance(state: dict, ev: dict) -> dict | None:
    """Take one capture into the state; returns the change record, or None when there is nothing to record.

    `ev`: hash, sig, added, removed, visible (an edit would show something), title, meta (changed?), pub_prev and
    pub_new (seconds or None), live.
    """
    if not state["seen"]:
        state.update(seen=True, hash=ev["hash"], hashes=[ev["hash"]], type="liveblog" if ev["live"] else state["type"])
        return None
    before, state["hash"] = state["hash"], ev["hash"]
    base, new = ev["pub_prev"], ev["pub_new"]
    apart = lambda a, b: a is not None and b is not None and abs(a - b) >= K.PUBDATE_TOLERANCE_S
    if apart(base, new) and state["last_pub"] is not None:
        base = state["last_pub"]
    pub = apart(base, new)
    other = ev["title"] or ev["meta"] or pub
    content = before != ev["hash"] and (ev["added"] > 0 or ev["removed"] > 0)
    growing = ev["live"] or state["type"] in ("liveblog", "timeline") or state["ext"] >= 2
    if not other and not content:
        return None
    if content and not other and not growing:
        if not ev["visible"]:
            return None
        if ev["hash"] in state["hashes"] or (ev["sig"] and ev["sig"] in state["flips"]):
            state["hashes"] = _push(state["hashes"], ev["hash"])
            if ev["sig"]:
                state["flips"] = _push(state["flips"], ev["sig"])
            return None
    if not content and not ev["title"]:
        kind = "edit"
    elif growing:
        kind = "extension"
    else:
        kind = "edit" if ev["title"] or ev["added"] <= ev["removed"] else "extension"
    state["rev"] += 1
    state["ext" if kind == "extension" else "edit"] += 1
    state["hashes"] = _push(state["hashes"], ev["hash"])
    if ev["sig"] and not other:
        state["flips"] = _push(state["flips"], ev["sig"])
    if pub:
        state["last_pub"] = new
    if ev["live"]:
        state["type"] = "liveblog"
    elif state["ext"] >= 2:
        state["type"] = "timeline"
    return {"kind": kind, "growing": growing, "pub": pub, "pub_old": base if pub else None, "rev": state["rev"], "ext": state["ext"], "edit": state["edit"], "type": state["type"]}


DECISION = ("article_id bigint, captured_at timestamp_ntz, change_kind string, growing boolean, pubdate_changed boolean, pub_old double, "
            "revision_count bigint, extension_count bigint, edit_count bigint, new_type string")
_EVENT_COLUMNS = ("article_id", "captured_at", "content_hash", "sig", "added_count", "removed_count", "visible", "title_edit", "meta_edit", "pub_prev_s", "pub_new_s", "is_live")
# one row per record, and one per chunk with `after`, the state at its end, as JSON
_FOLDED = DECISION + ", chunk bigint, after string"
# events of an article that are decided in one go
FOLD_ROWS = 20_000
# what an article with very many events most likely is in the middle of them: it has grown before
ASSUMED = {"ext": 2, "type": "timeline"}


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


def chunk_start(state: dict) -> dict:
    """What decisions depend on: counters start anew in each chunk, but for how far the article has grown."""
    return {**state, "rev": 0, "edit": 0, "ext": min(state["ext"], 2)}


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by article, chunk and time, each with the state its chunk starts from (`before`, null at the start of an article); the
    state of one chunk is alive at a time.  The counters of the records run from the start of the chunk."""
    current, state, grown = None, new_state(), 0
    names = [c.split()[0] for c in _FOLDED.split(", ")]
    closed = lambda: (current[0], None, None, None, None, None, state["rev"], state["ext"] - grown, state["edit"], state["type"], current[1], json.dumps(chunk_start(state)))
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if (r.article_id, r.chunk) != current:
                if current:
                    out.append(closed())
                current, state = (r.article_id, r.chunk), {**new_state(), **json.loads(r.before)} if isinstance(r.before, str) else new_state()
                grown = state["ext"]
            rec = advance(state, {"hash": r.content_hash, "sig": r.sig, "added": r.added_count, "removed": r.removed_count, "visible": r.visible, "title": r.title_edit,
                                  "meta": r.meta_edit, "pub_prev": _number(r.pub_prev_s), "pub_new": _number(r.pub_new_s), "live": r.is_live})
            if rec:
                out.append((r.article_id, r.captured_at, rec["kind"], rec["growing"], rec["pub"], rec["pub_old"], rec["rev"], rec["ext"] - grown, rec["edit"], rec["type"], r.chunk, None))
        yield pd.DataFrame(out, columns=names)
    if current:
        yield pd.DataFrame([closed()], columns=names)


def _decided(events: DataFrame) -> DataFrame:
    """Records (`after` null) and ends of chunks for events with chunk and before."""
    keys = ["article_id", "chunk"]
    return events.repartition(*keys).sortWithinPartitions(*keys, "captured_at").mapInPandas(_fold, _FOLDED)


def _chunked(events: DataFrame, rows: int) -> DataFrame:
    """Events with `chunk`: stretches of about `rows` events of an article, cut between minutes."""
    minute = F.date_trunc("minute", "captured_at")
    per = events.groupBy("article_id", minute.alias("__minute")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy("article_id").orderBy("__minute").rowsBetween(W.unboundedPreceding, W.currentRow))
    number = per.select("article_id", "__minute", F.floor((upto - 1) / rows).cast("bigint").alias("chunk"))
    return events.withColumn("__minute", minute).join(number, ["article_id", "__minute"]).drop("__minute")


def decide(events: DataFrame, rows: int = FOLD_ROWS) -> DataFrame:
    """The decisions of `advance` over the events of each article in time order (DECISION).

    An article with up to `rows` events is folded in one go.  Those with more are cut into chunks of time, which are decided at once from an
    assumed state.  Then each chunk's true start is the end of the one before; chunks that started otherwise are decided again, until none did.
    Every round settles at least the first unsettled chunk of each article; as states forget what lies far back, it is few rounds.  Counters are
    added up over the chunks at the end.
    """
    large = written(events.groupBy("article_id").agg(F.count("*").alias("n")).filter(F.col("n") > rows).select("article_id"), "large-articles")
    none = F.lit(None).cast("string")
    plain = [c.split()[0] for c in DECISION.split(", ")]
    if large.isEmpty():
        return _decided(events.withColumns({"chunk": F.lit(0).cast("bigint"), "before": none})).filter("after IS NULL").select(*plain)
    small = _decided(events.join(large, "article_id", "left_anti").withColumns({"chunk": F.lit(0).cast("bigint"), "before": none})).filter("after IS NULL").select(*plain)
    hot = written(_chunked(events.join(large, "article_id", "left_semi"), rows), "chunked-events")
    keys = ["article_id", "chunk"]
    assumed = F.to_json(F.struct(F.lit(True).alias("seen"), "hash", *[F.lit(v).alias(k) for k, v in ASSUMED.items()]))
    start = F.when(F.col("hash").isNotNull(), assumed)
    # the last hash of the chunk before is known from the events
    lasts = hot.groupBy(*keys).agg(F.max_by("content_hash", "captured_at").alias("last"))
    starts = written(lasts.withColumn("hash", F.lag("last").over(W.partitionBy("article_id").orderBy("chunk"))).select(*keys, start.alias("before")), "chunk-starts")
    done = written(_decided(hot.join(starts, keys)), "chunk-records")
    while True:
        ends = done.filter("after IS NOT NULL").select(*keys, "after")
        true = ends.select(*keys, F.lag("after").over(W.partitionBy("article_id").orderBy("chunk")).alias("before"))
        canon = lambda c: F.struct(*[F.get_json_object(c, f"$.{k}") for k in new_state()])
        wrong = written(true.join(starts.select(*keys, F.col("before").alias("__was")), keys).filter(~canon("before").eqNullSafe(canon("__was"))).select(*keys, "before"), "chunk-starts")
        if wrong.isEmpty():
            break
        again = _decided(hot.join(wrong, keys))
        done = written(done.join(wrong.select(*keys), keys, "left_anti").unionByName(again), "chunk-records")
        starts = written(starts.join(wrong.select(*keys), keys, "left_anti").unionByName(wrong), "chunk-starts")
    counts = ("revision_count", "extension_count", "edit_count")
    before = W.partitionBy("article_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = done.filter("after IS NOT NULL").select(*keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in counts])
    records = done.filter("after IS NULL").join(offsets, keys).withColumns({c: F.col(c) + F.col(f"__{c}") for c in counts})
    return small.unionByName(records.select(*plain))


META_COLUMNS = ("description", "og_image", "topic", "paywalled", "author_status")


def with_change_facts(captures: DataFrame) -> DataFrame:
    """Captures (article_id, captured_at, title, body, metadata, published_stored, published_track, is_live) with
    everything the decision needs.  Captures without a usable paragraph keep the last text state."""
    have = captures.columns
    for name, typ in (("description", "string"), ("og_image", "string"), ("topic", "string"), ("paywalled", "boolean"), ("author_status", "string"),
                      ("published_stored", "timestamp_ntz"), ("published_track", "timestamp_ntz"), ("is_live", "boolean")):
        if name not in have:
            captures = captures.withColumn(name, F.lit(None).cast(typ))
    day = F.col("captured_at").cast("date")
    base = previous_row(with_fingerprints(with_paragraphs(captures)), "article_id", ["captured_at"], ["title", *META_COLUMNS], day)
    base = previous_row(base.filter(F.size("para_fps") > 0), "article_id", ["captured_at"], ["para_fps", "paras", "content_hash", "body_words"], day)
    d = para_diff(base)
    old_paras, new_paras = F.coalesce("prev_paras", F.array().cast("array<string>")), F.col("paras")
    first = F.col("prev_content_hash").isNull()
    d = d.withColumns({
        "removed_texts": let(F.col("removed_fps"), lambda f: F.filter(old_paras, lambda p: F.array_contains(f, fingerprint(p)))),
        "added_texts": let(F.col("added_fps"), lambda f: F.array_distinct(F.filter(new_paras, lambda p: F.array_contains(f, fingerprint(p))))),
        "title_edit": title_changed(F.col("prev_title"), F.col("title")), "meta_edits": meta_edits(),
        "sig": flip_signature(F.coalesce("prev_para_fps", F.array().cast("array<string>")), F.col("para_fps")),
    })
    content = (F.col("added_count") > 0) | (F.col("removed_count") > 0)
    # paragraphs that are not in the other version always show something
    return d.withColumns({
        "visible": ~first & content, "meta_edit": F.size("meta_edits") > 0,
        "pub_prev_s": F.unix_micros(F.col("published_stored").cast("timestamp")) / 1e6, "pub_new_s": F.unix_micros(F.col("published_track").cast("timestamp")) / 1e6,
        "is_live": F.coalesce("is_live", F.lit(False)), "first_contact": first})


def recleaned(captures: DataFrame) -> DataFrame:
    """Captures (with url) whose stored text is brought to the current cleaning rules, so that furniture an older rule left in is no change."""
    have = captures.columns
    for name in ("title", "description"):
        if name not in have:
            captures = captures.withColumn(name, F.lit(None).cast("string"))
    return clean_body(captures).select(*have)


def track_changes(captures: DataFrame, passages: bool = True, reclean: bool = False, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Change records of a capture history: one row per recorded change, with counters after it.

    What moved is written once; the decisions read its thin columns, the records all of them.  `passages=False` leaves out the pairing of
    old and new passages (`changes` has none then).  `reclean` cleans all captures by the current rules first; they bring `url`."""
    facts = with_change_facts(recleaned(captures) if reclean else captures)
    moved = F.col("first_contact") | F.col("title_edit") | F.col("meta_edit") | (F.col("content_hash") != F.col("prev_content_hash")) | date_differs(F.col("published_stored"), F.col("published_track"))
    wide = ("prev_title", "title", "meta_edits", "added_texts", "removed_texts", "body_words", "prev_body_words", "published_track")
    facts = written(facts.filter(moved).select(*_EVENT_COLUMNS, *wide), "change-facts")
    decided = decide(facts.select(*_EVENT_COLUMNS), fold_rows)
    keys = ["article_id", "captured_at"]
    j = facts.join(decided, keys)
    content = (F.col("added_count") > 0) | (F.col("removed_count") > 0)
    # only recorded edits are paired
    edits = list_changes(j.filter(content & ~F.col("growing")), keys, "removed_texts", "added_texts") if passages else None
    j = j.join(edits.withColumnRenamed("changes", "edit_changes"), keys, "left") if passages else j.withColumn("edit_changes", F.lit(None).cast("array<struct<old:string,new:string>>"))
    grown = F.transform("added_texts", lambda p: F.struct(F.lit(None).cast("string").alias("old"), p.alias("new")))
    none = F.array().cast("array<struct<old:string,new:string>>")
    return j.select(
        "article_id", "captured_at", "change_kind",
        F.when(F.col("title_edit"), decode_entities(F.col("prev_title"))).alias("title_old"), F.when(F.col("title_edit"), decode_entities(F.col("title"))).alias("title_new"),
        F.when(content, F.array_join("added_texts", "\n\n")).otherwise("").alias("added"), "added_count",
        F.when(F.col("growing"), F.lit(0).cast("bigint")).otherwise(F.col("removed_count")).alias("removed_count"),
        (F.col("body_words") - F.coalesce("prev_body_words", "body_words")).alias("word_delta"),
        F.when(~content, none).when(F.col("growing"), grown).otherwise(F.coalesce("edit_changes", none)).alias("changes"),
        F.when(F.col("pubdate_changed"), F.timestamp_micros((F.col("pub_old") * 1e6).cast("bigint")).cast("timestamp_ntz")).alias("pubdate_old"),
        F.when(F.col("pubdate_changed"), F.col("published_track")).alias("pubdate_new"), "meta_edits", "revision_count", "extension_count", "edit_count", "new_type")


def tracked_state(captures: DataFrame, records: DataFrame) -> DataFrame:
    """Article state after a history: last hash and fingerprints, counters, type."""
    base = with_fingerprints(with_paragraphs(captures)).filter(F.size("para_fps") > 0)
    last = base.groupBy("article_id").agg(F.max_by(F.struct("content_hash", "para_fps", "body_words", "title"), "captured_at").alias("s"), F.count("*").alias("scan_count"))
    c = records.groupBy("article_id").agg(F.max("revision_count").alias("revision_count"), F.max("extension_count").alias("extension_count"), F.max("edit_count").alias("edit_count"),
                                          F.max_by("new_type", "captured_at").alias("article_type"))
    z = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return last.join(c, "article_id", "left").select("article_id", "s.*", "scan_count", z("revision_count"), z("extension_count"), z("edit_count"), "article_type")


def rebaseline(paras: DataFrame, cleaned: Column) -> DataFrame:
    """Stored paragraphs (article_id, paras) brought to the current cleaning rules before they are compared.
    `cleaned` is the cleaned text of the joined paragraphs."""
    return with_fingerprints(paras.withColumn("paras", split_paragraphs(cleaned)), body=None)


def joined_paras(paras: Column) -> Column:
    return F.array_join(paras, "\n\n")


# --- folds that are aggregates ---------------------------------------------------------------------------------------------
def sticky_paywall(captures: DataFrame) -> DataFrame:
    """Running paywall state: true and false set it, unknown keeps it - the latest known value."""
    return carry_forward(captures, "article_id", ["captured_at"], "paywalled", "paywalled_state", F.col("captured_at").cast("date"))


def freeze_dates(captures: DataFrame) -> DataFrame:
    """Publication time per article: the first one reported, never after the first capture; later forward values and
    page modification times go to modified_at, which never goes back.  Captures: article_id, captured_at, reported_pub,
    precise, reported_mod, first_seen.  Two aggregations, so late or shuffled captures give the same result."""
    pub = captures.filter(F.col("reported_pub").isNotNull()).groupBy("article_id").agg(F.min_by(F.struct("reported_pub", "captured_at", "first_seen"), F.struct("captured_at", "reported_pub")).alias("p"))
    pub = pub.select("article_id", F.least("p.reported_pub", F.coalesce("p.first_seen", "p.captured_at")).alias("published_at"), F.col("p.captured_at").alias("fixed_at"))
    j = captures.join(pub, "article_id", "left")
    bump = F.when(F.col("precise") & (F.col("captured_at") > F.col("fixed_at")) & (seconds_between(F.col("published_at"), F.col("reported_pub")) > K.PUBDATE_TOLERANCE_S), F.col("reported_pub"))
    return j.groupBy("article_id").agg(F.max("published_at").alias("published_at"), F.max(F.greatest("reported_mod", bump)).alias("modified_at"))


def with_date_track(captures: DataFrame) -> DataFrame:
    """Date to follow at each capture: a forward value of the page as it is, else the frozen one."""
    frozen = freeze_dates(captures).select("article_id", F.col("published_at").alias("published_stored"))
    j = captures.join(frozen, "article_id", "left")
    bump = F.col("precise") & (seconds_between(F.col("published_stored"), F.col("reported_pub")) > K.PUBDATE_TOLERANCE_S)
    return j.withColumn("published_track", F.when(bump, F.col("reported_pub")).otherwise(F.col("published_stored")))


def date_bounds(dates: DataFrame) -> DataFrame:
    """Sitemap dates (url, at, precise) per URL: earliest and latest precise date, earliest imprecise one.  Minima and
    maxima do not depend on the order of arrival, so the same aggregation serves a stream with late rows."""
    at = lambda cond: F.when(cond, F.col("at"))
    return dates.groupBy("url").agg(F.min(at(F.col("precise"))).alias("lo"), F.max(at(F.col("precise"))).alias("hi"), F.min(at(~F.col("precise"))).alias("guess"))


def apply_date_bounds(articles: DataFrame, bounds: DataFrame) -> DataFrame:
    """A precise date refines to the earlier one and a later one counts as modification; an imprecise one fills a gap."""
    j = articles.join(bounds, "url", "left")
    old = F.col("published_at")
    return j.withColumns({
        "modified_at": F.when(old.isNotNull() & (F.col("hi") > old), F.greatest("modified_at", "hi")).otherwise(F.col("modified_at")),
        "published_at": F.coalesce(F.least(old, "lo"), "guess")}).select(*articles.columns)


def apply_sitemap_dates(articles: DataFrame, dates: DataFrame) -> DataFrame:
    """Sitemap dates on existing articles."""
    return apply_date_bounds(articles, date_bounds(dates))


def sitemap_stubs(articles: DataFrame, dates: DataFrame) -> DataFrame:
    """URLs with a sitemap date that have no article yet: (source_id, url, published_at)."""
    best = dates.groupBy("source_id", "url").agg(F.coalesce(F.min(F.when(F.col("precise"), F.col("at"))), F.min("at")).alias("published_at"))
    return best.join(articles.select("url"), "url", "left_anti")


# --- gates ---------------------------------------------------------------------------------------------------------------
def never_changed() -> Column:
    return (F.coalesce("revision_count", F.lit(0)) == 0) & (F.coalesce("extension_count", F.lit(0)) == 0) & (F.coalesce("edit_count", F.lit(0)) == 0)


def move_out(t: Tables, gone: DataFrame, kind: str) -> Tables:
    """Pages of the URLs get the kind, their articles are removed."""
    urls = gone.select("url").distinct()
    pages = t.pages.join(urls.withColumn("__gone", F.lit(True)), "url", "left").withColumn("kind", F.when(F.col("__gone"), kind).otherwise(F.col("kind"))).select(*t.pages.columns)
    return t.with_(pages=pages, articles=t.articles.join(urls, "url", "left_anti").select(*t.articles.columns))


def archive_gate(t: Tables, now, days: int = K.ARTICLE_MAX_AGE_DAYS, reported: DataFrame | None = None) -> Tables:
    """Articles that never changed, are not live, and whose freshest reliable date is older than the window leave the
    corpus.  `reported` (url, page_date) adds precise dates of the pages."""
    a = t.articles if reported is None else t.articles.join(reported.groupBy("url").agg(F.max("page_date").alias("page_date")), "url", "left")
    fresh = F.greatest("published_at", "page_date") if reported is not None else F.col("published_at")
    old = seconds_between(fresh, as_ts(now)) > days * 86400
    return move_out(t, a.filter(never_changed() & old & ~live_content(F.col("url"), F.col("title"))).select("url"), "archive")


def sponsored_gate(t: Tables) -> Tables:
    """Articles whose URL or rubric URL is an advertorial."""
    hit = reduce(or_, [F.coalesce(url_kind(F.col(c)) == "sponsored", F.lit(False)) for c in ("url", "rubric")])
    return move_out(t, t.articles.filter(hit).select("url"), "sponsored")


def demote_non_articles(t: Tables, classified: DataFrame) -> Tables:
    """Pages with a new kind (url, new_kind) that is not 'article' lose their article."""
    c = classified.filter(F.col("new_kind") != "article").groupBy("url").agg(F.min("new_kind").alias("new_kind"))
    pages = t.pages.join(c, "url", "left").withColumn("kind", F.coalesce("new_kind", "kind")).select(*t.pages.columns)
    return t.with_(pages=pages, articles=t.articles.join(c, "url", "left_anti").select(*t.articles.columns))


# --- headline edits ---------------------------------------------------------------------------------------------------------
def headline_edits(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """Consecutive versions with another title: (article_id, before_title, after_title, scanned_at, delay_minutes)."""
    pairs = version_pairs(versions, ["title"])
    start = versions.groupBy("article_id").agg(F.min("scanned_at").alias("first_report"))
    e = pairs.filter(title_changed(F.col("prev_title"), F.col("title"))).join(start, "article_id")
    e = e.select("article_id", F.col("prev_title").alias("before_title"), F.col("title").alias("after_title"), "scanned_at",
                 F.floor(seconds_between(F.col("first_report"), F.col("scanned_at")) / 60).cast("bigint").alias("delay_minutes"))
    return e.orderBy(F.desc("scanned_at"), "article_id").limit(limit) if limit else e


def payload_trimmed(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose text was dropped by retention: they had content, and nothing to show is left."""
    c = lambda n: F.coalesce(n, F.lit(0))
    nothing = (F.col("title_old").isNull() | F.col("title_new").isNull()) & ~real_date_shift(F.col("pubdate_old"), F.col("pubdate_new")) & (F.coalesce(F.size("meta_edits"), F.lit(0)) <= 0)
    empty = (F.coalesce(F.size("changes"), F.lit(0)) <= 0) & (F.coalesce(F.length("added"), F.lit(0)) == 0)
    ext = F.col("change_kind") == "extension"
    had = ext | (c("word_delta") != 0) | (c("added_count") > 0) | (c("removed_count") > 0)
    return snapshots.withColumn("payload_trimmed", F.coalesce(nothing & empty & (ext | (c("removed_count") == 0)) & had, F.lit(False)))
