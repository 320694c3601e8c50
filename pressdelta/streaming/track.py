"""Change tracking as a stream: the fold of the batch job, with its state kept per article and captures put in order first."""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pressdelta.functions.text import decode_entities, letter_tokens
from pressdelta.operators.changes import META_COLUMNS, advance, new_state, with_fingerprints, with_paragraphs
from pressdelta.operators.passages import changes_of

OUTPUT = ("article_id bigint, captured_at timestamp, change_kind string, title_old string, title_new string, added string, added_count bigint, removed_count bigint, "
          "word_delta bigint, changes array<struct<old:string,new:string>>, pubdate_old timestamp, pubdate_new timestamp, meta_edits array<struct<field:string,old:string,new:string>>, "
          "revision_count bigint, extension_count bigint, edit_count bigint, new_type string")
# how late a capture may come, and how long an article may be silent before it is forgotten
LATENESS = "2 days"
KEEP_MS = 90 * 24 * 3600 * 1000


def _sha12(text: str) -> str:
    import hashlib
    return hashlib.sha1(text.lower().encode()).hexdigest()[:12]


def _meta(old: dict, new: dict) -> list[dict]:
    """Changes between two reliable metadata values."""
    out = []
    for f in META_COLUMNS:
        a, b = old.get(f), new.get(f)
        if a in (None, "") or b in (None, "") or a == b or (f == "author_status" and "none" in (a, b)):
            continue
        text = (lambda v: str(v).lower()) if f == "paywalled" else str
        out.append({"field": f, "old": text(a), "new": text(b)})
    return out


def step(mem: dict, row: dict, paras: MutableMapping[str, dict]) -> dict | None:
    """One capture into the memory of an article; returns the change record or None.

    `mem` is small (title, metadata, words, the state of decisions); `paras` holds the paragraphs of the last text by fingerprint, with
    their places.  Only those that come and go are touched.
    """
    last = mem.setdefault("last", {})
    title, meta = row["title"], {f: row[f] for f in META_COLUMNS}
    title_edit = bool(last.get("title")) and bool(title) and last["title"] != title
    edits = _meta(last.get("meta", {}), meta) if last else []
    before = last.get("title")
    last.update(title=title, meta=meta)
    if not row["fps"]:
        return None
    places: dict[str, list[int]] = {}
    for i, f in enumerate(row["fps"]):
        places.setdefault(f, []).append(i)
    olds = set(paras)
    added = [f for f in row["fps"] if f not in olds]
    removed = olds - places.keys()
    text_of = dict(zip(row["fps"], zip(row["paras"], row["tokens"])))
    fresh = [text_of[f] for f in dict.fromkeys(added)]
    lost = {f: paras[f] for f in removed}
    gone = [(p["text"], p["tokens"]) for _, p in sorted((i, p) for p in lost.values() for i in p["places"])] if len(removed) > 0 else []
    state = mem.setdefault("state", new_state())
    first = not state["seen"]
    items = [] if first or not (added or removed) else changes_of(gone, fresh)
    diff = sorted(removed.union(added))
    rec = advance(state, {"hash": row["hash"], "sig": _sha12("|".join(diff)) if diff else "", "added": len(added), "removed": len(removed), "visible": bool(items), "title": title_edit,
                          "meta": bool(edits), "pub_prev": row["pub_prev"], "pub_new": row["pub_new"], "live": row["live"]})
    words = mem.get("words", row["words"])
    mem["words"] = row["words"]
    for f in removed:
        del paras[f]
    for f, where in places.items():
        # a paragraph that only moved keeps its text
        if f not in olds or paras[f]["places"] != where:
            paras[f] = {"text": text_of[f][0], "tokens": text_of[f][1], "places": where}
    if rec is None:
        return None
    if rec["growing"]:
        items = [(None, p) for p, _ in fresh]
    when = lambda s: None if s is None else pd.Timestamp(round(s * 1e6), unit="us")
    return {"change_kind": rec["kind"], "title_old": before if title_edit else None, "title_new": title if title_edit else None, "added": "\n\n".join(p for p, _ in fresh), "added_count": len(added),
            "removed_count": 0 if rec["growing"] else len(removed), "word_delta": row["words"] - words, "changes": [{"old": o, "new": n} for o, n in items],
            "pubdate_old": when(rec["pub_old"]), "pubdate_new": when(row["pub_new"]) if rec["pub"] else None, "meta_edits": edits,
            "revision_count": rec["rev"], "extension_count": rec["ext"], "edit_count": rec["edit"], "new_type": rec["type"]}


def _none(v):
    return None if v is None or (isinstance(v, float) and v != v) else v


class Paragraphs(MutableMapping):
    """The paragraphs of an article as a map state, one entry per fingerprint."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, f: str) -> dict:
        text, tokens, places = self.state.getValue((f,))
        return {"text": text, "tokens": json.loads(tokens), "places": json.loads(places)}

    def __setitem__(self, f: str, p: dict) -> None:
        self.state.updateValue((f,), (p["text"], json.dumps(p["tokens"]), json.dumps(p["places"])))

    def __delitem__(self, f: str) -> None:
        self.state.removeKey((f,))

    def __iter__(self) -> Iterator[str]:
        return iter([k[0] for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self)


class ChangeTracker(StatefulProcessor):
    """Captures wait in a list until the watermark has passed them, then they are taken in time order, whatever order they came in.

    Memory per article: waiting captures, paragraphs by fingerprint, and a small record of the rest.  A timer per capture releases it; one
    after `keep_ms` of silence forgets the article.
    """

    def __init__(self, keep_ms: int | None = KEEP_MS) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, capture string")
        self.paras = handle.getMapState("paras", "fp string", "text string, tokens string, places string")
        self.mem = handle.getValueState("mem", "data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.to_dict("records"):
                row = {"title": _none(r["title"]), **{f: _none(r[f]) for f in META_COLUMNS}, "fps": list(r["para_fps"]), "paras": list(r["paras"]), "tokens": [list(t) for t in r["tokens"]],
                       "hash": r["content_hash"], "words": int(r["body_words"]), "pub_prev": _none(r["pub_prev_s"]), "pub_new": _none(r["pub_new_s"]), "live": bool(_none(r["is_live"]))}
                if row["paywalled"] is not None:
                    row["paywalled"] = bool(row["paywalled"])
                at = int(r["at_us"])
                self.waiting.appendValue((at, json.dumps(row)))
                self.handle.registerTimer(at // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [w for w in waiting if w[0] < passed], [w for w in waiting if w[0] >= passed]
        mem = json.loads(self.mem.get()[0]) if self.mem.exists() else {}
        if not due:
            if mem.get("until", passed) < passed:
                self.paras.clear()
                self.mem.clear()
            return
        out, paras = [], Paragraphs(self.paras)
        for at, capture in due:
            if mem.get("until", at) < at:
                self.paras.clear()
                mem = {}
            if self.keep_ms:
                mem["until"] = at + self.keep_ms * 1000
            rec = step(mem, json.loads(capture), paras)
            if rec:
                out.append({"article_id": int(key[0]), "captured_at": pd.Timestamp(at, unit="us"), **rec})
        if self.keep_ms:
            self.handle.registerTimer(mem["until"] // 1000 + 1)
        self.mem.update((json.dumps(mem),))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def prepare(captures: DataFrame) -> DataFrame:
    """Paragraphs, fingerprints and tokens in Spark; the processor only compares lists."""
    have = captures.columns
    for name, typ in (("description", "string"), ("og_image", "string"), ("topic", "string"), ("paywalled", "boolean"), ("author_status", "string"),
                      ("published_stored", "timestamp_ntz"), ("published_track", "timestamp_ntz"), ("is_live", "boolean")):
        if name not in have:
            captures = captures.withColumn(name, F.lit(None).cast(typ))
    d = with_fingerprints(with_paragraphs(captures))
    secs = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6).alias
    return d.select(
        "article_id", F.col("captured_at").cast("timestamp").alias("captured_at"), F.unix_micros(F.col("captured_at").cast("timestamp")).alias("at_us"), decode_entities(F.col("title")).alias("title"), decode_entities(F.col("description")).alias("description"),
        *[F.col(c) for c in META_COLUMNS if c != "description"], "paras", "para_fps", "content_hash", F.coalesce("body_words", F.lit(0)).alias("body_words"), F.transform("paras", lambda p: letter_tokens(p)).alias("tokens"),
        secs("published_stored")("pub_prev_s"), secs("published_track")("pub_new_s"), F.coalesce("is_live", F.lit(False)).alias("is_live"))


def track_changes_stream(captures: DataFrame, lateness: str = LATENESS, keep_ms: int | None = KEEP_MS) -> DataFrame:
    """Stream of change records, the same as the batch job's for any order of arrival.  Needs the RocksDB state store.

    A capture is taken when the watermark (`lateness` behind the newest capture) has passed it; later ones are dropped.  An article
    without captures for `keep_ms` is forgotten, so state is bounded by what is active; None keeps all."""
    d = prepare(captures).withWatermark("captured_at", lateness)
    return d.groupBy("article_id").transformWithStateInPandas(ChangeTracker(keep_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
