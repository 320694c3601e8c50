"""Edit tags and readable differences."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pressdelta.operators import diffs as df, editclass as ec

LONG = "Der Ausschuss hat am Abend lange über den neuen Entwurf beraten und will bald entscheiden"


@pytest.mark.parametrize("old,new,tags", [
    (LONG + " mit 12 Stimmen", LONG + " mit 14 Stimmen", {"factual": "Zahl geändert: 12 → 14"}), (LONG + " mit 12 Stimmen", LONG + " mit Stimmen", {"factual": "Zahl entfernt: 12"}),
    ("Ganz kurz 12", "Völlig anders geschrieben 14 hier", {"rephrase": None}), (LONG + " Komitee", LONG + " Komittee", {"typo": "Schreibweise: „komitee\" → „komittee\""}),
    (LONG + " der", LONG + " die", {"rephrase": None}), (LONG, LONG + " laut Bericht", {"attribution": "Absicherung eingefügt: „laut\""}), (LONG + " angeblich", LONG, {"attribution": "Absicherung entfernt: „angeblich\""}),
    (LONG, "Nach Angaben der Polizei " + LONG, {"attribution": "Absicherung eingefügt: „nach Angaben\""}), ("Peter Muster wurde festgenommen in Berlin", "Der Mann wurde festgenommen in Berlin", {"anonymization": "Name entfernt: „Peter Muster\""}),
    (LONG, LONG + " Skandal", {"sharpened": "Wertung eingefügt: „skandal\""}), (LONG + " Chaos", LONG, {"toned": "Wertung entfernt: „chaos\""}),
    (LONG + " 12 Tote", LONG + " 14 Tote Chaos", {"factual": "Zahl geändert: 12 → 14"}), ("gleich", "gleich", {"rephrase": None}),
])
def test_pair_tags(spark, old, new, tags):
    got = {t.key: t.reason for t in ec.with_pair_tags(spark.createDataFrame([(old, new)], "old string, new string")).first().tags}
    assert set(got) == set(tags) and all(got[k] == v for k, v in tags.items() if v)


def snaps(spark, *rows):
    return spark.createDataFrame([(i, [{"old": o, "new": n} for o, n in r.get("c", [])], r.get("t", (None, None))[0], r.get("t", (None, None))[1], r.get("added", "")) for i, r in enumerate(rows)],
                                 "id bigint, changes array<struct<old:string,new:string>>, title_old string, title_new string, added string")


def test_snapshot_tags(spark):
    rows = snaps(spark, {"t": ("A alt", "A neu")}, {"c": [(None, "x")]}, {"c": [("x", None), (LONG + " 12", LONG + " 14"), (LONG, LONG + " so")]}, {"c": [(LONG, LONG + " so")]},
                 {"c": [(LONG + " 12", LONG + " 14"), ("Peter Muster ging", "Der Mann ging"), (LONG, LONG + " laut"), (None, "y")]}, {"t": ("A 12 b c d e", "A 14 b c d e"), "added": "z"})
    got = {r.id: [t.key for t in r.tags] for r in ec.classify_snapshots(rows, 3).collect()}
    assert got == {0: ["showcase"], 1: ["addition"], 2: ["factual", "deletion"], 3: ["rephrase"], 4: ["factual", "anonymization", "attribution"], 5: ["factual"]}


@pytest.mark.parametrize("before,after,kind", [("Skandal im Amt", "Vorfall im Amt", "toned_down"), ("Vorfall", "Massiver Vorfall: massiv", "sharpened"), ("12 Tote", "14 Tote", "factual"), ("Tote", "14 Tote", "other"), ("EMPÖRUNG", "Ruhe", "toned_down")])
def test_headline_kind(spark, before, after, kind):
    d = spark.createDataFrame([(before, after)], "b string, a string")
    assert d.select(ec.headline_kind(F.col("b"), F.col("a"))).first()[0] == kind


words = st.lists(st.sampled_from(["der", "die", "Haus", "Haus,", "geht", "12", "neu."]), max_size=12).map(" ".join)


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_word_ops_give_both_sides_back(a, b):
    ops = df.word_ops(a, b)
    assert "".join(t for op, t in ops if op in ("eq", "del")) == a
    assert "".join(t for op, t in ops if op in ("eq", "ins")) == b


def test_hunks_begin_at_the_words_before_a_change(spark):
    rows = spark.createDataFrame([(1, 0, "a b c d e", "a x c d y"), (2, 0, "gleich", "gleich"), (3, 0, None, "neu")], "id bigint, item int, old string, new string")
    got = [(r.id, r.hunk, r.op, r.text) for r in df.diff_ops(rows).orderBy("id", "seq").collect()]
    assert got == [(1, 0, "eq", "a "), (1, 0, "del", "b "), (1, 0, "ins", "x "), (1, 1, "eq", "c d "), (1, 1, "del", "e"), (1, 1, "ins", "y"), (2, 0, "eq", "gleich")]


CASES = [
    ([("a b", "a b")], []), ([(None, "eins zwei drei vier"), ("eins zwei drei fünf", None)], [("eins zwei drei fünf", "eins zwei drei vier")]),
    ([(None, "x y"), ("ganz anders", None)], [(None, "x y"), ("ganz anders", None)]),
    ([(None, "k" * 85 + " " + "eins zwei drei"), ("k" * 85 + " " + "vier fünf sechs sieben acht", None)], [("k" * 85 + " vier fünf sechs sieben acht", "k" * 85 + " eins zwei drei")]),
    ([(None, "gleicher  Text"), ("gleicher Text", None)], []), ([], []), (None, None),
    ([("a b c d", None), ("a b c x", None), (None, "a b c d e"), ("alt", "neu")], [("alt", "neu"), ("a b c d", "a b c d e"), ("a b c x", None)]),
]


def test_reconcile(spark):
    rows = spark.createDataFrame([(i, None if c is None else [{"old": o, "new": n} for o, n in c]) for i, (c, _) in enumerate(CASES)], "id bigint, changes array<struct<old:string,new:string>>")
    got = {r.id: None if r.changes is None else [(c.old, c.new) for c in r.changes] for r in df.reconcile_changes(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_cards_and_sections(spark):
    rows = [(1, 1, 1, [(None, "A" * 10), (None, "B" * 30), ("C" * 20, None), ("D", "E")]), (2, 1, 2, [(None, "a" * 10), (None, "F")])]
    s = spark.createDataFrame([(i, a, t, [{"old": o, "new": n} for o, n in c], "", None, None) for i, a, t, c in rows],
                              "id bigint, article_id bigint, captured_at int, changes array<struct<old:string,new:string>>, added string, pubdate_old timestamp_ntz, pubdate_new timestamp_ntz")
    c = df.change_cards(s, shown=3).filter("id = 1").first()
    assert [x.new or x.old for x in c.shown] == ["B" * 30, "C" * 20, "A" * 10] and (c.more, c.added_paras, c.removed_paras) == (1, 2, 1)
    got = {r.id: (r.sections, r.more) for r in df.added_sections(df.shown_paragraphs(s)).collect()}
    assert got == {1: (["A" * 10, "B" * 30], 0), 2: (["F"], 0)}
