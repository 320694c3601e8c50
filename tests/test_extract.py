"""Facts from page HTML, page kinds, signals, body text."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from pressdelta.operators import body as bd, extract as ex


def page(ld=None, head="", body="", lang="de"):
    scripts = "".join(f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>' for x in (ld or []))
    return f'<html lang="{lang}-DE"><head>{head}{scripts}</head><body>{body}</body></html>'


def facts(spark, html, url="https://x.de/politik/ausland/a-12345.html"):
    return ex.extract_metadata(spark.createDataFrame([(url, html)], "url string, html string")).first()


def test_title_order_and_entities(spark):
    assert facts(spark, page(head='<meta content="A &amp; B&nbsp;&nbsp;C" property="og:title"><title>T</title>')).title == "A & B C"
    assert facts(spark, page([{"@type": "NewsArticle", "headline": "H"}], "<title>T</title>")).title == "H"
    assert facts(spark, page(head="<title> T &quot;x&quot; </title>")).title == 'T "x"'
    assert facts(spark, page()).title is None


@pytest.mark.parametrize("ld,head,body,url,want,precise", [
    ([{"@type": "NewsArticle", "datePublished": "2026-01-02T00:00:00Z"}], '<meta property="article:published_time" content="2026-01-01T10:00:00+01:00">', "", None, "2026-01-01 09:00:00", True),
    ([{"@type": "NewsArticle", "datePublished": "2026-01-02T00:00:00Z"}], '<meta property="article:published_time" content="gestern">', "", None, "2026-01-02 00:00:00", True),
    ([{"@graph": [{"@type": "WebPage", "datePublished": "2026-01-03T00:00:00Z"}]}], "", "", None, "2026-01-03 00:00:00", True),
    (["{broken \"datePublished\": \"2026-01-04T00:00:00Z\""], "", "", None, "2026-01-04 00:00:00", True),
    ([], "", '<time class="x" itemprop="datePublished" datetime="2026-01-05T00:00:00Z">', None, "2026-01-05 00:00:00", True),
    ([], "", "", "https://lemonde.fr/politique/article/2026/01/06/titre_1.html", "2026-01-06 12:00:00", False),
    ([], "", "", None, None, False),
])
def test_published(spark, ld, head, body, url, want, precise):
    r = facts(spark, page(ld, head, body), url or "https://x.de/politik/a-12345.html")
    assert (str(r.published_at) if r.published_at else None, r.published_precise) == (want, precise)


@pytest.mark.parametrize("ld,body,url,want", [
    ([{"@type": "Article", "isAccessibleForFree": False}], "", None, True), ([{"@type": "Article", "isAccessibleForFree": "True"}], '<div class="paywall">', None, False),
    ([{"isAccessibleForFree": False}, {"isAccessibleForFree": True}], "", None, False), ([], '<div class="piano-x">', None, True), ([], "", None, None),
    ([], '<div class="piano-x">', "https://www.tagesschau.de/inland/a-12345.html", False),
])
def test_paywall_three_states(spark, ld, body, url, want):
    assert facts(spark, page(ld, "", body), url or "https://x.de/politik/a-12345.html").paywalled is want


def test_types(spark):
    kind = lambda t, url="https://x.de/politik/a-12345.html", title="": facts(spark, page([{"@type": t}], f"<title>{title}</title>"), url).article_type
    assert kind("OpinionNewsArticle") == "opinion"
    assert kind("NewsArticle", "https://x.de/politik/liveblog-a-12345.html") == "liveblog"
    assert kind("NewsArticle", title="Lage: ++ Meldung ++") == "liveblog"
    assert kind("NewsArticle", "https://www.bild.de/newsticker/alle-politik-news-12345.html") == "news"


def test_authors(spark):
    f = lambda author, head="": facts(spark, page([{"@type": "NewsArticle", "author": author}], head))
    assert (f([{"name": "Erika Muster"}, "dpa"]).authors, f([{"name": "Erika Muster"}, "dpa"]).author_status) == (["Erika Muster", "dpa"], "named")
    assert f({"@type": "Organization", "name": "Redaktion"}).author_status == "anonymous"
    assert f("von Hans Meier").author_status == "named"
    assert f("Muster-Verlag.de").author_status == "anonymous"
    assert f([]).author_status == "none"
    assert f([], '<meta name="author" content="Jean Dupont">').authors == ["Jean Dupont"]
    assert f({"@type": "Person"}).author_status == "none"


def test_keywords(spark):
    head = '<meta name="news_keywords" content="Eins;Zwei_drei"><meta name="swr_keywords" content="vier|x"><meta property="article:tag" content="Fünf">'
    r = facts(spark, page([{"@type": "NewsArticle", "keywords": ["Alpha", "eins"]}], head, '<a class="t" rel="tag" href="/x"><b>Sechs</b></a>'))
    assert r.keywords == ["alpha", "eins", "zwei drei", "vier", "fünf", "sechs"]


def test_categories(spark):
    crumbs = {"@type": "BreadcrumbList", "itemListElement": [{"position": 4, "name": "Titel"}, {"position": 2, "item": {"name": "Feuilleton"}}, {"position": 1, "name": "Start"}, {"position": 3, "name": "dpa"}]}
    assert facts(spark, page([{"@type": "NewsArticle", "articleSection": "Politik, Ausland"}, crumbs])).categories == ["Politik", "Ausland", "Feuilleton"]


def test_words_and_language(spark):
    r = facts(spark, "<html lang='fr'><body><p>un deux</p><p>trois</p></body></html>")
    assert (r.word_count, r.reading_min, r.lang_detected) == (3, 1, "fr")


@pytest.mark.parametrize("status,title,want", [(404, "Alles gut", True), (200, "Seite nicht gefunden", True), (200, "Die Suche nach dem Fehler: nicht gefunden", False), (200, "404 - Not Found", True), (None, "Bericht", False)])
def test_error_pages(spark, status, title, want):
    df = spark.createDataFrame([(status, f"<title>{title}</title>")], "s int, html string")
    assert df.select(ex.is_error_page(F.col("s"), F.col("html"))).first()[0] is want


@pytest.mark.parametrize("url,html,body,want", [
    ("https://x.de/politik/a-12345.html", page([{"@type": "NewsArticle"}]), None, "article"), ("https://x.de/politik/a-12345.html", page(), "Text", "article"), ("https://x.de/politik/a-12345.html", page(), None, "section"),
    ("https://x.de/politik/a-12345.html", page(body="x" * 26000), "Text", "section"), ("https://x.de/2026/01/02/a.html", page(body="x" * 26000), None, "article"), ("https://x.de/politik/", page([{"@type": "NewsArticle"}]), None, "section"),
    ("https://x.de/politik/a-12345.html", page([{"@type": "VideoObject"}]), None, "media"), ("https://x.de/politik/a-12345.html", page([{"@type": "NewsArticle"}, {"@type": "VideoObject"}]), None, "article"),
    ("https://x.de/podcast/a-12345.html", page([{"@type": "NewsArticle"}]), None, "media"), ("https://x.de/politik/a-12345.html", page(head="<title>Zugriff verweigert</title>"), None, "error"),
])
def test_page_kind(spark, url, html, body, want):
    df = spark.createDataFrame([(url, html, body)], "url string, html string, body string")
    assert ex.page_kind(df).first().kind == want


def test_signals_can_be_extended(spark):
    df = spark.createDataFrame([("https://x.de/a", '<div class="Disqus">Liveblog</div>', 3)], "url string, html string, ad_requests bigint")
    s = ex.page_signals(df, {**ex.SIGNALS, "has_div": lambda html, ld, ads: html.contains("<div")}).first().signals
    assert (s.has_comments, s.ad_signal, s.paywalled, s.is_liveblog, s.has_div, s.body_chars) == (True, 3, False, True, True, 8)


def test_marker_counts(spark):
    rows = [(f"https://www.faz.net/a/{i}", "Jetzt kostenlos F+x" if i % 2 else "F+ ") for i in range(100)] + [("https://x.de/a", "F+x")]
    got = {(r.host, r.marker): (r.captures, r.n) for r in ex.paywall_marker_counts(spark.createDataFrame(rows, "url string, html string"), 1000).collect()}
    assert got[("www.faz.net", "f-plus")] == (100, 50) and all(h == "www.faz.net" for h, _ in got)


PARA = "Ein Absatz mit genug Zeichen, damit er als echter Text zählt, Nummer {}."


def test_main_text(spark):
    paras = "".join(f"<p>{PARA.format(i)}</p>" for i in range(30))
    pages = [f"<html><nav><li>{'x' * 2000}</li></nav><article><h2>kurz</h2>{paras}<script>{'y' * 99}</script></article></html>",
             f"<article>{paras}<div data-external-selector='recommendations'><p>{'z' * 99}</p></div></article>",
             "<article>" + "".join(f"<a href='/{i}'>Kurzer Link {i}</a>" for i in range(200)) + "</article>", "<article><p>wenig</p></article>", None,
             f"<article><p>{'v' * 2000}</p><div data-area='body'>{paras}</div></article>"]
    got = [r.body for r in bd.extract_body(spark.createDataFrame(list(enumerate(pages)), "i int, html string")).orderBy("i").collect()]
    assert got[0].split("\n\n")[0] == PARA.format(0) and len(got[0].split("\n\n")) == 30 and "z" * 99 not in got[1]
    assert got[2:5] == [None, None, None] and got[5].startswith(PARA.format(0))


@pytest.mark.parametrize("url,body,want", [
    ("https://x.de/a", 'Vor {"@context":"s","a":{"b":1}} nach', "Vor nach"), ("https://x.de/a", 'Vor {"@context":"s" offen', 'Vor {"@context":"s" offen'),
    ("https://x.de/a", "Vor An dieser Stelle findest du Inhalte aus X Weitere Infos finden Sie hier. nach", "Vor nach"),
    ("https://www.bild.de/a", "Titel Foto: Max 01.02.2026 - 10:11 Uhr Der Text.", "Der Text."), ("https://www.bild.de/a", "Vorspann Artikel weiterlesen Der Text.", "Der Text."),
    ("https://www.bild.de/a", "+++Handy 10,29 EUR Tisch 249,95 EUR Ende", "+++ Ende"),
    ("https://www.n-tv.de/a", "SachsenEigener Text lang " + "x" * 500 + " BayernErste ZeileHessenZweite Zeile", "SachsenEigener Text lang " + "x" * 500),
    ("https://www.n-tv.de/a", "Text. Empfehlungen1:23Film Mehr Inhalte anzeigen", "Text."),
    ("https://www.faz.net/aktuell/feuilleton/debatten/slug-1.html", "FeuilletonDebattenTitel 18.06.2026, 12:58 Lesezeit: 6 Min. Text FAZ+ weiter.", "Titel Text weiter."),
    ("https://www.faz.net/x/y-1.html", "Am Anfang. Lesermeinungen1 kurz. " + "Text. " * 30 + "Das Beste von FAZ+ und mehr", "Am Anfang. Lesermeinungen1 kurz. " + "Text. " * 30 + "Das Beste von und mehr"),
    ("https://www.faz.net/x/y-1.html", "Text. " * 30 + "Lesermeinungen1 weg", ("Text. " * 30).strip()),
    ("https://www.spiegel.de/a", "Echter Text ohne Marken.\nEin Film über etwas Schönes 01:23Noch ein Film über etwas 02:34Und ein dritter Film dazu 03:45", "Echter Text ohne Marken."),
])
def test_clean_body(spark, url, body, want):
    df = spark.createDataFrame([(url, body, None, None)], "url string, body string, title string, description string")
    assert bd.clean_body(df).first().body == want


def test_clean_body_with_title_and_lede(spark):
    df = spark.createDataFrame([("https://www.n-tv.de/id1.html", "Ressort Eine lange Überschrift Der Text.", "Eine lange Überschrift - n-tv.de", None),
                                ("https://www.faz.net/x/y-1.html", "Titel Gastbeitrag Von Max Muster Der erste Satz der Meldung steht hier. Mehr.", "T", "Der erste Satz der Meldung steht hier.")], "url string, body string, title string, description string")
    assert [r.body for r in bd.clean_body(df).collect()] == ["Der Text.", "Titel Der erste Satz der Meldung steht hier. Mehr."]


def test_choose_body(spark):
    long = lambda n: "\n".join(PARA.format(i) for i in range(n))
    cases = [(long(30), long(31), False, "raw"), (long(30), long(40), False, "rendered"), (long(30), long(31), True, "rendered"), ("", long(30), False, "rendered"), (long(30), "", False, "raw"), (long(3), long(2), False, "raw")]
    df = spark.createDataFrame([(r, d, l, r if w == "raw" else d) for r, d, l, w in cases], "r string, d string, l boolean, want string")
    assert df.filter(bd.choose_body(F.col("r"), F.col("d"), F.col("l")) != F.col("want")).count() == 0


def test_liveblog_body(spark):
    ld = {"@type": "LiveBlogPosting", "liveBlogUpdate": [{"datePublished": "2026-01-01T11:00:00Z", "headline": "B", "articleBody": "zwei"}, {"datePublished": "2026-01-01T10:00:00Z", "headline": "A"},
                                                         {"datePublished": "2026-01-01T12:00:00Z", "headline": "a"}, {"datePublished": "2026-01-01T12:00:00Z"}]}
    df = ex.with_jsonld(spark.createDataFrame([(page([ld]),), (page([{"@type": "NewsArticle"}]),)], "html string"))
    assert [r[0] for r in df.select(bd.liveblog_body(F.col("ld"))).collect()] == ["A\n\nB. zwei", None]


def test_track_body(spark):
    text = "".join(f"<p>{PARA.format(i)}</p>" for i in range(30))
    df = ex.with_jsonld(spark.createDataFrame([("https://x.de/a", f"<article>{text}<p>{'w' * 70}</p></article>", f"<article>{text}</article>", "T", None, False)], "url string, html string, raw_html string, title string, description string, is_live boolean"))
    r = bd.track_body(df).first()
    assert r.body.startswith(PARA.format(0)) and "www" not in r.body and r.is_live is False


def drop_blobs_plainly(text):
    """Front to back: an object that opens with a context goes with its last brace; one that never closes keeps the rest."""
    out, at = "", 0
    while (start := text.find('{"@context"', at)) >= 0:
        depth, end = 0, start
        while end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
            if depth == 0:
                break
        if depth:
            break
        out, at = out + text[at:start] + " ", end
    return out + text[at:]


def cut_clips_plainly(text):
    starts = [m.start() for m in re.finditer(r"[^\n]{15,220}?[0-9]{1,2}:[0-9]{2}(?=[A-ZÄÖÜ]|\Z)", text)]
    near = [a for a, c in zip(starts, starts[2:]) if c - a < 900]
    return text[: near[0]] if near else text


def test_blobs_and_video_lists_against_plain_code(spark):
    rnd = random.Random(4)
    parts = ['{"@context"', '{"a"', "{", "}", "} ", ":1", " Wort", "\n", "ü😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts + [None])), "i int, t string").select("t", bd.without_json_blobs(F.col("t")).alias("r")).collect()
    assert all(r.r == (None if r.t is None else drop_blobs_plainly(r.t)) for r in rows)
    bits = ["Ein Satz über etwas ", "12:30Uhr", "1:23Noch", " 01:23", "\n", "x" * 300, "Ä", " 9:59Ö"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 30))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts + [None])), "i int, t string").select("t", bd.without_video_list(F.col("t")).alias("r")).collect()
    assert all(r.r == (None if r.t is None else cut_clips_plainly(r.t)) for r in rows) and any(r.t and r.r != r.t for r in rows)
