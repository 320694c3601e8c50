"""URL rules on publisher forms."""

import pytest
from pyspark.sql import functions as F

from pressdelta.operators import extract as ex, url_jobs as uj
from pressdelta.sources import captures as cp

HEX = "6a4bf145b2ab39bc4a32345b"
UUID = "350acd2a-26ff-4761-9fd9-1234567890ab"


def one(spark, col, *args):
    return spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(col(*[F.col(f"c{i}") for i in range(len(args))])).first()[0]


@pytest.mark.parametrize("url,want", [
    ("https://www.n-tv.de/politik/Irgendein-Slug-id30797293.html", "https://www.n-tv.de/id30797293.html"),
    ("https://www.faz.net/aktuell/politik/ausland/slug-200749933.html?tab=tools#ref=rss", "https://www.faz.net/aktuell/politik/ausland/slug-200749933.html"),
    ("https://www.tagesschau.de/archiv?datum=2026-01-01", "https://www.tagesschau.de/archiv?datum=2026-01-01"),
    ("kein url", "kein url"),
])
def test_canonical_url(spark, url, want):
    assert one(spark, uj.canonical_url, url) == want


@pytest.mark.parametrize("url,want", [
    (f"https://www.bild.de/politik/slug-{HEX}", HEX), (f"https://www.spiegel.de/politik/slug-a-{UUID}", UUID), ("https://www.faz.net/aktuell/x/slug-faz-200749933.html", "200749933"),
    ("https://www.tagesschau.de/sport/fluch,wm-liveblog-100.html", "wm-liveblog-100"), ("https://www.tagesschau.de/sport/fluch,wm-liveblog-1000.html", "wm-liveblog-1000"), ("https://example.org/a/12345678.html", None),
])
def test_article_key(spark, url, want):
    assert one(spark, uj.article_key, url) == want


def test_page_canonical(spark):
    url = f"https://www.bild.de/sport/alt-{HEX}"
    page = lambda href: f'<link rel="canonical" href="{href}">'
    assert one(spark, uj.page_canonical, url, page(f"https://www.bild.de/sport/neu-{HEX}")) == f"https://www.bild.de/sport/neu-{HEX}"
    assert one(spark, uj.page_canonical, url, page(f"https://www.bild.de/article/{HEX}")) == url        # bare id form
    assert one(spark, uj.page_canonical, url, page("https://www.bild.de/sport/neu-" + "0" * 24)) == url  # another id
    assert one(spark, uj.page_canonical, "https://www.faz.net/a/b-12345678.html", page("https://other")) == "https://www.faz.net/a/b-12345678.html"


@pytest.mark.parametrize("url,want", [
    (f"https://www.bild.de/politik/slug-{HEX}", "article"), (f"https://www.spiegel.de/politik/slug-a-{UUID}", "article"), ("https://www.lemonde.fr/politique/article/2026/05/26/titre_1_2.html", "article"),
    ("https://www.faz.net/aktuell/politik/", "unknown"), ("https://x.de/inland", "unknown"), ("https://x.de/redaktion/person-12345.html", "unknown"), ("https://x.de/anzeigen/auto/deal-12345.html", "sponsored"),
    ("https://x.de/politik/anzeige-gegen-politiker-12345.html", "article"), ("https://www.bild.de/service/deals/x-12345.html", "sponsored"), ("https://www.spiegel.de/tests/x-12345.html", "sponsored"),
    ("https://x.de/sport/video-12345.html", "media"), ("https://x.de/podcast/folge-12345.html", "media"), ("https://x.de/wetter/heute/x-12345.html", "interactive"), ("https://x.de/impressum/a/b-12345.html", "service"),
    ("https://x.de/politik/beitrag-12345.html?advertorial=1", "sponsored"), ("https://x.de/politik/a-z/b-12345.html", "unknown"),
])
def test_url_kind(spark, url, want):
    assert one(spark, uj.url_kind, url) == want


@pytest.mark.parametrize("url,raw,label", [
    ("https://www.faz.net/aktuell/politik/ausland/slug-123.html", "politik/ausland", "Politik · Ausland"), ("https://x.de/rhein-main/frankfurt_stadt/slug.html", "rhein-main/frankfurt_stadt", "Rhein Main · Frankfurt Stadt"),
    ("https://x.de/2026/05/slug.html", None, None), ("https://x.de/slug.html", None, None),
])
def test_rubric(spark, url, raw, label):
    r = one(spark, uj.url_rubric, url)
    assert (r.raw, r.label) == (raw, label) if raw else r is None


@pytest.mark.parametrize("label,want", [
    ("Regional · Sachsen Anhalt", "sachsen-anhalt"), ("Inland · Thüringen", "thueringen"), ("Politique · International", "politik"), ("Économie", "economie"), ("Économies", "economies"), ("Economy", "wirtschaft"), ("Xy Abc", "abc"), ("12", None), ("Frühstück", "fruhstuck"),
])
def test_canon_category(spark, label, want):
    assert one(spark, uj.canon_category, label) == want


@pytest.mark.parametrize("cats,urls,want", [
    ((), ["https://x.de/inland/regional/hessen/a-1.html"], "regional"), ((), ["https://x.de/regionalliga/a-1.html"], "sonstiges"), (("Livres",), ["https://x.fr/international/a.html"], "politik"),
    ((), ["https://x.de/id1.html", "https://x.de/wirtschaft/boersen/a.html"], "wirtschaft"), (("Feuilleton",), ["https://x.de/id1.html"], "kultur"), ((), ["kein url"], "sonstiges"),
])
def test_topic(spark, cats, urls, want):
    df = spark.range(1).select(F.array(*[F.lit(c) for c in cats]).cast("array<string>").alias("c"), *[F.lit(u).alias(f"u{i}") for i, u in enumerate(urls)])
    assert df.select(ex.topic_of(F.col("c"), *[F.col(f"u{i}") for i in range(len(urls))])).first()[0] == want


@pytest.mark.parametrize("url,og,canon,want", [
    ("https://www.n-tv.de/id1.html", "https://www.n-tv.de/regionales/hessen/x-id1.html", None, "https://www.n-tv.de/regionales/hessen/x-id1.html"),
    ("https://x.de/inland/a-1.html", "https://mdr.de/sachsen/b/c.html", None, None), ("https://www.n-tv.de/id1.html", "kein", "https://x.de/sport/a.html", "https://x.de/sport/a.html"),
])
def test_rubric_url(spark, url, og, canon, want):
    df = spark.createDataFrame([(url, og, canon)], "url string, og_url string, canonical_href string")
    assert uj.with_rubric_url(df).first().rubric == want


def test_resolve_and_links(spark):
    html = '<a href="/a/b.html#x">1</a><a href="c.html">2</a><a href="https://x.de/d?e=1&amp;f=2">3</a><a href="https://y.de/z">4</a><a href="mailto:q@x.de">5</a><a href="//x.de/p">6</a><a href="https://x.de/">7</a>'
    df = spark.createDataFrame([("https://x.de/s/t.html?u=1", html)], "url string, html string")
    assert sorted(r.link for r in cp.page_links(df).collect()) == ["https://x.de/a/b.html", "https://x.de/d?e=1&f=2", "https://x.de/p", "https://x.de/s/c.html"]


def test_declared_feeds(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="/rss.xml"><link rel="alternate" hreflang="fr" href="/fr"><link type="application/atom+xml" rel=alternate href="https://x.de/atom">'
    df = spark.createDataFrame([("https://x.de/", html)], "url string, html string")
    assert sorted(r.feed for r in cp.declared_feeds(df).collect()) == ["https://x.de/atom", "https://x.de/rss.xml"]


def test_feed_links(spark):
    xml = '<item><link> https://x.de/a-12345.html#r </link><guid isPermaLink="true">https://x.de/a-12345.html</guid></item><entry><link rel="alternate" href="/b-12345.html"/></entry><link>https://y.de/c</link>'
    df = spark.createDataFrame([(1, "https://x.de/rss", xml)], "source_id bigint, url string, xml string")
    assert sorted(r.article_url for r in cp.feed_links(df).collect()) == ["https://x.de/a-12345.html", "https://x.de/b-12345.html"]


def test_sitemaps(spark):
    xml = """<urlset><url><loc>https://x.de/s/a-12345.html</loc><lastmod>2026-01-05T00:00:00Z</lastmod><news:publication_date>2026-01-02T03:04:05Z</news:publication_date></url>
    <url><loc>https://x.de/s/b-12345.html</loc><lastmod>2026-01-03</lastmod></url><url><loc>https://y.de/s/c-12345.html</loc></url><url><loc>https://x.de/anzeigen/s/d-12345.html</loc></url></urlset>"""
    df = spark.createDataFrame([(1, "https://x.de/sitemap.xml", xml)], "source_id bigint, url string, xml string")
    got = {r.article_url: (str(r["at"]), r.precise) for r in cp.sitemap_entries(df).collect()}
    assert got == {"https://x.de/s/a-12345.html": ("2026-01-02 03:04:05", True), "https://x.de/s/b-12345.html": ("2026-01-03 00:00:00", False)}
    names = ["sitemap-1957.xml", "sitemap-2026-05.xml", "sitemap-2026-06.xml", "sitemap-news.xml", "sitemap.xml"]
    files = spark.createDataFrame([(1, "https://x.de/" + n) for n in names], "source_id bigint, url string")
    assert [r.url.split("/")[-1] for r in cp.rank_sitemaps(files, 3).orderBy("rn").collect()] == ["sitemap-news.xml", "sitemap-2026-06.xml", "sitemap-2026-05.xml"]
    index = spark.createDataFrame([(1, "https://x.de/i.xml", "<sitemapindex>" + "".join(f"<loc>https://x.de/{n}</loc>" for n in names) + "</sitemapindex>")], "source_id bigint, url string, xml string")
    assert [r.url.split("/")[-1] for r in cp.index_children(index, 2).orderBy("rn").collect()] == ["sitemap-news.xml", "sitemap-2026-06.xml"]


def test_steps_in_links(spark):
    base = "https://x.de/a/b/c.html?q=1"
    cases = {"../d.html": "https://x.de/a/d.html", "./d": "https://x.de/a/b/d", "../../../../d": "https://x.de/d", "..": "https://x.de/a/", "/x/./y/../z": "https://x.de/x/z", "e?u=../f": "https://x.de/a/b/e?u=../f", "https://y.de/../g": "https://y.de/g", "a..b": "https://x.de/a/b/a..b"}
    rows = spark.createDataFrame([(h, base) for h in cases], "h string, b string").select("h", cp.resolve_url(F.col("h"), F.col("b")).alias("u")).collect()
    assert {r.h: r.u for r in rows} == cases
