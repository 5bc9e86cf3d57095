"""Feeds of both kinds, read from fetched files, and how sites' feeds are found."""

from datetime import datetime

from pyspark.sql import functions as F

from feedloom.sources import feeds

RSS = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>C</title><link>https://c</link>
<item><title>N &lt;b&gt;ew&lt;/b&gt;</title><link> http://n </link><description>short &lt;img src="https://i/d.png"&gt;</description><content:encoded><![CDATA[<p>Long <img src='https://i/c.png'> text</p>]]></content:encoded>
<pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>media</title><link>http://m</link><media:thumbnail url="https://i/t.png"/><media:content url="https://i/m.png"/><enclosure type="image/png" url="https://i/e.png"/></item>
<item><title>enclosed</title><link>https://e</link><enclosure type="audio/mp3" url="https://i/a.mp3"/><enclosure type="image/png" url="https://i/e.png"/><pubDate>02 Jan 2024 12:30 +0200</pubDate></item>
<item><title>old</title><link>http://o</link><pubDate>Thu, 02 Jan 2020 10:00:00 GMT</pubDate></item><item><title>none</title></item><item><title>ftp</title><link>ftp://x</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><link href="https://self" rel="self"/>
<entry><title type="html">T &amp;amp; U</title><link rel="self" href="https://no"/><link href="https://a/1"/><summary>sum</summary><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">Body <b>x</b></div></content>
<updated>2024-03-01T00:00:00Z</updated><published>2024-02-01T08:00:00+02:00</published></entry>
<entry><title>2</title><link rel="alternate" href="https://a/2"/><link rel="enclosure" type="image/jpeg" href="https://i/j.jpg"/><summary>only</summary></entry></feed>"""


def read(spark, *contents, since="2023-01-01"):
    df = spark.createDataFrame([(str(i), bytearray(c, "utf-8") if isinstance(c, str) else c) for i, c in enumerate(contents)], "feed string, content binary")
    return feeds.feed_entries(df, F.lit(since).cast("timestamp")).orderBy("feed", "pos").collect()


def test_rss_and_atom(spark):
    rows = read(spark, RSS, ATOM, None, "no xml", "")
    assert [(r.feed, r.url, r.title, r.snippet, r.image_url) for r in rows] == [
        ("0", "http://n", "N ew", "Long text", "https://i/c.png"), ("0", "http://m", "media", "", "https://i/m.png"), ("0", "https://e", "enclosed", "", "https://i/e.png"),
        ("1", "https://a/1", "T & U", "Body x", None), ("1", "https://a/2", "2", "only", "https://i/j.jpg"),
    ]
    assert [r.published_at and r.published_at.timestamp() for r in rows] == [datetime.fromisoformat(x).timestamp() if x else None for x in ("2024-01-02T10:00:00+00:00", None, "2024-01-02T10:30:00+00:00", "2024-02-01T06:00:00+00:00", None)]


def test_limits_of_a_feed(spark, monkeypatch):
    many = "<rss><channel>" + "".join(f"<item><link>http://{i}</link><title>{'x' * 900}</title><description>{'y' * 900}</description></item>" for i in range(3000)) + "</channel></rss>"
    rows = read(spark, many)  # over two megabytes: cut off, and still read
    assert len(many) > feeds.MOST_BYTES and [r.url for r in rows] == [f"http://{i}" for i in range(20)] and all(len(r.snippet) == 500 for r in rows)
    assert read(spark, '<!DOCTYPE x [<!ENTITY a "b">]><rss><channel><item><link>http://&a;</link></item></channel></rss>') == []


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.atom").write_text(ATOM)
    assert sorted(r.url for r in feeds.rss_entries(spark, str(tmp_path), "2024-01-15").collect()) == ["http://m", "https://a/1", "https://a/2"]


def test_discovery(spark):
    pages = [
        ("https://a.de/x/y", "<LINK REL='stylesheet alternate' TYPE='application/RSS+xml' HREF='../feed?a=1&amp;b=2'>"), ("https://b.de/", '<link rel="alternate" type="text/html" href="/no"><link rel="icon" href="/i">'),
        ("https://c.de/p", "<p>x</p>"), ("https://d.de/", None), ("https://e.de", '<link rel="alternate" type="application/atom+xml" href="//f.de/atom"><link rel="alternate" type="application/rss+xml" href="/rss">'),
    ]
    fetched = [("https://b.de/feed", "<html>"), ("https://b.de/atom.xml", "<?xml?><FEED>"), ("https://b.de/index.xml", "<rss>"), ("https://d.de/feed", "<rss>")]
    sites = spark.createDataFrame(pages, "site string, page string")
    found = feeds.discover(sites, spark.createDataFrame([(u, bytearray(c, "utf-8")) for u, c in fetched], "url string, content binary"))
    assert {r.site: r.feed for r in found.collect()} == {
        "https://a.de/x/y": "https://a.de/feed?a=1&b=2", "https://b.de/": "https://b.de/atom.xml", "https://c.de/p": None, "https://d.de/": None, "https://e.de": "https://f.de/atom",
    }


def test_opml_in_any_form(spark):
    text = "<outline text=\"x\" xmlUrl='https://a/f?x=1&amp;y=2'/><OUTLINE XMLURL = \"http://b\"></OUTLINE><outline xmlUrl='https://a/f?x=1&amp;y=2'/><outline xmlUrl='ftp://c'/><outline text='d'/>"
    assert spark.createDataFrame([(text,)], "o string").select(feeds.opml_feeds("o")).first()[0] == ["https://a/f?x=1&y=2", "http://b"]
