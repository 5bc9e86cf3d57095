"""The rows, the Atom feed and the digest of a cycle."""

from xml.etree import ElementTree

from feedloom.operators import output

ITEM = "cycle int, rank int, section string, candidate_id long, score double, reason string, source string, url string, title string, snippet string, published_at string, image_url string, description string"


def items(spark):
    rows = [
        (2, 1, "curated", 11, 0.5, None, "rss", "https://www.b.org/x/y", "", "<p>Snippet &amp; more</p>", None, None, "A description that is long enough to fill about two lines of a card, and ends."),
        (2, 0, "broad", 12, 0.25, "why <not>", "searxng", "http://c.org", "Third", None, "2024-01-01", "https://i/c.png", None),
        (2, 0, "curated", 10, 0.987, "fits", "hackernews", "https://a.org/?a&b", "First & \"best\"", "s", None, None, None),
        (1, 0, "curated", 9, 1.0, "old", "rss", "https://old", "Old", None, None, None, None),
    ]
    return spark.createDataFrame(rows, ITEM)


def test_rows_of_the_newest_cycle(spark):
    got = output.rows(items(spark)).orderBy("place").collect()
    assert [(r.candidate_id, r.title, r.reason, r.discovered_at) for r in got] == [(10, 'First & "best"', "fits", 2), (11, "https://www.b.org/x/y", "", 2), (12, "Third", "why <not>", 2)]
    assert got[1].snippet == "Snippet & more" and got[1].favicon == "https://www.google.com/s2/favicons?domain=b.org&sz=128"
    assert got[1].summary == "A description that is long enough to fill about two lines of a card, and ends." and got[2].image_url == "https://i/c.png"


def test_atom(spark):
    (row,) = output.atom(items(spark), "https://app/", "2024-01-31T00:00:00Z").collect()
    a = "{http://www.w3.org/2005/Atom}"
    feed = ElementTree.fromstring(row.feed.encode())
    entries = feed.findall(f"{a}entry")
    assert row.n == 3 and feed.find(f"{a}link").get("href") == "https://app/feed.atom" and [e.find(f"{a}title").text for e in entries] == ['First & "best"', "https://www.b.org/x/y", "Third"]
    assert [e.find(f"{a}summary").text for e in entries] == ["fits\n\n— hackernews (score 0.99)", "Snippet & more\n\n— rss (score 0.50)", "why <not>\n\n— searxng (score 0.25)"]
    assert entries[0].find(f"{a}link").get("href") == "https://a.org/?a&b" == entries[0].find(f"{a}id").text


def test_digest(spark):
    (row,) = output.digest(items(spark), "https://app/", "2024-01-31").collect()
    assert row.text == (
        '# Your digest — 2024-01-31\n\n## 1. [First & "best"](https://a.org/?a&b)\n> fits\n`hackernews` · score 0.99 · [rate](https://app/ui#c10)\n\n'
        "## 2. [https://www.b.org/x/y](https://www.b.org/x/y)\n`rss` · score 0.50 · [rate](https://app/ui#c11)\n\n"
        "# Beyond your bubble\n\n## 1. [Third](http://c.org)\n> why <not>\n`searxng` · score 0.25 · [rate](https://app/ui#c12)\n"
    )


def test_a_feed_without_items(spark):
    none = items(spark).limit(0)
    assert output.rows(none).collect() == [] and output.atom(none, "b", "u").first().feed.endswith("<updated>u</updated></feed>")
    assert output.digest(none, "b", "2024-01-31").first().text == "# Your digest — 2024-01-31\n\n" + output.NONE
