"""The readable part of pages: what stays, what goes, and in which form."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import url
from feedloom.operators import reader
from tests.test_plain_text import NOTES

ARTICLE = (
    "<html><head><title>T</title></head><body><nav>Home | News</nav><article><h1>An article</h1>"
    + "".join(f'<p>Paragraph {i} of the story, with <b>bold</b> words and a <a href="https://ex.com/x">link</a> and enough text to count as prose.</p>' for i in range(8))
    + "<h2>A section</h2><p>&lt;script&gt;alert(1)&lt;/script&gt; stays text.</p><img src=\"https://tracker.ex/pixel.gif\"><script>alert(2)</script>"
    "<ul><li>one</li><li>two</li></ul></article><footer>Footer</footer></body></html>"
)


def pictures(inner):
    text = "".join(f"<p>Paragraph {i} of the story, with enough words in it to count as prose.</p>" for i in range(8))
    return f"<html><body><article><h1>T</h1>{text}{inner}<p>The last words.</p></article></body></html>"


def read(spark, *pages, title=None):
    df = spark.createDataFrame([(i, "https://ex.com/a/b?c", p, title) for i, p in enumerate(pages)], "page long, url string, html string, title string")
    rows = reader.reader_blocks(df, "title" if title else None).orderBy("page", "pos").collect()
    return ["\n".join(r.body for r in rows if r.page == i) for i in range(len(pages))]


def test_articles_are_rebuilt(spark):
    nav = "<html><body><main><p>" + " ".join(f"Rubrik{i} Untermenü einblenden" for i in range(80)) + "</p></main></body></html>"
    body, paywall, menu, nothing, empty = read(spark, ARTICLE, "<html><body><p>Subscribe to read.</p></body></html>", nav, None, "", title=" an Article ")
    assert "<p>Paragraph 0 of the story, with <strong>bold</strong> words and a link and enough" in body
    assert "<h2>A section</h2>\n<p>&lt;script&gt;alert(1)&lt;/script&gt; stays text.</p>\n<ul><li>one</li><li>two</li></ul>" in body
    for gone in ("<script", "alert(2)", "<img", "tracker.ex", "href", "An article", "Home", "Footer"):
        assert gone not in body
    assert (paywall, menu, nothing, empty) == ("", "", "", "")
    assert "An article" in read(spark, ARTICLE)[0]


def test_headings_without_text_go(spark):
    post = "<p>" + "This is what the post says about the licence change. " * 6 + "</p>"
    page = (
        f"<html><body><article><h2>Post by ann</h2>{post}<h2>Post by bob</h2><h2>Post by cid</h2><h3>Empty part</h3><h2>Section</h2><h3>Part</h3>{post}"
        "<h2>Post by dan</h2><h3>More</h3></article></body></html>"
    )
    (body,) = read(spark, page)
    assert "<h2>Post by ann</h2>" in body and "<h2>Section</h2>\n<h3>Part</h3>\n<p>" in body
    assert not any(x in body for x in ("bob", "cid", "Empty part", "dan", "More"))


def test_plain_text_code_and_drawings_in_pre(spark):
    code = "".join(f"int f{i}(int x) {{\n    return x + {i}; /* add it. Then return. */\n}}\n" for i in range(20))
    drawing = "┌──────┐\n│ FTL. │\n└──────┘\n"
    notes = NOTES.replace("<rare>", "&lt;rare&gt;")
    plain, coded, drawn = read(spark, f"<html><body><pre>{notes}</pre></body></html>", ARTICLE.replace("<h2>A", f"<pre>{code}</pre><h2>A"), ARTICLE.replace("<h2>A", f"<pre>{drawing}</pre><h2>A"))
    assert plain.startswith('<div class="plain"><span>Widget 10.6 was released') and "&lt;rare&gt;.</span>" in plain and "<pre>" not in plain
    assert "<pre><code>int f0(int x) {\n    return x + 0;" in coded and 'class="plain"' not in coded
    assert f"<pre><code>{drawing}</code></pre>" in drawn


def test_pictures_stand_with_their_captions(spark):
    inner = (
        '<figure><a href="/img/island.jpg"><img src="/img/island-640.jpg" alt="A &quot;cutout&quot;" width="640" height="331"></a><figcaption>The smaller island. <b>Sam Axon</b></figcaption></figure>'
        '<figure><img src="data:image/gif;base64,R0lGOD" data-src="https://cdn.ex.com/b.png"><figcaption>A chart of <b>speed</b></figcaption></figure>'
        '<p>With <img srcset="../c-500x300.jpg 1x, /d.jpg 2x" alt="see"> one</p><img src="c.jpg" alt="again"><img src="e.svg" alt="v"><img src="f.png" width="20" alt="icon"><img src="g.png">'
        '<a href="/other/story"><img src="h.jpg" alt="teaser"></a><aside><img src="i.jpg" alt="aside"></aside>'
    )
    (body,) = read(spark, pictures(inner))
    assert '<figure><img src="https://ex.com/img/island-640.jpg" alt="A &quot;cutout&quot;" loading="lazy" referrerpolicy="no-referrer"><figcaption>The smaller island. Sam Axon</figcaption></figure>' in body
    assert body.count("Sam Axon") == 1 and "data:image" not in body and "<figcaption>A chart of speed</figcaption>" in body
    assert '<img src="https://ex.com/c-500x300.jpg" alt="see"' in body and body.count("<figure>") == 3
    assert body.index("Paragraph 7") < body.index("island") < body.index("b.png") < body.index("The last words.")


def test_pages_without_a_frame_are_scored(spark):
    text = "".join(f"<p>Paragraph {i} of the story, with enough words in it to count as prose here.</p>" for i in range(8))
    links = "".join(f'<li><a href="/{i}">Other story number {i} that has a long headline as well</a></li>' for i in range(9))
    page = f"<html><body><header><p>Site name and a slogan that is long enough to be text by itself.</p></header><ul>{links}</ul><div><h2>Head</h2>{text}short</div><ul>{links}</ul><footer>end</footer></body></html>"
    (body,) = read(spark, page)
    assert body.startswith("<h2>Head</h2>\n<p>Paragraph 0") and "Other story" not in body and "Site name" not in body


@pytest.mark.parametrize(
    ("raw", "want"),
    [("<strong>a</strong> b", "<strong>a</strong> b"), ("<strong>a b", "a b"), ("a</em>b<em>", "ab"), ("a\u0001 \u0001b", "a<br>b"), ("<em>a</em><strong>b", "<em>a</em>b"), ("x<em> </em>y", "x y")],
)
def test_inline_marks_close(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(reader.balanced(F.col("r"))).first()[0] == want


@pytest.mark.parametrize(
    ("address", "want"),
    [("https://a/b", "https://a/b"), ("//c.d/e", "http://c.d/e"), ("/x?y", "http://h.o/x?y"), ("x.png", "http://h.o/p/q/x.png"), ("../x", "http://h.o/p/x"), ("../../x", "http://h.o/x"), ("../../../x", "http://h.o/x"),
     ("./x", "http://h.o/p/q/x"), ("mailto:a@b", None), ("", None), (None, None)],
)
def test_addresses_on_a_page(spark, address, want):
    df = spark.createDataFrame([(address, "http://h.o/p/q/r?s#t")], "a string, p string")
    assert df.select(url.joined(F.col("a"), F.col("p"))).first()[0] == want


def test_an_empty_table(spark):
    assert reader.reader_blocks(spark.createDataFrame([], "page long, url string, html string")).collect() == []


def test_the_windows_of_scores_hold_no_text_and_are_sorted_once(spark):
    pages = spark.createDataFrame([(1, "https://x.example/a", "<main><p>one two <a href='/b'>three</a></p></main>")], "page long, url string, html string")
    scored = reader.scored_blocks(pages).select("page", "block", "tag", "words", "linked", "inside", "score")
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert all("tok#" not in line.split("Window", 1)[1] for line in plan.splitlines() if "Window [" in line) and "begun" not in plan
    assert scored.count() == 1
