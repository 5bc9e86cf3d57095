"""Pages taken apart for translation and put together again."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import translation as tr

BLOCKS = [
    "<h2>Head {0} &amp; more</h2>", "<p>One <strong>bold</strong> &lt;tag&gt;<br>two {x}</p>", "<ul><li>a</li><li></li><li>c <em>d</em></li></ul>", "<pre><code>x = {1};\n</code></pre>",
    '<figure><img src="https://a/{b}.png" alt="q">' + "<figcaption>Say &quot;it&quot;</figcaption></figure>", '<figure><img src="x" alt="y"></figure>', "<blockquote>“Quoted” „text“</blockquote>",
    '<div class="plain"><span>p</span></div>', "<p></p>", "<ol><li>1</li></ol>",
]


def tables(spark, *pages):
    titles = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pages)], "page long, title string")
    blocks = spark.createDataFrame([(i, n, b) for i, (_, bs) in enumerate(pages) for n, b in enumerate(bs)], "page long, pos long, body string")
    return titles, blocks


def answered(spark, titles, blocks, reply):
    rows = [(r.page, r.chunk, a, reply(r.page, r.chunk, a, r.texts)) for r in tr.requests(titles, blocks).collect() for a in (1, 2, 3)]
    answers = spark.createDataFrame(rows, "page long, chunk int, attempt int, reply string")
    return {r.page: (r.title, r.body, r.calls) for r in tr.translated(titles, blocks, answers).collect()}


def test_identity_gives_back_the_page(spark):
    titles, blocks = tables(spark, ("A <b> & “c”", BLOCKS), ("only a title", []), ("long", ["<p>" + "word " * 500 + f"{i}</p>" for i in range(5)]))
    got = answered(spark, titles, blocks, lambda p, c, a, texts: json.dumps(texts))
    want = "\n".join(BLOCKS).replace("&quot;", '"')
    assert got[0] == ("A <b> & “c”", want, 1) and got[1] == ("only a title", "", 1)
    assert got[2][1] == "\n".join("<p>" + "word " * 500 + f"{i}</p>" for i in range(5)) and got[2][2] == 5


def test_texts_and_chunks(spark):
    titles, blocks = tables(spark, ("T & “x”", BLOCKS), (None, ["<p>" + "a" * 2990 + "</p>", "<p>" + "b" * 10 + "</p>", "<p>c</p>"]))
    got = {(r.page, r.chunk): r.texts for r in tr.requests(titles, blocks).collect()}
    assert got[0, 0] == ["T &amp; &ldquo;x&rdquo;", "Head {0} &amp; more", "One <strong>bold</strong> &lt;tag&gt;<br>two {x}", "a", "", "c <em>d</em>", "Say &quot;it&quot;", "&ldquo;Quoted&rdquo; &bdquo;text&ldquo;", "", "1"]
    assert [len(got[1, c]) for c in (0, 1)] == [3, 1] and set(got) == {(0, 0), (1, 0), (1, 1)}


def test_one_retry_and_what_does_not_line_up(spark):
    pages = [("t", ["<p>a</p>", "<p>b</p>"])] * 6

    def reply(page, chunk, attempt, texts):
        good = "thinking [of it]</think>Here: " + json.dumps([t.upper() for t in texts])
        bad = [good[:-3], json.dumps(texts[:-1]), "no", json.dumps([*texts, "x"]), json.dumps(["x", None, "y"])]
        if page == 5:
            return bad[attempt - 1] if attempt < 3 else good
        return bad[page] if attempt == 1 else good

    got = answered(spark, *tables(spark, *pages), reply)
    assert set(got) == {0, 1, 2, 3, 4} and all(x == ("T", "<p>A</p>\n<p>B</p>", 2) for x in got.values())


@pytest.mark.parametrize(
    ("text", "want"),
    [("a <strong>b</strong><br>c", "a <strong>b</strong><br>c"), ("<script>x</script>", "&lt;script&gt;x&lt;/script&gt;"), ("a &amp; b & c", "a &amp; b &amp; c"), ("&lt;b&gt; &amp;lt;", "&lt;b&gt; &amp;lt;"), ("", ""),
     ("<em>", "<em>"), ('<em class="x">y</em>', '&lt;em class="x"&gt;y</em>')],
)
def test_only_inline_marks_survive(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tr.cleaned(F.col("t"))).first()[0] == want


def test_empty_tables(spark):
    titles, blocks = tables(spark)
    assert answered(spark, titles, blocks, None) == {}


def test_blocks_of_the_round_trip_are_made_once(spark, monkeypatch):
    from feedloom.operators import reader
    from feedloom.plans import page_queries

    seen = spark.sparkContext.accumulator(0)
    inner = reader.reader_blocks

    def counted(pages, title=None):
        made = inner(pages, title)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return made.mapInArrow(run, made.schema)

    monkeypatch.setattr(reader, "reader_blocks", counted)
    out = page_queries.translation_round_trip(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(out.collect()) > 0
    once = inner(page_queries._reader_pages(spark, "/root/testdata/sf0.001"), "title").count()
    assert once > 0 and seen.value == once
