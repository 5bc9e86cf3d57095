import re
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm.main_text import KEPT, OPEN, OUT, _suffix_groups, _token_stream, main_texts, page_blocks


def text(html):
    return " ".join(t for t, s in page_blocks(html) if s != OUT)


PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>'
    '<body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy now.</div>'
    "<article><h1>A &amp; B</h1><p><b>First\n line.<br><p>Second&nbsp;one.</p></article><footer>&copy; host</footer></body></html>"
)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (PAGE, "A & B First line. Second one."),
        (PAGE[:-14], "A & B First line. Second one."),
        ("", ""),
        ("just <b>te</b>xt", "just text"),
        ("<p>a<p>b", "a b"),
        ('<div class="sidebar-left"><article>in</article><p>out</p></div>', "in"),
        ("<main><h1>x</h1><article><p>y</p></article><p>z</p></main>", "y"),
        ("<main><h1>x</h1><p>y</p></main><p>z</p>", "x y"),
        ("<article><p>t</p><article><p>comment</p></article></article>", "t"),
        ('<article><p>t</p><section id="comments"><p>c</p></section><form><p>f</p></form><aside>s</aside></article>', "t"),
        ('<article><p>t</p><div class="cookie-notice">n</div><div role="complementary">r</div><p hidden>h</p></article>', "t"),
        ("<article><header><h1>head</h1><span>by line</span></header><p>t</p><footer>f</footer></article>", "head t"),
        ('<article itemprop="x"><div itemprop="articleBody"><p>t</p></div></article>', "t"),
        ('<header>h</header><p>a <a href="x>y">link</a> &lt;tag&gt; 1 < 2</p>', "a link <tag> 1 < 2"),
        ("<p>a<script>if (a<b) '</p>'</SCRIPT >b</p><textarea>q</textarea><svg><text>s</text></svg>", "ab"),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1 2 3 4"),
        ("<p>x</p></div></p><p>y <a 'broken", "x y"),
        ('<body class="has-sidebar"><p>t</p></body>', "t"),
        ('<p>&#169;&#x41;&eacute;&notanentity; a&#10;b</p>', "©Aé¬anentity; a b"),
    ],
)
def test_pages(html, want):
    assert text(html) == want


def test_states():
    assert page_blocks("<article><p>a</p><p class=x>b</p></article><p>c</p>") == [("a", KEPT), ("b", OPEN), ("c", OUT)]
    assert page_blocks("<p>a</p><nav>b</nav>") == [("a", OPEN), ("b", OUT)]


def test_long_and_broken_pages_take_linear_time():
    for html in ("<p>" * 60_000, "<b>" * 60_000 + "x", "<a '" * 60_000, "<" * 60_000, "<!--" * 60_000, "x " * 500_000, "<b><div></div>" * 20_000, "</p>" * 60_000, "<script>" * 20_000):
        page_blocks(html)


def test_suffix_groups_equal_sorted_suffixes():
    random = np.random.default_rng(5)
    streams = [[str(t) for t in random.integers(0, 3, n)] for n in (0, 3, 40, 55, 8, 1, 200)]
    for length in (1, 2, 5, 8, 11):
        order, groups, tokens, starts = _suffix_groups(streams, length)
        want = defaultdict(list)
        for i, s in enumerate(streams):
            for j in range(len(s) - length + 1):
                want[tuple(s[j : j + length])].append(int(starts[i]) + j)
        got = defaultdict(list)
        for p, g in zip(order.tolist(), groups.tolist(), strict=True):
            got[g].append(p)
        assert sorted(got.values()) == sorted(want.values())
        assert (np.diff(groups) >= 0).all() and all(tuple(tokens[p : p + length]) in want for p in order)


def host_pages():
    menu = "".join(f"<p>{w}</p>" for w in "Start News Sport Culture Contact Imprint".split())
    note = "<p>Please accept that we store some files on your machine for ever</p>"
    rows = [(i, f"https://h.example/{i}", f"{menu}<p>{' '.join(f'w{i}x{j}' for j in range(20))}</p>{note if i % 2 else ''}<p>unique end {i}</p>") for i in range(12)]
    rows += [(20 + i, f"https://H.example:80/a{i}", f"<article><p>Body {i} is here</p><p class='note'>Please accept that we store some files on your machine for ever</p><p>Please accept that we store some files on your machine for ever</p></article>") for i in range(2)]
    rows += [(30 + i, f"https://other{i}.example/", f"{menu}<p>own {i}</p>") for i in range(3)]
    rows += [(40, "https://two.example/1", menu + note), (41, "https://two.example/2", menu + note), (41, "https://two.example/2", menu + note)]
    rows += [(50 + i, f"https://same.example/{i}", f"{menu}{note}") for i in range(3)]
    rows += [(60, None, menu), (61, "no host", menu), (None, "https://h.example/x", None), (62, "https://h.example/y", ""), (63, "https://h.example/z", "<p>" + "long " * 100_000 + "</p>")]
    return rows


def brute(rows, length=8, least=3, share=75):
    hosts, found = defaultdict(dict), {}
    for url, html in {(u, h) for _, u, h in rows}:
        blocks = [b for b in page_blocks(html or "") if b[1] != KEPT]
        host = re.match(r"(?i)[a-z][a-z0-9+.\-]*://([^/?#:]*)", url or "")
        host = host[1].lower() if host else ""
        stream = _token_stream([t for t, _ in blocks])
        for i in range(len(stream) - length + 1) if host else ():
            hosts[host].setdefault(tuple(stream[i : i + length]), set()).add(url)
        found[url, html] = (host, stream)
    out = []
    for page_id, url, html in rows:
        host, stream = found[url, html]
        hit = set()
        for i in range(len(stream) - length + 1):
            if len(hosts[host].get(tuple(stream[i : i + length]), ())) >= least:
                hit.update(range(i, i + length))
        at, kept, left = 1, [], []
        for t, s in page_blocks(html or ""):
            n = len(t.split(" "))
            if s != OUT:
                left.append(t)
                if s == KEPT or 100 * len(hit & set(range(at, at + n))) < share * n:
                    kept.append(t)
            at += n + 1 if s != KEPT else 0
        t = " ".join(kept or left)
        out.append((page_id, url, t, len(t)))
    return out


@pytest.mark.parametrize("how", [{}, {"volume_tokens": 60}, {"volume_tokens": 1}, {"length": 5, "least_pages": 2}])
def test_repeats_of_a_host_equal_brute_force(spark, how):
    rows = host_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("key", "drop", "host", "volume", "text")}).repartition(4)
    got = sorted(map(tuple, main_texts(pages, **how).collect()), key=repr)
    want = sorted(brute(rows, how.get("length", 8), how.get("least_pages", 3)), key=repr)
    assert got == want
    by = {r[0]: r[2] for r in got}
    if how.get("length") is None:
        assert by[1] == " ".join(f"w1x{j}" for j in range(20)) + " unique end 1"
        assert by[20] == "Body 0 is here Please accept that we store some files on your machine for ever"
        assert by[50].startswith("Start News") and by[40].startswith("Start News")


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in main_texts(pages).join(pages, "page_id").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)).split()) and r.n_chars == len(r.text)


def test_empty_table(spark):
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
