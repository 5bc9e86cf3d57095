"""Queries of plain text, videos and drawings in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html, plain_text, svg, url, video
from feedloom.operators import reader, translation
from feedloom.plans import text_queries
from feedloom.plans.text_queries import _DOMAIN, _TITLE
from feedloom.sources import feeds
from feedloom.sources.domain import read


def plain_gate(spark, sf_dir):
    """Which documents are hand-wrapped plain text."""
    return read(spark, sf_dir, "documents").select("doc_id", plain_text.is_plain_text(F.col("text")).alias("plain"))


def plain_reflow(spark, sf_dir):
    """Documents' lines joined to paragraphs, as HTML."""
    spans = read(spark, sf_dir, "documents").select("doc_id", plain_text.paragraphs(F.col("text")).alias("s"))

    def count(kind: str):
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")

    return spans.select("doc_id", *(count(k).alias(f"{k}s") for k in ("text", "rule", "blank")), F.md5(plain_text.plain_html(F.col("s"))).alias("html_md5"))


def _with_videos(spark, sf_dir):
    """The pages with linked data and meta tags in their heads, made of their titles and addresses: films in nested data, in tags, streams, none."""
    title, number = html.title(F.col("html")), F.col("page_id")
    pages = read(spark, sf_dir, "pages").withColumns({"title": title, "host": url.domain(F.col("url"))})
    kind, length = F.lit("VideoObject").alias("@type"), F.concat(F.lit("PT"), number % 3, F.lit("H"), number % 60, F.lit("M7S")).alias("duration")
    film = F.struct(
        kind, F.concat("url", F.lit("/v.mp4")).alias("contentUrl"), F.col("title").alias("description"), length,
        F.struct(F.concat("host", F.lit(", Desk , Paper")).alias("name")).alias("author"),
    )
    clip = F.struct(
        F.array(F.lit("Thing"), F.lit("VideoObject")).alias("@type"), F.struct(F.concat("url", F.lit(".bin")).alias("url")).alias("contentUrl"), F.lit("video/webm").alias("encodingFormat"),
        F.array(F.concat("url", F.lit("/p.jpg"))).alias("thumbnailUrl"), F.lit("PT45S").alias("duration"), F.array(F.col("host"), F.lit("second")).alias("author"),
    )
    stream = F.struct(kind, F.concat("url", F.lit("/v.m3u8")).alias("contentUrl"))
    page = F.struct(F.lit("WebPage").alias("@type"))
    nested = F.concat(F.lit('{"mainEntity": {"hasPart": ['), F.to_json(page), F.lit(", "), F.to_json(F.struct(F.array(stream, stream).alias("video"))), F.lit(", "), F.to_json(F.struct(clip.alias("video"))), F.lit("]}}"))

    def script(data):
        return F.concat(F.lit('<script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))

    def tags(form: str):
        own = (("og:video", F.concat("url", F.lit("/clip"))), ("og:video:type", F.lit(form)), ("og:image", F.concat("url", F.lit("/o.png"))), ("og:description", plain_text.escaped(F.col("title"))))
        return F.concat(*(F.concat(F.lit(f'<meta property="{k}" content="'), v, F.lit('">')) for k, v in own))

    head = (
        F.when(number % 6 == 0, script(F.concat(F.lit('{"@graph": ['), F.to_json(page), F.lit(", "), F.to_json(film), F.lit("]}"))))
        .when(number % 6 == 1, F.concat(script(F.lit("{broken")), script(nested)))
        .when(number % 6 == 2, tags("video/mp4"))
        .when(number % 6 == 3, tags("text/html"))
        .when(number % 6 == 4, script(F.to_json(stream)))
        .otherwise("")
    )
    return pages.withColumn("html", F.concat(head, "html"))


def page_videos(spark, sf_dir):
    """Every page's playable video, and what the reader shows of it."""
    pages = _with_videos(spark, sf_dir).withColumn("videos", video.linked_videos(video.linked_data(F.col("html"))))
    found = pages.select("page_id", "title", video.video(F.col("html"), F.col("videos")).alias("v"))
    return found.select("page_id", "v.*", F.md5(video.video_body(F.col("v"), F.col("title"))).alias("body_md5"))


def page_drawings(spark, sf_dir):
    """Drawings in replies about pages: their titles as labels, among what may not stay."""
    number, label = F.col("page_id"), plain_text.escaped(html.title(F.col("html")))
    bad = F.lit('<script>alert(1)</script><rect id="r" fill="#f00" style="x" onclick="y()"/><a href="https://evil.example"><text>gone</text></a>')
    drawing = F.concat(
        F.lit("Here:\n```svg\n"), F.when(number % 5 == 3, F.lit("<!DOCTYPE x>")).otherwise(""), F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="9" viewBox="0 0  360 '), number, F.lit('">'),
        F.when(number % 5 == 4, F.lit("<!ENTITY e 'e'>")).otherwise(""), bad, F.when(number % 5 != 2, F.concat(F.lit('<g><text x="1">'), label, F.lit("</text></g>"))).otherwise(""), F.lit("</svg>\n```"),
    )
    reply = F.when(number % 5 != 1, drawing).otherwise("I can't draw that.")
    return read(spark, sf_dir, "pages").select("page_id", svg.clean_svg(reply, F.concat(F.lit("p"), number)).alias("drawing"))


def _reader_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "url", "html", html.title(F.col("html")).alias("title"))


def translation_requests(spark, sf_dir):
    """What to ask for of every article: its chunks, with their texts."""
    pages = _reader_pages(spark, sf_dir)
    chunks = translation.requests(pages, reader.reader_blocks(pages, "title"))
    return chunks.select(F.col("page").alias("page_id"), F.col("chunk").cast("long").alias("chunk"), F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", "\n")).alias("texts_md5"))


def translation_round_trip(spark, sf_dir):
    """Articles translated by answers that say what was asked: one page in three needs the second attempt, one in seven has none that lines up."""
    pages = _reader_pages(spark, sf_dir)
    blocks = reader.reader_blocks(pages, "title").checkpoint()  # made once, for what is asked, what is answered and what is put together
    asked = translation.requests(pages, blocks).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    whole, cut = F.to_json("texts"), F.to_json(F.slice("texts", 1, F.size("texts") - 1))
    fails = ((F.col("page") % 3 == 0) & (F.col("attempt") == 1)) | (F.col("page") % 7 == 6)
    answers = asked.select("page", "chunk", "attempt", F.concat(F.lit("<think>[x]</think>So: "), F.when(fails, cut).otherwise(whole)).alias("reply"))
    out = translation.translated(pages, blocks, answers)
    return out.select(F.col("page").alias("page_id"), "title", F.md5("body").alias("body_md5"), "calls")


def _feeds(spark, sf_dir):
    """A feed for each page, RSS and Atom by turns: the page as an entry with its markup as content, and one that only has a summary."""
    title, number = plain_text.escaped(html.title(F.col("html"))), F.col("page_id")
    address, body = plain_text.escaped(F.col("url")), plain_text.escaped(F.col("html"))
    day = F.lpad((number % 28 + 1).cast("string"), 2, "0")
    rss = F.concat(
        F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:media="http://search.yahoo.com/mrss/"><channel><item><title>'), title, F.lit("</title><link>"), address,
        F.lit("</link><description>short</description><content:encoded>"), body, F.lit("</content:encoded><pubDate>Mon, "), day, F.lit(" Jan 2024 06:30:00 GMT</pubDate></item><item><link>"), address,
        F.lit("?2</link><description>sum</description><media:content url='https://i/"), number, F.lit(".png'/></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title, F.lit('</title><link rel="self" href="https://no/"/><link href="'), address, F.lit('"/><summary>short</summary><content type="html">'), body,
        F.lit("</content><published>2024-01-"), day, F.lit('T06:30:00Z</published></entry><entry><link rel="enclosure" type="image/png" href="https://i/'), number, F.lit('.png"/><link href="'), address, F.lit('?2"/><summary>sum</summary></entry></feed>'),
    )
    pages = read(spark, sf_dir, "pages")
    return pages.select(number.cast("string").alias("feed"), F.encode(F.when(number % 2 == 0, rss).otherwise(atom), "UTF-8").alias("content"))


def feed_files(spark, sf_dir):
    """Entries of all feeds since the middle of a month."""
    rows = feeds.feed_entries(_feeds(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return rows.select("feed", "pos", "url", "title", F.md5("snippet").alias("snippet_md5"), "image_url", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


def site_feeds(spark, sf_dir):
    """The feed of each page's site: named in its head in one case of three, found at a usual path in another, else none."""
    number = F.col("page_id")
    link = F.when(number % 3 == 0, F.concat(F.lit("<LINK rel='Alternate x' TYPE='application/Atom+xml' href='/f/"), number, F.lit("?a&amp;b'>"))).otherwise('<link rel="alternate" type="text/html" href="/no">')
    pages = read(spark, sf_dir, "pages").withColumn("site", F.concat("url", F.lit("#"), number))
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    paths = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.encode(F.lit(c), "UTF-8").alias("c")) for p, c in (("/feed", "<html>"), ("/atom.xml", "<?xml?><feed>"), ("/index.xml", "<rss>")))))
    fetched = pages.filter("page_id % 3 = 1").select(root.alias("root"), paths.alias("x")).select(F.concat("root", "x.p").alias("url"), F.col("x.c").alias("content"))
    found = feeds.discover(pages.select("site", F.concat(link, "html").alias("page")), fetched)
    return found.select(F.regexp_extract("site", "#([0-9]+)$", 1).cast("long").alias("page_id"), "feed")


QUERIES = {f.__name__: f for f in (feed_files, site_feeds, plain_gate, plain_reflow, page_videos, page_drawings, translation_requests, translation_round_trip)}

_BLANK = r"[\s\x1C-\x1F\x{85}\p{Z}]"
_RULE = f"^{_BLANK}*(" + "|".join(rf"\x{ord(c):02x}{{3,}}" for c in "-=~_*#") + f"){_BLANK}*$"
_BULLET, _QUOTE = rf"^{_BLANK}*(?:[-*+•]|[0-9]{{1,3}}[.)]){_BLANK}+[^\s\p{{Z}}]", rf"^{_BLANK}*(?:\*\*|>+|\|)(?:{_BLANK}+|$)"
_PROSE_ENDS = r"""'[.!?…]["''»«“”)\]]*(\s|$)'"""
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"

_QUOTED = "replace(replace(replace({}, '“', '&ldquo;'), '”', '&rdquo;'), '„', '&bdquo;')"
_BARE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: Texts of articles by place, the titles first, and the chunk of each.
_CHUNKS = f"""WITH RECURSIVE shown AS ({text_queries.ORACLE_SQL["reader_blocks"]}
    ), texts AS (
        SELECT page_id, 1 AS i, {_QUOTED.format(_BARE.format(_TITLE))} AS t FROM pages
        UNION ALL SELECT page_id, pos + 2, {_QUOTED.format("regexp_replace(body, '^<[a-z0-9]+>|</[a-z0-9]+>$', '', 'g')")} FROM shown
    ), fold AS (
        SELECT page_id, i, 0 AS chunk, length(t)::BIGINT AS held FROM texts WHERE i = 1
        UNION ALL SELECT t.page_id, t.i, CASE WHEN held + length(t) > 3000 THEN chunk + 1 ELSE chunk END, CASE WHEN held + length(t) > 3000 THEN length(t) ELSE held + length(t) END
        FROM fold JOIN texts t ON t.page_id = fold.page_id AND t.i = fold.i + 1
    )"""

ORACLE_SQL = {
    "translation_requests": f"""{_CHUNKS} SELECT page_id, chunk::BIGINT AS chunk, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY i)) AS texts_md5
        FROM fold JOIN texts USING (page_id, i) GROUP BY page_id, chunk""",
    "translation_round_trip": f"""{_CHUNKS} SELECT page_id, {_TITLE} AS title, md5(coalesce(body, '')) AS body_md5, (chunks * CASE page_id % 3 WHEN 0 THEN 2 ELSE 1 END)::BIGINT AS calls
        FROM pages JOIN (SELECT page_id, max(chunk) + 1 AS chunks FROM fold GROUP BY page_id) USING (page_id)
        LEFT JOIN (SELECT page_id, string_agg(replace(replace(body, '&quot;', '"'), '&#x27;', chr(39)), chr(10) ORDER BY pos) AS body FROM shown GROUP BY page_id) USING (page_id)
        WHERE page_id % 7 <> 6""",
    "plain_gate": rf"""SELECT doc_id, coalesce(length(text) >= 400 AND ends >= 3 AND words <= 60 * ends
            AND 20 * len(list_filter(lines, lambda x: regexp_matches(x, '[;{{}}]\s*$'))) <= len(lines)
            AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '\S {{3,}}\S'))) <= len(lines) AND NOT regexp_matches(text, '[─-╿]'), false) AS plain
        FROM (SELECT doc_id, text, len(regexp_extract_all(text, {_PROSE_ENDS})) AS ends, len(regexp_extract_all(text, '\S+')) AS words,
            list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)""",
    # here lines are rows, with the lines beside them in windows; the paragraphs are their runs
    "plain_reflow": rf"""WITH cut AS (
            SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
                SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM documents)
        ), bare AS (SELECT doc_id, i, regexp_replace(l, '{_BLANK}+$', '') AS l FROM cut
        ), seen AS (
            SELECT *, l = '' AS blank, regexp_matches(l, '{_RULE}') AS ruled, regexp_matches(l, '{_QUOTE}') AS quoted,
                CASE WHEN regexp_matches(l, '{_QUOTE}') THEN regexp_replace(l, '{_QUOTE}', '') ELSE regexp_replace(l, '^{_BLANK}+', '') END AS rest,
                length(l) - length(regexp_replace(l, '^{_BLANK}+', '')) AS indent FROM bare
        ), known AS (
            SELECT *, CASE WHEN quoted THEN trim(regexp_extract(l, '{_QUOTE}')) END AS mark, regexp_matches(rest, '{_BULLET}') AS item,
                CASE WHEN quoted THEN length(l) - length(rest) WHEN regexp_matches(l, '{_BULLET}') THEN length(regexp_extract(l, '{_BULLET}')) - 1 ELSE indent END AS hang,
                length(regexp_extract(trim(rest), '^[^\s\p{{Z}}]*')) AS word FROM seen
        ), wide AS (
            SELECT doc_id, coalesce(list_sort(list(length(l)) FILTER (NOT blank))[(count(*) FILTER (NOT blank)) * 9 // 10 + 1], 0) AS width, max(i) FILTER (NOT blank) AS final
            FROM known GROUP BY doc_id
        ), told AS (
            SELECT k.*, w.final, coalesce(NOT pblank AND NOT pruled AND word > 0 AND NOT coalesce(nruled, false) AND NOT item AND (plen + 1 + word) * 5 > w.width * 4
                AND CASE WHEN mark IS NOT NULL AND pmark IS NOT NULL THEN mark = pmark ELSE mark IS NULL AND pmark IS NULL AND indent = phang END, false) AS goes_on
            FROM (SELECT *, lag(blank) OVER o AS pblank, lag(ruled) OVER o AS pruled, lag(mark) OVER o AS pmark, lag(hang) OVER o AS phang, lag(length(l)) OVER o AS plen,
                lead(ruled) OVER o AS nruled FROM known WINDOW o AS (PARTITION BY doc_id ORDER BY i)) k JOIN wide w USING (doc_id)
        ), kinds AS (
            SELECT *, CASE WHEN blank THEN CASE WHEN NOT pblank AND i < final THEN 'blank' END WHEN ruled THEN 'rule' WHEN goes_on THEN 'on' ELSE 'text' END AS kind FROM told
        ), runs AS (SELECT *, count(*) FILTER (kind <> 'on') OVER (PARTITION BY doc_id ORDER BY i) AS run FROM kinds WHERE kind IS NOT NULL
        ), spans AS (
            SELECT doc_id, run, arg_min(kind, i) AS kind, arg_min(hang, i) AS hang,
                string_agg(CASE WHEN blank THEN '' WHEN kind = 'on' THEN trim(rest) ELSE l END, ' ' ORDER BY i) AS body FROM runs GROUP BY doc_id, run
        )
        SELECT d.doc_id, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'rule') AS rules, count(*) FILTER (kind = 'blank') AS blanks,
            md5('<div class="plain">' || coalesce(string_agg('<span' || CASE WHEN kind = 'rule' THEN ' class="rule"' WHEN kind = 'text' AND hang > 0
                THEN ' style="--h:' || hang || '"' ELSE '' END || '>' || {_ESCAPED.format('body')} || '</span>', '' ORDER BY run), '') || '</div>') AS html_md5
        FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id""",
    "page_videos": f"""WITH p AS (SELECT page_id, page_id % 6 AS k, url, {_TITLE} AS title, {_DOMAIN} AS host, page_id % 3 AS h, page_id % 60 AS m FROM pages
        ), v AS (
            SELECT page_id, k, title, CASE k WHEN 0 THEN url || '/v.mp4' WHEN 1 THEN url || '.bin' WHEN 2 THEN url || '/clip' END AS src,
                CASE k WHEN 1 THEN url || '/p.jpg' WHEN 2 THEN url || '/o.png' END AS poster, CASE WHEN k IN (0, 2) THEN nullif(title, '') END AS description,
                CASE k WHEN 0 THEN CASE WHEN h > 0 THEN h || ':' || lpad(m::VARCHAR, 2, '0') || ':07' ELSE m || ':07' END WHEN 1 THEN '0:45' END AS duration,
                CASE k WHEN 0 THEN host || ', Desk' WHEN 1 THEN host END AS author FROM p
        )
        SELECT page_id, src, poster, description, duration, author, md5('<video class="player" controls preload="none" playsinline'
            || coalesce(' poster="' || {_ESCAPED.format('poster')} || '"', '') || ' src="' || {_ESCAPED.format('src')} || '"></video>' || chr(10) || '<p class="video-info">'
            || {_ESCAPED.format("concat_ws(' · ', 'Video', duration || ' min', author)")} || '</p>') AS body_md5 FROM v""",
    "page_drawings": f"""SELECT page_id, CASE WHEN page_id % 5 IN (0, 3) THEN '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 360 ' || page_id || '" role="img"><rect id="p' || page_id
        || '-r" fill="currentColor" /><g><text x="1">' || replace(replace(replace({_TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text></g></svg>' END AS drawing FROM pages""",
    "feed_files": f"""SELECT page_id::VARCHAR AS feed, n AS pos, url || CASE n WHEN 1 THEN '?2' ELSE '' END AS url, CASE n WHEN 0 THEN {_TITLE} ELSE '' END AS title,
            md5(CASE n WHEN 0 THEN left({text_queries._strip('html')}, 500) ELSE 'sum' END) AS snippet_md5, CASE n WHEN 1 THEN 'https://i/' || page_id || '.png' END AS image_url,
            CASE n WHEN 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || ' 06:30' END AS published_at
        FROM pages, (VALUES (0::BIGINT), (1::BIGINT)) AS entries(n) WHERE n = 1 OR page_id % 28 >= 14""",
    "site_feeds": """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages)
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN root || '/f/' || page_id || '?a&b' WHEN root IN (SELECT root FROM p WHERE page_id % 3 = 1) THEN root || '/atom.xml' END AS feed FROM p""",
}
