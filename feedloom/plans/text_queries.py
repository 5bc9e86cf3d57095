"""Queries of URL, HTML and text functions, and of sources and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html, text, url
from feedloom.operators import latest, reader
from feedloom.sources.domain import read

URL = "url"


def _pages(spark, sf_dir):
    return read(spark, sf_dir, "pages")


def norm_url_identity(spark, sf_dir):
    """Keys of addresses: whole, without their scheme, and without a scheme's name."""
    bare = F.regexp_replace(URL, "^https?://", "")
    return _pages(spark, sf_dir).select(
        "page_id", url.norm_url(URL).alias("url_key"), url.norm_url(bare).alias("bare_key"), url.norm_url(F.concat(F.lit("//"), bare)).alias("open_key")
    )


def site_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", url.site_of(URL).alias("site"), url.domain(URL).alias("domain"))


def url_words(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(url.url_words(URL), " ").alias("words"))


def strip_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(html.strip_html(F.col("html"))).alias("text_md5"))


def page_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"))


def anchors(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(html.anchors(F.col("html"), F.col("url"))).alias("pos", "a"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("a.url").alias("href"), F.col("a.text").alias("label"))


def url_list(spark, sf_dir):
    """Every http(s) URL in free text, in order, without the punctuation that follows it."""
    free = F.concat(F.lit("see "), URL, F.lit(", then ("), URL, F.lit(")."))
    found = F.regexp_extract_all(free, F.lit("(https?://[^\\s<>\"']+)"), F.lit(1))
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(found).alias("pos", "u"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_replace("u", "[.,;:)\\]}]+$", "").alias("found_url"))


def ad_filter(spark, sf_dir):
    titled = _pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))
    return titled.filter(~text.is_ad(F.col("title"), ("the ", "DES "))).select("page_id")


def repeats_title(spark, sf_dir):
    t = html.title(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", text.repeats_title(t, F.concat(t, F.lit(" - x.org"))).alias("repeats"), text.repeats_title(t, URL).alias("by_url"),
        text.repeats_title(t, F.substring(t, 1, 20)).alias("begins"), text.repeats_title(t, F.concat(t, F.lit(" and a good deal more"))).alias("adds"))


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def detect_lang(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.detect_lang(F.col("text")).alias("detected"))


def prose_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.is_prose(F.col("text")).alias("prose"), text.word_count(F.col("text")).cast("long").alias("n_words"))


def card_summary(spark, sf_dir):
    """Summaries of cards from a feed's snippet and the page's description: here a text's first 500 characters and the 300 after them."""
    summary = text.card_summary(F.substring("text", 1, 500), F.substring("text", 501, 300))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(summary).alias("summary_md5"))


def diagram_gate(spark, sf_dir):
    drawn = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("+---+ " * 8), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.is_diagram(drawn).alias("diagram"))


def shared_text(spark, sf_dir):
    """Texts that three documents or more have in common, counted once for each document."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return lines.filter("line <> ''").groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


def import_store(spark, sf_dir):
    """Imported pages, one per page identity, that aren't known."""
    pages = _pages(spark, sf_dir).select("page_id", url.norm_url(URL).alias("url_key"))
    known = pages.filter("page_id % 5 = 0").select("url_key").distinct()
    return latest.first_by(pages, ["url_key"], "page_id").join(known, "url_key", "left_anti")


def gather_dedupe(spark, sf_dir):
    """Batches of sources in their order: of a raw URL the first row stays, if it isn't stored."""
    batch = _pages(spark, sf_dir).select("page_id", "url", (F.col("page_id") % 3).alias("source_order"))
    doubled = batch.unionByName(batch.withColumn("source_order", F.col("source_order") + 1))
    stored = batch.filter("page_id % 7 = 0").select("url").distinct()
    return latest.first_by(doubled, ["url"], "source_order", "page_id").join(stored, "url", "left_anti")


def pending_domains(spark, sf_dir):
    """The 20 domains with two pages or more that aren't tried yet, most pages first."""
    hosts = _pages(spark, sf_dir).select(url.domain(URL).alias("domain")).filter("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    open_ = hosts.filter((F.col("n") >= 2) & ~F.col("domain").isin("spam-farm.example.org"))
    return open_.orderBy(F.desc("n"), "domain").limit(20)


def turn_validation(spark, sf_dir):
    """Conversations that a chat may answer: known roles only, the last turn the user's, 40 turns at most."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max_by("role", "turn").alias("last_role"), F.count(F.lit(1)).alias("turns"), F.bool_and(F.col("role").isin("user", "assistant")).alias("known")
    )
    return turns.select("conv_id", (F.col("known") & (F.col("last_role") == "user") & (F.col("turns") <= 40)).alias("valid"))


def reply_cap(spark, sf_dir):
    """Turns up to 2,000 characters of a conversation, in order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "conversations").withColumn("so_far", F.sum(F.length("text")).over(w))
    return rows.filter("so_far <= 2000").select("conv_id", "turn", "so_far")


def health_counts(spark, sf_dir):
    """Rows of each table, in one row."""
    tables = ("pages", "events", "documents", "embeddings", "conversations")
    rows = [read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(t)) for t in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.agg(*[F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in tables])


def plain_paragraphs(spark, sf_dir):
    """Reader HTML as paragraphs."""
    parts = F.split(F.regexp_replace("html", "</p>|</h1>|</h2>|</li>|<br>", "\u0001"), "\u0001")
    kept = F.filter(F.transform(parts, html.strip_html), lambda x: x != "")
    return _pages(spark, sf_dir).select("page_id", F.size(kept).cast("long").alias("paragraphs"), F.md5(F.array_join(kept, "\n")).alias("text_md5"))


def block_scores(spark, sf_dir):
    """Every block of a page that isn't round its article, with its words, those in links, and its score beside its neighbours."""
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("page"), "url", "html")
    rows = reader.scored_blocks(pages)
    return rows.select(F.col("page").alias("page_id"), F.col("block").cast("long").alias("block"), "tag", *(F.col(c).cast("long").alias(c) for c in ("words", "linked")), "inside", "score")


def reader_blocks(spark, sf_dir):
    """Headings, paragraphs, lists and figures of the articles in order, as safe HTML, under the pages' titles."""
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("page"), "url", "html", html.title(F.col("html")).alias("title"))
    return reader.reader_blocks(pages, "title").select(F.col("page").alias("page_id"), "pos", "tag", "body")


QUERIES = {
    f.__name__: f
    for f in (
        norm_url_identity, site_key, url_words, strip_html, page_title, anchors, url_list, ad_filter, repeats_title, detect_lang, prose_gate,
        card_summary, diagram_gate, shared_text, import_store, gather_dedupe, pending_domains, turn_validation, reply_cap, health_counts,
        plain_paragraphs, block_scores, reader_blocks,
    )
}

_AUTH = r"regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = r"regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_DOMAIN = rf"regexp_replace(regexp_replace(lower({_AUTH}), '^[^@]*@|:[0-9]*$', '', 'g'), '^www\.', '')"
_KEY = rf"""regexp_replace(lower({_AUTH}), '^www\.', '') || regexp_replace({_PATH}, '/+$', '') || coalesce('?' || nullif(array_to_string(
    list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> ''
      AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')
      AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid')), '&'), ''), '')"""


#: Those that occur in the given pages.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def _decode(x: str) -> str:
    for _ in range(2):
        for entity, char in _ENTITIES:
            x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _strip(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({_decode(f'coalesce({x}, chr(32))')}, '<[^>]*>', ' ', 'g'), '<[^>]*$', '')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), '[ \t\n\r\f]+', ' ', 'g'))"


def _cut(x: str) -> str:
    bare = rf"""regexp_replace({x}, '\s*(\.\.\.|…)["“”»)]?$', '')"""
    return f"CASE WHEN length({bare}) > 240 THEN regexp_replace(regexp_replace(left({bare}, 240), ' [^ ]*$', ''), '[,;:–-]+$', '') ELSE {bare} END || '…'"


_TITLE = _strip("regexp_extract(html, '<title>([^<]*)</title>', 1)")


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _repeats(said: str) -> str:
    return f"(a <> '' AND {said} <> '' AND (starts_with(a, {said}) OR (starts_with({said}, a) AND length({said}) - length(a) <= 12)))"


_ALNUM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_ENDS = r"""'[.!?…]["''»«“”)\]]*(\s|$)'"""

ORACLE_SQL = {
    "norm_url_identity": f"""SELECT page_id, max(k) FILTER (form = 0) AS url_key, max(k) FILTER (form = 1) AS bare_key, max(k) FILTER (form = 2) AS open_key FROM (
        SELECT page_id, form, {_KEY} AS k FROM (
            SELECT page_id, form, CASE form WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') ELSE '//' || regexp_replace(url, '^https?://', '') END AS url
            FROM pages, (VALUES (0), (1), (2)) AS forms(form))) GROUP BY page_id""",
    "site_key": f"""SELECT page_id, CASE WHEN len(parts) >= 2 THEN d || '/' || parts[1] ELSE d END AS site, d AS domain FROM (
        SELECT page_id, {_DOMAIN} AS d, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS parts FROM pages)""",
    "url_words": f"""SELECT page_id, array_to_string(list_filter(regexp_split_to_array({_PATH}, '[^A-Za-zÀ-ÿ]+'),
        lambda w: length(w) >= 3 AND lower(w) NOT IN ('html', 'htm', 'php', 'aspx', 'index', 'status', 'www')), ' ') AS words FROM pages""",
    "strip_html": f"SELECT page_id, md5({_strip('html')}) AS text_md5 FROM pages",
    "page_title": f"""SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""",
    "anchors": f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, {_decode('href')} AS href, {_strip('inside')} AS label FROM (
        SELECT page_id, n, CASE WHEN starts_with(h, '/') AND NOT starts_with(h, '//') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h ELSE h END AS href, tag, regexp_replace(tag, '(?i)^<a[^>]*>|</a>$', '', 'g') AS inside FROM (SELECT *, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS h FROM (
        SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1)::BIGINT AS n FROM (
        SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a>') AS tags FROM pages)))) WHERE lower(href) LIKE 'http%'""",
    "url_list": r"""SELECT page_id, pos - 1 AS pos, regexp_replace(u, '[.,;:)\]}]+$', '') AS found_url FROM (
        SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1)::BIGINT AS pos FROM (
        SELECT page_id, regexp_extract_all('see ' || url || ', then (' || url || ').', 'https?://[^\s<>"'']+') AS us FROM pages))""",
    "ad_filter": f"SELECT page_id FROM (SELECT page_id, lower({_TITLE}) AS t FROM pages) WHERE NOT (contains(t, 'the ') OR contains(t, 'des '))",
    "repeats_title": f"""SELECT page_id, r(a, b) AS repeats, r(a, c) AS by_url, r(a, d) AS begins, r(a, e) AS adds FROM (
        SELECT page_id, {_ALNUM.format('t')} AS a, {_ALNUM.format("t || ' - x.org'")} AS b, {_ALNUM.format('url')} AS c, {_ALNUM.format('left(t, 20)')} AS d, {_ALNUM.format("t || ' and a good deal more'")} AS e
        FROM (SELECT page_id, url, {_TITLE} AS t FROM pages))""".replace("r(a, b)", _repeats("b")).replace("r(a, c)", _repeats("c")).replace("r(a, d)", _repeats("d")).replace("r(a, e)", _repeats("e")),
    "detect_lang": f"""SELECT doc_id, CASE WHEN de >= 5 AND de >= 2 * en AND de > en THEN 'de' WHEN en >= 5 AND en >= 2 * de THEN 'en' END AS detected FROM (
        SELECT doc_id, len(list_filter(w, lambda x: list_contains({_words(text.GERMAN)}, x))) AS de,
               len(list_filter(w, lambda x: list_contains({_words(text.ENGLISH)}, x))) AS en
        FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zäöüß]+') AS w FROM documents))""",
    "prose_gate": f"""SELECT doc_id, length(text) >= 400 AND ends >= 3 AND w <= 60 * ends AS prose, w::BIGINT AS n_words FROM (
        SELECT doc_id, text, len(regexp_extract_all(text, {_ENDS})) AS ends, len(regexp_extract_all(text, '\\S+')) AS w FROM documents)""",
    "card_summary": rf"""WITH texts AS (
            SELECT doc_id, k, regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '(^ | $)', '', 'g') AS t FROM (
                SELECT doc_id, 0 AS k, {_strip("left(text, 500)")} AS t FROM documents UNION ALL SELECT doc_id, 1, {_strip("substring(text, 501, 300)")} FROM documents)
        ), cut AS (
            SELECT doc_id, k, t, list_filter(string_split(regexp_replace(t, '([.!?…]["“”»)]?)\s+(["„“»(]?[A-ZÄÖÜ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM texts WHERE t <> ''
        ), whole AS (
            SELECT doc_id, k, t, CASE WHEN len(s) > 0 AND (regexp_matches(s[-1], '\s*(\.\.\.|…)["“”»)]?$') OR (k = 0 AND NOT regexp_matches(s[-1], '[.!?…]["“”»)]?$')))
                THEN s[1:len(s) - 1] ELSE s END AS w FROM cut
        ), said AS (
            SELECT doc_id, k, t, CASE WHEN len(w) = 0 THEN '' WHEN length(w[1]) >= 80 OR len(w) = 1 THEN w[1] WHEN length(w[1] || ' ' || w[2]) >= 80 OR len(w) = 2 THEN w[1] || ' ' || w[2]
                ELSE w[1] || ' ' || w[2] || ' ' || w[3] END AS p FROM whole
        ), summed AS (SELECT doc_id, k, t, CASE WHEN length(p) <= 240 THEN p ELSE {_cut("p")} END AS p FROM said)
        SELECT doc_id, md5(coalesce(CASE WHEN count(*) FILTER (length(p) >= 80) > 0 THEN arg_min(p, k) FILTER (length(p) >= 80)
            WHEN max(length(p)) > 0 THEN arg_max(p, length(p) * 2 - k) ELSE arg_max({_cut("t")}, length(t) * 2 - k) END, '')) AS summary_md5
        FROM documents LEFT JOIN summed USING (doc_id) GROUP BY doc_id""",
    "diagram_gate": r"""SELECT doc_id, list_max(list_transform(string_split(d, chr(10)), lambda x: length(rtrim(x)))) > 40
        AND (len(regexp_extract_all(d, '[─-╿]')) >= 6 OR len(regexp_extract_all(d, '\+-{2,}\+')) >= 2) AS diagram FROM (
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('+---+ ', 8) || text ELSE text END AS d FROM documents)""",
    "shared_text": """SELECT md5(line) AS line_md5, count(*) AS n FROM (
        SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(*) >= 3""",
    "import_store": f"""WITH k AS (SELECT page_id, {_KEY} AS url_key FROM pages)
        SELECT url_key, min(page_id) AS page_id FROM k GROUP BY url_key HAVING url_key NOT IN (SELECT url_key FROM k WHERE page_id % 5 = 0)""",
    "gather_dedupe": """WITH b AS (SELECT page_id, url, page_id % 3 AS source_order FROM pages UNION ALL SELECT page_id, url, page_id % 3 + 1 FROM pages)
        SELECT url, page_id, source_order FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_order, page_id) AS r FROM b)
        WHERE r = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0)""",
    "pending_domains": f"""SELECT {_DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1
        HAVING count(*) >= 2 AND domain NOT IN ('', 'spam-farm.example.org') ORDER BY n DESC, domain LIMIT 20""",
    "turn_validation": """SELECT conv_id, bool_and(role IN ('user', 'assistant')) AND arg_max(role, turn) = 'user' AND count(*) <= 40 AS valid
        FROM conversations GROUP BY conv_id""",
    "reply_cap": """SELECT conv_id, turn, so_far FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS so_far
        FROM conversations) WHERE so_far <= 2000""",
    "health_counts": """SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS documents,
        (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM conversations) AS conversations""",
    "plain_paragraphs": f"""SELECT page_id, len(k)::BIGINT AS paragraphs, md5(array_to_string(k, chr(10))) AS text_md5 FROM (
        SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '</p>|</h1>|</h2>|</li>|<br>', chr(1), 'g'), chr(1)),
            lambda x: {_strip('x')}), lambda x: x <> '') AS k FROM pages)""",
    "block_scores": f"""WITH cut AS (
            SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{reader.TOKEN}') AS ts FROM pages)
        ), named AS (
            SELECT *, CASE WHEN tag THEN lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) ELSE '' END AS name,
                CASE WHEN NOT tag THEN 0 WHEN starts_with(tok, '</') THEN -1 ELSE 1 END AS step FROM (SELECT *, regexp_matches(tok, '^<[A-Za-z/!?]') AS tag FROM cut)
        ), placed AS (
            SELECT *, sum(CASE WHEN name IN ({_quoted(reader.BLOCKS)}, 'img') THEN 1 ELSE 0 END) OVER w AS block,
                sum(CASE WHEN name IN ({_quoted(reader.AROUND)}) THEN step ELSE 0 END) OVER w AS around, sum(CASE WHEN name = 'a' THEN step ELSE 0 END) OVER w AS a,
                sum(CASE WHEN name IN ('article', 'main') THEN step ELSE 0 END) OVER w AS framed,
                max(CASE WHEN name IN ('article', 'main') AND step = 1 THEN i END) OVER w AS begun, CASE WHEN name = '' THEN len(regexp_extract_all(tok, '\\S+')) ELSE 0 END AS n
            FROM named WHERE NOT starts_with(tok, '<!') AND name NOT IN ({_quoted(reader.UNREAD)}) WINDOW w AS (PARTITION BY page_id ORDER BY i)
        ), outer_ AS (SELECT *, CASE WHEN begun IS NULL THEN 0 ELSE first_value(around) OVER (PARTITION BY page_id, begun ORDER BY i) END AS beyond FROM placed
        ), blocks AS (
            SELECT page_id, block, CASE WHEN arg_min(step, i) = 1 THEN arg_min(name, i) ELSE 'div' END AS tag, sum(n) AS words, sum(CASE WHEN a > 0 THEN n ELSE 0 END) AS linked,
                bool_or(around > beyond) AS goes, bool_or(framed > 0) AS inside, arg_min(name, i) AS first_name FROM outer_ GROUP BY page_id, block
        ), kept AS (SELECT *, bool_or(inside AND NOT goes) OVER (PARTITION BY page_id) AS has_frame FROM blocks WHERE words > 0 OR first_name = 'img')
        SELECT page_id, block::BIGINT AS block, tag, words::BIGINT AS words, linked::BIGINT AS linked, inside,
            (words - linked) + 0.5 * (coalesce(lag(words - linked) OVER o, 0) + coalesce(lead(words - linked) OVER o, 0))::DOUBLE AS score
        FROM kept WHERE NOT goes AND (inside OR NOT has_frame) WINDOW o AS (PARTITION BY page_id ORDER BY block)""",
    # the given pages' articles hold a heading and paragraphs
    "reader_blocks": f"""WITH parts AS (
            SELECT page_id, title, generate_subscripts(ps, 1) AS i, trim(regexp_replace({_decode("regexp_replace(unnest(ps), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS said
            FROM (SELECT page_id, {_TITLE} AS title, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>|</p>|</h1>') AS ps FROM pages)
        ), said AS (SELECT *, i = 1 AS head FROM parts WHERE said <> ''
        ), enough AS (
            SELECT page_id FROM said GROUP BY page_id HAVING sum(length(said) + 1) - 1 >= 400 AND sum(len(regexp_extract_all(said, {_ENDS}))) >= 3
                AND sum(len(regexp_extract_all(said, '\\S+'))) <= 60 * sum(len(regexp_extract_all(said, {_ENDS})))
        ), shown AS (SELECT * FROM said JOIN enough USING (page_id) WHERE NOT (head AND lower(said) = lower(trim(title))))
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, CASE WHEN head THEN 'h2' ELSE 'p' END AS tag,
            '<' || tag || '>' || replace(replace(replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</' || tag || '>' AS body FROM shown""",
}
