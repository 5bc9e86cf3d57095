"""Queries of sections' rules, exploring slots, verdicts, lookups, backfills and replies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions import html, text, url
from feedloom.operators import feedback as fb
from feedloom.operators import latest, replies, selection, similarity
from feedloom.plans.feedback_queries import _stats
from feedloom.plans.ranking_queries import _candidates, exploring_taste, near_stories
from feedloom.sources.domain import AS_OF, read, view, with_views

EPSILON, SLOTS = 0.2, 8


def _keyed(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumn("url_key", url.norm_url("url"))


def eligible_stories(spark, sf_dir):
    """By section, what links, other kept pages and earlier cycles leave: rules differ between the two."""
    keyed = _keyed(spark, sf_dir)
    links = keyed.filter("candidate_id % 11 = 0").select("url_key")
    saved = view(spark, sf_dir, "feedback").filter("axis = 'saved' AND user_id % 50 = 0").select("candidate_id").distinct()
    kept = keyed.join(saved, "candidate_id", "left_semi").select("url_key").unionByName(keyed.filter("candidate_id % 13 = 0").select("url_key"))
    return selection.eligible(keyed, links, kept, view(spark, sf_dir, "served"))


def choose_arm_draws(spark, sf_dir):
    """An arm for every event's draw, with chance EPSILON for any of them."""
    draws = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), ((F.col("event_id") * 7919) % 1000 / 1000).alias("u"), ((F.col("event_id") * 104729) % 1009 / 1009).alias("v")
    )
    return selection.choose_arms(draws, fb.greedy_arms(_stats(spark, sf_dir)), EPSILON)


def broad_picks(spark, sf_dir):
    """Eight exploring slots: the best arm with stories left, by taste less the site's penalty among its newest 30; links and served stories are out."""
    links = _keyed(spark, sf_dir).filter("candidate_id % 11 = 0").select("url_key")
    material = _keyed(spark, sf_dir).filter("source = 'searxng'").join(links, "url_key", "left_anti")
    material = material.join(view(spark, sf_dir, "served").select("candidate_id"), "candidate_id", "left_anti")
    arms = fb.greedy_arms(_stats(spark, sf_dir)).select("topic", "rate")
    taste = exploring_taste(spark, sf_dir, material).select("candidate_id", F.round("taste", 6).alias("taste"))
    penalty = F.when(F.col("candidate_id") % 4 == 0, 0.3).otherwise(0.0)
    options = material.join(arms, "topic").join(taste, "candidate_id", "left")
    options = options.select(F.lit(0).alias("tenant"), "candidate_id", "topic", "rate", "taste", penalty.alias("penalty"))
    return selection.fill_slots(options, SLOTS).select("slot", "candidate_id")


def broad_picks_by_user(spark, sf_dir):
    """Four exploring slots for every user, with chance: arms by all feedback, penalties by site, stories that the user has no feedback on."""
    material = _candidates(spark, sf_dir).filter("source = 'searxng'").select("candidate_id", "topic")
    arms = fb.greedy_arms(_stats(spark, sf_dir)).select("topic", "rate")
    taste = exploring_taste(spark, sf_dir, _candidates(spark, sf_dir).filter("source = 'searxng'"))
    scored = material.join(arms, "topic").join(taste, "candidate_id", "left").withColumn("penalty", F.when(F.col("candidate_id") % 4 == 0, 0.3).otherwise(0.0))
    log = view(spark, sf_dir, "log").select("user_id", "candidate_id")
    # the topics that a user has met are those that they have selected
    selected = log.join(_candidates(spark, sf_dir).select("candidate_id", "topic"), "candidate_id").select("user_id", "topic").distinct()
    return selection.fill_slots_by_place(selected, scored, log.distinct(), 4, "user_id", EPSILON, 7).select("user_id", "slot", "candidate_id")


def served_stories(spark, sf_dir):
    return selection.served_stories(view(spark, sf_dir, "served"), view(spark, sf_dir, "candidates"), 64).select("candidate_id")


def same_story_groups(spark, sf_dir):
    """The fresh stories that groups of one event drop, an edge being a near pair that a verdict calls the same; no verdict is a no."""
    pairs = near_stories(spark, sf_dir).checkpoint()  # all pairs are met once, for the verdicts and what they judge
    verdicts = pairs.filter("(a + b) % 5 > 0").select("a", "b", ((F.col("a") + F.col("b")) % 3 > 0).alias("verdict"))
    same = selection.judged(pairs, verdicts, ["a", "b"], False).filter("verdict")
    roots = similarity.components(same).withColumn("earlier", F.col("node") % 11 == 0).withColumn("relevance", F.col("node") % 13)
    return selection.drop_duplicates(roots, "relevance").select(F.col("node").alias("candidate_id"), "root")


def article_verdicts(spark, sf_dir):
    """Pages that a verdict, or the lack of one, takes for articles."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    verdicts = pages.filter("page_id % 4 > 0").select("page_id", (F.col("page_id") % 3 > 0).alias("verdict"))
    return selection.judged(pages, verdicts, ["page_id"], True).filter("verdict").select("page_id")


def story_lookup(spark, sf_dir):
    """A candidate's section and rank of its newest cycle, the link of its page, and the language that its body is read in."""
    newest = view(spark, sf_dir, "served").groupBy("candidate_id").agg(F.max_by(F.struct("section", "rank"), F.struct("cycle", "rank")).alias("x"))
    keyed = _keyed(spark, sf_dir).select("candidate_id", "url_key", "topic")
    links = keyed.filter("candidate_id % 3 = 0").groupBy("url_key").agg(F.max("candidate_id").alias("link_id"))
    lang = F.when(F.col("candidate_id") % 2 == 0, "de").when(F.col("candidate_id") % 5 == 0, "en")
    rows = keyed.join(newest, "candidate_id", "left").join(links, "url_key", "left")
    return rows.select("candidate_id", "x.section", "x.rank", "link_id", F.coalesce(lang, F.lit("original")).alias("body"))


def title_order(spark, sf_dir):
    """Pages' places within their language by title, whatever the case."""
    rows = read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.language(F.col("html")).alias("lang"))
    return rows.select("page_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(F.lower("title"), "page_id")).cast("long").alias("place"))


def newest_saves(spark, sf_dir):
    """The newest 200 saves."""
    saved = view(spark, sf_dir, "feedback").filter("axis = 'saved'")
    return saved.select("id", "user_id", "candidate_id").orderBy(F.desc("id")).limit(200)


def stage_status(spark, sf_dir):
    """Runs with the stages that failed, and whether they are degraded by that."""
    stage = F.concat(F.lit("stage"), (F.col("event_id") % 7).cast("string"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", stage).alias("failed"))
    folded = rows.groupBy("run").agg(F.array_sort(F.collect_set("failed")).alias("failed"))
    return folded.select("run", F.array_join("failed", ",").alias("failed"), F.when(F.size("failed") > 0, "degraded").otherwise("ok").alias("status"))


def recent_arm_stats(spark, sf_dir):
    """Serves and rewards of arms over feedback of the last 14 days: what is older is pruned, so arms can change."""
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 14 DAYS")
    topics = _candidates(spark, sf_dir).select("candidate_id", "topic")
    recent = view(spark, sf_dir, "feedback").filter(F.col("created_at") >= since)
    opens = view(spark, sf_dir, "opens").filter(F.col("created_at") >= since)
    stats = fb.arm_stats(view(spark, sf_dir, "served").join(topics, "candidate_id"), recent, opens)
    return stats.select("topic", "serves", F.round("rewards", 4).alias("rewards"))


def reset_vectors(spark, sf_dir):
    """Vectors of another model are dropped, so that they count as pending."""
    rows = read(spark, sf_dir, "embeddings").withColumn("model", F.when(F.col("label") % 2 == 0, "new").otherwise("old"))
    kept = F.when(F.col("model") == "new", F.col("embedding"))
    return rows.select("vec_id", kept.isNull().alias("pending"), F.coalesce(F.size(kept), F.lit(0)).cast("long").alias("dimensions"))


def outbox_backfill(spark, sf_dir):
    """Saves that no command covers, once, with one stamp for all: the newest there is."""
    log = view(spark, sf_dir, "log")
    saved = view(spark, sf_dir, "feedback").filter("axis = 'saved'").groupBy("candidate_id").agg(F.min("id").alias("id"))
    queued = log.filter("event_type = 'error' AND user_id % 5 = 0").select("candidate_id").distinct()
    stamp = log.agg(F.max("id").alias("stamp"))
    return saved.join(queued, "candidate_id", "left_anti").crossJoin(F.broadcast(stamp)).select("candidate_id", "stamp")


def holds_to_archive(spark, sf_dir):
    """Held pages become archived ones, but for those in the archive already."""
    keyed = _keyed(spark, sf_dir).select("candidate_id", "url_key")
    holds, archive = keyed.filter("candidate_id % 4 = 1"), keyed.filter("candidate_id % 6 = 1")
    return latest.first_by(holds, ["url_key"], "candidate_id").join(archive.select("url_key").distinct(), "url_key", "left_anti").select("url_key", "candidate_id")


def reply_scores(spark, sf_dir):
    """Scores out of replies that hold a list somewhere in their text."""
    said = F.concat(F.substring("text", 1, 40), F.lit(' [{"id":'), F.col("turn").cast("string"), F.lit(',"score":0.5},{"id":99,"score":'), (F.col("turn") % 2).cast("string"), F.lit("}] done"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.from_json(replies.reply_slice(F.translate(said, "[]", "")), "array<struct<id:long,score:double>>")).alias("x"))
    bracketed = read(spark, sf_dir, "conversations").filter("NOT contains(text, '[') AND NOT contains(text, ']')").select(
        "conv_id", "turn", F.explode(F.from_json(replies.reply_slice(said), "array<struct<id:long,score:double>>")).alias("x")
    )
    return rows.unionByName(bracketed).select("conv_id", "turn", "x.id", "x.score")


def safe_urls(spark, sf_dir):
    """Addresses that may be opened: http(s) ones, images without the size in their name."""
    given = F.when(F.col("page_id") % 5 == 0, F.lit("javascript:alert(1)")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://i.org/pic"), F.col("page_id").cast("string"), F.lit("-300x200.png"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", replies.http_url(given).alias("safe"))


def readable_gate(spark, sf_dir):
    """Pages that a reader may open: http(s), and not found unreadable before."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    failed = pages.filter("page_id % 9 = 0").select("page_id")
    return pages.filter(F.col("url").rlike("^https?://")).join(failed, "page_id", "left_anti").select("page_id")


def page_dates(spark, sf_dir):
    """Dates by what a page's head says, else by its address."""
    day = F.format_string("2023-%02d-%02d", (F.col("page_id") % 12 + 1).cast("int"), (F.col("page_id") % 28 + 1).cast("int"))
    head = F.when(F.col("page_id") % 3 == 0, F.concat(day, F.lit("T10:00:00Z")))
    address = F.when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/"), F.replace(day, F.lit("-"), F.lit("/")), F.lit("/x"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", replies.page_date(address, head).alias("published"))


def translation_chunks(spark, sf_dir):
    """Paragraphs of documents in chunks of at most 3,000 characters."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", lines.alias("lines"))
    chunks = replies.folded(F.transform("lines", lambda x: F.length(x)), replies.CHUNK)
    placed = rows.select("doc_id", F.explode(F.arrays_zip("lines", chunks.alias("chunk"))).alias("x"))
    return placed.groupBy("doc_id", F.col("x.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x.lines")).alias("chars"))


def pasted_urls(spark, sf_dir):
    """The first 100 distinct addresses that were pasted, with the descriptions of pages that could be fetched."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    pasted = latest.first_by(pages.select("url", F.col("page_id").alias("pos")), ["url"], "pos").orderBy("pos").limit(100)
    fetched = pages.filter("page_id % 3 > 0").groupBy("url").agg(F.min_by(html.title(F.col("html")), "page_id").alias("description"))
    return pasted.join(fetched, "url", "left").select("pos", "url", "description")


def search_top(spark, sf_dir):
    """The first 10 http results, titles and snippets cut."""
    rows = read(spark, sf_dir, "pages").filter(F.col("url").rlike("^https?://")).orderBy("page_id").limit(10)
    return rows.select("page_id", "url", F.substring(html.title(F.col("html")), 1, 200).alias("title"), F.substring(html.strip_html(F.col("html")), 1, 400).alias("snippet"))


def bookmark_walk(spark, sf_dir):
    """Bookmarks read page by page, newest first, up to the first page without an unknown one."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    last = pages.agg(F.max("page_id").alias("last"))
    walked = pages.crossJoin(F.broadcast(last)).withColumn("cursor", F.floor((F.col("last") - F.col("page_id")) / 25)).withColumn("unknown", F.col("page_id") % 40 > 20)
    stop = walked.groupBy("cursor").agg(F.max("unknown").alias("some")).filter("NOT some").agg(F.min("cursor").alias("stop"))
    return walked.crossJoin(F.broadcast(stop)).filter("unknown AND (stop IS NULL OR cursor < stop)").select("page_id", "cursor")


def fetch_domains(spark, sf_dir):
    """The 20 hosts with most kept pages that weren't tried: links before saves before imports before up votes, one row a page."""
    keyed = _keyed(spark, sf_dir).select(F.col("candidate_id").alias("id"), "url_key", "url")
    links, saves, imports = (keyed.filter(f"id % 5 = {k}") for k in range(3))
    votes = fb.latest_votes(view(spark, sf_dir, "feedback")).filter("value = 'up' AND section = 'curated'").select(F.col("candidate_id").alias("id")).distinct()
    kept = latest.merge_first_wins("url_key", links, saves, imports, keyed.join(votes, "id", "left_semi"))
    tried = kept.filter("id % 17 = 0").select(url.domain("url").alias("domain")).distinct()
    hosts = kept.select(url.domain("url").alias("domain")).filter("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return hosts.join(tried, "domain", "left_anti").orderBy(F.desc("n"), "domain").limit(20)


def cut_replies(spark, sf_dir):
    """Turns cut where a conversation's texts come to 2,000 characters, with a mark; later turns left out."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = read(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter("before < 2000")
    room = F.lit(2000) - F.col("before")
    cut = F.when(F.length("text") > room, F.concat(F.substring(F.col("text"), F.lit(1), room.cast("int")), F.lit("[…]"))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.md5(cut).alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        eligible_stories, choose_arm_draws, broad_picks, broad_picks_by_user, served_stories, same_story_groups, article_verdicts, story_lookup, title_order, newest_saves,
        stage_status, recent_arm_stats, reset_vectors, outbox_backfill, holds_to_archive, reply_scores, safe_urls, readable_gate, page_dates,
        translation_chunks, pasted_urls, search_top, bookmark_walk, fetch_domains, cut_replies,
    )
}

from feedloom.plans.feedback_queries import _ARMS, _VOTES  # noqa: E402
from feedloom.plans.ranking_queries import _EXEMPLARS, _PAIRS, _TASTE  # noqa: E402
from feedloom.plans.text_queries import _DOMAIN, _KEY, _TITLE, _strip  # noqa: E402


def _sql(rest: str) -> str:
    return with_views(rest, "candidates", "log", "feedback", "opens", "served").rstrip()


def _more(tables: str, rest: str) -> str:
    """The domain's tables, further ones, then the query."""
    return _sql("").rstrip() + ", " + tables + " " + rest


_KEYED = f"k AS (SELECT candidate_id, url, topic, source, {_KEY} AS url_key FROM candidates)"
_RANKED = f"""arms AS (SELECT topic, (rewards + 1) / (serves + 2) AS rate, row_number() OVER (ORDER BY topic) AS place,
    row_number() OVER (ORDER BY (rewards + 1) / (serves + 2) DESC, topic) AS best, count(*) OVER () AS arms FROM {_ARMS})"""
_SINCE = f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS"

ORACLE_SQL = {
    "eligible_stories": _more(_KEYED + """, l AS (SELECT url_key FROM k WHERE candidate_id % 11 = 0),
        o AS (SELECT url_key FROM k WHERE candidate_id % 13 = 0 OR candidate_id IN (SELECT candidate_id FROM feedback WHERE axis = 'saved' AND user_id % 50 = 0))""",
        """SELECT candidate_id, 'broad' AS section FROM k WHERE source = 'searxng' AND url_key NOT IN (FROM l) AND candidate_id NOT IN (SELECT candidate_id FROM served)
        UNION ALL SELECT candidate_id, 'curated' FROM k WHERE source <> 'searxng' AND url_key NOT IN (FROM l) AND url_key NOT IN (FROM o)
            AND candidate_id NOT IN (SELECT candidate_id FROM served WHERE section = 'curated')"""),
    "choose_arm_draws": _more(_RANKED, f"""SELECT event_id AS id, topic FROM (SELECT event_id, event_id * 7919 % 1000 / 1000 AS u, event_id * 104729 % 1009 / 1009 AS v FROM events)
        JOIN arms ON (u < {EPSILON} AND place = CAST(floor(v * arms) AS BIGINT) + 1) OR (u >= {EPSILON} AND best = 1)"""),
    "broad_picks": _more(_RANKED + _EXEMPLARS + f""", opts AS (SELECT c.candidate_id AS id, topic, rate, CASE WHEN c.candidate_id % 4 = 0 THEN 0.3 ELSE 0.0 END AS penalty,
            round({_TASTE}, 6) AS taste
            FROM candidates c JOIN arms USING (topic) WHERE c.source = 'searxng' AND c.candidate_id NOT IN (SELECT candidate_id FROM served)
                AND {_KEY.replace('url', 'c.url')} NOT IN (SELECT {_KEY} FROM candidates WHERE candidate_id % 11 = 0)),
        step AS (SELECT 0 AS slot, NULL::BIGINT AS id, []::BIGINT[] AS ids UNION ALL SELECT s.slot + 1, n.id, list_append(s.ids, n.id) FROM step s, LATERAL (
            SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY id DESC) AS r FROM opts WHERE NOT list_contains(s.ids, id))
            WHERE r <= 30 ORDER BY rate DESC, topic, taste - penalty DESC, id DESC LIMIT 1) n WHERE s.slot < {SLOTS})""",
        "SELECT slot::BIGINT - 1 AS slot, id AS candidate_id FROM step WHERE slot > 0"),
    "served_stories": _sql("SELECT DISTINCT candidate_id FROM served JOIN candidates USING (candidate_id) WHERE len(vector) = 64"),
    "same_story_groups": _sql("").rstrip() + _PAIRS + """, e AS (SELECT a AS x, b AS y FROM pairs WHERE (a + b) % 5 > 0 AND (a + b) % 3 > 0
            UNION SELECT b, a FROM pairs WHERE (a + b) % 5 > 0 AND (a + b) % 3 > 0),
        reach AS (SELECT x AS node, x AS r FROM e UNION SELECT reach.node, e.y FROM reach JOIN e ON e.x = reach.r),
        roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
        best AS (SELECT root, bool_or(node % 11 = 0) AS old, arg_max(node, (node % 13) * 1000000 - node) AS best FROM roots GROUP BY root)
        SELECT node AS candidate_id, root FROM roots JOIN best USING (root) WHERE node % 11 <> 0 AND (old OR node <> best)""",
    "article_verdicts": "SELECT page_id FROM pages WHERE page_id % 4 = 0 OR page_id % 3 > 0",
    "story_lookup": _more(_KEYED + """, s AS (SELECT candidate_id, arg_max(section, cycle * 1000 + rank) AS section, arg_max(rank, cycle * 1000 + rank) AS rank FROM served GROUP BY candidate_id)""",
        """SELECT k.candidate_id, s.section, s.rank, l.link_id, CASE WHEN k.candidate_id % 2 = 0 THEN 'de' WHEN k.candidate_id % 5 = 0 THEN 'en' ELSE 'original' END AS body
        FROM k LEFT JOIN s USING (candidate_id) LEFT JOIN (SELECT url_key, max(candidate_id) AS link_id FROM k WHERE candidate_id % 3 = 0 GROUP BY url_key) l USING (url_key)"""),
    "title_order": f"""SELECT page_id, lang, row_number() OVER (PARTITION BY lang ORDER BY lower(title), page_id) AS place FROM (
        SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)""",
    "newest_saves": _sql("SELECT id, user_id, candidate_id FROM feedback WHERE axis = 'saved' ORDER BY id DESC LIMIT 200"),
    "stage_status": """SELECT user_id AS run, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS failed, CASE WHEN count(s) > 0 THEN 'degraded' ELSE 'ok' END AS status
        FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'stage' || (event_id % 7) END AS s FROM events) GROUP BY user_id""",
    "recent_arm_stats": _sql(f"SELECT topic, serves, round(rewards, 4) AS rewards FROM {_ARMS}".replace("FROM feedback", f"FROM (SELECT * FROM feedback WHERE {_SINCE})").replace("FROM opens", f"FROM (SELECT * FROM opens WHERE {_SINCE})")),
    "reset_vectors": "SELECT vec_id, label % 2 <> 0 AS pending, CASE WHEN label % 2 = 0 THEN len(embedding) ELSE 0 END AS dimensions FROM embeddings",
    "outbox_backfill": _sql("""SELECT DISTINCT candidate_id, (SELECT max(id) FROM log) AS stamp FROM feedback WHERE axis = 'saved'
        AND candidate_id NOT IN (SELECT candidate_id FROM log WHERE event_type = 'error' AND user_id % 5 = 0)"""),
    "holds_to_archive": _more(_KEYED, "SELECT url_key, min(candidate_id) AS candidate_id FROM k WHERE candidate_id % 4 = 1 AND url_key NOT IN (SELECT url_key FROM k WHERE candidate_id % 6 = 1) GROUP BY url_key"),
    "reply_scores": """SELECT conv_id, turn, unnest([turn, 99])::BIGINT AS id, unnest([0.5, turn % 2])::DOUBLE AS score FROM conversations WHERE NOT contains(text, '[') AND NOT contains(text, ']')""",
    "safe_urls": """SELECT page_id, CASE WHEN page_id % 5 = 1 THEN 'https://i.org/pic' || page_id || '.png' WHEN page_id % 5 > 1 AND regexp_matches(url, '(?i)^https?://[^\\s/]+\\S*$')
        THEN regexp_replace(url, '-[0-9]{2,4}x[0-9]{2,4}(\\.[A-Za-z]{3,4})$', '\\1') END AS safe FROM pages""",
    "readable_gate": "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://') AND page_id % 9 <> 0",
    "page_dates": """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN make_date(2023, page_id % 12 + 1, page_id % 28 + 1)
        WHEN regexp_matches(url, '/20[0-9]{2}[/-][01]?[0-9][/-][0-3]?[0-9](/|-|$)') THEN NULL END AS published FROM pages""",
    "translation_chunks": r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
            SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents)),
        f AS (SELECT doc_id, i, 0 AS chunk, length(line)::BIGINT AS held FROM l WHERE i = 1
            UNION ALL SELECT l.doc_id, l.i, CASE WHEN held + length(line) > 3000 THEN chunk + 1 ELSE chunk END, CASE WHEN held + length(line) > 3000 THEN length(line) ELSE held + length(line) END
            FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
        SELECT doc_id, chunk, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM f JOIN l USING (doc_id, i) GROUP BY doc_id, chunk""",
    "pasted_urls": f"""SELECT pos, url, d.description FROM (SELECT url, min(page_id) AS pos FROM pages GROUP BY url ORDER BY pos LIMIT 100) LEFT JOIN (
        SELECT url, arg_min(t, page_id) AS description FROM (SELECT url, page_id, {_TITLE} AS t FROM pages WHERE page_id % 3 > 0) GROUP BY url) d USING (url)""",
    "search_top": f"""SELECT page_id, url, substring({_TITLE}, 1, 200) AS title, substring({_strip('html')}, 1, 400) AS snippet FROM pages WHERE regexp_matches(url, '^https?://') ORDER BY page_id LIMIT 10""",
    "bookmark_walk": """WITH w AS (SELECT page_id, CAST(floor(((SELECT max(page_id) FROM pages) - page_id) / 25) AS BIGINT) AS cursor, page_id % 40 > 20 AS unknown FROM pages)
        SELECT page_id, cursor FROM w WHERE unknown AND cursor < coalesce((SELECT min(cursor) FROM (SELECT cursor FROM w GROUP BY cursor HAVING NOT bool_or(unknown))), 1000000000000)""",
    "fetch_domains": _more(_KEYED + f""", p AS (SELECT candidate_id AS id, url, url_key, CASE WHEN candidate_id % 5 < 3 THEN candidate_id % 5 ELSE 3 END AS prio FROM k
            WHERE candidate_id % 5 < 3 OR candidate_id IN (SELECT candidate_id FROM {_VOTES} WHERE value = 'up' AND section = 'curated')),
        kept AS (SELECT id, {_DOMAIN} AS domain FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY prio, id) AS r FROM p) WHERE r = 1)""",
        """SELECT domain, count(*) AS n FROM kept GROUP BY domain HAVING count(*) >= 2 AND domain <> '' AND domain NOT IN (SELECT domain FROM kept WHERE id % 17 = 0)
        ORDER BY n DESC, domain LIMIT 20"""),
    "cut_replies": """SELECT conv_id, turn, md5(CASE WHEN length(text) > 2000 - b THEN substring(text, 1, 2000 - b) || '[…]' ELSE text END) AS text_md5 FROM (
        SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM conversations) WHERE b < 2000""",
}
