"""Queries of cards, tags, section moves, marks, queues and page metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html, text, url
from feedloom.operators import latest, state
from feedloom.operators.feedback import latest_votes
from feedloom.sources.domain import read, view, with_views

LATER = "2024-01-30 12:00:00"


def page_meta(spark, sf_dir):
    """Description and image of pages: the page's own head with tags of several kinds put in."""
    og = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="og:description" content="og '), "url", F.lit('">'))).otherwise(F.lit(""))
    plain = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit('<meta name="description" content="'), "url", F.lit('">'))).otherwise(F.lit(""))
    image = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit('<img alt="" src="https://img/'), F.col("page_id").cast("string"), F.lit('.png">'))).otherwise(F.lit('<img src="/x">'))
    page = F.concat(og, plain, image, F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", html.meta(page, "og:description", "description").alias("description"), html.first_image(page).alias("image"))


def card_age(spark, sf_dir):
    return view(spark, sf_dir, "log").select("id", state.age_label(F.col("created_at"), F.lit(LATER).cast("timestamp_ntz")).alias("age"))


def card_flags(spark, sf_dir):
    """Served cards with their saves, opens in the section they were served in, and latest vote."""
    log = view(spark, sf_dir, "feedback")
    saved = log.filter("axis = 'saved'").select("candidate_id").distinct().withColumn("saved", F.lit(True))
    opened = view(spark, sf_dir, "opens").select("candidate_id", "section").distinct().withColumn("opened", F.lit(True))
    vote = latest.latest_by(log.filter("axis = 'interest'"), ["candidate_id"]).select("candidate_id", F.col("value").alias("vote"))
    cards = view(spark, sf_dir, "served").join(saved, "candidate_id", "left").join(opened, ["candidate_id", "section"], "left").join(vote, "candidate_id", "left")
    return cards.select("candidate_id", "section", F.coalesce("saved", F.lit(False)).alias("saved"), F.coalesce("opened", F.lit(False)).alias("opened"), "vote")


def own_text(spark, sf_dir):
    """Documents' lines without those that three documents share; short ones give way to the site's name; null below three words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.array_distinct(F.split("text", "\n"))).alias("pos", "line"))
    shared = docs.filter("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("line")
    own = docs.join(shared, "line", "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    body = text.one_line(F.array_join(F.transform("x", lambda s: s["line"]), " "))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(own, "doc_id", "left").select("doc_id", "source", body.alias("body"))
    filled = F.when(F.length("body") < 400, F.concat(F.col("body"), F.lit(" "), "source")).otherwise(F.col("body"))
    filled = F.trim(filled)
    return rows.select("doc_id", F.when(text.word_count(filled) >= 3, F.md5(filled)).alias("own_md5"))


def facet_tags(spark, sf_dir):
    facets = latest.latest_by(view(spark, sf_dir, "feedback").filter("axis <> 'saved'"), ["candidate_id", "axis"])
    rows = facets.groupBy("candidate_id").pivot("axis", ["interest", "mood"]).agg(F.first("value"))
    tags = F.array(F.lit("news"), F.lit("interest:low"), F.lit("mood:sad"), F.lit("x"))
    return rows.select("candidate_id", F.array_join(state.facet_tags(tags, F.col("interest"), F.col("mood")), ",").alias("tags"))


def valid_ratings(spark, sf_dir):
    rated = view(spark, sf_dir, "log").select("id", "candidate_id", ((F.col("id") % 7 - 3) / 2).alias("rating"))
    return state.valid_ratings(rated)


def section_moves(spark, sf_dir):
    names = F.array(*map(F.lit, ("save", "promote", "explore", "archive", "unsave")))
    return state.sections(view(spark, sf_dir, "log").select("candidate_id", "id", F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("command")))


def push_saves(spark, sf_dir):
    """Local saves: linked where the page is mirrored, by its first link, else to be created."""
    keyed = view(spark, sf_dir, "candidates").select("candidate_id", url.norm_url("url").alias("url_key"))
    links = keyed.filter("candidate_id % 3 = 0").groupBy("url_key").agg(F.min("candidate_id").alias("link_id"))
    saves = keyed.filter("candidate_id % 2 = 0").join(links, "url_key", "left")
    return saves.select("candidate_id", "link_id", F.when(F.col("link_id").isNull(), "create").otherwise("link").alias("action"))


def marks_store(spark, sf_dir):
    marks = read(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("text_id"), F.col("event_id").alias("id"), "event_type", F.floor("value").alias("start"), F.floor(F.col("value") * (F.col("event_id") % 4)).alias("end"))
    out = state.replace_marks(marks.filter("event_type <> 'purchase' AND end > start"), marks.filter("event_type = 'purchase'"), ["text_id"])
    return out.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


def settled_queue(spark, sf_dir):
    queue = view(spark, sf_dir, "log").groupBy(F.col("candidate_id").alias("key")).agg(F.count(F.lit(1)).alias("version"))
    answers = queue.select("key", (F.col("version") - F.col("key") % 2).alias("version")).filter("key % 3 > 0")
    return state.answered(queue, answers)


def backfilled_saves(spark, sf_dir):
    """Saves made up from saved events: the candidate's address where it is known, else one from the key."""
    saved = view(spark, sf_dir, "feedback").filter("axis = 'saved'").groupBy("candidate_id").agg(F.min("id").alias("id"))
    known = view(spark, sf_dir, "candidates").filter("candidate_id % 4 > 0").select("candidate_id", "url")
    rows = saved.join(known, "candidate_id", "left").filter("candidate_id % 5 > 0")
    return rows.select("candidate_id", "id", F.coalesce("url", F.concat(F.lit("https://key-"), F.col("candidate_id").cast("string"))).alias("url"))


def unchecked_pages(spark, sf_dir):
    """Up-voted candidates whose page hasn't been checked."""
    votes = latest_votes(view(spark, sf_dir, "feedback")).filter("value = 'up'").select("candidate_id").distinct()
    checked = view(spark, sf_dir, "served").select("candidate_id")
    return votes.join(checked, "candidate_id", "left_anti")


def subscription_status(spark, sf_dir):
    """Domains' latest outcome: the newest attempt replaces what was recorded."""
    pages = read(spark, sf_dir, "pages").select(url.domain("url").alias("domain"), F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, "no_feed").otherwise("subscribed").alias("status"))
    old = latest.latest_by(pages.filter("id % 2 = 0"), ["domain"]).select("domain", "id", "status")
    return latest.insert_or_replace(old, pages.filter("id % 2 = 1"), "domain")


QUERIES = {
    f.__name__: f
    for f in (
        page_meta, card_age, card_flags, own_text, facet_tags, valid_ratings, section_moves, push_saves, marks_store, settled_queue,
        backfilled_saves, unchecked_pages, subscription_status,
    )
}

from feedloom.plans.text_queries import _DOMAIN, _KEY  # noqa: E402


def _sql(rest: str) -> str:
    return with_views(rest, "candidates", "log", "feedback", "opens", "served")


_LATEST = "(SELECT candidate_id, arg_max(value, id) FILTER (axis = 'interest') AS interest, arg_max(value, id) FILTER (axis = 'mood') AS mood FROM feedback WHERE axis <> 'saved' GROUP BY candidate_id)"

ORACLE_SQL = {
    "page_meta": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'og ' || url WHEN page_id % 3 > 0 THEN url END AS description,
        CASE WHEN page_id % 5 > 0 THEN 'https://img/' || page_id || '.png' END AS image FROM pages""",
    "card_age": _sql(f"""SELECT id, CASE WHEN m < 0 THEN strftime(created_at, '%d.%m.') WHEN m < 60 THEN greatest(m, 1) || ' min' WHEN m < 1440 THEN m // 60 || ' h' WHEN m < 10080 THEN m // 1440 || ' d'
        ELSE strftime(created_at, '%d.%m.') END AS age FROM (
        SELECT *, CAST(floor((epoch_us(TIMESTAMP '{LATER}') - epoch_us(created_at)) / 60000000) AS BIGINT) AS m FROM log)"""),
    "card_flags": _sql("""SELECT candidate_id, section, candidate_id IN (SELECT candidate_id FROM feedback WHERE axis = 'saved') AS saved,
        EXISTS (SELECT 1 FROM opens o WHERE o.candidate_id = s.candidate_id AND o.section = s.section) AS opened,
        (SELECT arg_max(value, id) FROM feedback f WHERE f.axis = 'interest' AND f.candidate_id = s.candidate_id) AS vote FROM served s"""),
    "own_text": r"""WITH l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (
            SELECT doc_id, source, list_distinct_ordered AS ls FROM (SELECT doc_id, source,
                list_filter(string_split(text, chr(10)), lambda x, i: list_position(string_split(text, chr(10)), x) = i) AS list_distinct_ordered FROM documents))),
        shared AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 3),
        b AS (SELECT d.doc_id, d.source, trim(regexp_replace(coalesce(string_agg(l.line, ' ' ORDER BY l.pos), ''), '\s+', ' ', 'g')) AS body
            FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id AND l.line NOT IN (SELECT line FROM shared) GROUP BY ALL),
        f AS (SELECT doc_id, trim(CASE WHEN length(body) < 400 THEN body || ' ' || source ELSE body END) AS t FROM b)
        SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\S+')) >= 3 THEN md5(t) END AS own_md5 FROM f""",
    "facet_tags": _sql(f"""SELECT candidate_id, array_to_string(list_concat(list_filter(['news', 'interest:low', 'mood:sad', 'x'],
        lambda t: NOT (starts_with(t, 'interest:') AND interest IS NOT NULL) AND NOT (starts_with(t, 'mood:') AND mood IS NOT NULL)),
        list_filter([CASE interest WHEN 'up' THEN 'interest:high' WHEN 'down' THEN 'interest:low' END, CASE mood WHEN 'happy' THEN 'mood:happy' WHEN 'sad' THEN 'mood:sad' END],
        lambda t: t IS NOT NULL)), ',') AS tags FROM {_LATEST}"""),
    "valid_ratings": _sql("""SELECT min(id) AS id, candidate_id, (id % 7 - 3) / 2 AS rating FROM log WHERE (id % 7 - 3) / 2 BETWEEN -1 AND 1 GROUP BY 2, 3"""),
    "section_moves": _sql("""SELECT candidate_id, coalesce(arg_max(section, id) FILTER (section IS NOT NULL), 'curated') AS section, arg_max(id % 5, id) <> 4 AS saved,
        CAST(count(*) FILTER (section IS NOT NULL AND section <> before) AS INTEGER) AS moves FROM (
        SELECT candidate_id, id, section, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'curated') AS before
        FROM (SELECT candidate_id, id, CASE id % 5 WHEN 1 THEN 'curated' WHEN 2 THEN 'broad' WHEN 3 THEN 'archive' END AS section FROM log)) GROUP BY candidate_id"""),
    "push_saves": _sql(f"""SELECT s.candidate_id, l.link_id, CASE WHEN l.link_id IS NULL THEN 'create' ELSE 'link' END AS action
        FROM (SELECT candidate_id, {_KEY} AS k FROM candidates WHERE candidate_id % 2 = 0) s
        LEFT JOIN (SELECT {_KEY} AS k, min(candidate_id) AS link_id FROM candidates WHERE candidate_id % 3 = 0 GROUP BY 1) l USING (k)"""),
    "marks_store": """WITH m AS (SELECT event_id % 997 AS text_id, event_id AS id, event_type = 'purchase' AS fresh, CAST(floor(value) AS BIGINT) AS s, CAST(floor(value * (event_id % 4)) AS BIGINT) AS e FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY s, id) AS r FROM m WHERE fresh AND e > s)
        SELECT text_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts FROM (
            SELECT text_id, s FROM m WHERE NOT fresh AND e > s AND text_id NOT IN (SELECT text_id FROM m WHERE fresh)
            UNION ALL SELECT text_id, s FROM n WHERE r <= 500) GROUP BY text_id""",
    "settled_queue": _sql("SELECT candidate_id AS key, count(*) AS version FROM log GROUP BY candidate_id HAVING NOT (candidate_id % 3 > 0 AND candidate_id % 2 = 0)"),
    "backfilled_saves": _sql("""SELECT f.candidate_id, min(f.id) AS id, coalesce(any_value(c.url), 'https://key-' || f.candidate_id) AS url
        FROM feedback f LEFT JOIN candidates c ON c.candidate_id = f.candidate_id AND c.candidate_id % 4 > 0 WHERE axis = 'saved' AND f.candidate_id % 5 > 0 GROUP BY f.candidate_id"""),
    "unchecked_pages": _sql("""SELECT DISTINCT candidate_id FROM (SELECT user_id, candidate_id, arg_max(value, id) AS v FROM feedback WHERE axis = 'interest' GROUP BY ALL)
        WHERE v = 'up' AND candidate_id NOT IN (SELECT candidate_id FROM served)"""),
    "subscription_status": f"""WITH p AS (SELECT {_DOMAIN} AS domain, page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'no_feed' ELSE 'subscribed' END AS status FROM pages)
        SELECT domain, arg_max(id, r) AS id, arg_max(status, r) AS status FROM (
            SELECT *, id + CASE WHEN id % 2 = 1 THEN 1000000 ELSE 0 END AS r FROM p) GROUP BY domain""",
}
