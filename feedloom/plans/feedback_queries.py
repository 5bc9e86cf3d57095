"""Queries of the feedback log: votes, weights, arms, penalties, facets, snapshots, outbox, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedloom.functions import html, url
from feedloom.functions.decay import penalty_now
from feedloom.operators import feedback as fb
from feedloom.operators import latest, similarity
from feedloom.plans.ranking_queries import _candidates, _centroids
from feedloom.sources.domain import AS_OF, read, view, with_views


def _feedback(spark, sf_dir):
    return view(spark, sf_dir, "feedback")


def latest_vote(spark, sf_dir):
    return fb.latest_votes(_feedback(spark, sf_dir)).select("user_id", "candidate_id", "id", "value", "section")


def latest_then_section(spark, sf_dir):
    """Latest votes that are curated ones: a later vote elsewhere hides an earlier curated one."""
    return fb.latest_votes(_feedback(spark, sf_dir)).filter("section = 'curated'").select("user_id", "candidate_id", "value")


def latest_facets(spark, sf_dir):
    rows = latest.latest_by(_feedback(spark, sf_dir), ["candidate_id", "axis"])
    return rows.groupBy("candidate_id").pivot("axis", ["interest", "mood", "saved"]).agg(F.first("value"))


def facet_query(spark, sf_dir):
    return fb.facet_query(_feedback(spark, sf_dir), "interest", "up", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("candidate_id", "id")


def signal_set(spark, sf_dir):
    rows = fb.signals(_feedback(spark, sf_dir), view(spark, sf_dir, "opens"), view(spark, sf_dir, "ratings"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("base"), 4).alias("total"))


def centroid_weights(spark, sf_dir):
    near = similarity.assign(_candidates(spark, sf_dir), _centroids(spark, sf_dir), 0.2).select("candidate_id", "centroid")
    signalled = fb.signals(_feedback(spark, sf_dir), view(spark, sf_dir, "opens"), view(spark, sf_dir, "ratings"))
    weights = fb.centroid_weights(signalled, near, _centroids(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"))
    return weights.select("centroid", F.round("weight", 4).alias("weight"))


def _stats(spark, sf_dir):
    topics = _candidates(spark, sf_dir).select("candidate_id", "topic")
    served = view(spark, sf_dir, "served").join(topics, "candidate_id")
    return fb.arm_stats(served, _feedback(spark, sf_dir), view(spark, sf_dir, "opens"))


def arm_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("topic", "serves", F.round("rewards", 4).alias("rewards"))


def choose_arm_greedy(spark, sf_dir):
    return fb.greedy_arms(_stats(spark, sf_dir)).orderBy(F.desc("rate"), "topic").limit(1).select("topic", F.round("rate", 5).alias("rate"))


def broad_picks_greedy(spark, sf_dir):
    """Eight exploring slots without chance: the best arm's newest candidates first, then the next arm's."""
    arms = fb.greedy_arms(_stats(spark, sf_dir)).select("topic", "rate")
    material = _candidates(spark, sf_dir).filter("source = 'searxng'").join(view(spark, sf_dir, "served").select("candidate_id"), "candidate_id", "left_anti")
    picks = material.join(arms, "topic").orderBy(F.desc("rate"), "topic", F.desc("candidate_id")).limit(8)
    return picks.select("candidate_id", "topic")


def _failures(spark, sf_dir):
    bad = read(spark, sf_dir, "labels").filter("quality = 0")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"), (F.col("doc_id") % 30).alias("day"))
    return docs.join(bad, "doc_id").select("site", "day")


def site_penalty_fold(spark, sf_dir):
    rows = fb.site_penalties(_failures(spark, sf_dir))
    return rows.select("site", F.round("penalty", 4).alias("penalty"), "last_failure")


def penalty_today(spark, sf_dir):
    rows = fb.site_penalties(_failures(spark, sf_dir)).withColumn("p", F.round(penalty_now(F.col("penalty"), 29 - F.col("last_failure")), 4))
    return rows.filter("p > 0").select("site", "p")


def served_section(spark, sf_dir):
    return fb.served_section(view(spark, sf_dir, "served"))


def detect_saved(spark, sf_dir):
    keyed = view(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("id"), url.norm_url("url").alias("url_key"))
    served = view(spark, sf_dir, "served").select(F.col("candidate_id").alias("id")).join(keyed, "id")
    return fb.detect_saved(keyed.filter("id % 2 = 0"), served, keyed.filter("id % 5 = 0"), keyed.filter("id % 9 = 0"))


def kept_pages(spark, sf_dir):
    """Links before saves before up votes: of a page identity the first source that has it."""
    keyed = view(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("id"), url.norm_url("url").alias("url_key"))
    links = keyed.filter("id % 3 = 0").withColumn("origin", F.lit("link"))
    saves = keyed.filter("id % 3 = 1").withColumn("origin", F.lit("save"))
    votes = fb.latest_votes(_feedback(spark, sf_dir)).filter("value = 'up' AND section = 'curated'").select(F.col("candidate_id").alias("id")).distinct()
    votes = votes.join(keyed, "id").withColumn("origin", F.lit("vote")).select("id", "url_key", "origin")
    return latest.merge_first_wins("url_key", links, saves, votes)


def signals_report(spark, sf_dir):
    """Requested candidates in their order, with saves, opens and the latest vote; unknown ones left out."""
    asked = view(spark, sf_dir, "candidates").filter("candidate_id % 6 = 0").select("candidate_id", (F.col("candidate_id") * 7 % 200).alias("pos"))
    log = _feedback(spark, sf_dir)
    saved = log.filter("axis = 'saved'").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("saves"))
    vote = latest.latest_by(log.filter("axis = 'interest'"), ["candidate_id"]).select("candidate_id", F.col("value").alias("interest"))
    opened = view(spark, sf_dir, "opens").select("candidate_id").distinct().withColumn("opened", F.lit(True))
    out = asked.join(saved, "candidate_id", "left").join(vote, "candidate_id", "left").join(opened, "candidate_id", "left")
    return out.select("pos", "candidate_id", F.coalesce("saves", F.lit(0)).alias("saves"), "interest", F.coalesce("opened", F.lit(False)).alias("opened"))


def prune(spark, sf_dir):
    """Feedback whose candidate is fresh or in the current cycle."""
    seen = view(spark, sf_dir, "log").groupBy("candidate_id").agg(F.min("created_at").alias("fetched_at"))
    current = view(spark, sf_dir, "served").filter("cycle = 2").select("candidate_id")
    kept = seen.filter(F.col("fetched_at") >= F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).select("candidate_id").unionByName(current).distinct()
    return latest.cascade(_feedback(spark, sf_dir), kept, "candidate_id").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))


def _links(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("name"), html.language(F.col("html")).alias("lang"))
    return pages.filter("page_id % 4 <> 3").withColumn("embedded", F.col("page_id") % 2 == 0), pages.filter("page_id % 3 = 0").withColumn(
        "name", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("new "), "name")).when(F.col("page_id") % 5 != 0, F.col("name"))
    )


def upsert_links(spark, sf_dir):
    old, new = _links(spark, sf_dir)
    return latest.upsert(old, new, "page_id", ["name", "lang"], "embedded")


def insert_or_ignore(spark, sf_dir):
    """Opens: one per candidate, the first of them."""
    opens = view(spark, sf_dir, "opens").select("id", "candidate_id", "user_id")
    return latest.insert_or_ignore(latest.first_by(opens.filter("id % 2 = 0"), ["candidate_id"], "id"), opens.filter("id % 2 = 1"), "candidate_id")


def insert_or_replace(spark, sf_dir):
    opens = view(spark, sf_dir, "opens").select("id", "candidate_id", "user_id")
    return latest.insert_or_replace(latest.latest_by(opens.filter("id % 2 = 0"), ["candidate_id"]).select("id", "candidate_id", "user_id"), opens.filter("id % 2 = 1"), "candidate_id")


def outbox_coalesce(spark, sf_dir):
    commands = view(spark, sf_dir, "log").select(
        F.col("candidate_id").alias("key"), "id", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("p"), F.col("id").cast("string"))).alias("payload"),
    )
    return fb.coalesce_outbox(commands)


def retry_backoff(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, (200, 404, 429, 503, 0))), (F.col("event_id") % 5 + 1).cast("int")).alias("status"), (F.col("event_id") % 8).alias("attempts"))
    return rows.select("event_id", fb.retry_delay(F.col("status"), F.col("attempts")).alias("delay"))


def due_queue(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "value").orderBy("value", "event_id").limit(50)


def debounce_sessions(spark, sf_dir):
    """Changes of a user at most ten minutes apart, as one: due ten minutes after the last."""
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return rows.select("user_id", F.unix_micros(F.col("w.end")).alias("due_us"), "changes")


def strictly_increasing_stamp(spark, sf_dir):
    """Stamps in whole seconds, each a second above the one before it where time has not moved on."""
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("now"), F.row_number().over(w).alias("n"))
    peak = F.max(F.col("now") - F.col("n")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("event_id", (peak + F.col("n")).alias("stamp"))


def feed_json(spark, sf_dir):
    """The items of the newest cycle, each as one JSON object with its place in its section; curated ones are shown before broad ones."""
    served, newest = view(spark, sf_dir, "served"), view(spark, sf_dir, "served").agg(F.max("cycle").alias("cycle"))
    items = served.join(F.broadcast(newest), "cycle").join(view(spark, sf_dir, "candidates").select("candidate_id", "url", "html"), "candidate_id")
    w = W.partitionBy("section").orderBy("rank", "candidate_id")
    items = items.withColumn("place", F.row_number().over(w).cast("long")).withColumn("title", html.title(F.col("html")))
    items = items.withColumn("icon", F.concat(F.lit("https://"), url.domain("url"), F.lit("/favicon.ico")))
    return items.select("section", "place", F.to_json(F.struct("candidate_id", "section", "url", "title", "icon")).alias("item"))


def digest(spark, sf_dir):
    items = view(spark, sf_dir, "served").join(view(spark, sf_dir, "candidates").select("candidate_id", "html"), "candidate_id")
    line = F.concat((F.col("rank") + 1).cast("string"), F.lit(". ["), html.title(F.col("html")), F.lit("] "), F.col("source"))
    return items.select("section", "rank", "candidate_id", line.alias("line"))


def union_keys(spark, sf_dir):
    keyed = view(spark, sf_dir, "candidates").select("candidate_id", url.norm_url("url").alias("url_key"))
    return keyed.filter("candidate_id % 2 = 0").select("url_key").union(keyed.filter("candidate_id % 3 = 0").select("url_key")).distinct()


def archive_difference(spark, sf_dir):
    keyed = view(spark, sf_dir, "candidates").select("candidate_id", url.norm_url("url").alias("url_key"))
    return keyed.filter("candidate_id % 2 = 0").select("url_key").subtract(keyed.filter("candidate_id % 3 = 0").select("url_key"))


def benchmark_stats(spark, sf_dir):
    """Mean, median, the value nine tenths up, and the largest, per event type and user; the nine tenths by place, none is held as a list."""
    keys = ["event_type", "user_id"]
    events = read(spark, sf_dir, "events").select(*keys, "value")
    placed = events.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("value")))
    counts = events.groupBy(*keys).agg((F.floor(0.9 * (F.count(F.lit(1)) - 1)) + 1).alias("place"))
    tenth = placed.join(counts, [*keys, "place"]).select(*keys, F.col("value").alias("p90"))
    rows = events.groupBy(*keys).agg(F.round(F.avg("value"), 7).alias("mean"), F.median("value").alias("median"), F.max("value").alias("most"))
    return rows.join(tenth, keys).select("event_type", "user_id", "p90", "mean", F.round("median", 4).alias("median"), "most")


QUERIES = {
    f.__name__: f
    for f in (
        latest_vote, latest_then_section, latest_facets, facet_query, signal_set, centroid_weights, arm_stats, choose_arm_greedy, broad_picks_greedy,
        site_penalty_fold, penalty_today, served_section, detect_saved, kept_pages, signals_report, prune, upsert_links, insert_or_ignore,
        insert_or_replace, outbox_coalesce, retry_backoff, due_queue, debounce_sessions, strictly_increasing_stamp, feed_json, digest, union_keys,
        archive_difference, benchmark_stats,
    )
}


def _sql(rest: str, *names: str) -> str:
    return with_views(rest, "candidates", "log", "feedback", *names)


from feedloom.plans import ranking_queries as _rank  # noqa: E402
from feedloom.plans.text_queries import _DOMAIN, _KEY, _TITLE  # noqa: E402

_VOTES = """(SELECT user_id, candidate_id, max(id) AS id, arg_max(value, id) AS value, arg_max(section, id) AS section, arg_max(created_at, id) AS created_at
    FROM feedback WHERE axis = 'interest' GROUP BY user_id, candidate_id)"""
_SIGNALS = f"""(SELECT user_id, candidate_id, 1.0::DOUBLE AS base, created_at FROM feedback WHERE axis = 'saved' AND section = 'curated'
    UNION ALL SELECT user_id, candidate_id, CASE value WHEN 'up' THEN 1.0 ELSE -1.0 END, created_at FROM {_VOTES} WHERE section = 'curated'
    UNION ALL SELECT user_id, candidate_id, 0.1, created_at FROM opens o WHERE section = 'curated' AND NOT EXISTS (
        SELECT 1 FROM feedback f WHERE f.user_id = o.user_id AND f.candidate_id = o.candidate_id AND f.axis IN ('saved', 'interest'))
    UNION ALL SELECT user_id, candidate_id, CASE rating WHEN 1 THEN 2.0 WHEN 0.5 THEN 1.0 WHEN 0 THEN 0.0 WHEN -0.5 THEN -1.0 ELSE -2.0 END, created_at FROM ratings)"""
_ARMS = """(SELECT topic, sum(n)::BIGINT AS serves, sum(reward)::DOUBLE AS rewards FROM (SELECT c.topic, s.candidate_id, count(*) AS n, max(CASE
        WHEN s.candidate_id IN (SELECT candidate_id FROM feedback WHERE axis = 'saved')
          OR (SELECT arg_max(value, id) FROM feedback f WHERE f.axis = 'interest' AND f.candidate_id = s.candidate_id) = 'up' THEN 1.0
        WHEN s.candidate_id IN (SELECT candidate_id FROM opens WHERE section = 'broad')
          AND s.candidate_id NOT IN (SELECT candidate_id FROM feedback WHERE axis IN ('saved', 'interest')) THEN 0.1 ELSE 0.0 END) AS reward
    FROM served s JOIN candidates c ON c.candidate_id = s.candidate_id WHERE s.section = 'broad' GROUP BY c.topic, s.candidate_id) GROUP BY topic)"""
_FAILED = """WITH RECURSIVE f AS (SELECT source AS site, doc_id % 30 AS day, row_number() OVER (PARTITION BY source ORDER BY doc_id % 30) AS n
        FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
    fold AS (SELECT site, day, n, 0.2::DOUBLE AS p FROM f WHERE n = 1
        UNION ALL SELECT f.site, f.day, f.n, CASE WHEN greatest(0, p - 0.2 * (f.day - fold.day)) = 0 THEN 0.2 ELSE greatest(0, p - 0.2 * (f.day - fold.day)) + 0.1 END
        FROM fold JOIN f ON f.site = fold.site AND f.n = fold.n + 1),
    last AS (SELECT site, arg_max(p, n) AS penalty, max(day) AS last_failure FROM fold GROUP BY site)"""
_KEYED = f"(SELECT candidate_id AS id, {_KEY} AS url_key FROM candidates)"
_LINKS = f"""WITH p AS (SELECT page_id, {_TITLE} AS name, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages),
    o AS (SELECT page_id, name, lang, page_id % 2 = 0 AS embedded FROM p WHERE page_id % 4 <> 3),
    n AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new ' || name WHEN page_id % 5 <> 0 THEN name END AS name, lang FROM p WHERE page_id % 3 = 0)"""

ORACLE_SQL = {
    "latest_vote": _sql(f"SELECT user_id, candidate_id, id, value, section FROM {_VOTES}"),
    "latest_then_section": _sql(f"SELECT user_id, candidate_id, value FROM {_VOTES} WHERE section = 'curated'"),
    "latest_facets": _sql("""SELECT candidate_id, arg_max(value, id) FILTER (axis = 'interest') AS interest, arg_max(value, id) FILTER (axis = 'mood') AS mood,
        arg_max(value, id) FILTER (axis = 'saved') AS saved FROM feedback GROUP BY candidate_id"""),
    "facet_query": _sql("""SELECT candidate_id, max(id) AS id FROM feedback WHERE axis = 'interest' GROUP BY candidate_id
        HAVING arg_max(value, id) = 'up' AND arg_max(created_at, id) >= TIMESTAMP '2024-01-20'"""),
    "signal_set": _sql(f"SELECT user_id, count(*) AS n, round(sum(base), 4) AS total FROM {_SIGNALS} GROUP BY user_id", "opens", "ratings"),
    "centroid_weights": _sql("SELECT 1", "opens", "ratings").removesuffix("SELECT 1").rstrip() + _rank._MET + f""", near AS (SELECT candidate_id, centroid FROM (
        SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sim DESC, centroid) AS n FROM met) WHERE n = 1 AND sim >= 0.2)
        SELECT centroid, round(greatest(0.25, 1 + coalesce(sum(base * pow(0.5, greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400e6 / 30)), 0)), 4) AS weight
        FROM centroids LEFT JOIN near USING (centroid) LEFT JOIN {_SIGNALS} USING (candidate_id) GROUP BY centroid""",
    "arm_stats": _sql(f"SELECT topic, serves, round(rewards, 4) AS rewards FROM {_ARMS}", "opens", "served"),
    "choose_arm_greedy": _sql(f"SELECT topic, round((rewards + 1) / (serves + 2), 5) AS rate FROM {_ARMS} ORDER BY (rewards + 1) / (serves + 2) DESC, topic LIMIT 1", "opens", "served"),
    "broad_picks_greedy": _sql(f"""SELECT candidate_id, topic FROM candidates JOIN {_ARMS} USING (topic) WHERE source = 'searxng'
        AND candidate_id NOT IN (SELECT candidate_id FROM served) ORDER BY (rewards + 1) / (serves + 2) DESC, topic, candidate_id DESC LIMIT 8""", "opens", "served"),
    "site_penalty_fold": _FAILED + " SELECT site, round(penalty, 4) AS penalty, last_failure FROM last",
    "penalty_today": _FAILED + " SELECT site, round(greatest(0, penalty - 0.2 * (29 - last_failure)), 4) AS p FROM last WHERE round(greatest(0, penalty - 0.2 * (29 - last_failure)), 4) > 0",
    "served_section": _sql("SELECT candidate_id, arg_max(section, cycle * 2 + CASE WHEN section <> 'broad' THEN 1 ELSE 0 END) AS section FROM served GROUP BY candidate_id", "served"),
    "detect_saved": _sql(f"""SELECT url_key, min(id) AS id FROM {_KEYED} k WHERE id % 2 = 0
        AND url_key IN (SELECT url_key FROM {_KEYED} WHERE id IN (SELECT candidate_id FROM served))
        AND url_key NOT IN (SELECT url_key FROM {_KEYED} WHERE id % 5 = 0) AND url_key NOT IN (SELECT url_key FROM {_KEYED} WHERE id % 9 = 0) GROUP BY url_key""", "served"),
    "kept_pages": _sql(f"""SELECT id, url_key, origin FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY prio, id) AS n FROM (
        SELECT id, url_key, 'link' AS origin, 0 AS prio FROM {_KEYED} WHERE id % 3 = 0 UNION ALL SELECT id, url_key, 'save', 1 FROM {_KEYED} WHERE id % 3 = 1
        UNION ALL SELECT id, url_key, 'vote', 2 FROM {_KEYED} WHERE id IN (SELECT candidate_id FROM {_VOTES} WHERE value = 'up' AND section = 'curated'))) WHERE n = 1"""),
    "signals_report": _sql("""SELECT candidate_id * 7 % 200 AS pos, candidate_id,
        (SELECT count(*) FROM feedback f WHERE f.axis = 'saved' AND f.candidate_id = c.candidate_id) AS saves,
        (SELECT arg_max(value, id) FROM feedback f WHERE f.axis = 'interest' AND f.candidate_id = c.candidate_id) AS interest,
        candidate_id IN (SELECT candidate_id FROM opens) AS opened FROM candidates c WHERE candidate_id % 6 = 0""", "opens"),
    "prune": _sql("""SELECT candidate_id, count(*) AS n FROM feedback WHERE candidate_id IN (
        SELECT candidate_id FROM log GROUP BY candidate_id HAVING min(created_at) >= TIMESTAMP '2024-01-01 12:00:00')
        OR candidate_id IN (SELECT candidate_id FROM served WHERE cycle = 2) GROUP BY candidate_id""", "served"),
    "upsert_links": _LINKS + """ SELECT coalesce(n.page_id, o.page_id) AS page_id, CASE WHEN n.page_id IS NOT NULL THEN n.name ELSE o.name END AS name,
        CASE WHEN n.page_id IS NOT NULL THEN n.lang ELSE o.lang END AS lang,
        CASE WHEN n.page_id IS NULL THEN embedded WHEN o.page_id IS NULL OR n.name IS DISTINCT FROM o.name OR n.lang IS DISTINCT FROM o.lang THEN false ELSE embedded END AS embedded
        FROM o FULL JOIN n ON o.page_id = n.page_id""",
    "insert_or_ignore": _sql("""SELECT arg_min(id, (id % 2) * 100000000 + id) AS id, candidate_id, arg_min(user_id, (id % 2) * 100000000 + id) AS user_id
        FROM opens GROUP BY candidate_id""", "opens"),
    "insert_or_replace": _sql("""SELECT arg_max(id, CASE WHEN id % 2 = 1 THEN 100000000 ELSE 0 END + id) AS id, candidate_id,
        arg_max(user_id, CASE WHEN id % 2 = 1 THEN 100000000 ELSE 0 END + id) AS user_id FROM opens GROUP BY candidate_id""", "opens"),
    "outbox_coalesce": _sql("""SELECT candidate_id AS key, CASE arg_max(event_type, id) WHEN 'error' THEN 'delete' ELSE 'put' END AS op,
        'p' || max(id) FILTER (event_type = 'click' AND id > coalesce(gone, -1)) AS payload, count(*) AS version
        FROM log LEFT JOIN (SELECT candidate_id, max(id) AS gone FROM log WHERE event_type = 'error' GROUP BY candidate_id) USING (candidate_id) GROUP BY candidate_id"""),
    "retry_backoff": """SELECT event_id, CASE WHEN event_id % 5 IN (2, 3, 4) THEN least(3600.0, 60 * pow(2, event_id % 8))::DOUBLE END AS delay FROM events""",
    "due_queue": "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 50",
    "debounce_sessions": """SELECT user_id, max(epoch_us(ts)) + 600000000 AS due_us, count(*) AS changes FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)
            <= 600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, part""",
    "strictly_increasing_stamp": """SELECT event_id, CAST(max(now - n) OVER (PARTITION BY user_id ORDER BY event_id) + n AS BIGINT) AS stamp FROM (
        SELECT *, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""",
    "feed_json": _sql(f"""SELECT section, row_number() OVER (PARTITION BY section ORDER BY rank, candidate_id) AS place,
        '{{"candidate_id":' || candidate_id || ',"section":"' || section || '","url":"' || url || '","title":"' || replace(replace(title, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))
            || '","icon":"https://' || domain || '/favicon.ico"}}' AS item
        FROM served JOIN (SELECT candidate_id, url, {_TITLE} AS title, {_DOMAIN} AS domain FROM candidates) USING (candidate_id) WHERE cycle = (SELECT max(cycle) FROM served)""", "served"),
    "digest": _sql(f"SELECT section, rank, candidate_id, (rank + 1) || '. [' || {_TITLE} || '] ' || s.source AS line FROM served s JOIN candidates c USING (candidate_id)", "served"),
    "union_keys": _sql(f"SELECT url_key FROM {_KEYED} WHERE id % 2 = 0 UNION SELECT url_key FROM {_KEYED} WHERE id % 3 = 0"),
    "archive_difference": _sql(f"SELECT url_key FROM {_KEYED} WHERE id % 2 = 0 EXCEPT SELECT url_key FROM {_KEYED} WHERE id % 3 = 0"),
    "benchmark_stats": """SELECT event_type, user_id, list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS p90, round(avg(value), 7) AS mean,
        round(median(value), 4) AS median, max(value) AS most FROM events GROUP BY event_type, user_id""",
}
