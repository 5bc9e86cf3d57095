"""Queries of the outbox: rows, records and what answers do to them; and a change of the model over all tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import html, url
from feedloom.operators import commands, outbox, output
from feedloom.operators.feedback import served_section
from feedloom.sources import snapshots
from feedloom.sources.domain import read, view, with_views
from feedloom.streaming import stateful
from feedloom.streaming.events import run_once

NOW = 1_706_745_600.0


def _said(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")


def _asked(spark, sf_dir) -> DataFrame:
    """The log with the conversation that a purchase is about."""
    return view(spark, sf_dir, "log").withColumn("conv_id", F.when(F.col("event_type") == "purchase", F.col("id") % 60))


def _talks(spark, sf_dir) -> DataFrame:
    """Conversations that the log is about as the JSON of a discussion."""
    said = _said(spark, sf_dir).join(_asked(spark, sf_dir).select("conv_id").distinct(), "conv_id", "left_semi")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    search = F.array().cast("array<struct<query: string, results: array<struct<title: string, url: string>>>>")
    turn = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), search.alias("searches")))
    return said.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(turn).alias("discussion"))


def _commands(spark, sf_dir) -> DataFrame:
    """Commands out of the log: errors delete, purchases are saves with a discussion, signups are highlights, sent ten minutes later.

    A discussion is the number of its conversation here: its text, which many commands share, is joined once they are folded."""
    held = _said(spark, sf_dir).select("conv_id", F.col("conv_id").cast("string").alias("discussion")).distinct()
    at = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    return _asked(spark, sf_dir).join(held, "conv_id", "left").select(
        "id",
        (F.col("candidate_id") - 3).alias("link_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        "discussion",
        at.alias("at"),
        F.when(F.col("event_type") == "signup", 600.0).otherwise(0.0).alias("delay"),
        F.date_format("created_at", outbox.STAMP).alias("updated_at"),
    )


def _folded(spark, sf_dir) -> DataFrame:
    """The outbox after all commands, of which the first 500 have been folded in before, with numbers for discussions."""
    rows = _commands(spark, sf_dir)
    first = outbox.queued(spark.createDataFrame([], outbox.ROW), rows.filter("id < 500"))
    return outbox.queued(first, rows.filter("id >= 500"))


def _told(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """rows with the texts of discussions in the place of their numbers."""
    talks = _talks(spark, sf_dir).select(F.col("conv_id").cast("string").alias("number"), F.col("discussion").alias("talk"))
    return rows.join(talks, F.col("discussion") == F.col("number"), "left").withColumn("discussion", F.col("talk")).drop("number", "talk")


def outbox_rows(spark, sf_dir):
    """The outbox that the whole log of commands leaves, folded in two goes."""
    rows = _told(spark, sf_dir, _folded(spark, sf_dir))
    return rows.select("link_id", "op", F.md5("discussion").alias("talk_md5"), "updated_at", F.floor("due_at").alias("due_s"), "attempts", "state", "version")


def delivery_records(spark, sf_dir):
    """What is sent for each row: the save with its page's language, source, highlights, latest vote and discussion."""
    candidates = view(spark, sf_dir, "candidates").withColumn("url_key", url.norm_url("url"))
    feedback = view(spark, sf_dir, "feedback")
    own = feedback.filter("axis = 'saved'").groupBy("candidate_id").agg(F.min("created_at").alias("created_at"), F.max_by("section", "id").alias("section"))
    saves = own.join(candidates, "candidate_id").select(
        (F.col("candidate_id") - 3).alias("link_id"), "url", "url_key", html.title(F.col("html")).alias("title"), "section", F.col("label").cast("long").alias("collection_id"), "created_at"
    )
    articles = candidates.filter("html <> ''").select("candidate_id", F.nullif(html.language(F.col("html")), F.lit("")).alias("lang"))
    marks = view(spark, sf_dir, "log").filter("event_type = 'click'").select(
        "candidate_id", F.when(F.col("id") % 2 == 0, "orig").otherwise("tr").alias("variant"), "id", F.element_at(F.array(F.lit("red"), F.lit("blue")), (F.col("user_id") % 2 + 1).cast("int")).alias("color"),
        F.floor("value").cast("int").alias("start"), (F.floor("value") + F.col("id") % 9).cast("int").alias("end"), F.col("event_type").alias("quote"), F.lit("").alias("prefix"), F.lit(" x").alias("suffix"),
    )
    votes = feedback.filter("axis = 'interest'").join(candidates.select("candidate_id", "url_key"), "candidate_id").select("url_key", "id", "value")
    sent = outbox.records(_told(spark, sf_dir, _folded(spark, sf_dir)), saves, candidates, articles, marks, votes)
    r = F.col("record")
    marked = F.array_join(F.transform(r["highlights"], lambda m: F.concat_ws("|", *(m[c].cast("string") for c in ("variant", *outbox.MARK)))), ";")
    talk = F.array_join(F.transform(r["discussion"], lambda t: F.concat(t["role"], F.lit(":"), t["content"])), ";")
    fields = ("v", "url", "url_key", "title", "lang", "collection_id", "section", "source", "saved_at", "updated_at", "interest")
    return sent.select(
        "link_id", "op", "version", *(r[f].alias(f) for f in fields), F.when(F.col("op") == "put", F.size(r["highlights"]).cast("long")).alias("highlights"), F.md5(marked).alias("marks_md5"),
        F.md5(talk).alias("talk_md5"),
    ).fillna(0, ["v", "collection_id", "highlights"])


def outbox_settled(spark, sf_dir):
    """The outbox after an answer to two rows in three; of one in five the row has changed meanwhile."""
    rows = _folded(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, (204, 404, 429, 503, 0, 200))), (F.col("link_id") % 6 + 1).cast("int"))
    answers = rows.filter("link_id % 3 > 0").select("link_id", (F.col("version") - (F.col("link_id") % 5 == 0).cast("long")).alias("version"), "attempts", status.alias("status"), F.lit(None).cast("string").alias("error"))
    out = _told(spark, sf_dir, outbox.settled(rows, answers, NOW))
    return out.select("link_id", "op", F.md5("discussion").alias("talk_md5"), F.floor("due_at").alias("due_s"), "attempts", "last_error", "state", "version")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="feedloom-")


def _folder(spark, tag: str) -> str:
    """A new folder that all executors share; a local session without spark.checkpoint.dir has one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or _own_folder()}/feedloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def model_change(spark, sf_dir):
    """Tables before and after the model has changed: rows, rows with vectors, flags, and the sum of keys, read from both snapshots."""
    candidates = view(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("id"), F.col("vector").alias("embedding"), (F.col("candidate_id") % 7 > 0).alias("embedded"))
    vectors = candidates.select("id", "embedding")
    log = view(spark, sf_dir, "log").select("event_type", "candidate_id", F.col("id").alias("event")).join(vectors.withColumnRenamed("id", "candidate_id"), "candidate_id")

    def events(kind: str) -> DataFrame:
        return log.filter(F.col("event_type") == kind).select(F.col("event").alias("id"), "embedding")

    tables = {
        "candidates": candidates, "links": candidates.filter("id % 2 = 0"), "saves": events("purchase"), "feedback": events("click"), "ratings": events("signup"),
        "opens": events("view"), "profile": view(spark, sf_dir, "candidates").groupBy(F.col("label").cast("long").alias("id")).agg(F.first("vector").alias("embedding")),
        "served": view(spark, sf_dir, "served").select(F.col("candidate_id").alias("id")),
    }
    root = _folder(spark, "model")
    snapshots.publish(spark, root, tables, {"model": "first", "dim": 64})
    after = snapshots.change_model(spark, root, "second", 32, "20240131-000000")
    both = (("before", snapshots.newest(spark, root, snapshots.BACKUPS)), ("after", after))

    def counted(state: str, snapshot, name: str) -> DataFrame:
        t = snapshot[name]
        has = F.sum(F.col("embedding").isNotNull().cast("long")) if "embedding" in t.columns else F.lit(0).cast("long")
        flags = F.sum(F.col("embedded").cast("long")) if "embedded" in t.columns else F.lit(0).cast("long")
        sums = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(has, F.lit(0)).alias("vectors"), F.coalesce(flags, F.lit(0)).alias("flags"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))
        return sums.select(F.lit(state).alias("state"), F.lit(name).alias("table"), "n", "vectors", "flags", "ids")

    return reduce(DataFrame.unionByName, (counted(state, snapshot, name) for state, snapshot in both for name in snapshot.names))


def _streamed(spark, sf_dir, tag: str, transform) -> DataFrame:
    """What a stream over the events gives, run until it has read them all. A pattern, as a stream has no folder to watch where the table is one file."""
    root = _folder(spark, tag)
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    before = {k: spark.conf.get(k, None) for k in stateful.ROCKSDB}
    for k, v in stateful.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        run_once(transform(stream), lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{root}/out").drop("batch")


def stream_first_events(spark, sf_dir):
    """The first event of each user and type that the stream has ever seen."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")
    return _streamed(spark, sf_dir, "first", lambda s: stateful.once_ever(s.select(F.col("event_id").alias("id"), key), "key"))


def stream_due_changes(spark, sf_dir):
    """Users' runs of changes that are due, as timers find them."""
    changes = _streamed(spark, sf_dir, "due", lambda s: stateful.debounced(s.select("user_id", F.col("ts").cast("timestamp").alias("created_at")), "user_id"))
    return changes.select("user_id", F.unix_millis("due").alias("due_ms"), "changes")


def _items(spark, sf_dir) -> DataFrame:
    """Served stories with what a reader shows of them; scores and reasons as verdicts give them, to one story in three."""
    served = view(spark, sf_dir, "served").select("candidate_id", "cycle", "section", "rank")
    rows = served.join(view(spark, sf_dir, "candidates").select("candidate_id", "url", "html", "topic", "source"), "candidate_id")
    return rows.select(
        "cycle", "rank", "section", "candidate_id", ((F.col("candidate_id") % 100) / 100).alias("score"), F.when(F.col("candidate_id") % 3 == 0, F.concat(F.lit("near "), "topic")).alias("reason"),
        "source", "url", html.title(F.col("html")).alias("title"), F.substring("html", 1, 900).alias("snippet"), F.lit(None).cast("string").alias("published_at"), html.first_image(F.col("html")).alias("image_url"),
        F.lit(None).cast("string").alias("description"),
    )


def feed_rows(spark, sf_dir):
    """The newest cycle as a reader shows it, in its order."""
    rows = output.rows(_items(spark, sf_dir))
    return rows.select("rank", "section", "candidate_id", "source", "url", "title", F.md5("snippet").alias("snippet_md5"), "score", "reason", "discovered_at", "favicon", (F.length("summary") > 0).alias("summed"))


def atom_feed(spark, sf_dir):
    return output.atom(_items(spark, sf_dir), "https://app.example/", "2024-01-31T00:00:00Z")


def digest_text(spark, sf_dir):
    return output.digest(_items(spark, sf_dir), "https://app.example", "2024-01-31")


#: What the log's events command.
COMMANDS = {"purchase": "save", "signup": "promote", "click": "explore", "error": "unsave", "view": "archive"}


def _commanded(spark, sf_dir) -> commands.Tables:
    """The tables after the log's events as commands on known candidates, some saved and linked before."""
    keyed = view(spark, sf_dir, "candidates").select("candidate_id", url.norm_url("url").alias("url_key")).filter("candidate_id % 9 > 0")
    name = F.element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in COMMANDS.items()) + ")"), F.col("event_type"))
    log = view(spark, sf_dir, "log").filter("id % 4 = 1 OR candidate_id % 2 = 0")
    rows = log.select("id", "candidate_id", name.alias("command"), F.when(F.col("user_id") % 3 == 0, F.col("section")).alias("section"), "created_at")
    long_ago = F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
    link = F.when(F.col("candidate_id") % 2 == 0, F.col("candidate_id") + 1000)
    saves = keyed.filter("candidate_id % 3 = 0").groupBy("url_key").agg(F.min("candidate_id").alias("candidate_id"))
    saves = saves.select("url_key", "candidate_id", link.cast("long").alias("link_id"), F.lit("curated").alias("section"), long_ago.alias("created_at"))
    saved = saves.select(F.col("candidate_id").alias("id"), "candidate_id", "url_key", F.lit("saved").alias("axis"), F.lit("explicit").alias("value"), "section", "created_at")
    votes = view(spark, sf_dir, "feedback").filter("axis = 'interest'").join(keyed, "candidate_id").select((F.col("id") + 1_000_000).alias("id"), "candidate_id", "url_key", "axis", "value", "section", "created_at")
    links = keyed.filter("candidate_id % 5 = 0").select(F.col("candidate_id").alias("link_id"), "url_key")
    return commands.applied(rows, keyed, served_section(view(spark, sf_dir, "served")), saves, saved.unionByName(votes), links)


def commands_saves(spark, sf_dir):
    """Saves after all commands; a link of 0 is none."""
    return _commanded(spark, sf_dir).saves.fillna(0, ["link_id"])


def commands_feedback(spark, sf_dir):
    """Events after all commands: saves where they lie now, and a vote against for each explore."""
    return _commanded(spark, sf_dir).feedback


def commands_links(spark, sf_dir):
    return _commanded(spark, sf_dir).links


def commands_outbox(spark, sf_dir):
    """What the commands queue for stories with a link."""
    return _commanded(spark, sf_dir).outbox


QUERIES = {f.__name__: f for f in (feed_rows, atom_feed, digest_text, commands_saves, commands_feedback, commands_links, commands_outbox, stream_first_events, stream_due_changes, outbox_rows, delivery_records, outbox_settled, model_change)}

from feedloom.plans.text_queries import _KEY, _TITLE, _strip  # noqa: E402

_TALKS = """(SELECT conv_id, '[' || string_agg('{"role":"' || role || '","content":' || CAST(to_json(text) AS VARCHAR) || ',"searches":[]}', ',' ORDER BY turn) || ']' AS discussion,
    string_agg(role || ':' || text, ';' ORDER BY turn) AS talk FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)"""
_BOX = f"""(SELECT candidate_id - 3 AS link_id, count(*) AS version, arg_max(event_type, id) AS last_type, CASE arg_max(event_type, id) WHEN 'error' THEN 'delete' ELSE 'put' END AS op,
        strftime(arg_max(created_at, id), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, floor(epoch_us(arg_max(created_at, id)) / 1e6)::BIGINT AS at_s,
        max(id) FILTER (event_type = 'error') AS gone, max(id) FILTER (event_type = 'purchase' AND t.discussion IS NOT NULL) AS said
    FROM log LEFT JOIN {_TALKS} t ON event_type = 'purchase' AND t.conv_id = id % 60 WHERE candidate_id > 3 GROUP BY candidate_id)"""
_FULL = f"""(SELECT b.*, CASE WHEN op = 'put' AND said > coalesce(gone, -1) THEN t.discussion END AS discussion, CASE WHEN op = 'put' AND said > coalesce(gone, -1) THEN t.talk END AS talk,
    at_s + CASE WHEN last_type = 'signup' THEN 600 ELSE 0 END AS due_s FROM {_BOX} b LEFT JOIN {_TALKS} t ON t.conv_id = said % 60)"""


def _sql(rest: str, *names: str) -> str:
    return with_views(rest, "candidates", "log", "feedback", *names)


_COUNTED = "count(*) AS n, count(*) FILTER (embedding IS NOT NULL) AS vectors, coalesce(sum(embedded::BIGINT), 0)::BIGINT AS flags, coalesce(sum(id), 0)::BIGINT AS ids"
_EVENTS = ", ".join(f"('{t}', '{e}')" for t, e in (("saves", "purchase"), ("feedback", "click"), ("ratings", "signup"), ("opens", "view")))

_TOLD = f""", keyed AS (SELECT candidate_id, {_KEY} AS url_key FROM candidates WHERE candidate_id % 9 > 0),
    places AS (SELECT candidate_id, arg_max(section, cycle * 2 + CASE WHEN section <> 'broad' THEN 1 ELSE 0 END) AS tab FROM served GROUP BY candidate_id),
    known AS (SELECT id, candidate_id, url_key, command, created_at, CASE command WHEN 'save' THEN coalesce(section, tab, 'curated') WHEN 'promote' THEN 'curated'
            WHEN 'explore' THEN 'broad' WHEN 'archive' THEN 'archive' END AS filed
        FROM (SELECT *, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items())} END AS command FROM (
            SELECT id, candidate_id, event_type, created_at, CASE WHEN user_id % 3 = 0 THEN section END AS section FROM log WHERE id % 4 = 1 OR candidate_id % 2 = 0))
        JOIN keyed USING (candidate_id) LEFT JOIN places USING (candidate_id)),
    old AS (SELECT url_key, min(candidate_id) AS candidate_id, CASE min(candidate_id) % 2 WHEN 0 THEN min(candidate_id) + 1000 ELSE 0 END AS link_id FROM keyed WHERE candidate_id % 3 = 0 GROUP BY url_key),
    mirrored AS (SELECT candidate_id AS link_id, url_key FROM keyed WHERE candidate_id % 5 = 0),
    told AS (SELECT url_key, max(id) FILTER (command = 'unsave') AS gone FROM known GROUP BY url_key),
    final AS (SELECT url_key, gone, arg_max(filed, id) FILTER (live) AS now, arg_min(candidate_id, id) FILTER (live) AS first_id, min(id) FILTER (live) AS first_no, arg_min(created_at, id) FILTER (live) AS first_at
        FROM (SELECT *, filed IS NOT NULL AND id > coalesce(gone, -1) AS live FROM known JOIN told USING (url_key)) GROUP BY url_key, gone),
    stay AS (SELECT o.*, coalesce(now, 'curated') AS section FROM old o LEFT JOIN final USING (url_key) WHERE gone IS NULL),
    new AS (SELECT * FROM final WHERE now IS NOT NULL AND (gone IS NOT NULL OR url_key NOT IN (SELECT url_key FROM old UNION SELECT url_key FROM mirrored)))"""

_SHOWN = f""", shown AS (SELECT s.rank, s.section, s.candidate_id, c.source, url, coalesce(nullif({_TITLE}, ''), url) AS title, {_strip("left(html, 900)")} AS snippet,
        (s.candidate_id % 100) / 100 AS score, CASE WHEN s.candidate_id % 3 = 0 THEN 'near ' || topic ELSE '' END AS reason, cycle AS discovered_at,
        'https://www.google.com/s2/favicons?domain=' || replace(split_part(regexp_replace(url, '^.*//', ''), '/', 1), 'www.', '') || '&sz=128' AS favicon,
        CASE s.section WHEN 'curated' THEN 0 ELSE 1 END AS part
    FROM served s JOIN candidates c ON c.candidate_id = s.candidate_id WHERE cycle = (SELECT max(cycle) FROM served))"""


def _xml(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


ORACLE_SQL = {
    "feed_rows": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _SHOWN + """
        SELECT rank, section, candidate_id, source, url, title, md5(snippet) AS snippet_md5, score, reason, discovered_at, favicon, snippet <> '' AS summed FROM shown""",
    "atom_feed": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _SHOWN + f"""
        SELECT '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>urn:feedloom:discover</id><title>Personal Discover</title>'
            || '<link href="https://app.example/feed.atom" rel="self"/><updated>2024-01-31T00:00:00Z</updated>' || coalesce(string_agg('<entry><id>' || {_xml('url')} || '</id><title>' || {_xml('title')}
            || '</title><link href="' || {_xml('url')} || '"/><summary>' || {_xml("coalesce(nullif(reason, ''), snippet) || chr(10) || chr(10) || '— ' || source || printf(' (score %.2f)', score)")}
            || '</summary></entry>', '' ORDER BY part, rank, candidate_id), '') || '</feed>' AS feed, count(*) AS n FROM shown""",
    "digest_text": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _SHOWN + """
        SELECT '# Your digest — 2024-01-31' || chr(10) || chr(10) || string_agg(CASE WHEN part = 1 AND coalesce(before, 0) = 0 THEN '# Beyond your bubble' || chr(10) || chr(10) ELSE '' END
            || '## ' || (rank + 1) || '. [' || title || '](' || url || ')' || chr(10) || CASE reason WHEN '' THEN '' ELSE '> ' || reason || chr(10) END || '`' || source || printf('` · score %.2f', score)
            || ' · [rate](https://app.example/ui#c' || candidate_id || ')' || chr(10), chr(10) ORDER BY part, rank, candidate_id) AS text, count(*) AS n
        FROM (SELECT *, lag(part) OVER (ORDER BY part, rank, candidate_id) AS before FROM shown)""",
    "commands_saves": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _TOLD + """
        SELECT url_key, candidate_id, link_id, section, TIMESTAMP '2023-12-01' AS created_at FROM stay UNION ALL SELECT url_key, first_id, 0, now, first_at FROM new""",
    "commands_feedback": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _TOLD + """, votes AS (SELECT f.id + 1000000 AS id, candidate_id, url_key, axis, value, section, created_at
            FROM feedback f JOIN keyed USING (candidate_id) WHERE axis = 'interest'),
        base AS (SELECT greatest((SELECT max(id) FROM votes), (SELECT max(candidate_id) FROM old)) AS b)
        SELECT * FROM votes UNION ALL SELECT candidate_id, candidate_id, url_key, 'saved', 'explicit', section, TIMESTAMP '2023-12-01' FROM stay
        UNION ALL SELECT b + 2 * first_no, first_id, url_key, 'saved', 'explicit', now, first_at FROM new, base
        UNION ALL SELECT b + 2 * id + 1, candidate_id, url_key, 'interest', 'down', 'curated', created_at FROM known, base WHERE command = 'explore'""",
    "commands_links": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _TOLD + " SELECT link_id, url_key FROM mirrored WHERE url_key NOT IN (SELECT url_key FROM told WHERE gone IS NOT NULL)",
    "commands_outbox": _sql("SELECT 1", "served").removesuffix("SELECT 1").rstrip() + _TOLD + """, early AS (SELECT k.*, coalesce(lag(filed) OVER (PARTITION BY url_key ORDER BY id), 'curated') AS was
            FROM known k WHERE filed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM known u WHERE u.url_key = k.url_key AND u.command = 'unsave' AND u.id < k.id))
        SELECT e.id, link_id, 'put' AS op FROM early e JOIN old USING (url_key) WHERE link_id > 0 AND (command <> 'save' OR was <> filed)
        UNION ALL SELECT min(k.id), link_id, 'delete' FROM known k JOIN old USING (url_key) WHERE link_id > 0 AND command = 'unsave' GROUP BY url_key, link_id""",
    "outbox_rows": _sql(f"SELECT link_id, op, md5(discussion) AS talk_md5, updated_at, due_s, 0::INTEGER AS attempts, 'pending' AS state, version FROM {_FULL}"),
    "delivery_records": _sql(f"""SELECT link_id, op, version, CASE op WHEN 'put' THEN 1 ELSE 0 END::INTEGER AS v, url, url_key, title, lang, coalesce(collection_id, 0) AS collection_id, section, source, saved_at,
            CASE op WHEN 'put' THEN updated_at END AS updated_at, interest, CASE op WHEN 'put' THEN coalesce(highlights, 0) ELSE 0 END AS highlights,
            CASE op WHEN 'put' THEN md5(coalesce(marked, '')) END AS marks_md5, md5(talk) AS talk_md5
        FROM {_FULL} b LEFT JOIN (
            SELECT c.candidate_id AS own, c.url, c.url_key, {_TITLE} AS title, c.label::BIGINT AS collection_id, s.section, strftime(s.created_at, '%Y-%m-%dT%H:%M:%SZ') AS saved_at
            FROM (SELECT candidate_id, min(created_at) AS created_at, arg_max(section, id) AS section FROM feedback WHERE axis = 'saved' GROUP BY candidate_id) s
            JOIN (SELECT *, {_KEY} AS url_key FROM candidates) c USING (candidate_id)) s ON own - 3 = link_id AND op = 'put'
        LEFT JOIN (SELECT url AS known_url, max(candidate_id) AS known, arg_max(source, candidate_id) AS source,
            nullif(regexp_extract(arg_max(html, candidate_id), '<html lang="([a-z]+)"', 1), '') AS lang FROM candidates GROUP BY url) k ON known_url = url
        LEFT JOIN (SELECT candidate_id AS marked_id, count(*) AS highlights, string_agg(concat_ws('|', CASE id % 2 WHEN 0 THEN 'orig' ELSE 'tr' END,
                CASE user_id % 2 WHEN 0 THEN 'red' ELSE 'blue' END, floor(value)::INTEGER, (floor(value) + id % 9)::INTEGER, 'click', '', ' x'), ';' ORDER BY id % 2, id) AS marked
            FROM log WHERE event_type = 'click' GROUP BY candidate_id) m ON marked_id = known
        LEFT JOIN (SELECT {_KEY} AS voted, arg_max(value, id) AS interest FROM feedback JOIN candidates USING (candidate_id) WHERE axis = 'interest' GROUP BY 1) v ON voted = url_key
        WHERE op = 'delete' OR own IS NOT NULL"""),
    "outbox_settled": _sql(f"""SELECT link_id, op, CASE WHEN kind <> 'failed' THEN md5(discussion) END AS talk_md5, CASE kind WHEN 'retry' THEN {int(NOW)} + 60 ELSE due_s END AS due_s,
            CASE kind WHEN 'retry' THEN 1 ELSE 0 END::INTEGER AS attempts, CASE WHEN kind IN ('retry', 'failed') THEN 'HTTP ' || status END AS last_error,
            CASE kind WHEN 'failed' THEN 'failed' ELSE 'pending' END AS state, version
        FROM (SELECT *, CASE WHEN link_id % 3 = 0 OR link_id % 5 = 0 THEN 'none' WHEN status IN (204, 200) THEN 'sent' WHEN status = 404 THEN 'failed' ELSE 'retry' END AS kind
            FROM (SELECT *, [204, 404, 429, 503, 0, 200][link_id % 6 + 1] AS status FROM {_FULL})) WHERE kind <> 'sent'"""),
    "model_change": _sql(f"""SELECT state, "table", n, CASE state WHEN 'before' THEN vectors ELSE 0 END AS vectors, CASE state WHEN 'before' THEN flags ELSE 0 END AS flags, ids FROM (
            SELECT 'candidates' AS "table", {_COUNTED} FROM (SELECT candidate_id AS id, vector AS embedding, candidate_id % 7 > 0 AS embedded FROM candidates)
            UNION ALL SELECT 'links', {_COUNTED} FROM (SELECT candidate_id AS id, vector AS embedding, candidate_id % 7 > 0 AS embedded FROM candidates WHERE candidate_id % 2 = 0)
            UNION ALL SELECT t, count(*), count(*), 0, coalesce(sum(id), 0)::BIGINT FROM log JOIN (VALUES {_EVENTS}) AS x(t, e) ON event_type = e GROUP BY t
            UNION ALL SELECT 'served', count(*), 0, 0, sum(candidate_id)::BIGINT FROM served), (VALUES ('before'), ('after')) AS s(state)
        UNION ALL SELECT 'before', 'profile', count(DISTINCT label), count(DISTINCT label), 0, (SELECT sum(l)::BIGINT FROM (SELECT DISTINCT label AS l FROM candidates)) FROM candidates
        UNION ALL SELECT 'after', 'profile', 0, 0, 0, 0""", "served"),
    "stream_first_events": "SELECT min(event_id) AS id, user_id || ':' || event_type AS key FROM events GROUP BY user_id, event_type",
    "stream_due_changes": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events),
        runs AS (SELECT user_id, max(t) + 600000 AS due_ms, count(*) AS changes, max(part) OVER (PARTITION BY user_id) AS last_part, part FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS part FROM (
                SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 600000 THEN 0 ELSE 1 END AS fresh FROM e)) GROUP BY user_id, part)
        SELECT user_id, due_ms, changes FROM runs WHERE part < last_part OR due_ms <= (SELECT max(t) FROM e) - 3600000""",
}
