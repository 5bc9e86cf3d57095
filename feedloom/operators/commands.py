"""Commands on stories, folded into all tables that they change: saves, feedback, links and the outbox.

A story is its page's identity. What stood before the last unsave of a story no longer
counts, votes aside; of the commands after it the first that files the story saves it, and
the last one says where it lies. So the tables come from aggregates over the log, and no
story's commands are walked in order. Commands for unknown candidates change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Commands that file a story, with the section of each; save files it where it was pressed, or served.
FILED = {"promote": "curated", "explore": "broad", "archive": "archive"}
SAVE, UNSAVE, EXPLORE = "save", "unsave", "explore"


@dataclass
class Tables:
    """saves: url_key, candidate_id, link_id, section, created_at; feedback: id, candidate_id, url_key, axis, value, section, created_at;
    links: link_id, url_key; outbox: id, link_id, op."""

    saves: DataFrame
    feedback: DataFrame
    links: DataFrame
    outbox: DataFrame


def applied(commands: DataFrame, candidates: DataFrame, served: DataFrame, saves: DataFrame, feedback: DataFrame, links: DataFrame) -> Tables:
    """The tables after the commands. commands: id, candidate_id, command, section (the tab, or null), created_at;
    candidates: candidate_id, url_key; served: candidate_id, section (one row each).

    An explore is a vote against the story for the main section as well, one for each time. New saves have no link yet.
    Events that commands make are numbered after those that are there, in the order of the commands."""
    filed = F.when(F.col("command") == SAVE, F.coalesce("section", "served", F.lit("curated")))
    for name, section in FILED.items():
        filed = filed.when(F.col("command") == name, section)
    known = commands.join(candidates.select("candidate_id", "url_key"), "candidate_id").join(
        served.select("candidate_id", F.col("section").alias("served")), "candidate_id", "left"
    )
    known = known.select("id", "candidate_id", "url_key", "command", filed.alias("filed"), "created_at")
    ends = known.groupBy("url_key").agg(F.max(F.when(F.col("command") == UNSAVE, F.col("id"))).alias("gone"))
    live = known.join(ends, "url_key").filter(F.col("filed").isNotNull() & (F.col("gone").isNull() | (F.col("id") > F.col("gone"))))
    last = live.groupBy("url_key").agg(F.max_by("filed", "id").alias("now"), F.min(F.struct("id", "candidate_id", "created_at")).alias("first"))
    told = ends.join(last, "url_key", "left")
    gone = told.filter("gone IS NOT NULL").select("url_key")

    def moved(table: DataFrame) -> DataFrame:
        """Rows of saved stories that were never unsaved, in the section where they lie now."""
        rows = table.join(gone, "url_key", "left_anti").join(told.select("url_key", "now"), "url_key", "left")
        return rows.withColumn("section", F.coalesce("now", "section")).select(*table.columns)

    marked = feedback.filter("axis = 'saved'").select("url_key").unionByName(links.select("url_key")).unionByName(saves.select("url_key")).distinct()
    known_before = marked.join(gone, "url_key", "left_anti")
    new = told.filter("now IS NOT NULL").join(known_before, "url_key", "left_anti")
    fresh = new.select("url_key", F.col("first.candidate_id").alias("candidate_id"), F.lit(None).cast("long").alias("link_id"), F.col("now").alias("section"), F.col("first.created_at").alias("created_at"))
    all_saves = moved(saves.select(*fresh.columns)).unionByName(fresh)
    base = feedback.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))
    saved = new.select(F.col("first.id").alias("at"), F.lit(0).alias("k"), F.col("first.candidate_id").alias("candidate_id"), "url_key", F.lit("saved").alias("axis"), F.lit("explicit").alias("value"), F.col("now").alias("section"), F.col("first.created_at").alias("created_at"))
    against = known.filter(F.col("command") == EXPLORE).select(F.col("id").alias("at"), F.lit(1).alias("k"), "candidate_id", "url_key", F.lit("interest").alias("axis"), F.lit("down").alias("value"), F.lit("curated").alias("section"), "created_at")
    # two events a command at most, so twice its number keeps their order
    made = saved.unionByName(against).crossJoin(F.broadcast(base)).withColumn("id", F.col("base") + 2 * F.col("at") + F.col("k"))
    events = feedback.select("id", "candidate_id", "url_key", "axis", "value", "section", "created_at")
    stay = events.filter("axis <> 'saved'").unionByName(moved(events.filter("axis = 'saved'")))
    changed = stay.unionByName(made.select(*events.columns))
    # a save that lies where it was put before queues nothing; any other filing does, for stories that have a link
    run = W.partitionBy("url_key").orderBy("id")
    steps = known.withColumn("part", F.sum((F.col("command") == UNSAVE).cast("int")).over(run)).filter("filed IS NOT NULL")
    before = F.lag("filed").over(W.partitionBy("url_key", "part").orderBy("id"))
    mine = saves.filter("link_id > 0").select("url_key", "link_id", F.col("section").alias("was"))
    steps = steps.withColumn("before", before).join(mine, "url_key").filter((F.col("part") == 0) & ((F.col("command") != SAVE) | (F.coalesce("before", "was") != F.col("filed"))))
    first_gone = known.filter(F.col("command") == UNSAVE).groupBy("url_key").agg(F.min("id").alias("id"))
    outbox = steps.select("id", "link_id", F.lit("put").alias("op")).unionByName(first_gone.join(mine, "url_key").select("id", "link_id", F.lit("delete").alias("op")))
    return Tables(all_saves, changed, links.join(gone, "url_key", "left_anti").select("link_id", "url_key"), outbox)
