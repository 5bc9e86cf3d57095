"""The domain's tables over the given Parquet tables: candidates, feedback, history, links, penalties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: As of this moment all ages are counted.
AS_OF = "2024-02-01 00:00:00"

#: SQL that Spark and DuckDB read alike; each may use the ones before it.
VIEWS = {
    "candidates": """
        SELECT e.vec_id AS candidate_id, coalesce(p.url, concat('https://vectors.example.org/v/', CAST(e.vec_id AS STRING))) AS url,
               coalesce(p.html, '') AS html, e.embedding AS vector, e.label,
               concat('T', CAST(e.label AS STRING)) AS topic,
               CASE e.vec_id % 3 WHEN 0 THEN 'hackernews' WHEN 1 THEN 'rss' ELSE 'searxng' END AS source
        FROM embeddings e LEFT JOIN pages p ON e.vec_id = p.page_id""",
    "log": """
        SELECT event_id AS id, user_id, event_id % (SELECT count(*) FROM candidates) AS candidate_id, event_type, value, ts AS created_at,
               CASE WHEN user_id % 4 = 0 THEN 'broad' ELSE 'curated' END AS section
        FROM events""",
    "feedback": """
        SELECT id, user_id, candidate_id, section, created_at,
               CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'signup' THEN 'mood' ELSE 'interest' END AS axis,
               CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'click' THEN 'up' WHEN 'error' THEN 'down'
                    ELSE CASE WHEN id % 2 = 0 THEN 'happy' ELSE 'sad' END END AS value
        FROM log WHERE event_type <> 'view'""",
    "opens": "SELECT id, user_id, candidate_id, section, created_at FROM log WHERE event_type = 'view'",
    "ratings": """
        SELECT id, user_id, candidate_id, (id % 7 - 3) / 2 AS rating, section, created_at
        FROM log WHERE event_type = 'signup' AND (id % 7 - 3) / 2 BETWEEN -1 AND 1""",
    "served": """
        SELECT candidate_id, source, candidate_id % 3 AS cycle, CASE WHEN source = 'searxng' THEN 'broad' ELSE 'curated' END AS section,
               candidate_id % 10 AS rank
        FROM candidates WHERE candidate_id % 7 = 0
        UNION ALL
        SELECT candidate_id, source, 3, CASE WHEN source = 'searxng' OR candidate_id % 4 = 0 THEN 'broad' ELSE 'curated' END, candidate_id % 11
        FROM candidates WHERE candidate_id % 14 = 0""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, hint: str | None = None) -> DataFrame:
    """A domain table, or a given one, as a DataFrame; a hint says how the tables that it is made of are joined."""
    if name not in VIEWS:
        return read(spark, sf_dir, name)
    text, frames = VIEWS[name], {}
    for used in [*VIEWS, "embeddings", "pages", "events"]:
        if used != name and (f"FROM {used}" in text or f"JOIN {used} " in text):
            frame = view(spark, sf_dir, used)
            frames[used] = frame.hint(hint) if hint else frame
            for word in ("FROM", "JOIN"):
                text = text.replace(f"{word} {used}", f"{word} {{{used}}}")
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """The SQL for DuckDB, with the domain tables that it names before it."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in names) + " " + sql
