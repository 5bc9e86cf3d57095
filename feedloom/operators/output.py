"""What a cycle shows: its rows for readers, an Atom feed, and a digest in Markdown.

A cycle's items are as many as a feed has places, so the texts of one feed fit one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.functions.html import strip_html
from feedloom.functions.plain_text import escaped

#: The order of sections, and texts of the digest.
SECTIONS = ("curated", "broad")
HEAD, BEYOND, NONE = "# Your digest — ", "# Beyond your bubble", "_No items yet — the pipeline has not produced a feed._"
ICON = "https://www.google.com/s2/favicons?domain={}&sz=128"


def current(items: DataFrame) -> DataFrame:
    """The items of the newest cycle."""
    return items.join(F.broadcast(items.agg(F.max("cycle").alias("cycle"))), "cycle")


def place(section: Column, rank: Column) -> Column:
    """Sort key of a cycle: the main section first, by rank."""
    return F.struct(F.when(section == SECTIONS[0], 0).otherwise(1).alias("s"), rank.alias("r"))


def rows(items: DataFrame) -> DataFrame:
    """The newest cycle's items with all that a reader shows, and their place in the feed.

    items: cycle, rank, section, candidate_id, score, reason, source, url, title, snippet, published_at, image_url, description."""
    address = F.coalesce("url", F.lit(""))
    domain = F.replace(F.regexp_extract(F.regexp_replace(address, "^.*//", ""), "^([^/]*)", 1), F.lit("www."), F.lit(""))
    before, after = ICON.split("{}")
    return current(items).select(
        place(F.col("section"), F.col("rank")).alias("place"), "rank", "section", "candidate_id", "source", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"),
        strip_html(F.col("snippet")).alias("snippet"), "score", F.coalesce("reason", F.lit("")).alias("reason"), "published_at", F.col("cycle").alias("discovered_at"),
        F.concat(F.lit(before), domain, F.lit(after)).alias("favicon"), "image_url", text.card_summary(F.col("snippet"), F.col("description")).alias("summary"),
    )


def _joined(shown: DataFrame, line: Column, between: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("place", "candidate_id", line.alias("line"))))
    return shown.agg(F.array_join(F.transform(lines, lambda x: x["line"]), between).alias("body"), F.count(F.lit(1)).alias("n"))


def atom(items: DataFrame, base: str, updated: str) -> DataFrame:
    """feed, n: the newest cycle as one Atom feed. An entry's summary is its reason, else its snippet, with its source and score."""
    shown = rows(items)
    said = F.concat(F.coalesce(F.nullif("reason", F.lit("")), "snippet"), F.lit("\n\n— "), "source", F.format_string(" (score %.2f)", "score"))
    parts = ("<entry><id>", escaped(F.col("url")), "</id><title>", escaped(F.col("title")), '</title><link href="', escaped(F.col("url")), '"/><summary>', escaped(said), "</summary></entry>")
    entry = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>urn:feedloom:discover</id><title>Personal Discover</title>'
        f'<link href="{base.rstrip("/")}/feed.atom" rel="self"/><updated>{updated}</updated>'
    )
    return _joined(shown, entry, "").select(F.concat(F.lit(head), "body", F.lit("</feed>")).alias("feed"), "n")


def digest(items: DataFrame, base: str, day: str) -> DataFrame:
    """text, n: the newest cycle as Markdown, the exploring section under a heading of its own. Each item links to its place in the app."""
    shown = rows(items)
    reason = F.when(F.col("reason") != "", F.concat(F.lit("> "), "reason", F.lit("\n"))).otherwise("")
    item = F.concat(
        F.lit("## "), (F.col("rank") + 1).cast("string"), F.lit(". ["), "title", F.lit("]("), "url", F.lit(")\n"), reason, F.lit("`"), "source",
        F.format_string(f"` · score %.2f · [rate]({base.rstrip('/')}/ui#c", "score"), F.col("candidate_id").cast("string"), F.lit(")\n"),
    )
    first = F.min(F.when(F.col("section") != SECTIONS[0], F.struct("place", "candidate_id")))
    begun = shown.agg(first.alias("b"))
    opens = F.struct("place", "candidate_id") == F.col("b")
    line = F.when(F.coalesce(opens, F.lit(False)), F.concat(F.lit(f"{BEYOND}\n\n"), item)).otherwise(item)
    body = _joined(shown.crossJoin(F.broadcast(begun)), line, "\n")
    return body.select(F.concat(F.lit(f"{HEAD}{day}\n\n"), F.when(F.col("n") == 0, NONE).otherwise(F.col("body"))).alias("text"), "n")
