"""Validated events, section moves, tags, marks and versioned queues, as snapshot transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What votes and ratings may say, and the tags that stand for them.
INTEREST, MOOD, RATINGS = ("up", "down"), ("happy", "sad"), (-1.0, -0.5, 0.0, 0.5, 1.0)
TAGS = {"up": "interest:high", "down": "interest:low", "happy": "mood:happy", "sad": "mood:sad"}
MOST_MARKS = 500


def valid_ratings(rows: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Ratings with an allowed value, the first of each key and value."""
    first = W.partitionBy(key, "rating").orderBy("id")
    return rows.filter(F.col("rating").isin(*RATINGS)).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def facet_tags(tags: Column, interest: Column, mood: Column) -> Column:
    """Tags with those of the facets that are given replaced; others stay in place."""
    names = F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k), F.lit(v))])

    def kept(t: Column) -> Column:
        return ~(F.startswith(t, F.lit("interest:")) & interest.isNotNull()) & ~(F.startswith(t, F.lit("mood:")) & mood.isNotNull())

    new = F.filter(F.array(names[interest], names[mood]), lambda t: t.isNotNull())
    return F.concat(F.filter(tags, kept), new)


def sections(commands: DataFrame, key: str = "candidate_id") -> DataFrame:
    """key, section, saved, moves: what commands save, promote, explore, archive and unsave lead to in their order.

    Aggregates and one lag over the moves, so no list of a key's commands is made."""
    to = F.when(F.col("command") == "promote", "curated").when(F.col("command") == "explore", "broad").when(F.col("command") == "archive", "archive")
    ends = commands.groupBy(key).agg(
        F.max_by(to, F.when(to.isNotNull(), F.col("id"))).alias("section"), (F.max_by("command", "id") != "unsave").alias("saved")
    )
    moves = commands.withColumn("to", to).filter("to IS NOT NULL")
    before = F.lag("to", 1, "curated").over(W.partitionBy(key).orderBy("id"))
    moves = moves.withColumn("moved", (F.col("to") != before).cast("int")).groupBy(key).agg(F.sum("moved").alias("moves"))
    return ends.join(moves, key, "left").select(
        key, F.coalesce("section", F.lit("curated")).alias("section"), "saved", F.coalesce("moves", F.lit(0)).cast("int").alias("moves")
    )


def replace_marks(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Marks with those of the texts that new names replaced: valid ones in the order of start and id, MOST_MARKS at most."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("start", "id"))
    valid = new.filter(F.col("end") > F.col("start")).withColumn("__n", place).filter(F.col("__n") <= MOST_MARKS).drop("__n")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(valid)


def answered(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """The queue without the entries that an answer to their own version has settled."""
    return queue.join(answers.select("key", "version"), ["key", "version"], "left_anti")


def slots(size: int, topics: bool, profile: bool, share: float = 0.3) -> tuple[int, int]:
    """Curated and exploring places of a feed."""
    if not profile:
        return 0, size if topics else 0
    broad = min(round(size * share), size - 1) if topics else 0
    return size - broad, broad


def age_label(created: Column, as_of: Column) -> Column:
    """An age as minutes (one at least), hours, days, or the day and month after a week, and where it lies ahead."""
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 60_000_000)

    def said(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(minutes < 0, F.date_format(created, "dd.MM."))
        .when(minutes < 60, said(F.greatest(minutes, F.lit(1)), " min"))
        .when(minutes < 1_440, said(F.floor(minutes / 60), " h"))
        .when(minutes < 10_080, said(F.floor(minutes / 1_440), " d"))
        .otherwise(F.date_format(created, "dd.MM."))
    )
