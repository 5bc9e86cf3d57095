"""Folds over the feedback log: interest weights, bandit arms, penalties, facets, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.decay import decayed, penalty_now
from feedloom.operators.latest import latest_by

#: What an event adds to an interest, and what a failure costs a site.
SAVED, UP, DOWN, OPENED, RATED, LEAST_WEIGHT = 1.0, 1.0, -1.0, 0.1, 2.0, 0.25
FIRST_FAILURE, NEXT_FAILURE = 0.2, 0.1


def latest_votes(feedback: DataFrame) -> DataFrame:
    """The latest interest vote of each user and candidate, over all sections; sections are filtered afterwards."""
    return latest_by(feedback.filter("axis = 'interest'"), ["user_id", "candidate_id"])


def signals(feedback: DataFrame, opens: DataFrame, ratings: DataFrame) -> DataFrame:
    """user_id, candidate_id, base, created_at: curated saves, latest votes, opens that nothing overrides, and ratings, all of them from any section."""
    curated = F.col("section") == "curated"
    saved = feedback.filter((F.col("axis") == "saved") & curated)
    votes = latest_votes(feedback).filter(curated)
    silent = opens.filter(curated).join(feedback.filter("axis in ('saved', 'interest')"), ["user_id", "candidate_id"], "left_anti")
    out = ["user_id", "candidate_id", "base", "created_at"]
    return (
        saved.withColumn("base", F.lit(SAVED)).select(out)
        .unionByName(votes.withColumn("base", F.when(F.col("value") == "up", UP).otherwise(DOWN)).select(out))
        .unionByName(silent.withColumn("base", F.lit(OPENED)).select(out))
        .unionByName(ratings.withColumn("base", F.col("rating").cast("double") * RATED).select(out))
    )


def centroid_weights(signalled: DataFrame, nearest: DataFrame, centroids: DataFrame, as_of: Column) -> DataFrame:
    """centroid, weight: 1 and the decayed signals of its candidates, LEAST_WEIGHT at least."""
    sums = (
        signalled.join(nearest, "candidate_id")
        .groupBy("centroid")
        .agg(F.sum(decayed(F.col("base"), F.col("created_at"), as_of)).alias("s"))
    )
    return centroids.select("centroid").join(sums, "centroid", "left").select(
        "centroid", F.greatest(F.lit(LEAST_WEIGHT), 1 + F.coalesce("s", F.lit(0.0))).alias("weight")
    )


def arm_stats(served: DataFrame, feedback: DataFrame, opens: DataFrame) -> DataFrame:
    """topic, serves, rewards over what the exploring section served: 1 for a save or an up vote, OPENED for an open.

    A story that was served again counts as served again, and is rewarded once."""
    broad = served.filter("section = 'broad'")
    saved = feedback.filter("axis = 'saved'").select("candidate_id").distinct().withColumn("saved", F.lit(True))
    vote = latest_by(feedback.filter("axis = 'interest'"), ["candidate_id"]).select("candidate_id", F.col("value").alias("vote"))
    opened = opens.filter("section = 'broad'").select("candidate_id").distinct().withColumn("opened", F.lit(True))
    items = broad.groupBy("candidate_id", "topic").agg(F.count(F.lit(1)).alias("serves"))
    joined = items.join(saved, "candidate_id", "left").join(vote, "candidate_id", "left").join(opened, "candidate_id", "left")
    reward = (
        F.when(F.coalesce("saved", F.lit(False)) | (F.coalesce("vote", F.lit("")) == "up"), 1.0)
        .when(F.coalesce("opened", F.lit(False)) & F.col("saved").isNull() & F.col("vote").isNull(), OPENED)
        .otherwise(0.0)
    )
    return joined.groupBy("topic").agg(F.sum("serves").alias("serves"), F.sum(reward).alias("rewards"))


def _voted(feedback: DataFrame) -> DataFrame:
    """The latest interest vote on each story: candidate_id, id, value, section."""
    return latest_by(feedback.filter("axis = 'interest'").select("candidate_id", "id", "value", "section"), ["candidate_id"])


def rejected(feedback: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, id, title, their_vector of stories whose latest vote is against them, and was given in the main section; those without a
    vector are left out. candidates: candidate_id, title, vector. Ordered by id, falling, they are the newest first."""
    down = _voted(feedback).filter("value = 'down' AND section = 'curated'").select("candidate_id", "id")
    return down.join(candidates.select("candidate_id", "title", F.col("vector").alias("their_vector")).filter("their_vector IS NOT NULL"), "candidate_id")


def kept(feedback: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, their_vector of the pages that are kept: links, saves, and stories with a latest vote for them in the main section."""
    up = _voted(feedback).filter("value = 'up' AND section = 'curated'").select("candidate_id")
    ids = links.select("candidate_id").unionByName(feedback.filter("axis = 'saved'").select("candidate_id")).unionByName(up).distinct()
    return ids.join(candidates.select("candidate_id", F.col("vector").alias("their_vector")).filter("their_vector IS NOT NULL"), "candidate_id")


def explore_taste(feedback: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, liked, their_vector from the exploring section alone: saves and latest votes for a story, or against it."""
    saved = feedback.filter("axis = 'saved' AND section = 'broad'").select("candidate_id", F.lit(True).alias("liked"))
    voted = _voted(feedback).filter("section = 'broad' AND value IN ('up', 'down')").select("candidate_id", (F.col("value") == "up").alias("liked"))
    both = saved.unionByName(voted).distinct()
    return both.join(candidates.select("candidate_id", F.col("vector").alias("their_vector")).filter("their_vector IS NOT NULL"), "candidate_id")


def greedy_arms(stats: DataFrame) -> DataFrame:
    """Arms by rate, best first: (rewards + 1) / (serves + 2), ties by name."""
    return stats.withColumn("rate", (F.col("rewards") + 1) / (F.col("serves") + 2))


def site_penalties(failures: DataFrame) -> DataFrame:
    """site, penalty, last_failure from site, day: each failure adds to what is left of the ones before it.

    Failures are counted by day first, so a site's list is as long as its days."""
    days = failures.groupBy("site", "day").agg(F.count(F.lit(1)).alias("n"))
    days = days.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"))

    def charge(state: Column, at: Column) -> Column:
        left = F.when(state["last"].isNull(), 0.0).otherwise(penalty_now(state["p"], at["day"] - state["last"]))
        first = F.when(left == 0, FIRST_FAILURE).otherwise(left + NEXT_FAILURE)
        return F.struct((first + NEXT_FAILURE * (at["n"] - 1)).alias("p"), at["day"].alias("last"))

    start = F.struct(F.lit(0.0).alias("p"), F.lit(None).cast("long").alias("last"))
    return days.select("site", F.aggregate("days", start, charge).alias("x")).select(
        "site", F.col("x.p").alias("penalty"), F.col("x.last").alias("last_failure")
    )


def facet_query(feedback: DataFrame, axis: str, value: str, since: Column) -> DataFrame:
    """Candidates whose latest event on the axis has the value and isn't older."""
    latest = latest_by(feedback.filter(F.col("axis") == axis), ["candidate_id"])
    return latest.filter((F.col("value") == value) & (F.col("created_at") >= since))


def served_section(served: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The section in which a candidate was last served; curated where one cycle served it in both."""
    last = F.max_by("section", F.struct("cycle", (F.col("section") != "broad").alias("curated")))
    return served.groupBy(*(keys or ["candidate_id"])).agg(last.alias("section"))


def detect_saved(new: DataFrame, served: DataFrame, archived: DataFrame, saved: DataFrame, key: str = "url_key") -> DataFrame:
    """Bookmarks that were served, and are neither archived nor saved before: implicit saves, one per key."""
    return (
        new.join(served.select(key).distinct(), key, "left_semi")
        .join(archived.select(key), key, "left_anti")
        .join(saved.select(key), key, "left_anti")
        .groupBy(key)
        .agg(F.min("id").alias("id"))
    )


def coalesce_outbox(commands: DataFrame) -> DataFrame:
    """key, op, payload, version: the last command of a key, with the last payload since its last delete, and their
    number. Plain aggregates, so a hot key is added up before it moves."""
    put = (F.col("op") != "delete") & F.col("payload").isNotNull()
    folded = commands.groupBy("key").agg(
        F.max_by("op", "id").alias("op"),
        F.max_by(F.when(put, F.col("payload")), F.when(put, F.col("id"))).alias("last_payload"),
        F.max(F.when(put, F.col("id"))).alias("put_at"),
        F.max(F.when(F.col("op") == "delete", F.col("id"))).alias("gone_at"),
        F.count(F.lit(1)).alias("version"),
    )
    alive = F.col("gone_at").isNull() | (F.col("put_at") > F.col("gone_at"))
    return folded.select("key", "op", F.when(alive, F.col("last_payload")).alias("payload"), "version")


def retry_delay(status: Column, attempts: Column) -> Column:
    """Seconds until the next try: 60 doubled for each attempt, an hour at most; null where it failed for good or worked."""
    again = (status == 0) | (status == 429) | (status >= 500)
    return F.when(again, F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), attempts)))
