"""Delivery of saved stories: one row per link that commands are folded into, the record that is sent, and what answers do to the rows.

A row is settled by its link, version and attempts. So an answer to a row that changed
while it was sent leaves the newer row alone, and an answer that is read twice, after a
batch was run again, settles nothing a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.latest import latest_by

#: A row of the outbox; `at` and `due_at` are seconds.
ROW = "link_id long, op string, discussion string, updated_at string, due_at double, attempts int, last_error string, state string, version long"
ANSWER = "link_id long, version long, attempts int, status int, error string"
#: The contract's version and shapes, seconds of the first wait and of the longest, rows sent at once.
CONTRACT = 1
TALK = "array<struct<role: string, content: string, searches: array<struct<query: string, results: array<struct<title: string, url: string>>>>>>"
MARK = ("color", "start", "end", "quote", "prefix", "suffix")
FIRST_WAIT, LONGEST_WAIT, BATCH = 60.0, 3600.0, 50
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def queued(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """rows with commands folded in. commands: id, link_id, op (put or delete), discussion, at, delay, updated_at, in the order of their ids.

    A put without a discussion keeps the one that waits; a delete forgets it, and so does the put after a delete.
    Links without a positive id are not the receiver's and queue nothing. A changed row is pending again, from its first attempt."""
    gone, said = F.col("op") == "delete", F.col("discussion").isNotNull() & (F.col("op") == "put")
    last = F.max_by(F.struct("op", "updated_at", (F.col("at") + F.col("delay")).alias("due_at")), "id")
    news = (
        commands.filter("link_id > 0")
        .groupBy("link_id")
        .agg(
            last.alias("last"),
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(gone, F.col("id"))).alias("gone"),
            F.max(F.when(said, F.col("id"))).alias("said"),
            F.max_by(F.when(said, F.col("discussion")), F.when(said, F.col("id"))).alias("words"),
        )
    )
    after = F.when(F.col("said") > F.coalesce("gone", F.lit(-1)), F.col("words"))
    waiting = F.when(F.col("gone").isNull() & (F.col("op") == "put"), F.col("discussion"))
    both = rows.join(news, "link_id", "full_outer")
    new = F.col("n").isNotNull()
    return both.select(
        "link_id",
        F.coalesce("last.op", "op").alias("op"),
        F.when(~new, F.col("discussion")).when(F.col("last.op") == "put", F.coalesce(after, waiting)).alias("discussion"),
        F.coalesce("last.updated_at", "updated_at").alias("updated_at"),
        F.coalesce("last.due_at", "due_at").cast("double").alias("due_at"),
        F.when(new, 0).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(~new, F.col("last_error")).alias("last_error"),
        F.when(new, "pending").otherwise(F.col("state")).alias("state"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("version"),
    )


def due(rows: DataFrame, now: float, most: int = BATCH) -> DataFrame:
    """The rows to send now, the longest due first."""
    return rows.filter((F.col("state") == "pending") & (F.col("due_at") <= now)).orderBy("due_at", "link_id").limit(most)


def records(rows: DataFrame, saves: DataFrame, candidates: DataFrame, articles: DataFrame, marks: DataFrame, votes: DataFrame) -> DataFrame:
    """link_id, op, version, attempts, record: what is sent for each row, from the tables as they are now.

    saves: link_id, url, url_key, title, section, collection_id, created_at; candidates: candidate_id, url, source;
    articles: candidate_id, lang; marks: candidate_id, variant (orig or tr), id and the columns of MARK; votes: url_key, id, value.
    A delete has no record; neither has a put whose save is gone: such a row is dropped, as the unsave queued its own delete."""
    puts = rows.filter("op = 'put'").join(saves, "link_id")
    known = puts.join(latest_by(candidates.select("candidate_id", "url", "source"), ["url"], "candidate_id"), "url", "left")
    langs = articles.groupBy("candidate_id").agg(F.max("lang").alias("lang"))
    place = F.struct(F.when(F.col("variant") == "orig", 0).otherwise(1).alias("v"), "id", "variant", *MARK)
    own = marks.groupBy("candidate_id").agg(F.sort_array(F.collect_list(place)).alias("marked"))
    interest = latest_by(votes.select("url_key", "id", F.col("value").alias("interest")), ["url_key"]).drop("id")
    full = known.join(langs, "candidate_id", "left").join(own, "candidate_id", "left").join(interest, "url_key", "left")
    highlights = F.transform(F.coalesce("marked", F.array().cast(full.schema["marked"].dataType)), lambda m: F.struct(m["variant"].alias("variant"), *(m[c].alias(c) for c in MARK)))
    record = F.struct(
        F.lit(CONTRACT).alias("v"), "url", "url_key", "title", "lang", F.col("collection_id").cast("long").alias("collection_id"), "section", "source",
        F.date_format("created_at", STAMP).alias("saved_at"), "updated_at", "interest", highlights.alias("highlights"),
        F.from_json("discussion", TALK).alias("discussion"),
    )
    sent = full.select("link_id", "op", "version", "attempts", record.alias("record"))
    return sent.unionByName(rows.filter("op = 'delete'").select("link_id", "op", "version", "attempts", F.lit(None).cast(sent.schema["record"].dataType).alias("record")))


def kind(status: Column) -> Column:
    """sent, retry or failed: no answer at all (0), too many requests and errors of the receiver are tried again."""
    return F.when(status.between(200, 299), "sent").when((status == 0) | (status == 429) | (status >= 500), "retry").otherwise("failed")


def wait(attempts: Column) -> Column:
    return F.least(FIRST_WAIT * F.pow(F.lit(2.0), attempts), F.lit(LONGEST_WAIT))


def settled(rows: DataFrame, answers: DataFrame, now: float) -> DataFrame:
    """rows after answers (ANSWER): sent ones are gone, others wait or have failed for good, without their discussion."""
    own = latest_by(answers, ["link_id", "version", "attempts"], "status").select("link_id", "version", "attempts", "status", "error")
    out = rows.join(own, ["link_id", "version", "attempts"], "left").withColumn("kind", kind(F.col("status")))
    again, failed = F.coalesce(F.col("kind") == "retry", F.lit(False)) & F.col("status").isNotNull(), F.col("status").isNotNull() & (F.col("kind") == "failed")
    kept = out.filter(F.col("status").isNull() | (F.col("kind") != "sent"))
    return kept.select(
        "link_id",
        "op",
        F.when(~failed, F.col("discussion")).alias("discussion"),
        "updated_at",
        F.when(again, F.lit(now) + wait(F.col("attempts"))).otherwise(F.col("due_at")).alias("due_at"),
        (F.col("attempts") + again.cast("int")).cast("int").alias("attempts"),
        F.when(again | failed, F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status")))).otherwise(F.col("last_error")).alias("last_error"),
        F.when(failed, "failed").otherwise(F.col("state")).alias("state"),
        "version",
    )


def answered_by(sent: DataFrame, send: Callable[[str, int, str | None], tuple[int, str | None]]) -> DataFrame:
    """The answers to records(): send(op, link, record as JSON) runs in the tasks and returns a status, 0 for none, and an error."""
    ready = sent.select("link_id", "version", "attempts", "op", F.to_json("record", {"ignoreNullFields": "false"}).alias("record"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [send(r.op, int(r.link_id), r.record) for r in part.itertuples()]
            yield part[["link_id", "version", "attempts"]].assign(status=[s for s, _ in got], error=[e for _, e in got])

    return ready.mapInPandas(run, ANSWER)


def delivery(path: str, send: Callable[[str, int, str | None], tuple[int, str | None]]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch over records(): sends what no earlier batch has sent and keeps the answers of each batch in a folder of its own.

    A batch that is run again finds its folder whole and sends nothing, or writes over what it had begun."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(hadoop(f"{path}/batch={number}/_SUCCESS")):
            return
        earlier = answers(spark, path, number)
        fresh = batch.join(earlier, ["link_id", "version", "attempts"], "left_anti") if earlier is not None else batch
        answered_by(fresh, send).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def answers(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The answers that finished batches have kept, or null where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [x.getPath().getParent() for x in files.globStatus(hadoop(f"{path}/batch=*/_SUCCESS")) or []]
    folders = [str(p.toString()) for p in done if before is None or int(p.getName().removeprefix("batch=")) < before]
    return spark.read.schema(ANSWER).parquet(*folders) if folders else None
