"""The outbox: the contract's record, the rules of its rows, and a sink that may be run again."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import outbox
from feedloom.streaming.events import run_once

EXAMPLE = json.loads(
    '{"v":1,"url":"https://www.Example.com/a/?utm_source=x&b=1#top","url_key":"example.com/a?b=1","title":"Example","lang":"en","collection_id":17,"section":"curated",'
    '"source":"hackernews","saved_at":"2026-10-29T05:27:29Z","updated_at":"2026-10-29T05:40:00Z","interest":"up","highlights":[{"variant":"orig","color":"red","start":0,'
    '"end":7,"quote":"Example","prefix":"","suffix":" text"}],"discussion":[{"role":"user","content":"I think this is wrong.","searches":[]},{"role":"assistant","content":'
    '"Here is why it might be right.","searches":[{"query":"example","results":[{"title":"E","url":"https://e.example"}]}]}]}'
)
COMMAND = "id long, link_id long, op string, discussion string, at double, delay double, updated_at string"
TALK = '[{"role":"user","content":"mine","searches":[]}]'


def tables(spark):
    e = EXAMPLE
    return {
        "saves": spark.createDataFrame([(1074, e["url"], e["url_key"], "Example", "curated", 17)], "link_id long, url string, url_key string, title string, section string, collection_id long").withColumn(
            "created_at", F.lit("2026-10-29 05:27:29").cast("timestamp_ntz")
        ),
        "candidates": spark.createDataFrame([(1, e["url"], "hackernews"), (2, "https://other", "rss")], "candidate_id long, url string, source string"),
        "articles": spark.createDataFrame([(1, "en")], "candidate_id long, lang string"),
        "marks": spark.createDataFrame([(1, "orig", 5, "red", 0, 7, "Example", "", " text")], "candidate_id long, variant string, id long, color string, start int, end int, quote string, prefix string, suffix string"),
        "votes": spark.createDataFrame([(e["url_key"], 1, "down"), (e["url_key"], 2, "up")], "url_key string, id long, value string"),
    }


def empty(spark):
    return spark.createDataFrame([], outbox.ROW)


def put(spark, rows, *commands):
    full = [(i, *c) for i, c in enumerate(commands)]
    return outbox.queued(rows, spark.createDataFrame(full, COMMAND))


def one(rows):
    (row,) = rows.collect()
    return row


def test_record_is_the_contracts(spark):
    rows = put(spark, empty(spark), (1074, "put", json.dumps(EXAMPLE["discussion"]), 0.0, 0.0, "2026-10-29T05:40:00Z"))
    sent = outbox.records(rows, **tables(spark))
    got = one(sent.select(F.to_json("record", {"ignoreNullFields": "false"}).alias("j")))
    assert json.loads(got.j) == EXAMPLE


def test_record_of_little(spark):
    t = tables(spark)
    t |= {k: t[k].limit(0) for k in ("candidates", "articles", "marks", "votes")}
    rows = put(spark, empty(spark), (1074, "put", None, 0.0, 0.0, "u"), (9, "put", None, 0.0, 0.0, "u"), (8, "delete", None, 0.0, 0.0, "u"))
    got = {r.link_id: r for r in outbox.records(rows, **t).collect()}
    assert set(got) == {1074, 8} and got[8].record is None and got[8].op == "delete"  # the save of 9 is gone
    record = got[1074].record.asDict()
    assert record["highlights"] == [] and [record[k] for k in ("lang", "source", "interest", "discussion")] == [None] * 4


def test_rules_of_rows(spark):
    rows = put(spark, empty(spark), (7, "put", TALK, 100.0, 0.0, "a"), (0, "put", None, 100.0, 0.0, "a"), (-3, "put", None, 100.0, 0.0, "a"))
    row = one(rows)
    assert (row.op, row.discussion, row.state, row.version, row.due_at) == ("put", TALK, "pending", 1, 100.0)

    def answer(rows, status, now=200.0, error=None):
        r = one(rows)
        return outbox.settled(rows, spark.createDataFrame([(r.link_id, r.version, r.attempts, status, error)], outbox.ANSWER), now)

    rows = answer(rows, 503)
    row = one(rows)
    assert (row.attempts, row.due_at, row.discussion, row.last_error, row.state) == (1, 260.0, TALK, "HTTP 503", "pending")
    # a change meanwhile has no discussion of its own and keeps the one that waits
    rows = put(spark, rows, (7, "put", None, 300.0, 600.0, "b"))
    row = one(rows)
    assert (row.discussion, row.updated_at, row.due_at, row.attempts, row.version, row.last_error) == (TALK, "b", 900.0, 0, 2, None)
    assert outbox.due(rows, 899.0).count() == 0 and outbox.due(rows, 900.0).count() == 1
    assert answer(rows, 204).count() == 0
    for status, error in ((429, None), (0, "ConnectError")):
        assert one(answer(rows, status, error=error)).last_error == (error or "HTTP 429")
    rows = answer(rows, 422)
    row = one(rows)
    assert (row.state, row.discussion, row.attempts) == ("failed", None, 0) and outbox.due(rows, 1e9).count() == 0
    # later commands revive it; a delete replaces a put, a put the delete
    rows = put(spark, rows, (7, "put", TALK, 0.0, 0.0, "c"), (7, "delete", None, 0.0, 0.0, "d"))
    row = one(rows)
    assert (row.op, row.state, row.discussion, row.version) == ("delete", "pending", None, 4)
    rows = put(spark, rows, (7, "put", None, 0.0, 0.0, "e"))
    assert (one(rows).op, one(rows).discussion) == ("put", None)
    # a command while the row is on its way: the answer must not take the newer one away
    newer = put(spark, rows, (7, "put", TALK, 0.0, 0.0, "f"))
    sent = one(rows)
    kept = outbox.settled(newer, spark.createDataFrame([(7, sent.version, sent.attempts, 204, None)], outbox.ANSWER), 0.0)
    assert (one(kept).state, one(kept).discussion, one(kept).version) == ("pending", TALK, 6)


@pytest.mark.parametrize(("attempts", "want"), [(0, 60.0), (1, 120.0), (5, 1920.0), (6, 3600.0), (40, 3600.0)])
def test_waits(spark, attempts, want):
    assert spark.createDataFrame([(attempts,)], "a int").select(outbox.wait(F.col("a"))).first()[0] == want


def test_longest_due_come_first(spark):
    rows = put(spark, empty(spark), *((i, "put", None, float(100 - i), 0.0, "u") for i in range(1, 61)))
    got = outbox.due(rows, 1000.0).collect()
    assert len(got) == 50 and {r.link_id for r in got} == set(range(11, 61))


def test_a_repeated_batch_sends_and_settles_nothing_twice(spark, tmp_path):
    log, kept = tmp_path / "sent", f"file://{tmp_path}/answers"
    log.mkdir()

    def send(op, link, record, log=str(log)):
        import uuid

        with open(f"{log}/{link}-{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([op, record]))
        return (503 if link == 2 else 204), None

    rows = put(spark, empty(spark), *((i, "put", None, 0.0, 0.0, "u") for i in (1, 2, 3)))
    record = F.struct(F.col("updated_at"))
    batch = rows.select("link_id", "op", "version", "attempts", record.alias("record"))
    sink = outbox.delivery(kept, send)
    assert outbox.answers(spark, kept) is None
    sink(batch, 0)
    sink(batch, 0)  # run again whole
    sink(batch, 1)  # the same rows once more, in a later batch
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == ["1", "2", "3"]
    after = outbox.settled(rows, outbox.answers(spark, kept), 10.0)
    assert [(r.link_id, r.attempts, r.due_at) for r in after.collect()] == [(2, 1, 70.0)]
    twice = outbox.settled(after, outbox.answers(spark, kept), 10.0)
    assert [(r.link_id, r.attempts, r.due_at) for r in twice.collect()] == [(2, 1, 70.0)]
    # begun and not finished: the folder is written over
    (tmp_path / "answers/batch=0/_SUCCESS").unlink()
    (tmp_path / "answers/batch=1/_SUCCESS").unlink()
    sink(batch, 0)
    assert len(list(log.iterdir())) == 6 and outbox.answers(spark, kept).count() == 3


def test_delivery_as_a_stream(spark, tmp_path):
    rows = put(spark, empty(spark), (1, "put", TALK, 0.0, 0.0, "u"), (2, "delete", None, 0.0, 0.0, "u"))
    rows.select("link_id", "op", "version", "attempts", F.when(F.col("op") == "put", F.struct("discussion")).alias("record")).write.parquet(str(tmp_path / "due"))
    stream = spark.readStream.schema("link_id long, op string, version long, attempts int, record struct<discussion: string>").parquet(str(tmp_path / "due"))
    kept = f"file://{tmp_path}/answers"
    for _ in range(2):
        run_once(stream, outbox.delivery(kept, lambda op, link, record: (204 if (op == "put") == (record is not None) else 400, None)), str(tmp_path / "check"))
    assert outbox.settled(rows, outbox.answers(spark, kept), 0.0).count() == 0


def test_commands_are_folded_without_the_texts_of_discussions(spark):
    from feedloom.plans import delivery_queries

    data = "/root/testdata/sf0.001"
    assert delivery_queries._commands(spark, data).agg(F.max(F.length("discussion"))).first()[0] <= 2
    talks = delivery_queries.outbox_rows(spark, data).filter("talk_md5 IS NOT NULL")
    assert 0 < talks.select("talk_md5").distinct().count() <= 60
