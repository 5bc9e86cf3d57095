"""State that lasts: events months later, and across a restart from the checkpoint."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.streaming import stateful
from feedloom.streaming.events import run_once

START = datetime(2024, 1, 1)


@pytest.fixture
def state(spark):
    for k, v in stateful.ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    for k in stateful.ROCKSDB:
        spark.conf.unset(k)


def write(spark, folder, n, rows):
    df = spark.createDataFrame([(i, k, START + timedelta(minutes=m)) for i, k, m in rows], "id long, key string, created_at timestamp")
    df.coalesce(1).write.parquet(f"{folder}/in/part={n}")


def run(spark, folder, transform):
    stream = spark.readStream.schema("id long, key string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    run_once(transform(stream), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/check")


def result(spark, folder, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select(*columns).collect())


def test_a_key_is_never_forgotten(state, tmp_path):
    days = 24 * 60
    write(state, tmp_path, 0, [(3, "a", 2), (1, "a", 0), (2, "b", 1)])
    write(state, tmp_path, 1, [(4, "a", 60 * days), (5, "c", 61 * days)])
    run(state, tmp_path, lambda s: stateful.once_ever(s, "key"))
    write(state, tmp_path, 2, [(6, "b", 200 * days), (7, "c", 0), (8, "d", 0)])  # after a restart
    run(state, tmp_path, lambda s: stateful.once_ever(s, "key"))
    assert result(state, tmp_path, "id", "key") == [(1, "a"), (2, "b"), (5, "c"), (8, "d")]


def test_changes_are_due_after_the_last_one(state, tmp_path):
    write(state, tmp_path, 0, [(1, "a", 0), (2, "a", 5), (3, "b", 0), (4, "a", 14)])
    write(state, tmp_path, 1, [(5, "a", 20), (6, "b", 30)])
    run(state, tmp_path, lambda s: stateful.debounced(s, "key"))
    write(state, tmp_path, 2, [(7, "z", 60 * 24 * 60)])  # after a restart, months later: all that is due comes
    write(state, tmp_path, 3, [(8, "z", 61 * 24 * 60)])
    run(state, tmp_path, lambda s: stateful.debounced(s, "key"))
    rows = result(state, tmp_path, "key", F.unix_timestamp("due").alias("due"), "changes")
    local = int(START.timestamp())
    assert [(k, (due - local) // 60, n) for k, due, n in rows if k != "z"] == [("a", 30, 4), ("b", 10, 1), ("b", 40, 1)]
    assert [(n, (due - local) // 60 - 60 * 24 * 60) for k, due, n in rows if k == "z"] == [(1, 10)]
