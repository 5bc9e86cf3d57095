"""The feedback log as a stream: once-per-key events, latest votes, debounced changes.

Streams take timestamps with a zone; cast naive ones first, in UTC. State stays
bounded by the watermark: a key may be kept again once it is older than that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.latest import latest_by


def once_per_key(events: DataFrame, key: str, ts: str = "created_at", delay: str = "30 days") -> DataFrame:
    """The first event of each key, for as long as the watermark remembers it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def debounced(events: DataFrame, key: str, ts: str = "created_at", gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """key, due, changes: runs of changes no more than `gap` apart, due so long after the last one."""
    runs = events.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w"))
    return runs.agg(F.count(F.lit(1)).alias("changes")).select(key, F.col("w.end").alias("due"), "changes")


def keep_latest(path: str, keys: list[str], order: str = "id", run: str = "0") -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: every batch writes a new snapshot of the latest event per key, and the one before the last goes.

    A batch that is run again writes the same folder from the same older one. `run` names the stream's checkpoint: the
    first batch of a new one starts from the newest snapshot of the run that sorts last, and never writes over it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, folder = _files(spark, path)
        mine = sorted(n for r, n in _snapshots(spark, path) if r == run and n < number)
        others = sorted((x for x in _snapshots(spark, path) if x[0] != run), key=lambda x: (x[0], x[1]))
        before = (run, mine[-1]) if mine else others[-1] if others else None
        rows = latest_by(batch, keys, order)
        if before:
            old = spark.read.parquet(f"{path}/snapshot={before[0]}-{before[1]}")
            rows = latest_by(old.select(batch.columns).unionByName(batch), keys, order)
        rows.select(batch.columns).write.mode("overwrite").parquet(f"{path}/snapshot={run}-{number}")
        for n in mine[:-1]:
            fs.delete(folder(f"snapshot={run}-{n}"), True)

    return write


def newest(spark: SparkSession, path: str, run: str = "0") -> DataFrame:
    """The newest snapshot of a run."""
    return spark.read.parquet(f"{path}/snapshot={run}-{max(n for r, n in _snapshots(spark, path) if r == run)}")


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: hadoop(f"{path}/{name}")


def _snapshots(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Runs and numbers of finished snapshots."""
    fs, folder = _files(spark, path)
    found = fs.globStatus(folder("snapshot=*/_SUCCESS")) or []
    names = [x.getPath().getParent().getName().removeprefix("snapshot=").rpartition("-") for x in found]
    return [(run, int(n)) for run, _, n in names]


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that has come since the last run, then stop: the poll of a scheduler."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
