"""What several operators share: reading, cutting lineage in the shared folder, joins with small tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="feedloom-")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a local session gets a folder of its own; a
    cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_folder()
    return f"{root}/feedloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and a lost
    executor costs a read."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*written: DataFrame) -> None:
    """Delete the files of tables from materialize() that nothing will read again."""
    for df in written:
        if path := _WRITTEN.pop(df, None):
            sc = df.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def sliced(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes: what Python makes of a slice is several times larger.

    At either end the worker, which serves many tasks, gives back what it no longer needs."""
    release()
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release()


def model_file(model: str) -> str:
    """Where a tokenizer's file lies: model itself if it is a path, else the public tokenizers' file of that name, here on this machine."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def release() -> None:
    """Hand free memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forget(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished steps now: its cleaner waits for the driver to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_small(left: DataFrame, small: DataFrame, on: Column | Sequence[str], rows: int, how: str = "inner") -> DataFrame:
    """left joined with a table of `rows` counted rows: broadcast up to BROADCAST_ROWS, else shuffled."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `keys`, ordered by bucket and then `order`.

    Two levels keep a hot key out of one task: sums run within (keys, bucket), and
    the buckets' totals, a row each, run within keys. The totals are a second
    aggregate over df, so df should be cheap to read again."""
    within = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*keys, bucket)
        .agg(F.sum(value).alias("__total"))
        .select(*keys, bucket, F.coalesce(F.sum("__total").over(over), F.lit(0)).alias("__before"))
    )
    return (
        df.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(totals, [*keys, bucket])
        .withColumn(out, (F.col("__before") + F.col("__own")).cast("long"))
        .drop("__before", "__own")
    )
