"""Latest event per key, first-wins merges, and snapshot transforms in place of updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_by(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row of each key with the largest order: one aggregate, whose partial step runs before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_first_wins(key: str, *tables: DataFrame) -> DataFrame:
    """Tables with the same columns, one under the other; of a key the first table's first row by id stays."""
    placed = [t.withColumn("__prio", F.lit(i)) for i, t in enumerate(tables)]
    return first_by(reduce(DataFrame.unionByName, placed), [key], "__prio", "id").drop("__prio")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str = "id") -> DataFrame:
    """old and those rows of new whose key is in neither old nor earlier in new."""
    return old.unionByName(first_by(new, [key], order).join(old, key, "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, key: str, order: str = "id") -> DataFrame:
    """new over old: of a key the row of new with the largest order, else that of old."""
    return old.join(new, key, "left_anti").unionByName(latest_by(new, [key], order).select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, compared: list[str], flag: str) -> DataFrame:
    """Both tables by key, values of new first; flag falls to false where a compared value changed or the key is new."""
    o, n = old.alias("o"), new.alias("n")
    changed = reduce(lambda a, c: a | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), compared, F.lit(False))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    seen = F.col(f"n.{key}").isNotNull()
    values = [F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in compared]
    kept = F.when(~seen, F.col(f"o.{flag}")).when(F.col(f"o.{key}").isNull() | changed, False).otherwise(F.col(f"o.{flag}"))
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *values, kept.alias(flag))


def cascade(table: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """The rows whose parent survives."""
    return table.join(survivors, key, "left_semi")
