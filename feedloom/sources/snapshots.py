"""Several tables as one snapshot: written side by side, then committed by one manifest.

A manifest names the folder and the rows of each table and what else is known about them.
Its file is put in its place by one rename, so a reader sees all tables of a snapshot or
none of it, whatever happens to the job that writes. Folders without a manifest are of
jobs that didn't end; nothing reads them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose rows say if they have a vector, those that only have one, and the one that is made of vectors.
FLAGGED, WITH_VECTORS, DERIVED = ("links", "imports", "candidates"), ("saves", "feedback", "ratings", "opens"), ("profile",)
CURRENT, BACKUPS = "current", "backups"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in its place at once; false where another one is there already."""
    files, at = _files(spark, path)
    draft = at(f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if files.exists(at(path)) or not files.rename(draft, at(path)):
        files.delete(draft, False)
        return False
    return True


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def _numbers(spark: SparkSession, root: str, kind: str) -> list[int]:
    files, at = _files(spark, root)
    found = files.globStatus(at(f"{root}/{kind}/*.json")) or []
    return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"(\d+)\.json", x.getPath().getName())))


class Snapshot:
    """The tables of one manifest, read when asked for."""

    def __init__(self, spark: SparkSession, manifest: dict):
        self.spark, self.manifest = spark, manifest

    @property
    def meta(self) -> dict:
        return self.manifest["meta"]

    @property
    def names(self) -> list[str]:
        return list(self.manifest["tables"])

    def __getitem__(self, name: str) -> DataFrame:
        entry = self.manifest["tables"][name]
        return self.spark.read.schema(entry["schema"]).parquet(entry["path"])

    def rows(self, name: str) -> int:
        return self.manifest["tables"][name]["rows"]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict, kind: str = CURRENT, after: int | None = None) -> int:
    """Write the tables and commit them as the snapshot after `after` (the newest one): its number.

    Where another writer has committed that number meanwhile, nothing of this one becomes visible, and it raises."""
    after = (_numbers(spark, root, kind) or [0])[-1] if after is None else after
    folder = f"{root}/data/{after + 1}-{uuid.uuid4().hex}"
    entries = {}
    for name, table in tables.items():
        path = f"{folder}/{name}"
        table.write.parquet(path)
        rows = spark.read.schema(table.schema).parquet(path).count()
        entries[name] = {"path": path, "rows": rows, "schema": table._jdf.schema().toDDL()}
    if not _write_text(spark, f"{root}/{kind}/{after + 1}.json", json.dumps({"tables": entries, "meta": meta})):
        raise RuntimeError(f"snapshot {after + 1} has been committed by another writer")
    return after + 1


def newest(spark: SparkSession, root: str, kind: str = CURRENT) -> Snapshot | None:
    """The newest committed snapshot, or null."""
    numbers = _numbers(spark, root, kind)
    return Snapshot(spark, json.loads(_read_text(spark, f"{root}/{kind}/{numbers[-1]}.json"))) if numbers else None


def without_vectors(name: str, table: DataFrame) -> DataFrame:
    """A table once the model that made its vectors is gone: flags down, vectors null, what is made of vectors empty."""
    if name in DERIVED:
        return table.limit(0)
    kind = dict(table.dtypes)
    out = {"embedding": F.lit(None).cast(kind["embedding"])} if name in FLAGGED + WITH_VECTORS and "embedding" in kind else {}
    if name in FLAGGED and "embedded" in kind:
        out["embedded"] = F.lit(False)
    return table.withColumns(out) if out else table


def change_model(spark: SparkSession, root: str, model: str, dim: int, stamp: str) -> Snapshot:
    """The newest snapshot under a model's name. Where it was made by another one, all tables are first copied to a
    backup of their own, and a snapshot without vectors follows.

    Each step is one commit, and a run that ended between them takes up where the last commit was: the copy of the
    same snapshot isn't made twice."""
    now = newest(spark, root)
    if now is None or (now.meta.get("model"), now.meta.get("dim")) == (model, dim):
        return now
    number, copied = _numbers(spark, root, CURRENT)[-1], newest(spark, root, BACKUPS)
    if now.meta.get("model") is not None and (copied is None or copied.meta["of"] != number):
        label = re.sub(r"[^A-Za-z0-9._@-]+", "_", str(now.meta["model"]))
        publish(spark, root, {n: now[n] for n in now.names}, now.meta | {"of": number, "label": f"before-{label}-{stamp}"}, BACKUPS)
    if now.meta.get("model") is None:  # the first model: nothing has a vector yet
        publish(spark, root, {n: now[n] for n in now.names}, now.meta | {"model": model, "dim": dim}, after=number)
    else:
        publish(spark, root, {n: without_vectors(n, now[n]) for n in now.names}, now.meta | {"model": model, "dim": dim}, after=number)
    return newest(spark, root)
