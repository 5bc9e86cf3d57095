"""Exact deduplication by content-defined chunk recipes.

A rolling hash cuts every text into chunks where the text itself says so. Equal
chunks are grouped by their bytes, not only by their hash, so an identifier,
(hash, number among the contents that share the hash), stands for one content
alone. A document then is the ordered list of its chunks' identifiers, and equal
lists are equal texts. Chunks move once, reduced to distinct ones per task before
the shuffle; after that only lists of 16-byte identifiers do.

Defined results: a null text counts as empty, and all empty texts are equal; of
equal texts the row with the largest id stays, null ids being the least; rows
repeated with the same id and text all count, and all carry the same verdict; an
empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, materialize, sliced

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 1 << 10, 1 << 14, 12

#: One pseudorandom word for each byte value, from a fixed rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)


def cut_points(data: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of data: after a byte whose preceding 32 bytes hash to `bits` zeros, between
    `least` and `most` bytes after the last cut."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after each round a word covers twice as many bytes
        h[k:] += h[:-k] << np.uint32(k)
    cuts, last = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while end - last > most:
            last += most
            cuts.append(last)
        if end - last >= least and end < n:
            cuts.append(end)
            last = end
    while n - last > most:
        last += most
        cuts.append(last)
    return [*cuts, n]


def _chunks(data: bytes, hash_bytes: int) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    for end in cut_points(data):
        piece = data[at:end]
        yield xxhash.xxh3_128_digest(piece)[:hash_bytes], piece
        at = end


def _recipes(hash_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            shas, recipes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                data = text or b""
                shas.append(hashlib.sha256(data).hexdigest())
                recipes.append([h for h, _ in _chunks(data, hash_bytes)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas), pa.array(recipes, pa.list_(pa.binary()))], ["id", "sha", "recipe"]
            )

    return run


def _contents(hash_bytes: int, positions: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: dict = {"id": [], "pos": [], "h": [], "content": []}
            size = 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for pos, (h, piece) in enumerate(_chunks(text or b"", hash_bytes)):
                    rows["id"].append(row)
                    rows["pos"].append(pos)
                    rows["h"].append(h)
                    rows["content"].append(piece)
                    size += len(piece)
                if size > 4 << 20:
                    yield _batch(rows, positions)
                    rows, size = {k: [] for k in rows}, 0
            yield _batch(rows, positions)

    return run


def _batch(rows: dict, positions: bool) -> pa.RecordBatch:
    arrays = {"h": pa.array(rows["h"], pa.binary()), "content": pa.array(rows["content"], pa.binary())}
    if positions:
        arrays = {"sha": pa.array(rows["id"], pa.string()), "pos": pa.array(rows["pos"], pa.int32())} | arrays
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def document_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """id, sha (SHA-256 of the text), recipe (array of verified chunk identifiers) of every row of docs."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    recipes = texts.mapInArrow(_recipes(hash_bytes), f"id {kind}, sha string, recipe array<binary>")
    recipes = materialize(recipes, "dedup-recipes")
    distinct = (
        texts.filter("text <> ''").mapInArrow(_contents(hash_bytes, False), "h binary, content binary").distinct()
    )
    shared = materialize(
        distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "dedup-collisions"
    )
    if shared.isEmpty():
        return recipes
    # some hashes stand for several contents: those chunks get a number among them, in the order of their bytes
    hit = recipes.filter(F.size("recipe") > 0).select("sha", F.explode(F.array_distinct("recipe")).alias("h"))
    hit = hit.join(shared, "h", "left_semi").select("sha").distinct()
    keyed = texts.filter("text <> ''").select(F.sha2("text", 256).alias("sha"), "text")
    placed = (
        keyed.join(hit, "sha", "left_semi")
        .dropDuplicates(["sha"])
        .mapInArrow(_contents(hash_bytes, True), "sha string, pos int, h binary, content binary")
    )
    numbers = placed.join(shared, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_set("content")).alias("all"))
    numbered = (
        placed.join(numbers, "h", "left")
        .withColumn("number", F.coalesce(F.array_position("all", F.col("content")), F.lit(0)).cast("int"))
        .groupBy("sha")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("h", F.encode(F.format_string(":%d", "number"), "UTF-8")).alias("id")))).alias("l"))
        .select("sha", F.transform("l", lambda x: x["id"]).alias("numbered"))
    )
    return recipes.join(numbered, "sha", "left").select("id", "sha", F.coalesce("numbered", "recipe").alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; keep_id is the id of the row that stays.

    hash_bytes shortens the chunks' hashes; results don't depend on it."""
    recipes = document_recipes(docs, id_col, text_col, hash_bytes)
    groups = recipes.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return recipes.join(groups, "recipe").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns.

    Of rows that share the largest id, or a null one, and the text, any one stays."""
    its_id, its_sha, sha, nth = (fresh(docs, x) for x in ("kept_id", "kept_sha", "text_sha", "nth"))
    stay = (
        exact_duplicates(docs, id_col, text_col)
        .filter("kept")
        .select(F.col("doc_id").alias(its_id), F.col("text_sha256").alias(its_sha))
        .distinct()
    )
    named = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = named.join(stay, F.col(id_col).eqNullSafe(F.col(its_id)) & (F.col(sha) == F.col(its_sha)), "left_semi")
    equal = W.partitionBy(sha).orderBy(F.lit(1))
    return found.withColumn(nth, F.row_number().over(equal)).filter(F.col(nth) == 1).select(*docs.columns)
