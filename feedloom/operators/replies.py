"""Texts on the way to models and back: slices of replies, chunks, batches, dates and addresses of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and rows and characters of a batch that is embedded at once.
CHUNK, BATCH_ROWS, BATCH_CHARS, TEXT_CHARS = 3_000, 32, 65_536, 4_096


def reply_slice(reply: Column) -> Column:
    """What stands from the first [ to the last ] of a model's reply, or null."""
    low, back = F.instr(reply, "["), F.instr(F.reverse(reply), "]")
    high = F.length(reply) - back + 1
    return F.when((low > 0) & (back > 0) & (high > low), F.substring(reply, low, high - low + 1))


def http_url(address: Column) -> Column:
    """An absolute http(s) address without white space, or null; the size that an image's name ends with is removed."""
    bare = F.trim(address)
    sized = F.regexp_replace(bare, r"-[0-9]{2,4}x[0-9]{2,4}(\.[A-Za-z]{3,4})$", "$1")
    return F.when(bare.rlike(r"(?i)^https?://[^\s/]+\S*$"), sized)


def page_date(address: Column, published: Column) -> Column:
    """A page's own date: what its head says, else the one in its address, or null."""
    said = F.to_date(F.regexp_extract(published, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    parts = [F.lpad(F.regexp_extract(address, r"/(20[0-9]{2})[/-]([01]?[0-9])[/-]([0-3]?[0-9])(?:/|-|$)", k), 2 if k > 1 else 4, "0") for k in (1, 2, 3)]
    there = F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
    return F.coalesce(F.when(published.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), said), F.when(address.rlike(r"/20[0-9]{2}[/-][01]?[0-9][/-][0-3]?[0-9](?:/|-|$)"), there))


def folded(sizes: Column, most: int, rows: int = 1 << 30) -> Column:
    """Numbers of the chunks of a list of sizes, in order: a chunk ends before it would hold more than `most`, or more rows."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        ends = (s["n"] > 0) & ((s["held"] + size > most) | (s["n"] >= rows))
        chunk = s["chunk"] + ends.cast("int")
        held, n = F.when(ends, F.lit(0).cast("long")).otherwise(s["held"]) + size, F.when(ends, F.lit(0)).otherwise(s["n"]) + 1
        return F.struct(chunk.alias("chunk"), held.cast("long").alias("held"), n.alias("n"), F.array_append(s["out"], chunk).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def embed_pending(rows: DataFrame, embed, key: str = "id") -> DataFrame:
    """key, vector of rows of key, text, url: a text, or its address, cut to TEXT_CHARS, in batches of BATCH_ROWS and
    BATCH_CHARS at most. Rows of a batch for which embed(texts) fails are left out, and so stay pending."""
    kind = rows.schema[key].dataType.simpleString()
    text = F.substring(F.coalesce(F.nullif("text", F.lit("")), F.nullif("url", F.lit("")), F.lit("untitled")), 1, TEXT_CHARS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low, size = 0, 0
            lengths = frame["text"].str.len().tolist()
            for i, n in enumerate([*lengths, BATCH_CHARS + 1]):
                if i > low and (size + n > BATCH_CHARS or i - low >= BATCH_ROWS or i == len(lengths)):
                    part = frame.iloc[low:i]
                    low, size = i, 0
                    try:
                        vectors = embed(part["text"].tolist())
                    except Exception:  # a failed call costs its batch, whatever went wrong there
                        continue
                    yield pd.DataFrame({key: part[key].to_numpy(), "vector": [list(map(float, v)) for v in vectors]})
                size += n

    return rows.select(key, text.alias("text")).mapInPandas(run, f"{key} {kind}, vector array<double>")
