"""Language identification by compression.

Each language has a zstandard raw-content dictionary: passages of labelled
documents, laid end to end. A text is brought to lower case, what isn't a letter
becomes a space, and it is cut into segments; every segment is encoded with every
dictionary, and the language whose encodings are smallest in sum is the guess. The
margin is the part by which the smallest sum is below the second smallest. Where
it is narrow, which whole bytes make likely for short texts, the tails of every
segment from each of its words are encoded, too. A text is rejected when the
margin then still is narrow.

Dictionaries are fitted on a bounded sample: at most SAMPLE_TEXTS distinct texts
of a language, those whose hashes are smallest, with PASSAGE_CHARS characters of
each, from a place that the hash gives. All rows are looked
at for the sample, and every whole text is scored.

Defined results: a null text, and a text without letters, is `und` with score 0
and rejected; labels that are null teach nothing; equal sums go to the language
that sorts first; with no labelled text at all everything is `und`; with one
language every text with letters is of it, with score 1. Rows and ids may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, join_small, sliced

SAMPLE_TEXTS, PASSAGE_CHARS, SEGMENT_CHARS, LEVEL = 500, 700, 500, 3
#: Below this margin a text is rejected.
MARGIN = 0.0005
NO_LETTERS = re.compile(r"[\W\d_]+")
#: Few labelled languages are expected; each one costs an encoding of every text.
MOST_LANGUAGES = 1_000


def passages(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = PASSAGE_CHARS) -> DataFrame:
    """lang, u, passage: the bounded sample, from lang and text.

    u is a hash of the text, so copies fall together and count once. A first cut at
    four times the wanted share of the distinct texts, whose number is known to some
    hundredths, leaves few rows for the window that takes the least."""
    rows = labelled.filter("lang is not null and text <> ''").select(
        "lang", "text", (F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(1 << 40)).alias("u")
    )
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("u").alias("n"), F.min("u").alias("least"))
    n = counts.count()
    near = join_small(rows, counts, ["lang"], n).filter(
        (F.col("u") <= F.lit(4.0 * texts) / F.col("n")) | (F.col("u") == F.col("least"))
    )
    start = F.floor(F.col("u") * F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    ranked = (
        near.select("lang", "u", F.substring(F.col("text"), start, F.lit(chars)).alias("passage"))
        .dropDuplicates(["lang", "u"])
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("u")))
    )
    return ranked.filter(F.col("rank") <= texts).drop("rank")


def fit_dictionaries(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = PASSAGE_CHARS) -> dict[str, bytes]:
    """The raw content of each language's dictionary, about texts * chars characters at most."""
    found: dict[str, list[str]] = {}
    for row in passages(labelled, texts, chars).collect():  # bounded by languages * texts * chars
        found.setdefault(row.lang, []).append(letters(row.passage))
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{len(found)} languages are labelled; at most {MOST_LANGUAGES} are expected")
    return {lang: "".join(sorted(found[lang])).encode() for lang in sorted(found)}


def letters(text: str) -> str:
    """The words of text in lower case, each with a space before it."""
    return " " + NO_LETTERS.sub(" ", text.lower()).strip()


def encoders(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in sorted(dictionaries.items()):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, by_lang: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """The language and the margin of a text."""
    low = letters(text or "")
    if low == " " or not by_lang:
        return "und", 0.0
    if len(by_lang) == 1:
        return by_lang[0][0], 1.0
    parts = [low[i : i + SEGMENT_CHARS].encode() for i in range(0, len(low), SEGMENT_CHARS)]
    sums = {lang: sum(len(c.compress(p)) for p in parts) for lang, c in by_lang}
    (best, lang), (second, _) = sorted((n, lang) for lang, n in sums.items())[:2]
    if best > second * (1 - MARGIN):
        for i in range(0, len(low), SEGMENT_CHARS):
            words = low[i : i + SEGMENT_CHARS].split(" ")
            tails = [" ".join(["", *words[i:]]).encode() for i in range(2, len(words))]
            tails += [(" " + w).encode() for w in words]
            sums = {lang: sums[lang] + sum(len(c.compress(p)) for p in tails) for lang, c in by_lang}
        (best, lang), (second, _) = sorted((n, lang) for lang, n in sums.items())[:2]
    return lang, 1.0 - best / second


def _classifier(dictionaries: dict[str, bytes], lang_name: str, score_name: str):
    """Replaces the last column, the text, by its language and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang = encoders(dictionaries)
        for batch in sliced(batches):
            got = [classify(t, by_lang) for t in batch.column(batch.num_columns - 1).to_pylist()]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            langs, scores = pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, langs, scores], [*batch.schema.names[:-1], lang_name, score_name])

    return run


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus))


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_classifier(dictionaries, "__lang", "__score"), f"doc_id {kind}, __lang string, __score double")
    rejected = (F.col("__lang") == "und") | (F.col("__score") < MARGIN)
    return out.select("doc_id", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), rejected.alias("rejected"))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    rows = docs.withColumn(fresh(docs, "text_again"), F.col(text_col))
    out = rows.mapInArrow(_classifier(dictionaries, lang, score), f"{kinds}, {lang} string, {score} double")
    return out.filter((F.col(lang) != "und") & (F.col(score) >= MARGIN)).select(*docs.columns)
