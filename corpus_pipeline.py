"""From raw documents to encoded training rows: the stages, in their order.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last keep the columns of documents. run() writes what a
stage returns and reads it again for the next one.

Defined results, in every stage: null texts count as empty ones; rows may repeat, with
or without ids; empty tables give empty tables; other columns are carried along, and
their names can't clash with those that a stage makes up. The last stage needs the
columns doc_id, lang, source and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import common, exact_dedup, jaccard, language, mixing, pieces
from feedloom.llm.queries import piece_model
from feedloom.session import ready


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; dictionaries are fitted on labelled rows whose remainder isn't 2.

    Texts that are null or have no letters are rejected; without any label nothing can be told, and all go."""
    ready(spark)
    dictionaries = language.fit_dictionaries(docs.filter(language.remainder("doc_id", 4) != 2))
    return language.keep_identified(docs, dictionaries)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is the least, and of equal rows any one stays."""
    ready(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that links connect, the document with the smallest id, null last; texts without words all stay."""
    ready(spark)
    return jaccard.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and epoch, with the words that the mix takes; a null source comes last, a text without words is never taken."""
    ready(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, byte spans and digests of every row's text, with its document's id, language and source; an empty text has the begin and end ids alone."""
    ready(spark)
    return pieces.encode_rows(docs, piece_model(), ["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix),
    ("encode_pieces", encode),
]

#: Compression and piece merging are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
