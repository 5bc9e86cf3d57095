"""The subpackage's queries: opN_<name> applies operator N to its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .collocations import phrase_graph
from .common import documents
from .exact_dedup import exact_duplicates
from .fuzzy import edited_fingerprints
from .jaccard import JaccardJoin
from .language import fit_dictionaries, identify_languages, remainder
from .main_text import main_texts
from .mixing import mix_sources
from .pieces import digest_documents
from .quality import quality_scores
from .suffix_dedup import repeated_spans
from .suffix_tree_lm import SuffixTreeModel
from .token_counts import count_tokens
from .whitening import whiten

#: A folder with the public tokenizers' vocabulary files; without one, each machine takes those it has installed.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR")


def piece_model() -> str:
    return f"{TOKENIZERS}/piece_bpe_32k.model" if TOKENIZERS else "piece_bpe_32k.model"


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SuffixTreeModel(documents(spark, sf_dir), remainder("doc_id", 10) == 0).score()


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(documents(spark, sf_dir)).components().drop("class_id")


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(documents(spark, sf_dir)).link_counts()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), piece_model())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).drop("spans")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(documents(spark, sf_dir), labels, ~held_out).withColumn("held_out", held_out)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 4) == 2
    dictionaries = fit_dictionaries(docs.filter(~held_out))
    return identify_languages(docs, dictionaries).withColumn("held_out", held_out)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir), piece_model())


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).documents().drop("source")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph(documents(spark, sf_dir)).top()


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op3_jaccard_links": op3_jaccard_links,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_pieces": op9_pieces,
    "op10_mix_sources": op10_mix_sources,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_main_text": op13_main_text,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
            FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
            FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents
            UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
        )
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
        FROM documents d LEFT JOIN sizes s USING (doc_id)
        JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
    """,
    "op3_jaccard_links": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
            FROM words
        ), classes AS (
            SELECT doc_id, s, len(s)::BIGINT AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM sets
        ), shingles AS (SELECT class_id, n, unnest(s) AS g FROM classes WHERE doc_id = class_id
        ), shared AS (
            SELECT a.class_id AS x, b.class_id AS y, count(*) AS k, any_value(a.n + b.n) AS of_both
            FROM shingles a JOIN shingles b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY ALL
        ), links AS (SELECT x, count(*) AS n_links FROM shared WHERE 100 * k >= 75 * (of_both - k) GROUP BY x)
        SELECT doc_id, n AS n_shingles, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM classes LEFT JOIN links ON x = class_id
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
            FROM documents
        ), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, g, count(*) AS f FROM (
                SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
                FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
            ) GROUP BY ALL
        ), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
        ), often AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM grams WHERE f >= 10
        ), holders AS (
            SELECT lang, g, max(f) AS longer FROM (
                SELECT lang, f, array_to_string(w[1:2], ' ') AS g FROM often WHERE k = 3
                UNION ALL SELECT lang, f, array_to_string(w[2:3], ' ') FROM often WHERE k = 3
            ) GROUP BY lang, g
        ), kept AS (
            SELECT o.* FROM often o LEFT JOIN holders h USING (lang, g) WHERE o.k >= 2 AND NOT (o.k = 2 AND coalesce(100 * h.longer >= 50 * o.f, false))
        ), cuts AS (
            SELECT lang, g, f AS a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS rest
            FROM kept, (VALUES (1), (2)) AS ends(c) WHERE c < k
        ), sides AS (
            SELECT t.lang, t.g, t.a, t.c, x.f AS l, y.f AS r, ((1000000::HUGEINT * t.a * t.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts t JOIN often x ON x.lang = t.lang AND x.g = t.head JOIN often y ON y.lang = t.lang AND y.g = t.rest
        ), best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
        FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
}
