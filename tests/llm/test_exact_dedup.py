import hashlib

import numpy as np
import pytest

from feedloom.llm.exact_dedup import cut_points, drop_exact_duplicates, exact_duplicates

LONG = "".join(chr(97 + i) for i in np.random.default_rng(1).integers(0, 26, 50_000))
ROWS = [(1, "a b", "x"), (2, "a b", "x"), (3, None, "x"), (4, "", "x"), (5, "a b ", None), (6, LONG, "x"), (7, LONG, "x"),
        (8, LONG[:-1], "x"), (9, LONG[:20_000] + "!" + LONG[20_001:], "x"), (9, LONG, "x"), (2, "a b", "x"), (None, "a b", "x"), (None, "só", "x")]


def expected(rows):
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text, _ in rows:
        ids = groups[text or ""]
        keep = max([x for x in ids if x is not None], default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_bytes", [16, 0, 1])
def test_matches_grouping_by_text_even_when_hashes_collide(spark, hash_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    got = exact_duplicates(docs, hash_bytes=hash_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_stage_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None], "doc_id long, text string, kept string")
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) == [2, 4, 5, 8, 9]


def test_stage_keeps_one_of_equal_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (None, "a"), (2, None), (2, "")]
    out = drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in out if r.doc_id) == [(1, "a"), (2, "")] and [r.text for r in out if r.doc_id is None] == ["b"]


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_follow_content_and_respect_bounds():
    data = LONG.encode()
    cuts = cut_points(data)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(data) and sizes[:-1].min() >= 1024 and sizes.max() <= 16384
    moved = {len(data) - c for c in cuts[:-1]} & {len(data) + 7 - c for c in cut_points(b"1234567" + data)[:-1]}
    assert len(moved) >= len(cuts) // 2
