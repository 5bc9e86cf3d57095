import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm.collocations import phrase_graph


def brute(rows, longest=3, least=10, share=50, most=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    cand = {x: f for x, f in counts.items() if f >= least and len(x[1]) >= 2}
    covered = Counter()
    for (lang, p), f in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                covered[lang, p[i : i + k]] = max(covered[lang, p[i : i + k]], f)
    out = []
    for (lang, p), a in cand.items():
        if 100 * covered[lang, p] >= share * a:
            continue
        score, _, left, right = min(
            (10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))
        )
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out.sort()
    ranks, got = Counter(), set()
    for lang, score, a, p, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= most:
            got.add((lang, ranks[lang], p.decode(), -a, left, right, totals[lang], -score))
    return got


def found(docs, **how):
    most = how.pop("most", 2000)
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrase_graph(docs, **how).top(most).collect()}


def texts():
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [("en", f"The big red dog number {i % 7} runs, the BIG red cat sits. Ünï big red") for i in range(40)]
    rows += [("en", passage + (" tail" if i % 2 else ".")) for i in range(24)]
    rows += [("fr", "la la la la\tla; le chat İ noir\r\nle chat noir" * 3) for _ in range(6)]
    rows += [(None, "und a b " * 30), (None, None), ("en", ""), ("en", " .,;\n"), ("de", "ein wort"), ("", "a b. " * 12), ("en", "x" * 50_000 + " y"), ("en", "w v " * 20_000)]
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_phrases_equal_brute_force(spark, longest):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("node", F.lit("clash")).withColumn("f", F.lit(1)).repartition(3)
    assert found(docs, longest=longest) == brute(rows, longest)


def test_limit_ties_and_least(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(docs, most=5) == brute(rows, most=5)
    assert found(docs, least=2) == brute(rows, least=2)


def test_blocks_are_added_up(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string").coalesce(1)
    want = {n: brute(rows, n) for n in (3, 4)}
    monkeypatch.setattr("feedloom.llm.collocations.BLOCK_WORDS", 20)
    assert found(docs) == want[3]


def test_edges_are_added_up_slice_by_slice(monkeypatch):
    import pyarrow as pa

    from feedloom.llm import collocations

    monkeypatch.setattr(collocations, "AT_ONCE", 3)
    rows = [("a", b"x y", None, 4), ("a", b"x y", b"q", 2), ("a", b"x y", b"q", 9), ("b", b"x y", b"q", 30), ("a", b"x z", b"q", 3), ("a", b"x z", b"r", 3), ("a", b"x z", b"r", 3)]
    rows += [("a", b"z", None, 1)]
    for cut in range(1, 5):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "node", "next", "f"), r, strict=True)) for r in rows[i : i + cut]], collocations._ROWS) for i in range(0, len(rows), cut)]
        sums = Counter()
        for out in collocations._flows(3, 10)(iter(batches)):
            for r in out.to_pylist():
                sums[r["lang"], r["phrase"], r["words"]] += r["f"]
        assert sums == {
            ("a", b"x y q", 3): 11, ("b", b"x y q", 3): 30, ("a", b"x y", 2): 15, ("b", b"x y", 2): 30, ("a", b"x", 1): 24, ("b", b"x", 1): 30, ("a", b"z", 1): 1,
        }


def test_codes_beyond_64_bits():
    from feedloom.llm.collocations import _edges_of

    text = " ".join(f"w{i % 6000}" for i in range(7000)).encode()
    rows = _edges_of("en", [text], 6).to_pylist()
    assert sum(r["f"] for r in rows[:-1]) == 7000 == rows[-1]["f"] and len(rows) == 6000 + 5 + 1


def test_paths_are_unary_and_whole(spark):
    graph = phrase_graph(spark.createDataFrame(texts(), "lang string, text string"))
    paths = {(r.path, r.f) for r in graph.paths().filter("lang = 'en'").collect()}
    assert (" ".join(f"p{i}" for i in range(70)), 24) in paths
    assert sum(len(p.split(" ")) - 2 for p, _ in paths) == graph.edges().filter("lang = 'en'").count()


def test_counts_beyond_64_bits(spark):
    from feedloom.llm.collocations import exact_score

    a, left, right = 9_000_000_000_000_001, 9_000_000_000_000_007, 9_876_543_210_987_654
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(exact_score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_empty_table(spark):
    assert phrase_graph(spark.createDataFrame([], "doc_id long, lang string, text string")).top().collect() == []
