from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm.mixing import WEIGHTS, mix_sources, mixed_documents, permuted


def targets_by_rounds(sizes, share=1.5, limit=2.0):
    """Deal by weight, hold what is above its limit, deal the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    held, rest = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        level = (rest - sum(held.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not over:
            return held | {s: weight[s] * level for s in free}
        held |= {s: limit * sizes[s] for s in over}


def table(spark):
    rows = [(i, "w " * (i % 90), f"s{i % 4}") for i in range(400)]
    rows += [(1000 + i, "v " * 50, None) for i in range(30)] + [(2000, None, "s1"), (2001, "", "tiny"), (2002, "one two", "tiny")]
    rows += [(2003, "x " * 30_000, "long"), (5, "w " * 5, "s1"), (None, "q q q", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_targets_limits_and_totals(spark):
    rows = mix_sources(table(spark), block_words=16, shard_slots=128).documents().collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = targets_by_rounds(sizes)
    assert len(rows) == 436 and set(want) == set(target)
    for s, t in target.items():
        assert t == pytest.approx(want[s])
        assert abs(taken[s] - t) <= 32
    assert {r.source: r.source_size for r in rows} == dict(sizes)


def test_reruns_and_partitionings_agree(spark):
    t = table(spark).filter("doc_id is not null")
    a, b = ({tuple(r) for r in mix_sources(x, block_words=16).documents().collect()} for x in (t, t.repartition(7)))
    assert a == b


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 5, 17, 1000):
        df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9)).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shards_draw_about_their_share(spark):
    mix = mix_sources(table(spark), block_words=8, shard_slots=500)
    full = mix.slots.filter("shard < 3").groupBy("shard").count().collect()
    assert {r["count"] for r in full} == {500}
    share = {r.src: r.quota for r in mix.sources.collect()}
    big = max(share, key=share.get)
    per = [r["count"] for r in mix.slots.filter(f"src = {big} and shard < 3").groupBy("shard").count().collect()]
    assert all(abs(c / 500 - share[big] / sum(share.values())) < 0.1 for c in per)


def test_stage_gives_the_taken_words(spark):
    t = table(spark).filter("doc_id is not null and doc_id <> 5")
    want = {r.doc_id: r.taken for r in mix_sources(t).documents().collect() if r.taken}
    out = mixed_documents(t)
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    assert out.columns == t.columns and got == want


def test_taken_equals_a_walk_of_the_slots(spark):
    """Every slot's block taken word by word, from the documents laid end to end."""
    t = table(spark).filter("doc_id is not null and doc_id <> 5")
    mix = mix_sources(t, block_words=16)
    laid, taken = {}, Counter()
    sizes = {r.row: (r.doc_id, r["size"]) for r in mix.sizes.collect()}
    for r in mix.pieces.collect():
        for w in range(r.first_word, r.first_word + r.words):
            laid.setdefault((r.src, r.block), []).append((r.row, w))
    words = [x for block in laid.values() for x in block]
    assert sorted(words) == [(row, w) for row, (_, n) in sorted(sizes.items()) for w in range(n)]
    for s in mix.slots.collect():
        taken.update(sizes[row][0] for row, _ in laid[s.src, s.block])
    assert {r.doc_id: r.taken for r in mix.documents().collect()} == {d: taken[d] for d, _ in sizes.values()}


def test_a_source_of_few_words_comes_near_its_target(spark):
    rows = [(i, "w " * 500, "big") for i in range(40)] + [(100 + i, "v " * 7, "small") for i in range(4)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).documents().collect()
    for source in ("big", "small"):
        target = next(r.target for r in got if r.source == source)
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= max(1, target / 16, 0.0)


def test_ties_of_the_order_agree(spark):
    rows = [(1, "a b c", "x")] * 30 + [(1, "d e", "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = [Counter() for _ in range(2)]
    for k, d in enumerate((docs, docs.repartition(5))):
        for r in mix_sources(d).documents().collect():
            sums[k][r["size"]] += r.taken
    assert sum(sums[0].values()) == sum(sums[1].values())


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).documents().count() == 0
