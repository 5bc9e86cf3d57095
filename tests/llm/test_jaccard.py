import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import jaccard, queries
from feedloom.llm.jaccard import JaccardJoin, connected_components, keep_one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, width=5):
    """Components over all pairs; rows are (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(ASCII))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids[r] = min([x for x in (ids.get(r), d) if x is not None], default=None)
    return sorted(((d, len(s), ids[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, families, copies, words=60, edits=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    rows, n = [], 0
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, words))]
        if r.random() < 0.3:
            base += shared
        for _ in range(r.randint(1, copies)):
            text = list(base)
            for _ in range(r.randint(0, edits)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    r.shuffle(rows)
    return rows


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("sid", F.lit(1))
    return sorted(map(tuple, JaccardJoin(docs, **how).components().drop("class_id").collect()), key=str)


@pytest.mark.parametrize(("seed", "bucket"), [(1, 64), (2, 2)])
def test_components_equal_brute_force(spark, seed, bucket):
    rows = corpus(seed, 60, 12) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one TWO"), (9006, "one"), (9007, "É x"), (9008, "é x")]
    rows += [(9009, rows[0][1]), (9009, rows[0][1]), (9010, "a b c d e"), (9011, " ".join(f"x{i}" for i in range(30_000)))]
    assert found(spark, rows, bucket=bucket) == brute(rows)


def test_one_large_group_of_near_copies_and_a_common_passage(spark):
    rows = corpus(5, 1, 1, 3) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(7, 1, 400, 90, 4) + corpus(8, 1, 200, 90, 4))]
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(5000 + i, passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randint(5, 30)))) for i in range(200)]
    assert found(spark, rows, bucket=8) == brute(rows)


def test_stage_and_empty_table(spark):
    rows = corpus(4, 10, 5)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, kept_id string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})
    assert JaccardJoin(spark.createDataFrame([], "doc_id long, text string")).components().count() == 0


def test_stage_keeps_one_row_of_rows_loaded_twice(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (None, other), (None, other), (1, other + " x"), (2, None), (2, None), (None, "")]
    kept = sorted((tuple(r) for r in keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(1, text), (1, other + " x"), (2, None), (2, None), (None, "")], key=str)


@pytest.mark.parametrize("copies", [500, 2000])
def test_blocks_connect_a_family_without_its_pairs(spark, copies):
    r = random.Random(12)
    rows = []
    for i in range(copies):
        words = [f"v{j}" for j in range(200)]
        words[r.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(words)))
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    links = join.chosen()
    assert links.count() <= jaccard.CHOICES * copies
    assert join._rest(connected_components(links)).count() <= copies


def test_blocks_find_what_brute_force_connects(monkeypatch):
    r = random.Random(5)
    for columns in (7, 4096):
        monkeypatch.setattr(jaccard, "COLUMNS", columns)
        sets = [np.array(sorted(r.sample(range(40), r.randint(24, 36))), np.uint64) for _ in range(25)] + [np.arange(100, 120, dtype=np.uint64)]
        cuts = [x[: len(x) - -(-75 * len(x) // 100) + 1] for x in sets]
        near = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b))}
        likely = jaccard._likely([len(x) for x in sets], cuts, 75)
        got = jaccard._joined(list(range(len(sets))), sets, 75)

        def reach(edges, n=len(sets)):
            root = list(range(n))
            for _ in range(n):
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert near and set(got) <= near and reach(got) == reach(near)
        assert all(likely[i] for i, _ in near) and not likely[-1]


def test_other_paths_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FETCH_BROADCAST", 0)
    monkeypatch.setattr(jaccard, "HOMES", 2)
    monkeypatch.setattr(jaccard, "REST_BLOCK", 3)
    monkeypatch.setattr(jaccard, "MOVED", 5)
    monkeypatch.setattr(jaccard, "CLASSES", 2)
    rows = corpus(3, 30, 12)
    assert found(spark, rows, bucket=2) == brute(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600), (600, 550), (7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {i: 0 for i in range(201)} | {500: 500, 600: 500, 550: 500}


@pytest.mark.parametrize(("bucket", "block"), [(64, 256), (2, 8)])
def test_links_are_all_pairs_of_different_sets(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(11)
    rows = [(500 + i, t) for i, (_, t) in enumerate(corpus(2, 20, 8))]
    for i in range(120):  # one family, whose members differ from each other in one to four words of 90
        text = [f"v{j}" for j in range(90)]
        for _ in range(r.randint(1, 2)):
            text[r.randrange(90)] = f"w{r.randrange(1000)}"
        rows.append((i, " ".join(text)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, "")]
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket)
    sets, ids = {}, {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(ASCII))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        ids.setdefault(sets[d] or d, d)
    names = {r.row: r.doc_id for r in join.rows.select("row", "doc_id").collect()}
    first = {d: ids[s or d] for d, s in sets.items()}
    alone = [d for d, c in first.items() if d == c and sets[d]]
    want = {(a, b) for a in alone for b in alone if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [tuple(sorted((first[names[r.a]], first[names[r.b]]))) for r in join.links().collect()]
    assert len(want) > 1_000 and sorted(got) == sorted(want)
    counts = {d: sum(first[d] in pair for pair in want) for d in first}
    assert sorted(map(tuple, join.link_counts().collect())) == sorted((d, len(sets[d]), first[d], counts[d]) for d in first)


def test_link_counts_equal_their_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_jaccard_links"]).fetchall()
    got = queries.QUERIES["op3_jaccard_links"](spark, data).select("doc_id", "n_shingles", "class_id", "n_links")
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(n for *_, n in want)


def test_a_class_outside_a_large_component_is_joined_by_few_of_its_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TRIED", 20, raising=False)
    r = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"v{j}" for j in range(200)]
        words[r.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(words)))
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = sorted(x.cls for x in join.classes.select("cls").collect())
    labels = spark.createDataFrame([(c, classes[1]) for c in classes[1:]], "node long, root long")
    split = join._split(labels)
    assert join._rest(labels, split).count() > 150
    tried = join._tries(split)
    assert 0 < tried.count() < 150
    joined = jaccard.relabelled(labels, join._near(tried))
    assert {tuple(x) for x in joined.collect()} == {(c, classes[0]) for c in classes}
    assert join._rest(joined).count() == 0


def test_sets_of_many_texts_are_those_of_their_words(monkeypatch):
    r = random.Random(5)
    signs = ["a", "B", "b", "É", "é", "ß", " ", " ", "\n", "\x0b", "\x1c", "\t", "x" * 70, "X" * 70]
    texts = [None, "", " ", "a b c d", "a b c d e", "A B c d E"] + ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(1000)]
    given, names = pa.array(["zz", *texts, "yy"]).slice(1, len(texts)), {}
    sets = jaccard.shingle_sets(given, 5)
    for text, got in zip(texts, sets):
        w = WORD.findall((text or "").translate(ASCII))
        want = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        assert len(got) == len(want) and got.tolist() == sorted(got.tolist())
        assert names.setdefault(want, got.tobytes()) == got.tobytes()
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(jaccard, "TEXT_BYTES", 100)  # a long text is hashed stretch by stretch
    assert [x.tobytes() for x in jaccard.shingle_sets(given, 5)] == [x.tobytes() for x in sets]


def test_rounds_of_blocks_give_the_same_components(spark, monkeypatch):
    sent, inner = [], JaccardJoin._sent
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(JaccardJoin, "_sent", lambda join, homes: sent.append(homes.select("home").distinct().collect()) or inner(join, homes))
    rows = corpus(11, 25, 5)
    assert found(spark, rows) == brute(rows)
    first = [{x.home for x in part} for part in sent[: jaccard.ROUNDS]]
    assert len(first) == jaccard.ROUNDS and all(not a & b for i, a in enumerate(first) for b in first[:i]) and sum(map(bool, first)) > 1


def test_near_copies_meet_in_one_of_their_common_buckets(spark, monkeypatch):
    r, rows = random.Random(8), []
    for family in range(8):
        for i in range(6):
            words = [f"f{family}w{j}" for j in range(120)]
            for place in r.sample(range(120), 2):
                words[place] = f"x{family}_{i}_{place}"
            rows.append((6 * family + i, " ".join(words)))
    join, met = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")), []
    split = join._split(spark.createDataFrame([], "node long, root long"))
    monkeypatch.setattr(type(split), "distinct", lambda df: met.append(df.count()) or df.dropDuplicates())
    pairs = join._rest(None, split).count()
    assert pairs >= 8 * 10 and met[-1] < 6 * pairs
    monkeypatch.undo()
    assert found(spark, rows) == brute(rows)


def test_prefixes_are_sent_without_what_no_other_has(spark):
    r, rows = random.Random(9), []
    for i in range(30):  # two sets each, which differ in one shingle: most have one prefix, which no other group shares
        words = [f"w{i}_{j}" for j in range(150)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    for i in range(30):  # texts that share five shingles with one another and no more
        words = [f"v{i}_{j}" for j in range(300)]
        words[100:109] = [f"common{j}" for j in range(9)]
        rows.append((100 + i, " ".join(words)))
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    several = [x.g for x in join.classes.groupBy("g").count().filter("count > 1").collect()]
    assert len(several) > 15
    sent = join._prefixes_sent(join.classes.selectExpr("cls", "struct(0 AS a) AS home")).join(join.classes.select("cls", "g"), "cls").collect()
    for x in sent:
        assert len(x.shingles) == 8 * (37 if x.g in several else join.entries.filter(f"g = {x.g}").count())
    assert found(spark, rows) == brute(rows)
