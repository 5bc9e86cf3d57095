"""Every registered query over the smallest tables, against its SQL; plans and units of the operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text, url, vector
from feedloom.operators import feedback, latest, ranking, similarity, state
from feedloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(round(x, 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(([value(x) for x in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = duck.execute(registry.ORACLE_SQL[name])
    order = [d[0] for d in got.description]
    assert sorted(order) == columns
    want = [[r[order.index(c)] for c in columns] for r in got.fetchall()]
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_scans_read_only_what_is_used(spark):
    plan = registry.QUERIES["norm_url_identity"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    assert "Exchange" not in plan


def test_latest_needs_one_shuffle(spark):
    plan = registry.QUERIES["latest_vote"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    ("given", "key"),
    [
        ("https://www.Example.com/a/b/?utm_source=x&q=1#top", "example.com/a/b?q=1"),
        ("http://example.com", "example.com"),
        ("https://a.org/x?fbclid=1&UTM_medium=2", "a.org/x"),
        ("https://u:p@a.org:8080/Path/", "u:p@a.org:8080/Path"),
    ],
)
def test_page_identity(spark, given, key):
    assert spark.createDataFrame([(given,)], "url string").select(url.norm_url("url")).first()[0] == key


def test_zero_vectors_and_sizes(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0], None)], "z array<float>, v array<float>, n array<float>").select(
        vector.unit(F.col("z")).alias("z"), vector.unit(F.col("v")).alias("v"), vector.valid(F.col("n"), 2).alias("n"), vector.valid(F.col("v"), 2).alias("ok")
    ).first()
    assert (row.z, row.v, row.n, row.ok) == ([0.0, 0.0], [0.6, 0.8], False, True)


def test_selection_by_diversity(spark):
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.85, [1.0, 0.0]), (0, 3, 0.6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "tenant int, candidate_id long, relevance double, vector array<double>")
    assert [r.candidate_id for r in ranking.mmr(df, 2).orderBy("place").collect()] == [1, 3]


def test_penalties_grow_and_are_forgiven(spark):
    days = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 9)], "site string, day long")
    got = {r.site: (round(r.penalty, 6), r.last_failure) for r in feedback.site_penalties(days).collect()}
    assert got == {"a": (0.3, 1), "b": (0.2, 9)}


def test_upsert_is_null_safe(spark):
    schema = "id long, name string, embedded boolean"
    old = spark.createDataFrame([(1, None, True), (2, "x", True), (3, "y", True)], schema)
    new = spark.createDataFrame([(1, None, True), (2, None, True), (4, "z", True)], schema)
    got = {r.id: (r.name, r.embedded) for r in latest.upsert(old, new, "id", ["name"], "embedded").collect()}
    assert got == {1: (None, True), 2: (None, False), 3: ("y", True), 4: ("z", False)}


def test_large_small_side_is_dealt_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "candidate_id long, vector array<double>")
    small = spark.createDataFrame([([float(i), 2.0],) for i in range(5)], "their_vector array<double>")
    want = {tuple(r) for r in similarity.best_similarity(rows, small).collect()}
    monkeypatch.setattr(similarity, "BLOCK", 2)
    assert {tuple(r) for r in similarity.best_similarity(rows, small).collect()} == want


def test_language_and_prose_gates(spark):
    german = "der Hund und die Katze sind nicht mit dem Ball auf der Wiese"
    row = spark.createDataFrame([(german, "the cat and the dog is on it for this", "kurz")], "a string, b string, c string")
    assert tuple(row.select(*[text.detect_lang(F.col(c)) for c in "abc"]).first()) == ("de", "en", None)


@pytest.mark.parametrize(("given", "want"), [((30, True, True), (21, 9)), ((30, False, True), (30, 0)), ((30, True, False), (0, 30)), ((1, True, True), (1, 0)), ((5, False, False), (0, 0))])
def test_places_of_a_feed(given, want):
    assert state.slots(*given) == want
