"""Units of sections' rules, replies and page functions, and invariants of clustering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import html, text, url
from feedloom.operators import feedback, replies, selection, similarity, state
from feedloom.plans import registry
from feedloom.sources.domain import read

DATA = "/root/testdata/sf0.001"


def one(spark, expression, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expression).first()[0]


def test_links_of_a_bookmark_file(spark):
    page = '''<DT><A HREF="https://a.org/?x=1&amp;y=2" ADD_DATE="1">B &amp; C</A> <a class=q href='http://b.org/'>x</a>
        <a href=ftp://c>n</a><a  id="z" href=https://d.org/p>D <b>e</b></a><a name="n">none</a><a href="/rel">r</a>'''
    got = one(spark, html.anchors(F.col("c0")), page)
    want = [("https://a.org/?x=1&y=2", "B & C"), ("http://b.org/", "x"), ("https://d.org/p", "D e")]
    assert [(a.url, a.text) for a in got] == want
    got = one(spark, html.anchors(F.col("c0"), F.col("c1")), page, "https://h.org/a/b?c")
    assert [(a.url, a.text) for a in got] == [*want, ("https://h.org/rel", "r")]


@pytest.mark.parametrize(
    ("given", "want"),
    [("&eacute;&#233;&#xE9;", "ééé"), ("&amp;amp;gt;", ">"), ("<![CDATA[a]]>", "a"), ("&amp;lt;b&gt;", ""), ("&unknown; &#0;", "&unknown; &#0;"), ("a&nbsp;b&#160;c", "a b c"), ("&#x1F600;", "😀"), (None, "")],
)
def test_entities(spark, given, want):
    assert one(spark, html.strip_html(F.col("c0")), given) == want


def test_meta_tags_of_any_form(spark):
    page = '''<META content='t &quot;q&quot;' NAME="description"><meta property="og:description" content="">'''
    assert one(spark, html.meta(F.col("c0"), "og:description", "description"), page) == 't "q"'


@pytest.mark.parametrize(
    ("given", "want"), [("x [1, 2] y", "[1, 2]"), ("[a] and [b]", "[a] and [b]"), ("none", None), ("] [", None), ("", None), (None, None)]
)
def test_slice_of_a_reply(spark, given, want):
    assert one(spark, replies.reply_slice(F.col("c0")), given) == want


@pytest.mark.parametrize(
    ("address", "head", "want"),
    [("https://a/2024/01/05/x", None, "2024-01-05"), ("https://a/2024-1-5", "", "2024-01-05"), ("https://a/x", "2023-02-03T10:00Z", "2023-02-03"), ("https://a/x", None, None), ("https://a/20245/1/1", None, None)],
)
def test_dates_of_pages(spark, address, head, want):
    got = one(spark, replies.page_date(F.col("c0"), F.col("c1")), address, head)
    assert (got and got.isoformat()) == want


def test_chunks_end_before_they_overflow(spark):
    df = spark.createDataFrame([([5, 5, 5, 20, 1, 1],), ([],), ([1] * 7,)], "s array<int>")
    got = [r[0] for r in df.select(replies.folded(F.col("s"), 10, 3)).collect()]
    assert got == [[0, 0, 1, 2, 3, 3], [], [0, 0, 0, 1, 1, 1, 2]]


def test_batches_of_an_embedder(spark):
    def embed(texts):
        if len(texts) > replies.BATCH_ROWS or sum(map(len, texts)) > replies.BATCH_CHARS:
            raise AssertionError
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    rows = [(i, "x" * (i % 9000), f"u{i}") for i in range(100)] + [(200, "y" * 9000, "u"), (201, None, "http://u"), (202, "", None)]
    df = spark.createDataFrame(rows, "id long, text string, url string").coalesce(1)
    got = {r.id: r.vector for r in replies.embed_pending(df, embed).collect()}
    assert len(got) == len(rows) and got[200] == [4096.0] and got[201] == [8.0] and got[202] == [8.0]
    broken = spark.createDataFrame([(i, "bad" if i == 5 else "ok", "u") for i in range(40)], "id long, text string, url string").coalesce(1)
    assert {r.id for r in replies.embed_pending(broken, embed).collect()} == set(range(32, 40))


def test_slots_without_a_taste_take_the_least_penalised(spark):
    rows = [(0, i, "A", 0.5, None, 0.3 if i > 2 else 0.0) for i in range(5)] + [(0, 10 + i, "B", 0.9, None, 0.0) for i in range(2)]
    df = spark.createDataFrame(rows, "tenant int, candidate_id long, topic string, rate double, taste double, penalty double")
    got = sorted((r.slot, r.candidate_id) for r in selection.fill_slots(df, 5).collect())
    assert [c for _, c in got] == [11, 10, 2, 1, 0]


def test_k_means_covers_all_and_gives_each_its_nearest(spark):
    rows = registry.QUERIES["kmeans_profile"](spark, DATA).collect()
    n = read(spark, DATA, "embeddings").count()
    assert sum(r.n for r in rows) == n and 8 <= len(rows) <= 32


@pytest.mark.parametrize(
    ("address", "want"),
    [("example.com/a", "example.com/a"), ("//www.H.x/a/", "h.x/a"), ("https://www.Example.com/a/?utm_source=x&b=1#top", "example.com/a?b=1"), ("http://h", "h"), ("/p/q/", "/p/q"), ("", ""), ("mailto:a@b", "a@b")],
)
def test_identity_of_addresses(spark, address, want):
    assert one(spark, url.norm_url(F.col("c0")), address) == want


@pytest.mark.parametrize(
    ("raw", "text", "image"),
    [
        ('<![CDATA[<p> <a href="https://t.de/x"><img src="https://img.t.de/1.jpg" alt=""></a> Der Text &amp; mehr\u200b</p>]]>', "Der Text & mehr", "https://img.t.de/1.jpg"),
        ('<img src="/relative.jpg"><img src="https://a/b">', "", None), (None, "", None), ("<IMG alt=x SRC = 'http://a/b.png'>", "", "http://a/b.png"),
        ("&lt;![CDATA[&lt;p&gt; &lt;img src=&#34;https://images.x.de/a.jpg?width=1920&#34; alt=&#34;T&#34;&gt; Bedroht? &amp;quot;Ja&amp;quot;&lt;/p&gt;]]&gt;", 'Bedroht? "Ja"', "https://images.x.de/a.jpg?width=1920"),
        ('Text davor <img src="https://ex.com/a.jpg" al', "Text davor", "https://ex.com/a.jpg"),
    ],
)
def test_texts_and_images_of_fragments(spark, raw, text, image):
    assert (one(spark, html.strip_html(F.col("c0")), raw), one(spark, html.first_image(F.col("c0")), raw)) == (text, image)


THREE = "Der erste Satz ist kurz. Der zweite Satz bringt den Text über zwei Zeilen hinaus. Ein dritter Satz wird nicht mehr gebraucht."
STUB = "Die KI schreibt mit. Die Möglichkeiten künstlicher Intelligenz sind für Sc"
FULL = "In Singapur sollen Schüler lernen, KI zu nutzen, ohne ihr das Denken zu überlassen."


@pytest.mark.parametrize(
    ("snippet", "description", "want"),
    [
        ("", None, ""), (None, None, ""), (THREE, None, THREE[: THREE.index(" Ein")]), (STUB, FULL, FULL), (STUB, None, "Die KI schreibt mit."),
        ("Messages containing “Microslop.” were blocked. People then started testing…", None, "Messages containing “Microslop.” were blocked."),
        ("Sie sagte „Nein.“ Danach war Ruhe im Saal und im ganzen Haus der …", None, "Sie sagte „Nein.“"), ("Radio waves were found. It reveals its ...", None, "Radio waves were found."),
        ("Das gilt z.B. für Schulen und Hochschulen im ganzen Land.", None, "Das gilt z.B. für Schulen und Hochschulen im ganzen Land."), (None, "Er kam. Und dann sah er die …", "Er kam."),
        ("GM and Ford lost share, according to a ...", None, "GM and Ford lost share, according to a…"), ("wort " * 80, None, ("wort " * 48)[:-1] + "…"),
        ("<p>Kurz</p>", "headline without an end", "headline without an end"),
    ],
)
def test_summaries_of_cards(spark, snippet, description, want):
    assert one(spark, text.card_summary(F.col("c0"), F.col("c1")), snippet, description) == want


@pytest.mark.parametrize(
    ("title", "said", "want"),
    [("Bundestag berät über &#34;Rente&#34;", 'Bundestag berät über "Rente"[ mehr ]', True), ("A long headline that goes on", "A long head", True), ("Head", "Head and quite a lot more", False), ("", "", False), ("x", "", False), (None, None, False)],
)
def test_what_repeats_a_title(spark, title, said, want):
    assert one(spark, text.repeats_title(F.col("c0"), F.col("c1")), title, said) is want


@pytest.mark.parametrize(
    ("created", "want"),
    [("2024-01-30 11:59:50", "1 min"), ("2024-01-30 11:25:00", "35 min"), ("2024-01-30 08:00:00", "4 h"), ("2024-01-28 12:00:00", "2 d"), ("2024-01-20 12:00:00", "20.01."), ("2024-01-31 12:00:00", "31.01."), (None, None)],
)
def test_ages_of_cards(spark, created, want):
    assert one(spark, state.age_label(F.col("c0").cast("timestamp"), F.lit("2024-01-30 12:00:00").cast("timestamp")), created) == want


def test_a_story_served_twice_is_rewarded_once(spark):
    served = spark.createDataFrame([(1, "T", "broad"), (1, "T", "broad"), (2, "T", "broad"), (3, "T", "broad"), (4, "U", "curated")], "candidate_id long, topic string, section string")
    log = spark.createDataFrame([(1, 1, "saved", "saved"), (2, 2, "interest", "up"), (3, 2, "interest", "down")], "id long, candidate_id long, axis string, value string")
    opens = spark.createDataFrame([(3, "broad"), (3, "broad"), (2, "broad")], "candidate_id long, section string")
    (row,) = feedback.arm_stats(served, log, opens).collect()
    assert (row.topic, row.serves, round(row.rewards, 6)) == ("T", 4, 1.1)


def test_rows_without_vectors_and_empty_sets(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "candidate_id long, vector array<double>")
    small = spark.createDataFrame([([0.0, 1.0],)], "their_vector array<double>")
    assert {tuple(r) for r in similarity.best_similarity(rows, small).collect()} == {(1, 0.0), (2, -1.0)}
    assert {tuple(r) for r in similarity.best_similarity(rows, small.limit(0)).collect()} == {(1, -1.0), (2, -1.0)}


def votes(spark):
    rows = [(1, 1, "interest", "down", "curated"), (2, 2, "interest", "down", "curated"), (3, 2, "interest", "up", "curated"), (4, 3, "interest", "down", "broad"), (5, 4, "saved", "saved", "broad"),
            (6, 5, "interest", "up", "broad"), (7, 6, "interest", "down", "curated"), (8, 7, "saved", "saved", "curated"), (9, 1, "mood", "happy", "curated"), (10, 4, "interest", "down", "broad"), (11, 8, "interest", "down", "curated")]
    log = spark.createDataFrame(rows, "id long, candidate_id long, axis string, value string, section string")
    stories = spark.createDataFrame([(i, f"t{i}", None if i == 8 else [1.0, i / 10]) for i in range(1, 12)], "candidate_id long, title string, vector array<double>")
    return log, stories


def test_exemplars_come_from_votes(spark):
    log, stories = votes(spark)
    down = feedback.rejected(log, stories).orderBy(F.desc("id")).collect()
    assert [(r.candidate_id, r.title) for r in down] == [(6, "t6"), (1, "t1")]  # the newest first; 8 has no vector, 2 was voted for since
    links = stories.filter("candidate_id = 9")
    assert {r.candidate_id for r in feedback.kept(log, links, stories).collect()} == {2, 4, 7, 9}
    assert {(r.candidate_id, r.liked) for r in feedback.explore_taste(log, stories).collect()} == {(4, True), (4, False), (5, True), (3, False)}


def test_exemplars_and_taste_of_empty_sets(spark):
    _, stories = votes(spark)
    rows, none = stories.filter("candidate_id < 4"), stories.limit(0).withColumnRenamed("vector", "their_vector")
    some = stories.filter("candidate_id = 1").withColumnRenamed("vector", "their_vector")
    assert similarity.negative_exemplars(rows, none, some).count() == 3 and similarity.negative_exemplars(rows, some, none).count() == 3
    assert {r.taste for r in similarity.taste(rows, none, some).collect()} == {None}
    assert all(r.taste > 0.9 for r in similarity.taste(rows, some, none).collect())


@pytest.mark.parametrize(("points", "want"), [(3, 3), (40, 8), (726, 19), (10_000, 32), (1, 1)])
def test_number_of_interests(points, want):
    assert similarity.cluster_count(points) == want and similarity.cluster_count(points, 5) == min(5, points)


def test_profile_is_of_unit_centroids(spark):
    rows = [([1.0, 0.1 * (i % 2)],) for i in range(10)] + [([0.0, 2.0 + i],) for i in range(5)] + [(None,), ([float("nan"), 1.0],), ([1.0],)]
    pages = spark.createDataFrame(rows, "their_vector array<double>")
    got = similarity.profile(pages, 2, dim=2).collect()
    assert sorted(r.n for r in got) == [5, 10] and all(abs(sum(x * x for x in r.their_vector) - 1) < 1e-9 for r in got)
    assert max(r.their_vector[1] for r in got) == pytest.approx(1.0)
    assert similarity.profile(pages.limit(0), dim=2).collect() == [] and similarity.profile(pages, dim=7).collect() == []


def test_profile_without_a_fixed_number(spark):
    pages = spark.createDataFrame([([float(i % 10), 1.0, float(i % 7)],) for i in range(40)], "their_vector array<double>")
    got = similarity.profile(pages, dim=3).collect()
    assert len(got) == 8 and sum(r.n for r in got) == 40


def test_all_pairs_are_whole_and_take_few_bytes(spark, monkeypatch, tmp_path):
    v = np.random.default_rng(5).standard_normal((3_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "b long, vector array<double>").coalesce(1)
    asked = rows.filter("b % 20 = 0").selectExpr("b AS a", "vector AS their_vector")
    pairs = similarity.similarities(rows, asked, "b", "a").select("a", "b", F.round("sim", 5).alias("sim"))
    pairs.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 5 * (3_000 * 150 - 150)
    want = {(20 * i, j): s for i, line in enumerate(v[::20] @ v.T) for j, s in enumerate(line) if 20 * i != j}

    def check(got):
        assert len(got) == len(want) and max(abs(r.sim - want.pop((r.a, r.b))) for r in got) < 1e-5 and not want

    kept = dict(want)
    check(spark.read.parquet(str(tmp_path / "pairs")).collect())
    for name, value in (("BROADCAST_BYTES", 0), ("PAIRED", 700), ("CYCLE", 7), ("ALIKE", 100)):
        monkeypatch.setattr(similarity, name, value)
    want |= kept
    check(similarity.similarities(rows, asked, "b", "a").collect())


@pytest.mark.parametrize("name", ["same_story_groups", "duplicate_groups"])
def test_groups_of_stories_broadcast_nothing(spark, name):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def plans():
        bus.waitUntilEmpty()
        runs = store.executionsList()
        return {runs.apply(i).executionId(): runs.apply(i).physicalPlanDescription() for i in range(runs.size())}

    old = plans()
    assert registry.QUERIES[name](spark, DATA).count() > 0
    new = [plan for k, plan in plans().items() if k not in old]
    assert any("SortMergeJoin" in plan for plan in new) and not any("BroadcastHashJoin" in plan for plan in new)


def test_slots_with_chance_equal_a_walk(spark):
    from feedloom.operators.selection import NEWEST, fill_slots, keyed_draw

    rows = [(g, i, f"t{i % 5}", (i % 5) / 5, None if g == 2 else (i * 7 % 11) / 11, (i % 3) / 10) for g in (1, 2, 3) for i in range(60)]
    options = spark.createDataFrame(rows, "tenant long, candidate_id long, topic string, rate double, taste double, penalty double")
    got = {(r.tenant, r.slot): r.candidate_id for r in fill_slots(options, 20, epsilon=0.4, seed=3).collect()}
    chance = 0
    for g in (1, 2, 3):
        left = {r[1]: r for r in rows if r[0] == g}
        for slot in range(20):
            arms = sorted({r[2] for r in left.values()})
            any_arm, which, no_taste = (keyed_draw(3, g, slot, k) for k in range(3))
            arm = arms[int(which * len(arms))] if any_arm < 0.4 else min(arms, key=lambda t: (-max(r[3] for r in left.values() if r[2] == t), t))
            chance += any_arm < 0.4
            own = sorted((r for r in left.values() if r[2] == arm), key=lambda r: -r[1])
            pick = max(own[:NEWEST], key=lambda r: r[4] - r[5]) if g != 2 and no_taste >= 0.4 else min(own, key=lambda r: r[5])
            assert got[g, slot] == pick[1]
            del left[pick[1]]
    assert 10 < chance < 40 and len(got) == 60


def test_large_sets_meet_in_stripes_without_a_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((2_200, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # equal vectors: the least key first
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "candidate_id long, vector array<double>")
    sims = v @ v.T
    np.fill_diagonal(sims, -1)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), -np.round(sims[i], 12)))[:3] if sims[i, j] >= 0.3}
    monkeypatch.setattr(similarity, "BLOCK", 500)
    monkeypatch.setattr(similarity, "STRIPE", 900, raising=False)
    pairs = similarity.neighbour_pairs(rows, 0.3)
    assert "BroadcastNestedLoopJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in pairs.collect()} == want
    best = similarity.best_similarity(rows, rows.filter("candidate_id % 2 = 1").withColumnRenamed("vector", "their_vector"))
    assert all(abs(r.best - (v[r.candidate_id] @ v[1::2].T).max()) < 1e-9 for r in best.collect())


@pytest.mark.parametrize("liked", [True, False])
def test_slots_by_place_equal_those_of_all_options(spark, liked):
    from feedloom.operators.selection import fill_slots, fill_slots_by_place

    stories = [(i, f"t{i % 5}", (i % 5) / 5, (i * 7 % 31) / 31 if liked else None, (i % 3) / 10) for i in range(300)] + [(400 + i, "few", 0.9, 0.1 if liked else None, 0.0) for i in range(2)]
    material = spark.createDataFrame(stories, "candidate_id long, topic string, rate double, taste double, penalty double")
    selected = spark.createDataFrame([(u, t) for u in range(20) for t in ("t0", "t1", "t3", "few") if (u + len(t)) % 4], "user_id long, topic string")
    seen = spark.createDataFrame([(u, i) for u in range(20) for i in range(0, 402, 1 + u % 3) if i % 5 == u % 5 or i == 400], "user_id long, candidate_id long")
    options = selected.join(material, "topic").join(seen, ["user_id", "candidate_id"], "left_anti")
    want = {tuple(r) for r in fill_slots(options, 6, "user_id", 0.3, 5).select("user_id", "slot", "candidate_id").collect()}
    got = {tuple(r) for r in fill_slots_by_place(selected, material, seen, 6, "user_id", 0.3, 5).select("user_id", "slot", "candidate_id").collect()}
    assert got == want and len(got) > 80
