"""Queries of the ranking chain: pools, floors, relevance, selection, duplicates, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import url, vector
from feedloom.operators import feedback, index, ranking, similarity
from feedloom.sources.domain import AS_OF, read, view, with_views

K, FLOOR, GATE = 200, 0.2, 0.2
#: Until here votes are known where ranking reads them.
EARLY = "2024-01-02 00:00:00"


def _candidates(spark, sf_dir):
    return view(spark, sf_dir, "candidates").select("candidate_id", "url", "label", "source", "topic", "vector").filter(vector.valid(F.col("vector"), 64))


def near_stories(spark, sf_dir):
    """Pairs of near candidates. Their vectors are written once, as every step on pairs reads them, and pages join them without going through the driver."""
    rows = view(spark, sf_dir, "candidates", "merge").select("candidate_id", "vector").filter(vector.valid(F.col("vector"), 64))
    return similarity.neighbour_pairs(rows.checkpoint(), 0.3)


def _centroids(spark, sf_dir):
    means = similarity.label_means(view(spark, sf_dir, "candidates").select("label", "vector"))
    return means.select(F.col("label").alias("centroid"), ((F.col("label") + 1) / 10).alias("weight"), "their_vector")


def _early(spark, sf_dir):
    """The feedback of the first day: at that moment most stories have none."""
    return view(spark, sf_dir, "feedback").filter(F.col("created_at") < F.lit(EARLY).cast("timestamp_ntz"))


def _exemplars(spark, sf_dir):
    """Kept and rejected stories by the feedback so far, and those that had none yet."""
    log, rows = _early(spark, sf_dir), _candidates(spark, sf_dir)
    links = rows.filter("candidate_id % 11 = 0").select("candidate_id")
    fresh = rows.join(log.select("candidate_id").unionByName(links), "candidate_id", "left_anti")
    titled = rows.withColumn("title", F.col("url"))
    return fresh, feedback.kept(log, links, titled), feedback.rejected(log, titled)


def exploring_taste(spark, sf_dir, rows):
    """rows' taste by the exploring section's feedback so far."""
    taste = feedback.explore_taste(_early(spark, sf_dir), _candidates(spark, sf_dir))
    return similarity.taste(rows, taste.filter("liked"), taste.filter("NOT liked"))


def _pool(spark, sf_dir):
    return similarity.knn_pool(_candidates(spark, sf_dir), _centroids(spark, sf_dir), K)


def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 5).alias("length"))


def pairwise_cosine(spark, sf_dir):
    """The vectors whose id is divisible by 20, a stated query set, against all others."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("vector"))
    asked = rows.filter("b % 20 = 0").select(F.col("b").alias("a"), F.col("vector").alias("their_vector"))
    return similarity.similarities(rows, asked, "b", "a").select("a", "b", F.round("sim", 5).alias("sim"))


def knn_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("candidate_id", F.round("sim", 5).alias("sim"))


def similarity_floor(spark, sf_dir):
    best = similarity.best_similarity(_candidates(spark, sf_dir), _centroids(spark, sf_dir))
    return best.filter(F.col("best") >= FLOOR).select("candidate_id", F.round("best", 5).alias("best"))


def negative_exemplars(spark, sf_dir):
    """Stories without feedback so far that aren't nearer to a rejected one than to every page that is kept."""
    fresh, kept, rejected = _exemplars(spark, sf_dir)
    return similarity.negative_exemplars(fresh, kept, rejected).select("candidate_id")


def rejected_stories(spark, sf_dir):
    """The stories rejected so far, the newest first, as a context of ranking names them."""
    from pyspark.sql import Window as W

    rows = _exemplars(spark, sf_dir)[2]
    # one person's votes of a section: their titles go into one prompt
    return rows.select("candidate_id", "title", F.row_number().over(W.orderBy(F.desc("id"))).cast("long").alias("place"))


def assign_gate(spark, sf_dir):
    return similarity.assign(_candidates(spark, sf_dir), _centroids(spark, sf_dir), GATE).select("candidate_id", "centroid", F.round("sim", 5).alias("sim"))


def nearest_sim_stats(spark, sf_dir):
    best = similarity.best_similarity(_candidates(spark, sf_dir), _centroids(spark, sf_dir))
    return best.agg(*[F.round(f("best"), 5).alias(n) for f, n in ((F.min, "least"), (F.median, "middle"), (F.max, "most"))])


def shortlist(spark, sf_dir):
    return ranking.shortlist(_pool(spark, sf_dir), 30).select("candidate_id", F.round("sim", 5).alias("sim"))


def minmax_relevance(spark, sf_dir):
    rows = ranking.minmax_relevance(ranking.shortlist(_pool(spark, sf_dir), 150))
    return rows.select("candidate_id", F.round("relevance", 5).alias("relevance"))


def penalised_relevance(spark, sf_dir):
    """Relevance with verdicts for every fourth candidate, less penalties of half the sites, above the floor."""
    rows = ranking.minmax_relevance(ranking.shortlist(_pool(spark, sf_dir), 150)).join(_candidates(spark, sf_dir).select("candidate_id", "url"), "candidate_id")
    verdicts = rows.filter("candidate_id % 4 = 0").select("candidate_id", (F.col("candidate_id") % 10 / 10).alias("score"))
    sites = rows.withColumn("site", url.site_of("url"))
    penalties = sites.groupBy("site").agg(F.min("candidate_id").alias("least")).filter("least % 2 = 0").select("site", F.lit(0.2).alias("penalty"))
    scored = ranking.penalise(ranking.overlay(sites, verdicts), penalties)
    return ranking.relevance_floor(scored).select("candidate_id", F.round("relevance", 5).alias("relevance"), "scored")


def stale_filter(spark, sf_dir):
    rows = view(spark, sf_dir, "log").groupBy("candidate_id").agg(F.min("created_at").cast("date").alias("published"))
    rows = rows.withColumn("published", F.when(F.col("candidate_id") % 5 > 0, F.date_sub(F.col("published"), (F.col("candidate_id") % 20).cast("int"))))
    return ranking.fresh(rows, AS_OF, 35).select("candidate_id")


def source_partition(spark, sf_dir):
    """What each section may show: searches only in exploring, never what was served there before."""
    rows = _candidates(spark, sf_dir).join(view(spark, sf_dir, "served").select("candidate_id"), "candidate_id", "left_anti")
    return rows.select("candidate_id", F.when(F.col("source") == "searxng", "broad").otherwise("curated").alias("section"))


def neighbour_pairs(spark, sf_dir):
    return similarity.neighbour_pairs(_candidates(spark, sf_dir), 0.3).select("a", "b", F.round("sim", 5).alias("sim"))


def indexed_neighbours(spark, sf_dir):
    """The ten nearest of the vectors whose id is divisible by 20, a stated query set, by an index that holds all vectors."""
    rows = _candidates(spark, sf_dir).select("candidate_id", "vector")
    found = index.build(rows).neighbours(rows.filter("candidate_id % 20 = 0"), 10)
    return found.select(F.col("query").alias("candidate_id"), "other", F.round("sim", 5).alias("sim"))


def fresh_pairs(spark, sf_dir):
    """Fresh stories near fresh or earlier ones, as candidates for one event."""
    rows = _candidates(spark, sf_dir).select("candidate_id", "vector")
    return index.near_pairs(rows.filter("candidate_id % 3 = 0"), rows.filter("candidate_id % 3 > 0"), 0.3).select("a", "b", F.round("sim", 5).alias("sim"))


def duplicate_groups(spark, sf_dir):
    """The stories that groups of the same event drop: all but the most relevant, and all where an earlier one is in."""
    roots = similarity.components(near_stories(spark, sf_dir))
    marked = roots.withColumn("earlier", F.col("node") % 11 == 0)
    best = marked.groupBy("root").agg(F.max("earlier").alias("old"), F.max_by("node", F.struct(F.col("node") % 13, -F.col("node"))).alias("best"))
    return marked.filter("NOT earlier").join(best.hint("merge"), "root").filter("old OR node <> best").select(F.col("node").alias("candidate_id"), "root")


def mmr(spark, sf_dir):
    rows = ranking.minmax_relevance(ranking.shortlist(_pool(spark, sf_dir), 40)).withColumn("relevance", F.round("relevance", 5))
    rows = rows.join(_candidates(spark, sf_dir).select("candidate_id", "vector"), "candidate_id").withColumn("tenant", F.lit(0))
    return ranking.mmr(rows, 10).select("candidate_id", "place")


def diversity(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"))
    return similarity.diversity(rows, "label").select("label", "n", F.round("diversity", 5).alias("diversity"))


def taste(spark, sf_dir):
    """Searched stories' taste: the nearest that exploring liked less the nearest that it disliked."""
    rows = _candidates(spark, sf_dir).filter("source = 'searxng'")
    return exploring_taste(spark, sf_dir, rows).select("candidate_id", F.round("taste", 5).alias("taste"))


def interest_context(spark, sf_dir):
    """The three candidates nearest to each centroid that it owns."""
    owned = similarity.assign(_candidates(spark, sf_dir), _centroids(spark, sf_dir), -1.0)
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("centroid").orderBy(F.desc("sim"), "candidate_id"))
    return owned.withColumn("place", n.cast("long")).filter("place <= 3").select("centroid", "candidate_id", "place")


def profile_pool(spark, sf_dir):
    """The pool of stories without feedback so far, by the interests that the kept pages make, weighed by their feedback."""
    fresh, kept, _ = _exemplars(spark, sf_dir)
    centroids = similarity.profile(kept, dim=64)
    log, opens = _early(spark, sf_dir), view(spark, sf_dir, "opens").filter(F.col("created_at") < F.lit(EARLY).cast("timestamp_ntz"))
    ratings = view(spark, sf_dir, "ratings").filter(F.col("created_at") < F.lit(EARLY).cast("timestamp_ntz"))
    near = similarity.assign(_candidates(spark, sf_dir), centroids, GATE)
    weights = feedback.centroid_weights(feedback.signals(log, opens, ratings), near, centroids, F.lit(EARLY).cast("timestamp_ntz"))
    pool = similarity.knn_pool(fresh, centroids.join(weights, "centroid"), K)
    return pool.select("candidate_id", F.round("sim", 5).alias("sim"))


def kmeans_profile(spark, sf_dir):
    """Clusters of the vectors, by size: their number follows the number of points, 8 to 32 and no more than those."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = read(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = rows.count()
    k = max(1, min(n, max(8, min(32, round((n / 2) ** 0.5)))))
    model = KMeans(k=k, seed=0, maxIter=20).fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_norms, pairwise_cosine, knn_pool, similarity_floor, negative_exemplars, rejected_stories, assign_gate, nearest_sim_stats, shortlist, minmax_relevance,
        penalised_relevance, stale_filter, source_partition, neighbour_pairs, indexed_neighbours, fresh_pairs, duplicate_groups, mmr, diversity, taste, interest_context, profile_pool, kmeans_profile,
    )
}

_DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
_MEANS = f""", parts AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM candidates) GROUP BY ALL),
    raw AS (SELECT label, list(m ORDER BY i) AS v FROM parts GROUP BY label),
    centroids AS (SELECT label AS centroid, (label + 1) / 10 AS weight, list_transform(v, lambda x: x / sqrt({_DOT.format('v', 'v')})) AS v FROM raw)"""
_MET = _MEANS + f", met AS (SELECT c.candidate_id, c.url, centroid, weight, {_DOT.format('c.vector', 'k.v')} AS sim FROM candidates c CROSS JOIN centroids k)"
_POOL = _MET + f""", pool AS (SELECT candidate_id, max(CASE WHEN sim > 0 THEN sim * (0.5 + 0.5 * weight / (SELECT max(weight) FROM centroids)) ELSE sim END) AS sim
    FROM (SELECT *, row_number() OVER (PARTITION BY centroid ORDER BY sim DESC, candidate_id) AS n FROM met) WHERE n <= {K} GROUP BY candidate_id)"""
_SHORT = _POOL + """, short AS (SELECT * FROM pool ORDER BY sim DESC, candidate_id LIMIT {n}), rel AS (SELECT candidate_id,
    0.05 + 0.95 * (sim - (SELECT min(sim) FROM short)) / ((SELECT max(sim) FROM short) - (SELECT min(sim) FROM short)) AS relevance FROM short)"""
_BEST = "best AS (SELECT candidate_id, greatest(-1, max(sim)) AS best FROM met GROUP BY candidate_id)"
_PAIRS = f""", near AS (SELECT a.candidate_id AS x, b.candidate_id AS y, {_DOT.format('a.vector', 'b.vector')} AS sim FROM candidates a JOIN candidates b ON a.candidate_id <> b.candidate_id),
    pairs AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, round(sim, 5) AS sim FROM (
        SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS n FROM near) WHERE n <= 3 AND sim >= 0.3)"""


def _sql(rest: str, *more: str) -> str:
    """The candidates, then further tables, then the query."""
    head = with_views("", "candidates", *more)
    return head.rstrip() + rest


_EXEMPLARS = f""", so_far AS (SELECT * FROM feedback WHERE created_at < TIMESTAMP '{EARLY}'),
    voted AS (SELECT candidate_id, max(id) AS id, arg_max(value, id) AS value, arg_max(section, id) AS section FROM so_far WHERE axis = 'interest' GROUP BY candidate_id),
    kept AS (SELECT candidate_id FROM candidates WHERE candidate_id % 11 = 0 UNION SELECT candidate_id FROM so_far WHERE axis = 'saved'
        UNION SELECT candidate_id FROM voted WHERE value = 'up' AND section = 'curated'),
    against AS (SELECT candidate_id, id FROM voted WHERE value = 'down' AND section = 'curated'),
    liked AS (SELECT candidate_id FROM so_far WHERE axis = 'saved' AND section = 'broad' UNION SELECT candidate_id FROM voted WHERE value = 'up' AND section = 'broad'),
    disliked AS (SELECT candidate_id FROM voted WHERE value = 'down' AND section = 'broad')"""
#: Of a candidate c, after _EXEMPLARS; null where nothing is liked.
_TASTE = f"""(SELECT max({_DOT.format('c.vector', 'x.vector')}) FROM liked JOIN candidates x USING (candidate_id))
    - coalesce((SELECT max({_DOT.format('c.vector', 'x.vector')}) FROM disliked JOIN candidates x USING (candidate_id)), 0)"""


_SITE = r"""CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) >= 2
    THEN regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') || '/' || list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1]
    ELSE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') END"""

ORACLE_SQL = {
    "vector_norms": f"SELECT vec_id, round(sqrt({_DOT.format('embedding', 'embedding')}), 5) AS length FROM embeddings",
    "pairwise_cosine": f"""SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT.format('a.embedding', 'b.embedding')}, 5) AS sim
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0""",
    "knn_pool": _sql(_POOL + " SELECT candidate_id, round(sim, 5) AS sim FROM pool"),
    "similarity_floor": _sql(_MET + ", " + _BEST + f" SELECT candidate_id, round(best, 5) AS best FROM best WHERE best >= {FLOOR}"),
    "negative_exemplars": _sql(_EXEMPLARS + f""" SELECT candidate_id FROM (SELECT c.candidate_id, (SELECT max({_DOT.format('c.vector', 'x.vector')}) FROM kept k JOIN candidates x USING (candidate_id)) AS u,
            (SELECT max({_DOT.format('c.vector', 'x.vector')}) FROM against k JOIN candidates x USING (candidate_id)) AS d
        FROM candidates c WHERE candidate_id % 11 > 0 AND candidate_id NOT IN (SELECT candidate_id FROM so_far)) WHERE u IS NULL OR d IS NULL OR NOT d > u""", "log", "feedback"),
    "rejected_stories": _sql(_EXEMPLARS + " SELECT candidate_id, url AS title, row_number() OVER (ORDER BY id DESC) AS place FROM against JOIN candidates USING (candidate_id)", "log", "feedback"),
    "assign_gate": _sql(_MET + f""" SELECT candidate_id, centroid, round(sim, 5) AS sim FROM (
        SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sim DESC, centroid) AS n FROM met) WHERE n = 1 AND sim >= {GATE}"""),
    "nearest_sim_stats": _sql(_MET + ", " + _BEST + " SELECT round(min(best), 5) AS least, round(median(best), 5) AS middle, round(max(best), 5) AS most FROM best"),
    "shortlist": _sql(_POOL + " SELECT candidate_id, round(sim, 5) AS sim FROM (SELECT * FROM pool ORDER BY sim DESC, candidate_id LIMIT 30)"),
    "minmax_relevance": _sql(_SHORT.format(n=150) + " SELECT candidate_id, round(relevance, 5) AS relevance FROM rel"),
    "penalised_relevance": _sql(_SHORT.format(n=150) + f""", s AS (SELECT r.candidate_id, {_SITE} AS site,
            CASE WHEN r.candidate_id % 4 = 0 THEN (r.candidate_id % 10) / 10 ELSE relevance END AS rel, r.candidate_id % 4 = 0 AS scored
            FROM rel r JOIN candidates c USING (candidate_id)),
        p AS (SELECT site FROM s GROUP BY site HAVING min(candidate_id) % 2 = 0),
        q AS (SELECT candidate_id, rel - CASE WHEN site IN (SELECT site FROM p) THEN 0.2 ELSE 0 END AS rel, scored FROM s)
        SELECT candidate_id, round(rel::DOUBLE, 5) AS relevance, scored FROM q WHERE rel > 0 AND (NOT scored OR rel >= 0.3)"""),
    "stale_filter": _sql(f""" SELECT candidate_id FROM (SELECT candidate_id, CASE WHEN candidate_id % 5 > 0
        THEN CAST(min(created_at) AS DATE) - CAST(candidate_id % 20 AS INTEGER) END AS published FROM log GROUP BY candidate_id)
        WHERE NOT coalesce(published < CAST('{AS_OF}' AS DATE) - 35, false)""", "log"),
    "source_partition": _sql(""" SELECT candidate_id, CASE WHEN source = 'searxng' THEN 'broad' ELSE 'curated' END AS section FROM candidates
        WHERE candidate_id NOT IN (SELECT candidate_id FROM served)""", "served"),
    "neighbour_pairs": _sql(_PAIRS + " SELECT * FROM pairs"),
    "duplicate_groups": _sql(_PAIRS + """, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT x AS node, x AS r FROM e UNION SELECT reach.node, e.y FROM reach JOIN e ON e.x = reach.r),
        roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
        best AS (SELECT root, bool_or(node % 11 = 0) AS old, arg_max(node, (node % 13) * 1000000 - node) AS best FROM roots GROUP BY root)
        SELECT node AS candidate_id, root FROM roots JOIN best USING (root) WHERE node % 11 <> 0 AND (old OR node <> best)"""),
    "mmr": _sql(_SHORT.format(n=40) + f""", v AS (SELECT candidate_id AS id, round(relevance, 5) AS rel, vector FROM rel JOIN candidates USING (candidate_id)),
        step AS (SELECT 0 AS place, (SELECT id FROM v ORDER BY rel DESC, id LIMIT 1) AS id, [(SELECT id FROM v ORDER BY rel DESC, id LIMIT 1)] AS ids
            UNION ALL SELECT s.place + 1, n.id, list_append(s.ids, n.id) FROM step s, LATERAL (
                SELECT v.id FROM v WHERE NOT list_contains(s.ids, v.id)
                ORDER BY round(0.6 * v.rel - 0.4 * (SELECT max({_DOT.format('v.vector', 'w.vector')}) FROM v w WHERE list_contains(s.ids, w.id)), 12) DESC, v.id LIMIT 1) n
            WHERE s.place < 9)
        SELECT id AS candidate_id, place::BIGINT AS place FROM step"""),
    "diversity": f"""SELECT a.label, count(DISTINCT a.vec_id) AS n, round(1 - avg({_DOT.format('a.embedding', 'b.embedding')}) FILTER (a.vec_id <> b.vec_id), 5) AS diversity
        FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.label""",
    "taste": _sql(_EXEMPLARS + f" SELECT candidate_id, round({_TASTE}, 5) AS taste FROM candidates c WHERE c.source = 'searxng'", "log", "feedback"),
    "interest_context": _sql(_MET + """ SELECT centroid, candidate_id, place FROM (SELECT centroid, candidate_id, row_number() OVER (PARTITION BY centroid ORDER BY sim DESC, candidate_id) AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sim DESC, centroid) AS n FROM met) WHERE n = 1) WHERE place <= 3"""),
}
