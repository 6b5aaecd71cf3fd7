"""Queries of exact neighbours, leaders and the vector index. The domain's thresholds are used on the first six components of
the vectors, where they separate."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import knn, search, vector_index
from ..sources import adapters as A
from .catalogue import Q0, Q0_SQL, query, r6

_LOW = ", low AS (SELECT id, object_type, topic_id, x[1:6] AS x FROM vectors)"


def low(s, d):
    return A.vectors(s, d).withColumn("x", F.slice("x", 1, 6))


_NEAR = _LOW + f""", near AS (SELECT q.id AS id, s.topic_id, s.id AS sid, list_cosine_similarity(q.x, s.x) AS c FROM low q, low s WHERE q.object_type = 'source_item' AND s.object_type = 'topic_summary'
  AND s.topic_id IN (SELECT topic_id FROM topics WHERE status = 'active' AND last_active >= TIMESTAMP '2024-07-28 00:00:00' - INTERVAL 180 DAY)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, sid) AS rn FROM near), b AS (SELECT id, topic_id, min(rn) AS rn, max(c) AS c FROM k WHERE rn <= 6 AND c >= {K.CANDIDATE_COSINE} GROUP BY id, topic_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS rank FROM b)
"""


def _candidates(s, d):
    v = low(s, d)
    as_of = F.lit("2024-07-28 00:00:00").cast("timestamp_ntz")
    open_topics = search.mergeable(v.where("object_type = 'topic_summary'"), A.topics(s, d), as_of)
    return search.candidates(v.where("object_type = 'source_item'"), open_topics, 6, K.CANDIDATE_COSINE, K.CANDIDATES)


@query(_NEAR + "SELECT id, topic_id, round(c, 6) AS similarity, rank FROM cand WHERE rank <= 3")
def candidate_topics_domain(s, d):
    return _candidates(s, d).select("id", "topic_id", r6("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(_NEAR + f"SELECT v.id, CASE WHEN c >= {K.MERGE_CONFIDENCE} THEN 'merge' ELSE 'new' END AS decision, CASE WHEN c >= {K.MERGE_CONFIDENCE} THEN cand.topic_id END AS target FROM vectors v LEFT JOIN cand ON cand.id = v.id AND cand.rank = 1 WHERE v.object_type = 'source_item'")
def merge_decision_domain(s, d):
    v = low(s, d).where("object_type = 'source_item'").select("id").join(_candidates(s, d).where("rank = 1"), "id", "left")
    ok = F.coalesce(F.col("similarity") >= K.MERGE_CONFIDENCE, F.lit(False))
    return v.select("id", F.when(ok, "merge").otherwise("new").alias("decision"), F.when(ok, F.col("topic_id")).alias("target"))


_WALK = _LOW + """, e AS (SELECT a.id AS a, b.id AS b FROM low a JOIN low b ON a.id < b.id AND list_cosine_similarity(a.x, b.x) >= {least}),
ord AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM low),
walk(n, led, taken) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT o.n, CASE WHEN list_contains(w.taken, o.id) THEN w.led ELSE list_append(w.led, o.id) END, CASE WHEN list_contains(w.taken, o.id) THEN w.taken ELSE list_concat(w.taken, coalesce((SELECT list(e.b) FROM e WHERE e.a = o.id), [])) END FROM walk w JOIN ord o ON o.n = w.n + 1),
fin AS (SELECT led FROM walk ORDER BY n DESC LIMIT 1)
SELECT v.id AS id, CASE WHEN list_contains(fin.led, v.id) THEN v.id ELSE (SELECT min(e.a) FROM e WHERE e.b = v.id AND list_contains(fin.led, e.a)) END AS leader FROM low v, fin"""

for _name, _least in (("vector_leaders", K.CLUSTER_COSINE), ("vector_leaders_merge", K.MERGE_CONFIDENCE)):
    query(_WALK.format(least=_least), _name)(lambda s, d, t=_least: knn.leaders(low(s, d).select("id", "x"), t))


@query(_LOW + """, k AS (SELECT q.id AS id, s.id AS other, list_cosine_similarity(q.x, s.x) AS c FROM low q, low s WHERE q.object_type = 'source_item' AND s.object_type = 'topic_summary')
SELECT id, other, round(c, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rank FROM k) WHERE rank <= 4""")
def nearest_neighbours(s, d):
    v = low(s, d)
    near = knn.nearest(v.where("object_type = 'source_item'"), knn.Cells(v.where("object_type = 'topic_summary'")), 4)
    return near.select("id", "other", r6("similarity"), F.col("rank").cast("bigint").alias("rank"))


def _indexed(s, d):
    """An index that is built from half of the vectors and then gets the others."""
    v = A.vectors(s, d)
    index = vector_index.scratch_index(v.where("id % 4 < 2"))
    index.add(v.where("id % 4 >= 2"))
    return index


for _m, _dist, _ord, _sim in (
    ("cosine", f"1 - list_cosine_similarity(x, {Q0_SQL})", "ASC", "1 - dist"),
    ("ip", f"list_inner_product(x, {Q0_SQL})", "DESC", "dist"),
    ("l2", f"pow(list_distance(x, {Q0_SQL}), 2)", "ASC", "1 / (1 + dist)"),
):
    query(f"SELECT id, round(dist, 6) AS distance, round({_sim}, 6) AS similarity FROM (SELECT id, {_dist} AS dist FROM vectors WHERE object_type = 'topic_summary') ORDER BY dist {_ord}, id LIMIT 10", f"index_topk_{_m}")(
        lambda s, d, m=_m: search.top_k(_indexed(s, d), Q0, 10, "topic_summary", m).select("id", r6("distance"), r6("similarity"))
    )


@query(f"SELECT id, round(c, 6) AS cosine FROM (SELECT id, list_cosine_similarity(x, {Q0_SQL}) AS c FROM vectors WHERE object_type = 'source_item' AND topic_id = 5) ORDER BY c DESC, id LIMIT 5")
def index_node_search(s, d):
    near = _indexed(s, d).search(Q0, 5, "source_item", where=F.col("topic_id") == 5)
    return near.select("id", F.round(1 - F.col("distance"), 6).alias("cosine"))


@query(f", h AS (SELECT topic_id, list_cosine_similarity(x, {Q0_SQL}) AS c, id FROM vectors WHERE object_type = 'topic_summary' ORDER BY 1 - c, id LIMIT 30) SELECT topic_id, round(max(c), 6) AS similarity FROM h WHERE c >= 0.1 GROUP BY topic_id ORDER BY max(c) DESC, topic_id LIMIT 3")
def index_topics_strict(s, d):
    return search.topics_strict(_indexed(s, d), Q0, 3, 0.1).withColumn("similarity", F.round("similarity", 6))
