"""Vector searches. A query vector is a parameter; a table is scanned once, with a bounded top list for each task, and of an
index only the groups are read that can hold one of the nearest."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CANDIDATE_DAYS
from ..functions.vec import distance, similarity
from ..sources.storage import checkpointed
from . import knn

if TYPE_CHECKING:
    from .vector_index import VectorIndex


def array_of(q: list[float]) -> Column:
    return F.lit([float(x) for x in q])


def top_k(vectors: DataFrame | VectorIndex, q: list[float], k: int, object_type: str | None = None, metric: str = "cosine") -> DataFrame:
    if isinstance(vectors, DataFrame):
        v = vectors.where(F.col("object_type") == object_type) if object_type else vectors
    else:
        v = vectors.rows_for(q, k, object_type, metric)
    v = v.withColumn("distance", distance(F.col("x"), array_of(q), metric)).where("distance IS NOT NULL")
    nearest = F.desc("distance") if metric == "ip" else F.asc("distance")
    return v.orderBy(nearest, "id").limit(k).withColumn("similarity", similarity(F.col("distance"), metric))


def topics_strict(vectors: DataFrame | VectorIndex, q: list[float], limit: int = 3, least: float = 0.7) -> DataFrame:
    """The best similarity of each topic among the 10 x limit nearest, at least `least`; the best `limit` topics."""
    hits = top_k(vectors, q, 10 * limit, "topic_summary").where(F.col("similarity") >= least)
    return hits.groupBy("topic_id").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "topic_id").limit(limit)


def topics_lenient(vectors: DataFrame | VectorIndex, q: list[float], limit: int = 5) -> DataFrame:
    """The first `limit` distinct topics among the 2 x limit nearest."""
    hits = top_k(vectors, q, 2 * limit, "topic_summary")
    return hits.groupBy("topic_id").agg(F.min("distance").alias("distance")).orderBy("distance", "topic_id").limit(limit)


def candidates(items: DataFrame, summaries: DataFrame, k: int = 6, least: float = 0.5, topics: int = 3) -> DataFrame:
    """(id, topic_id, similarity, rank): for each item vector its k nearest summary vectors, of these those of at least this
    similarity, and of these the first distinct topics. Both sides may have any size (see knn)."""
    found = knn.nearest(items.select("id", "x"), knn.Cells(summaries), k, least)
    found = found.join(summaries.select(F.col("id").alias("other"), "topic_id"), "other")
    best = found.groupBy("id", "topic_id").agg(F.min("rank").alias("rn"), F.max("similarity").alias("similarity"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rn"))).where(F.col("rank") <= topics)
    return best.select("id", "topic_id", "similarity", "rank")


def fallback(items: DataFrame, found: DataFrame, topics: DataFrame, n: int = 3) -> DataFrame:
    """Items without a candidate get the n most recently active topics, without a similarity."""
    recent = topics.where("status = 'active'").orderBy(F.desc("last_active"), "topic_id").limit(n).select("topic_id")
    without = items.select("id").join(found.select("id").distinct(), "id", "left_anti")
    return without.join(F.broadcast(recent)).withColumn("similarity", F.lit(None).cast("double"))


def cosine_pairs(vectors: DataFrame, by: str, threshold: float, most: int | None = None) -> DataFrame:
    """(grp, a, b, cosine), a < b, within groups. A group is cut into blocks of `most` vectors, and each two blocks meet in a task
    of their own (see blocks). A group is one period's batch; for whole corpora there is the embedding operator of the llm subpackage."""
    return knn.pairs(checkpointed(knn.units(vectors, by=by)), threshold, most).withColumnRenamed("g", "grp")


def mergeable(summaries: DataFrame, topics: DataFrame, as_of: Column, days: int = CANDIDATE_DAYS) -> DataFrame:
    """Summary vectors of the topics that an event may join: active ones with activity in the last days."""
    t = topics.where((F.col("status") == "active") & (F.col("last_active") >= as_of - F.make_dt_interval(days=F.lit(days))))
    return summaries.join(t.select("topic_id"), "topic_id", "left_semi")


def get(vectors: DataFrame, object_type: str, ids: list[int]) -> DataFrame:
    """The stored vectors of these objects."""
    return vectors.where((F.col("object_type") == object_type) & F.col("id").isin(ids))


def or_else(found: DataFrame, other: DataFrame) -> DataFrame:
    """found, or the other rows (of the same columns) where nothing was found; both are top lists."""
    none = found.agg(F.count("*").alias("__n")).where("__n = 0")
    return found.unionByName(other.join(F.broadcast(none)).select(*found.columns))


def without_vector(objects: DataFrame, vectors: DataFrame, object_type: str) -> DataFrame:
    """The objects whose vector is missing, which a back-fill embeds."""
    return objects.join(vectors.where(F.col("object_type") == object_type).select("id"), "id", "left_anti")
