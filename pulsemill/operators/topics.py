"""Topics: lists, details, the item view, latest rows by topic, searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from ..constants import VIEW_FIELDS
from ..functions.timex import hours_between

ORDERS = {
    "echo_rank": lambda: [F.desc("hours"), F.desc(F.coalesce("heat", F.lit(0.0))), F.asc("topic_id")],
    "last_active_desc": lambda: [F.desc_nulls_first("last_active"), F.asc("topic_id")],
    "heat_desc": lambda: [F.desc_nulls_first("heat"), F.asc("topic_id")],
    "intensity_desc": lambda: [F.desc_nulls_first("intensity_total"), F.asc("topic_id")],
}


def with_hours(topics: DataFrame) -> DataFrame:
    return topics.withColumn("hours", hours_between(F.col("first_seen"), F.col("last_active")))


def filtered(topics: DataFrame, status: str | None = None, category: str | None = None, keyword: str | None = None, seen_from: Column | None = None, seen_to: Column | None = None) -> DataFrame:
    """The keyword is looked for literally and by case."""
    conds = [F.col("status") == status if status else None, F.col("category") == category if category else None, F.contains("title", F.lit(keyword)) if keyword else None]
    conds += [F.col("first_seen") >= seen_from if seen_from is not None else None, F.col("first_seen") <= seen_to if seen_to is not None else None]
    return reduce(DataFrame.where, [c for c in conds if c is not None], topics)


def page(topics: DataFrame, order: str = "echo_rank", number: int = 1, size: int = 20) -> DataFrame:
    if not 1 <= size <= 100 or number < 1:
        raise ValueError("size must be 1 to 100, and the page 1 or more")
    by = ORDERS.get(order, ORDERS["echo_rank"])()
    return with_hours(topics).orderBy(*by).offset((number - 1) * size).limit(size)


def platform_mentions(items: DataFrame) -> DataFrame:
    return items.groupBy("topic_id", "platform").agg(F.count("*").alias("mentions"))


def on_platforms(topics: DataFrame, items: DataFrame, platforms: list[str]) -> DataFrame:
    return topics.join(items.where(F.col("platform").isin(platforms)).select("topic_id"), "topic_id", "left_semi")


def latest(rows: DataFrame, by: str, order: list[Column], n: int = 1, rank: str = "rn") -> DataFrame:
    """The first n rows of each group in this order; Catalyst limits groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= n)


def newest_summary(summaries: DataFrame) -> DataFrame:
    """By partial aggregation, not a window: a topic with many summaries is no hot task."""
    return summaries.groupBy("topic_id").agg(F.max_by(F.struct("id", "content", "generated_at"), F.struct("generated_at", "id")).alias("s")).select("topic_id", F.col("s.id").alias("summary_id"), "s.content", "s.generated_at")


def item_view(topics: DataFrame, summaries: DataFrame, items: DataFrame) -> DataFrame:
    """Topics with their newest summary and every item; topics without either stay."""
    t = with_hours(topics).join(newest_summary(summaries).select("topic_id", F.col("content").alias("summary")), "topic_id", "left")
    i = items.select(
        F.col("topic_id").alias("__t"), F.col("id").alias("item_id"), F.col("title").alias("item_title"), F.col("summary").alias("item_summary"), F.col("url").alias("item_url"),
        F.col("platform").alias("item_platform"), F.col("published_at").alias("item_published_at"), F.col("fetched_at").alias("item_fetched_at"),
    )
    v = t.join(i, F.col("topic_id") == F.col("__t"), "left").drop("__t")
    return v.withColumnsRenamed({"heat": "heat_normalized", "hours": "echo_length_hours"})


LATEST_ITEM = lambda: [F.desc_nulls_last("item_published_at"), F.desc_nulls_last("item_fetched_at"), F.desc("item_id")]
QUERY_ORDERS = {"last_active_desc": "last_active", "heat_desc": "heat_normalized", "first_seen_desc": "first_seen", "echo_length_desc": "echo_length_hours", "intensity_desc": "intensity_total"}


def topic_query(view: DataFrame, fields: list[str] | None = None, status: str | None = None, category: str | None = None, title_contains: str | None = None, platforms: list[str] | None = None, start=None, end=None, order: str = "last_active_desc", limit: int = 20) -> DataFrame:
    """Filters on the view, the latest item of each topic that is left, chosen columns, order, limit of 1 to 50."""
    chosen = [f for f in fields or [] if f in VIEW_FIELDS] or ["topic_id", "title", "last_active"]
    chosen += [f for f in ("item_title", "item_summary", "item_url", "item_platform", "item_published_at") if f not in chosen]
    v = view
    for cond in (
        F.col("status") == status if status else None, F.col("category") == category if category else None, F.contains(F.lower("title"), F.lit(title_contains.lower())) if title_contains else None,
        F.col("item_platform").isin(platforms) if platforms else None, F.col("last_active") >= start if start is not None else None, F.col("first_seen") <= end if end is not None else None,
    ):
        v = v if cond is None else v.where(cond)
    by = QUERY_ORDERS.get(order, "last_active")
    return latest(v, "topic_id", LATEST_ITEM()).orderBy(F.desc_nulls_last(by), "topic_id").limit(max(1, min(limit, 50))).select(*chosen)


def keyword_search(topics: DataFrame, keywords: list[str], match_all: bool = False, since: Column | None = None, until: Column | None = None, limit: int = 10) -> DataFrame:
    hits = [F.contains(F.lower("title"), F.lit(k.lower())) for k in keywords]
    t = topics.where(reduce(lambda a, b: a & b if match_all else a | b, hits))
    t = t if since is None else t.where(F.col("last_active") >= since)
    t = t if until is None else t.where(F.col("first_seen") <= until)
    return t.orderBy(F.desc("last_active"), "topic_id").limit(limit)


def keyword_rerank(topics: DataFrame, keywords: list[str]) -> DataFrame:
    score = reduce(lambda a, b: a + b, [F.contains("title", F.lit(k)).cast("int") for k in keywords])
    return topics.withColumn("score", score.cast("bigint"))


def reranked(topics: DataFrame, keywords: list[str], order: list[Column]) -> DataFrame:
    """topics with their score, most keywords first and then in this order; none where no topic has any of the keywords."""
    if not keywords:
        return topics.withColumn("score", F.lit(0).cast("bigint")).orderBy(*order)
    scored = keyword_rerank(topics, keywords)
    some = scored.agg(F.max("score").alias("__most")).where("__most > 0")  # one row or none
    return scored.join(F.broadcast(some), F.col("__most") >= F.col("score")).drop("__most").orderBy(F.desc("score"), *order)


def active_node_counts(topics: DataFrame, items: DataFrame, since: Column) -> DataFrame:
    """(topic_id, node_count) of the active topics with activity since then."""
    t = topics.where((F.col("status") == "active") & (F.col("last_active") >= since)).select("topic_id")
    counts = items.join(t, "topic_id", "left_semi").groupBy("topic_id").agg(F.count("*").alias("n"))
    return t.join(counts, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).alias("node_count"))


def downselect(topics: DataFrame, ratio: float) -> DataFrame:
    """The hottest share of topics stays active, one at least; the others end, their heat 0 and last activity their first.

    The last one that stays is looked up in one range of a range partitioning: the sizes of the ranges before tell its rank in it."""
    order = [F.desc("__h"), F.asc("__id")]
    ranked = topics.select(F.coalesce("heat", F.lit(0.0)).alias("__h"), F.col("topic_id").alias("__id")).repartitionByRange(*order)
    ranked = checkpointed(ranked.withColumn("__p", F.spark_partition_id()))
    sizes = sorted((r["__p"], r["count"]) for r in ranked.groupBy("__p").count().collect())  # a row for each range
    rank, here = max(1, int(sum(c for _, c in sizes) * ratio)), 0
    for here, size in sizes:
        if rank <= size:
            break
        rank -= size
    edge = ranked.where(F.col("__p") == here).orderBy(*order).offset(rank - 1).limit(1).drop("__p")
    t = topics.crossJoin(F.broadcast(edge))
    h = F.coalesce("heat", F.lit(0.0))
    stays = (h > F.col("__h")) | ((h == F.col("__h")) & (F.col("topic_id") <= F.col("__id")))
    return t.withColumns({"status": F.when(stays, F.lit("active")).otherwise("ended"), "last_active": F.when(stays, F.col("last_active")).otherwise(F.col("first_seen")), "heat": F.when(stays, F.col("heat")).otherwise(0.0)}).drop("__h", "__id")


def key_nodes(nodes: DataFrame, most: int = 15) -> DataFrame:
    """The first node of a topic, its two with most interactions, and the last five; each once, in time order, `most` at most.
    nodes: topic_id, id, appended_at, interaction_total, has_interactions."""
    # each part is cut to a few rows of a topic before its shuffle, so a topic with very many nodes is no hot task
    narrow = [F.col(c) for c in nodes.columns]
    first = nodes.groupBy("topic_id").agg(F.min_by(F.struct(*narrow), F.struct("appended_at", "id")).alias("__n")).select("__n.*")
    peaks = latest(nodes.where("has_interactions"), "topic_id", [F.desc("interaction_total"), F.asc("id")], 2, "__rn").drop("__rn")
    last = latest(nodes, "topic_id", [F.desc("appended_at"), F.desc("id")], 5, "__rn").drop("__rn")
    n = first.unionByName(peaks).unionByName(last).dropDuplicates(["topic_id", "id"])
    return latest(n, "topic_id", [F.asc("appended_at"), F.asc("id")], most, "pos")
