"""A topic's timeline: repeated reports of one thing are one entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate(items: DataFrame) -> DataFrame:
    """Entries by topic, title and summary (or title, where that is empty): the newest report's id, how many there are, the span, the platforms."""
    t = items.withColumns({"__k1": F.trim("title"), "__k2": F.trim(F.coalesce(F.nullif("summary", F.lit("")), "title")), "at": F.coalesce("published_at", "fetched_at")})
    return t.groupBy("topic_id", "__k1", "__k2").agg(
        F.max_by("id", F.struct("at", "id")).alias("item_id"), F.count("*").alias("reports"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"),
    ).drop("__k1", "__k2")


def with_reports(items: DataFrame) -> DataFrame:
    """Entries like aggregate's, with what each report says, newest first: platforms, urls and times. What tells of several
    reports is null where there is one. A group is one topic's equal title and summary."""
    t = items.withColumns({"__k1": F.trim("title"), "__k2": F.trim(F.coalesce(F.nullif("summary", F.lit("")), "title")), "at": F.coalesce("published_at", "fetched_at")})
    g = t.groupBy("topic_id", "__k1", "__k2").agg(F.sort_array(F.collect_list(F.struct("at", "id", "platform", "url")), False).alias("r"))
    several = lambda c: F.when(F.size("r") > 1, c)
    return g.select(
        "topic_id", F.col("r")[0]["id"].alias("item_id"), F.col("r")[0]["at"].alias("at"), several(F.size("r")).cast("bigint").alias("reports"),
        several(F.array_min("r.at")).alias("first_at"), several(F.array_max("r.at")).alias("last_at"),
        several(F.col("r.platform")).alias("platforms"), several(F.col("r.url")).alias("urls"), several(F.col("r.at")).alias("times"),
    )
