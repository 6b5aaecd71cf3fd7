"""Category statistics, day series, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CATEGORIES
from ..functions.text import days_hours


def category_relation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "category string, display string")


def category_metrics(topics: DataFrame, ended_only: bool = False, since: Column | None = None) -> DataFrame:
    """One row for each category, zero where it has no topic (seen `since` then). topics with hours. Ties of the longest and the shortest go to the smallest id."""
    spark = topics.sparkSession
    t = topics.where("status = 'ended'") if ended_only else topics
    t = t if since is None else t.where(F.col("first_seen") >= since)
    m = t.groupBy("category").agg(
        F.count("*").alias("topics_count"), F.count_if(F.col("status") == "active").alias("topics_active"), F.count_if(F.col("status") == "ended").alias("topics_ended"),
        F.avg("hours").alias("avg_hours"), F.max("hours").alias("max_hours"), F.min("hours").alias("min_hours"),
        F.max_by("topic_id", F.struct("hours", -F.col("topic_id"))).alias("max_topic_id"), F.min_by("topic_id", F.struct("hours", "topic_id")).alias("min_topic_id"),
        F.sum("intensity_total").alias("intensity_sum"), F.avg("intensity_total").alias("intensity_avg"), F.max("intensity_total").alias("intensity_max"), F.sum("heat").alias("heat_sum"), F.avg("heat").alias("heat_avg"),
    )
    r = F.broadcast(category_relation(spark)).join(m, "category", "left")
    zero = lambda c, n=2: F.round(F.coalesce(F.col(c), F.lit(0.0)), n).alias(c)
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return r.select(
        "category", *[none(c) for c in ("topics_count", "topics_active", "topics_ended")], *[zero(c) for c in ("avg_hours", "max_hours", "min_hours")], "max_topic_id", "min_topic_id",
        none("intensity_sum"), zero("intensity_avg"), none("intensity_max"), zero("heat_sum", 6), zero("heat_avg", 6), days_hours(F.round(F.coalesce("avg_hours", F.lit(0.0)), 2)).alias("display"),
    )


SERIES = {
    "topics_count": lambda: F.count("*"), "avg_hours": lambda: F.round(F.avg("hours"), 2), "max_hours": lambda: F.round(F.max("hours"), 2),
    "intensity_sum": lambda: F.sum("intensity_total"), "intensity_avg": lambda: F.round(F.avg("intensity_total"), 2), "heat_sum": lambda: F.round(F.sum("heat"), 6),
}


def category_series(topics: DataFrame, category: str, metric: str) -> DataFrame:
    """(day, value) of one metric of a category's topics by the day they were first seen. Unknown names are refused."""
    if category not in CATEGORIES or metric not in SERIES:
        raise ValueError(f"no such category or metric: {category}, {metric}; there are {', '.join([*CATEGORIES, *SERIES])}")
    days = topics.where(F.col("category") == category).groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day"))
    return days.agg(F.coalesce(SERIES[metric]().cast("double"), F.lit(0.0)).alias("value"))


def summary(topics: DataFrame, items: DataFrame) -> DataFrame:
    """One row: topics by status, and the last run with its outcome."""
    t = topics.agg(F.count("*").alias("topics_total"), F.count_if(F.col("status") == "active").alias("topics_active"), F.count_if(F.col("status") == "ended").alias("topics_ended"))
    last = runs(items).agg(F.max_by(F.struct("run_hour", "status", "total_items"), "run_hour").alias("r"))
    return t.crossJoin(F.broadcast(last)).select("topics_total", "topics_active", "topics_ended", "r.run_hour", F.col("r.status").alias("run_status"), F.col("r.total_items").alias("run_items"))


def global_rates(groups: DataFrame) -> DataFrame:
    """Of groups (period, merged, seconds): how many joined a topic of before, and the seconds that one took."""
    g = groups.groupBy("period").agg(F.count("*").alias("groups"), F.count_if("merged").alias("merged"), F.sum("seconds").alias("seconds"))
    return g.select("period", "groups", ratio(F.col("merged"), F.col("groups")).alias("merge_rate"), ratio(F.col("seconds"), F.col("groups")).alias("avg_seconds"))


def per_day(rows: DataFrame, ts: str, out: str = "n") -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias(out))


def spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS day")


def total_per_day(topics: DataFrame, start: str, end: str) -> DataFrame:
    """Topics seen up to each day. Counts by day come first; only they (a row a day) meet in one window."""
    days = spine(topics.sparkSession, start, end)
    counts = per_day(topics, "first_seen").withColumn("day", F.greatest("day", F.lit(start).cast("date"))).groupBy("day").agg(F.sum("n").alias("n"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(counts, "day", "left").select("day", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint").alias("total"))


def active_per_day(topics: DataFrame, start: str, end: str) -> DataFrame:
    """Topics now active whose last activity is at the day before or later: a running count from the end."""
    days = spine(topics.sparkSession, start, end)
    counts = per_day(topics.where("status = 'active'"), "last_active").withColumn("day", F.least(F.date_add("day", 1), F.lit(end).cast("date"))).groupBy("day").agg(F.sum("n").alias("n"))
    w = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    return days.join(counts, "day", "left").select("day", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint").alias("active"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def runs(items: DataFrame) -> DataFrame:
    """One run for each fetch hour: items without heat failed."""
    r = items.groupBy("run_hour").agg(
        F.count("*").alias("total_items"), F.count("heat_value").alias("success_items"), F.count_if(F.col("heat_value").isNull()).alias("failed_items"), F.countDistinct("platform").alias("platforms"),
        (F.unix_timestamp(F.max("fetched_at")) - F.unix_timestamp(F.min("fetched_at"))).alias("seconds"),
    )
    status = F.when(F.col("failed_items") == 0, "success").when(F.col("success_items") == 0, "failed").otherwise("partial")
    return r.withColumns({"status": status, "success_rate": F.round(ratio(F.col("success_items"), F.col("total_items")), 4)})
