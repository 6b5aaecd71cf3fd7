"""Heat: min-max scaling by period and platform, platform weights, share of the period; and its roll-ups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_WEIGHT, PERIOD_ORDER, PLATFORM_WEIGHTS


def weights_of(setting: str) -> dict[str, float]:
    """Platform weights as a setting has them: a JSON object of numbers; ValueError for anything else."""
    found = json.loads(setting)
    if not isinstance(found, dict) or not all(isinstance(v, int | float) and not isinstance(v, bool) for v in found.values()):
        raise ValueError("weights are a JSON object of numbers")
    return {k: float(v) for k, v in found.items()}


def weight(platform: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (weights or PLATFORM_WEIGHTS).items() for x in kv])
    return F.coalesce(table[platform], F.lit(DEFAULT_WEIGHT))


def normalize(items: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """items (period, platform, heat_value) with heat_normalized, which adds up to 1 in each period.

    A period is as large as its items, so no window sorts one: minima, maxima and sums are aggregated first (map-side) and
    joined back; a few rows for each period, which Spark broadcasts while they are small."""
    total = sum((weights or PLATFORM_WEIGHTS).values())
    ends = items.groupBy("period", "platform").agg(F.min("heat_value").alias("__lo"), F.max("heat_value").alias("__hi"))
    x = F.when(F.col("heat_value").isNull() | (F.col("__hi") == F.col("__lo")), 0.5).otherwise((F.col("heat_value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    scaled = items.join(ends, ["period", "platform"], "left").withColumn("__x", x * weight(F.col("platform"), weights) / F.lit(total))
    sums = scaled.groupBy("period").agg(F.sum("__x").alias("__s"))
    share = F.when(F.col("__s") > 0, F.col("__x") / F.col("__s")).otherwise(F.col("__x"))
    return scaled.join(sums, "period", "left").withColumn("heat_normalized", share).drop("__lo", "__hi", "__x", "__s")


def platform_stats(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("heat_value", F.lit(0.0))).alias("heat_sum"), F.sum("heat_normalized").alias("share_sum"), F.avg("heat_normalized").alias("share_avg")
    )


def period_heat(items: DataFrame, mode: str = "sum") -> DataFrame:
    """Heat of each topic by date and period. mode `sum` adds its groups' heat; `last` keeps the last item's, as a merge that
    overwrites does."""
    value = F.sum("heat_normalized") if mode == "sum" else F.max_by("heat_normalized", "id")
    parts = F.split("period", "_")
    return items.groupBy("topic_id", "period").agg(value.alias("heat"), F.count("*").alias("source_count")).select("topic_id", parts[0].alias("day"), parts[1].alias("slot"), "heat", "source_count")


def peak(heats: DataFrame) -> DataFrame:
    return heats.groupBy("topic_id").agg(F.max("heat").alias("peak_heat"), F.sum("source_count").alias("items"))


def running_peak(heats: DataFrame) -> DataFrame:
    """The peak so far at each period; one topic's periods are a window."""
    order = F.array_position(F.array(*[F.lit(p) for p in PERIOD_ORDER]), F.col("slot"))
    w = Window.partitionBy("topic_id").orderBy("day", order).rowsBetween(Window.unboundedPreceding, 0)
    return heats.withColumn("peak_so_far", F.max("heat").over(w))


def add_groups(groups: DataFrame) -> DataFrame:
    """Of groups (topic_id, period, seq, heat, source_count) that join topics one by one: a topic's heat in a period is what
    the last group left, and its sources add up."""
    g = groups.groupBy("topic_id", "period").agg(F.max_by("heat", "seq").alias("heat"), F.sum("source_count").alias("source_count"))
    return g.select("topic_id", "period", "heat", "source_count")


def raised_peaks(topics: DataFrame, period_heat: DataFrame) -> DataFrame:
    """(topic_id, heat) of the topics whose heat isn't the highest of their periods: what a back-fill writes."""
    peaks = period_heat.groupBy("topic_id").agg(F.max("heat").alias("__peak"))
    return topics.join(peaks, "topic_id").where(~F.col("heat").eqNullSafe(F.col("__peak"))).select("topic_id", F.col("__peak").alias("heat"))
