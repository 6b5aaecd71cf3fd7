"""What surrounds a merge: the run log, draining what is pending, and refreshing what readers see. Steps can be repeated."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import classify, heat, metrics, summaries
from ..operators import topics as T
from ..sources.storage import Store, checkpointed
from . import pipeline

RUNS = "run_id string, period string, stage string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, counters string, error string"
SUMMARIES = "id long, topic_id long, content string, method string, generated_at timestamp_ntz"

# Hours and minutes at which the stages of a day start.
SCHEDULE = {
    "ingest": [(8, 0), (10, 0), (12, 0), (14, 0), (16, 0), (18, 0), (20, 0), (22, 0)],
    "merge_events": [(8, 5), (12, 5), (18, 5), (22, 5)], "merge_topics": [(8, 20), (12, 20), (18, 20), (22, 20)], "category_metrics": [(1, 0)],
}


def stages_due(since: datetime, until: datetime) -> list[str]:
    """Stages that start after `since` and up to `until`, on the same day, in the order of their times; for an outer scheduler."""
    at = sorted((since.replace(hour=h, minute=m, second=0, microsecond=0), name) for name, times in SCHEDULE.items() for h, m in times)
    return [name for t, name in at if since < t <= until]


def logged(spark: SparkSession, store: Store, period: str, stage: str, run: Callable[[], dict], now: Callable[[], datetime] = datetime.now) -> dict:
    """run()'s counters. The log has a row of it: running, then success with the counters, or failed with the error, which is
    raised again."""
    run_id, began = uuid.uuid4().hex, now()

    def put(status: str, counters: dict | None = None, error: str | None = None) -> None:
        row = (run_id, period, stage, status, began, None if status == "running" else now(), json.dumps(counters or {}), error)
        store.upsert("runs", spark.createDataFrame([row], RUNS), ["run_id"])

    put("running")
    try:
        counters = run()
    except Exception as x:
        put("failed", error=str(x)[:500])
        raise
    put("success", counters)
    return counters


def pending_periods(store: Store) -> list[str]:
    """Periods with items that wait for either stage, oldest first: four a day at most."""
    rows = store.read("items").where("merge_status IN ('pending_event_merge', 'pending_global_merge')").select("period").distinct().collect()
    return sorted((r[0] for r in rows), key=pipeline.period_key)


def drain(spark: SparkSession, store: Store, most: int = 100) -> int:
    """Merges waiting periods until none waits or a round changes nothing; how many rounds it took."""
    for k in range(most):
        waiting = pending_periods(store)
        if not waiting:
            return k
        moved = 0
        for period in waiting:
            log = logged(spark, store, period, "merge", lambda p=period: pipeline.run_period(spark, store, p))
            moved += log["input"] + log["groups"]
        if not moved:
            return k
    return most


def changed_topics(store: Store) -> tuple[DataFrame | None, dict[str, list[str]]]:
    """(topics touched by merges since the last refresh, or None for all, and what to remember of the change log). The log has a
    partition for each period, which a merge replaces: those whose files aren't the ones that the last refresh saw count."""
    parts = store.manifest("topic_changes")["parts"]
    seen = store.read("system_config").where("key = 'refreshed'").first() if store.exists("system_config") else None
    if seen is None or not parts:
        return None, parts
    seen = json.loads(seen["value"])
    return store.read("topic_changes", [p[1:] for p in parts if parts[p] != seen.get(p)]).select("topic_id").distinct(), parts


def put_config(store: Store, key: str, value: str, at: Column) -> None:
    store.upsert("system_config", store.spark.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), at.cast("timestamp_ntz").alias("updated_at")))


class Touched:
    """The store's tables, cut to some topics; None: all of them."""

    def __init__(self, store: Store, topics: DataFrame | None):
        self.store, self.ids = store, None if topics is None else checkpointed(topics)
        self.periods: list[str] | None = None
        if self.ids is not None and store.exists("period_heat"):  # where these topics have nodes: a row for each period at most
            heats = store.read("period_heat").join(self.ids, "topic_id", "left_semi")
            self.periods = sorted(r[0] for r in heats.select("period").distinct().collect())

    def only(self, rows: DataFrame) -> DataFrame:
        return rows if self.ids is None else rows.join(self.ids, "topic_id", "left_semi")

    def by_topic(self, name: str) -> DataFrame:
        """Rows of a table that is cut by topic_id."""
        return self.store.read(name) if self.ids is None else self.store.read_keys(name, self.ids)

    def nodes(self) -> DataFrame:
        return self.only(self.store.read("nodes", self.periods))

    def items(self) -> DataFrame:
        """The items of topics, with columns that sources may lack as nulls."""
        nodes = self.nodes().select("topic_id", F.col("item_id").alias("id"), "appended_at")
        items = nodes.join(self.store.read("items", self.periods), "id")
        return items.withColumns({c: F.lit(None).cast(t) for c, t in (("url", "string"), ("published_at", "timestamp_ntz"), ("interactions", "string")) if c not in items.columns})

    def topics(self) -> DataFrame:
        t = self.by_topic("topics")
        if not self.store.exists("topic_categories"):
            return t.withColumn("category", F.lit(None).cast("string"))
        return t.join(self.by_topic("topic_categories").select("topic_id", "category"), "topic_id", "left")

    def put(self, name: str, rows: DataFrame) -> None:
        """rows are all that the table has of these topics."""
        if self.ids is None or not self.store.exists(name):
            self.store.replace(name, rows)
        else:
            self.store.replace_rows(name, rows, self.ids)


def _categories(t: Touched, as_of: Column, provider: str) -> None:
    topics = t.by_topic("topics").where("status = 'active'")
    new = topics.join(t.by_topic("topic_categories").select("topic_id"), "topic_id", "left_anti") if t.store.exists("topic_categories") else topics
    t.store.upsert("topic_categories", classify.classify(new, t.items(), provider, record=summaries.recorder(t.store, "classify", as_of, provider)))


def _told(t: Touched) -> DataFrame:
    return t.only(t.store.read("summaries")) if t.store.exists("summaries") else t.store.spark.createDataFrame([], SUMMARIES)


def _summaries(t: Touched, as_of: Column, provider: str) -> None:
    nodes = t.items().select(
        "topic_id", "id", "appended_at", F.concat_ws(" ", "title", "summary").alias("text"), jsonx.interaction_total(F.col("interactions")).alias("interaction_total"), F.col("interactions").isNotNull().alias("has_interactions")
    )
    new = summaries.refresh(t.by_topic("topics"), nodes, _told(t), as_of, provider, record=summaries.recorder(t.store, "summary", as_of, provider))
    new = new.select(F.abs(F.xxhash64("topic_id", "generated_at")).alias("id"), "topic_id", "content", "method", "generated_at")
    t.store.upsert("summaries", new)
    missing = _told(t)
    missing = missing.join(t.store.read_keys("summary_vectors", missing.select("id")).select("id"), "id", "left_anti") if t.store.exists("summary_vectors") else missing
    t.store.upsert("summary_vectors", summaries.vectors_of(missing))


def _stats(t: Touched, as_of: Column) -> None:
    t.store.upsert("topic_stats", T.active_node_counts(t.by_topic("topics"), t.nodes(), as_of - F.expr("INTERVAL 1 HOUR")))


def _metrics(store: Store, as_of: Column, window_days: int = 365) -> None:
    """The day's statistics of topics seen in the last year; the day is replaced if it is there."""
    since = F.date_trunc("DAY", as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(window_days))
    m = metrics.category_metrics(T.with_hours(Touched(store, None).topics()), since=since)
    store.replace_days("category_days", m.withColumn("day", F.date_format(as_of, "yyyy-MM-dd")))


def _peaks(t: Touched) -> None:
    topics = t.by_topic("topics")
    raised = heat.raised_peaks(topics, t.only(t.store.read("period_heat", t.periods))).withColumnRenamed("heat", "__heat")
    t.store.upsert("topics", topics.join(raised, "topic_id").withColumn("heat", F.col("__heat")).select(topics.columns))


def refresh(spark: SparkSession, store: Store, as_of: Column, provider: str = "stub", full: bool = False) -> dict[str, str]:
    """All that follows a merge, step by step: a step that fails is reported and doesn't keep the others from running. Only
    topics that merges touched since the last refresh are worked on (full: all); their rows in the tables that readers see are
    replaced, and partitions without any of them keep their files. What is done is remembered when all steps went well, so after
    a failure the next refresh does these topics again."""
    changed, parts = changed_topics(store)
    t = Touched(store, None if full else changed)
    steps: dict[str, Callable[[], None]] = {
        "timestamp": lambda: put_config(store, "last_merge_time", str(spark.range(1).select(as_of.cast("string")).first()[0]), as_of) if store.exists("topics") else store.read("topics"),
        "peaks": lambda: _peaks(t),
        "categories": lambda: _categories(t, as_of, provider),
        "summaries": lambda: _summaries(t, as_of, provider),
        "stats": lambda: _stats(t, as_of),
        "view": lambda: t.put("topic_item_view", T.item_view(t.topics(), _told(t), t.items()).drop("x", "imported_total")),
        "category_metrics": lambda: _metrics(store, as_of),
    }
    done = {}
    for name, step in steps.items():
        try:
            step()
            done[name] = "ok"
        except Exception as x:  # the others still run
            done[name] = str(x)[:300]
    if all(x == "ok" for x in done.values()):
        put_config(store, "refreshed", json.dumps(parts), as_of)
    return done
