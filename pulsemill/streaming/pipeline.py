"""The scheduled work as pure steps over tables, and as a stream of item files: merge items of a period into events, events into
topics, refresh what readers see. Every step can be repeated: names are hashes, decisions are kept in a ledger, and writes replace rows by key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import embedding_input, ngrams, normalize_title
from ..functions.vec import cosine
from ..operators import cluster, heat, knn, search, summaries
from ..providers import embed, same_event
from ..sources.storage import Store, checkpointed


#: Earlier periods in which a run looks for items that came too late: two days.
LATE_PERIODS = 8


def period_key(period: str) -> str:
    """What sorts period labels in time: the day and the place in it."""
    day, _, slot = period.partition("_")
    return day + str(K.PERIOD_ORDER.index(slot) + 1 if slot in K.PERIOD_ORDER else 9)


def period_order(period: Column) -> Column:
    """period_key of a column."""
    return F.concat(F.substring(period, 1, 10), F.array_position(F.array(*[F.lit(p) for p in K.PERIOD_ORDER]), F.split(period, "_")[1]).cast("string"))


def late(items: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """(of this period or later, late): items of earlier periods would wait for ever; they are told apart and reported."""
    order, now = period_order(F.col("period")), period_key(period)
    return items.where(order >= now), items.where(order < now)


def merge_events(items: DataFrame, cos: float = K.CLUSTER_COSINE, jac: float = K.CLUSTER_JACCARD) -> DataFrame:
    """Pending items (id, period, platform, title, summary, heat_value) with group, leader, occurrence and status: share of heat,
    leader clusters by title and vector within the period, the judge's word on each member, groups of two at least go on."""
    pending = heat.normalize(items.where("merge_status = 'pending_event_merge'"))
    pending = pending.withColumns({"__text": embedding_input(F.col("title"), F.col("summary")), "__title": normalize_title(F.col("title"))})
    # items with one title and text have the same neighbours and one another: the first of them stands for all, so that a crowd
    # of copies makes no pairs
    copies = pending.groupBy("period", "__title", "__text").agg(F.min("id").alias("__rep"))
    pending = pending.join(copies, ["period", "__title", "__text"]).withColumn("__rep", F.when(F.length("__title") >= 2, F.col("__rep")).otherwise(F.col("id")))
    pending = checkpointed(pending)
    first = checkpointed(embed(pending.where("id = __rep").select("period", "id", "__title", "__text"), "__text"))
    pairs = cluster.jaccard_pairs(first.select("period", "id", ngrams(F.col("__title")).alias("g")), "period", "id", "g", jac)
    x = first.select("id", "x")
    pairs = pairs.join(x.select(F.col("id").alias("a"), F.col("x").alias("ax")), "a").join(x.select(F.col("id").alias("b"), F.col("x").alias("bx")), "b")
    pairs = checkpointed(pairs.withColumn("cosine", cosine(F.col("ax"), F.col("bx"))).where(F.col("cosine") >= cos).select("a", "b", "jaccard", "cosine"))
    led = cluster.leader_clusters(first.select(F.col("id").alias("k")), pairs)
    same, confidence = same_event(F.col("jaccard"), F.col("cosine"))
    led = led.join(pairs.select(F.col("a").alias("leader"), F.col("b").alias("k"), "jaccard", "cosine"), ["leader", "k"], "left")
    accept = (F.col("k") == F.col("leader")) | F.coalesce(same, F.lit(False))
    led = led.select(F.col("k").alias("__rep"), F.when(accept, F.col("leader")).alias("leader"), F.coalesce(confidence, F.lit(1.0)).alias("confidence"))
    out = pending.join(led, "__rep").withColumn("leader", F.coalesce("leader", "id")).drop("__rep", "__title", "__text", "merge_status")
    return cluster.occurrence(out.withColumn("group_id", cluster.group_name(F.col("period"), F.col("leader"))), "group_id", K.MIN_OCCURRENCE)


def group_heads(events: DataFrame) -> DataFrame:
    g = events.where("merge_status = 'pending_global_merge'").groupBy("group_id", "period").agg(
        F.min("id").alias("id"), F.min_by("title", "id").alias("title"), F.count("*").alias("n"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_active"), F.sum("heat_normalized").alias("heat")
    )
    return g


def place_groups(heads: DataFrame, topics: DataFrame, least: float = K.MERGE_CONFIDENCE, as_of: Column | None = None) -> DataFrame:
    """heads (id, group_id, title) with x, the topic each belongs to and its similarity (null for a new one): the nearest of at least this similarity among the active
    topics with activity in the CANDIDATE_DAYS before as_of (without it, among all); the rest are clustered among
    themselves, so that two groups of one event make one topic. topics has x, the vector of its title."""
    h = checkpointed(embed(heads, "title"))
    old = topics if as_of is None else search.mergeable(topics, topics, as_of)
    found = search.candidates(h.select("id", "x"), old.select("topic_id", F.col("topic_id").alias("id"), "x"), least=K.CANDIDATE_COSINE).where((F.col("rank") == 1) & (F.col("similarity") >= least))
    with_target = checkpointed(h.join(found.select("id", "topic_id", "similarity"), "id", "left"))
    new = with_target.where("topic_id IS NULL").drop("topic_id")
    led = knn.leaders(new.select("id", "x"), least).select("id", F.col("leader").alias("topic_id"))
    return with_target.where("topic_id IS NOT NULL").unionByName(new.join(led, "id"))


TOPICS = "topic_id long, title string, first_seen timestamp_ntz, last_active timestamp_ntz, intensity_total long, heat double, status string, x array<double>, imported_total long"
PLACED = "item_id long, period string, group_id string, topic_id long, seq long, fetched_at timestamp_ntz, heat_normalized double, title string, x array<double>"


def table_or(store: Store, name: str, ddl: str, parts: list[str] | None = None) -> DataFrame:
    return store.read(name, parts) if store.exists(name) else store.spark.createDataFrame([], ddl)


def run_events(spark: SparkSession, store: Store, period: str) -> dict[str, int]:
    """The first stage: the period's waiting items get their group and status in one write, which touches the period only."""
    events = merge_events(store.read("items", [period]).where("merge_status = 'pending_event_merge'"))
    events = checkpointed(events)
    n, kept = events.agg(F.count("*"), F.count_if(F.col("merge_status") == "pending_global_merge")).first()
    if n:
        by_group = events.groupBy("group_id", "leader").agg(F.min_by("title", "id").alias("prompt"), F.to_json(F.struct(F.count("*").alias("items"), F.min("confidence").alias("confidence"))).alias("answer"), F.max("fetched_at").alias("at"))
        newest = F.lit(by_group.agg(F.max("at")).first()[0])
        summaries.recorder(store, "event_merge", newest, target="leader")(by_group.withColumn("status", F.lit("success")))
        known = store.read("items", [period])
        own = [c for c in known.columns if c not in ("group_id", "heat_normalized", "merge_status")]
        store.upsert("items", events.select(*own, "group_id", "heat_normalized", "merge_status"))
    return {"input": n, "kept": kept}


def run_topics(spark: SparkSession, store: Store, period: str, as_of: datetime | None = None, most: int | None = K.MAX_GROUPS) -> dict[str, int]:
    """The second stage: the first `most` waiting groups of the period are placed, and the tables follow. as_of: the run's time;
    without it, the newest of the groups' items.

    Where an item goes is decided once: the ledger `placements` gets a row for each item in one write, before any other state. A
    run that is repeated after a failure, wherever it was, leaves out what the ledger has, and derives the rest from it."""
    waiting = store.read("items", [period]).where("merge_status = 'pending_global_merge'")
    placed = table_or(store, "placements", PLACED, [period])
    waiting = checkpointed(waiting.join(placed.select(F.col("item_id").alias("id")), "id", "left_anti"))
    heads = group_heads(waiting)
    groups = heads.count()
    if groups:
        now = F.lit(as_of or heads.agg(F.max("last_active")).first()[0]).cast("timestamp_ntz")
        heads = heads.orderBy("id").limit(most) if most and most < groups else heads
        topics = table_or(store, "topics", TOPICS)
        to = checkpointed(place_groups(heads.select("id", "group_id", "title"), topics, as_of=now))
        decision = F.struct(F.when(F.col("similarity").isNull(), "new").otherwise("merge").alias("decision"), "topic_id", F.col("similarity").alias("confidence"))
        summaries.recorder(store, "global_merge", now, target="id")(to.select("id", F.lit("success").alias("status"), F.col("title").alias("prompt"), F.to_json(decision).alias("answer")))
        to = to.select("group_id", F.col("id").alias("seq"), "topic_id", F.col("title").alias("head_title"), "x")
        rows = waiting.join(to, "group_id")
        head = F.col("id") == F.col("seq")
        rows = rows.select(
            F.col("id").alias("item_id"), "period", "group_id", "topic_id", "seq", "fetched_at", "heat_normalized", F.when(head, F.col("head_title")).alias("title"), F.when(head, F.col("x")).alias("x")
        )
        store.append("placements", rows)
    return {"groups": groups, "left": max(0, groups - most) if most else 0, "topics": settle(spark, store, period)}


def settle(spark: SparkSession, store: Store, period: str) -> int:
    """Derives a period's state from the ledger: its nodes and heat, which are replaced, the topics that it touches, and the
    status of its items. It can be repeated at any time. Returns how many topics the period touches."""
    if not store.exists("placements"):
        return 0
    placed = store.read("placements", [period])
    store.replace_parts("nodes", placed.select("topic_id", "item_id", F.col("fetched_at").alias("appended_at"), "period", "heat_normalized"), [period])
    groups = placed.groupBy("topic_id", "period", "seq").agg(
        F.sum("heat_normalized").alias("heat"), F.count("*").alias("source_count"), F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_active")
    )
    heats = heat.add_groups(groups).join(groups.groupBy("topic_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_active").alias("last_active")), "topic_id")
    store.replace_parts("period_heat", heats, [period])
    touched = checkpointed(placed.select("topic_id").distinct())
    known = checkpointed(store.read_keys("topics", touched) if store.exists("topics") else spark.createDataFrame([], TOPICS))
    oldest = known.agg(F.min("first_seen")).first()[0]
    since = min(period_key(period), f"{oldest:%Y-%m-%d}0" if oldest else "9")
    totals = store.read("period_heat", [p for p in store.partitions("period_heat") if period_key(p) >= since]).join(touched, "topic_id", "left_semi")
    totals = totals.groupBy("topic_id").agg(
        F.sum("source_count").alias("__n"), F.min("first_seen").alias("__first"), F.max_by("last_active", F.struct(period_order(F.col("period")), "last_active")).alias("__last"), F.max("heat").alias("__heat")
    )
    head = placed.where("title IS NOT NULL").groupBy("topic_id").agg(F.min_by(F.struct("title", "x"), "seq").alias("__head"))
    t = totals.join(known, "topic_id", "left").join(head, "topic_id", "left")
    imported = F.coalesce("imported_total", "intensity_total", F.lit(0))  # what a topic had before the ledger knew of it
    t = t.select(
        "topic_id", F.coalesce("title", "__head.title").alias("title"), F.least("first_seen", "__first").alias("first_seen"), F.col("__last").alias("last_active"),
        (imported + F.col("__n")).alias("intensity_total"), F.greatest("heat", "__heat").alias("heat"), F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("x", "__head.x").alias("x"),
        imported.cast("long").alias("imported_total"),
    )
    store.upsert("topics", t)
    store.replace_parts("topic_changes", touched.select("topic_id", F.lit(period).alias("period"), F.current_timestamp().cast("timestamp_ntz").alias("changed_at")), [period])
    items = store.read("items", [period])
    done = items.where("merge_status = 'pending_global_merge'").join(placed.select(F.col("item_id").alias("id")), "id", "left_semi")
    store.upsert("items", done.withColumn("merge_status", F.lit("merged")))
    return touched.count()


def run_period(spark: SparkSession, store: Store, period: str, as_of: datetime | None = None, most: int | None = K.MAX_GROUPS) -> dict[str, int]:
    """Both stages for one period. Run again, also after a failure between any two writes, it changes nothing more. It reads and
    writes the period's partitions, and of the topics and their earlier heat what the period touches. Returns what a run log keeps."""
    earlier = [p for p in store.partitions("items") if period_key(p) < period_key(period)][-LATE_PERIODS:]
    log = {"late": store.read("items", earlier).where("merge_status = 'pending_event_merge'").count()}
    return log | run_events(spark, store, period) | run_topics(spark, store, period, as_of, most)


def start(spark: SparkSession, store: Store, path: str, schema: str, checkpoint: str):
    """A stream over item files: each micro-batch is stored by id, then every period in it is merged. Runs on what is there."""

    def batch(rows: DataFrame, epoch: int) -> None:
        periods = sorted((r[0] for r in rows.select("period").distinct().collect()), key=period_key)
        known = rows.join(store.read("items", periods).select("id"), "id", "left_anti") if store.exists("items") else rows
        store.append("items", known.dropDuplicates(["id"]))
        for p in periods:  # a batch holds the periods of a few runs
            run_period(spark, store, p)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, late_by: str = "2 hours") -> DataFrame:
    """Items by platform and hour, with a watermark for late ones; for streams and tables alike."""
    t = stream.withColumn("at", F.col("fetched_at").cast("timestamp"))
    return t.withWatermark("at", late_by).groupBy(F.window("at", "1 hour").alias("w"), "platform").agg(F.count("*").alias("items"), F.sum("heat_value").alias("heat"))
