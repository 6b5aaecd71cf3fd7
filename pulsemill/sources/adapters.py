"""The star-schema tables seen as the domain's tables (items, topics, nodes, summaries, vectors, runs). Real tables of the same
columns can take their place: every operator takes DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timex import period_label
from ..operators import heat

# Which event type stands for which platform.
PLATFORM_OF = {"click": "weibo", "view": "zhihu", "purchase": "toutiao", "signup": "sina", "error": "hupu"}
AS_OF = "2024-01-31 00:00:00"
STATUS = ["pending_event_merge", "pending_global_merge", "merged"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_items without texts; narrow over the events."""
    e = read(spark, sf_dir, "events")
    platform = F.create_map(*[F.lit(x) for kv in PLATFORM_OF.items() for x in kv])[F.col("event_type")]
    url = F.concat(F.lit("https://ex/"), platform, F.lit("/"), (F.col("event_id") % 500).cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("topic_id"), platform.alias("platform"),
        F.when(~F.col("event_type").isin("signup", "error"), F.col("value")).alias("heat_value"), F.col("ts").alias("fetched_at"), period_label(F.col("ts")).alias("period"),
        url.alias("url"), F.col("props").alias("interactions"), F.date_trunc("HOUR", F.col("ts")).cast("timestamp_ntz").alias("run_hour"),
        F.when(F.col("event_id") % 2 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("published_at"),
        F.element_at(F.array(*[F.lit(s) for s in STATUS]), (F.col("event_id") % 3 + 1).cast("int")).alias("merge_status"),
    )


def titled(spark: SparkSession, sf_dir: str, rows: DataFrame, item_id: str = "id") -> DataFrame:
    """rows with the title and summary of their item."""
    docs = read(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("__n"))
    texts = docs.select(F.col("doc_id").alias("__doc"), F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 200).alias("summary"))
    return rows.crossJoin(F.broadcast(n)).withColumn("__doc", F.col(item_id) % F.col("__n")).join(texts, "__doc", "left").drop("__doc", "__n")


def items_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir, items(spark, sf_dir))


def with_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat.normalize(items(spark, sf_dir))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = with_heat(spark, sf_dir)
    t = h.groupBy("topic_id").agg(
        F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_active"), F.count("*").alias("intensity_total"),
        F.round(F.sum("heat_normalized"), 9).alias("heat"), F.min("id").alias("__first"),
    )
    cat = F.element_at(F.array(F.lit("entertainment"), F.lit("current_affairs"), F.lit("sports_esports")), (F.col("topic_id") % 3 + 1).cast("int"))
    t = titled(spark, sf_dir, t, "__first").drop("summary", "__first")
    return t.withColumns({"category": cat, "status": F.when(F.col("topic_id") % 5 == 0, "ended").otherwise("active")})


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    n = items(spark, sf_dir).agg(F.countDistinct("topic_id").alias("n"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return d.crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("id"), (F.col("doc_id") % F.col("n")).alias("topic_id"), F.col("text").alias("content"), at.alias("generated_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 2 == 0, "topic_summary").otherwise("source_item")
    return e.select(F.col("vec_id").alias("id"), kind.alias("object_type"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 97).alias("topic_id"))


#: The same views for the SQL oracle.
ORACLE_VIEWS = """WITH RECURSIVE nd AS (SELECT count(*) AS n FROM documents),
core AS (SELECT event_id AS id, user_id AS topic_id, CASE event_type WHEN 'click' THEN 'weibo' WHEN 'view' THEN 'zhihu' WHEN 'purchase' THEN 'toutiao' WHEN 'signup' THEN 'sina' ELSE 'hupu' END AS platform,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN value END AS heat_value, ts AS fetched_at,
  strftime(ts, '%Y-%m-%d') || '_' || CASE WHEN hour(ts) < 10 THEN 'MORN' WHEN hour(ts) < 14 THEN 'AM' WHEN hour(ts) < 20 THEN 'PM' ELSE 'EVE' END AS period,
  props AS interactions, date_trunc('hour', ts) AS run_hour, CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 1 HOUR END AS published_at,
  CASE event_id % 3 WHEN 0 THEN 'pending_event_merge' WHEN 1 THEN 'pending_global_merge' ELSE 'merged' END AS merge_status FROM events),
items AS (SELECT c.*, 'https://ex/' || platform || '/' || CAST(c.id % 500 AS VARCHAR) AS url, substr(d.text, 1, 60) AS title, substr(d.text, 61, 200) AS summary FROM core c CROSS JOIN nd LEFT JOIN documents d ON d.doc_id = c.id % nd.n),
mm AS (SELECT *, min(heat_value) OVER w AS lo, max(heat_value) OVER w AS hi FROM core WINDOW w AS (PARTITION BY period, platform)),
weighted AS (SELECT *, (CASE WHEN heat_value IS NULL OR lo IS NULL OR hi = lo THEN 0.5::DOUBLE ELSE (heat_value - lo) / (hi - lo) END) * (CASE platform WHEN 'weibo' THEN 1.2::DOUBLE WHEN 'zhihu' THEN 1.1::DOUBLE WHEN 'toutiao' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) / 6.9::DOUBLE AS x FROM mm),
heat AS (SELECT *, CASE WHEN s > 0 THEN x / s ELSE x END AS heat_normalized FROM (SELECT *, sum(x) OVER (PARTITION BY period) AS s FROM weighted)),
t0 AS (SELECT topic_id, min(fetched_at) AS first_seen, max(fetched_at) AS last_active, count(*) AS intensity_total, round(sum(heat_normalized), 9) AS heat, min(id) AS first_id FROM heat GROUP BY topic_id),
topics AS (SELECT t0.*, CASE topic_id % 3 WHEN 0 THEN 'entertainment' WHEN 1 THEN 'current_affairs' ELSE 'sports_esports' END AS category, CASE WHEN topic_id % 5 = 0 THEN 'ended' ELSE 'active' END AS status,
  substr(d.text, 1, 60) AS title, epoch(last_active - first_seen) / 3600.0::DOUBLE AS hours FROM t0 CROSS JOIN nd LEFT JOIN documents d ON d.doc_id = first_id % nd.n),
summaries AS (SELECT doc_id AS id, doc_id % (SELECT count(DISTINCT user_id) FROM events) AS topic_id, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS generated_at FROM documents),
vectors AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'topic_summary' ELSE 'source_item' END AS object_type, label AS grp, CAST(embedding AS DOUBLE[]) AS x, vec_id % 97 AS topic_id FROM embeddings)
"""
