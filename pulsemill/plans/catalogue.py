"""Every query by name, with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonx, text, timex
from ..operators import access, cluster, context, heat, knn, metrics, search, timeline
from ..operators import topics as T
from ..sources import adapters as A
from ..sources import storage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = A.ORACLE_VIEWS + sql
        return f

    return put


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
r6 = lambda c, out=None: F.round(c, 6).alias(out or c)
ts = lambda c: timex.ts_text(F.col(c)).alias(c)
Q0 = [((i * 37) % 64 - 31.5) / 100 for i in range(64)]
Q0_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in Q0) + "]"

# ---------------------------------------------------------------- heat


@query("SELECT id, period, platform, round(heat_normalized, 9) AS heat_normalized FROM heat")
def heat_normalize(s, d):
    return A.with_heat(s, d).select("id", "period", "platform", F.round("heat_normalized", 9).alias("heat_normalized"))


@query("SELECT platform, count(*) AS n, round(sum(coalesce(heat_value, 0.0)), 4) AS heat_sum, round(sum(heat_normalized), 6) AS share_sum, round(avg(heat_normalized), 9) AS share_avg, round(CASE platform WHEN 'weibo' THEN 1.2::DOUBLE WHEN 'zhihu' THEN 1.1::DOUBLE WHEN 'toutiao' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, 2) AS weight FROM heat GROUP BY platform")
def heat_platform_stats(s, d):
    r = heat.platform_stats(A.with_heat(s, d), ["platform"])
    return r.select("platform", "n", F.round("heat_sum", 4).alias("heat_sum"), r6("share_sum"), F.round("share_avg", 9).alias("share_avg"), F.round(heat.weight(F.col("platform")), 2).alias("weight"))


@query("SELECT period, platform, count(*) AS n, round(sum(heat_normalized), 6) AS share_sum FROM heat GROUP BY period, platform")
def heat_period_stats(s, d):
    return heat.platform_stats(A.with_heat(s, d), ["period", "platform"]).select("period", "platform", "n", r6("share_sum"))


@query("SELECT id, period, split_part(period, '_', 1) AS day, split_part(period, '_', 2) AS slot FROM core")
def period_label(s, d):
    p = F.split("period", "_")
    return A.items(s, d).select("id", "period", p[0].alias("day"), p[1].alias("slot"))


_PH = "ph AS (SELECT topic_id, period, {} AS heat, count(*) AS source_count FROM heat GROUP BY topic_id, period), p AS (SELECT topic_id, split_part(period, '_', 1) AS day, split_part(period, '_', 2) AS slot, heat, source_count FROM ph)\n"


@query(", " + _PH.format("sum(heat_normalized)") + "SELECT topic_id, day, slot, round(heat, 9) AS heat, source_count FROM p")
def topic_period_heat(s, d):
    return heat.period_heat(A.with_heat(s, d)).withColumn("heat", F.round("heat", 9))


@query(", " + _PH.format("arg_max(heat_normalized, id)") + "SELECT topic_id, day, slot, round(heat, 9) AS heat, source_count FROM p")
def topic_period_heat_last(s, d):
    return heat.period_heat(A.with_heat(s, d), "last").withColumn("heat", F.round("heat", 9))


@query(", " + _PH.format("sum(heat_normalized)") + "SELECT topic_id, round(max(heat), 9) AS peak_heat, CAST(sum(source_count) AS BIGINT) AS items FROM p GROUP BY topic_id")
def topic_peak_heat(s, d):
    return heat.peak(heat.period_heat(A.with_heat(s, d))).withColumn("peak_heat", F.round("peak_heat", 9))


@query(", " + _PH.format("sum(heat_normalized)") + "SELECT topic_id, day, slot, round(max(heat) OVER (PARTITION BY topic_id ORDER BY day, list_position(['MORN', 'AM', 'PM', 'EVE'], slot)), 9) AS peak_so_far FROM p")
def running_peak_heat(s, d):
    return heat.running_peak(heat.period_heat(A.with_heat(s, d))).select("topic_id", "day", "slot", F.round("peak_so_far", 9).alias("peak_so_far"))


# ---------------------------------------------------------------- lists


def _listed(t):
    return t.select(F.col("topic_id").cast("string").alias("id"), "title", "status", "category", "intensity_total", F.when(F.col("heat") > 0, F.round("heat", 4)).otherwise(0.0).alias("intensity_norm"), F.round("hours", 1).alias("length_hours"), F.round(F.col("hours") / 24, 2).alias("length_days"), ts("first_seen"), ts("last_active"))


_LIST = f"SELECT CAST(topic_id AS VARCHAR) AS id, title, status, category, intensity_total, CASE WHEN heat > 0 THEN round(heat, 4) ELSE 0.0 END AS intensity_norm, round(hours, 1) AS length_hours, round(hours / 24, 2) AS length_days, {TS.format('first_seen')} AS first_seen, {TS.format('last_active')} AS last_active FROM topics "

for _name, _order, _sql in (
    ("topics_echo_rank", "echo_rank", "ORDER BY hours DESC, heat DESC, topic_id"),
    ("topics_last_active", "last_active_desc", "ORDER BY last_active DESC, topic_id"),
    ("topics_heat_desc", "heat_desc", "ORDER BY heat DESC, topic_id"),
    ("topics_intensity_desc", "intensity_desc", "ORDER BY intensity_total DESC, topic_id"),
):
    query(_LIST + _sql + " LIMIT 20", _name)(lambda s, d, o=_order: _listed(T.page(A.topics(s, d), o, 1, 20)))

query(_LIST + "ORDER BY hours DESC, heat DESC, topic_id LIMIT 20 OFFSET 20", "topics_page2")(lambda s, d: _listed(T.page(A.topics(s, d), "echo_rank", 2, 20)))


@query(_LIST + "WHERE status = 'active' AND category = 'entertainment' AND contains(title, 'th')")
def topics_filtered(s, d):
    return _listed(T.with_hours(T.filtered(A.topics(s, d), "active", "entertainment", "th")))


@query(_LIST + "WHERE first_seen BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-01 23:59:59.999999'")
def topics_today(s, d):
    day = lambda t: F.lit(t).cast("timestamp_ntz")
    return _listed(T.with_hours(T.filtered(A.topics(s, d), seen_from=day("2024-01-01 00:00:00"), seen_to=day("2024-01-01 23:59:59.999999"))))


@query("SELECT count(*) AS total FROM topics WHERE status = 'active'")
def topics_total(s, d):
    return T.filtered(A.topics(s, d), "active").agg(F.count("*").alias("total"))


@query("SELECT topic_id, platform, count(*) AS mentions FROM core GROUP BY topic_id, platform")
def topic_platform_mentions(s, d):
    return T.platform_mentions(A.items(s, d))


@query("SELECT topic_id, count(DISTINCT platform) AS n_platforms, string_agg(DISTINCT platform, ', ' ORDER BY platform) AS platforms, count(*) AS nodes FROM core GROUP BY topic_id")
def platform_distinct(s, d):
    names = F.array_sort(F.collect_set("platform"))
    return A.items(s, d).groupBy("topic_id").agg(F.size(names).cast("bigint").alias("n_platforms"), F.array_join(names, ", ").alias("platforms"), F.count("*").alias("nodes"))


@query("SELECT topic_id, title, CAST(floor(hours / 24) AS BIGINT) || '天' || CAST(floor(hours - 24 * floor(hours / 24)) AS BIGINT) || '小时' AS length_display FROM topics")
def topic_detail_display(s, d):
    return T.with_hours(A.topics(s, d)).select("topic_id", "title", text.days_hours(F.col("hours")).alias("length_display"))


@query("SELECT topic_id, CAST(floor(hours) AS BIGINT) AS whole_hours, round(heat, 4) AS norm, CASE WHEN r < 2 THEN '低于2小时' WHEN r < 24 THEN r || '小时' WHEN r % 24 = 0 THEN r // 24 || '天' ELSE r // 24 || '天' || r % 24 || '小时' END AS display FROM (SELECT *, CAST(floor(hours + 0.5) AS BIGINT) AS r FROM topics) ORDER BY whole_hours DESC, norm DESC, topic_id LIMIT 50")
def ui_rank(s, d):
    t = T.with_hours(A.topics(s, d)).select("topic_id", F.floor("hours").alias("whole_hours"), F.round("heat", 4).alias("norm"), text.ui_length(F.col("hours")).alias("display"))
    return t.orderBy(F.desc("whole_hours"), F.desc("norm"), "topic_id").limit(50)


# ---------------------------------------------------------------- view


def _view(s, d):
    return T.item_view(A.topics(s, d), A.summaries(s, d), A.items_titled(s, d))


_VIEW = """, ls AS (SELECT topic_id, arg_max(content, (generated_at, id)) AS summary FROM summaries GROUP BY topic_id),
v AS (SELECT t.topic_id, t.title, ls.summary, t.first_seen, t.last_active, t.status, t.category, t.intensity_total, t.heat AS heat_normalized, t.hours AS echo_length_hours, i.id AS item_id, i.title AS item_title, i.summary AS item_summary, i.url AS item_url, i.platform AS item_platform, i.published_at AS item_published_at, i.fetched_at AS item_fetched_at
  FROM topics t LEFT JOIN ls USING (topic_id) LEFT JOIN items i ON i.topic_id = t.topic_id),
lat AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY item_published_at DESC NULLS LAST, item_fetched_at DESC NULLS LAST, item_id DESC) AS rn FROM v {})
"""


@query(_VIEW.format("") + "SELECT topic_id, title, summary, round(echo_length_hours, 6) AS hours, item_id, item_title, item_platform FROM v")
def topic_item_view(s, d):
    return _view(s, d).select("topic_id", "title", "summary", F.round("echo_length_hours", 6).alias("hours"), "item_id", "item_title", "item_platform")


@query(_VIEW.format("") + "SELECT topic_id, item_id, item_platform FROM lat WHERE rn = 1")
def topic_latest_item(s, d):
    return T.latest(_view(s, d), "topic_id", T.LATEST_ITEM()).select("topic_id", "item_id", "item_platform")


_TQ = "SELECT topic_id, title, " + TS.format("last_active") + " AS last_active, item_title, item_summary, item_url, item_platform, " + TS.format("item_published_at") + " AS item_published_at FROM lat WHERE rn = 1 ORDER BY {} DESC NULLS LAST, topic_id LIMIT 20"


def _tq(v, **k):
    return T.topic_query(v, **k).withColumns({"last_active": timex.ts_text(F.col("last_active")), "item_published_at": timex.ts_text(F.col("item_published_at"))})


query(_VIEW.format("") + _TQ.format("last_active"), "topic_query_default")(lambda s, d: _tq(_view(s, d)))
query(_VIEW.format("WHERE item_platform IN ('weibo', 'hupu')") + _TQ.format("lat.heat_normalized"), "topic_query_platform")(lambda s, d: _tq(_view(s, d), platforms=["weibo", "hupu"], order="heat_desc"))
query(_VIEW.format("WHERE last_active >= TIMESTAMP '2024-01-28 00:00:00'") + _TQ.format("lat.first_seen"), "topic_query_recent")(lambda s, d: _tq(_view(s, d), start=F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"), order="first_seen_desc"))
query(_VIEW.format("WHERE category = 'sports_esports' AND status = 'active' AND contains(lower(title), 'the')") + _TQ.format("echo_length_hours"), "topic_query_category")(lambda s, d: _tq(_view(s, d), category="sports_esports", status="active", title_contains="THE", order="echo_length_desc"))


@query("SELECT topic_id, title FROM topics WHERE topic_id IN (SELECT topic_id FROM core WHERE platform IN ('sina'))")
def platform_semi_join(s, d):
    return T.on_platforms(A.topics(s, d), A.items(s, d), ["sina"]).select("topic_id", "title")


@query(f"SELECT topic_id, title, {TS.format('last_active')} AS last_active FROM topics WHERE status = 'active' ORDER BY topics.last_active DESC, topic_id LIMIT 10")
def recent_topics(s, d):
    return T.filtered(A.topics(s, d), "active").orderBy(F.desc("last_active"), "topic_id").limit(10).select("topic_id", "title", ts("last_active"))


@query("SELECT topic_id, id, rn FROM (SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at DESC, id DESC) AS rn FROM core) WHERE rn <= 5")
def latest_nodes_per_topic(s, d):
    return T.latest(A.items(s, d), "topic_id", [F.desc("fetched_at"), F.desc("id")], 5).select("topic_id", "id", F.col("rn").cast("bigint").alias("rn"))


@query(f"SELECT topic_id, arg_max(id, (generated_at, id)) AS summary_id, {TS.format('max(generated_at)')} AS generated_at FROM summaries GROUP BY topic_id")
def latest_summary_per_topic(s, d):
    return T.newest_summary(A.summaries(s, d)).select("topic_id", "summary_id", ts("generated_at"))


@query("SELECT id FROM summaries WHERE id NOT IN (SELECT id FROM vectors WHERE object_type = 'topic_summary')")
def summaries_without_vector(s, d):
    return A.summaries(s, d).select("id").join(A.vectors(s, d).where("object_type = 'topic_summary'"), "id", "left_anti")


@query("SELECT topic_id FROM (SELECT *, nullif(CASE WHEN topic_id % 4 = 0 THEN '' ELSE category END, '') AS c FROM topics) WHERE c IS NULL AND status = 'active'")
def unclassified_topics(s, d):
    t = A.topics(s, d).withColumn("category", F.when(F.col("topic_id") % 4 == 0, "").otherwise(F.col("category")))
    return t.where((F.col("category").isNull() | (F.col("category") == "")) & (F.col("status") == "active")).select("topic_id")


@query(", gone AS (SELECT id, topic_id FROM items WHERE contains(url, 'weibo/7')) SELECT 'item' AS kind, id FROM gone UNION ALL SELECT 'topic', topic_id FROM (SELECT DISTINCT topic_id FROM gone)")
def cleanup_victims(s, d):
    i, t = storage.cleanup_victims(A.items_titled(s, d), A.topics(s, d), K.NOISE_TITLES, ["weibo/7"])
    return i.select(F.lit("item").alias("kind"), "id").unionByName(t.select(F.lit("topic").alias("kind"), F.col("topic_id").alias("id")))


@query("SELECT topic_id, count(*) AS node_count FROM core GROUP BY topic_id")
def topic_node_count(s, d):
    return A.items(s, d).groupBy("topic_id").agg(F.count("*").alias("node_count"))


@query("SELECT topic_id, list_extract(list(url ORDER BY fetched_at DESC, id DESC), 1) AS newest_url, list_extract(list(url ORDER BY fetched_at DESC, id DESC), 2) AS next_url FROM items GROUP BY topic_id")
def topic_urls(s, d):
    t = T.latest(A.items(s, d), "topic_id", [F.desc("fetched_at"), F.desc("id")], 2)
    return t.groupBy("topic_id").agg(F.max(F.when(F.col("rn") == 1, F.col("url"))).alias("newest_url"), F.max(F.when(F.col("rn") == 2, F.col("url"))).alias("next_url"))


# ---------------------------------------------------------------- metrics

_CM = """, m AS (SELECT category, count(*) AS n, count(*) FILTER (status = 'active') AS a, count(*) FILTER (status = 'ended') AS e, avg(hours) AS ah, max(hours) AS mh, min(hours) AS ih,
  list(topic_id ORDER BY hours DESC, topic_id)[1] AS xt, list(topic_id ORDER BY hours, topic_id)[1] AS it, sum(intensity_total) AS si, avg(intensity_total) AS ai, max(intensity_total) AS xi, sum(heat) AS sh, avg(heat) AS avh FROM topics {} GROUP BY category),
c(category) AS (VALUES ('entertainment'), ('current_affairs'), ('sports_esports')),
cm AS (SELECT category, CAST(coalesce(n, 0) AS BIGINT) AS topics_count, CAST(coalesce(a, 0) AS BIGINT) AS topics_active, CAST(coalesce(e, 0) AS BIGINT) AS topics_ended, round(coalesce(ah, 0), 2) AS avg_hours, round(coalesce(mh, 0), 2) AS max_hours, round(coalesce(ih, 0), 2) AS min_hours, xt AS max_topic_id, it AS min_topic_id,
  CAST(coalesce(si, 0) AS BIGINT) AS intensity_sum, round(coalesce(ai, 0), 2) AS intensity_avg, CAST(coalesce(xi, 0) AS BIGINT) AS intensity_max, round(coalesce(sh, 0), 6) AS heat_sum, round(coalesce(avh, 0), 6) AS heat_avg FROM c LEFT JOIN m USING (category))
SELECT *, CAST(floor(avg_hours / 24) AS BIGINT) || '天' || CAST(floor(avg_hours - 24 * floor(avg_hours / 24)) AS BIGINT) || '小时' AS display FROM cm"""
query(_CM.format(""), "category_metrics")(lambda s, d: metrics.category_metrics(T.with_hours(A.topics(s, d))))
query(_CM.format("WHERE status = 'ended'"), "category_metrics_ended")(lambda s, d: metrics.category_metrics(T.with_hours(A.topics(s, d)), True))


@query("SELECT strftime(first_seen, '%Y-%m-%d') AS day, category, count(*) AS topics_count, round(avg(hours), 2) AS avg_hours, CAST(sum(intensity_total) AS BIGINT) AS intensity_sum, max(intensity_total) AS intensity_max, round(sum(heat), 6) AS heat_sum FROM topics GROUP BY 1, 2")
def category_day_metrics(s, d):
    t = T.with_hours(A.topics(s, d)).groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day"), "category")
    return t.agg(F.count("*").alias("topics_count"), F.round(F.avg("hours"), 2).alias("avg_hours"), F.sum("intensity_total").alias("intensity_sum"), F.max("intensity_total").alias("intensity_max"), F.round(F.sum("heat"), 6).alias("heat_sum"))


@query("SELECT strftime(first_seen, '%Y-%m-%d') AS day, CAST(coalesce(sum(intensity_total), 0) AS DOUBLE) AS value FROM topics WHERE category = 'entertainment' GROUP BY 1")
def category_timeseries(s, d):
    t = A.topics(s, d).where("category = 'entertainment'").groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day"))
    return t.agg(F.coalesce(F.sum("intensity_total").cast("double"), F.lit(0.0)).alias("value"))


@query("SELECT strftime(first_seen, '%Y-%m-%d') AS day, count(*) AS n FROM topics GROUP BY 1")
def topics_new_per_day(s, d):
    return metrics.per_day(A.topics(s, d), "first_seen").withColumn("day", F.col("day").cast("string"))


@query("SELECT strftime(last_active, '%Y-%m-%d') AS day, count(*) AS n FROM topics WHERE status = 'ended' GROUP BY 1")
def topics_ended_per_day(s, d):
    return metrics.per_day(A.topics(s, d).where("status = 'ended'"), "last_active").withColumn("day", F.col("day").cast("string"))


_SPINE = ", sp AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) SELECT strftime(day, '%Y-%m-%d') AS day, CAST((SELECT count(*) FROM topics WHERE {}) AS BIGINT) AS {} FROM sp"
query(_SPINE.format("CAST(first_seen AS DATE) <= sp.day", "total"), "topics_total_per_day")(lambda s, d: metrics.total_per_day(A.topics(s, d), "2024-01-01", "2024-01-30").withColumn("day", F.col("day").cast("string")))
query(_SPINE.format("status = 'active' AND CAST(last_active AS DATE) >= sp.day - 1", "active"), "topics_active_per_day")(lambda s, d: metrics.active_per_day(A.topics(s, d), "2024-01-01", "2024-01-30").withColumn("day", F.col("day").cast("string")))


@query(f"SELECT count(*) AS topics_total, count(*) FILTER (status = 'active') AS topics_active, count(*) FILTER (status = 'ended') AS topics_ended, {TS.format('max(last_active)')} AS last_active FROM topics")
def admin_summary(s, d):
    return A.topics(s, d).agg(F.count("*").alias("topics_total"), F.count_if(F.col("status") == "active").alias("topics_active"), F.count_if(F.col("status") == "ended").alias("topics_ended"), timex.ts_text(F.max("last_active")).alias("last_active"))


_RUNS = """, rn AS (SELECT run_hour, count(*) AS total_items, count(heat_value) AS success_items, count(*) - count(heat_value) AS failed_items, count(DISTINCT platform) AS platforms, CAST(epoch(date_trunc('second', max(fetched_at))) - epoch(date_trunc('second', min(fetched_at))) AS BIGINT) AS seconds FROM core GROUP BY run_hour),
runs AS (SELECT *, CASE WHEN failed_items = 0 THEN 'success' WHEN success_items = 0 THEN 'failed' ELSE 'partial' END AS status, round(success_items / total_items, 4) AS success_rate FROM rn)
"""


@query(_RUNS + f"SELECT {TS.format('run_hour')} AS run_hour, total_items, success_items, failed_items, platforms, status, success_rate FROM runs ORDER BY runs.run_hour DESC LIMIT 20")
def ingest_runs(s, d):
    r = metrics.runs(A.items(s, d)).orderBy(F.desc("run_hour")).limit(20)
    return r.select(ts("run_hour"), "total_items", "success_items", "failed_items", "platforms", "status", "success_rate")


@query(_RUNS + f"SELECT count(*) AS n, CAST(floor(sum(seconds) / count(*)) AS BIGINT) AS avg_latency, {TS.format('max(run_hour)')} AS last_run FROM (SELECT * FROM runs WHERE status <> 'failed' ORDER BY run_hour DESC LIMIT 10)")
def source_status(s, d):
    r = metrics.runs(A.items(s, d)).where("status <> 'failed'").orderBy(F.desc("run_hour")).limit(10)
    return r.agg(F.count("*").alias("n"), F.floor(F.sum("seconds") / F.count("*")).alias("avg_latency"), timex.ts_text(F.max("run_hour")).alias("last_run"))


@query(", g AS (SELECT period, topic_id, count(*) AS c FROM core GROUP BY period, topic_id) SELECT period, round(sum(CASE WHEN c >= 2 THEN c ELSE 0 END) / sum(c), 6) AS keep_rate, round(1 - sum(CASE WHEN c >= 2 THEN c ELSE 0 END) / sum(c), 6) AS drop_rate, round(avg(c), 6) AS avg_occurrence FROM g GROUP BY period")
def merge_rates(s, d):
    g = A.items(s, d).groupBy("period", "topic_id").agg(F.count("*").alias("c")).groupBy("period").agg(F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)).alias("k"), F.sum("c").alias("n"), F.avg("c").alias("a"))
    rate = metrics.ratio(F.col("k"), F.col("n"))
    return g.select("period", r6(rate, "keep_rate"), r6(1 - rate, "drop_rate"), r6("a", "avg_occurrence"))


@query("SELECT period, count(*) AS pending FROM core WHERE merge_status = 'pending_event_merge' GROUP BY period")
def pending_counts(s, d):
    return A.items(s, d).where("merge_status = 'pending_event_merge'").groupBy("period").agg(F.count("*").alias("pending"))


@query("SELECT * FROM (VALUES ('entertainment', '娱乐八卦类事件'), ('current_affairs', '社会实事类事件'), ('sports_esports', '体育电竞类事件')) AS c(category, display)")
def categories(s, d):
    return metrics.category_relation(s)


# ---------------------------------------------------------------- timeline

_TL = """, tl AS (SELECT *, trim(title) AS k1, trim(coalesce(nullif(summary, ''), title)) AS k2, coalesce(published_at, fetched_at) AS at_ FROM items),
agg AS (SELECT topic_id, arg_max(id, (at_, id)) AS item_id, count(*) AS reports, min(at_) AS first_at, max(at_) AS last_at, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms FROM tl GROUP BY topic_id, k1, k2)
"""


@query(_TL + f"SELECT topic_id, item_id, reports, {TS.format('first_at')} AS first_at, {TS.format('last_at')} AS last_at, platforms FROM agg")
def timeline_aggregate(s, d):
    return timeline.aggregate(A.items_titled(s, d)).select("topic_id", "item_id", "reports", ts("first_at"), ts("last_at"), "platforms")


@query(_TL + f"SELECT item_id, reports, {TS.format('last_at')} AS last_at FROM agg WHERE topic_id = 3 ORDER BY agg.last_at DESC, item_id DESC LIMIT 10 OFFSET 10")
def timeline_page(s, d):
    t = timeline.aggregate(A.items_titled(s, d).where("topic_id = 3"))
    return t.orderBy(F.desc("last_at"), F.desc("item_id")).offset(10).limit(10).select("item_id", "reports", ts("last_at"))


@query("SELECT id, nullif(CAST(json_extract_string(j, '$.hot_score') AS BIGINT), 0) AS engagement FROM (SELECT id, replace(interactions, '\"k\"', '\"hot_score\"') AS j FROM core)")
def engagement(s, d):
    return A.items(s, d).select("id", jsonx.engagement(F.replace("interactions", F.lit('"k"'), F.lit('"hot_score"'))).alias("engagement"))


@query("SELECT topic_id, CAST(sum(CAST(json_extract_string(interactions, '$.k') AS BIGINT)) AS BIGINT) AS total FROM core GROUP BY topic_id")
def interaction_totals(s, d):
    return A.items(s, d).groupBy("topic_id").agg(F.sum(jsonx.interaction_total(F.col("interactions"), ["k", "like"])).alias("total"))


# ---------------------------------------------------------------- text

_FULL, _HALF = text.FULL.replace("'", "''"), text.HALF.replace("'", "''")
def _norm_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(regexp_replace(translate({x}, '{_FULL}{text.DIGITS_CN}', '{_HALF}{text.DIGITS}'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


_N60 = _norm_sql("substr(text, 1, 60)")
_GRAMS = "CASE WHEN length({0}) >= 2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) ELSE [] END"


@query(f"SELECT doc_id, {_norm_sql('text')} AS norm FROM documents")
def normalize_title(s, d):
    return A.read(s, d, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("norm"))


@query(f", n AS (SELECT doc_id, {_N60} AS t FROM documents) SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(list_sort(g), '|') AS grams FROM (SELECT doc_id, {_GRAMS.format('t')} AS g FROM n)")
def title_ngrams(s, d):
    g = text.ngrams(text.normalize_title(F.substring("text", 1, 60)))
    return A.read(s, d, "documents").select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("bigint").alias("n_grams"), F.array_join(F.array_sort("g"), "|").alias("grams"))


@query(f", n AS (SELECT doc_id, source, {_N60} AS t FROM documents), g AS (SELECT doc_id, source, {_GRAMS.format('t')} AS g FROM n), p AS (SELECT a.source AS g, a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.g, b.g)) AS c, len(a.g) AS na, len(b.g) AS nb FROM g a JOIN g b ON a.source = b.source AND a.doc_id < b.doc_id) SELECT g, a, b, round(c / (na + nb - c), 9) AS jaccard FROM p WHERE na > 0 AND nb > 0 AND c / (na + nb - c) >= 0.4")
def title_jaccard_pairs(s, d):
    rows = A.read(s, d, "documents").select("source", "doc_id", text.ngrams(text.normalize_title(F.substring("text", 1, 60))).alias("grams"))
    return cluster.jaccard_pairs(rows, "source", "doc_id", "grams", 0.4).withColumn("jaccard", F.round("jaccard", 9))


@query("SELECT id, md5(url) AS url_hash, md5(title || summary) AS content_hash, platform || ':' || md5(url) || ':' || strftime(run_hour, '%Y%m%d%H') AS dedup_key FROM items")
def content_hashes(s, d):
    h = F.md5("url")
    return A.items_titled(s, d).select("id", h.alias("url_hash"), F.md5(F.concat("title", "summary")).alias("content_hash"), F.concat_ws(":", "platform", h, F.date_format("run_hour", "yyyyMMddHH")).alias("dedup_key"))


@query(", x AS (SELECT id, CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '点击查看 更多实时热点' WHEN 2 THEN '点击查看更多热榜' WHEN 3 THEN '热点新闻' ELSE title END AS t, CASE WHEN id % 5 = 0 THEN url || '/top_news_list.html' ELSE url END AS u FROM items) SELECT id, regexp_replace(t, '\\s+', '', 'g') IN ('', '点击查看更多实时热点', '点击查看更多热榜') OR contains(u, 'top_news_list') AS noise FROM x")
def noise_filter(s, d):
    m = F.col("id") % 7
    t = F.when(m == 0, "").when(m == 1, "点击查看 更多实时热点").when(m == 2, "点击查看更多热榜").when(m == 3, "热点新闻").otherwise(F.col("title"))
    u = F.when(F.col("id") % 5 == 0, F.concat("url", F.lit("/top_news_list.html"))).otherwise(F.col("url"))
    return A.items_titled(s, d).select("id", text.is_noise(t, u).alias("noise"))


@query("SELECT item_id, array_to_string(k, ' ') AS keywords FROM (SELECT item_id, CASE WHEN len(w) > 0 THEN w[1:8] ELSE [trim(text)] END AS k FROM (SELECT item_id, text, list_transform(list_sort(list_transform(map_entries(map_from_entries(list_transform(list_distinct(a), lambda x: (x, list_position(a, x))))), lambda e: (e.value, e.key))), lambda p: p[2]) AS w FROM (SELECT item_id, text, regexp_extract_all(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g'), '[A-Za-z0-9]+') AS a FROM benchmark)))")
def query_keywords(s, d):
    return A.read(s, d, "benchmark").select("item_id", F.array_join(text.query_keywords(F.col("text")), " ").alias("keywords"))


@query(", q AS (SELECT id, CASE id % 4 WHEN 0 THEN '微博和知乎' WHEN 1 THEN '今日头条' WHEN 2 THEN '虎扑热榜 ' || title ELSE title END AS t FROM items) SELECT id, CASE id % 4 WHEN 0 THEN 'weibo,zhihu' WHEN 1 THEN 'toutiao' WHEN 2 THEN 'hupu' ELSE '' END AS platforms FROM q")
def platform_alias(s, d):
    m = F.col("id") % 4
    t = F.when(m == 0, "微博和知乎").when(m == 1, "今日头条").when(m == 2, F.concat(F.lit("虎扑热榜 "), "title")).otherwise(F.col("title"))
    return A.items_titled(s, d).select("id", F.array_join(text.platforms_in(t), ",").alias("platforms"))




def _score_sql(cat: str) -> str:
    strong, medium = K.KEYWORDS[cat]
    n = lambda ws: "(" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in ws) + ")::DOUBLE"
    return f"{n(strong)} * 0.15::DOUBLE + {n(medium)} * 0.05::DOUBLE + " + ("CASE WHEN platform = 'hupu' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END" if cat == "sports_esports" else "0.0::DOUBLE")


_MIX = "CASE id % 5 WHEN 0 THEN '演员夺得冠军 ' WHEN 1 THEN '政策发布通知 ' WHEN 2 THEN '普通文本 ' WHEN 3 THEN '篮球转会 ' ELSE '' END || title"


@query(f", x AS (SELECT id, platform, {_MIX} AS t FROM items), sc AS (SELECT id, {_score_sql('entertainment')} AS e, {_score_sql('current_affairs')} AS c, {_score_sql('sports_esports')} AS p FROM x) SELECT id, CASE WHEN greatest(e, c, p) = 0 THEN 'current_affairs' WHEN e = greatest(e, c, p) THEN 'entertainment' WHEN c = greatest(e, c, p) THEN 'current_affairs' ELSE 'sports_esports' END AS category, CASE WHEN greatest(e, c, p) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM sc")
def rule_classify(s, d):
    m = F.col("id") % 5
    t = F.concat(F.when(m == 0, "演员夺得冠军 ").when(m == 1, "政策发布通知 ").when(m == 2, "普通文本 ").when(m == 3, "篮球转会 ").otherwise(""), "title")
    cat, conf = text.rule_category(F.col("t"), F.col("platform") == "hupu")
    return A.items_titled(s, d).select("id", "platform", t.alias("t")).select("id", cat.alias("category"), conf.alias("confidence"))


@query("SELECT doc_id, length(text) // 2 AS tokens FROM documents")
def token_estimate(s, d):
    return A.read(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) // 2 <= 100 THEN text ELSE substr(text, 1, CAST(floor(length(text) * (100 / (length(text) // 2)::DOUBLE) * 0.9::DOUBLE) AS INTEGER)) || '...' END AS cut FROM documents")
def truncate_text(s, d):
    return A.read(s, d, "documents").select("doc_id", text.truncate_to_tokens(F.col("text"), 100).alias("cut"))


@query(", c AS (SELECT source, doc_id, text, length(text) // 2 AS tokens FROM documents), u AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM c) SELECT source, doc_id, CASE WHEN upto <= 5000 THEN text ELSE substr(text, 1, CAST(floor(length(text) * ((5000 - (upto - tokens))::DOUBLE / tokens) * 0.9::DOUBLE) AS INTEGER)) || '...' END AS packed FROM u WHERE 5000 - (upto - tokens) > 0")
def context_packing(s, d):
    return context.pack_context(A.read(s, d, "documents"), "source", "doc_id", "text", 5000).select("source", "doc_id", "packed")


@query("SELECT conv_id, CAST(sum(length(text) // 2 + 4) + 3 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def message_tokens(s, d):
    return context.message_tokens(A.read(s, d, "conversations"))


@query(
    ", l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, trim(coalesce(text, '')) AS said FROM conversations) "
    "SELECT conv_id, coalesce(string_agg(CASE WHEN lower(trim(role)) = 'assistant' THEN '助手' ELSE '用户' END || '：' || said, chr(10) ORDER BY turn) FILTER (WHERE said <> ''), '（无）') AS history "
    "FROM l WHERE rn <= 8 GROUP BY conv_id"
)
def history_format(s, d):
    return context.history_text(A.read(s, d, "conversations"))


@query("SELECT conv_id, arg_max(trim(text), turn) AS query FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def last_user_query(s, d):
    return context.last_user_query(A.read(s, d, "conversations"))


_BLANK = "' ' || chr(9) || chr(10) || chr(13)"


@query(f""", th AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN '<think>a' || chr(10) || 'b</think> ' || text WHEN 1 THEN text || ' <think>' || text WHEN 2 THEN '<think>' || text WHEN 3 THEN text
  WHEN 4 THEN text || '<THINK>x</Think>' || chr(10) || text || chr(10) ELSE '<think>a</think>' || text || '<think>b</think>' || text END AS t FROM benchmark),
ex AS (SELECT item_id, t, regexp_extract(t, '(?is)</think>\\s*(.+)', 1) AS a, regexp_extract(t, '(?is)^(.+?)<think>', 1) AS b FROM th)
SELECT item_id, trim(regexp_replace(t, '<think>.*?</think>', '', 'gs')) AS stripped, CASE WHEN a <> '' THEN trim(a, {_BLANK}) WHEN b <> '' THEN trim(b, {_BLANK}) ELSE t END AS after FROM ex""")
def strip_think(s, d):
    m, x, lit = F.col("item_id") % 6, F.col("text"), F.lit
    t = F.when(m == 0, F.concat(lit("<think>a\nb</think> "), x)).when(m == 1, F.concat(x, lit(" <think>"), x)).when(m == 2, F.concat(lit("<think>"), x)).when(m == 3, x)
    t = t.when(m == 4, F.concat(x, lit("<THINK>x</Think>\n"), x, lit("\n"))).otherwise(F.concat(lit("<think>a</think>"), x, lit("<think>b</think>"), x))
    return A.read(s, d, "benchmark").select("item_id", text.strip_think(t).alias("stripped"), text.after_think(t).alias("after"))


@query(", q AS (SELECT id, id % 6 AS m FROM core) SELECT id, m IN (0) AS all_time, CASE m WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 180 END AS recent_days, m IN (0, 1, 2) AS refine_only FROM q")
def followup_flags(s, d):
    m = F.col("id") % 6
    q = F.when(m == 0, "不要最近").when(m == 1, "只看近7天").when(m == 2, "改为最近30天").when(m == 3, "近180天").when(m == 4, "演员离婚").otherwise("AI model news")
    f = text.followup(q)
    return A.items(s, d).select("id", f["all_time"].alias("all_time"), f["recent_days"].alias("recent_days"), f["refine_only"].alias("refine_only"))


@query(", h AS (SELECT id, CAST(id % 900 AS VARCHAR) AS n, id % 900 AS v, id % 5 AS m FROM core) SELECT id, CASE m WHEN 0 THEN v * 10000.0::DOUBLE WHEN 1 THEN v * 100000000.0::DOUBLE WHEN 2 THEN v * 10000.0::DOUBLE WHEN 3 THEN v::DOUBLE ELSE 0.0::DOUBLE END AS units, CASE m WHEN 0 THEN v * 10000.0::DOUBLE WHEN 3 THEN v::DOUBLE END AS hot, CASE WHEN m < 4 THEN v::DOUBLE END AS digits FROM h")
def hot_value_parse(s, d):
    m, n = F.col("id") % 5, (F.col("id") % 900).cast("string")
    t = F.when(m == 0, F.concat(n, F.lit("万热度"))).when(m == 1, F.concat(n, F.lit("亿"))).when(m == 2, F.concat(n, F.lit("w"))).when(m == 3, n).otherwise("abc")
    return A.items(s, d).select("id", text.unit_number(t).alias("units"), text.hot_text_number(t).alias("hot"), text.digits_number(t).alias("digits"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS BIGINT) AS n_chars FROM pages")
def html_title_text(s, d):
    return A.read(s, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.length(text.html_text(F.col("html"))).cast("bigint").alias("n_chars"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN interactions WHEN 1 THEN interactions END AS json, CASE WHEN id % 3 < 2 THEN CAST(json_extract_string(interactions, '$.k') AS BIGINT) END AS k FROM core")
def json_extract_lenient(s, d):
    m = F.col("id") % 3
    t = F.when(m == 0, F.col("interactions")).when(m == 1, F.concat(F.lit("so: "), "interactions", F.lit(" ok"))).otherwise("none {here")
    j = jsonx.lenient_json(t)
    return A.items(s, d).select("id", j.alias("json"), F.get_json_object(j, "$.k").cast("bigint").alias("k"))


@query(", x AS (SELECT id, id % 7 AS m FROM core) SELECT id, CASE m WHEN 0 THEN '2024-01-25' WHEN 1 THEN '2024-01-29' WHEN 2 THEN '2024-01-22' WHEN 3 THEN '2024-01-30' WHEN 4 THEN '2024-01-02' WHEN 5 THEN '2024-01-29' END AS d0, CASE m WHEN 0 THEN '2024-01-31' WHEN 1 THEN '2024-01-31' WHEN 2 THEN '2024-01-28' WHEN 3 THEN '2024-01-30' WHEN 4 THEN '2024-01-05' WHEN 5 THEN '2024-01-29' END AS d1 FROM x")
def date_range_parse(s, d):
    m = F.col("id") % 7
    q = F.when(m == 0, "近7天").when(m == 1, "本周").when(m == 2, "上周").when(m == 3, "昨天").when(m == 4, "2024年1月5日到2024-01-02").when(m == 5, "前天").otherwise("随便")
    a, b = timex.date_range(q, F.lit("2024-01-31").cast("date"))
    return A.items(s, d).select("id", a.cast("string").alias("d0"), b.cast("string").alias("d1"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 55 WHEN 1 THEN 3 WHEN 2 THEN 101 END::BIGINT AS target FROM core")
def resolve_target(s, d):
    m = F.col("id") % 4
    raw = F.when(m == 0, "55").when(m == 1, "3").when(m == 2, "候选主题 1").otherwise("x")
    return A.items(s, d).select("id", jsonx.resolve_target(raw, F.array(*[F.lit(x).cast("bigint") for x in (101, 55, 3)])).alias("target"))


@query("SELECT DISTINCT platform, CASE platform WHEN 'weibo' THEN '微博' WHEN 'zhihu' THEN '知乎' WHEN 'toutiao' THEN '今日头条' WHEN 'sina' THEN '新浪新闻' ELSE '虎扑' END AS label FROM core")
def platform_labels(s, d):
    m = F.create_map(*[F.lit(x) for kv in K.PLATFORM_LABELS.items() for x in kv])
    return A.items(s, d).select("platform").distinct().select("platform", F.coalesce(m[F.col("platform")], F.col("platform")).alias("label"))


# ---------------------------------------------------------------- vectors


@query("SELECT a.grp, a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS cosine FROM vectors a JOIN vectors b ON a.grp = b.grp AND a.id < b.id AND list_cosine_similarity(a.x, b.x) >= 0.25")
def cosine_pairs(s, d):
    return search.cosine_pairs(A.vectors(s, d), "grp", 0.25).withColumn("cosine", F.round("cosine", 6))


for _m, _dist, _ord, _sim in (
    ("cosine", f"1 - list_cosine_similarity(x, {Q0_SQL})", "ASC", "1 - dist"),
    ("ip", f"list_inner_product(x, {Q0_SQL})", "DESC", "dist"),
    ("l2", f"pow(list_distance(x, {Q0_SQL}), 2)", "ASC", "1 / (1 + dist)"),
):
    query(f"SELECT id, round(dist, 6) AS distance, round({_sim}, 6) AS similarity FROM (SELECT id, {_dist} AS dist FROM vectors WHERE object_type = 'topic_summary') ORDER BY dist {_ord}, id LIMIT 10", f"vector_topk_{_m}")(
        lambda s, d, m=_m: search.top_k(A.vectors(s, d), Q0, 10, "topic_summary", m).select("id", r6("distance"), r6("similarity"))
    )


@query(f", h AS (SELECT topic_id, list_cosine_similarity(x, {Q0_SQL}) AS c, id FROM vectors WHERE object_type = 'topic_summary' ORDER BY 1 - c, id LIMIT 30) SELECT topic_id, round(max(c), 6) AS similarity FROM h WHERE c >= 0.1 GROUP BY topic_id ORDER BY max(c) DESC, topic_id LIMIT 3")
def topic_vector_strict(s, d):
    return search.topics_strict(A.vectors(s, d), Q0, 3, 0.1).withColumn("similarity", F.round("similarity", 6))


@query(f", h AS (SELECT topic_id, 1 - list_cosine_similarity(x, {Q0_SQL}) AS c, id FROM vectors WHERE object_type = 'topic_summary' ORDER BY c, id LIMIT 10) SELECT topic_id, round(min(c), 6) AS distance FROM h GROUP BY topic_id ORDER BY min(c), topic_id LIMIT 5")
def topic_vector_lenient(s, d):
    return search.topics_lenient(A.vectors(s, d), Q0, 5).withColumn("distance", F.round("distance", 6))


@query(f"SELECT id, round(c, 6) AS cosine FROM (SELECT id, list_cosine_similarity(x, {Q0_SQL}) AS c FROM vectors WHERE object_type = 'source_item' AND topic_id = 5) ORDER BY c DESC, id LIMIT 5")
def node_vector_search(s, d):
    return search.top_k(A.vectors(s, d).where("topic_id = 5"), Q0, 5, "source_item").select("id", F.round(1 - F.col("distance"), 6).alias("cosine"))


_CAND = """, near AS (SELECT q.id AS id, s.topic_id, s.id AS sid, list_cosine_similarity(q.x, s.x) AS c FROM vectors q, vectors s WHERE q.object_type = 'source_item' AND s.object_type = 'topic_summary'),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, sid) AS rn FROM near), b AS (SELECT id, topic_id, min(rn) AS rn, max(c) AS c FROM k WHERE rn <= 6 AND c >= 0.25 GROUP BY id, topic_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS rank FROM b)
"""


def _candidates(s, d):
    v = A.vectors(s, d)
    return search.candidates(v.where("object_type = 'source_item'"), v.where("object_type = 'topic_summary'"), 6, 0.25, 3)


@query(_CAND + "SELECT id, topic_id, round(c, 6) AS similarity, rank FROM cand WHERE rank <= 3")
def candidate_topics(s, d):
    return _candidates(s, d).select("id", "topic_id", r6("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(_CAND + ", recent AS (SELECT topic_id FROM topics WHERE status = 'active' ORDER BY last_active DESC, topic_id LIMIT 3) SELECT v.id, r.topic_id, NULL::DOUBLE AS similarity FROM vectors v, recent r WHERE v.object_type = 'source_item' AND v.id NOT IN (SELECT id FROM cand)")
def candidate_fallback(s, d):
    return search.fallback(A.vectors(s, d).where("object_type = 'source_item'"), _candidates(s, d), A.topics(s, d))


@query(_CAND + "SELECT v.id, CASE WHEN c >= 0.3 THEN 'merge' ELSE 'new' END AS decision, CASE WHEN c >= 0.3 THEN cand.topic_id END AS target FROM vectors v LEFT JOIN cand ON cand.id = v.id AND cand.rank = 1 WHERE v.object_type = 'source_item'")
def merge_decision(s, d):
    v = A.vectors(s, d).where("object_type = 'source_item'").select("id").join(_candidates(s, d).where("rank = 1"), "id", "left")
    ok = F.coalesce(F.col("similarity") >= 0.3, F.lit(False))
    return v.select("id", F.when(ok, "merge").otherwise("new").alias("decision"), F.when(ok, F.col("topic_id")).alias("target"))


@query(""", e AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.grp = b.grp AND a.id < b.id AND list_cosine_similarity(a.x, b.x) >= 0.25),
ord AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM vectors),
walk(n, led, taken) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT o.n, CASE WHEN list_contains(w.taken, o.id) THEN w.led ELSE list_append(w.led, o.id) END, CASE WHEN list_contains(w.taken, o.id) THEN w.taken ELSE list_concat(w.taken, coalesce((SELECT list(e.b) FROM e WHERE e.a = o.id), [])) END FROM walk w JOIN ord o ON o.n = w.n + 1),
fin AS (SELECT led FROM walk ORDER BY n DESC LIMIT 1)
SELECT v.id AS k, CASE WHEN list_contains(fin.led, v.id) THEN v.id ELSE (SELECT min(e.a) FROM e WHERE e.b = v.id AND list_contains(fin.led, e.a)) END AS leader FROM vectors v, fin""")
def leader_clusters(s, d):
    v = A.vectors(s, d)
    return knn.leaders(v, 0.25, by="grp").withColumnRenamed("id", "k")


@query("SELECT object_type, count(*) AS n, min(len(x))::BIGINT AS dim FROM vectors GROUP BY object_type")
def vector_stats(s, d):
    return A.vectors(s, d).groupBy("object_type").agg(F.count("*").alias("n"), F.min(F.size("x")).cast("bigint").alias("dim"))


# ---------------------------------------------------------------- merging

_GROUP = ", g AS (SELECT *, period || '/' || topic_id AS grp FROM heat), z AS (SELECT grp, count(*) AS c FROM g GROUP BY grp) "


def _grouped(s, d):
    return A.with_heat(s, d).withColumn("grp", F.concat_ws("/", "period", F.col("topic_id").cast("string")))


@query(_GROUP + "SELECT g.id, z.c AS occurrence, CASE WHEN z.c >= 2 THEN 'pending_global_merge' ELSE 'discarded' END AS merge_status FROM g JOIN z USING (grp)")
def occurrence_filter(s, d):
    return cluster.occurrence(_grouped(s, d), "grp").select("id", "occurrence", "merge_status")


@query(_GROUP + "SELECT grp, round(coalesce(avg(heat_normalized), 0), 9) AS heat_avg, round(coalesce(max(heat_value), 0), 4) AS raw_max FROM g GROUP BY grp")
def group_heat(s, d):
    return _grouped(s, d).groupBy("grp").agg(F.round(F.coalesce(F.avg("heat_normalized"), F.lit(0.0)), 9).alias("heat_avg"), F.round(F.coalesce(F.max("heat_value"), F.lit(0.0)), 4).alias("raw_max"))


@query(_GROUP + f"SELECT grp, min(id) AS representative, count(*) AS n, {TS.format('min(fetched_at)')} AS first_seen, {TS.format('max(fetched_at)')} AS last_active FROM g GROUP BY grp ORDER BY representative LIMIT 200")
def group_headers(s, d):
    h = _grouped(s, d).groupBy("grp").agg(F.min("id").alias("representative"), F.count("*").alias("n"), timex.ts_text(F.min("fetched_at")).alias("first_seen"), timex.ts_text(F.max("fetched_at")).alias("last_active"))
    return h.orderBy("representative").limit(K.MAX_GROUPS)


@query("SELECT topic_id, CASE WHEN r <= greatest(1, floor(n * 0.3)) THEN 'active' ELSE 'ended' END AS status, CASE WHEN r <= greatest(1, floor(n * 0.3)) THEN heat ELSE 0.0 END AS heat FROM (SELECT *, row_number() OVER (ORDER BY heat DESC, topic_id) AS r, count(*) OVER () AS n FROM topics)")
def new_topic_downselect(s, d):
    return T.downselect(A.topics(s, d), 0.3).select("topic_id", "status", "heat")


@query(""", n AS (SELECT topic_id, id, fetched_at, CAST(json_extract_string(interactions, '$.k') AS BIGINT) AS k FROM core), w AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at, id) AS a, row_number() OVER (PARTITION BY topic_id ORDER BY k DESC, id) AS b, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at DESC, id DESC) AS c FROM n)
SELECT topic_id, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at, id) AS pos FROM w WHERE a = 1 OR b <= 2 OR c <= 5) WHERE pos <= 15""")
def key_nodes(s, d):
    n = A.items(s, d).select("topic_id", "id", F.col("fetched_at").alias("appended_at"), jsonx.interaction_total(F.col("interactions"), ["k"]).alias("interaction_total"), F.lit(True).alias("has_interactions"))
    return T.key_nodes(n).select("topic_id", "id", F.col("pos").cast("bigint").alias("pos"))


@query(", l AS (SELECT topic_id, max(generated_at) AS g FROM summaries GROUP BY topic_id) SELECT t.topic_id, count(c.id) AS new_nodes, count(c.id) >= 3 AND epoch(TIMESTAMP '2024-01-31 00:00:00' - any_value(l.g)) / 3600.0 >= 6 AS refresh FROM topics t JOIN l USING (topic_id) LEFT JOIN core c ON c.topic_id = t.topic_id AND c.fetched_at > l.g GROUP BY t.topic_id")
def summary_gate(s, d):
    newest = T.newest_summary(A.summaries(s, d)).select("topic_id", "generated_at")
    n = A.topics(s, d).select("topic_id").join(newest, "topic_id").join(A.items(s, d).select(F.col("topic_id").alias("t"), "id", "fetched_at"), (F.col("t") == F.col("topic_id")) & (F.col("fetched_at") > F.col("generated_at")), "left")
    g = n.groupBy("topic_id").agg(F.count("id").alias("new_nodes"), F.first("generated_at").alias("g"))
    return g.select("topic_id", "new_nodes", ((F.col("new_nodes") >= K.SUMMARY_NODES) & (timex.hours_between(F.col("g"), A.as_of()) >= K.SUMMARY_HOURS)).alias("refresh"))


for _all, _op in ((True, "AND"), (False, "OR")):
    query(f"SELECT topic_id, title FROM topics WHERE (contains(lower(title), 'the') {_op} contains(lower(title), 'er')) AND last_active >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY last_active DESC, topic_id LIMIT 10", f"keyword_search_{_op.lower()}")(
        lambda s, d, a=_all: T.keyword_search(A.topics(s, d), ["The", "er"], a, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("topic_id", "title")
    )


@query("SELECT topic_id, CAST(contains(title, 'the') AS BIGINT) + CAST(contains(title, 'tion') AS BIGINT) + CAST(contains(title, 'Er') AS BIGINT) AS score FROM topics")
def keyword_rerank(s, d):
    return T.keyword_rerank(A.topics(s, d), ["the", "tion", "Er"]).select("topic_id", "score")


@query(f""", kw AS (SELECT topic_id FROM topics WHERE contains(lower(title), 'the') ORDER BY last_active DESC, topic_id LIMIT 10),
h AS (SELECT topic_id, list_cosine_similarity(x, {Q0_SQL}) AS c, id FROM vectors WHERE object_type = 'topic_summary' ORDER BY 1 - c, id LIMIT 50), ve AS (SELECT topic_id FROM h WHERE c >= 0.1 GROUP BY topic_id ORDER BY max(c) DESC, topic_id LIMIT 5),
hit AS (SELECT topic_id, min(o) AS origin FROM (SELECT topic_id, 1 AS o FROM kw UNION ALL SELECT topic_id, 2 FROM ve) GROUP BY topic_id)
SELECT t.topic_id, t.title, hit.origin FROM hit JOIN topics t USING (topic_id) WHERE t.last_active >= TIMESTAMP '2024-01-10 00:00:00' AND t.first_seen <= TIMESTAMP '2024-01-31 00:00:00' AND t.topic_id IN (SELECT topic_id FROM core WHERE platform IN ('weibo', 'sina')) ORDER BY hours DESC, t.topic_id LIMIT 10""")
def topic_search(s, d):
    t, at = A.topics(s, d), lambda x: F.lit(x).cast("timestamp_ntz")
    kw = T.keyword_search(t, ["the"]).select("topic_id", F.lit(1).alias("o"))
    ve = search.topics_strict(A.vectors(s, d), Q0, 5, 0.1).select("topic_id", F.lit(2).alias("o"))
    hit = kw.unionByName(ve).groupBy("topic_id").agg(F.min("o").alias("origin"))
    f = T.with_hours(T.on_platforms(t.where((F.col("last_active") >= at("2024-01-10 00:00:00")) & (F.col("first_seen") <= at("2024-01-31 00:00:00"))), A.items(s, d), ["weibo", "sina"]))
    return f.join(F.broadcast(hit), "topic_id").orderBy(F.desc("hours"), "topic_id").limit(10).select("topic_id", "title", "origin")


@query("SELECT user_id AS id, CASE WHEN user_id % 7 = 0 THEN 'inactive' WHEN (user_id % 3 = 0 AND user_id % 2 = 0) OR (user_id % 3 <> 0 AND user_id % 4 = 1) THEN 'expired' WHEN user_id % 5 = 0 THEN 'used_up' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT user_id FROM events)")
def invite_check(s, d):
    u = F.col("topic_id")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    inv = A.items(s, d).select("topic_id").distinct().select(
        u.alias("id"), F.concat(F.lit("c"), u.cast("string")).alias("code"), F.when(u % 7 == 0, "disabled").otherwise("active").alias("status"), F.lit(5).alias("max_uses"), F.when(u % 5 == 0, 5).otherwise(1).alias("used_count"),
        F.when(u % 3 == 0, F.when(u % 2 == 0, at("2024-01-01 00:00:00")).otherwise(at("2024-03-01 00:00:00"))).alias("expires_at"), F.when(u % 4 == 1, at("2024-01-01 00:00:00")).otherwise(at("2024-01-30 00:00:00")).alias("created_at"),
    )
    return access.check_invites(inv, A.as_of()).select("id", "verdict")


# ---------------------------------------------------------------- more


@query(", w AS (SELECT topic_id, id, count(*) OVER (PARTITION BY topic_id) AS n, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at DESC, id DESC) AS r FROM core WHERE fetched_at >= TIMESTAMP '2024-01-25 00:00:00') SELECT topic_id, id, n AS new_nodes FROM w WHERE r <= 5")
def new_nodes_compress(s, d):
    new = A.items(s, d).where(F.col("fetched_at") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    n = new.groupBy("topic_id").agg(F.count("*").alias("new_nodes"))
    return T.latest(new, "topic_id", [F.desc("fetched_at"), F.desc("id")], 5).join(n, "topic_id").select("topic_id", "id", "new_nodes")


@query("SELECT strftime(first_seen, '%Y-%m-%d') AS day, category, count(*) AS topics_count FROM topics WHERE CAST(first_seen AS DATE) = (SELECT max(CAST(first_seen AS DATE)) FROM topics) GROUP BY 1, 2")
def latest_category_metrics(s, d):
    m = A.topics(s, d).groupBy(F.to_date("first_seen").alias("day"), "category").agg(F.count("*").alias("topics_count"))
    last = m.agg(F.max("day").alias("day"))
    return m.join(F.broadcast(last), "day").withColumn("day", F.col("day").cast("string"))


@query("SELECT conv_id, greatest(0, 32000 - 2000 - sum(length(text) // 2 + 4) - 3 - 2000)::BIGINT AS available FROM conversations GROUP BY conv_id")
def token_budget(s, d):
    t = context.message_tokens(A.read(s, d, "conversations"))
    return t.select("conv_id", context.available_tokens(F.col("tokens"), F.lit(0), F.lit(2000)).cast("bigint").alias("available"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN '转发' || (id % 7 + 1) || ', 点赞' || (id % 100 + 1) WHEN 1 THEN '评论12' ELSE '' END AS shown FROM core")
def interaction_display(s, d):
    m = F.col("id") % 3
    counts = F.format_string('{"repost": %d, "comment": 0, "like": %d}', F.col("id") % 7 + 1, F.col("id") % 100 + 1)
    j = F.when(m == 0, counts).when(m == 1, '{"comment": "12"}').otherwise("{}")
    return A.items(s, d).select("id", text.interaction_text(j).alias("shown"))


@query(
    ", m AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 4 WHEN 0 THEN [] WHEN 1 THEN ['topic_search'] WHEN 2 THEN ['topic_search', 'topic_query'] ELSE ['global_search'] END AS tools FROM conversations), "
    "f AS (SELECT *, chr(10) || chr(10) || '（本次使用工具：' || CASE WHEN len(tools) = 0 THEN '无' ELSE array_to_string(list_sort(tools), ', ') END || '）' AS footer FROM m) "
    "SELECT conv_id, max(footer) AS footer, coalesce(arg_max(CASE WHEN list_contains(tools, 'topic_query') THEN 'topic_query' ELSE 'topic_search' END, turn) "
    "FILTER (WHERE role = 'assistant' AND (list_contains(tools, 'topic_query') OR list_contains(tools, 'topic_search'))), '') AS last_tool FROM f GROUP BY conv_id"
)
def tool_footer(s, d):
    k = (F.col("conv_id") + F.col("turn")) % 4
    search, both = F.array(F.lit("topic_search"), F.lit("topic_search")), F.array(F.lit("topic_search"), F.lit("topic_query"))
    tools = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, search).when(k == 2, both).otherwise(F.array(F.lit("global_search")))
    said = A.read(s, d, "conversations").withColumn("footer", text.tools_used(tools))
    answers = said.withColumn("text", F.concat(F.coalesce("text", F.lit("")), "footer"))
    return said.groupBy("conv_id").agg(F.max("footer").alias("footer")).join(context.last_tool(answers), "conv_id")


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'A' || id WHEN 1 THEN 'V' || id END AS doc FROM core")
def document_ids(s, d):
    from ..sources import hotlist

    i = F.col("id").cast("string")
    u = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://n/article/A"), i, F.lit(".html"))).when(F.col("id") % 3 == 1, F.concat(F.lit("https://n/video/V"), i, F.lit(".html"))).otherwise("https://n/x")
    return A.items(s, d).select("id", hotlist.doc_id(u).alias("doc"))


@query(f""", ls AS (SELECT topic_id, arg_max(content, (generated_at, id)) AS content FROM summaries WHERE topic_id = 3 GROUP BY topic_id),
n AS (SELECT *, row_number() OVER (ORDER BY fetched_at DESC, id DESC) AS pos FROM items WHERE topic_id = 3)
SELECT 0::BIGINT AS pos, '【主题摘要】' || chr(10) || content AS chunk FROM ls
UNION ALL SELECT pos, pos || '. [' || platform || '] ' || strftime(fetched_at, '%Y-%m-%d %H:%M') || chr(10) || '   ' || coalesce(title, '') || chr(10) || '   ' || substr(coalesce(summary, ''), 1, 200) FROM n WHERE pos <= 5""")
def topic_context(s, d):
    from ..operators import agent

    return agent.topic_context(3, A.summaries(s, d), A.items_titled(s, d)).select(F.col("pos").cast("bigint").alias("pos"), "chunk")


@query("SELECT topic_id, '类别：entertainment：娱乐八卦类事件；current_affairs：社会实事类事件；sports_esports：体育电竞类事件' || chr(10) || '主题：' || coalesce(title, '') || chr(10) || '报道：' || chr(10) || coalesce(title, '') || chr(10) || '只回答 JSON：{\"category\": str, \"confidence\": 0-1, \"reason\": str}' AS prompt FROM topics")
def classify_prompt(s, d):
    from ..functions import prompts

    return A.topics(s, d).select("topic_id", prompts.classify(F.col("title"), F.array(F.coalesce("title", F.lit("")))).alias("prompt"))


@query("SELECT run_hour_text AS run_hour, platform, n FROM (SELECT strftime(run_hour, '%Y-%m-%d %H:%M:%S') AS run_hour_text, platform, count(*) AS n FROM core GROUP BY 1, 2)")
def runs_by_platform(s, d):
    return A.items(s, d).groupBy(timex.ts_text(F.col("run_hour")).alias("run_hour"), "platform").agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H:%M:%S') AS hour, platform, count(*) AS items, round(coalesce(sum(heat_value), 0), 4) AS heat FROM core GROUP BY 1, 2")
def hourly_counts(s, d):
    from ..streaming import pipeline

    w = pipeline.windowed_counts(A.items(s, d))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "platform", "items", F.round(F.coalesce("heat", F.lit(0.0)), 4).alias("heat"))


@query("SELECT id, period, CASE WHEN period < '2024-01-15' THEN 'late' ELSE 'open' END AS state FROM core WHERE merge_status = 'pending_event_merge'")
def late_items(s, d):
    from ..streaming import pipeline

    i = A.items(s, d).where("merge_status = 'pending_event_merge'")
    a, b = pipeline.late(i, "2024-01-15_MORN")
    return a.select("id", "period", F.lit("open").alias("state")).unionByName(b.select("id", "period", F.lit("late").alias("state")))

# The other queries register themselves.
from . import answers, similarity, workflow  # noqa: E402, F401
