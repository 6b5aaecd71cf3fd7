"""Queries of what surrounds the merge: classification, summaries, agent context, candidates, statistics in a window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, text, timex
from ..operators import access, agent, classify, heat, metrics, search, summaries, timeline
from ..operators import topics as T
from ..sources import adapters as A
from .catalogue import _CM, _MIX, _PH, Q0, Q0_SQL, TS, _norm_sql, _score_sql, query, r6, ts

at = lambda x: F.lit(x).cast("timestamp_ntz")

# ---------------------------------------------------------------- functions

_ANSWERS = """, tx AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS w FROM documents),
ans AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"needs_update": false, "updated_summary": "' || w || '"}' WHEN 1 THEN '{"updated_summary": "' || w || '"}' WHEN 2 THEN '<think>' || w || '</think> so {"needs_update": true, "updated_summary": "' || w || '"} done'
  WHEN 3 THEN '{"updated_summary": "' || w || '", "new' WHEN 4 THEN w ELSE '' END AS a FROM tx),
body AS (SELECT doc_id, CASE WHEN regexp_extract(a, '(?is)</think>\\s*(.+)', 1) <> '' THEN trim(regexp_extract(a, '(?is)</think>\\s*(.+)', 1), ' ' || chr(10)) ELSE a END AS b FROM ans),
obj AS (SELECT doc_id, b, CASE WHEN regexp_matches(b, '\\{.*\\}', 's') AND json_valid(regexp_extract(b, '\\{.*\\}', 0, 's')) THEN regexp_extract(b, '\\{.*\\}', 0, 's') END AS j FROM body)
"""


@query(_ANSWERS + """SELECT doc_id, CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.needs_update') <> 'false', true) ELSE regexp_matches(b, '"updated_summary"\\s*:\\s*"[^"]+"') END AS needs_update,
  CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.updated_summary'), '') ELSE regexp_extract(b, '"updated_summary"\\s*:\\s*"([^"]+)"', 1) END AS summary FROM obj""")
def incremental_parse(s, d):
    w, m = F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.col("doc_id") % 6
    j = lambda head, tail: F.concat(F.lit(head + '"updated_summary": "'), w, F.lit(tail))
    a = F.when(m == 0, j('{"needs_update": false, ', '"}')).when(m == 1, j("{", '"}')).when(m == 2, F.concat(F.lit("<think>"), w, j('</think> so {"needs_update": true, ', '"} done')))
    got = jsonx.incremental_struct(a.when(m == 3, j("{", '", "new')).when(m == 4, w).otherwise(""))
    return A.read(s, d, "documents").select("doc_id", got.alias("got")).select("doc_id", F.col("got.needs").alias("needs_update"), "got.summary")


@query("SELECT id, CASE id % 3 WHEN 0 THEN CAST(json_extract_string(interactions, '$.k') AS DOUBLE) WHEN 1 THEN 0.0::DOUBLE END AS number FROM core")
def interaction_number(s, d):
    m = F.col("id") % 3
    j = F.when(m == 0, F.replace("interactions", F.lit("{"), F.lit('{"a": "n/a", '))).when(m == 1, F.lit('{"a": "x", "b": null, "c": 3}')).otherwise('{"a": "x", "b": "inf"}')
    return A.items(s, d).select("id", jsonx.first_number(j).alias("number"))


@query("""SELECT a.conv_id, a.turn, CASE WHEN b.role IS NOT NULL AND b.turn % 2 = 1 THEN b.role ELSE a.role END AS intent, array_to_string(CASE WHEN b.turn % 3 = 1 THEN [b.role] ELSE [a.role, 'x'] END, ',') AS keywords, CASE WHEN b.turn % 2 = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS since
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def intent_merge(s, d):
    c = A.read(s, d, "conversations").select("conv_id", "turn", "role")
    words = F.array().cast("array<string>")
    none = F.lit("")
    base = c.withColumn("base", F.struct(F.col("role").alias("intent"), F.array("role", F.lit("x")).alias("keywords"), words.alias("platforms"), F.lit("2024-01-01").alias("since"), none.alias("until")))
    u = F.col("turn")
    over = F.struct(
        F.when(u % 2 == 1, F.col("role")).otherwise(none).alias("intent"), F.when(u % 3 == 1, F.array("role", F.lit(" "))).otherwise(words).alias("keywords"), words.alias("platforms"),
        F.when(u % 2 == 0, "2024-01-02").otherwise(none).alias("since"), none.alias("until"),
    )
    nxt = c.select("conv_id", (u - 1).alias("turn"), over.alias("over"))
    m = base.join(nxt, ["conv_id", "turn"], "left").withColumn("m", F.when(F.col("over").isNull(), F.col("base")).otherwise(jsonx.merged_intent(F.col("base"), F.col("over"))))
    return m.select("conv_id", "turn", "m.intent", F.array_join("m.keywords", ",").alias("keywords"), "m.since")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') END AS day_start, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(date_trunc('day', o_orderdate) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') END AS day_end FROM orders")
def date_parse(s, d):
    m = F.col("o_orderkey") % 3
    c = F.when(m == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 2, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return A.read(s, d, "orders").select("o_orderkey", timex.ts_text(timex.parsed_date(c)).alias("day_start"), timex.ts_text(timex.parsed_date(c, True)).alias("day_end"))


@query(f"SELECT id, {TS.format('fetched_at + INTERVAL 8 HOUR')} AS local, {TS.format('fetched_at - INTERVAL 8 HOUR')} AS utc, {TS.format('to_timestamp(1700000000 + id * 3600)::TIMESTAMP + INTERVAL 8 HOUR')} AS unix_local FROM core")
def local_times(s, d):
    f, u = F.col("fetched_at"), F.col("id") * 3600 + 1_700_000_000
    return A.items(s, d).select("id", timex.ts_text(timex.to_local(f)).alias("local"), timex.ts_text(timex.to_utc(f)).alias("utc"), timex.ts_text(timex.from_unix(u)).alias("unix_local"))


@query("""SELECT topic_id, CASE WHEN hours >= 24 THEN CAST(floor(hours / 24) AS BIGINT) || '天' ELSE '' END || CAST(floor(hours - 24 * floor(hours / 24)) AS BIGINT) || '小时' AS span, CASE WHEN r >= 24 THEN r // 24 || '天' ELSE '' END || r % 24 || '小时' AS home,
  CASE WHEN a < 1 THEN '今天' WHEN a = 1 THEN '昨天' WHEN a = 2 THEN '前天' WHEN a < 7 THEN a || '天前' ELSE strftime(last_active, '%Y/%m/%d ') || CASE WHEN hour(last_active) < 12 THEN 'am' ELSE 'pm' END END AS ago
FROM (SELECT *, CAST(floor(hours + 0.5) AS BIGINT) AS r, CAST(floor(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - last_active) / 3600) / 24) AS BIGINT) AS a FROM topics)""")
def time_displays(s, d):
    t, h = T.with_hours(A.topics(s, d)), F.col("hours")
    return t.select("topic_id", text.span_text(h).alias("span"), text.ui_days_hours(h).alias("home"), timex.relative_day(F.col("last_active"), A.as_of()).alias("ago"))


@query(f"SELECT doc_id, {_norm_sql('text')} || ' ' || source AS input FROM documents")
def embedding_inputs(s, d):
    return A.read(s, d, "documents").select("doc_id", text.embedding_input(F.col("text"), F.col("source")).alias("input"))


# ---------------------------------------------------------------- statistics

query(_CM.format("WHERE first_seen >= TIMESTAMP '2024-01-08 00:00:00'"), "category_metrics_window")(lambda s, d: metrics.category_metrics(T.with_hours(A.topics(s, d)), since=at("2024-01-08 00:00:00")))

for _metric, _sql in (("topics_count", "count(*)"), ("avg_hours", "round(avg(hours), 2)"), ("intensity_avg", "round(avg(intensity_total), 2)"), ("heat_sum", "round(sum(heat), 6)")):
    query(f"SELECT strftime(first_seen, '%Y-%m-%d') AS day, CAST({_sql} AS DOUBLE) AS value FROM topics WHERE category = 'current_affairs' GROUP BY 1", f"category_series_{_metric}")(
        lambda s, d, m=_metric: metrics.category_series(T.with_hours(A.topics(s, d)), "current_affairs", m)
    )


@query(f"""SELECT t.*, {TS.format('r.run_hour')} AS run_hour, CASE WHEN r.good = r.n THEN 'success' WHEN r.good = 0 THEN 'failed' ELSE 'partial' END AS run_status, r.n AS run_items
FROM (SELECT count(*) AS topics_total, count(*) FILTER (status = 'active') AS topics_active, count(*) FILTER (status = 'ended') AS topics_ended FROM topics) t,
(SELECT run_hour, count(*) AS n, count(heat_value) AS good FROM core GROUP BY run_hour ORDER BY run_hour DESC LIMIT 1) r""")
def admin_summary_run(s, d):
    r = metrics.summary(A.topics(s, d), A.items(s, d))
    return r.withColumn("run_hour", timex.ts_text(F.col("run_hour")))


@query("SELECT period, count(*) AS groups, round(count(*) FILTER (n >= 2) / count(*), 6) AS merge_rate, round(sum(n * 0.5::DOUBLE) / count(*), 6) AS avg_seconds FROM (SELECT period, topic_id, count(*) AS n FROM core GROUP BY period, topic_id) GROUP BY period")
def global_merge_rates(s, d):
    g = A.items(s, d).groupBy("period", "topic_id").agg(F.count("*").alias("n")).select("period", (F.col("n") >= 2).alias("merged"), (F.col("n") * 0.5).alias("seconds"))
    return metrics.global_rates(g).select("period", "groups", r6("merge_rate"), r6("avg_seconds"))


@query(", gr AS (SELECT topic_id, period, id % 4 AS seq, sum(heat_normalized) AS h, count(*) AS n FROM heat GROUP BY topic_id, period, id % 4) SELECT topic_id, period, round(arg_max(h, seq), 9) AS heat, CAST(sum(n) AS BIGINT) AS source_count FROM gr GROUP BY topic_id, period")
def period_heat_groups(s, d):
    g = A.with_heat(s, d).groupBy("topic_id", "period", (F.col("id") % 4).alias("seq")).agg(F.sum("heat_normalized").alias("heat"), F.count("*").alias("source_count"))
    return heat.add_groups(g).withColumn("heat", F.round("heat", 9))


@query(", " + _PH.format("sum(heat_normalized)") + ", pk AS (SELECT topic_id, max(heat) AS m FROM p GROUP BY topic_id) SELECT topic_id, round(m, 6) AS heat FROM topics JOIN pk USING (topic_id) WHERE round(topics.heat, 6) <> round(m, 6)")
def peak_backfill(s, d):
    t = A.topics(s, d).withColumn("heat", F.round("heat", 6))
    return heat.raised_peaks(t, heat.period_heat(A.with_heat(s, d)).withColumn("heat", F.round("heat", 6)))


@query("SELECT t.topic_id, count(c.id) AS node_count FROM topics t LEFT JOIN core c USING (topic_id) WHERE t.status = 'active' AND t.last_active >= TIMESTAMP '2024-01-30 12:00:00' GROUP BY t.topic_id")
def active_node_counts(s, d):
    return T.active_node_counts(A.topics(s, d), A.items(s, d), at("2024-01-30 12:00:00"))


@query(f""", tl AS (SELECT *, trim(title) AS k1, trim(coalesce(nullif(summary, ''), title)) AS k2, coalesce(published_at, fetched_at) AS at_ FROM items),
g AS (SELECT topic_id, arg_max(id, (at_, id)) AS item_id, count(*) AS n, min(at_) AS a, max(at_) AS b, string_agg(platform, ',' ORDER BY at_ DESC, id DESC) AS p, string_agg(url, ',' ORDER BY at_ DESC, id DESC) AS u FROM tl GROUP BY topic_id, k1, k2)
SELECT topic_id, item_id, CASE WHEN n > 1 THEN n END AS reports, CASE WHEN n > 1 THEN {TS.format('a')} END AS first_at, CASE WHEN n > 1 THEN {TS.format('b')} END AS last_at, CASE WHEN n > 1 THEN p END AS platforms, CASE WHEN n > 1 THEN u END AS urls, CASE WHEN n > 1 THEN n END AS n_times FROM g""")
def timeline_reports(s, d):
    t = timeline.with_reports(A.items_titled(s, d))
    return t.select("topic_id", "item_id", "reports", ts("first_at"), ts("last_at"), F.array_join("platforms", ",").alias("platforms"), F.array_join("urls", ",").alias("urls"), F.when(F.col("times").isNotNull(), F.size("times").cast("bigint")).alias("n_times"))


# ---------------------------------------------------------------- merging

_OPEN = "op AS (SELECT topic_id FROM topics WHERE status = 'active' AND last_active >= TIMESTAMP '2024-07-28 00:00:00' - INTERVAL 180 DAY)"


@query(f""", {_OPEN}, near AS (SELECT q.id, s.topic_id, s.id AS sid, list_cosine_similarity(q.x, s.x) AS c FROM vectors q, vectors s WHERE q.object_type = 'source_item' AND s.object_type = 'topic_summary' AND s.topic_id IN (SELECT topic_id FROM op)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, sid) AS rn FROM near), b AS (SELECT id, topic_id, min(rn) AS rn, max(c) AS c FROM k WHERE rn <= 6 AND c >= 0.25 GROUP BY id, topic_id)
SELECT id, topic_id, round(c, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rn) AS rank FROM b) WHERE rank <= 3""")
def candidate_topics_open(s, d):
    v = A.vectors(s, d)
    open_topics = search.mergeable(v.where("object_type = 'topic_summary'"), A.topics(s, d), at("2024-07-28 00:00:00"))
    return search.candidates(v.where("object_type = 'source_item'"), open_topics, 6, 0.25, 3).select("id", "topic_id", r6("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT id, object_type, topic_id FROM vectors WHERE object_type = 'topic_summary' AND id IN (2, 4, 5, 90)")
def vector_get(s, d):
    return search.get(A.vectors(s, d), "topic_summary", [2, 4, 5, 90]).select("id", "object_type", "topic_id")


@query("SELECT topic_id FROM topics WHERE status = 'active' ORDER BY last_active DESC, topic_id LIMIT 5")
def topic_vector_fallback(s, d):
    """No vector is of this type, so the newest topics are given."""
    found = search.topics_lenient(A.vectors(s, d).where("object_type = 'none'"), Q0, 5).select("topic_id")
    return search.or_else(found, T.filtered(A.topics(s, d), "active").orderBy(F.desc("last_active"), "topic_id").limit(5).select("topic_id"))


@query("SELECT count(*) AS missing, CAST(coalesce(sum(id), 0) AS BIGINT) AS ids FROM summaries WHERE id NOT IN (SELECT id FROM vectors WHERE object_type = 'topic_summary')")
def vector_backfill(s, d):
    v = summaries.vectors_of(search.without_vector(A.summaries(s, d), A.vectors(s, d), "topic_summary"))
    return v.agg(F.count_if(F.size("x") == 64).alias("missing"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))


# ---------------------------------------------------------------- classification and summaries

_NOT_ALL = "id % 9 <> 0 AND topic_id % 7 <> 0"


@query(f""", mx AS (SELECT topic_id, id, fetched_at, platform, {_MIX} || CASE WHEN coalesce(summary, '') <> '' THEN ' ' || summary ELSE '' END AS said, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at DESC, id DESC) AS rn FROM items WHERE {_NOT_ALL} AND platform <> 'hupu'),
x AS (SELECT topic_id, 'none' AS platform, string_agg(said, ' ' ORDER BY rn) AS t FROM mx WHERE rn <= 20 GROUP BY topic_id),
sc AS (SELECT topic_id, {_score_sql('entertainment')} AS e, {_score_sql('current_affairs')} AS c, {_score_sql('sports_esports')} AS p FROM x)
SELECT topic_id, CASE WHEN e IS NULL OR greatest(e, c, p) = 0 THEN 'current_affairs' WHEN e = greatest(e, c, p) THEN 'entertainment' WHEN c = greatest(e, c, p) THEN 'current_affairs' ELSE 'sports_esports' END AS category,
  CASE WHEN e IS NULL OR greatest(e, c, p) = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN e IS NULL THEN 'default' WHEN greatest(e, c, p) = 0 THEN 'open' ELSE 'rule' END AS method FROM topics LEFT JOIN sc USING (topic_id)""")
def classify_topics(s, d):
    """What rules decide; topics that they leave open would go to a model, and have the default here."""
    m = F.col("id") % 5
    mark = F.when(m == 0, "演员夺得冠军 ").when(m == 1, "政策发布通知 ").when(m == 2, "普通文本 ").when(m == 3, "篮球转会 ").otherwise("")
    items = A.items_titled(s, d).where(_NOT_ALL).where("platform <> 'hupu'").withColumn("title", F.concat(mark, "title"))
    c = classify.by_rule(A.topics(s, d), items)
    return c.select("topic_id", F.coalesce("category", F.lit(classify.DEFAULT)).alias("category"), F.coalesce("confidence", F.lit(classify.DEFAULT_CONFIDENCE)).alias("confidence"), F.coalesce("method", F.lit("open")).alias("method"))


@query(""", nw AS (SELECT topic_id, max(generated_at) AS g FROM summaries WHERE topic_id % 4 <> 0 GROUP BY topic_id), c AS (SELECT core.topic_id, count(*) AS n FROM core JOIN nw ON nw.topic_id = core.topic_id AND core.fetched_at > nw.g GROUP BY core.topic_id)
SELECT t.topic_id, coalesce(c.n, 0) AS new_nodes, CASE WHEN nw.g IS NULL THEN 'full' WHEN coalesce(c.n, 0) >= 3 AND epoch(TIMESTAMP '2024-01-31 00:00:00' - nw.g) / 3600.0 >= 6 THEN 'incremental' ELSE 'keep' END AS mode FROM topics t LEFT JOIN nw USING (topic_id) LEFT JOIN c USING (topic_id)""")
def summary_states(s, d):
    nodes = A.items(s, d).select("topic_id", "id", F.col("fetched_at").alias("appended_at"))
    return summaries.due(A.topics(s, d), nodes, A.summaries(s, d).where("topic_id % 4 <> 0"), A.as_of()).select("topic_id", "new_nodes", "mode")


@query(_ANSWERS + """SELECT doc_id AS topic_id, CASE WHEN doc_id % 5 = 0 THEN '事件「' || source || '」的摘要正在生成中...' WHEN j IS NOT NULL THEN trim(json_extract_string(j, '$.updated_summary')) ELSE trim(regexp_extract(b, '"updated_summary"\\s*:\\s*"([^"]+)"', 1)) END AS content, CASE WHEN doc_id % 5 = 0 THEN 'placeholder' ELSE 'incremental' END AS method
FROM obj JOIN documents USING (doc_id) WHERE doc_id % 5 = 0 OR (CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.needs_update') <> 'false', true) ELSE true END AND trim(coalesce(CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.updated_summary') ELSE regexp_extract(b, '"updated_summary"\\s*:\\s*"([^"]+)"', 1) END, '')) <> '')""")
def summary_outcomes(s, d):
    """A fifth of the answers failed and were to be full summaries; the others are updates, some of them not needed or broken."""
    w, m = F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), F.col("doc_id") % 6
    j = lambda head, tail: F.concat(F.lit(head + '"updated_summary": "'), w, F.lit(tail))
    a = F.when(m == 0, j('{"needs_update": false, ', '"}')).when(m == 1, j("{", '"}')).when(m == 2, F.concat(F.lit("<think>"), w, j('</think> so {"needs_update": true, ', '"} done')))
    a = a.when(m == 3, j("{", '", "new')).when(m == 4, w).otherwise("")
    bad = F.col("doc_id") % 5 == 0
    rows = A.read(s, d, "documents").select(F.col("doc_id").alias("topic_id"), F.col("source").alias("title"), F.when(bad, "full").otherwise("incremental").alias("mode"), a.alias("answer"), F.when(bad, "failed").otherwise("success").alias("status"))
    r = summaries.resolved(rows)
    return r.select("topic_id", "content", "method")


@query("SELECT 'classify' AS kind, doc_id AS target_id, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'success' END AS status, length(text) // 2 AS tokens_prompt, length(source) // 2 AS tokens_completion FROM documents")
def judgement_rows(s, d):
    a = A.read(s, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("source").alias("answer"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("success").alias("status"))
    return summaries.judgements(a, "classify", "doc_id", A.as_of()).select("kind", "target_id", "status", "tokens_prompt", "tokens_completion")


# ---------------------------------------------------------------- questions


@query("""SELECT topic_id, score FROM (SELECT *, CAST(contains(title, 'the') AS BIGINT) + CAST(contains(title, 'tion') AS BIGINT) AS score FROM topics) t WHERE (SELECT max(CAST(contains(title, 'the') AS BIGINT) + CAST(contains(title, 'tion') AS BIGINT)) FROM topics) > 0 ORDER BY score DESC, last_active DESC, topic_id LIMIT 20""")
def keyword_rerank_ordered(s, d):
    return T.reranked(A.topics(s, d), ["the", "tion"], [F.desc("last_active"), F.asc("topic_id")]).limit(20).select("topic_id", "score")


@query(f""", kw AS (SELECT topic_id, 0 AS o, epoch(TIMESTAMP '2100-01-01 00:00:00' - last_active) AS k FROM topics WHERE contains(lower(title), 'the') OR contains(lower(title), 'tion') ORDER BY last_active DESC, topic_id LIMIT 10),
h AS (SELECT topic_id, 1 - list_cosine_similarity(x, {Q0_SQL}) AS c, id FROM vectors WHERE object_type = 'topic_summary' ORDER BY c, id LIMIT 20), ve AS (SELECT topic_id, 1 AS o, min(c) AS k FROM h GROUP BY topic_id ORDER BY min(c), topic_id LIMIT 10),
hit AS (SELECT topic_id, min(o) AS o, arg_min(k, o) AS k FROM (SELECT * FROM kw UNION ALL SELECT * FROM ve) GROUP BY topic_id ORDER BY min(o), arg_min(k, o), topic_id LIMIT 10),
sc AS (SELECT t.*, hit.o, hit.k, CAST(contains(title, 'the') AS INTEGER) + CAST(contains(title, 'tion') AS INTEGER) AS score FROM hit JOIN topics t USING (topic_id) WHERE topic_id IN (SELECT topic_id FROM core WHERE platform IN ('weibo', 'sina'))),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, o, k, topic_id) AS rank FROM sc WHERE (SELECT max(score) FROM sc) > 0 QUALIFY rank <= 5),
told AS (SELECT topic_id, arg_max(content, (generated_at, id)) AS content FROM summaries GROUP BY topic_id), onp AS (SELECT topic_id, string_agg(DISTINCT platform, ' / ' ORDER BY platform) AS ps FROM core GROUP BY topic_id),
nd2 AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fetched_at DESC, id DESC) AS rn FROM items WHERE platform IN ('weibo', 'sina')),
parts AS (SELECT topic_id, rank, 1 AS k, 'topic_overview' AS type, '【主题概览】' || title || chr(10) || '时间范围: ' || {TS.format('first_seen')} || ' - ' || {TS.format('last_active')} || chr(10) || '来源平台: ' || ps || CASE WHEN coalesce(content, '') <> '' THEN chr(10) || '摘要: ' || content ELSE '' END AS chunk FROM best JOIN onp USING (topic_id) LEFT JOIN told USING (topic_id)
UNION ALL SELECT topic_id, rank, 2, 'topic_summary', '【主题：' || title || '】' || chr(10) || content FROM best JOIN told USING (topic_id)
UNION ALL SELECT b.topic_id, b.rank, 3, 'node', '. [' || n.platform || '] ' || strftime(n.fetched_at, '%Y-%m-%d %H:%M') || chr(10) || '   ' || n.title || chr(10) || '   ' || substr(coalesce(n.summary, ''), 1, 200) FROM best b JOIN nd2 n ON n.topic_id = b.topic_id AND n.rn = 1)
SELECT CAST(pos AS INTEGER) AS pos, topic_id, type, CASE WHEN type = 'node' THEN pos || chunk ELSE chunk END AS chunk FROM (SELECT *, row_number() OVER (ORDER BY rank, k) AS pos FROM parts) ORDER BY pos""")
def global_context(s, d):
    t, i, platforms = A.topics(s, d), A.items(s, d), ["weibo", "sina"]
    ranked = agent.global_topics(t, i, A.vectors(s, d), Q0, ["the", "tion"], platforms)
    return agent.global_context(ranked, t, A.summaries(s, d), A.items_titled(s, d), platforms)


# ---------------------------------------------------------------- access


@query(""", inv AS (SELECT DISTINCT topic_id AS id, topic_id % 3 + 1 AS max_uses FROM core), asked AS (SELECT i.id, 't' || e.id || '-' || i.id AS token FROM inv i JOIN (SELECT DISTINCT id % 3 AS id FROM core) e ON true),
used AS (SELECT *, row_number() OVER (PARTITION BY asked.id ORDER BY token) AS k FROM asked JOIN inv USING (id)) SELECT id, count(*) AS used_count, min(token) AS first_token, '2024-02-07 00:00:00' AS expires_at FROM used WHERE k <= max_uses GROUP BY id""")
def invite_redeem(s, d):
    u = F.col("topic_id")
    inv = A.items(s, d).select(u).distinct().select(
        u.alias("id"), F.concat(F.lit("c"), u.cast("string")).alias("code"), F.lit("active").alias("status"), (u % 3 + 1).alias("max_uses"), F.lit(0).cast("bigint").alias("used_count"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"), at("2024-01-30 00:00:00").alias("created_at"),
    )
    asked = inv.withColumn("e", F.explode(F.array(*[F.lit(k) for k in range(3)]))).select(F.concat(F.lit(" c"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("t"), F.col("e").cast("string"), F.lit("-"), F.col("id").cast("string")).alias("token"))
    after, tokens = access.redeem(inv, asked, A.as_of())
    first = tokens.groupBy("invite_id").agg(F.min("token").alias("first_token"), timex.ts_text(F.max("expires_at")).alias("expires_at"))
    return after.join(first, F.col("id") == F.col("invite_id")).select("id", "used_count", "first_token", first["expires_at"])
