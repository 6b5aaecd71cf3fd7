"""Queries of what models answer: broken answers, built from whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, timex
from ..operators import context, heat
from ..sources import adapters as A
from ..sources import pages
from .catalogue import query

#: Answers by doc_id: JSON that is whole, cut off, inside a text, short, with quotes inside, with thoughts around it, or none.
_KINDS = 13


def answers(s, d):
    """doc_id, w (the text without control characters), a (an answer made of it)."""
    doc = A.read(s, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " / "), r"[\x00-\x1f\\]", "").alias("w"))
    w, m, lit = F.col("w"), F.col("doc_id") % _KINDS, F.lit
    q = F.replace(w, lit('"'), lit('\\"'))
    json = F.concat(lit('{"summary": "'), q, lit('", "key_points": []}'))
    a = F.when(m == 0, json).when(m == 1, F.concat(lit('{"summary": "'), q)).when(m == 2, F.concat(lit("It says: "), json, lit(" and that's all"))).when(m == 3, F.concat(lit('{"summary": "'), F.left(w, lit(5)), lit('"} more')))
    a = a.when(m == 4, F.concat(lit("<think>hm</think>\n"), json)).when(m == 5, F.concat(lit("<think>"), w)).when(m == 6, F.concat(w, lit(" <think>so"))).when(m == 7, F.concat(lit('{"text": "'), q, lit('"}')))
    a = a.when(m == 8, "").when(m == 9, F.concat(lit('{"summary": "she said "'), w, lit('" twice\\n", "key_points": ["a'))).when(m == 10, F.left(w, lit(12)))
    a = a.when(m == 11, F.concat(lit('{"a": {"summary": "'), q, lit('"}, "b": {')) ).otherwise(F.concat(lit(' { "summary" : "'), F.left(F.replace(w, lit('"'), lit("")), lit(40)), lit("")))
    return doc.select("doc_id", "w", a.alias("a"))


_ANSWERS = f""", dw AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(10), ' / '), '[\\x00-\\x1f\\\\]', '', 'g') AS w FROM documents),
dq AS (SELECT doc_id, w, doc_id % {_KINDS} AS m, replace(w, '"', '\\"') AS q FROM dw),
dj AS (SELECT *, '{{"summary": "' || q || '", "key_points": []}}' AS json FROM dq),
ans AS (SELECT doc_id, w, CASE m WHEN 0 THEN json WHEN 1 THEN '{{"summary": "' || q WHEN 2 THEN 'It says: ' || json || ' and that''s all' WHEN 3 THEN '{{"summary": "' || left(w, 5) || '"}} more'
  WHEN 4 THEN '<think>hm</think>' || chr(10) || json WHEN 5 THEN '<think>' || w WHEN 6 THEN w || ' <think>so' WHEN 7 THEN '{{"text": "' || q || '"}}' WHEN 8 THEN ''
  WHEN 9 THEN '{{"summary": "she said "' || w || '" twice\\n", "key_points": ["a' WHEN 10 THEN left(w, 12) WHEN 11 THEN '{{"a": {{"summary": "' || q || '"}}, "b": {{' ELSE ' {{ "summary" : "' || left(replace(w, '"', ''), 40) END AS a FROM dj),
b AS (SELECT doc_id, a, CASE WHEN regexp_extract(a, '(?is)</think>\\s*(.+)', 1) <> '' THEN trim(regexp_extract(a, '(?is)</think>\\s*(.+)', 1), ' ' || chr(10))
  WHEN regexp_extract(a, '(?is)^(.+?)<think>', 1) <> '' THEN trim(regexp_extract(a, '(?is)^(.+?)<think>', 1), ' ' || chr(10)) ELSE a END AS t FROM ans),
p AS (SELECT *, regexp_extract(t, '(?s)\\{{[^{{}}]*"summary"[^{{}}]*\\}}', 0) AS p1, regexp_extract(t, '(?s)\\{{.+\\}}', 0) AS p2, regexp_extract(t, '(?s)"summary"\\s*:\\s*"([^"].*)$', 1) AS rest FROM b),
x AS (SELECT *, coalesce(CASE WHEN p1 <> '' AND json_valid(p1) THEN json_extract_string(p1, '$.summary') END, CASE WHEN p2 <> '' AND json_valid(p2) THEN json_extract_string(p2, '$.summary') END) AS inner_one,
  length(rest) - length(replace(rest, '"', '')) AS n, trim(regexp_replace(regexp_replace(t, '^\\s*\\{{\\s*"summary"\\s*:\\s*"', ''), '"\\s*[,}}]?\\s*$', ''), ' ' || chr(10)) AS bare FROM p)
"""


@query(_ANSWERS + f"""SELECT doc_id, CASE WHEN a = '' THEN '{jsonx.NO_CONTENT}' WHEN json_valid(t) AND t <> '' THEN coalesce(json_extract_string(t, '$.summary'), '{jsonx.NO_FIELD}') WHEN length(inner_one) > 50 THEN inner_one
  WHEN n > 0 THEN replace(replace(array_to_string(string_split(rest, '"')[1:n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END], '"'), '\\"', '"'), '\\n', chr(10)) WHEN length(bare) < 20 THEN trim(t, ' ' || chr(10)) ELSE bare END AS summary FROM x""")
def summary_answers(s, d):
    return answers(s, d).select("doc_id", jsonx.summary_field(F.col("a")).alias("summary"))


_STATE = """, sw AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(10), ' / '), '[\x00-\x1f\\\\]', '', 'g') AS w FROM documents),
sq AS (SELECT doc_id, '["' || replace(w, '"', '\\"') || '", {"t": "}]"}]' AS l FROM sw)
"""


@query(_STATE + """SELECT doc_id, '{"a": [ ], "b": {"c": "[1]{", "d": ' || l || ', "e": [2]}}' AS state, l AS first FROM sq""")
def embedded_state(s, d):
    """Whole texts as JSON within a page, with brackets and quotes in them."""
    w = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " / "), r"[\x00-\x1f\\]", "")
    json = F.concat(F.lit('{"a": [ ], "b": {"c": "[1]{", "d": ["'), F.replace(w, F.lit('"'), F.lit('\\"')), F.lit('", {"t": "}]"}], "e": [2]}}'))
    page = F.concat(F.lit("<html><script>var x = {}; window.STATE = "), json, F.lit("; f({});</script>"), w)
    return A.read(s, d, "documents").withColumn("state", pages.embedded_object(page, "STATE")).select("doc_id", "state", pages.first_list(F.col("state")).alias("first"))


# Patterns as in functions.text, for the SQL.
_ALL = "(不要|不需要|去掉|取消).*(近期|最近|近来|最新)|全部时间|所有时间|不限时间|不限制时间|全量|不限范围|全部范围"
_MORE = "(不要|不需要|去掉|取消|改为|改成|全部|所有|不限|不限制|近期|最近|近来|最新|时间|范围|只要|只看|仅|只|的|，|,|。|\\s)"


@query(f""", cv AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN CASE (conv_id + turn) % 7 WHEN 0 THEN '只看近7天' WHEN 1 THEN '不要最近' WHEN 2 THEN '改为最近30天 ' || left(text, 2) WHEN 3 THEN '近半年 ' || text ELSE text END
  WHEN 'assistant' THEN text || CASE (conv_id + turn) % 4 WHEN 0 THEN '（本次使用工具：topic_query, topic_search）' WHEN 1 THEN '（本次使用工具：topic_search）' ELSE '' END ELSE text END AS t FROM conversations),
us AS (SELECT conv_id, turn, trim(t, ' ' || chr(10)) AS t FROM cv WHERE role = 'user' AND trim(t, ' ' || chr(10)) <> ''), la AS (SELECT conv_id, max(turn) AS at_, arg_max(t, turn) AS question FROM us GROUP BY conv_id),
pr AS (SELECT us.conv_id, arg_max(trim(us.t), us.turn) AS q FROM us JOIN la ON la.conv_id = us.conv_id AND us.turn < la.at_ GROUP BY us.conv_id),
tl AS (SELECT cv.conv_id, arg_max(CASE WHEN contains(t, 'topic_query, topic_search）') THEN 'topic_query' ELSE 'topic_search' END, turn) AS tool FROM cv JOIN la ON la.conv_id = cv.conv_id AND cv.turn < la.at_ WHERE role = 'assistant' AND contains(t, '本次使用工具：') GROUP BY cv.conv_id),
fl AS (SELECT la.*, pr.q, tl.tool, NOT regexp_matches(regexp_replace(question, '{_MORE}', '', 'g'), '[A-Za-z0-9]{{3,}}|[一-鿿]{{2,}}') AS refine_only FROM la LEFT JOIN pr USING (conv_id) LEFT JOIN tl USING (conv_id))
SELECT conv_id, question, CASE WHEN refine_only AND q IS NOT NULL THEN q || ' ' || question ELSE question END AS resolved, regexp_matches(question, '{_ALL}') AS all_time,
  CASE WHEN regexp_matches(question, '近一周|最近7天|近7天|本周') THEN 7 WHEN regexp_matches(question, '近两周|最近14天|近14天') THEN 14 WHEN regexp_matches(question, '近一月|最近30天|近30天|本月') THEN 30
  WHEN regexp_matches(question, '近三月|最近90天|近90天') THEN 90 WHEN regexp_matches(question, '近半年|最近180天|近180天') THEN 180 END AS recent_days, refine_only, coalesce(tool, '') AS last_tool FROM fl""")
def followup_plan(s, d):
    k, t, lit = F.col("conv_id") + F.col("turn"), F.col("text"), F.lit
    user = F.when(k % 7 == 0, "只看近7天").when(k % 7 == 1, "不要最近").when(k % 7 == 2, F.concat(lit("改为最近30天 "), F.left(t, lit(2)))).when(k % 7 == 3, F.concat(lit("近半年 "), t)).otherwise(t)
    answer = F.concat(t, F.when(k % 4 == 0, "（本次使用工具：topic_query, topic_search）").when(k % 4 == 1, "（本次使用工具：topic_search）").otherwise(""))
    said = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", answer).otherwise(t)
    return context.followups(A.read(s, d, "conversations").select("conv_id", "turn", "role", said.alias("text")))


@query("SELECT topic_id, strftime(last_active, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract('microsecond' FROM last_active) % 1000000 = 0 THEN '' ELSE strftime(last_active, '.%f') END AS last_active, strftime(first_seen + INTERVAL 1500 MICROSECOND, '%Y-%m-%dT%H:%M:%S.%f') AS later FROM topics")
def topics_iso(s, d):
    return A.topics(s, d).select("topic_id", timex.iso_text(F.col("last_active")).alias("last_active"), timex.iso_text(F.col("first_seen") + F.expr("INTERVAL '0.0015' SECOND")).alias("later"))


_WEIGHTS = '{"weibo": 2, "sina": 0.5}'


@query("""SELECT platform, count(*) AS n, round(sum(CASE platform WHEN 'weibo' THEN 2.0::DOUBLE WHEN 'sina' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * coalesce(heat_value, 0.0)), 4) AS weighted FROM core GROUP BY platform""")
def heat_by_setting(s, d):
    w = heat.weight(F.col("platform"), heat.weights_of(_WEIGHTS))
    return A.items(s, d).groupBy("platform").agg(F.count("*").alias("n"), F.round(F.sum(w * F.coalesce("heat_value", F.lit(0.0))), 4).alias("weighted"))
