"""Questions about topics: plan, tools, context, answer. DataFrames do the work; the driver only puts it in order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text
from ..functions.timex import hours_between, ts_text
from ..providers import ChatModel, StubChat, hashed_vector
from . import search
from . import topics as T

FALLBACK = "抱歉，暂时无法回答这个问题。"
# Words that tell what a question wants.
INTENTS = {"compare": ["对比", "比较", "区别"], "analysis": ["分析", "趋势", "为什么", "原因"], "query": ["多少", "哪些", "排行", "列表", "最热", "最新"], "search": ["搜索", "查找", "关于", "相关"]}
# Words that shape a question and say nothing where a run of characters begins or ends.
SHAPING = ["的", "有", "了", "是", "主题", "话题"]

#: Topics that a listing gives.
QUERY_LIMIT = 20

TOOLS = [
    {"name": "topic_query", "parameters": {"fields": "array", "filters": "object", "order": "string", "limit": "integer"}},
    {"name": "topic_search", "parameters": {"keywords": "array", "match": "string", "platforms": "array", "limit": "integer"}},
]


def resolve(question: str, history: list[dict] | None = None) -> tuple[str, dict, bool, str]:
    """(the question, with the user's one before it where it only refines that; time filters it asks for; whether it only
    refines; the tool of the newest answer whose footer names one). history: messages (role, content), oldest first."""
    said = question.strip()
    days = next((n for pattern, n in text.RECENT if re.search(pattern, said)), None)
    refines = not re.search(r"[A-Za-z0-9]{3,}|[一-鿿]{2,}", re.sub(text.MODIFIERS, "", said))
    before = next((m["content"].strip() for m in reversed(history or []) if m.get("role", "").lower() == "user" and (m.get("content") or "").strip()), "")
    tools = [re.search(r"本次使用工具：([^）)\n]+)", m.get("content") or "") for m in reversed(history or []) if m.get("role", "").lower() == "assistant"]
    named = (next((t for t in ("topic_query", "topic_search") if t in {x.strip() for x in found[1].split(",")}), "") for found in tools if found)
    time_filter = {"all_time": bool(re.search(text.FORCE_ALL, said)), "recent_days": days}
    return f"{before} {said}" if refines and before else said, time_filter, refines, next((t for t in named if t), "")


def plan(question: str, history: list[dict] | None = None) -> list[dict]:
    """Tool calls for a question, by its words; none for small talk. One that only refines the question before it ("only the last
    7 days") asks that one again, with the tool of the last answer. Listings come longest echo first, unless heat is asked for."""
    question, time_filter, refines, tool = resolve(question, history)
    intent = next((k for k, ws in INTENTS.items() if any(w in question for w in ws)), "chat" if len(question.strip()) < 4 else "search")
    if refines and history and (tool or intent == "chat"):
        intent = "query" if tool == "topic_query" else "search"
    platforms = list(dict.fromkeys(p for a, p in K.PLATFORM_ALIASES.items() if a in question))
    rest = question
    for pattern, _ in text.RECENT:
        rest = re.sub(pattern, " ", rest)
    rest = re.sub(text.FORCE_ALL, " ", rest)
    for w in sorted([*K.STOPWORDS, *K.PLATFORM_ALIASES, *(w for ws in INTENTS.values() for w in ws)], key=lambda w: (-len(w), w)):
        rest = rest.replace(w, " ")
    edges = "|".join(SHAPING)
    runs = [re.sub(f"^(?:{edges})+|(?:{edges})+$", "", w) for w in re.findall(r"[A-Za-z0-9]{2,}|[一-鿿]{2,}", rest)]
    words = list(dict.fromkeys(w for w in runs if len(w) > 1 and not re.fullmatch(f"(?:{text.MODIFIERS})+", w)))[:8]
    span = {"recent_days": time_filter["recent_days"]} if time_filter["recent_days"] else {}
    if intent == "chat":
        return []
    if intent == "query":
        return [{"tool": "topic_query", "args": {"platforms": platforms, "title_contains": words[0] if words else None, "order": "heat_desc" if "热" in question else "echo_length_desc", "limit": QUERY_LIMIT, **span}}]
    return [{"tool": "topic_search", "args": {"keywords": words, "platforms": platforms, "match_all": False, **span}}]


def topic_search(topics: DataFrame, items: DataFrame, vectors: DataFrame, question: str, keywords: list[str], platforms: list[str] | None = None, match_all: bool = False, since: Column | None = None, until: Column | None = None, limit: int = 10) -> DataFrame:
    """Keyword hits, then vector hits, each topic once; filtered, longest echo first."""
    hits = [search.topics_strict(vectors, hashed_vector(question), limit, K.SEARCH_COSINE).select("topic_id")]
    if keywords:
        hits.append(T.keyword_search(topics, keywords, match_all, since, until, limit).select("topic_id"))
    ids = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    t = topics.join(F.broadcast(ids.distinct()), "topic_id", "left_semi")  # 2 x limit ids at most
    t = T.on_platforms(t, items, platforms) if platforms else t
    return T.with_hours(t).orderBy(F.desc("hours"), "topic_id").limit(max(1, min(limit, 50)))


def chunks(context: DataFrame) -> DataFrame:
    """Rows (pos, type, title, summary, platform, at, content) as texts by their type."""
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    text = (
        F.when(F.col("type") == "summary", say("【主题摘要】\n", c("content")))
        .when(F.col("type") == "node", say(F.col("pos").cast("string"), ". [", F.coalesce("platform", F.lit("未知")), "] ", c("at"), "\n   ", c("title"), "\n   ", F.substring(c("summary"), 1, 200)))
        .when(F.col("type") == "topic_overview", say("【主题概览】", c("title"), "\n时间范围: ", c("at"), "\n来源平台: ", F.coalesce(F.nullif("platform", F.lit("")), F.lit("未知")), F.when(c("summary") != "", say("\n摘要: ", c("summary"))).otherwise("")))
        .when(F.col("type") == "topic_summary", say("【主题：", c("title"), "】\n", c("summary")))
        .otherwise(c("content"))
    )
    return context.withColumn("chunk", text)


def topic_context(topic_id: int, summaries: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """A topic's newest summary and its newest items."""
    s = T.newest_summary(summaries.where(F.col("topic_id") == topic_id)).select(F.lit(0).alias("pos"), F.lit("summary").alias("type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("string").alias("at"), "content")
    w = T.latest(items.where(F.col("topic_id") == topic_id), "topic_id", [F.desc("fetched_at"), F.desc("id")], n, "pos")
    i = w.select("pos", F.lit("node").alias("type"), "title", "summary", "platform", F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("at"), F.lit(None).cast("string").alias("content"))
    return chunks(s.unionByName(i)).orderBy("pos")


def global_topics(topics: DataFrame, items: DataFrame, vectors: DataFrame, q: list[float], keywords: list[str], platforms: list[str] | None = None, top_k: int = 10, most: int = 5) -> DataFrame:
    """(topic_id, rank) for a question about no topic in particular: keyword hits, newest first, then vector hits, nearest
    first, or else the newest topics; top_k at most. Of these the ones on the platforms, if any are; those with most keywords
    first, and none if no title has any. Windows and joins are over at most 2 x top_k rows."""
    far = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    newest = topics.where("status = 'active'").orderBy(F.desc("last_active"), "topic_id").limit(top_k)
    dated = lambda t, o: t.select("topic_id", F.lit(o).alias("o"), hours_between(F.col("last_active"), far).alias("k"))
    hits = search.topics_lenient(vectors, q, top_k).select("topic_id", F.lit(1).alias("o"), F.col("distance").alias("k"))
    if keywords:
        hits = dated(T.keyword_search(topics, keywords, limit=top_k), 0).unionByName(hits)
    best = search.or_else(hits, dated(newest, 2)).groupBy("topic_id").agg(F.min(F.struct("o", "k", "topic_id")).alias("s")).orderBy("s").limit(top_k)
    found = topics.join(F.broadcast(best), "topic_id")
    if platforms:
        found = search.or_else(T.on_platforms(found, items, platforms), found)
    found = T.reranked(found, keywords, [F.asc("s")])
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "s"))).where(F.col("rank") <= most).select("topic_id", "rank")


def global_context(ranked: DataFrame, topics: DataFrame, summaries: DataFrame, items: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """For each topic of a short list (topic_id, rank): an overview, its newest summary, its newest item (on the platforms)."""
    few = F.broadcast(ranked)
    mine = items.join(few, "topic_id")
    t = topics.join(few, "topic_id").join(T.newest_summary(summaries.join(few, "topic_id", "left_semi")).select("topic_id", "content"), "topic_id", "left")
    t = t.join(mine.groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_set("platform")), " / ").alias("on")), "topic_id", "left")
    none = F.lit(None).cast("string")
    span = F.concat(ts_text(F.col("first_seen")), F.lit(" - "), ts_text(F.col("last_active")))
    over = t.select("topic_id", "rank", F.lit(1).alias("k"), F.lit("topic_overview").alias("type"), "title", F.col("content").alias("summary"), F.col("on").alias("platform"), span.alias("at"))
    told = t.where("content IS NOT NULL").select("topic_id", "rank", F.lit(2).alias("k"), F.lit("topic_summary").alias("type"), "title", F.col("content").alias("summary"), none.alias("platform"), none.alias("at"))
    mine = mine.where(F.col("platform").isin(platforms)) if platforms else mine
    node = T.latest(mine, "topic_id", [F.desc("fetched_at"), F.desc("id")]).select(
        "topic_id", "rank", F.lit(3).alias("k"), F.lit("node").alias("type"), "title", "summary", "platform", F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("at")
    )
    rows = over.unionByName(told).unionByName(node).withColumn("pos", F.row_number().over(Window.orderBy("rank", "k")))
    return chunks(rows.withColumn("content", none)).select("pos", "topic_id", "type", "chunk").orderBy("pos")


def execute(calls: list[dict], question: str, topics: DataFrame, summaries: DataFrame, items: DataFrame, vectors: DataFrame, limit: int = 10, as_of: Column | None = None) -> DataFrame:
    """(pos, topic_id, chunk): what the tools find, in the order of the calls; a search for the question where they find nothing.
    An unknown tool is refused. Recent days are those before as_of, by default now."""
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    ago = lambda days: None if days is None else now - F.make_dt_interval(days=F.lit(days))
    told = T.newest_summary(summaries).select("topic_id", F.col("content").alias("summary"))

    def searched(k: int, recent_days=None, **args) -> DataFrame:
        r = topic_search(topics, items, vectors, question, limit=limit, since=ago(recent_days), **args)
        r = r if recent_days is None else r.where(F.col("last_active") >= ago(recent_days))
        r = r.join(told, "topic_id", "left").withColumn("__r", F.row_number().over(Window.orderBy(F.desc("hours"), "topic_id")))
        return r.select(F.lit(k).alias("k"), "__r", "topic_id", F.lit("topic_summary").alias("type"), "title", "summary", *[F.lit(None).cast("string").alias(c) for c in ("platform", "at", "content")])

    def queried(k: int, platforms=None, title_contains=None, order="last_active_desc", limit=limit, recent_days=None) -> DataFrame:
        by = T.QUERY_ORDERS.get(order, "last_active")
        r = T.topic_query(T.item_view(topics, summaries, items), ["topic_id", "title", "last_active", by], platforms=platforms or None, title_contains=title_contains, start=ago(recent_days), order=order, limit=limit)
        r = r.withColumn("__r", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "topic_id")))
        at = F.date_format("last_active", "yyyy-MM-dd HH:mm")
        return r.select(F.lit(k).alias("k"), "__r", "topic_id", F.lit("node").alias("type"), "title", F.col("item_summary").alias("summary"), F.col("item_platform").alias("platform"), at.alias("at"), F.lit(None).cast("string").alias("content"))

    tools = {"topic_search": searched, "topic_query": queried}
    if unknown := {c["tool"] for c in calls} - set(tools):
        raise ValueError(f"no such tool: {', '.join(sorted(unknown))}")
    found = [tools[c["tool"]](k, **c["args"]) for k, c in enumerate(calls)]
    default = searched(len(calls), keywords=[])
    rows = search.or_else(reduce(DataFrame.unionByName, found), default) if found else default
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy("k", "__r")))  # a few top lists
    return chunks(rows).select("pos", "topic_id", "chunk").orderBy("pos")


def footer(tools: list[str]) -> str:
    """What follows an answer: the tools that were used."""
    return f"\n\n（本次使用工具：{', '.join(sorted(set(tools))) or '无'}）"


def respond(question: str, topics: DataFrame, summaries: DataFrame, items: DataFrame, vectors: DataFrame, model: ChatModel | None = None, mode: str = "global", topic_id: int | None = None, history: list[dict] | None = None, as_of: Column | None = None) -> dict:
    """An answer: in topic mode from one topic's context; in global mode the plan's tools are run and their results are the
    context; small talk goes to the model as it is."""
    if mode not in ("global", "topic") or (mode == "topic") != (topic_id is not None):
        raise ValueError("mode is global, or topic with a topic_id")
    if mode == "topic":
        return ask(question, topic_context(topic_id, summaries, items), model)
    calls, question = plan(question, history), resolve(question, history)[0]
    if calls:
        got = ask(question, execute(calls, question, topics, summaries, items, vectors, as_of=as_of), model)
    else:
        said = (model or StubChat()).complete([{"role": "user", "content": question}])
        got = {"answer": said["content"] or FALLBACK, "citations": [], "diagnostics": {"chunks": 0, **said["usage"]}}
    names = [c["tool"] for c in calls]
    return {**got, "answer": got["answer"] + footer(names), "diagnostics": {**got["diagnostics"], "tools": names}}


def strip_stream(parts: Iterator[str]) -> Iterator[str]:
    """Parts of a text without what stands between think tags, also where a tag is cut between parts."""
    held, hidden = "", False
    for part in parts:
        held += part
        out = ""
        while held:
            tag = "</think>" if hidden else "<think>"
            at = held.find(tag)
            if at >= 0:
                out += "" if hidden else held[:at]
                held, hidden = held[at + len(tag) :], not hidden
                continue
            tail = next((k for k in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-k:])), 0)
            out += "" if hidden else held[: len(held) - tail]
            held = held[len(held) - tail :]
            break
        yield out
    if held and not hidden:
        yield held


def asked(question: str, context: DataFrame | None) -> tuple[list, list[dict]]:
    """The context's chunks (a top list, the only thing that comes to the driver) and the messages for a model."""
    rows = context.limit(50).collect() if context is not None else []
    said = "\n".join(r["chunk"] for r in rows)
    return rows, [{"role": "user", "content": f"{said}\n问：{question}\n答：{said[:200]}"}]


def citation(c: dict) -> dict:
    """What readers get of a citation; what it lacks is empty."""
    return {"topic_id": c.get("topic_id"), "node_id": c.get("node_id"), **{k: c.get(k) or "" for k in ("source_url", "snippet", "platform")}}


def citations(rows: list) -> list[dict]:
    return [{"pos": r["pos"], **citation({**r.asDict(), "snippet": r["chunk"][:150]})} for r in rows]


def ask(question: str, context: DataFrame | None, model: ChatModel | None = None) -> dict:
    """An answer with its citations."""
    rows, messages = asked(question, context)
    if not rows:
        return {"answer": FALLBACK, "citations": [], "diagnostics": {"chunks": 0}}
    got = (model or StubChat()).complete(messages)
    answer = "".join(strip_stream(iter([got["content"]]))).strip()
    return {"answer": answer or FALLBACK, "citations": citations(rows), "diagnostics": {"chunks": len(rows), **got["usage"]}}


def ask_stream(question: str, context: DataFrame | None, model: ChatModel | None = None) -> Iterator[str]:
    """Server-sent events: a token event for each part as the model gives it, then citations and done. Whatever fails, also
    in the middle of an answer, is an error event, which is the last one."""
    event = lambda name, data: f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
    try:
        rows, messages = asked(question, context)
        said = ""
        for part in strip_stream((model or StubChat()).stream(messages)) if rows else ():
            if part:
                said += part
                yield event("token", {"content": part})
        if not said.strip():
            yield event("token", {"content": FALLBACK})
        yield event("citations", citations(rows))
        yield event("done", {"chunks": len(rows), "completion_tokens": len(said) // 2})
    except Exception as x:  # told to the reader
        yield event("error", {"message": str(x)[:500]})
