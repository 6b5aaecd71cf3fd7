"""Prompts as Column expressions: every row's prompt is made in the JVM, and only the finished text goes to a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CATEGORIES


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def same_event(leader_title: Column, leader_summary: Column, titles: Column) -> Column:
    return _say("判断下列报道是否为同一事件。\n代表：", leader_title, "\n", F.substring(leader_summary, 1, 150), "\n报道：\n", F.array_join(titles, "\n"), '\n只回答 JSON：{"is_same_event": bool, "confidence": 0-1, "reason": str}')


def relation(title: Column, summary: Column, candidates: Column) -> Column:
    """candidates: array of texts, in the order by which an answer may number them."""
    listed = F.array_join(F.transform(candidates, lambda c, k: F.concat((k + 1).cast("string"), F.lit(". "), c)), "\n")
    return _say("新事件：", title, "\n", F.substring(summary, 1, 200), "\n候选主题：\n", listed, '\n只回答 JSON：{"decision": "merge" 或 "new", "target_topic_id": int, "confidence": 0-1, "reason": str}')


def classify(title: Column, texts: Column) -> Column:
    kinds = "；".join(f"{k}：{v}" for k, v in CATEGORIES.items())
    return _say(f"类别：{kinds}\n主题：", title, "\n报道：\n", F.array_join(F.slice(texts, 1, 5), "\n"), '\n只回答 JSON：{"category": str, "confidence": 0-1, "reason": str}')


def full_summary(title: Column, nodes: Column) -> Column:
    return _say("用 150 到 300 字概括主题：", title, "\n", F.array_join(nodes, "\n"), '\n只回答 JSON：{"summary": str, "key_points": [str]}')


def incremental_summary(title: Column, old: Column, nodes: Column) -> Column:
    return _say("主题：", title, "\n现有概括：", old, "\n新报道：\n", F.array_join(nodes, "\n"), '\n只回答 JSON：{"needs_update": bool, "updated_summary": str, "new_key_points": [str], "change_reason": str}')


def question(context: Column, history: Column, query: Column) -> Column:
    return _say("根据资料回答。\n资料：\n", context, "\n历史：\n", F.when(F.coalesce(history, F.lit("")) == "", "（无）").otherwise(history), "\n问：", query, "\n答：")
