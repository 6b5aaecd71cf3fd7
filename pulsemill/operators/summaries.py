"""Summaries of topics: a full one first, then updates when enough is new, a placeholder where the model fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonx, prompts, text
from ..functions.timex import hours_between
from ..providers import embed, judge_batch
from ..sources.storage import Store, checkpointed
from . import topics as T


def due(topics: DataFrame, nodes: DataFrame, summaries: DataFrame, as_of: Column) -> DataFrame:
    """topics (topic_id, title) with old (the newest summary's text), new_nodes and mode: full where there is no summary,
    incremental where enough nodes came since the newest one and it is old enough, else keep. nodes: topic_id, id, appended_at."""
    newest = T.newest_summary(summaries).select("topic_id", F.col("content").alias("old"), F.col("generated_at").alias("__g"))
    t = topics.select("topic_id", "title").join(newest, "topic_id", "left")
    new = nodes.select("topic_id", "appended_at").join(newest.select("topic_id", "__g"), "topic_id").where("appended_at > __g").groupBy("topic_id").agg(F.count("*").alias("__n"))
    t = t.join(new, "topic_id", "left").withColumn("new_nodes", F.coalesce("__n", F.lit(0)))
    ready = (F.col("new_nodes") >= K.SUMMARY_NODES) & (hours_between(F.col("__g"), as_of) >= K.SUMMARY_HOURS)
    return t.select("topic_id", "title", "old", "new_nodes", F.when(F.col("__g").isNull(), "full").when(ready, "incremental").otherwise("keep").alias("mode"))


def placeholder(title: Column) -> Column:
    # What readers see until there is a summary.
    return F.concat(F.lit("事件「"), title, F.lit("」的摘要正在生成中..."))


def resolved(answers: DataFrame) -> DataFrame:
    """answers (topic_id, title, mode, answer, status) as new summaries (topic_id, content, method). A failed or empty full
    one becomes a placeholder; an update that fails, says nothing or isn't needed leaves the old one as it is."""
    a, ok = F.col("answer"), F.col("status") == "success"
    row = lambda content, method: F.struct(content.alias("content"), method.alias("method"))
    said = lambda c: text.let(F.nullif(c, F.lit("")), lambda x: F.when(x.isNotNull(), row(x, F.col("mode"))))
    whole = F.when(ok, said(text.strip(jsonx.summary_field(a))))
    change = F.when(ok, text.let(jsonx.incremental_struct(a), lambda u: F.when(u["needs"], said(F.trim(u["summary"])))))
    new = F.when(F.col("mode") == "full", F.coalesce(whole, row(placeholder(F.col("title")), F.lit("placeholder")))).otherwise(change)
    # a generator, because a filter would be pushed below and read each answer again
    return answers.select("topic_id", F.inline(F.filter(F.array(new), lambda r: r["content"].isNotNull())))


def refresh(topics: DataFrame, nodes: DataFrame, summaries: DataFrame, as_of: Column, provider: str = "stub", record: Callable[[DataFrame], None] | None = None, **options) -> DataFrame:
    """New summaries (topic_id, content, method, generated_at) of the topics that are due. nodes also have a text, of which
    the key nodes' go into the prompt: 15 at most for each topic. record gets the model's answers, which are kept, so that a model is asked once."""
    t = due(topics, nodes, summaries, as_of).where("mode <> 'keep'")
    said = F.sort_array(F.collect_list(F.struct("pos", "text")))
    key = T.key_nodes(nodes.join(t.select("topic_id"), "topic_id", "left_semi")).groupBy("topic_id").agg(F.transform(said, lambda s: s["text"]).alias("texts"))
    t = t.join(key, "topic_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    prompt = F.when(F.col("mode") == "full", prompts.full_summary(F.col("title"), F.col("texts"))).otherwise(prompts.incremental_summary(F.col("title"), F.col("old"), F.col("texts")))
    answers = judge_batch(t.select("topic_id", "title", "mode", prompt.alias("prompt")), "prompt", provider, **options)
    if record is not None:
        answers = checkpointed(answers)
        record(answers)
    return resolved(answers).withColumn("generated_at", as_of)


def vectors_of(summaries: DataFrame) -> DataFrame:
    """Rows for the vector table of summaries (id, topic_id, content, generated_at)."""
    e = embed(summaries, "content")
    return e.select("id", F.lit("topic_summary").alias("object_type"), "topic_id", "generated_at", "x")


def judgements(answers: DataFrame, kind: str, target: str, as_of: Column) -> DataFrame:
    """What was asked and answered, for audits: one row for each answer of judge_batch."""
    tokens = lambda c: text.token_estimate(F.coalesce(F.col(c), F.lit("")))
    return answers.select(
        F.lit(kind).alias("kind"), F.col(target).cast("bigint").alias("target_id"), "status", F.col("prompt").alias("request"), F.col("answer").alias("response"),
        tokens("prompt").alias("tokens_prompt"), tokens("answer").alias("tokens_completion"), as_of.alias("created_at"),
    )


def recorder(store: Store, kind: str, as_of: Column, provider: str = "stub", target: str = "topic_id") -> Callable[[DataFrame], None]:
    """What writes answers to the store's judgements; the same answer of the same time again takes its own place."""

    def put(answers: DataFrame) -> None:
        rows = judgements(answers, kind, target, as_of.cast("timestamp_ntz")).withColumn("provider", F.lit(provider))
        store.upsert("judgements", rows.withColumn("id", F.sha1(F.concat_ws(":", "kind", F.col("target_id").cast("string"), F.col("created_at").cast("string"), "request"))))

    return put
