"""Which category a topic belongs to: by rules, by a model where rules don't tell, by default where there is nothing to read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonx, prompts, text
from ..providers import judge_batch
from ..sources.storage import checkpointed
from . import topics as T

# What a topic without nodes, or with an unusable answer, gets; and the confidence from which rules decide.
DEFAULT, DEFAULT_CONFIDENCE, RULE_DECIDES = "current_affairs", 0.3, 0.6


def topic_texts(items: DataFrame, most: int = 20) -> DataFrame:
    """(topic_id, texts, on_hupu): titles and summaries of each topic's newest items, newest first."""
    n = T.latest(items, "topic_id", [F.desc("fetched_at"), F.desc("id")], most)
    said = F.struct("rn", F.concat_ws(" ", "title", F.nullif("summary", F.lit(""))).alias("t"))
    return n.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(said)), lambda s: s["t"]).alias("texts"), F.max(F.col("platform") == "hupu").alias("on_hupu"))


def by_rule(topics: DataFrame, items: DataFrame, force_model: bool = False) -> DataFrame:
    """topics (topic_id, title) with texts, category, confidence and method: rule, default, or null where a model is to be asked."""
    t = topics.select("topic_id", "title").join(topic_texts(items), "topic_id", "left").withColumn("__t", F.array_join("texts", " "))
    category, confidence = text.rule_category(F.col("__t"), F.col("on_hupu"))
    none, told = F.col("texts").isNull(), (confidence >= RULE_DECIDES) & F.lit(not force_model)
    return t.select(
        "topic_id", "title", "texts", F.when(none, DEFAULT).when(told, category).alias("category"),
        F.when(none, DEFAULT_CONFIDENCE).when(told, confidence).alias("confidence"), F.when(none, "default").when(told, "rule").alias("method"),
    )


def asked(rows: DataFrame, provider: str = "stub", **options) -> DataFrame:
    """rows of by_rule, each asked of a model: topic_id, prompt, answer, status."""
    return judge_batch(rows.select("topic_id", prompts.classify(F.col("title"), F.slice("texts", 1, 10)).alias("prompt")), "prompt", provider, **options)


def told(answers: DataFrame) -> DataFrame:
    """What the answers say; failures and answers that name no category get the default."""
    category, confidence = jsonx.category_answer(text.after_think(F.col("answer")), list(K.CATEGORIES))
    ok = (F.col("status") == "success") & category.isNotNull()
    return answers.select("topic_id", F.when(ok, category).otherwise(DEFAULT).alias("category"), F.when(ok, confidence).otherwise(DEFAULT_CONFIDENCE).alias("confidence"), F.lit("llm").alias("method"))


def by_model(rows: DataFrame, provider: str = "stub", **options) -> DataFrame:
    return told(asked(rows, provider, **options))


def classify(topics: DataFrame, items: DataFrame, provider: str = "stub", force_model: bool = False, record: Callable[[DataFrame], None] | None = None, **options) -> DataFrame:
    """(topic_id, category, confidence, method) of each topic. Only topics that rules leave open go to the model; record gets
    its answers, which are kept, so that a model is asked once."""
    t = by_rule(topics, items, force_model)
    sure = t.where("method IS NOT NULL").select("topic_id", "category", "confidence", "method")
    answers = asked(t.where("method IS NULL"), provider, **options)
    if record is not None:
        answers = checkpointed(answers)
        record(answers)
    return sure.unionByName(told(answers))


def unclassified(topics: DataFrame) -> DataFrame:
    return topics.where((F.coalesce("category", F.lit("")) == "") & (F.col("status") == "active"))
