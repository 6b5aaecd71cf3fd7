"""Context for questions: token counts, greedy packing, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTEXT_LIMIT, CONTEXT_SAFETY
from ..functions.text import followup, footer_tool, strip, token_estimate


def available_tokens(prompt, query, completion):
    return F.greatest(F.lit(0), F.lit(CONTEXT_LIMIT - CONTEXT_SAFETY) - prompt - query - completion)


def pack_context(chunks: DataFrame, by: str, pos: str, text: str, budget: int) -> DataFrame:
    """Whole chunks of each group while they fit, then one cut chunk with an ellipsis, then none."""
    w = Window.partitionBy(by).orderBy(pos)
    c = chunks.withColumn("tokens", token_estimate(F.col(text)))
    c = c.withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("upto") - F.col("tokens"))
    n = F.floor(F.length(text) * (left / F.col("tokens")) * 0.9).cast("int")
    c = c.where(left > 0).withColumn("cut", F.col("upto") > budget)
    return c.withColumn("packed", F.when(F.col("cut"), F.concat(F.substring(F.col(text), F.lit(1), n), F.lit("..."))).otherwise(F.col(text)))


def message_tokens(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg((F.sum(token_estimate(F.col("text")) + 4) + 3).alias("tokens"))


def history_text(messages: DataFrame, turns: int = 8) -> DataFrame:
    """The last turns of each conversation as one text. Blank ones count as turns but have no line."""
    last = messages.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("rn") <= turns)
    said = F.trim(F.coalesce("text", F.lit("")))
    speaker = F.when(F.lower(F.trim("role")) == "assistant", "助手").otherwise("用户")
    line = F.when(said != "", F.concat(speaker, F.lit("："), said))
    made = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("turn", line.alias("line")))))
    lines = F.array_join(F.transform(made, lambda x: x["line"]), "\n")
    return last.groupBy("conv_id").agg(F.when(lines != "", lines).otherwise("（无）").alias("history"))


def last_tool(messages: DataFrame) -> DataFrame:
    """conv_id, last_tool: that of the newest answer whose footer names one; empty without such an answer."""
    tool = F.when(F.lower("role") == "assistant", footer_tool(F.coalesce("text", F.lit("")))).otherwise("")
    newest = F.max_by(F.when(tool != "", tool), F.when(tool != "", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(newest, F.lit("")).alias("last_tool"))


def last_user_query(messages: DataFrame) -> DataFrame:
    return messages.where((F.col("role") == "user") & (F.trim("text") != "")).groupBy("conv_id").agg(F.max_by(F.trim("text"), "turn").alias("query"))


def followups(messages: DataFrame) -> DataFrame:
    """For each conversation that ends with a user's turns, its newest one as a question: conv_id, question, resolved (with the user's question
    before it, where it only refines that one), all_time, recent_days, refine_only and last_tool. messages: conv_id, turn, role, text."""
    said = messages.where((F.col("role") == "user") & (strip(F.col("text")) != ""))
    asked = said.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("q")).select("conv_id", F.col("q.turn").alias("at"), strip(F.col("q.text")).alias("question"))
    history = messages.join(asked.select("conv_id", "at"), "conv_id").where("turn < at").drop("at")
    f = followup(F.col("question"))
    out = asked.join(last_user_query(history), "conv_id", "left").join(last_tool(history), "conv_id", "left").withColumns(f)
    resolved = F.when(F.col("refine_only") & F.col("query").isNotNull(), F.concat_ws(" ", "query", "question")).otherwise(F.col("question"))
    return out.select("conv_id", "question", resolved.alias("resolved"), "all_time", "recent_days", "refine_only", F.coalesce("last_tool", F.lit("")).alias("last_tool"))
