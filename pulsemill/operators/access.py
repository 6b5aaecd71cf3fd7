"""Invite codes and access tokens of the free mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_invites(invites: DataFrame, as_of: Column, ttl_days: int = 7) -> DataFrame:
    """Why each invite can't be used; `ok` where it can."""
    expired = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    old = F.col("expires_at").isNull() & (F.col("created_at") + F.make_dt_interval(days=F.lit(ttl_days)) < as_of)
    used = F.col("used_count") >= F.col("max_uses")
    reason = F.when(F.trim("code") == "", "empty").when(F.col("status") != "active", "inactive").when(expired | old, "expired").when(used, "used_up").otherwise("ok")
    return invites.withColumn("verdict", reason)


def check_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    gone = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    return tokens.withColumn("verdict", F.when(F.col("revoked"), "revoked").when(gone, "expired").otherwise("ok"))


def redeem(invites: DataFrame, asked: DataFrame, as_of: Column, hours: int = 168, ttl_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(invites after use, tokens issued) for asked (code, token): a code, trimmed, that can be used is used once for each
    token, up to its limit in the order of the tokens; a token is good for these hours."""
    ok = check_invites(invites, as_of, ttl_days).where("verdict = 'ok'").select("id", F.trim("code").alias("code"), (F.col("max_uses") - F.col("used_count")).alias("__left"))
    a = asked.select(F.trim("code").alias("code"), "token").join(ok, "code")
    a = a.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy("token"))).where("__k <= __left")
    tokens = a.select("token", F.col("id").alias("invite_id"), as_of.alias("created_at"), (as_of + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"))
    used = a.groupBy("id").agg(F.count("*").alias("__n"))
    after = invites.join(used, "id", "left").withColumn("used_count", F.col("used_count") + F.coalesce("__n", F.lit(0)))
    return after.select(*invites.columns), tokens
