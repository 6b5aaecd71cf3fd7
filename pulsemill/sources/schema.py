"""The store's tables: columns that are declared and enforced on every write, keys, and how each is cut into partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partitions of tables that have no time of their own: buckets by the hash of a key.
BUCKETS = 64


def bucket(key: str, n: int = BUCKETS) -> str:
    return f"pmod(xxhash64({key}), {n})"


@dataclass(frozen=True)
class Table:
    """ddl: declared columns; others may be written besides. partition: an SQL expression, whose value is the row's partition;
    rows with one key always have the same. Without it, the table is one partition."""

    ddl: str = ""
    keys: tuple[str, ...] = ()
    partition: str | None = None

    def columns(self) -> list[T.StructField]:
        return list(T.StructType.fromDDL(self.ddl)) if self.ddl else []

    def part(self) -> Column:
        """The partition's name as text; null has one of its own."""
        if self.partition is None:
            return F.lit("all")
        return F.coalesce(F.concat(F.lit("v"), F.expr(self.partition).cast("string")), F.lit("null"))

    def typed(self, keys: DataFrame) -> DataFrame:
        """keys in the declared types, on which partitions depend."""
        kinds = {f.name: f.dataType for f in self.columns()}
        return keys.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in keys.columns])

    def checked(self, df: DataFrame) -> DataFrame:
        """df with the declared columns in their types. One that is missing is null, or an error if it is declared NOT NULL; so
        is a null in it, when the rows are written."""
        own = {c.lower(): c for c in df.columns}
        out = []
        for f in self.columns():
            if f.name.lower() not in own and not f.nullable:
                raise ValueError(f"column {f.name} is missing")
            c = F.col(f"`{own[f.name.lower()]}`") if f.name.lower() in own else F.lit(None)
            if f.name.lower() not in own or df.schema[own[f.name.lower()]].dataType != f.dataType:
                c = c.cast(f.dataType)
            if not f.nullable:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"column {f.name} may not be null"))).otherwise(c)
            out.append(c.alias(f.name))
        declared = {f.name.lower() for f in self.columns()}
        return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c.lower() not in declared])


TABLES = {
    "items": Table("id long NOT NULL, period string NOT NULL, platform string, title string, summary string, heat_value double, fetched_at timestamp_ntz, merge_status string, group_id string, heat_normalized double", ("id",), "period"),
    "placements": Table(
        "item_id long NOT NULL, period string NOT NULL, group_id string NOT NULL, topic_id long NOT NULL, seq long NOT NULL, fetched_at timestamp_ntz, heat_normalized double, title string, x array<double>", ("item_id",), "period"
    ),
    "nodes": Table("topic_id long NOT NULL, item_id long NOT NULL, appended_at timestamp_ntz, period string, heat_normalized double", ("item_id",), "period"),
    "period_heat": Table("topic_id long NOT NULL, period string NOT NULL, heat double, source_count long, first_seen timestamp_ntz, last_active timestamp_ntz", ("topic_id", "period"), "period"),
    "topics": Table(
        "topic_id long NOT NULL, title string, first_seen timestamp_ntz, last_active timestamp_ntz, intensity_total long, heat double, status string NOT NULL, x array<double>, imported_total long", ("topic_id",), bucket("topic_id")
    ),
    "topic_categories": Table("topic_id long NOT NULL, category string, confidence double, method string", ("topic_id",), bucket("topic_id")),
    "topic_item_view": Table("topic_id long NOT NULL", ("topic_id", "item_id"), bucket("topic_id")),
    "topic_stats": Table("topic_id long NOT NULL, node_count long", ("topic_id",), bucket("topic_id")),
    "topic_changes": Table("topic_id long NOT NULL, period string NOT NULL, changed_at timestamp_ntz", ("topic_id", "period"), "period"),
    "summaries": Table("id long NOT NULL, topic_id long NOT NULL, content string, method string, generated_at timestamp_ntz", ("id",), "date_format(generated_at, 'yyyy-MM-dd')"),
    "summary_vectors": Table("id long NOT NULL", ("id",), bucket("id")),
    "index_vectors": Table("object_type string NOT NULL, id long NOT NULL, topic_id long, x array<double>, cell int NOT NULL", ("object_type", "id"), "concat(object_type, '-', cell)"),
    "index_cells": Table("object_type string NOT NULL, cell int NOT NULL, n long, radius double, reach double", ("object_type", "cell"), "object_type"),
    "index_centres": Table("cell int NOT NULL, centre array<double>, length double", ("cell",)),
    "judgements": Table(
        "id string NOT NULL, kind string NOT NULL, target_id long, status string, request string, response string, tokens_prompt long, tokens_completion long, created_at timestamp_ntz, provider string",
        ("id",), "date_format(created_at, 'yyyy-MM-dd')",
    ),
    "category_days": Table("day string NOT NULL, category string", ("day", "category"), "day"),
    "runs": Table("run_id string NOT NULL, period string, stage string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, counters string, error string", ("run_id",), "substring(period, 1, 10)"),
    "late_items": Table("id long NOT NULL, period string NOT NULL", ("id",), "period"),
    "stream_progress": Table("epoch long NOT NULL, newest timestamp_ntz", ("epoch",)),
    "closed_periods": Table("period string NOT NULL, epoch long, items long", ("period",)),
    "system_config": Table("key string NOT NULL, value string, updated_at timestamp_ntz", ("key",)),
}
