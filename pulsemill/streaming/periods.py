"""A stream that knows when a period is over: items wait in their period until event time has passed its end by `late_by`, then
the period is merged once and closed; items of a closed period are late and go to a table of their own.

State is kept by period in the store (`closed_periods`, and the items that wait in their partition), the clock in `stream_progress`:
the newest item that each micro-batch had seen. A batch judges lateness by the clock of the batches before it, so one that fails and
is repeated judges as it did; its writes replace rows by key, and merging a period again changes nothing."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.storage import Store
from . import pipeline

LATE_BY = timedelta(hours=2)


def period_end(period: str) -> datetime:
    """When a period's items have all been written, by its label."""
    day, _, slot = period.partition("_")
    return datetime.strptime(day, "%Y-%m-%d") + timedelta(hours={name: hour for hour, name in K.PERIODS}[slot])


def clock(store: Store, before_epoch: int | None = None) -> datetime | None:
    """The newest item's time that batches (before this one) have seen."""
    if not store.exists("stream_progress"):
        return None
    rows = store.read("stream_progress")
    rows = rows if before_epoch is None else rows.where(F.col("epoch") < before_epoch)
    return rows.agg(F.max("newest")).first()[0]


def closed(store: Store) -> set[str]:
    """Periods that are closed: four a day."""
    return {r["period"] for r in store.read("closed_periods").select("period").collect()} if store.exists("closed_periods") else set()


def take(spark: SparkSession, store: Store, rows: DataFrame, epoch: int, late_by: timedelta = LATE_BY) -> dict[str, list[str]]:
    """One micro-batch: late items are put aside, the others wait in their period, and periods whose time is over are merged and
    closed. Returns the periods that were closed."""
    newest = clock(store, epoch)
    periods = [r[0] for r in rows.select("period").distinct().collect()]  # those of a few runs
    over = [p for p in periods if newest is not None and period_end(p) <= newest - late_by]
    late, fresh = rows.where(F.col("period").isin(over)), rows.where(~F.col("period").isin(over))
    if over:
        store.upsert("late_items", late.dropDuplicates(["id"]))
    if len(over) < len(periods):
        known = fresh.join(store.read("items", sorted(set(periods) - set(over))).select("id"), "id", "left_anti") if store.exists("items") else fresh
        store.append("items", known.dropDuplicates(["id"]))
    seen = rows.agg(F.max("fetched_at")).first()[0]
    now = max((t for t in (newest, seen) if t is not None), default=None)
    store.upsert("stream_progress", spark.createDataFrame([(epoch, now)], "epoch long, newest timestamp_ntz"))
    return {"late": sorted(over), "closed": [] if now is None else close(spark, store, now - late_by, epoch)}


def close(spark: SparkSession, store: Store, until: datetime | None = None, epoch: int = -1) -> list[str]:
    """Merges and closes the open periods that ended by then (without a time: all), oldest first."""
    done, out = closed(store), []
    for p in sorted(set(store.partitions("items")) - done if store.exists("items") else (), key=pipeline.period_key):
        if until is None or period_end(p) <= until:
            log = pipeline.run_period(spark, store, p)
            while log["left"]:
                log = pipeline.run_period(spark, store, p)
            items = store.read("items", [p]).count()
            store.upsert("closed_periods", spark.createDataFrame([(p, epoch, items)], "period string, epoch long, items long"))
            out.append(p)
    return out


def readmit(store: Store, periods: list[str]) -> int:
    """Late items of these periods become waiting items after all, and the periods open again; how many items."""
    late = store.read("late_items", periods)
    n = late.count()
    if n:
        store.upsert("items", late)
        store.delete("closed_periods", late.select("period").distinct())
        store.delete("late_items", late.select("id"))
    return n


def start(spark: SparkSession, store: Store, path: str, schema: str, checkpoint: str, late_by: timedelta = LATE_BY, files: int = 1000):
    """A stream over item files, `files` in a micro-batch at most. Runs on what is there; close() ends what then is open."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.writeStream.foreachBatch(lambda df, epoch: take(spark, store, df, epoch, late_by) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
