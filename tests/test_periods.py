"""Periods that close by event time."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsemill.sources.storage import Store
from pulsemill.streaming import periods, pipeline

from .test_operators import ITEMS, some_items
from .test_store import AM, PM, dump

EVE = "2024-01-01_EVE"


def files(spark, folder):
    """Five files, one after the other: some of the morning, the afternoon, the rest of the morning out of order but in time, the
    evening, which ends both, and items of the morning that come too late."""
    am, pm, eve = some_items(spark, AM, "2024-01-01 11:00:00", 1), some_items(spark, PM, "2024-01-01 15:00:00", 11), some_items(spark, EVE, "2024-01-01 22:30:00", 21)
    parts = [am.where("id <= 2"), pm, am.where("id > 2"), eve, some_items(spark, AM, "2024-01-01 13:00:00", 31).where("id <= 32")]
    for k, rows in enumerate(parts):
        rows.coalesce(1).write.parquet(str(folder / f"w{k}"))
        (name,) = [f for f in os.listdir(folder / f"w{k}") if f.endswith(".parquet")]
        (folder / "in").mkdir(exist_ok=True)
        os.rename(folder / f"w{k}" / name, folder / "in" / f"{k}.parquet")
        os.utime(folder / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return am, pm, eve


def test_late_and_out_of_order_files_equal_the_batch(spark, tmp_path):
    am, pm, eve = files(spark, tmp_path)
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    periods.start(spark, a, str(tmp_path / "in"), ITEMS, str(tmp_path / "cp"), files=1).awaitTermination()
    assert periods.closed(a) == {AM, PM} and sorted(r.id for r in a.read("late_items").collect()) == [31, 32]
    assert periods.close(spark, a) == [EVE] and periods.close(spark, a) == []
    b.append("items", am.unionByName(pm).unionByName(eve))
    for p in (AM, PM, EVE):
        pipeline.run_period(spark, b, p)
    assert dump(a) == dump(b)
    assert {r.period: r["items"] for r in a.read("closed_periods").collect()} == {AM: 5, PM: 5, EVE: 5}
    assert periods.readmit(a, [AM]) == 2 and a.read("late_items").count() == 0 and periods.close(spark, a) == [AM]
    assert a.read("items", [AM]).count() == 7


def test_a_repeated_batch_judges_as_it_did(spark, tmp_path, monkeypatch):
    """The first attempt fails after its clock is written; the second isn't late by its own items."""
    store = Store(spark, str(tmp_path / "s"))
    rows = some_items(spark, AM, "2024-01-01 11:00:00", 1).unionByName(some_items(spark, EVE, "2024-01-01 23:00:00", 21))

    def lost(*a, **b):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(periods, "close", lost)
        with pytest.raises(OSError):
            periods.take(spark, store, rows, 0)
    assert periods.clock(store) == datetime(2024, 1, 1, 23) and periods.clock(store, 0) is None
    assert periods.take(spark, store, rows, 0) == {"late": [], "closed": [AM]}
    assert store.read("items").count() == 10 and not store.exists("late_items")
    assert periods.take(spark, store, rows.where(F.col("period") == AM), 1) == {"late": [AM], "closed": []}
    assert periods.take(spark, store, rows.limit(0), 2) == {"late": [], "closed": []}


def test_period_ends():
    assert periods.period_end(EVE) == datetime(2024, 1, 2) and periods.period_end("2024-01-01_MORN") == datetime(2024, 1, 1, 10)
    assert periods.LATE_BY == timedelta(hours=2)
