"""The partition-wise store, and merge runs that fail anywhere in between."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsemill.sources.schema import Table
from pulsemill.sources.storage import Conflict, Store, cascade
from pulsemill.streaming import pipeline, upkeep

from .test_operators import some_items

AM, PM, DAY = "2024-01-01_AM", "2024-01-01_PM", {"t": Table("k long NOT NULL, v string, day string", ("k",), "day")}


def rows_of(store, name="t"):
    return sorted(map(tuple, store.read(name).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, day string")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), DAY)
    s.append("t", table(spark, [(1, "a", "d1"), (2, "b", "d2"), (3, "c", None), (4, "d", "d:3/x"), (5, "e", "")]))
    return s


def test_only_touched_partitions_are_written(spark, store):
    before = store.manifest("t")["parts"]
    assert store.partitions("t") == ["", "d1", "d2", "d:3/x", "null"]
    store.upsert("t", table(spark, [(2, "B", "d2"), (6, "f", "d2"), (7, "g", "d4")]))
    after = store.manifest("t")["parts"]
    assert {p for p in after if after[p] != before.get(p)} == {"vd2", "vd4"}
    store.replace_days("t", table(spark, [(8, "h", "d1")]))
    assert store.delete("t", spark.createDataFrame([(4,), (99,)], "k long")) == 1
    last = store.manifest("t")["parts"]
    assert last["vd2"] == after["vd2"] and last["null"] == before["null"] and "vd:3/x" not in last
    assert rows_of(store) == sorted([(2, "B", "d2"), (6, "f", "d2"), (7, "g", "d4"), (8, "h", "d1"), (3, "c", None), (5, "e", "")], key=repr)
    assert [tuple(r) for r in store.read("t", ["d1"]).collect()] == [(8, "h", "d1")] and store.read("t", ["none"]).count() == 0
    assert [tuple(r) for r in store.read_keys("t", spark.createDataFrame([("d4",)], "day string")).collect()] == [(7, "g", "d4")]
    store.replace_parts("t", table(spark, []), ["d4"])
    assert "d4" not in store.partitions("t")
    store.clear("t")
    assert rows_of(store) == [] and store.read("t").columns == ["k", "v", "day"]


def test_schema_is_enforced(spark, store):
    with pytest.raises(ValueError, match="k is missing"):
        store.append("t", spark.createDataFrame([("x",)], "v string"))
    with pytest.raises(Exception, match="may not be null"):
        store.append("t", table(spark, [(None, "x", "d1")]))
    store.append("t", spark.createDataFrame([("9", 1.5)], "k string, more double"))
    assert store.read("t").dtypes == [("k", "bigint"), ("v", "string"), ("day", "string"), ("more", "double")]
    assert tuple(store.read("t", ["null"]).where("k = 9").first()) == (9, None, None, 1.5)
    with pytest.raises(ValueError, match="more is double, not string"):
        store.append("t", spark.createDataFrame([(9, "x")], "k long, more string"))
    assert store.read("t").count() == 6


def test_rows_by_bucket(spark, tmp_path):
    """Buckets depend on declared types, whatever type keys come in; rows of keys are replaced, also by none."""
    s = Store(spark, str(tmp_path / "b"), {"t": Table("k long NOT NULL, v string", ("k",), "pmod(xxhash64(k), 8)")})
    s.append("t", spark.range(40).selectExpr("CAST(id AS int) AS k", "CAST(id AS string) AS v"))
    keys = spark.createDataFrame([(3,), (5,), (99,)], "k int")
    assert sorted(r.k for r in s.read_keys("t", keys).collect()) == [3, 5]
    before = s.manifest("t")["parts"]
    s.replace_rows("t", spark.createDataFrame([(5, "new")], "k int, v string"), keys)
    after = s.manifest("t")["parts"]
    assert {r.k: r.v for r in s.read("t").collect()} == {k: "new" if k == 5 else str(k) for k in range(40) if k != 3}
    assert 1 <= len({p for p in after if after[p] != before[p]}) <= 3


def test_writers_at_the_same_time(spark, store, tmp_path):
    """Appends and writes to other partitions are published on top; a changed partition is a conflict, and nothing is lost."""
    other = Store(spark, str(tmp_path / "t"), DAY)

    class Slow(Store):
        between = None

        def _publish(self, *a, **b):
            if Slow.between:
                act, Slow.between = Slow.between, None
                act()
            super()._publish(*a, **b)

    slow = Slow(spark, str(tmp_path / "t"), DAY)
    Slow.between = lambda: other.append("t", table(spark, [(20, "x", "d1")]))
    slow.append("t", table(spark, [(21, "y", "d1")]))
    Slow.between = lambda: other.upsert("t", table(spark, [(22, "z", "d9")]))
    slow.upsert("t", table(spark, [(2, "new", "d2")]))
    assert {r[0]: r[1] for r in rows_of(store)} == {1: "a", 2: "new", 3: "c", 4: "d", 5: "e", 20: "x", 21: "y", 22: "z"}
    Slow.between = lambda: other.append("t", table(spark, [(23, "w", "d2")]))
    with pytest.raises(Conflict):
        slow.upsert("t", table(spark, [(2, "lost", "d2")]))
    assert {r[0]: r[1] for r in rows_of(store)}[2] == "new" and 23 in {r[0] for r in rows_of(store)}


def test_old_snapshots_go(spark, store):
    reader = store.read("t")
    for k in range(Store.KEPT - 1):
        store.upsert("t", table(spark, [(2, f"v{k}", "d2")]))
    assert reader.count() == 5 and {r.k: r.v for r in reader.collect()}[2] == "b"  # a snapshot that is still kept
    for k in range(3):
        store.upsert("t", table(spark, [(2, f"w{k}", "d2")]))
    named = {f.split("/")[0] for n in store._numbers("t") for folders in store._load("t", n)["parts"].values() for f in folders}
    assert len(store._numbers("t")) == Store.KEPT and {r[0]: r[1] for r in rows_of(store)}[2] == "w2"
    store._write("t", table(spark, [(1, "lost", "d1")]))  # a write that was never published
    assert len(store.vacuum("t")) >= 1 and set(store._names(f"{store.root}/t")) == named | {"manifests"}


# ------------------------------------------------------------------ merge runs

ANGLES = {"a": 0.0, "n": np.arccos(0.8), "l": np.arccos(0.8) + np.arccos(0.9)}


def chained(df, text, out="x", dim=2):
    """Vectors of titles: the second event is like the first (0.8) and more like the third (0.9), these two aren't alike."""

    @F.pandas_udf("array<double>")
    def vectors(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(np.cos(ANGLES[t[0]])), float(np.sin(ANGLES[t[0]]))])

    return df.withColumn(out, vectors(F.col(text)))


def three_events(spark):
    rows = some_items(spark, AM, "2024-01-01 11:00:00", 1)
    return rows.unionByName(rows.where("id = 5").withColumn("id", F.lit(6).cast("long")))


class Fails(Store):
    """Fails at its n-th snapshot."""

    left = 0

    def _publish(self, *a, **b):
        Fails.left -= 1
        if Fails.left == 0:
            raise OSError("lost")
        super()._publish(*a, **b)


STATE = ("topics", "nodes", "period_heat", "items", "placements", "judgements")


def dump(store):
    return {n: sorted(repr(sorted(r.asDict().items())) for r in store.read(n).collect()) for n in STATE}


@pytest.mark.parametrize("failing", range(1, 10))
def test_a_failed_run_is_repeated_without_a_trace(spark, tmp_path, monkeypatch, failing):
    monkeypatch.setattr(pipeline, "embed", chained)
    whole, broken = Store(spark, str(tmp_path / "whole")), str(tmp_path / "broken")
    for s in (whole, Store(spark, broken)):
        s.append("items", three_events(spark))
    pipeline.run_period(spark, whole, AM)
    Fails.left = failing
    with pytest.raises(OSError):
        pipeline.run_period(spark, Fails(spark, broken), AM)
    Fails.left = 0
    pipeline.run_period(spark, Store(spark, broken), AM)
    assert dump(Store(spark, broken)) == dump(whole)
    topics = {r.topic_id: r.intensity_total for r in whole.read("topics").collect()}
    assert topics == {1: 4, 5: 2} and whole.read("nodes").groupBy("item_id").count().where("count > 1").count() == 0


def test_ended_and_old_topics_take_nothing(spark, tmp_path):
    """An event is merged into an active topic with activity in the last 180 days only; what a topic brought along is kept."""
    store = Store(spark, str(tmp_path / "s"))
    pipeline.run_period(spark, first := _filled(spark, tmp_path / "x"), AM)
    x = {r.topic_id: r.x for r in first.read("topics").collect()}
    old = [(90, "ended", datetime(2024, 1, 1), datetime(2024, 1, 1), 7, 0.1, "ended", x[1]), (91, "old", datetime(2020, 1, 1), datetime(2020, 2, 1), 3, 0.1, "active", x[1]), (92, "open", datetime(2023, 12, 1), datetime(2023, 12, 31), 5, 0.9, "active", x[3])]
    store.append("topics", spark.createDataFrame(old, "topic_id long, title string, first_seen timestamp_ntz, last_active timestamp_ntz, intensity_total long, heat double, status string, x array<double>"))
    store.append("items", some_items(spark, AM, "2024-01-01 11:00:00", 1))
    pipeline.run_period(spark, store, AM)
    got = {r.topic_id: (r.intensity_total, r.status, str(r.last_active)) for r in store.read("topics").collect()}
    assert got == {1: (2, "active", "2024-01-01 11:00:00"), 90: (7, "ended", "2024-01-01 00:00:00"), 91: (3, "active", "2020-02-01 00:00:00"), 92: (7, "active", "2024-01-01 11:00:00")}
    pipeline.settle(spark, store, AM)
    assert {r.topic_id: r.intensity_total for r in store.read("topics").collect()} == {k: v[0] for k, v in got.items()}


def _filled(spark, path):
    store = Store(spark, str(path))
    store.append("items", some_items(spark, AM, "2024-01-01 11:00:00", 1))
    return store


def test_a_period_reads_and_writes_itself(spark, tmp_path):
    """Files of other periods keep their names, and are not read but for topics' earlier heat."""
    store = _filled(spark, tmp_path / "s")
    pipeline.run_period(spark, store, AM)
    before = {n: store.manifest(n)["parts"][f"v{AM}"] for n in ("items", "nodes", "period_heat", "placements", "topic_changes")}
    store.append("items", some_items(spark, PM, "2024-01-01 15:00:00", 11))
    read = []

    class Watched(Store):
        def _read(self, name, manifest, parts=None):
            read.append((name, sorted(manifest["parts"] if parts is None else parts)))
            return super()._read(name, manifest, parts)

    pipeline.run_events(spark, w := Watched(spark, store.root), PM)
    pipeline.run_topics(spark, w, PM)
    assert {n: store.manifest(n)["parts"][f"v{AM}"] for n in before} == before
    assert {tuple(p) for n, p in read if n in ("items", "nodes", "placements")} == {(f"v{PM}",)}
    assert {r.topic_id: r.intensity_total for r in store.read("topics").collect()} == {1: 4, 3: 4}


def test_a_run_places_at_most_so_many_groups(spark, tmp_path):
    """What is over the cap waits for the next run, as it is; draining goes on until none waits."""
    store = _filled(spark, tmp_path / "s")
    log = pipeline.run_period(spark, store, AM, most=1)
    assert (log["groups"], log["left"], log["topics"]) == (2, 1, 1) and {r.topic_id for r in store.read("topics").collect()} == {1}
    assert upkeep.drain(spark, store) == 1 and upkeep.pending_periods(store) == []
    once = _filled(spark, tmp_path / "o")
    pipeline.run_period(spark, once, AM)
    assert dump(store) == dump(once)
    kinds = {(r.kind, r.target_id): r.response for r in store.read("judgements").collect()}
    assert set(kinds) == {("event_merge", 1), ("event_merge", 3), ("event_merge", 5), ("global_merge", 1), ("global_merge", 3)} and '"decision":"new","topic_id":1' in kinds["global_merge", 1]


def test_a_crowd_of_copies_makes_no_pairs(spark, monkeypatch):
    """Copies of a leader, of a member, and of one that the judge refuses are where they are without the shortcut."""
    titles = ["alpha star marries beta"] * 200 + ["alpha star marries beta today"] * 50 + ["new law on rivers passed"] * 3 + ["x"] * 4
    at = "2024-01-01 11:00:00"
    rows = [(k, AM, "weibo", t, "s", 1.0, at, "pending_event_merge") for k, t in enumerate(titles)]
    items = spark.createDataFrame(rows, "id long, period string, platform string, title string, summary string, heat_value double, fetched_at string, merge_status string")
    seen, inner = [], pipeline.cluster.jaccard_pairs
    monkeypatch.setattr(pipeline.cluster, "jaccard_pairs", lambda df, *a: seen.append(df.count()) or inner(df, *a))
    got = pipeline.merge_events(items).collect()
    assert seen == [7]  # three titles and four that are too short to be compared
    by_title = {t: {(r.leader, r.occurrence, r.merge_status) for r in got if r.title == t} for t in set(titles)}
    assert len(got) == len(titles) and by_title["new law on rivers passed"] == {(250, 3, "pending_global_merge")}
    assert by_title["alpha star marries beta"] == by_title["alpha star marries beta today"] == {(0, 250, "pending_global_merge")}
    assert by_title["x"] == {(k, 1, "discarded") for k in range(253, 257)}
    monkeypatch.setattr(pipeline, "same_event", lambda j, c: (F.lit(False), j))
    refused = {(r.leader, r.occurrence) for r in pipeline.merge_events(items).collect() if r.title.endswith("today")}
    assert refused == {(k, 1) for k in range(200, 250)}


def test_cascade(spark, tmp_path):
    """The dry run's counts are what the real run deletes, children included."""
    store = _filled(spark, tmp_path / "s")
    pipeline.run_period(spark, store, AM)
    upkeep.refresh(spark, store, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    had = {n: store.read(n).count() for n in ("items", "nodes", "topics", "summaries", "summary_vectors", "topic_item_view", "period_heat", "placements")}
    victims = {"topics": spark.createDataFrame([(1,)], "topic_id long"), "items": spark.createDataFrame([(3,), (77,)], "id long")}
    told = cascade(store, victims)
    assert {n: store.read(n).count() for n in had} == had
    assert cascade(store, victims, dry_run=False) == told
    assert {k: told[k] for k in ("topics", "items", "nodes", "summaries", "summary_vectors")} == {"topics": 1, "items": 1, "nodes": 3, "summaries": 1, "summary_vectors": 1}
    assert {n: store.read(n).count() for n in had} == {n: had[n] - told.get(n, 0) for n in had}
    assert sum(cascade(store, victims).values()) == 0
