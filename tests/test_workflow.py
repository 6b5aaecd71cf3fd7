"""The work around a merge, from the store's tables: run log, draining, refreshing, questions, models that fail."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsemill import providers
from pulsemill.operators import agent, classify, metrics, search, summaries
from pulsemill.operators import topics as T
from pulsemill.sources import adapters as A
from pulsemill.sources.storage import Store
from pulsemill.streaming import pipeline, upkeep

from .test_operators import SF, some_items, state


def as_of():
    return F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")


class Fails(providers.StubChat):
    def complete(self, messages, **options):
        raise OSError("no answer")


def full_store(spark, path):
    store = Store(spark, str(path))
    store.append("items", some_items(spark, "2024-01-01_AM", "2024-01-01 11:00:00", 1).unionByName(some_items(spark, "2024-01-01_PM", "2024-01-01 15:00:00", 11)))
    return store


def test_drain_and_refresh(spark, tmp_path):
    store = full_store(spark, tmp_path / "s")
    assert upkeep.pending_periods(store) == ["2024-01-01_AM", "2024-01-01_PM"]
    assert upkeep.drain(spark, store) == 1 and upkeep.pending_periods(store) == [] and upkeep.drain(spark, store) == 0
    assert state(store) == [(1, 4, "2024-01-01 15:00:00"), (3, 4, "2024-01-01 15:00:00")]
    runs = store.read("runs").collect()
    assert sorted((r.period, r.status) for r in runs) == [("2024-01-01_AM", "success"), ("2024-01-01_PM", "success")] and all('"kept": 4' in r.counters for r in runs)
    assert sorted((r.topic_id, r.source_count) for r in store.read("period_heat").collect()) == [(1, 2), (1, 2), (3, 2), (3, 2)]
    want = dict.fromkeys(["timestamp", "peaks", "categories", "summaries", "stats", "view", "category_metrics"], "ok")
    assert upkeep.refresh(spark, store, as_of()) == want
    tables = {n: store.read(n).count() for n in ("topic_categories", "summaries", "summary_vectors", "topic_item_view", "category_days")}
    assert tables == {"topic_categories": 2, "summaries": 2, "summary_vectors": 2, "topic_item_view": 8, "category_days": 3}
    assert upkeep.refresh(spark, store, as_of()) == want and {n: store.read(n).count() for n in tables} == tables
    kinds = {r.kind: r["count"] for r in store.read("judgements").groupBy("kind").count().collect()}
    assert kinds == {"event_merge": 6, "global_merge": 4, "classify": 2, "summary": 2}
    peaks = store.read("period_heat").groupBy("topic_id").agg(F.max("heat").alias("p"))
    assert store.read("topics").join(peaks, "topic_id").where("abs(heat - p) > 1e-12").count() == 0


def test_refresh_of_changed_topics_equals_a_full_one(spark, tmp_path):
    """Three rounds of merging and refreshing leave what one full refresh leaves, and a round writes only rows of its topics."""
    step, whole = Store(spark, str(tmp_path / "step")), Store(spark, str(tmp_path / "whole"))
    titles = ["alpha star marries beta", "new law on rivers passed", "third thing entirely different", "xyz quiet words here now"]
    for k, (period, at) in enumerate([("2024-01-01_MORN", "2024-01-01 09:00:00"), ("2024-01-01_AM", "2024-01-01 11:00:00"), ("2024-01-01_PM", "2024-01-01 15:00:00")]):
        rows = [(100 * k + j, period, "weibo", titles[(k + j // 2) % 4], "s", float(j), "pending_event_merge", '{"like": %d}' % j) for j in range(4)]
        items = spark.createDataFrame(rows, "id long, period string, platform string, title string, summary string, heat_value double, merge_status string, interactions string").withColumn("fetched_at", F.lit(at).cast("timestamp_ntz"))
        for s in (step, whole):
            s.append("items", items)
            pipeline.run_period(spark, s, period)
        view = step.manifest("topic_item_view")["parts"]
        assert set(upkeep.refresh(spark, step, as_of()).values()) == {"ok"}
        changed = {p for p, f in step.manifest("topic_item_view")["parts"].items() if f != view.get(p)}
        buckets = spark.createDataFrame(step.read("topic_changes", [period]).select("topic_id").collect()).selectExpr("concat('v', pmod(xxhash64(topic_id), 64)) AS b")
        assert changed == {r.b for r in buckets.collect()}
    assert upkeep.changed_topics(step)[0].count() == 0
    assert set(upkeep.refresh(spark, whole, as_of(), full=True).values()) == {"ok"}
    for name in ("topic_item_view", "topic_categories", "topic_stats", "category_days", "topics", "summaries"):
        a, b = step.read(name), whole.read(name)
        leave = {"changed_at", "content", "method", "summary"}  # summaries are of the time they were written
        cols = [c for c in a.columns if c not in leave]
        assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect())), name
    assert step.read("system_config").where("key = 'last_merge_time'").first()["value"] == "2024-01-02 00:00:00"


def test_a_failed_stage_is_logged_and_others_run(spark, tmp_path):
    store = full_store(spark, tmp_path / "s")

    def bad():
        raise OSError("lost")

    with pytest.raises(OSError):
        upkeep.logged(spark, store, "2024-01-01_AM", "merge", bad)
    assert [(r.status, r.error) for r in store.read("runs").collect()] == [("failed", "lost")]
    done = upkeep.refresh(spark, store, as_of())  # there are no topics yet
    assert set(done) == {"timestamp", "peaks", "categories", "summaries", "stats", "view", "category_metrics"} and all(v != "ok" for v in done.values())


def test_a_second_run_of_a_period_adds_sources(spark, tmp_path):
    store = full_store(spark, tmp_path / "s")
    pipeline.run_period(spark, store, "2024-01-01_AM")
    store.append("items", some_items(spark, "2024-01-01_AM", "2024-01-01 11:30:00", 51))
    pipeline.run_period(spark, store, "2024-01-01_AM")
    assert sorted((r.topic_id, r.source_count) for r in store.read("period_heat").collect()) == [(1, 4), (3, 4)]


def test_schedule():
    assert upkeep.stages_due(datetime(2024, 1, 1, 12, 0), datetime(2024, 1, 1, 12, 30)) == ["merge_events", "merge_topics"]
    assert upkeep.stages_due(datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 1, 0)) == ["category_metrics"]


def test_classify_asks_a_model_only_where_rules_are_silent(spark, monkeypatch):
    topics = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "topic_id long, title string")
    items = spark.createDataFrame([(1, 1, "weibo", "演员离婚", None), (2, 2, "weibo", "plain", "")], "id long, topic_id long, platform string, title string, summary string").withColumn("fetched_at", as_of())
    got = {r.topic_id: tuple(r)[1:] for r in classify.classify(topics, items).collect()}
    assert got[1] == ("entertainment", 1.0, "rule") and got[3] == ("current_affairs", 0.3, "default") and got[2][2] == "llm"
    monkeypatch.setitem(providers.CHAT, "fails", Fails)
    failed = classify.by_model(classify.by_rule(topics, items).where("topic_id = 2").withColumn("title", F.lit("x")), "openai", base_url="http://127.0.0.1:9", model="m", timeout=1)
    assert [tuple(r) for r in failed.collect()] == [(2, "current_affairs", 0.3, "llm")]
    forced = classify.by_rule(topics, items, force_model=True)
    assert {r.topic_id: r.method for r in forced.collect()} == {1: None, 2: None, 3: "default"}


def test_summary_of_a_failing_model_is_a_placeholder_and_an_update_keeps_the_old_one(spark):
    rows = [(1, "t", "full", "x", "failed"), (2, "t", "full", '{"summary": "s"}', "success"), (3, "t", "incremental", '{"needs_update": false, "updated_summary": "u"}', "success"), (4, "t", "incremental", '{"updated_summary": "u"}', "success"), (5, "t", "incremental", "error", "failed")]
    got = summaries.resolved(spark.createDataFrame(rows, "topic_id long, title string, mode string, answer string, status string"))
    assert {r.topic_id: (r.content, r.method) for r in got.collect()} == {1: ("事件「t」的摘要正在生成中...", "placeholder"), 2: ("s", "full"), 4: ("u", "incremental")}


def test_agent_runs_its_plan(spark):
    t, s, i, v = A.topics(spark, SF), A.summaries(spark, SF), A.items_titled(spark, SF), A.vectors(spark, SF)
    got = agent.respond("微博最热的主题有哪些", t, s, i, v)
    assert got["diagnostics"]["tools"] == ["topic_query"] and got["answer"].endswith("（本次使用工具：topic_query）") and len(got["citations"]) == 20
    want = T.topic_query(T.item_view(t, s, i), platforms=["weibo"], order="heat_desc", limit=10)
    calls = [{"tool": "topic_query", "args": {"platforms": ["weibo"], "title_contains": None, "order": "heat_desc"}}]
    context = agent.execute(calls, "q", t, s, i, v)
    assert {r.topic_id for r in context.collect()} == {r.topic_id for r in want.collect()} and [r.pos for r in context.collect()] == list(range(1, 11))
    assert agent.respond("嗨", t, s, i, v)["answer"].endswith("（本次使用工具：无）")
    nothing = [{"tool": "topic_query", "args": {"platforms": [], "title_contains": "no such title", "order": "heat_desc"}}]
    default = agent.execute([], "q", t, s, i, v)
    assert [tuple(r)[1:] for r in agent.execute(nothing, "q", t, s, i, v).collect()] == [tuple(r)[1:] for r in default.collect()]
    with pytest.raises(ValueError, match="no such tool"):
        agent.execute([{"tool": "x", "args": {}}], "q", t, s, i, v)
    with pytest.raises(ValueError, match="mode"):
        agent.respond("q", t, s, i, v, mode="topic")
    assert agent.respond("q", t, s, i, v, mode="topic", topic_id=3)["citations"]


def test_global_context_falls_back(spark):
    t, i, v = A.topics(spark, SF), A.items(spark, SF), A.vectors(spark, SF)
    assert agent.global_topics(t, i, v.limit(0), [1.0] * 64, [], None).count() == 5  # the newest
    assert agent.global_topics(t, i, v, [1.0] * 64, ["no such word"], None).count() == 0
    some = agent.global_topics(t, i, v, [1.0] * 64, ["the"], ["nowhere"])
    assert sorted(some.collect()) == sorted(agent.global_topics(t, i, v, [1.0] * 64, ["the"], None).collect())


def test_unknown_names_are_refused(spark):
    with pytest.raises(ValueError, match="no such category"):
        metrics.category_series(spark.range(1), "x", "heat_sum")
    with pytest.raises(ValueError, match="metric"):
        metrics.category_series(spark.range(1), "entertainment", "title")


def test_or_else(spark):
    a, b = spark.range(2), spark.range(5, 8)
    assert search.or_else(a, b).count() == 2 and sorted(r.id for r in search.or_else(a.limit(0), b).collect()) == [5, 6, 7]


@pytest.mark.parametrize("most", [1_000, 7])
def test_cosine_pairs_of_a_cut_group(spark, most):
    """Chunks lose no pair and give none twice."""
    v = A.vectors(spark, SF).where("id < 120").withColumn("g", F.lit(0)).select("g", "id", "x")
    x = {r.id: r.x for r in v.collect()}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    want = sorted((a, b) for a in x for b in x if a < b and dot(x[a], x[b]) / (dot(x[a], x[a]) * dot(x[b], x[b])) ** 0.5 >= 0.1)
    assert want and sorted((r.a, r.b) for r in search.cosine_pairs(v, "g", 0.1, most).collect()) == want


def test_summaries_are_due(spark):
    """None yet: full; three new nodes and six hours: an update; otherwise the old one is kept."""
    at = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    topics = spark.createDataFrame([(k, "t") for k in range(1, 5)], "topic_id long, title string")
    old = [(1, 2, "2024-01-01 10:00:00"), (2, 3, "2024-01-01 10:00:00"), (3, 4, "2024-01-01 19:00:00")]
    told = at(spark.createDataFrame(old, "id long, topic_id long, generated_at string"), "generated_at").withColumn("content", F.lit("c"))
    nodes = [(2, k, "2024-01-01 20:00:00") for k in range(3)] + [(3, k, "2024-01-01 20:00:00") for k in range(2)] + [(4, k, "2024-01-01 20:00:00") for k in range(5)] + [(3, 9, "2024-01-01 09:00:00")]
    got = summaries.due(topics, at(spark.createDataFrame(nodes, "topic_id long, id long, appended_at string"), "appended_at"), told, as_of())
    assert {r.topic_id: (r.new_nodes, r.mode) for r in got.collect()} == {1: (0, "full"), 2: (3, "incremental"), 3: (2, "keep"), 4: (5, "keep")}
