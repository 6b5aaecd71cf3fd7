"""Operators against plain loops, properties, and the state pipeline end to end."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import access, agent, cluster, context, heat, metrics, search
from pulsemill.operators import topics as T
from pulsemill.providers import StubChat, chat_model, embed, judge_batch
from pulsemill.sources import adapters as A
from pulsemill.sources import hotlist
from pulsemill.sources.schema import Table
from pulsemill.sources.storage import Store
from pulsemill.streaming import pipeline

SF = "/root/testdata/sf0.001"


def test_heat_adds_up_and_golden(spark):
    rows = [("weibo", 100.0), ("weibo", 50.0), ("weibo", None), ("zhihu", 7.0), ("hupu", None)]
    df = spark.createDataFrame([(k, "2024-01-01_AM", p, h) for k, (p, h) in enumerate(rows)], "id long, period string, platform string, heat_value double")
    got = [r.heat_normalized for r in heat.normalize(df).orderBy("id").collect()]
    assert got == pytest.approx([0.436364, 0.0, 0.218182, 0.2, 0.145455], abs=1e-6) and sum(got) == pytest.approx(1)


@pytest.mark.parametrize("seed", range(4))
def test_leaders_equal_the_loop(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.04}
    want, taken = {}, set()
    for a in range(n):
        if a not in taken:
            want[a] = a
            for b in range(a + 1, n):
                if (a, b) in edges and b not in taken:
                    taken.add(b)
                    want[b] = a
    got = cluster.leader_clusters(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {x.k: x.leader for x in got.collect()} == want


def test_leaders_of_a_chain_are_not_components(spark):
    got = cluster.leader_clusters(spark.range(1, 5).withColumnRenamed("id", "k"), spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    assert sorted((x.k, x.leader) for x in got.collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_jaccard_join_loses_no_pair(spark):
    r = random.Random(7)
    sets = [[r.choice("abcdefghijkl") for _ in range(r.randrange(0, 8))] for _ in range(150)]
    df = spark.createDataFrame([(k % 3, k, s) for k, s in enumerate(sets)], "g int, k long, t array<string>")
    for thr in (0.4, 0.75, 1.0):
        got = {(x.a, x.b) for x in cluster.jaccard_pairs(df, "g", "k", "t", thr).collect()}
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if a % 3 == b % 3 and sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= thr}
        assert got == want


def test_occurrence(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (6, "c")], "id long, g string")
    got = {r.id: (r.occurrence, r.merge_status) for r in cluster.occurrence(df, "g").collect()}
    assert got[1] == (1, "discarded") and got[2] == (2, "pending_global_merge") and got[6] == (3, "pending_global_merge")


def test_pages_are_the_whole_list(spark):
    t = A.topics(spark, SF).cache()
    n = t.count()
    pages = [r.topic_id for k in range(1, n // 4 + 2) for r in T.page(t, "echo_rank", k, 4).collect()]
    assert pages == [r.topic_id for r in T.with_hours(t).orderBy(*T.ORDERS["echo_rank"]()).collect()] and len(pages) == n
    with pytest.raises(ValueError, match="size"):
        T.page(t, size=101)


def test_context_packing_golden(spark):
    df = spark.createDataFrame([(1, 1, "a" * 8), (1, 2, "b" * 10), (1, 3, "c" * 12)], "g int, pos int, t string")
    got = [r.packed for r in context.pack_context(df, "g", "pos", "t", 10).orderBy("pos").collect()]
    assert got[:2] == ["a" * 8, "b" * 10] and got[2].endswith("...") and len(got) == 3 and len(got[2]) <= 4


def test_top_k_equals_sort(spark):
    q = np.random.default_rng(0).normal(size=64)
    v = A.vectors(spark, SF)
    rows = {r.id: np.array(r.x) for r in v.collect()}
    want = sorted(rows, key=lambda k: (1 - rows[k] @ q / np.linalg.norm(rows[k]) / np.linalg.norm(q), k))[:10]
    assert [r.id for r in search.top_k(v, q.tolist(), 10).collect()] == want


def test_metrics_of_nothing(spark):
    t = T.with_hours(A.topics(spark, SF)).limit(0)
    rows = metrics.category_metrics(t).collect()
    assert len(rows) == 3 and all(r.topics_count == 0 and r.avg_hours == 0 and r.max_topic_id is None for r in rows)


def test_tokens_of_free_mode(spark):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([(1, False, "2024-02-01 00:00:00"), (2, True, None), (3, False, "2024-01-01 00:00:00"), (4, False, None)], "id int, revoked boolean, e string").withColumn("expires_at", F.col("e").cast("timestamp_ntz"))
    assert [r.verdict for r in access.check_tokens(df, at).orderBy("id").collect()] == ["ok", "revoked", "expired", "ok"]


# ------------------------------------------------------------------ sources

PAYLOADS = {
    "weibo.json": json.dumps({"ok": 1, "data": {"realtime": [{"word": "甲", "word_scheme": "#甲#", "num": 100, "icon_desc": "热"}, {"word": "乙", "num": 5}]}}),
    "zhihu.json": json.dumps({"data": [{"detail_text": "166万热度", "target": {"title": "问", "excerpt": "摘", "id": 7, "type": "question", "answer_count": 3, "follower_count": 0}}]}),
    "toutiao.json": json.dumps({"data": [{"Title": "头", "Url": "http://t/1", "HotValue": "1.2亿"}, {"title": "条", "url": "http://t/2", "hot": "3w", "desc": "d"}]}),
    "baidu.json": json.dumps({"data": {"cards": [{"content": [{"word": "百", "url": "/s?wd=1", "hotScore": "42", "desc": ""}]}]}}),
    "sina.json": json.dumps({"result": {"data": [{"title": "新", "url": "//s/1", "intro": "引", "comment_count": "9"}]}}),
    "netease.html": '<div class="mod_hot_rank"><ul><li><em>1</em><a title="网题" href="http://n/article/ABC.html">网</a><span>12,345</span></li><li><em>2</em><a href="http://n/2">易题</a><span></span></li></ul></div>',
    "hupu.html": "<h2>篮球热榜</h2><li><a href='/1.html'>很长的篮球标题 88评论</a></li><li><a href='/2.html'>短</a></li><h2>足球热榜</h2><li><a href='/3.html'>很长的足球标题</a></li><li><a href='/1.html'>很长的篮球标题</a></li>",
}


def test_recorded_lists(spark, tmp_path):
    for n, p in PAYLOADS.items():
        (tmp_path / n).write_text(p, encoding="utf-8")
    raw = hotlist.recorded(spark, str(tmp_path))
    found = hotlist.items(raw)
    got = {(r.platform, r.title): r for r in found.collect()}
    assert len(got) == 11
    assert got["weibo", "甲"].hot_value == 100 and got["weibo", "甲"].summary == "#甲#" and got["weibo", "乙"].interactions == {"hot_value": "5.0"}
    assert got["zhihu", "问"].url == "https://www.zhihu.com/question/7" and got["zhihu", "问"].hot_value == 1660000 and got["zhihu", "问"].interactions == {"answer_count": "3"}
    assert got["toutiao", "头"].hot_value == 1.2e8 and got["toutiao", "条"].hot_value == 30000 and got["toutiao", "条"].summary == "d"
    assert got["baidu", "百"].url == "https://www.baidu.com/s?wd=1" and got["baidu", "百"].hot_value == 42 and got["sina", "新"].url == "https://s/1" and got["sina", "新"].hot_value is None
    assert got["netease", "网题"].hot_value == 12345 and got["netease", "易题"].hot_value is None
    assert got["hupu", "很长的篮球标题 88评论"].hot_value == 88 and got["hupu", "很长的足球标题"].url == "https://bbs.hupu.com/3.html"
    assert hotlist.items(raw, 1).where("platform = 'hupu'").count() == 2
    e = hotlist.enrich(found, "r1", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    assert e.select("dedup_key").distinct().count() == 11 and {r.period for r in e.collect()} == {"2024-01-01_AM"}
    assert {r.platform: r["items"] for r in hotlist.run_report(raw, found).collect()}["weibo"] == 2
    hotlist.dump(found, str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).count() == 11


def test_fetch_tells_errors_as_rows(spark, tmp_path):
    page = tmp_path / "w.json"
    page.write_text(PAYLOADS["weibo.json"], encoding="utf-8")
    raw = hotlist.fetch(spark, platforms="weibo,zhihu", **{"url.weibo": f"file:///nowhere file://{page}", "url.zhihu": "file:///nowhere", "tries": "2", "wait": "0"})
    got = {r.platform: r for r in raw.collect()}
    assert got["weibo"].status == "success" and got["zhihu"].status == "failed" and "URLError" in got["zhihu"].error and hotlist.items(raw).count() == 2


# ------------------------------------------------------------------ state

ITEMS = "id long, period string, platform string, title string, summary string, heat_value double, fetched_at timestamp_ntz, merge_status string"


def some_items(spark, period, at, first):
    titles = ["alpha star marries beta", "alpha star marries beta today", "new law on rivers passed", "new law on rivers passed", "lonely headline xyz"]
    rows = [(first + k, period, "weibo" if k % 2 else "zhihu", t, "s", float(k), at, "pending_event_merge") for k, t in enumerate(titles)]
    return spark.createDataFrame(rows, ITEMS.replace("fetched_at timestamp_ntz", "fetched_at string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


def state(store):
    return sorted((r.topic_id, r.intensity_total, str(r.last_active)) for r in store.read("topics").collect())


@pytest.mark.parametrize("failing", [1, 2, 3, 4])
def test_a_failed_period_counts_once(spark, tmp_path, failing):
    """A run that fails before its first to fourth write, and is run again, leaves what one run leaves."""
    class Fails(Store):
        writes = 0

        def _publish(self, *a, **b):
            Fails.writes += 1
            if Fails.writes == failing:
                raise OSError("lost")
            super()._publish(*a, **b)

    whole, broken = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "broken"))
    for s in (whole, broken):
        s.append("items", some_items(spark, "2024-01-01_AM", "2024-01-01 11:00:00", 1))
    pipeline.run_period(spark, whole, "2024-01-01_AM")
    with pytest.raises(OSError):
        pipeline.run_period(spark, Fails(spark, str(tmp_path / "broken")), "2024-01-01_AM")
    pipeline.run_period(spark, broken, "2024-01-01_AM")
    for name in ("topics", "nodes", "period_heat", "items"):
        a, b = (s.read(name) for s in (whole, broken))
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_two_periods(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append("items", some_items(spark, "2024-01-01_AM", "2024-01-01 11:00:00", 1))
    log = pipeline.run_period(spark, store, "2024-01-01_AM")
    assert (log["input"], log["kept"], log["topics"], log["late"]) == (5, 4, 2, 0)
    one = state(store)
    assert [x[:2] for x in one] == [(1, 2), (3, 2)] and {r.id: r.merge_status for r in store.read("items").collect()}[5] == "discarded"
    assert pipeline.run_period(spark, store, "2024-01-01_AM")["input"] == 0 and state(store) == one
    store.append("items", some_items(spark, "2024-01-01_PM", "2024-01-01 15:00:00", 11).unionByName(some_items(spark, "2024-01-01_MORN", "2024-01-01 05:00:00", 31).limit(1)))
    assert pipeline.run_period(spark, store, "2024-01-01_PM")["late"] == 1
    assert state(store) == [(1, 4, "2024-01-01 15:00:00"), (3, 4, "2024-01-01 15:00:00")]
    assert store.read("nodes").count() == 8 and store.read("period_heat").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    rows = some_items(spark, "2024-01-01_AM", "2024-01-01 11:00:00", 1).unionByName(some_items(spark, "2024-01-01_PM", "2024-01-01 15:00:00", 11))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    pipeline.start(spark, a, str(tmp_path / "in"), ITEMS, str(tmp_path / "cp")).awaitTermination()
    b.append("items", rows)
    for p in ("2024-01-01_AM", "2024-01-01_PM"):
        pipeline.run_period(spark, b, p)
    assert state(a) == state(b) and a.read("nodes").count() == b.read("nodes").count() == 8
    got = pipeline.windowed_counts(rows)
    assert sorted((r.platform, r["items"]) for r in got.collect()) == [("weibo", 2), ("weibo", 2), ("zhihu", 3), ("zhihu", 3)]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), {"t": Table(keys=("k",), partition="day")})
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2")], "k int, v string, day string")
    s.append("t", df)
    s.upsert("t", spark.createDataFrame([(2, "c", "d2"), (3, "d", "d3")], df.schema), ["k"])
    rows = lambda: sorted((r.k, r.v) for r in s.read("t").collect())
    assert rows() == [(1, "a"), (2, "c"), (3, "d")]
    s.replace_days("t", spark.createDataFrame([(9, "z", "d1")], df.schema))
    assert rows() == [(2, "c"), (3, "d"), (9, "z")]
    s.delete("t", spark.createDataFrame([(9,)], "k int"), ["k"])
    s.clear("u") if s.exists("u") else None
    assert rows() == [(2, "c"), (3, "d")]
    s.clear("t")
    assert rows() == []


# ------------------------------------------------------------------ questions


def test_think_tags_in_a_stream():
    assert list(agent.strip_stream(iter(["<th", "ink>x</thi", "nk>ok"]))) == ["", "", "ok"]
    for cut in range(1, 20):
        t = "a<b <think>hidden</think> c<think>"
        parts = [t[k : k + cut] for k in range(0, len(t), cut)]
        assert "".join(agent.strip_stream(iter(parts))) == "a<b  c"


def test_weights_of_a_setting():
    assert heat.weights_of('{"weibo": 2, "sina": 0.5}') == {"weibo": 2.0, "sina": 0.5}
    for bad in ("[1]", '{"a": "x"}', '{"a": true}', "x"):
        with pytest.raises(ValueError):
            heat.weights_of(bad)


def test_citations():
    assert agent.citation({"topic_id": 3, "snippet": None}) == {"topic_id": 3, "node_id": None, "source_url": "", "snippet": "", "platform": ""}


def test_key_nodes_are_cut_before_the_shuffle(spark):
    """Each part of a topic's key nodes is limited in the tasks that read the nodes, and the first is an aggregate."""
    nodes = spark.range(1000).select((F.col("id") % 3).alias("topic_id"), "id", F.col("id").cast("timestamp").cast("timestamp_ntz").alias("appended_at"), F.col("id").alias("interaction_total"), (F.col("id") % 2 == 0).alias("has_interactions"))
    df = T.key_nodes(nodes)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 3 and "WindowGroupLimit" in plan
    assert [r.id for r in df.where("topic_id = 0").orderBy("pos").collect()] == [0, 987, 990, 993, 996, 999]  # 996 and 990 have most interactions


def test_plan():
    assert agent.plan("你好") == [] and agent.plan("微博最热的有哪些")[0]["args"]["platforms"] == ["weibo"]
    assert agent.plan("搜索 alpha 离婚")[0] == {"tool": "topic_search", "args": {"keywords": ["alpha", "离婚"], "platforms": [], "match_all": False}}


def test_plan_with_history():
    """A turn that only refines the one before asks that one again, with its tool and the new time filter."""
    asked = [{"role": "user", "content": "微博最热的电影主题有哪些"}, {"role": "assistant", "content": "十个。\n\n（本次使用工具：topic_query）"}]
    assert agent.resolve("只看近7天", asked) == ("微博最热的电影主题有哪些 只看近7天", {"all_time": False, "recent_days": 7}, True, "topic_query")
    first = agent.plan(asked[0]["content"])[0]
    assert agent.plan("只看近7天", asked) == [{"tool": "topic_query", "args": {**first["args"], "recent_days": 7}}]
    assert agent.plan("不要最近", asked) == [first] and agent.resolve("不限时间", asked)[1]["all_time"]
    assert agent.plan("只看近7天") == [{"tool": "topic_search", "args": {"keywords": [], "platforms": [], "match_all": False, "recent_days": 7}}]
    searched = [{"role": "user", "content": "搜索 alpha"}, {"role": "assistant", "content": "x（本次使用工具：topic_search）"}, {"role": "assistant", "content": "no footer"}]
    assert agent.plan("改为最近30天", searched)[0] == {"tool": "topic_search", "args": {"keywords": ["alpha"], "platforms": [], "match_all": False, "recent_days": 30}}
    assert agent.plan("知乎最新列表", asked)[0]["args"]["order"] == "echo_length_desc" and agent.plan("知乎最新列表", asked)[0]["args"]["platforms"] == ["zhihu"]


def test_ask(spark):
    ctx = agent.topic_context(3, A.summaries(spark, SF), A.items_titled(spark, SF))
    got = agent.ask("what?", ctx)
    assert got["answer"] and got["diagnostics"]["chunks"] == len(got["citations"]) == 6
    events = list(agent.ask_stream("what?", ctx))
    assert events[0].startswith("event: token\ndata: ") and events[-1].startswith("event: done") and all(e.endswith("\n\n") for e in events)
    assert agent.ask("x", None)["answer"] == agent.FALLBACK

    class Breaks(StubChat):
        def stream(self, messages, **options):
            yield from ("one ", "<think>no</think>", "two")
            raise OSError("cut off")

    broken = list(agent.ask_stream("what?", ctx, Breaks()))
    assert [json.loads(e.split("data: ")[1]) for e in broken] == [{"content": "one "}, {"content": "two"}, {"message": "cut off"}] and broken[-1].startswith("event: error")
    v = embed(A.topics(spark, SF).select("topic_id", F.col("topic_id").alias("id"), "title"), "title").withColumn("object_type", F.lit("topic_summary"))
    one = A.topics(spark, SF).first()
    hits = agent.topic_search(A.topics(spark, SF), A.items(spark, SF), v, one.title, []).collect()
    assert one.topic_id in [r.topic_id for r in hits]


def test_providers(spark):
    with pytest.raises(ValueError, match="no such provider"):
        chat_model("none")
    rows = judge_batch(spark.createDataFrame([(1, "q 答：yes"), (2, None)], "id int, p string"), "p").orderBy("id").collect()
    assert rows[0].answer == "yes" and rows[1].status == "success"
    assert "".join(chat_model().stream([{"role": "user", "content": "答：ab"}])) == "ab"


def test_summaries_hold_whole_texts(spark):
    texts = {r.doc_id: r.text for r in A.read(spark, SF, "documents").collect()}
    assert max(len(t or "") for t in texts.values()) > 300 and {r.id: r.content for r in A.summaries(spark, SF).collect()} == texts


def test_jaccard_pairs_of_cut_groups(spark, monkeypatch):
    """blocks lose no pair and give none twice, also where tokens fill several products; pairs that fail are never joined rows."""
    import random

    monkeypatch.setattr(cluster.blocks, "ROWS", 16)
    monkeypatch.setattr(cluster.blocks, "SLICE", 5)
    monkeypatch.setattr(cluster, "WORDS", 7)
    rnd = random.Random(1)
    sets = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(0, 9))] for _ in range(120)]
    sets[:30] = [["the", "same"]] * 30
    rows = [(k % 2, k, s) for k, s in enumerate(sets)] + [(None, 500, ["the", "same"]), (0, None, ["the", "same"]), (0, 501, None)]
    out = cluster.jaccard_pairs(spark.createDataFrame(rows, "g int, k long, t array<string>"), "g", "k", "t", 0.4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "explode(t" not in plan
    want = sorted((a, b, len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]})) for a in range(120) for b in range(a + 1, 120) if a % 2 == b % 2 and sets[a] and sets[b])
    assert sorted((r.a, r.b, r.jaccard) for r in out.collect()) == [w for w in want if w[2] >= 0.4]
