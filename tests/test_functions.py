"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from pulsemill.functions import jsonx, text, timex


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


lit = F.lit


@pytest.mark.parametrize(("given", "want"), [("安徽省二胎补贴被追回", "安徽省2胎补贴被追回"), ("ＡＢＣ１２３！", "abc123"), ("  Hello,   World  ", "hello world"), ("三星 S24—发布", "3星 s24 发布"), ("", ""), (None, "")])
def test_normalize(spark, given, want):
    assert value(spark, text.normalize_title(lit(given).cast("string"))) == want


def test_similarity(spark):
    j = lambda a, b: value(spark, text.jaccard(text.ngrams(lit(a)), text.ngrams(lit(b))))
    assert j("abc", "bcd") == pytest.approx(1 / 3) and j("a", "ab") == 0.0


@pytest.mark.parametrize(("hour", "want"), [("00:30:00", "MORN"), ("09:59:59", "MORN"), ("10:00:00", "AM"), ("13:59:00", "AM"), ("14:00:00", "PM"), ("19:59:00", "PM"), ("20:00:00", "EVE")])
def test_period(spark, hour, want):
    assert value(spark, timex.period_label(lit(f"2025-10-29 {hour}").cast("timestamp_ntz"))) == f"2025-10-29_{want}"


def test_numbers(spark):
    assert [value(spark, text.unit_number(lit(x))) for x in ("1.2亿", "3w", "")] == [120000000.0, 30000.0, 0.0]
    assert [value(spark, text.hot_text_number(lit(x))) for x in ("166万热度", "abc")] == [1660000.0, None]
    assert value(spark, text.digits_number(lit("12,345"))) == 12345.0


@pytest.mark.parametrize(("title", "url", "want"), [("点击查看 更多实时热点", "", True), ("点击查看更多热榜", "", True), ("", "", True), ("x", "http://a/top_news_list.d.html", True), ("热点新闻", "", False)])
def test_noise(spark, title, url, want):
    assert value(spark, text.is_noise(lit(title), lit(url))) is want


@pytest.mark.parametrize(("t", "hupu", "want"), [("演员夺得冠军", False, ("entertainment", 1.0)), ("球队夺冠 演员", False, ("sports_esports", 1.0)), ("普通文本", True, ("sports_esports", 1.0)), ("普通文本", False, ("current_affairs", 0.0)), ("演员冠军", False, ("entertainment", 1.0))])
def test_rules(spark, t, hupu, want):
    cat, conf = text.rule_category(lit(t), lit(hupu))
    assert (value(spark, cat), value(spark, conf)) == want


def test_displays(spark):
    assert [value(spark, text.days_hours(lit(h))) for h in (76.0, 36.9, 0.0)] == ["3天4小时", "1天12小时", "0天0小时"]
    assert [value(spark, text.ui_length(lit(h))) for h in (0.4, 23.6, 25.0)] == ["低于2小时", "1天", "1天1小时"]


def test_keywords(spark):
    assert value(spark, text.query_keywords(lit("最近 AI 芯片 有哪些 进展"))) == ["AI", "芯片"]
    assert value(spark, text.query_keywords(lit("半导体产业"))) == ["半导体产", "导体产业", "半导体", "导体产", "体产业", "半导", "导体", "体产"]
    assert value(spark, text.query_keywords(lit("最近"))) == ["最近"]
    assert value(spark, text.platforms_in(lit("微博和今日头条"))) == ["weibo", "toutiao"]


def test_think(spark):
    assert value(spark, text.strip_think(lit("<think>a\nb</think> hi"))) == "hi"
    assert value(spark, text.after_think(lit("x <THINK>a</THINK>  yes"))) == "yes" and value(spark, text.after_think(lit("before <think> a"))) == "before"


@pytest.mark.parametrize(("raw", "want"), [("55", 55), ("2", 55), ("3", 3), ("候选主题 1", 101), ("2.0", 55), ("x", None), ("9", None)])
def test_target(spark, raw, want):
    assert value(spark, jsonx.resolve_target(lit(raw), F.array(*[lit(x).cast("bigint") for x in (101, 55, 3)]))) == want


@pytest.mark.parametrize(("q", "a", "b"), [("近7天", "2024-01-25", "2024-01-31"), ("本周", "2024-01-29", "2024-01-31"), ("上周", "2024-01-22", "2024-01-28"), ("昨天", "2024-01-30", "2024-01-30"), ("2024年1月5日到2024-01-02", "2024-01-02", "2024-01-05"), ("没有", None, None)])
def test_ranges(spark, q, a, b):
    got = timex.date_range(lit(q), lit("2024-01-31").cast("date"))
    assert [x and str(x) for x in (value(spark, got[0]), value(spark, got[1]))] == [a, b]


def test_json(spark):
    assert value(spark, jsonx.lenient_json(lit('so {"a": 1} ok'))) == '{"a": 1}' and value(spark, jsonx.lenient_json(lit("no {"))) is None
    assert value(spark, jsonx.engagement(lit('{"hot_score": "", "engagement": "12"}'))) == 12 and value(spark, jsonx.engagement(lit('{"hot_score": "x"}'))) is None
    assert value(spark, jsonx.interaction_total(lit('{"like": 2, "view": "5", "other": 9}'))) == 7
    long = "good " * 11
    assert value(spark, jsonx.summary_field(lit('<x>{"summary": "%s", "key_points": []}' % long))) == long
    # 50 characters or fewer inside a text: read as broken, up to the last quote that leaves those inside in pairs
    assert value(spark, jsonx.summary_field(lit('<x>{"summary": "good", "key_points": []}'))) == 'good", "key_points'
    assert value(spark, jsonx.summary_field(lit('{"summary": "good \\"day\\" and\\nmore", "key'))) == 'good "day" and\nmore'
    cat, conf = jsonx.category_answer(lit('{"category": "entertainment", "confidence": 1.7}'), ["entertainment", "current_affairs"])
    assert (value(spark, cat), value(spark, conf)) == ("entertainment", 1.0)
    cat, conf = jsonx.category_answer(lit("it is current_affairs"), ["entertainment", "current_affairs"])
    assert (value(spark, cat), value(spark, conf)) == ("current_affairs", 0.5)


def test_tokens(spark):
    assert value(spark, text.token_estimate(lit("abcdef"))) == 3
    assert value(spark, text.truncate_to_tokens(lit("x" * 100), 10)) == "x" * 18 + "..." and value(spark, text.truncate_to_tokens(lit("ab"), 10)) == "ab"


def test_followup(spark):
    f = text.followup(lit("不要最近"))
    assert value(spark, f["all_time"]) is True and value(spark, f["refine_only"]) is True and value(spark, text.followup(lit("近两周演员离婚"))["recent_days"]) == 14


def test_json_ends_where_the_text_does(spark):
    """a number, list or object at the start of a text doesn't make it JSON; Spark's parser stops after the first value."""
    said = "12 months of reports, and more besides"
    answers = [said, '[1] ' + said, '{"a": 1} ' + said, "[]]" + said, '1] ' + said, '1} ' + said, '1,"y":2', "2024", '{"summary": "s"}', ' [{"a": "]"}] ', None]
    df = spark.createDataFrame(list(enumerate(answers)), "k int, a string").select("k", jsonx.summary_field(F.col("a")).alias("s"), jsonx.is_json(F.col("a")).alias("json"))
    rows = df.orderBy("k").collect()
    assert [r.json for r in rows] == [False] * 7 + [True, True, True, False]
    assert [r.s for r in rows] == answers[:7] + [jsonx.NO_FIELD, "s", jsonx.NO_FIELD, jsonx.NO_CONTENT]


def test_answers_are_read_once(spark):
    """F9 to F11: however often parts of an answer or page are used, the plan computes it once, and no filter does so again."""
    from pulsemill.operators import summaries
    from pulsemill.plans import answers, workflow

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    sf = "/root/testdata/sf0.001"
    assert plan(workflow.incremental_parse(spark, sf)).count("regexp_replace(text") == 6  # one for each place of the text in the five kinds of answers
    assert plan(answers.embedded_state(spark, sf)).count("var x") == 1
    rows = spark.createDataFrame([(1, "t", "full", '{"summary": "whole"}', "success"), (2, "t", "incremental", "none", "success"), (3, "t", "full", "x", "failed")], "topic_id int, title string, mode string, answer string, status string")
    out = summaries.resolved(rows)
    assert "Filter" not in plan(out) and sorted(map(tuple, out.collect())) == [(1, "whole", "full"), (3, "事件「t」的摘要正在生成中...", "placeholder")]
