"""Recorded pages: embedded state, adverts, articles and the second round."""

import json

import pytest
from pyspark.sql import functions as F

from pulsemill.sources import hotlist, pages

STATE = {"x": {"empty": [], "note": "a ] and a } and \\ \"quoted\" {["}, "board": {"list": [{"Title": "头", "Url": "http://t/1", "HotValue": "2万"}, {"title": "}", "url": "http://t/2", "hot": "5"}]}}
ZHIHU = {"topstory": {"hotList": [{"detail_text": "3万热度", "target": {"title": " 问; } ", "excerpt": "", "id": 9, "type": "question", "answer_count": 4, "hot_value": 7}}]}}
ARTICLE = """<html><head><title> 题 </title></head><body><div class="post_info">来源 2025-10-29 01:42:44 x</div>
<div class="nav post_body"><p> 正文 一</p><div>内 <b>容</b></div><script>var a = "<div>";</script><style>p{}</style>（原标题：旧）分享至 好友 朋友圈<p>尾</p></div><div class="post_body">second</div></body></html>"""


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "whole", "listed"),
    [
        ('x = {"a": "}"} y', '{"a": "}"}', None), ('{"a": "\\\\"}, {}', '{"a": "\\\\"}', None), ('{"a": "\\"}"}', '{"a": "\\"}"}', None), ('{"a": [ ], "b": [[1], 2]}', '{"a": [ ], "b": [[1], 2]}', "[[1], 2]"), ('{"a": [1', None, None),
        ("", None, None), (None, None, None), ('} ] {"k": "[x]", "l": [{"m": "]"}]} [9]', '{"k": "[x]", "l": [{"m": "]"}]}', '[{"m": "]"}]'),
    ],
)
def test_balanced(spark, text, whole, listed):
    t = F.lit(text).cast("string")
    assert one(spark, pages.balanced(t, "{", "}")) == whole and one(spark, pages.first_list(t)) == listed


def test_lists_that_pages_embed(spark, tmp_path):
    (tmp_path / "toutiao.html").write_text(f"<html><script>window.__SSR_HYDRATED_DATA__ = {json.dumps(STATE, ensure_ascii=False)};</script><script>f({{}})</script>", encoding="utf-8")
    (tmp_path / "zhihu.html").write_text(f"<script>window.__INITIAL_STATE__={json.dumps(ZHIHU)};HotList</script>", encoding="utf-8")
    (tmp_path / "sina.html").write_text('<ul><li class="top ad"><a href="/a">advert one</a></li><li><a href="/n">news</a></li><li><ins class="x sinaads"></ins><a href="/b">advert two</a></li></ul><a href="//s/2">more</a>', encoding="utf-8")
    got = {(r.platform, r.title): r for r in hotlist.items(hotlist.recorded(spark, str(tmp_path))).collect()}
    assert set(got) == {("toutiao", "头"), ("toutiao", "}"), ("zhihu", "问; }"), ("sina", "news"), ("sina", "more")}
    assert got["toutiao", "头"].hot_value == 20000 and got["toutiao", "}"].url == "http://t/2"
    z = got["zhihu", "问; }"]
    assert (z.summary, z.url, z.hot_value, z.interactions) == ("问; }", "https://www.zhihu.com/question/9", 30000, {"answer_count": "4", "hot_value": "7"})


def test_articles(spark):
    a = one(spark, pages.article(F.lit(ARTICLE)))
    assert (a.title, a.summary, a.published_at) == ("题", "正文 一内容尾", "2025-10-29 01:42:44")
    meta = '<meta property="article:published_time" content="2024-05-06T07:08:09+08:00"><div id="content"><p>' + "字" * 300 + "</p></div>"
    a = one(spark, pages.article(F.lit(meta)))
    assert (a.summary, a.published_at) == ("字" * 200, "2024-05-06T07:08:09+08:00")
    a = one(spark, pages.article(F.lit("<div class='post_body'>never closed")))
    assert (a.summary, a.published_at) == ("", "")


def test_second_round(spark, tmp_path):
    """Each address is asked once; a page that is missing is a row with its error and leaves its item as it is."""
    (tmp_path / "a.html").write_text(ARTICLE, encoding="utf-8")
    good, bad = f"file://{tmp_path}/a.html", "file:///nowhere"
    found = spark.createDataFrame([(1, "t", "old", good), (2, "u", "old", bad), (3, "v", "old", good), (4, "w", "old", None)], "id int, title string, summary string, url string")
    details = pages.fetch_details(found, tries=2, wait=0.0).cache()
    assert {r.url: r.status for r in details.collect()} == {good: "success", bad: "failed"} and details.count() == 2
    got = {r.id: (r.summary, str(r.published_at)) for r in pages.with_details(found, details).collect()}
    told = ("正文 一内容尾", "2025-10-29 01:42:44")
    assert got == {1: told, 2: ("old", "None"), 3: told, 4: ("old", "None")}


@pytest.mark.parametrize(("states", "want"), [(["success", "success"], "success"), (["success", "failed"], "partial"), (["failed", "failed"], "failed")])
def test_run_row(spark, states, want):
    raw = spark.createDataFrame([(p, s, None if s == "success" else "lost") for p, s in zip(("weibo", "zhihu"), states, strict=True)], "platform string, status string, error string")
    found = spark.createDataFrame([("weibo", "点击查看更多热点", "u"), ("weibo", "a", "u"), ("weibo", "b", "u")], "platform string, title string, url string")
    report = hotlist.run_report(raw, found)
    assert {r.platform: (r["items"], r.skipped, r.kept) for r in report.collect()} == {"weibo": (3, 1, 2), "zhihu": (0, 0, 0)}
    r = hotlist.run_row(report, "r1", F.lit(1), F.lit(2)).first()
    assert (r.run_id, r.status, r.platforms, r.answered, r["items"], r.kept) == ("r1", want, 2, states.count("success"), 3, 2)
    assert json.loads(r.errors) == {p: "lost" for p, s in zip(("weibo", "zhihu"), states, strict=True) if s == "failed"}
