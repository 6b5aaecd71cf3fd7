"""Hot lists of seven platforms: a Python data source that fetches pages, recorded pages, and parsers in DataFrame operations.

Raw pages come as rows (platform, status, error, payload): one partition for each platform, so one that fails is a row with
its error and doesn't fail the others. Parsers turn the payload column into items."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import digits_number, hot_text_number, html_text, is_noise, unit_number
from ..functions.timex import period_label
from .pages import embedded_object, first_list, get

RAW = "platform string, status string, error string, payload string"
ITEM = "array<struct<title:string,summary:string,url:string,hot_value:double,interactions:map<string,string>>>"
PLATFORMS = ["weibo", "zhihu", "toutiao", "sina", "netease", "baidu", "hupu"]


class _Platform(InputPartition):
    def __init__(self, platform: str, urls: list[str]):
        super().__init__(platform)
        self.platform, self.urls = platform, urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        names = [p for p in self.options.get("platforms", ",".join(PLATFORMS)).split(",") if p]
        return [_Platform(p, [u for u in self.options.get(f"url.{p}", "").split(" ") if u]) for p in names]

    def read(self, part: _Platform) -> Iterator[tuple]:
        """The first address that answers with something wins; each is tried three times, with growing pauses."""
        error = "no address"
        for url in part.urls:
            text, error = get(url, int(self.options.get("tries", 3)), float(self.options.get("wait", 2)), float(self.options.get("timeout", 10)))
            if text is not None:
                yield part.platform, "success", None, text
                return
        yield part.platform, "failed", error, None


class HotListSource(DataSource):
    """spark.read.format("hotlist").option("url.weibo", "http://...").load()"""

    @classmethod
    def name(cls) -> str:
        return "hotlist"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(HotListSource)
    return spark.read.format("hotlist").options(**options).load()


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """Pages recorded as files <platform>.<anything> in a folder of any file system."""
    f = spark.read.text(f"{path}/*", wholetext=True)
    return f.select(F.regexp_extract(F.input_file_name(), r"([a-z]+)\.[^/]*$", 1).alias("platform"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), F.col("value").alias("payload"))


def first_of(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def _item(title, summary, url, hot, interactions: dict[str, Column] | None = None) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (interactions or {}).items()]) if interactions else F.array().cast("array<struct<key:string,value:string>>")
    kept = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull() & ~e["value"].isin("", "0")))
    return F.struct(title.alias("title"), summary.alias("summary"), url.alias("url"), hot.cast("double").alias("hot_value"), kept.alias("interactions"))


def _weibo(p: Column) -> Column:
    j = F.from_json(p, "ok int, data struct<realtime:array<struct<word:string,word_scheme:string,num:double,icon_desc:string,icon_desc_color:string>>>")
    url = lambda w: F.concat(F.lit("https://s.weibo.com/weibo?q="), F.url_encode(w))
    made = F.transform(j["data"]["realtime"], lambda x: _item(x["word"], first_of(x["word_scheme"], x["word"]), url(x["word"]), x["num"], {"hot_value": x["num"], "icon_desc": x["icon_desc"], "icon_desc_color": x["icon_desc_color"]}))
    return F.when(j["ok"] == 1, made)


def zhihu_url(t: Column) -> Column:
    """The page of a question or article by its type and id; else by what addresses it has."""
    raw = first_of(t["origin"]["url"], t["link"]["url"], t["url"])
    by_id = F.when(t["type"] == "question", F.concat(F.lit("https://www.zhihu.com/question/"), t["id"])).when(t["type"] == "article", F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), t["id"]))
    return F.coalesce(F.when(F.nullif(t["id"], F.lit("")).isNotNull(), by_id), F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit("https://www.zhihu.com"), raw)).otherwise(raw))


def _zhihu(p: Column) -> Column:
    """From the JSON answer, else from the state that the page embeds."""
    target = "struct<title:string,excerpt:string,content:string,id:string,type:string,url:string,origin:struct<url:string>,link:struct<url:string>,answer_count:long,follower_count:long,comment_count:long,hot_value:long,voteup_count:long>"
    rows = f"array<struct<detail_text:string,target:{target}>>"
    state = F.from_json(embedded_object(p, r"window\.__INITIAL_STATE__"), f"topstory struct<hotList:{rows}>, hotList {rows}")
    data = F.coalesce(F.from_json(p, f"data {rows}")["data"], state["topstory"]["hotList"], state["hotList"])
    counts = ("answer_count", "follower_count", "comment_count", "hot_value", "voteup_count")

    def one(x: Column) -> Column:
        title = F.trim(x["target"]["title"])
        said = first_of(F.trim(x["target"]["excerpt"]), F.trim(x["target"]["content"]), title)
        return _item(title, said, zhihu_url(x["target"]), hot_text_number(x["detail_text"]), {c: x["target"][c] for c in counts})

    return F.transform(data, one)


def _toutiao(p: Column) -> Column:
    """From the JSON answer, else from the first list of the state that the page embeds."""
    listed = F.concat(F.lit('{"data": '), first_list(embedded_object(p, "__SSR_HYDRATED_DATA__")), F.lit("}"))
    p = F.when(p.rlike(r"(?s)^\s*[\[{]"), p).otherwise(F.coalesce(listed, p))
    # names that differ in case only can't be fields of one struct: the two spellings are read one after the other
    upper = F.from_json(p, "data array<struct<Title:string,Url:string,HotValue:string,desc:string>>")["data"]
    lower = F.from_json(p, "data array<struct<title:string,word:string,url:string,link:string,hot_value:string,hot:string,hot_score:string,desc:string>>")["data"]
    return F.zip_with(upper, lower, lambda u, v: (lambda t: _item(t, first_of(v["desc"], t), first_of(u["Url"], v["url"], v["link"]), unit_number(first_of(u["HotValue"], v["hot_value"], v["hot"], v["hot_score"]))))(first_of(u["Title"], v["title"], v["word"])))


def without_adverts(p: Column) -> Column:
    """A page without the list entries that are adverts: by their class, or by what they hold."""
    entry = lambda x: F.regexp_extract(x, r"(?is)^(<li\b.*?</li>)", 1)
    advert = lambda x: entry(x).rlike(r"(?is)^<li\b[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?ad(?:\s[^\"']*)?[\"']|<ins\b[^>]*sinaads")
    pieces = F.split(p, r"(?i)(?=<li\b)")
    return F.array_join(F.transform(pieces, lambda x: F.when(advert(x), F.regexp_replace(x, r"(?is)^<li\b.*?</li>", "")).otherwise(x)), "")


def _sina(p: Column) -> Column:
    row = "array<struct<title:string,url:string,intro:string,media_name:string,comment_count:string,read_count:string>>"
    j = F.from_json(p, f"data struct<news:{row}>, result struct<data:{row}>")
    url = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(F.lit("https://news.sina.com.cn"), u)).otherwise(u)
    api = F.transform(F.coalesce(j["data"]["news"], j["result"]["data"]), lambda x: _item(x["title"], first_of(x["intro"], x["title"]), url(x["url"]), F.lit(None), {"comment_count": x["comment_count"], "read_count": x["read_count"]}))
    return F.coalesce(api, F.transform(links(without_adverts(p)), lambda a: _item(a["text"], a["text"], url(a["href"]), F.lit(0.0))))


def _baidu(p: Column) -> Column:
    j = F.from_json(p, "data struct<cards:array<struct<content:array<struct<word:string,url:string,hotScore:string,desc:string>>>>>")
    url = lambda u: F.when(u.startswith("/"), F.concat(F.lit("https://www.baidu.com"), u)).otherwise(u)
    return F.transform(F.try_element_at(j["data"]["cards"], F.lit(1))["content"], lambda x: _item(x["word"], first_of(x["desc"], x["word"]), url(x["url"]), F.coalesce(x["hotScore"].try_cast("double"), F.lit(0.0)), {"hot_score": x["hotScore"]}))


def links(p: Column) -> Column:
    """Links of a page, as (href, text)."""
    found = F.regexp_extract_all(p, F.lit(r"(?is)(<a\b[^>]*href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1).alias("href"), html_text(a).alias("text")))


def _netease(p: Column) -> Column:
    block = F.regexp_extract(p, r"(?is)class=[\"'][^\"']*mod_hot_rank[^\"']*[\"'][^>]*>(.*?)</(?:ul|ol|div)>", 1)
    rows = F.regexp_extract_all(block, F.lit(r"(?is)(<li\b.*?</li>)"), F.lit(1))
    made = F.transform(rows, lambda li: _item(first_of(F.regexp_extract(li, r"(?is)title=[\"']([^\"']+)[\"']", 1), F.try_element_at(links(li), F.lit(1))["text"]), F.lit(""), F.try_element_at(links(li), F.lit(1))["href"], digits_number(F.regexp_extract(li, r"(?is)<span[^>]*>(.*?)</span>", 1))))
    return F.filter(made, lambda x: x["title"].isNotNull())


def _hupu(p: Column, limit: int) -> Column:
    """The two lists for basketball and football, each to the limit; titles of five characters at least, addresses once."""

    def section(name: str) -> Column:
        body = F.regexp_extract(p, rf"(?s){name}(.*?)(?=篮球热榜|足球热榜|$)", 1)
        made = F.transform(links(body), lambda a: _item(a["text"], a["text"], F.when(a["href"].startswith("/"), F.concat(F.lit("https://bbs.hupu.com"), a["href"])).otherwise(a["href"]), F.coalesce(F.regexp_extract(a["text"], r"(\d+)(?:亮|评论|热度)", 1).try_cast("double"), F.lit(0.0))))
        return F.slice(F.filter(made, lambda x: F.length(x["title"]) >= 5), 1, limit)

    both = F.concat(section("篮球热榜"), section("足球热榜"))
    urls = F.transform(both, lambda x: x["url"])
    return F.filter(both, lambda x, k: F.array_position(urls, x["url"]) == k + 1)


def doc_id(url: Column) -> Column:
    return first_of(F.regexp_extract(url, r"/article/([A-Za-z0-9]+)\.html", 1), F.regexp_extract(url, r"/video/([A-Za-z0-9]+)\.html", 1))


def items(raw: DataFrame, limit: int = 30) -> DataFrame:
    """platform, title, summary, url, hot_value, interactions: `limit` rows of each platform at most (of hupu, of each list)."""
    p = F.col("payload")
    parsed = {"weibo": _weibo(p), "zhihu": _zhihu(p), "toutiao": _toutiao(p), "sina": _sina(p), "netease": _netease(p), "baidu": _baidu(p)}
    rows = F.when(F.col("platform") == "hupu", _hupu(p, limit).cast(ITEM))
    for name, made in parsed.items():
        rows = rows.when(F.col("platform") == name, F.slice(made.cast(ITEM), 1, limit))
    return raw.where("status = 'success'").select("platform", F.explode(rows).alias("i")).select("platform", "i.*").where(F.coalesce(F.trim("title"), F.lit("")) != "")


def enrich(found: DataFrame, run_id: str, fetched_at: Column) -> DataFrame:
    """What a load adds: hashes, the key of the run, the period, the first status; noise is left out."""
    url = F.coalesce("url", F.lit(""))
    h = F.md5(url)
    return found.where(~is_noise(F.col("title"), url)).withColumns({
        "url_hash": h, "content_hash": F.md5(F.concat("title", F.coalesce("summary", F.lit("")))), "dedup_key": F.concat_ws(":", "platform", h, F.lit(run_id)), "run_id": F.lit(run_id),
        "fetched_at": fetched_at, "period": period_label(fetched_at), "merge_status": F.lit("pending_event_merge"), "occurrence_count": F.lit(1),
    })


def run_report(raw: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each platform, and how its run went: items, and of these those that are noise and those that are kept."""
    noise = is_noise(F.col("title"), F.coalesce("url", F.lit("")))
    n = found.groupBy("platform").agg(F.count("*").alias("items"), F.count_if(noise).alias("skipped"), F.count_if(~noise).alias("kept"))
    return raw.select("platform", "status", "error").join(n, "platform", "left").fillna(0, ["items", "skipped", "kept"])


def run_row(report: DataFrame, run_id: str, started_at: Column, finished_at: Column) -> DataFrame:
    """The run's own row: success if every platform answered, failed if none did, else partial; and the sums over platforms."""
    good, every = F.count_if(F.col("status") == "success"), F.count("*")
    status = F.when(good == every, "success").when(good == 0, "failed").otherwise("partial")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items", "skipped", "kept")]
    failed = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("status") != "success", F.struct("platform", F.coalesce("error", F.lit(""))))))))
    return report.agg(status.alias("status"), every.alias("platforms"), good.alias("answered"), *sums, failed.alias("errors")).select(F.lit(run_id).alias("run_id"), "*", started_at.alias("started_at"), finished_at.alias("finished_at"))


def dump(found: DataFrame, path: str) -> None:
    """A text dump, one folder for each platform."""
    found.select("platform", F.to_json(F.struct("title", "summary", "url", "hot_value")).alias("value")).write.mode("overwrite").partitionBy("platform").text(path)
