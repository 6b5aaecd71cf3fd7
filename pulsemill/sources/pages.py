"""Reading pages in the JVM: state that scripts embed as JSON, balanced elements, articles; and the second round of fetching."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_title, let, strip

DETAIL = "url string, status string, error string, payload string"


def balanced(t: Column, opening: str, closing: str, filled: bool = False) -> Column:
    """The text from the first opening bracket to the one that closes it, brackets inside JSON strings aside; null if it
    isn't closed. filled: from the first one that holds something."""
    return let(t, lambda x: _balanced(x, opening, closing, filled))


def _balanced(t: Column, opening: str, closing: str, filled: bool) -> Column:
    # same length, but without escapes: a string then ends at the next quote
    flat = F.replace(F.replace(t, F.lit("\\\\"), F.lit("\x01\x01")), F.lit('\\"'), F.lit("\x01\x01"))
    flat = F.regexp_replace(flat, rf"\{opening}(\s*)\{closing}", r"($1)") if filled else flat
    tokens = F.regexp_extract_all(flat, F.lit(r'("[^"]*+"|[\[\]{}]|[^"\[\]{}]++|")'), F.lit(1))

    def step(s: Column, x: Column) -> Column:
        opens, closes, over = x == opening, (x == closing) & (s["depth"] > 0), s["end"] > 0
        depth = s["depth"] + F.when(over, 0).when(opens, 1).when(closes, -1).otherwise(0)
        start = F.when(opens & (s["start"] == 0), s["at"] + 1).otherwise(s["start"])
        end = F.when(~over & closes & (s["depth"] == 1), s["at"] + 1).otherwise(s["end"])
        return F.struct((s["at"] + F.length(x)).alias("at"), depth.alias("depth"), start.alias("start"), end.alias("end"))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "depth", "start", "end")])
    return F.transform(F.array(F.aggregate(tokens, zero, step)), lambda s: F.when(s["end"] > 0, F.substring(t, s["start"], s["end"] - s["start"] + 1)))[0]


def embedded_object(page: Column, name: str) -> Column:
    """The JSON object that a script of the page assigns to a name, where it parses."""
    found = balanced(F.regexp_extract(page, rf"(?s){name}\s*=\s*(\{{.*)$", 1), "{", "}")
    return let(found, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))  # nothing follows what is balanced


def first_list(json: Column) -> Column:
    """The first list of a JSON text, in its order, that isn't empty."""
    return balanced(json, "[", "]", filled=True)


def element(page: Column, name: str, tag: str = "div") -> Column:
    """The first element with this class or id, with what it holds but scripts and styles; null if there is none or it isn't closed."""
    page = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    rest = F.regexp_extract(page, rf"(?is)(<{tag}\b[^>]*\b(?:class|id)\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"'].*)$", 1)
    pieces = F.filter(F.split(rest, rf"(?i)(?=</?{tag}\b)"), lambda x: x != "")

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x.rlike(rf"(?i)^<{tag}\b"), 1).when(x.rlike(rf"(?i)^</{tag}\b"), -1).otherwise(0)
        ends = ~s["done"] & (depth == 0)
        own = F.when(ends, F.regexp_extract(x, r"^(</[^>]*>)", 1)).otherwise(x)
        return F.struct(F.when(s["done"], s["depth"]).otherwise(depth).alias("depth"), (s["done"] | ends).alias("done"), F.when(s["done"], s["out"]).otherwise(F.concat(s["out"], own)).alias("out"))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("out"))
    return F.transform(F.array(F.aggregate(pieces, zero, step)), lambda s: F.when(s["done"], s["out"]))[0]


def element_text(html: Column) -> Column:
    """The texts of an element, each without blanks at its ends, put together."""
    said = F.array_join(F.transform(F.split(html, r"<[^>]*>"), strip), "")
    for mark, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        said = F.replace(said, F.lit(mark), F.lit(char))
    return F.regexp_replace(said, r"\s+", " ")


# What an article's text says besides.
BESIDES = [r"（原标题：.*?）", r"分享至.*?朋友圈"]


def article(page: Column) -> Column:
    """A struct (title, summary, published_at): the first 200 characters of the article's body, or of the content element, and when
    it was published, as text; empty where the page doesn't tell."""
    def said(name: str) -> Column:
        t = element_text(element(page, name))
        for words in BESIDES:
            t = F.regexp_replace(t, words, "")
        return F.nullif(strip(F.left(t, F.lit(200))), F.lit(""))

    meta = F.regexp_extract(page, r"(?is)<meta\b[^>]*property\s*=\s*[\"']article:published_time[\"'][^>]*>", 0)
    told = F.nullif(F.regexp_extract(meta, r"(?is)content\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    line = F.regexp_extract(element_text(element(page, "post_info")), r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    return F.struct(html_title(page).alias("title"), F.coalesce(said("post_body"), said("content"), F.lit("")).alias("summary"), F.coalesce(told, line, F.lit("")).alias("published_at"))


def get(url: str, tries: int = 3, wait: float = 2.0, timeout: float = 10.0) -> tuple[str | None, str | None]:
    """(text, None) or (None, error) of an address that is tried some times, with growing pauses."""
    import urllib.request

    error = "no address"
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                if text := r.read().decode("utf-8", "replace"):
                    return text, None
            error = "empty answer"
        except Exception as x:  # the error is the answer
            error = f"{type(x).__name__}: {x}"[:500]
        if k + 1 < tries:
            time.sleep(min(10.0, wait * 2**k))
    return None, error


def fetch_details(found: DataFrame, url: str = "url", per_task: int = 20, tries: int = 3, wait: float = 2.0, timeout: float = 10.0) -> DataFrame:
    """The second round: the pages that the first round's items link to, each address once, as rows like those of the first
    round. A task has about `per_task` addresses, so a lost one asks few again; a page that fails is a row with its error."""
    links = found.select(F.col(url).alias("url")).where("url IS NOT NULL AND url <> ''").distinct()
    tasks = max(1, -(-links.count() // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column("url").to_pylist():
                text, error = get(u, tries, wait, timeout)
                row = {"url": u, "status": "success" if error is None else "failed", "error": error, "payload": text}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.string()) for c in ("url", "status", "error", "payload")]))

    return links.repartition(tasks, "url").mapInArrow(run, DETAIL)


def with_details(found: DataFrame, details: DataFrame) -> DataFrame:
    """Items with the summary of their page and when it was published; items whose page is missing stay as they are."""
    d = details.where("status = 'success'").select("url", article(F.col("payload")).alias("__a"))
    out = found.drop("published_at").join(d, "url", "left")
    out = out.withColumn("published_at", F.try_to_timestamp(F.left("__a.published_at", F.lit(19))).cast("timestamp_ntz"))
    return out.withColumn("summary", F.coalesce(F.nullif("__a.summary", F.lit("")), "summary")).drop("__a")
