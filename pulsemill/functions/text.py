"""Text functions, Column to Column: all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CATEGORIES, HUPU_BIAS, KEYWORDS, MEDIUM, NOISE_PARTS, NOISE_PREFIX, NOISE_TITLES, NOISE_URL, PLATFORM_ALIASES, RULE_LEAST, STOPWORDS, STRONG

FULL = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = " " + "".join(map(chr, range(0x21, 0x7F)))
# Chinese digits.
DIGITS_CN, DIGITS = "〇零一二两三四五六七八九", "001223456789"


def array_of(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def normalize_title(c: Column) -> Column:
    """Half-width, Arabic digits, no punctuation, single spaces, lower case; null counts as empty."""
    t = F.translate(F.coalesce(c, F.lit("")), FULL + DIGITS_CN, HALF + DIGITS)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: long chains would be too long to compile."""
    return F.transform(F.array(value), use)[0]


def ngrams(c: Column, n: int = 2) -> Column:
    """The distinct character n-grams, in order; none for texts shorter than n."""
    made = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    return let(c, lambda t: F.when(F.length(t) >= n, F.array_distinct(made(t))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def is_noise(title: Column, url: Column) -> Column:
    compact = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", "")
    more = compact.contains(NOISE_PREFIX) & reduce(lambda a, b: a | b, [compact.contains(p) for p in NOISE_PARTS])
    return (compact == "") | compact.isin(NOISE_TITLES) | more | F.coalesce(url, F.lit("")).contains(NOISE_URL)


def query_keywords(c: Column, most: int = 8) -> Column:
    """ASCII tokens, then runs of Chinese characters (longer ones as 4-, 3- and 2-grams), without stopwords; the first `most`
    distinct ones, or else the whole query."""
    t = F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")
    for w in sorted(STOPWORDS, key=lambda w: (-len(w), w)):
        t = F.replace(t, F.lit(w), F.lit(" "))
    ascii_tokens = F.regexp_extract_all(t, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(t, F.lit("([一-鿿]{2,})"), F.lit(1))
    grams = lambda s, n: F.transform(F.sequence(F.lit(0), F.length(s) - n), lambda i: F.substring(s, i + 1, F.lit(n)))
    parts = F.flatten(F.transform(runs, lambda s: F.when(F.length(s) <= 4, F.array(s)).otherwise(F.concat(grams(s, 4), grams(s, 3), grams(s, 2)))))
    words = F.filter(F.array_distinct(F.concat(ascii_tokens, parts)), lambda w: ~F.array_contains(array_of(STOPWORDS), w))
    whole = F.when(F.trim(c) != "", F.array(F.trim(c))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) > 0, F.slice(words, 1, most)).otherwise(whole)


def platforms_in(c: Column) -> Column:
    """Platforms whose alias stands in the text, in the order of the aliases."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c.contains(a), F.lit(p)) for a, p in PLATFORM_ALIASES.items()])))


def rule_scores(text: Column, on_hupu: Column) -> dict[str, Column]:
    found = {}
    for cat, (strong, medium) in KEYWORDS.items():
        n = lambda words: F.size(F.filter(array_of(words), lambda w: F.contains(text, w))).cast("double")
        found[cat] = n(strong) * STRONG + n(medium) * MEDIUM + (F.when(on_hupu, HUPU_BIAS).otherwise(0.0) if cat == "sports_esports" else F.lit(0.0))
    return found


def rule_category(text: Column, on_hupu: Column) -> tuple[Column, Column]:
    """(category, confidence); the confidence is relative to the best score, so 1, or 0 where nothing was found."""
    s = rule_scores(text, on_hupu)
    top = F.greatest(*s.values())
    cat = reduce(lambda c, k: c.when(s[k] == top, k), list(CATEGORIES)[1:], F.when(s["entertainment"] == top, "entertainment"))
    conf = F.when(top > 0, 1.0).otherwise(0.0)
    return F.when(conf < RULE_LEAST, "current_affairs").otherwise(cat), conf


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 2).cast("bigint")


def truncate_to_tokens(c: Column, most: int | Column, keep_start: bool = True) -> Column:
    """Texts over the budget are cut to 0.9 of their share of characters, with an ellipsis."""
    most = F.lit(most) if isinstance(most, int) else most
    n = F.floor(F.length(c) * (most / token_estimate(c)) * 0.9).cast("int")
    cut = F.concat(F.substring(c, F.lit(1), n), F.lit("...")) if keep_start else F.concat(F.lit("..."), F.right(c, n))
    return F.when(token_estimate(c) <= most, c).otherwise(cut)


def strip_think(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


#: What a text loses at its ends.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def after_think(c: Column) -> Column:
    """What follows the closing tag, or else what stands before the opening one; the text as it is where there is neither."""
    part = lambda t, pattern: let(F.regexp_extract(t, pattern, 1), lambda x: F.when(x != "", strip(x)))
    found = lambda t: F.coalesce(part(t, r"(?is)</think>\s*(.+)"), part(t, r"(?is)^(.+?)<think>"), t)
    return let(c, lambda t: F.when(F.contains(t, F.lit("<")), found(t)).otherwise(t))


def unit_number(c: Column) -> Column:
    """Numbers with 万, w (ten thousand) or 亿 (a hundred million); 0 for others."""
    t = F.trim(F.coalesce(c, F.lit("")))
    n = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.when(F.contains(t, F.lit("亿")), 1e8).when(t.rlike("[万wW]"), 1e4).otherwise(1.0)
    return F.coalesce(n * unit, F.lit(0.0))


def hot_text_number(c: Column) -> Column:
    """Like unit_number for texts such as 166万热度, but null where there is no number."""
    t = F.trim(F.replace(c, F.lit("热度"), F.lit("")))
    return F.when(t.endswith("万"), F.regexp_replace(t, "万$", "").try_cast("double") * 1e4).otherwise(t.try_cast("double"))


def digits_number(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "").try_cast("double")


def days_hours(hours: Column) -> Column:
    h = F.greatest(F.coalesce(hours, F.lit(0.0)), F.lit(0.0))
    return F.concat(F.floor(h / 24).cast("string"), F.lit("天"), F.floor(h % 24).cast("string"), F.lit("小时"))


def ui_length(hours: Column) -> Column:
    """As the explorer page shows it: whole hours, rounded half up."""
    r = F.floor(hours + 0.5)
    d, h = F.floor(r / 24).cast("string"), (r % 24).cast("string")
    return F.when(r < 2, "低于2小时").when(r < 24, F.concat(h, F.lit("小时"))).when(r % 24 == 0, F.concat(d, F.lit("天"))).otherwise(F.concat(d, F.lit("天"), h, F.lit("小时")))


def embedding_input(title: Column, summary: Column) -> Column:
    """What is embedded of an item: its normalised title and its summary."""
    return F.concat(normalize_title(F.coalesce(title, F.lit(""))), F.lit(" "), F.coalesce(summary, F.lit("")))


def span_text(hours: Column) -> Column:
    """A span of hours, as the classifier is told: days only where there are some, unknown for null."""
    d, h = F.floor(hours / 24), F.floor(hours - 24 * F.floor(hours / 24))
    some = F.concat(F.when(d > 0, F.concat(d.cast("string"), F.lit("天"))).otherwise(""), h.cast("string"), F.lit("小时"))
    return F.when(hours.isNull(), "未知").otherwise(some)


def ui_days_hours(hours: Column) -> Column:
    """As the home page shows it: whole hours, rounded half up, with days only where there are some."""
    r = F.greatest(F.floor(hours + 0.5), F.lit(0))
    return F.when(hours.isNull() | F.isnan(hours), "—").otherwise(span_text(r))


# How users ask for all time.
FORCE_ALL = r"(不要|不需要|去掉|取消).*(近期|最近|近来|最新)|全部时间|所有时间|不限时间|不限制时间|全量|不限范围|全部范围"
# How users name a recent span, with its days.
RECENT = [(r"(近一周|最近7天|近7天|本周)", 7), (r"(近两周|最近14天|近14天)", 14), (r"(近一月|最近30天|近30天|本月)", 30), (r"(近三月|最近90天|近90天)", 90), (r"(近半年|最近180天|近180天)", 180)]
# Words that only refine the question before.
MODIFIERS = r"(不要|不需要|去掉|取消|改为|改成|全部|所有|不限|不限制|近期|最近|近来|最新|时间|范围|只要|只看|仅|只|的|，|,|。|\s)"


def followup(c: Column) -> dict[str, Column]:
    """Whether a query asks for all time, for how many recent days, and whether it only refines the one before."""
    days = reduce(lambda w, x: w.when(c.rlike(x[0]), x[1]), RECENT[1:], F.when(c.rlike(RECENT[0][0]), RECENT[0][1]))
    rest = F.regexp_replace(c, MODIFIERS, "")
    return {"all_time": c.rlike(FORCE_ALL), "recent_days": days, "refine_only": ~rest.rlike(r"[A-Za-z0-9]{3,}|[一-鿿]{2,}")}


def html_text(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1))


def interaction_text(json: Column) -> Column:
    """Reposts, comments and likes that are set, for readers."""
    # The names of the three counts.
    names = {"repost": "转发", "comment": "评论", "like": "点赞"}
    parts = []
    for k, n in names.items():
        v = F.get_json_object(json, f"$.{k}")
        parts.append(F.when(~v.isin("", "0", "null", "false"), F.concat(F.lit(n), v)))
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def tools_used(tools: Column) -> Column:
    """What follows an answer: a blank line and the distinct tools in alphabetical order, or that there were none."""
    names = F.array_join(F.array_sort(F.array_distinct(tools)), ", ")
    return F.concat(F.lit("\n\n（本次使用工具："), F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, names).otherwise("无"), F.lit("）"))


def footer_tool(answer: Column) -> Column:
    """Of the tools that an answer's footer names, the one that a question may refine: topic_query before topic_search."""
    named = F.transform(F.split(F.regexp_extract(answer, r"本次使用工具：([^)）\n]+)", 1), ","), F.trim)
    return F.when(F.array_contains(named, "topic_query"), "topic_query").when(F.array_contains(named, "topic_search"), "topic_search").otherwise("")
