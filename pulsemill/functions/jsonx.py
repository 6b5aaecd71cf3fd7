"""JSON and map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_think, let, strip

INTERACTIONS = ["repost", "comment", "like", "view", "favorite"]


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else. Spark's parser stops after the first value, whatever follows; so the
    text has to be the only value of a list and of an object, which close where it ends."""
    parses = lambda *parts: F.try_parse_json(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).isNotNull()
    may = c.rlike(r"^[ \t\n\r]*[\[{\"0-9tfn-]")
    return F.coalesce(may & parses("[", c, "]") & parses('{"":', c, "}"), F.lit(False))


def lenient_json(c: Column) -> Column:
    """The text itself where it is JSON, else its first {...} where that is, else null."""
    part = lambda t: let(F.regexp_extract(t, r"(?s)\{.*\}", 0), lambda p: F.when((p != "") & is_json(p), p))
    return let(c, lambda t: F.coalesce(F.when(is_json(t), t), F.when(F.contains(t, F.lit("{")), part(t))))


def engagement(json: Column) -> Column:
    """The first of three keys that is set and not zero, as a whole number."""
    value = lambda k: (lambda v: F.when(~v.isin("", "0", "null", "false"), v))(F.get_json_object(json, f"$.{k}"))
    return F.coalesce(*[value(k) for k in ("hot_score", "engagement", "interactions")]).try_cast("bigint")


def interaction_total(json: Column, keys: list[str] | None = None) -> Column:
    total = F.lit(0).cast("bigint")
    for k in keys or INTERACTIONS:
        total = total + F.coalesce(F.get_json_object(json, f"$.{k}").try_cast("bigint"), F.lit(0))
    return total


# What readers see where a model's answer holds no summary.
NO_CONTENT, NO_FIELD = "摘要生成失败：LLM返回空内容", "摘要解析失败：Missing summary field"
EMBEDDED, SHORT = 50, 20  # a summary found inside a text has to be longer; cleaned text that is shorter isn't used


def broken_string(c: Column, field: str) -> Column:
    """The value of a field in JSON that doesn't parse, up to the last quote that leaves the quotes inside in pairs, unescaped;
    null where none is. It looks at the field's first place that has a value."""
    rest = F.regexp_extract(c, rf'(?s)"{field}"\s*:\s*"([^"].*)$', 1)

    def cut(r: Column) -> Column:
        quotes = F.length(r) - F.length(F.replace(r, F.lit('"'), F.lit("")))
        value = F.call_function("substring_index", r, F.lit('"'), (quotes - F.when(quotes % 2 == 0, 1).otherwise(0)).cast("int"))
        return F.when(quotes > 0, F.replace(F.replace(value, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))

    return let(rest, cut)


def summary_field(c: Column) -> Column:
    """The summary of a model's answer, which may be broken. In turn: the answer's own JSON; JSON inside a longer text, if its
    summary has over 50 characters; the field's text in JSON that was cut off; the text without JSON's marks; the text."""
    whole = lambda t: F.when(is_json(t), F.coalesce(F.get_json_object(t, "$.summary"), F.lit(NO_FIELD)))

    def inside(t: Column) -> Column:
        told = lambda pattern: let(F.regexp_extract(t, pattern, 0), lambda j: F.when((j != "") & is_json(j), F.get_json_object(j, "$.summary")))
        found = F.coalesce(told(r'(?s)\{[^{}]*"summary"[^{}]*\}'), told(r"(?s)\{.+\}"))
        return let(found, lambda x: F.when(F.length(x) > EMBEDDED, x))

    def cleaned(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, r'^\s*\{\s*"summary"\s*:\s*"', ""), r'"\s*[,}]?\s*$', "")
        return let(strip(bare), lambda x: F.when(F.length(x) < SHORT, strip(t)).otherwise(x))

    got = lambda a: let(after_think(a), lambda t: F.coalesce(whole(t), inside(t), broken_string(t, "summary"), cleaned(t)))
    return let(c, lambda a: F.when(F.coalesce(a, F.lit("")) == "", NO_CONTENT).otherwise(got(a)))


def category_answer(c: Column, categories: list[str]) -> tuple[Column, Column]:
    """(category, confidence) of a model's answer: from JSON, confidence clamped to 0..1; else a category named in the text, 0.5."""
    j = lenient_json(c)
    cat, conf = F.get_json_object(j, "$.category"), F.get_json_object(j, "$.confidence").try_cast("double")
    named = F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(k)) for k in categories])
    ok = cat.isin(categories)
    return F.when(ok, cat).otherwise(named), F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(conf, F.lit(0.5))))).when(named.isNotNull(), 0.5)


def resolve_target(raw: Column, candidates: Column) -> Column:
    """The candidate that a model's answer means: its id, or its place in the list from 1; else null."""
    n = F.regexp_extract(raw, r"(\d+)", 1).try_cast("bigint")
    return F.when(F.array_contains(candidates, n), n).when(n >= 1, F.try_element_at(candidates, F.when(n <= F.size(candidates), n).otherwise(F.size(candidates) + 1).cast("int")))


def incremental_answer(c: Column) -> tuple[Column, Column]:
    """The fields of incremental_struct."""
    got = incremental_struct(c)
    return got["needs"], got["summary"]


def incremental_struct(c: Column) -> Column:
    """A struct (needs, summary) of a model's answer about a topic's new items: a JSON object, alone or within a text, asks for
    an update unless it says otherwise; of a broken one the summary counts; anything else asks for none."""
    def told(t: Column, j: Column) -> Column:
        mended = lambda part: F.replace(F.replace(part, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
        broken = let(F.regexp_extract(t, r'"updated_summary"\s*:\s*"([^"]+)"', 1), lambda part: F.struct((part != "").alias("needs"), mended(part).alias("summary")))
        needs, summary = F.coalesce(F.get_json_object(j, "$.needs_update") != "false", F.lit(True)), F.coalesce(F.get_json_object(j, "$.updated_summary"), F.lit(""))
        return F.when(j.isNotNull(), F.struct(needs.alias("needs"), summary.alias("summary"))).otherwise(broken)

    object_in = lambda t: let(lenient_json(t), lambda j: F.when(j.startswith("{"), j))
    return let(after_think(F.coalesce(c, F.lit(""))), lambda t: let(object_in(t), lambda j: told(t, j)))


def first_number(json: Column) -> Column:
    """The first value of a JSON object that reads as a finite number; empty texts, null and false read as 0, true as 1."""
    values = F.map_values(F.from_json(json, "map<string,string>"))
    number = lambda v: F.when(v.isNull() | (F.trim(v) == "") | (v == "false"), 0.0).when(v == "true", 1.0).otherwise(F.trim(v).try_cast("double"))
    finite = F.filter(F.transform(values, number), lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))
    return F.try_element_at(finite, F.lit(1))


def merged_intent(base: Column, override: Column) -> Column:
    """Structs (intent, keywords, platforms, since, until): what the override names wins, field by field; empty lists and
    texts name nothing, and blank words are left out."""
    words = lambda k: F.when(F.size(override[k]) > 0, F.filter(override[k], lambda w: F.trim(w) != "")).otherwise(base[k]).alias(k)
    one = lambda k: F.coalesce(F.nullif(override[k], F.lit("")), base[k]).alias(k)
    return F.struct(one("intent"), words("keywords"), words("platforms"), one("since"), one("until"))
