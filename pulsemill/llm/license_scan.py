"""License scans: an exact containment join of text blocks with license templates, in DataFrame operations only.

A text block is a line of a document, or what surrounds a line end: the last words of a line and the words that follow, as
many of each as hold a notice of the longest template, so that hard-wrapped notices lie in one block. Its tokens are its
distinct words. A template matches every block that holds at least its threshold of its distinct words. Short templates, in
which one word tells licenses or versions apart, have the threshold 1. The join is exact and never compares all pairs:

* one narrow pass over the texts writes, for each document, its word count, the places of base phrases, and of each block
  that holds enough template words to match anything (length filter) just these words; documents that as a whole hold too
  few words of every template have no such blocks;
* template words are ordered by how many of these blocks hold them, rarest first;
* a template of n words that needs o of them is indexed by its prefix, its n - o + 1 rarest words: a block without any of
  them can't match, and only blocks with one of them are compared with just the templates that it stands for;
* a match at place i of the template and j of the block's template words leaves at most 1 + min(what follows either)
  common words (positional filter); survivors are verified.

Templates are a parameter. They are joined CHUNK at a time, so the index and the template words, the only things broadcast,
are of bounded size however many there are. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased.

Besides, base phrases are found wherever their words stand consecutively, across lines and punctuation.

Edge cases: null and empty texts have no words and no labels, score 0. Very long texts are scanned whole. A block that
matches several templates gets each label once, with the largest containment. Repeated rows each get their result. Rows with
a null id are kept: rows are matched by a number given when the scan is written. Extra columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

CHUNK = 1000  # templates that are joined at a time
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Fixed values: (label, words of the notice, share of its distinct words that a block must hold).
TEMPLATES = [
    ("mit", "released under the mit license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.85),
    ("apache-2", "licensed under the apache license version 2 0", 1.0),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.85),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 1.0),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0", 1.0),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", 0.85),
    ("all-rights-reserved", "copyright all rights reserved", 1.0),
]


def needed(notice: str, threshold: float) -> int:
    """How many of the notice's distinct words a block must hold."""
    return math.ceil(threshold * len(set(notice.split())) - 1e-9)


def words_around(templates: list[tuple[str, str, float]]) -> int:
    """How many words on each side of a line end hold the longest notice, with what a match may have between its words."""
    return max(1, *(math.ceil(len(notice.split()) / threshold) - 1 for _, notice, threshold in templates))


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() is far faster than translate() and differs for other letters only, which can't make a
    word equal to an ASCII word or move a word's ends; but for the Kelvin sign, which becomes a k."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit("\u212a")), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, NO_WORD), "")


def _array(items: list) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _places(lines: Column, text: Column, phrase: str) -> Column:
    """Where the phrase's words stand, from 0. Only texts that hold all of them pay for it."""
    p = phrase.split(" ")

    def places(words: Column) -> Column:
        def here(i: Column) -> Column:
            same = F.lit(True)
            for k, w in enumerate(p):
                same = same & (F.element_at(words, i + (k + 1)) == w)
            return same

        none = F.array().cast("array<int>")
        return F.when(F.size(words) < len(p), none).otherwise(F.filter(F.sequence(F.lit(0), F.size(words) - len(p)), here))

    held = F.lit(True)
    for w in p:
        held = held & F.contains(text, F.lit(w))
    # the words are joined once for each text, not once for each place: hence the array of one
    return F.flatten(F.transform(F.when(held, F.array(F.flatten(lines))).otherwise(F.array().cast("array<array<string>>")), places))


def _near(words: Column, lines: Column, templates: list[tuple[str, str, float]]) -> Column:
    """Blocks (line, tokens) that hold enough template words to match anything; `lines` are the numbered lines with a word
    and the first words of each."""
    vocabulary = _array(sorted({w for _, notice, _ in templates for w in notice.split()}))
    least, reach = min(needed(n, t) for _, n, t in templates), words_around(templates)
    sets = F.array(*[F.struct(_array(sorted(set(n.split()))).alias("words"), F.lit(needed(n, t)).alias("need")) for _, n, t in templates])

    def around(b: Column, k: Column) -> Column:
        tail = F.slice(b["words"], F.greatest(F.lit(1), F.size(b["words"]) - (reach - 1)), F.lit(reach))
        heads = F.transform(F.slice(lines, k + 2, F.lit(reach)), lambda x: x["words"])  # each of these lines has a word
        return F.concat(tail, F.slice(F.flatten(F.transform(heads, lambda x: F.slice(x, 1, reach))), 1, reach))

    def tokens(x: Column) -> Column:
        return F.array_intersect(x, vocabulary)

    within = F.transform(lines, lambda b: F.struct(b["line"].alias("line"), tokens(b["words"]).alias("tokens")))
    wrapped = F.transform(lines, lambda b, k: F.struct(b["line"].alias("line"), tokens(around(b, k)).alias("tokens")))
    possible = F.filter(F.concat(within, wrapped), lambda b: F.size(b["tokens"]) >= least)
    # an array of one: the words of the text are looked up once, not once for each template
    enough = F.exists(F.array(tokens(words)), lambda held: F.exists(sets, lambda t: F.size(F.array_intersect(held, t["words"])) >= t["need"]))
    return F.when(enough, possible).otherwise(F.array().cast("array<struct<line:int,tokens:array<string>>>"))


def _matches(s: DataFrame, near: str, templates: list[tuple[str, str, float]]) -> DataFrame:
    """__row, line, label, containment of the blocks in the column `near` that templates match."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    hits = s.select(F.explode(f"{near}.tokens").alias("tokens")).select(F.explode("tokens").alias("w"))
    seen = {r["w"]: r["n"] for r in hits.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the template words
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    index = []
    for number, (label, notice, threshold) in enumerate(templates):
        ranks, need = sorted(order[w] for w in set(notice.split())), needed(notice, threshold)
        index += [(rank, number, label, place, need, ranks) for place, rank in enumerate(ranks[: len(ranks) - need + 1])]
    by_rank = sorted(vocabulary, key=order.__getitem__)
    prefix_words = _array([by_rank[r] for r in sorted({x[0] for x in index})])
    rank_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])])
    b = s.select("__row", F.explode(F.filter(near, lambda b: F.arrays_overlap(b["tokens"], prefix_words))).alias("b"))
    b = b.select("__row", "b.line", F.array_sort(F.transform("b.tokens", lambda w: F.element_at(rank_of, w))).alias("ranks"))
    b = b.select("__row", "line", "ranks", F.posexplode("ranks").alias("j", "rank"))
    ix = s.sparkSession.createDataFrame(index, "rank int, template int, label string, i int, need int, t_ranks array<int>")
    m = b.join(F.broadcast(ix), "rank")
    rest = 1 + F.least(F.size("t_ranks") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1)
    m = m.where((F.size("ranks") >= F.col("need")) & (rest >= F.col("need")))
    m = m.withColumn("common", F.size(F.array_intersect("ranks", "t_ranks"))).where("common >= need")
    return m.select("__row", "line", "label", (F.col("common") / F.size("t_ranks")).alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str, float]] | None = None, phrases: dict[str, str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest
    containment of a matching template; 1 where a base phrase stands), blocks (the matches: label, line, containment)."""
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases
    if not templates:
        raise ValueError("no templates")
    chunks = [templates[k : k + chunk] for k in range(0, len(templates), chunk)]
    s = docs.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("__t"))
    s = s.select("doc_id", "__t", F.transform(F.split("__t", "\n"), words_of).alias("__l")).withColumn("__w", F.flatten("__l"))
    lines = F.transform("__l", lambda words, k: F.struct(k.cast("int").alias("line"), words.alias("words")))
    lines = F.filter(lines, lambda b: F.size(b["words"]) > 0)
    s = s.select(
        "doc_id", F.size("__w").cast("bigint").alias("n_words"),
        F.struct(*[_places(F.col("__l"), F.col("__t"), p).alias(f"p{k}") for k, p in enumerate(phrases)]).alias("__p"),
        *[_near(F.col("__w"), lines, c).alias(f"__near{k}") for k, c in enumerate(chunks)],
    )
    s = written(s.withColumn("__row", F.monotonically_increasing_id()), "scan")

    m = None
    for k, c in enumerate(chunks):
        found = _matches(s, f"__near{k}", c)
        m = found if m is None else m.unionByName(found)
    m = m.groupBy("__row", "line", "label").agg(F.max("containment").alias("containment"))
    m = m.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("label", "line", "containment"))).alias("blocks"), F.max("containment").alias("best"))

    r = s.drop(*[f"__near{k}" for k in range(len(chunks))]).join(m, "__row", "left")
    every = F.flatten(F.array(*[F.col(f"__p.p{k}") for k in range(len(phrases))]))
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"__p.p{k}") > 0, F.lit(v)) for k, v in enumerate(phrases.values())]))))
    both = F.array_sort(F.array_union(base_labels, F.coalesce(F.transform("blocks", lambda x: x["label"]), F.array().cast("array<string>"))))
    n = F.size(every)
    return r.select(
        "doc_id", "n_words", n.cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "blocks",
    )


def oracle() -> str:
    """The same rows by brute force, in DuckDB: every line, and every stretch of words around a line end, with every template."""
    w = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    phr = ", ".join(f"({p.split()!r}, '{v}')" for p, v in BASE_PHRASES.items())
    tem = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {needed(t, threshold)})" for label, t, threshold in TEMPLATES)
    reach = words_around(TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS t FROM documents),
w AS (SELECT rid, doc_id, t, {w.format('t')} AS ws FROM d),
phrase(p, label) AS (VALUES {phr}),
place AS (SELECT rid, label, unnest(list_filter(range(0, len(ws) - len(p) + 1), lambda i: ws[i + 1 : i + len(p)] = p)) AS pos FROM w, phrase WHERE len(ws) >= len(p)),
bp AS (SELECT rid, count(*) AS n_base, min(pos) AS f, max(pos) AS l, list(DISTINCT label) AS labels FROM place GROUP BY rid),
line AS (SELECT rid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
sized AS (SELECT rid, k, len({w.format('x')}) AS n FROM line),
ends AS (SELECT rid, n, sum(n) OVER (PARTITION BY rid ORDER BY k) AS e FROM sized),
block AS (SELECT rid, list_distinct(ws[e - n + 1 : e]) AS tok FROM ends JOIN w USING (rid) WHERE n > 0
  UNION ALL SELECT rid, list_distinct(ws[greatest(e - n, e - {reach}) + 1 : e + {reach}]) FROM ends JOIN w USING (rid) WHERE n > 0),
template(label, tw, need) AS (VALUES {tem}),
hit AS (SELECT rid, label, len(list_intersect(tok, tw)) AS common, len(tw) AS n FROM block, template WHERE len(list_intersect(tok, tw)) >= need),
m AS (SELECT rid, list(DISTINCT label) AS labels, max(common / n) AS best FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(bp.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bp.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN bp USING (rid) LEFT JOIN m USING (rid)"""
