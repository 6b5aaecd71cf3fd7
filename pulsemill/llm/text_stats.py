"""Statistics of whole texts that the quality operators learn from, computed in one narrow Arrow pass.

Words are `[^\\x20\\x09-\\x0D]+`. Besides general ratios there is the rate of each ASCII mark, none of them picked by hand.

Edge cases: null and empty texts have no words and all statistics 0. Very long texts are read whole. Equal rows get equal
statistics. Columns of the table that have a statistic's name are replaced, unless a prefix keeps them apart. An empty table
gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts_of

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["symbols_per_word", "dup_line_share", "repeat_share", "chars_per_word", "upper_share", "digit_share", "mark_share", "distinct_share", "top_word_share", "same_next_share", "words_per_line"]
MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]  # the ASCII characters that are marks
RATIOS += [f"mark_{k}_per_word" for k in MARKS]
SPACE, SYMBOLS = [9, 10, 11, 12, 13, 32], [ord(c) for c in "#*$%&|<>"]


def repeated(ids: np.ndarray, width: int = 3) -> int:
    """Words in windows of `width` words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):
        key = np.unique(key * (int(ids.max()) + 1) + ids[k : n + k], return_inverse=True)[1].reshape(-1)
    often = np.bincount(key)[key] > 1
    mark = np.zeros(len(ids), bool)
    for k in range(width):
        mark[k : n + k] |= often
    return int(mark.sum())


def stats(text: str) -> tuple[list[int], list[float]]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at ASCII white space only
    if not words:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    chars = np.frombuffer(raw, np.uint8)
    of = np.bincount(chars, minlength=256)
    space = int(of[SPACE].sum())
    n, points = len(words), len(text) - space
    symbols = int(of[SYMBOLS].sum())
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    dup = len(lines) - len(set(lines))
    repeat = repeated(ids)
    upper, lower, digit = int(of[65:91].sum()), int(of[97:123].sum()), int(of[48:58].sum())
    mark = int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum())
    return [n, points, symbols, dup, repeat], [
        symbols / n, dup / max(1, len(lines)), repeat / n, points / n, upper / max(1, upper + lower), digit / max(1, points), mark / max(1, points),
        len(seen) / n, float(np.bincount(ids).max() / n), float((ids[1:] == ids[:-1]).sum() / n), n / max(1, len(lines)),
        *(of[MARKS] / n).tolist(),
    ]


FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in RATIOS]


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with all statistics as columns; a prefix keeps them from clashing with columns of docs."""

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            both = [stats(t) for t in texts_of(batch, text)]
            counts, ratios = zip(*both, strict=True)
            return [*(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), *(pa.array(c, pa.float64()) for c in zip(*ratios, strict=True))]

        return compute

    return append_columns(docs, [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], make)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, where: str | None, most: int) -> DataFrame:
    """docs (doc_id, text) with their label, for at most `most` labelled rows chosen by a hash of doc_id: the bounded
    sample of labelled rows that a classifier may be fitted on. Labels are looked up by broadcast, bounded by `most`. A doc_id
    that docs repeats comes with each of its rows: one_each() leaves one of them before anything goes to the driver."""
    from pyspark.sql import functions as F

    ids = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col(label).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    ids = ids.where(where) if where else ids
    ids = ids.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    return docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(ids), "__id")


def one_each(rows: DataFrame) -> DataFrame:
    """One row for each __id, the smallest, so that a repeated id can't break the sample's bound."""
    from pyspark.sql import functions as F

    return rows.groupBy("__id").agg(F.min(F.struct(*[c for c in rows.columns if c != "__id"])).alias("__one")).select("__id", "__one.*")


def inner_split(ids: np.ndarray, parts: int = 5) -> np.ndarray:
    """Which training rows are set aside to choose settings on: one of so many parts, by a hash of the id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts) == 0
