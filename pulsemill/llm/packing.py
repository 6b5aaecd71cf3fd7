"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window is a fixed number of sequences. In each window a source may
spend its quantum (window tokens times its target share) plus the deficit it carries; whole tokens are spent, the fraction
is carried on. A queue that ends leaves its share to the others. With the default target, each source's share of all
tokens, every window holds the mixture and all queues end together, so that only the last sequence is padded. Documents are
cut where a window or a sequence ends.

The round-robin is hierarchical: a tree whose leaves are the queues, where each inner node deals what it gets to its two
sides. After N tokens the left side has had its exact quota, rounded; the rounding is the deficit, half a token at most, that
the node carries to later windows. So a queue's position at the start of any window has a closed form, a few whole-number
operations for each level of the tree, and no list of windows is kept: windows have the same size however large the corpus.

How it runs: one pass tokenizes into a table in the shared folder, with each document's place within its task and source.
Sums by task and source (small: one row for each) give each task's start in the queues: this carries the queues across
partitions. The upper levels of the tree are the sums of GROUPS groups of sources by hash, a list of fixed length; the lower ones
are computed where a group's sources lie and travel with the source, so there may be any number of sources. A last narrow
pass cuts each document at the windows' positions.

Edge cases: null and empty texts hold only the end id. Very long texts are tokenized whole and span as many sequences as they
need. A null source is a queue of its own. Repeated rows are packed each. A source whose target share is 0 comes when no other is
left. Extra columns are ignored, whatever their names. An empty table gives no pieces. Ids travel in two bytes if the vocabulary allows it, else
in four.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_BROADCAST, ship, whole_runs, written

GROUPS = 1 << 16  # leaves of the upper tree


def byte_bpe(ranks_path: str, pattern: str, end_text: str, end_token: int):
    """The byte-level BPE of a ranks file; the end text inside a text is its special token, as the JSON file's default."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end_text: end_token})


def tokenized(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """doc_id, source, ids (binary, little-endian, 2 or 4 bytes each), n, task, before: tokens of the source before it in the task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern, "<|endoftext|>", 50256)
        kind = "H" if max(bpe.max_token_value, end_id) < 1 << 16 else "I"
        task, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc, source, text = (batch.column(k) for k in range(3))
            for at in range(0, batch.num_rows, 512):
                ids, n, before = [], [], []
                for t, s in zip(text.slice(at, 512), source.slice(at, 512).to_pylist(), strict=True):
                    row = array(kind, bpe.encode(t.as_py() or "", allowed_special="all"))
                    row.append(end_id)
                    ids.append(row.tobytes())
                    n.append(len(row))
                    before.append(so_far.get(s, 0))
                    so_far[s] = before[-1] + len(row)
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(at, 512), source.slice(at, 512), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([task] * len(n), pa.int64()), pa.array(before, pa.int64())],
                    ["doc_id", "source", "ids", "n", "task", "before"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, source string, ids binary, n bigint, task bigint, before bigint"
    )


class Fixed:
    """A node whose sides keep their shares to the end, as these are their shares of its tokens."""

    def __init__(self, left: int, total: int):
        self.left, self.twice = left, 2 * total

    def __call__(self, n: int) -> int:
        """How many of the first n tokens go to the left."""
        return (2 * n * self.left + self.twice // 2) // self.twice


class Changing:
    """A node over queues with target shares: whenever one ends, the others share what it leaves."""

    def __init__(self, totals: list[int], shares: list[Fraction], split: int):
        rest = [Fraction(t) for t in totals]
        n = x = Fraction(0)
        self.at, self.points = [Fraction(0)], [(x, Fraction(0))]
        while any(rest):
            live = [k for k, r in enumerate(rest) if r]
            rate = {k: shares[k] for k in live} if any(shares[k] for k in live) else {k: rest[k] for k in live}
            whole = sum(rate.values())
            step = min(rest[k] * whole / rate[k] for k in live if rate[k])
            slope = sum(rate[k] for k in live if k < split) / whole
            self.points[-1] = (x, slope)
            for k in live:
                rest[k] -= step * rate[k] / whole
            n, x = n + step, x + step * slope
            self.at.append(n)
            self.points.append((x, Fraction(0)))

    def __call__(self, n: int) -> int:
        k = bisect_right(self.at, n) - 1
        x, slope = self.points[k]
        return int(x + (n - self.at[k]) * slope + Fraction(1, 2))


Path = list[tuple[Fixed | Changing, bool]]  # from the root: a node, and whether the queue is on its right side


def sides(lo: int, hi: int, k: int) -> Iterator[tuple[int, int, int, bool]]:
    """The halvings of lo..hi that lead to k: start, middle, end, and whether k is in the right half."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        yield lo, mid, hi, k >= mid
        lo, hi = (mid, hi) if k >= mid else (lo, mid)


def path_by_tokens(sums: np.ndarray, k: int) -> Path:
    """The nodes above queue k among queues with these cumulative token counts, whose shares are those of their tokens."""
    out: Path = []
    for lo, mid, hi, right in sides(0, len(sums) - 1, k):
        left, total = int(sums[mid] - sums[lo]), int(sums[hi] - sums[lo])
        if 0 < left < total:  # else the other side is empty
            out.append((Fixed(left, total), right))
    return out


def path_by_shares(totals: list[int], shares: list[float], k: int) -> Path:
    """The nodes above queue k among queues with target shares."""
    exact = [Fraction(s).limit_denominator(1 << 40) for s in shares]
    return [(Changing(totals[lo:hi], exact[lo:hi], mid - lo), right) for lo, mid, hi, right in sides(0, len(totals), k)]


def dealt(path: Path, n: int) -> tuple[int, int]:
    """Of the first n tokens: how many go to queues before this one, and how many to this one."""
    before = 0
    for node, right in path:
        left = node(n)
        if right:
            before, n = before + left, n - left
        else:
            n = left
    return before, n


def round_robin(totals: list[int], shares: list[float], window: int) -> np.ndarray:
    """Queue positions: row k has how many tokens of each queue the windows before k take."""
    total = sum(totals)
    paths = [path_by_shares(totals, shares, k) for k in range(len(totals))]
    return np.array([[dealt(p, min(n, total))[1] for p in paths] for n in range(0, total + window, window)], np.int64)


class Queue:
    """Where the tokens of one source go; asked for positions in rising order, it rarely has to search."""

    def __init__(self, path: Path, tokens: int, total: int, window: int):
        self.path, self.tokens, self.total, self.window = path, tokens, total, window
        self.move(0)

    def move(self, w: int) -> None:
        self.w = w
        before, self.start = dealt(self.path, min(w * self.window, self.total))
        after, self.stop = dealt(self.path, min((w + 1) * self.window, self.total))
        self.place = w * self.window + after - before  # of the first token that the window takes from this queue

    def seek(self, at: int) -> None:
        """Moves to the window that takes the token at this position."""
        if self.start <= at < self.stop:
            return
        if self.stop <= at:  # mostly the next window
            self.move(self.w + 1)
            if self.start <= at < self.stop:
                return
        low, high = 0, self.total // self.window + 1  # the last window that starts at or before the position
        while high - low > 1:
            w = (low + high) // 2
            low, high = (w, high) if dealt(self.path, min(w * self.window, self.total))[1] <= at else (low, w)
        self.move(low)


def _lower_paths(sources: DataFrame) -> DataFrame:
    """source, group, tokens, path: for each source, the cumulative counts around it of the tree over its group, whose
    sources are ordered by hash. Mostly a group has one source and the path is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(batches, ["group"]):
            tokens, first = t.column("tokens").to_numpy(), np.searchsorted(runs, np.arange(runs[-1] + 2))
            paths = []
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                sums = np.concatenate([[0], np.cumsum(tokens[lo:hi])])
                for k in range(hi - lo):
                    nodes = [(node.left, node.twice // 2, right) for node, right in path_by_tokens(sums, k)]
                    paths.append(np.array(nodes, np.int64).tobytes())
            yield from pa.Table.from_arrays([*t.select(["source", "group", "tokens"]).columns, pa.array(paths, pa.binary())], ["source", "group", "tokens", "path"]).to_batches()

    keyed = sources.withColumns({"h": F.xxhash64("source"), "group": group_of(F.col("source"))}).select("source", "group", "tokens", "h")
    return keyed.repartition("group").sortWithinPartitions("group", "h", "source").mapInArrow(run, "source string, group int, tokens bigint, path binary")


def group_of(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), source), F.lit(GROUPS)).cast("int")


def pack(docs: DataFrame, ranks_path: str, pattern: str, sequence: int = 1024, window_sequences: int = 64, shares: dict[str | None, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids (little-endian uint32; null unless with_ids), ids_crc32, doc_tokens, window, sequence_id, offset.

    shares: target share of each source; sources that it leaves out get their share of the tokens, scaled to the rest."""
    table = written(tokenized(docs, ranks_path, pattern), "tokens")
    parts = table.groupBy("task", "source").agg(F.sum("n").alias("tokens"))
    parts = parts.withColumn("base", F.sum("tokens").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    sources = written(table.groupBy("source").agg(F.sum("n").alias("tokens")), "sources")
    own = dict(shares or {})
    texts = [s for s in own if s is not None]
    named = F.col("source").isin(texts) if texts else F.lit(False)
    named = F.coalesce(named, F.lit(None in own)) if own else F.lit(False)
    have = {r["source"]: r["tokens"] for r in sources.where(named).collect()}  # as many as shares were given
    names = sorted(have, key=lambda x: (x is None, x))
    lower = written(_lower_paths(sources.where(~named)), "paths")
    sums = np.zeros(GROUPS + 1, np.int64)
    for r in lower.groupBy("group").agg(F.sum("tokens").alias("tokens")).collect():  # GROUPS rows at most
        sums[r["group"] + 1] = r["tokens"]
    sums = np.cumsum(sums)
    totals = [have[s] for s in names] + [int(sums[-1])] * bool(sums[-1])
    targets = [own[s] for s in names] + [max(0.0, 1 - sum(own.values()))] * bool(sums[-1])
    total, window = sum(totals), sequence * window_sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues: dict[str | None, Queue] = {}

        def queue(source: str | None, group: int, tokens: int, path: bytes) -> Queue:
            k = names.index(source) if source in have else len(names)
            nodes = path_by_shares(totals, targets, k)
            if source not in have:
                nodes += path_by_tokens(sums, group)
                nodes += [(Fixed(left, whole), bool(right)) for left, whole, right in np.frombuffer(path, np.int64).reshape(-1, 3).tolist()]
            if len(queues) >= 10_000:
                queues.clear()
            queues[source] = Queue(nodes, tokens, total, window)
            return queues[source]

        for batch in batches:
            rows: list[tuple] = []
            for doc, source, ids, n, before, base, group, tokens, path in zip(*(batch.column(k) for k in range(9)), strict=True):
                doc, source, n = doc.as_py(), source.as_py(), n.as_py()
                ids = np.frombuffer(ids.as_buffer(), "<u2" if len(ids.as_buffer()) == 2 * n else "<u4").astype("<u4")
                ids = memoryview(ids).cast("B")
                q = queues.get(source) or queue(source, group.as_py(), tokens.as_py(), path.as_py())
                at, start = (base.as_py() or 0) + before.as_py(), 0
                while start < n:
                    q.seek(at)
                    place = q.place + at - q.start
                    length = min(n - start, q.stop - at, sequence - place % sequence)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, source, start, length, bytes(piece) if with_ids else None, zlib.crc32(piece), n, q.w, place // sequence, place % sequence))
                    start += length
                    at += length
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    names_out = ["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "window", "sequence_id", "offset"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names_out)

    same = parts.source.eqNullSafe(F.col("__source"))
    paths = lower.select(F.col("source").alias("__source"), "group", F.col("tokens").alias("queue"), "path")
    parts = parts.join(paths, same, "left").select(F.col("task").alias("__task"), F.col("source").alias("__source"), "base", "group", "queue", "path")
    return _with_parts(table, parts).select("doc_id", "source", "ids", "n", "before", "base", "group", F.coalesce("queue", F.lit(0)).alias("queue"), "path").mapInArrow(
        run, T.StructType([T.StructField(n, {pa.string(): T.StringType(), pa.binary(): T.BinaryType()}.get(k, T.LongType())) for n, k in zip(names_out, kinds, strict=True)])
    )


def _with_parts(table: DataFrame, parts: DataFrame) -> DataFrame:
    """Each row's task and source's start in the queue, and the source's path. The parts are broadcast up to MOST_BROADCAST
    rows; beyond that, the tokens are shuffled by task and source to join them."""
    p = written(parts, "parts")
    p = F.broadcast(p) if p.count() <= MOST_BROADCAST else p.hint("merge")
    return table.join(p, (F.col("task") == F.col("__task")) & F.col("source").eqNullSafe(F.col("__source"))).drop("__task", "__source")
