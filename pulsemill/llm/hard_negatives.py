"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

The score of an anchor and a row is the inner product of their whole-number components. Anchors and rows are dealt to
blocks of bounded size, and both are cut into `chunks` ranges of dimensions. A block of anchors meets a block of rows once
for each range and gives a partial tile of int64 scores; partial tiles are shuffled by (anchor block, row block) and added.
Every join key of the multiply holds one block of each side, so the work is even however the labels or ids are spread.

It runs twice, and each pair of an anchor and a row is scored in one of the two runs. In the first, rows and anchors are
blocked by a hash of their label, and a tile gives each anchor's best rows of its own label: the positives. In the second,
blocks mix all labels; the anchors' blocks bring the windows of scores that their positives leave to negatives, and a tile
gives the best rows of other labels for each window. Only these few rows of each tile travel on, to a top k by anchor (and
positive) that is cut before its shuffle and after it. A label or vec_id that holds many of the rows fills more blocks, no larger ones.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. A null vec_id is no
anchor; as a positive or negative it comes after others of its score. Rows are told apart by a number of their own, so
repeated rows each count, also as each other's positives. Vectors are scored against those of their own length; empty ones
score 0. Components outside 64 bits are held at their ends, and sums wrap around at 64 bits. A window may be empty, as it is
below a negative positive score. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, join_hot, ship, whole_runs, written

#: Where matrix products of doubles are exact.
EXACT = float(1 << 53)
#: Components of a block of rows or anchors at most, so that long vectors make smaller blocks.
BLOCK_COMPONENTS = 1 << 20
TILE = "kind bigint, i bigint, j bigint, k int, d int, tile binary, a binary, b binary"


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str | Column, scale: int) -> DataFrame:
    """row, vec_id, label, x (whole numbers) of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    v = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), x.alias("x"))
    sound = F.expr("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    v = v.where(F.col("label").isNotNull() & F.col("x").isNotNull()).where(sound)
    top, low = float(1 << 62) * 2, -float(1 << 62) * 2
    whole = F.transform("x", lambda c: F.when(c * scale >= top, F.lit((1 << 63) - 1)).when(c * scale <= low, F.lit(-(1 << 63))).otherwise(F.floor(F.when(F.abs(c * scale) < top, c * scale).otherwise(F.lit(0.0)))))
    return v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("x"))


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices: by doubles where they are exact, else by wrapping 64-bit sums."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore"):
        return sum(a[:, c, None] * b[None, :, c] for c in range(a.shape[1]))


def blocks_of(rows: DataFrame, chunks: int, extra: list[str]) -> DataFrame:
    """Rows with kind and block as one row for each (kind, block, d, k): the components of range k, and, with range 0, ids and `extra`."""
    names = ["row", "vec_id", "label", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(batches, ["kind", "block", "d"]):
            at = np.searchsorted(runs, np.arange(runs[-1] + 2))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                part = t.slice(lo, hi - lo).combine_chunks()
                kind, block, d = (part.column(c)[0].as_py() for c in ("kind", "block", "d"))
                x = part.column("x").combine_chunks().flatten().to_numpy().reshape(hi - lo, d)
                ids = ipc(part.select(names))
                cuts = [d * k // chunks for k in range(chunks + 1)]
                for k in range(chunks):
                    matrix = np.ascontiguousarray(x[:, cuts[k] : cuts[k + 1]]).tobytes()
                    yield pa.RecordBatch.from_pylist([{"kind": kind, "block": block, "d": d, "k": k, "n": hi - lo, "x": matrix, "ids": None if k else ids}], schema)

    schema = pa.schema([("kind", pa.int64()), ("block", pa.int64()), ("d", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("x", pa.binary()), ("ids", pa.binary())])
    keyed = rows.select("kind", "block", F.size("x").alias("d"), *names, "x")
    keyed = keyed.repartition("kind", "block", "d").sortWithinPartitions("kind", "block", "d", "row")
    return keyed.mapInArrow(run, "kind bigint, block bigint, d int, k int, n bigint, x binary, ids binary")


def ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def tiles(left: DataFrame, right: DataFrame, chunks: int) -> DataFrame:
    """Partial tiles of blocks of anchors (left) and of rows (right) of the same kind and length: each block goes to every
    block of the other side, so a key (kind, i, j, d, k) holds one of each. Blocks are written, as they are read more than once."""
    left, right = (written(blocks_of(x, chunks, e), n) for x, e, n in ((left, ["windows"], "anchors"), (right, [], "rows")))

    def copied(blocks: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        many = written(others.groupBy("kind", "d").agg((F.max("block") + 1).alias("m")), "grid")
        many = F.broadcast(many) if many.count() <= MOST_BROADCAST else many
        return blocks.join(many, ["kind", "d"]).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1))).withColumnRenamed("block", own)

    l, r = copied(left, right, "i", "j"), copied(right, left, "j", "i")
    keys = ["kind", "i", "j", "d", "k"]
    l = l.select(*keys, F.col("n").alias("na"), F.col("x").alias("xa"), F.col("ids").alias("a"))
    r = r.select(*keys, F.col("n").alias("nb"), F.col("x").alias("xb"), F.col("ids").alias("b"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (x for at in range(batch.num_rows) for x in batch.slice(at, 1).to_pylist()):
                xa = np.frombuffer(row["xa"], np.int64).reshape(row["na"], -1)
                xb = np.frombuffer(row["xb"], np.int64).reshape(row["nb"], -1)
                tile = exact_product(xa, xb).tobytes()
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("kind", "i", "j", "k", "d", "a", "b")} | {"tile": tile}], tile_schema)

    tile_schema = pa.schema([("kind", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("k", pa.int32()), ("d", pa.int32()), ("tile", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
    return l.hint("merge").join(r, keys).mapInArrow(multiply, TILE)


def summed(partial: DataFrame) -> DataFrame:
    """The partial tiles by (kind, i, j, d), range 0 first: what whole_tiles() adds."""
    keys = ["kind", "i", "j", "d"]
    return partial.repartition(*keys).sortWithinPartitions(*keys, "k")


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table, pa.Table]]:
    """Added tiles with the ids of their anchors and rows; one tile is held at a time."""
    tile = a = b = None
    for batch in batches:
        for at in range(batch.num_rows):
            k, raw = batch.column("k")[at].as_py(), batch.column("tile")[at].as_py()
            if k == 0:
                if tile is not None:
                    yield tile, a, b
                a, b = (from_ipc(batch.column(c)[at].as_py()) for c in ("a", "b"))
                tile = np.frombuffer(raw, np.int64).reshape(a.num_rows, b.num_rows).copy()
            else:
                tile += np.frombuffer(raw, np.int64).reshape(tile.shape)
    if tile is not None:
        yield tile, a, b


def ordered_ids(t: pa.Table) -> np.ndarray:
    """For each row of a block its place by vec_id, null ids last."""
    ids = t.column("vec_id")
    null = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((t.column("row").to_numpy(), ids.fill_null(0).to_numpy(), null))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def first_of_runs(run: np.ndarray, k: int) -> np.ndarray:
    """The first k indices of each run of a sorted array."""
    n = np.arange(len(run))
    start = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    return np.flatnonzero(n - np.maximum.accumulate(np.where(start, n, 0)) < k)


def mine(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label", scale: int = 256, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, chunks: int = 2, anchor_block: int = 128, row_block: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: a condition on vec_id and label. Each component becomes floor(scale * x). A row of another label is a negative of
    an anchor and a positive if low * positive score <= 100 * its score <= high * positive score."""
    ship(vectors.sparkSession)
    rows = written(prepared(vectors, vec_id, embedding, label, scale), "numbered")
    rows = rows.withColumns({"anchor": F.coalesce(is_anchor, F.lit(False)), "windows": F.array().cast("array<bigint>")})
    n, longest = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    row_block, anchor_block = (max(1, min(b, BLOCK_COMPONENTS // max(1, longest or 1))) for b in (row_block, anchor_block))
    kinds = max(1, math.ceil(n / row_block))

    def blocked(x: DataFrame, size: int) -> DataFrame:
        """Rows of one kind dealt to blocks of about `size`; large kinds have more blocks."""
        sizes = x.groupBy("kind").count().withColumn("blocks", F.ceil(F.col("count") / size))
        return join_hot(x, sizes, "kind", "count").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))

    own = rows.withColumn("kind", F.pmod(F.xxhash64("label"), F.lit(kinds)))

    def best_of_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, a, b in whole_tiles(batches):
            row_a, row_b, id_b, place = a.column("row").to_numpy(), b.column("row").to_numpy(), b.column("vec_id"), ordered_ids(b)
            at, to = np.nonzero((a.column("label").to_numpy()[:, None] == b.column("label").to_numpy()) & (row_a[:, None] != row_b))
            score = tile[at, to]
            order = np.lexsort((place[to], ~score, at))
            order = order[first_of_runs(at[order], positives)]
            at, to, score = at[order], to[order], score[order]
            yield pa.RecordBatch.from_arrays([pa.array(row_a[at]), pa.array(row_b[to]), id_b.combine_chunks().take(pa.array(to)), pa.array(score)], ["row", "other", "other_id", "score"])

    found = summed(tiles(blocked(own.where("anchor"), anchor_block), blocked(own, row_block), chunks)).mapInArrow(best_of_own, "row bigint, other bigint, other_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    chosen = written(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    # what an anchor's block brings along: place and score of each positive, in turn
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: F.array(p["place"].cast("bigint"), p["score"])))
    anchors = rows.where("anchor").drop("windows").join(chosen.groupBy("row").agg(flat.alias("windows")), "row")

    def fraction(s: np.ndarray, share: int, up: bool) -> np.ndarray:
        """share * s / 100, rounded up or down, without leaving 64 bits for any s."""
        whole, rest = np.divmod(s, 100)
        return share * whole + (-(-share * rest // 100) if up else share * rest // 100)

    def best_of_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, a, b in whole_tiles(batches):
            windows = a.column("windows").combine_chunks()
            flat, size = windows.flatten().to_numpy().reshape(-1, 2), np.diff(windows.offsets.to_numpy()) // 2
            of = np.repeat(np.arange(a.num_rows), size)
            least, most = fraction(flat[:, 1], low, True), fraction(flat[:, 1], high, False)
            all_least, all_most = np.full(a.num_rows, np.iinfo(np.int64).max), np.full(a.num_rows, np.iinfo(np.int64).min)
            np.minimum.at(all_least, of, least)
            np.maximum.at(all_most, of, most)
            other = a.column("label").to_numpy()[:, None] != b.column("label").to_numpy()
            at, to = np.nonzero(other & (tile >= all_least[:, None]) & (tile <= all_most[:, None]))
            score, place = tile[at, to], ordered_ids(b)
            order = np.lexsort((place[to], ~score, at))
            at, to, score = at[order], to[order], score[order]
            ends = np.searchsorted(at, np.arange(a.num_rows + 1))
            picked: list[tuple[int, np.ndarray]] = []
            for w in range(len(of)):
                lo, hi = ends[of[w]], ends[of[w] + 1]
                falling = ~score[lo:hi]  # rises where scores fall
                first, last = np.searchsorted(falling, ~most[w], "left"), np.searchsorted(falling, ~least[w], "right")
                picked.append((w, np.arange(lo + first, lo + min(last, first + negatives))))
            w = np.repeat([p[0] for p in picked], [len(p[1]) for p in picked]).astype(np.int64)
            if len(w):
                k = np.concatenate([p[1] for p in picked])
                row_a, ids = a.column("row").to_numpy(), b.column("vec_id").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_a[of[w]]), pa.array(flat[w, 0].astype(np.int32)), pa.array(b.column("row").to_numpy()[to[k]]), ids.take(pa.array(to[k])), pa.array(score[k])],
                    ["row", "place", "negative", "negative_id", "negative_score"],
                )

    mixed = rows.withColumns({"kind": F.lit(0).cast("bigint"), "block": F.pmod(F.xxhash64("row"), F.lit(max(1, math.ceil(n / row_block))))})
    n_anchors = anchors.count()
    anchors = anchors.withColumns({"kind": F.lit(0).cast("bigint"), "block": F.pmod(F.xxhash64("row"), F.lit(max(1, math.ceil(n_anchors / anchor_block))))})
    found = summed(tiles(anchors, mixed, chunks)).mapInArrow(best_of_others, "row bigint, place int, negative bigint, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = chosen.join(rows.where("anchor").select("row", F.col("vec_id").alias("anchor_id")), "row")
    out = found.join(named.select("row", "place", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), ["row", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
