"""Pairs of rows of one group that meet in blocks. A group is cut by hash into blocks of bounded size; each two blocks meet under
a key of their own, as matrix products in Arrow, and only what is asked for leaves them. So pairs that fail are never rows, no
task has a whole large group, and a row is shuffled once for each block it meets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

ROWS = 8192  # of a block, at most
SLICE = 512  # rows of a block that are multiplied in one step

#: ids, values and where each one's value ends (in bytes) of both blocks, and whether they are one block; gives columns without the group.
Meet = Callable[[np.ndarray, bytes, np.ndarray, np.ndarray, bytes, np.ndarray, bool], Iterator[tuple]]


def counted(rows: DataFrame, most: int, tasks: int = 16) -> DataFrame:
    """g, c: how many blocks each group has; smaller blocks where the groups are small, so that there are tasks enough."""
    n = F.count("*")
    size = F.least(F.lit(most), F.greatest(F.lit(min(most, 1024)), F.ceil(n / tasks)))  # of a block
    return checkpointed(rows.groupBy("g").agg(F.ceil(n / size).cast("int").alias("c")))


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it, unless it is long."""
    return F.broadcast(df) if df.count() <= 100_000 else df


def packed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (g, id, u binary) as blocks: g, block, ids, us, ends."""
    kind = rows.schema["g"].dataType.simpleString()
    rows = rows.join(small(counts), "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("c").cast("bigint")).cast("int"))
    rows = rows.select("g", "block", "id", "u").repartition("g", "block").sortWithinPartitions("g", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, us, of = None, [], [], None

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(u) for u in us])
            one = [(key[0], of), (key[1], pa.int32()), (np.array(ids, np.int64).tobytes(), pa.binary()), (b"".join(us), pa.binary()), (ends.astype(np.int64).tobytes(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in one], ["g", "block", "ids", "us", "ends"])

        for b in batches:
            of = b.schema.field("g").type
            for g, number, i, u in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if (g, number) != key:
                    if ids:
                        yield block()
                    key, ids, us = (g, number), [], []
                ids.append(i)
                us.append(u)
        if ids:
            yield block()

    return rows.mapInArrow(run, f"g {kind}, block int, ids binary, us binary, ends binary")


def met(left: DataFrame, right: DataFrame | None, meet: Meet, names: list[str], schema: str, most: int | None = None, tasks: int = 16) -> DataFrame:
    """What `meet` gives for each two blocks of one group, one of left and one of right (each g, id, u binary), with the group in
    front. Without right, left meets itself: each two blocks once, and each block itself."""
    kind, most = left.schema["g"].dataType.simpleString(), most or ROWS
    counts = counted(left, most, tasks)
    p = packed(left, counts)
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    if right is None:
        p = checkpointed(p)
        a = p.join(small(counts), "g").select("g", F.col("block").alias("i"), every(F.col("block"), F.col("c") - 1).alias("j"), "ids", "us", "ends")
        b = p.select("g", every(F.lit(0), F.col("block")).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"r{c}") for c in ("ids", "us", "ends")])
    else:
        others = counted(right, most)
        a = p.join(small(others), "g").select("g", F.col("block").alias("i"), every(F.lit(0), F.col("c") - 1).alias("j"), "ids", "us", "ends")
        b = packed(right, others).join(small(counts), "g").select("g", every(F.lit(0), F.col("c") - 1).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"r{c}") for c in ("ids", "us", "ends")])
    both = a.hint("merge").join(b, ["g", "i", "j"]).select("g", (F.col("i") == F.col("j")).alias("same"), "ids", "us", "ends", "rids", "rus", "rends")
    alone = right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                g = b.column("g")[k]
                raw = [b.column(c)[k].as_buffer() for c in ("ids", "us", "ends", "rids", "rus", "rends")]
                x = [np.frombuffer(v, np.int64) if c not in (1, 4) else v for c, v in enumerate(raw)]
                for columns in meet(*x, alone and b.column("same")[k].as_py()):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays([pa.repeat(g, len(columns[0])), *map(pa.array, columns)], ["g", *names])

    return both.mapInArrow(run, f"g {kind}, {schema}")


def ordered(p: np.ndarray, q: np.ndarray, *more: np.ndarray, one: bool) -> tuple:
    """Pairs of ids as (a, b), a < b; within one block, which meets itself, each pair comes twice and stays once."""
    keep = p < q if one else p != q
    return tuple(x[keep] for x in (np.minimum(p, q), np.maximum(p, q), *more))
