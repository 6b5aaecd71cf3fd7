"""Embedding near-duplicates with randomised-rotation binary codes.

Every vector is scaled to length one and rotated at random (by sign flips and Hadamard transforms). Once per vector a code is stored: the signs of the rotated
coordinates, one bit each; the correction factor f, the inner product of these signs (as a vector of length one) with the
vector; and, for its part as the other side of a comparison, the coordinates in 4 bits, whose highest bit is the sign. The
signs of one vector times the 4-bit coordinates of another, by popcounts, over f, estimate their cosine without bias; the
estimate's error is below eps * sqrt((1 - f^2) / (d - 1) + r^2) / f with a confidence of 1 - 2 exp(-eps^2 / 2), where r is
the rounding error of the 4 bits. Pairs whose upper bound is below the threshold are discarded.

Candidates are vectors that share a bucket in one of several tables: for more rotations, which coordinate is the largest and
its sign. What travels to the buckets are codes only. The vectors themselves follow for the rows that the bounds leave open
with some other one; the pairs that are open are compared exactly, in double precision, from the vectors as given. So no
link is below the threshold; links can be missed only if no table brings the pair together. How often one rotation agrees
for a pair just at the threshold is simulated for the vectors' dimension when the job starts, and the number of tables
chosen so that such a pair is found with a probability of `recall`; pairs of higher cosine are found nearly always.

Equal vectors are one class with a count. A pair is counted in the first table that brings it together. Buckets over
`most` rows are dealt out as blocks of two chunks. Blocks emit sums of links and a forest of edges, never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different dimension never link; a null vec_id counts as a link but can't be a component. Repeated vec_ids are rows of their
own, each with its result. Ties in the largest coordinate go to the first. Extra columns are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, join_hot, pairs_in_runs, same_block, ship, split_hot, whole_runs, written

LEVELS = 15  # steps of the 4-bit coordinates


def turned_size(d: int) -> int:
    """Coordinates of a rotated vector: vectors are padded to a power of two."""
    return 1 << max(0, d - 1).bit_length()


def rotated(x: np.ndarray, seed: int, k: int) -> np.ndarray:
    """The rows of x, padded, in the k-th pseudo-random rotation: three rounds of random sign flips and a Hadamard transform, which
    take O(d log d) for each row and no matrix."""
    n, d = x.shape
    size = turned_size(d)
    out = np.zeros((n, size))
    out[:, :d] = x
    signs = np.random.default_rng([seed, size, k]).integers(0, 2, (3, size)) * 2.0 - 1
    left, right = hadamard(1 << (size.bit_length() - 1) // 2), hadamard(1 << size.bit_length() // 2)
    for r in range(3):  # the transform of all coordinates is one of each row and one of each column of a square of them
        out = ((out * (signs[r] / math.sqrt(size))).reshape(-1, len(right)) @ right).reshape(n, len(left), len(right))
        out = (out.transpose(0, 2, 1).reshape(-1, len(left)) @ left).reshape(n, size)
    return out


@lru_cache
def hadamard(size: int) -> np.ndarray:
    """The Hadamard matrix of a power of two; those of half a vector's bits are small."""
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def agreement(d: int, cosine: float, seed: int = 1, pairs: int = 20_000) -> float:
    """How often a random rotation's largest coordinate, with its sign, is the same for two vectors of this cosine."""
    rng, same, done = np.random.default_rng([seed, d]), 0, 0
    while done < pairs:
        n = max(1, min(pairs - done, 2_000_000 // d))
        x, y = rng.normal(size=(2, n, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.where(norm > 0, norm, 1)
        a, b, at = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1), np.arange(n)
        same += int(((a == b) & ((x[at, a] > 0) == (y[at, b] > 0))).sum())
        done += n
    return same / pairs


def bucket_keys(x: np.ndarray, tables: int, per_table: int, seed: int) -> np.ndarray:
    d = turned_size(x.shape[1])
    keys = np.zeros((len(x), tables), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        for j in range(per_table):
            y = rotated(x, seed, 1 + t * per_table + j)
            top = np.abs(y).argmax(axis=1)
            keys[:, t] = keys[:, t] * (2 * d) + 2 * top + (y[rows, top] > 0)
    return keys


class Codes:
    """Codes of vectors of one dimension: four bit planes of the rotated coordinates, lowest first, then f, the step and
    the rounding error as single precision numbers."""

    def __init__(self, raw: list[bytes], d: int):
        d = turned_size(d)
        self.d, self.width = d, -(-d // 64) * 8
        table = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        self.planes = np.ascontiguousarray(table[:, : 4 * self.width]).view(np.uint64).reshape(len(raw), 4, -1)
        self.f, self.step, self.r = np.ascontiguousarray(table[:, 4 * self.width :]).view(np.float32).astype(np.float64).T
        ones = np.bitwise_count(self.planes).sum(axis=2).astype(np.int64)
        self.total, self.signs = ones @ (1 << np.arange(4)), 2 * ones[:, 3] - d

    @staticmethod
    def pack(unit: np.ndarray, seed: int) -> list[bytes]:
        turned = rotated(unit, seed, 0)
        n, d = turned.shape
        step = 2 * np.abs(turned).max(axis=1, keepdims=True) / LEVELS
        level = np.clip(np.floor(turned / step + LEVELS / 2 + 0.5), 0, LEVELS).astype(np.uint8)
        sign = np.where(level > LEVELS // 2, 1.0, -1.0)
        f = (sign * turned).sum(axis=1) / math.sqrt(d)
        r = np.sqrt(((turned - (level - LEVELS / 2) * step) ** 2).mean(axis=1))
        planes = np.zeros((n, 4, -(-d // 64) * 8), np.uint8)
        for j in range(4):
            bits = np.packbits(level >> j & 1, axis=1)
            planes[:, j, : bits.shape[1]] = bits
        numbers = np.stack([f, step[:, 0], r], axis=1).astype(np.float32)
        return [p.tobytes() + x.tobytes() for p, x in zip(planes, numbers, strict=True)]

    def upper_bounds(self, a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
        """Upper confidence bounds of the cosines of the pairs (a, b), from the signs of a and the coordinates of b."""
        both = np.bitwise_count(self.planes[a, 3][:, None, :] & self.planes[b]).sum(axis=2).astype(np.int64)
        inner = self.step[b] * (2 * (both @ (1 << np.arange(4))) - self.total[b] - LEVELS / 2 * self.signs[a])
        f = np.maximum(self.f[a], 1e-6)
        spread = np.maximum(0, 1 - f * f) / max(1, self.d - 1) + self.r[b] ** 2
        return (inner / math.sqrt(self.d) + eps * np.sqrt(spread)) / f


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = 0.97, eps: float = 4.0, bucket: int = 16, most: int = 4096, seed: int = 42) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    sound = F.col("x").isNotNull() & F.expr("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))") & F.expr("exists(x, c -> c <> 0)")
    v = v.withColumn("x", F.when(F.coalesce(sound, F.lit(False)), F.col("x")))
    v = v.withColumn("same", F.when(F.col("x").isNotNull(), F.concat(F.hex(F.xxhash64("x")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), "x")))))
    classes = v.where("x IS NOT NULL").groupBy("same", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n, d_most = classes.agg(F.count("*"), F.max(F.size("x"))).first()
    d_most = max(2, turned_size(d_most or 2))
    per_table = max(1, math.ceil(math.log2(max(2, n / bucket)) / math.log2(2 * d_most)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agreement(d_most, threshold) ** per_table))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, x = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "x"))
            size = np.diff(x.offsets.to_numpy())
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                raw = x.take(pa.array(own)).values.to_numpy().reshape(-1, d)
                unit = raw / np.abs(raw).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                keys = bucket_keys(unit, tables, per_table, seed)
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(own)), pa.array([int(d)] * len(own), pa.int32()), pa.array(Codes.pack(unit, seed), pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["node", "d", "code", "keys"],
                )

    codes = written(classes.select("node", "x").mapInArrow(coded, "node bigint, d int, code binary, keys binary"), "codes")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, d, code, raw = (batch.column(c) for c in ("node", "d", "code", "keys"))
            keys = np.frombuffer(b"".join(raw.to_pylist()), np.int64).reshape(len(raw), tables)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([node, d, code, pa.array(np.full(len(raw), t, np.int32)), pa.array(keys[:, t])], ["node", "d", "code", "t", "key"])

    rows = codes.mapInArrow(dealt, "node bigint, d int, code binary, t int, key bigint")
    keys = ["d", "t", "key", "__i", "__j"]
    block_row = "node bigint, d int, code binary, t int, key bigint, __r int, __i int, __j int"
    rows = split_hot(rows, ["d", "t", "key"], "node", most).select("node", "d", "code", "t", "key", "__r", "__i", "__j")

    def tables_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows of one dimension and one table each, with whole blocks."""
        for table, runs in whole_runs(batches, keys):
            change = (np.diff(table.column("d").to_numpy()) != 0) | (np.diff(table.column("t").to_numpy()) != 0)
            starts = np.flatnonzero(np.r_[True, change])
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                yield table.slice(s, e - s), runs[s:e]

    def open_pairs(t: pa.Table, runs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that this block counts and whose upper bounds reach the threshold."""
        r, ci, cj = (t.column(c).to_numpy() for c in ("__r", "__i", "__j"))
        code = Codes(t.column("code").to_pylist(), t.column("d")[0].as_py())
        for all_a, all_b in pairs_in_runs(runs):
            for at in range(0, len(all_a), 50_000):
                a, b = all_a[at : at + 50_000], all_b[at : at + 50_000]
                here = same_block(a, b, r, ci, cj)
                a, b = a[here], b[here]
                keep = code.upper_bounds(a, b, eps) >= threshold
                a, b = a[keep], b[keep]
                keep = code.upper_bounds(b, a, eps) >= threshold  # both directions must leave the pair open
                if keep.any():
                    yield a[keep], b[keep]

    def with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in tables_of(batches):
            partner = np.zeros(t.num_rows, bool)
            for a, b in open_pairs(t, runs):
                partner[a] = partner[b] = True
            if partner.any():
                yield from t.take(pa.array(np.flatnonzero(partner))).combine_chunks().to_batches()

    maybe = written(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(with_partners, block_row), "open")
    full = maybe.join(classes.select("node", "x", "copies"), "node").join(codes.select("node", F.col("keys").alias("all_keys")), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in tables_of(batches):
            d, number = t.column("d")[0].as_py(), t.column("t")[0].as_py()
            node, copies = (t.column(c).to_numpy() for c in ("node", "copies"))
            x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d)
            earlier = np.frombuffer(b"".join(t.column("all_keys").to_pylist()), np.int64).reshape(len(x), -1)[:, :number]
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            links = np.zeros(len(x), np.int64)
            found = []
            for a, b in open_pairs(t, runs):
                if number:
                    new = ~(earlier[a] == earlier[b]).any(axis=1)
                    a, b = a[new], b[new]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[near], b[near]
                if len(a):
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    found.append((a, b))
            if found:
                some = np.flatnonzero(links)
                yield batch_of(np.zeros(len(some), np.int32), node[some], links[some])
                child, root = forest(len(x), *(np.concatenate(c) for c in zip(*found, strict=True)), node)
                yield batch_of(np.ones(len(child), np.int32), node[child], node[root])

    def batch_of(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    found = written(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "kind int, a bigint, b bigint"), "found")
    sums = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    components = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("component", "group")
    joined = classes.select("node", "same", "rep", "copies").join(sums, "node", "left").join(components, "node", "left").withColumn("group", F.coalesce("group", "node"))
    smallest = joined.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes"))
    of_class = join_hot(joined, smallest, "group", "classes")
    of_class = of_class.select("same", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = join_hot(v.where("same IS NOT NULL").select("vec_id", "same"), of_class, "same", "copies").select("vec_id", "n_links", "component_id")
    alone = v.where("same IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
