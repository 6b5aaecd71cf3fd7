"""SimHash near-duplicates, linked by pivot distance tables.

Fingerprints are taken once per text; equal fingerprints are one node. A pair within `radius` bits keeps, of `blocks`
bit blocks, at least blocks - radius untouched. Reference fingerprints (pivots) that differ from a base in one bit of a
block place each fingerprint by its distances to them; a pair has coordinate difference 0 in every untouched block, so
an equi-join on the coordinates of each choice of blocks - radius blocks meets every linked pair. (Without such local
pivots a table of distances to pivots can only discard pairs of an all-pairs list: distances of 64-bit fingerprints to
any pivot lie within 32 +- 4 mostly.) Within a bucket, a table of distances to many other pivots discards pairs whose
maximum coordinate difference is over the radius (the triangle inequality), and the survivors are verified bit by bit.

Buckets over `most` fingerprints are dealt out as blocks of two chunks each. What a block emits is not its pairs but a
forest of as many edges as nodes at most. Components come from alternating stars over these edges.

With a `similarity`, texts that the fingerprints' radius doesn't link are linked too if the Jaccard similarity of their sets
of five-word shingles is that or more: an exact join, whatever their fingerprints and whatever the size (shingle_join).

Nodes of the graph are fingerprints, so rows without an id, and rows that share an id, link like any others.

Edge cases: null and empty texts have fingerprint zero, which links like any other. Rows with a null doc_id join what they
link and get a fingerprint and a null component. Rows with one doc_id and different texts keep a fingerprint each. Repeated
rows share their component. Very long texts are fingerprinted whole, in pieces. Extra columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingle_join
from .common import append_columns, connected_components, forest, join_hot, pairs_in_runs, same_block, split_hot, texts_of, whole_runs, written
from .shingle_join import words_of

PIECE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(words: list[bytes], width: int) -> int:
    if not words:
        return 0
    count = np.zeros(64, np.int64)
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * count > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with long `out`, the 64-bit fingerprint as a signed number."""

    def make():
        return lambda batch: [pa.array((fingerprint(words_of(t), width) for t in texts_of(batch, text)), pa.int64())]

    return append_columns(docs, [T.StructField(out, T.LongType())], make)


def block_masks(blocks: int, radius: int) -> list[int]:
    """A mask of the bits of each choice of blocks - radius bit blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(one, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each fingerprint and a column for each pivot."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)


def near_pairs(t: pa.Table, runs: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within each run that this block counts and that are within radius bits."""
    fp = t.column("fp").to_numpy().view(np.uint64)
    r, ci, cj = (t.column(c).to_numpy() for c in ("__r", "__i", "__j"))
    table = np.frombuffer(b"".join(t.column("distances").to_pylist()), np.int8).reshape(len(fp), -1)
    for a, b in pairs_in_runs(runs):
        near = same_block(a, b, r, ci, cj) & (np.abs(table[a, 0] - table[b, 0]) <= radius)
        a, b = a[near], b[near]
        if len(a):
            near = np.abs(table[a] - table[b]).max(axis=1) <= radius  # the maximum coordinate difference
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            if near.any():
                yield a[near], b[near]


def links(nodes: DataFrame, radius: int = 3, n_pivots: int = 16, blocks: int | None = None, most: int = 4096, seed: int = 42) -> DataFrame:
    """Edges (u, v) between reps of nodes (fp, rep; fp distinct) that connect just what links within radius bits connect."""
    if blocks is None:  # more blocks make more rows but finer buckets; buckets stay small while nodes are far fewer than their keys
        blocks = radius + 1 if nodes.count() < 2_000_000 else 2 * radius
    pivots = np.random.default_rng(seed).integers(0, 1 << 64, n_pivots, np.uint64)

    def make():
        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            table = pivot_table(batch.column("fp").to_numpy().view(np.uint64), pivots)
            return [pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_pivots), len(table), [None, pa.py_buffer(table.tobytes())]).cast(pa.binary())]

        return columns

    placed = append_columns(nodes.select("fp", "rep"), [T.StructField("distances", T.BinaryType())], make, 100_000)
    masks = block_masks(blocks, radius)
    choices = F.array(*[F.struct(F.lit(k).alias("b"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
    keyed = placed.select("fp", "rep", "distances", F.explode(choices).alias("x")).select("fp", "rep", "distances", "x.b", "x.key")
    rows = split_hot(keyed, ["b", "key"], "fp", most)
    keys = ["b", "key", "__i", "__j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(batches, keys):
            rep = t.column("rep").to_numpy()
            found = list(near_pairs(t, runs, radius))
            if found:
                child, root = forest(len(rep), *(np.concatenate(x) for x in zip(*found, strict=True)), rep)
                yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root])], ["u", "v"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint")


def groups(docs: DataFrame, width: int = 3, radius: int = 3, similarity: float | None = None) -> DataFrame:
    """docs (row, doc_id, text; row distinct) as row, doc_id, fp, component: a number that just the rows of one group share,
    by links within radius bits and, with a similarity, of at least that Jaccard similarity of five-word shingles."""
    if similarity is None:
        fps = fingerprints(docs, width).drop("text")
    else:
        fps = _both(docs, width, similarity).drop("text")
    fps = written(fps, "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.count("*").alias("rows")), "nodes")
    edges = links(nodes.select("fp", F.col("fp").alias("rep")), radius)
    if similarity is not None:  # equal shingle sets are one node from here on
        of_set = fps.where("n > 0").groupBy("set_id", "fp").agg(F.min("row").alias("row"))
        of_set = written(of_set, "set-fingerprints")
        reps = of_set.groupBy("set_id").agg(F.min("row").alias("row"), F.min("fp").alias("first"))
        same = of_set.join(reps.select("set_id", "first"), "set_id").where("fp != first")
        edges = edges.unionByName(same.select(F.col("fp").alias("u"), F.col("first").alias("v")))
    linked = connected_components(edges).withColumnRenamed("node", "fp")
    if similarity is not None:
        linked = written(linked, "linked")
        of_row = of_set.join(reps.select("row"), "row").join(linked, "fp", "left").select("row", F.coalesce("component", "fp").alias("component"))
        sets = fps.join(of_row, "row")
        sets = written(sets.select("set_id", "n", "prefix", "bits", "brief", "row", "component"), "sets")
        more = shingle_join.similar_links(docs, sets, similarity)
        wider = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        of = nodes.select("fp").join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")).join(wider, "component", "left")
        linked = of.select("fp", F.coalesce("wider", "component").alias("component"))
    of_fp = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return join_hot(fps.select("row", "doc_id", "fp"), of_fp, "fp", "rows")


def _both(docs: DataFrame, width: int, similarity: float, shingle: int = 5) -> DataFrame:
    """docs with fp and the columns of their shingle sets, in one pass over the texts."""
    often, count = shingle_join.common_shingles(docs, shingle)

    def make():
        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            words = [shingle_join.words_of(t) for t in texts_of(batch)]
            fp = pa.array([fingerprint(w, width) for w in words], pa.int64())
            return [fp, *shingle_join.set_columns(words, shingle, similarity, often, count)]

        return columns

    return append_columns(docs, [T.StructField("fp", T.LongType()), *shingle_join.FIELDS], make, 100)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links reach. Links are pairs within
    radius bits and, with a similarity, pairs of at least that Jaccard similarity of five-word shingles."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    of = groups(named if similarity is None else written(named, "texts"), width, radius, similarity)
    smallest = of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    return join_hot(of, smallest, "component", "rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
