"""Similarity pairs and leader clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from . import blocks

WORDS = 4096  # tokens that are columns of one product


def jaccard_pairs(rows: DataFrame, by: str, key: str, tokens: str, threshold: float) -> DataFrame:
    """(group, a, b, jaccard), a < b, of all pairs in a group with this Jaccard similarity of their token arrays. Sets are known
    by 64-bit hashes of their tokens; where two blocks of a group meet, what all pairs share is a product of 0/1 matrices
    over the tokens found in both, which is exact. Candidates are never rows, whatever tokens the titles share."""
    r = rows.select(F.col(by).alias("g"), F.col(key).cast("bigint").alias("id"), F.array_distinct(tokens).alias("t")).where("g IS NOT NULL AND id IS NOT NULL")
    kind = r.schema["g"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = pa.array([np.array(t or [], np.int64).tobytes() for t in b.column("t").to_pylist()], pa.binary())
            some = pa.array([len(t.as_buffer()) > 0 for t in u], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(some) for x in (b.column("g"), b.column("id"), u)], ["g", "id", "u"])

    def meet(qi: np.ndarray, qu: bytes, qe: np.ndarray, vi: np.ndarray, vu: bytes, ve: np.ndarray, one: bool) -> Iterator[tuple]:
        q, v = np.frombuffer(qu, np.int64), np.frombuffer(vu, np.int64)
        nq, nv = np.diff(qe // 8, prepend=0), np.diff(ve // 8, prepend=0)
        shared = np.intersect1d(q, v)
        if not len(shared):
            return

        def places(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The row and the column of each shared token."""
            at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
            found = shared[at] == x
            return np.repeat(np.arange(len(n)), n)[found], at[found]

        (of_q, at_q), (of_v, at_v) = places(q, nq), places(v, nv)
        for lo in range(0, len(qi), blocks.SLICE):
            hi = min(len(qi), lo + blocks.SLICE)
            both = np.zeros((hi - lo, len(vi)), np.float32)  # counts of less than 2^24 are exact
            for first in range(0, len(shared), WORDS):
                words = min(WORDS, len(shared) - first)
                a, b = np.zeros((hi - lo, words), np.float32), np.zeros((len(vi), words), np.float32)
                own = (of_q >= lo) & (of_q < hi) & (at_q >= first) & (at_q < first + words)
                a[of_q[own] - lo, at_q[own] - first] = 1
                own = (at_v >= first) & (at_v < first + words)
                b[of_v[own], at_v[own] - first] = 1
                both += a @ b.T
            least = threshold / (1 + threshold) - 1e-6
            x, y = np.nonzero(both >= (nq[lo:hi].astype(np.float32) * np.float32(least))[:, None] + (nv.astype(np.float32) * np.float32(least))[None, :] - np.float32(0.01))
            c = both[x, y].astype(np.float64)
            j = c / (nq[lo + x] + nv[y] - c)
            keep = j >= threshold
            yield blocks.ordered(qi[lo + x[keep]], vi[y[keep]], j[keep], one=one)

    sets = r.select("g", "id", F.transform("t", lambda w: F.xxhash64(w)).alias("t")).mapInArrow(codes, f"g {kind}, id bigint, u binary")
    return blocks.met(checkpointed(sets), None, meet, ["a", "b", "jaccard"], "a bigint, b bigint, jaccard double")


def leader_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(k, leader): in order of k, each node that no leader has taken becomes a leader and takes all its free neighbours.

    Leaders are the lexicographically first maximal independent set of the edges (a, b), a < b; a member belongs to its
    smallest leader. Rounds decide all nodes whose smaller neighbours are decided; a few rounds do, each over fewer edges."""
    edges = checkpointed(edges.select("a", "b").distinct())
    open_nodes = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    leaders = None
    left = edges
    while True:
        first = checkpointed(open_nodes.join(left.select(F.col("b").alias("k")).distinct(), "k", "left_anti"))
        leaders = first if leaders is None else checkpointed(leaders.unionByName(first))
        taken = left.join(first.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        open_nodes = checkpointed(open_nodes.join(first, "k", "left_anti").join(taken, "k", "left_anti"))
        left = checkpointed(left.join(open_nodes.withColumnRenamed("k", "a"), "a", "left_semi").join(open_nodes.withColumnRenamed("k", "b"), "b", "left_semi"))
        if open_nodes.isEmpty():
            break
    member = edges.join(leaders.withColumnRenamed("k", "a"), "a", "left_semi").join(leaders.withColumnRenamed("k", "b"), "b", "left_anti").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("leader"))
    return nodes.select("k").join(member, "k", "left").select("k", F.coalesce("leader", "k").alias("leader"))


def group_name(period, leader):
    """The same name for the same group, whenever it is computed."""
    return F.sha1(F.concat_ws(":", period, leader.cast("string")))


def occurrence(rows: DataFrame, group: str, least: int = 2) -> DataFrame:
    """rows with the size of their group and the status that follows; sizes are aggregated first and joined back."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("occurrence"))
    return rows.join(sizes, group).withColumn("merge_status", F.when(F.col("occurrence") >= least, "pending_global_merge").otherwise("discarded"))
