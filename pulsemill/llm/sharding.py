"""Sharding: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are numbered when they are written to a table in the shared folder and lie in blocks by a hash of that number. Given
the blocks' counts, the matrix of how many rows each block sends to each shard is drawn exactly: row by row from the
multivariate hypergeometric law, with the shard sizes, which differ by one at most, as column sums. In its block each row
gets a random rank, which together with the matrix fixes its shard; that and the shard sizes make every assignment equally
likely. In its shard it gets a random key; its slot is its rank by that key, found by ranges of the key: counts by range
give each range's start, and ranks within the range the rest. No shard is sorted as one group.

The matrix takes blocks x shards numbers: there are at most `most_blocks` blocks, so its size is bounded; it is drawn on
the driver and joined by block. Randomness is a hash with a seed of the rows' numbers in the written table, so a task that
is run again gives the same rows the same shards.

Edge cases: null texts have size 1 and crc32 0. Equal rows have numbers of their own, and ties in the random keys go by
these. Rows with null ids and rows of any length are sharded like others. Extra columns are carried along; columns named
shard or slot are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` drawn rows are good. numpy draws up to 1e9 rows; beyond that, ratio of uniforms (Stadlober)."""
    if not good or not sample:
        return 0
    if not bad:
        return sample
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    total, lg = good + bad, math.lgamma
    p = good / total
    mean, var = sample * p, sample * p * (1 - p) * (total - sample) / (total - 1)
    low, high = max(0, sample - bad), min(sample, good)
    log_f = lambda k: -(lg(k + 1) + lg(good - k + 1) + lg(sample - k + 1) + lg(bad - sample + k + 1))
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    top, a, h = log_f(mode), mean + 0.5, 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(a + h * (v - 0.5) / u) if u else low - 1
        if low <= k <= high and 2 * math.log(u) <= log_f(k) - top:
            return k


def matrix(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows from each block (by row) to each shard (by column), drawn with these exact sums."""
    rng, total = np.random.default_rng(seed), int(blocks.sum())
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(blocks), shards), np.int64)
    for k, n in enumerate(blocks):
        rest, room = int(n), int(left.sum())
        for s in range(shards):
            room -= int(left[s])
            out[k, s] = hypergeometric(rng, int(left[s]), room, rest)
            rest -= int(out[k, s])
        left -= out[k]
    return out


def shard(rows: DataFrame, shards: int = 16, block_rows: int = 2_000, most_blocks: int = 10_000, seed: int = 42) -> DataFrame:
    """rows with int `shard` and long `slot` (gapless from 0 in each shard)."""
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("__id"))
    r = written(rows.withColumn("__id", F.monotonically_increasing_id()), "rows")
    total = r.count()
    n = max(1, min(most_blocks, -(-total // block_rows)))
    r = r.withColumn("__b", F.pmod(h(0), F.lit(n)).cast("int"))
    counts = {x["__b"]: x["n"] for x in r.groupBy("__b").agg(F.count("*").alias("n")).collect()}  # most_blocks rows at most
    sent = matrix(np.array([counts.get(b, 0) for b in range(n)], np.int64), shards, seed)
    bounds = rows.sparkSession.createDataFrame([(b, np.cumsum(sent[b]).tolist()) for b in range(n)], "__b int, __bounds array<bigint>")
    r = r.join(bounds, "__b").withColumn("__rank", F.row_number().over(Window.partitionBy("__b").orderBy(h(1), "__id")))
    r = r.withColumn("shard", F.size(F.filter("__bounds", lambda x: x < F.col("__rank"))).cast("int")).drop("__bounds", "__rank", "__b")
    ranges = max(1, -(-n // shards))
    r = r.withColumn("__key", h(2)).withColumn("__r", F.least(F.floor((F.col("__key") / 2.0**64 + 0.5) * ranges), F.lit(ranges - 1)).cast("int"))
    starts = r.groupBy("shard", "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    r = r.withColumn("__place", F.row_number().over(Window.partitionBy("shard", "__r").orderBy("__key", "__id")))
    r = r.join(starts, ["shard", "__r"]).withColumn("slot", (F.col("__start") + F.col("__place") - 1).cast("bigint"))
    return r.drop("__start", "__place", "__id", "__key", "__r")


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
