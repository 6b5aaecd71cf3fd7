"""An exact Jaccard join of the sets of five-word shingles: which texts that nothing links yet are near-duplicates.

A set's prefix are its n - ceil(similarity n) + 1 rarest shingles; two sets of at least this similarity share a shingle
of both prefixes (prefix filter), are of like size (length filter), and share early enough (positional filter). Which
shingles count as common is learned from a sample and only decides the order, so whatever it misses costs time, not links.

What the filters leave is mostly pairs that share one passage. They are discarded by parity bitmaps: a shingle flips one
bit of its set's bitmap, so two bitmaps differ in at most as many bits as the sets do, which bounds the overlap from
above. A bitmap has one or two bits a shingle; the larger of two is folded to the other's size. Pairs are tested where they
meet, so those that share a passage only never leave their task. Only pairs that the bound leaves open are compared shingle by shingle, and only their texts are read again. So no pair is linked below the similarity, and
none at or above it is missed, whatever the size of the corpus.

Of the sets that share a shingle, first each is compared with the first of them and with its neighbour in a random order
of them, another one for each shingle; then, of those that still lie in two components, with a few more neighbours. This joins crowds of copies in linear time. Then all pairs that still lie in two components are, dealt out in blocks where a shingle has many sets.

Edge cases: texts without a word have no set and are linked by nothing here; a text of fewer than five words is one
shingle. Very long texts go through the same path. Equal sets are one set, which the caller sees to. An empty table, or one
sample without common shingles, gives no edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, connected_components, only, pairs_in_runs, same_block, ship, split_hot, texts_of, whole_runs, written

SLACK = 1e-9  # for comparisons of products with whole numbers
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words, of the whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ w[k : n + k]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of n to 2n slots."""
    order = max(6, (len(shingles) - 1).bit_length())
    slot = (shingles >> np.uint64(64 - order)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=1 << order) & 1).astype(np.uint8)).tobytes()


#: Bytes of a bitmap that rows of shingles carry at most; whole ones are compared for the pairs that these leave open.
BRIEF = 256


def brief(bits: bytes) -> bytes:
    """The bitmap folded to BRIEF bytes if it is larger: parities of neighbouring slots together."""
    if len(bits) <= BRIEF:
        return bits
    slots = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(8 * BRIEF, -1)
    return np.packbits(np.bitwise_xor.reduce(slots, axis=1)).tobytes()


def differing_bits(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, the larger one folded: a lower bound of how many shingles do."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(len(a), np.int64)
    for p, q in set(zip(size_a.tolist(), size_b.tolist(), strict=True)):
        at = np.flatnonzero((size_a == p) & (size_b == q))
        sides = []
        for side, size in ((a, p), (b, q)):
            rows = np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), size)
            if size > min(p, q):
                folded = np.unpackbits(rows, axis=1).reshape(len(at), 8 * min(p, q), -1)
                rows = np.packbits(np.bitwise_xor.reduce(folded, axis=2), axis=1)
            sides.append(rows)
        out[at] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
    return out


def common_shingles(docs: DataFrame, width: int, sample: int = 10_000, least: int = 3, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and their counts: at most `most`, the most frequent ones."""
    share = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                sets = [shingle_set(words_of(t), width) for t in texts_of(batch.slice(at, 100))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["s"])

    ship(docs.sparkSession)
    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select("text").mapInArrow(run, "s bigint")
    t = some.groupBy("s").count().where(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(most).toArrow()
    s, n = t.column("s").to_numpy().view(np.uint64), t.column("count").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def rarest(x: np.ndarray, similarity: float, often: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The prefix of a sorted shingle set: its n - ceil(similarity n) + 1 first shingles by (count, hash)."""
    if not len(x):
        return x
    c = np.zeros(len(x), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, x), len(often) - 1)
        c = np.where(often[at] == x, count[at], 0)
    return x[np.argsort(c, kind="stable")][: len(x) - math.ceil(similarity * len(x) - SLACK) + 1]


FIELDS = [
    T.StructField("set_id", T.LongType()), T.StructField("n", T.IntegerType()),
    T.StructField("prefix", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("brief", T.BinaryType()),
]


def set_columns(words: list[list[bytes]], width: int, similarity: float, often: np.ndarray, count: np.ndarray) -> list[pa.Array]:
    """set_id, n, prefix, bitmap and folded bitmap of each text."""
    ids, size, prefix, bits = [], [], [], []
    for w in words:
        x = shingle_set(w, width)
        ids.append(set_id(x))
        size.append(len(x))
        prefix.append(rarest(x, similarity, often, count).tobytes())
        bits.append(bitmap(x) if len(x) else b"")
    return [pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), pa.array([brief(b) for b in bits], pa.binary())]


def may_be_similar(n: np.ndarray, place: np.ndarray, other_n: np.ndarray, other_place: np.ndarray, similarity: float) -> np.ndarray:
    """Length and positional filter: what two sets can share from these places on, if this is the first that they share."""
    fits = np.minimum(n, other_n) >= similarity * np.maximum(n, other_n) - SLACK
    return fits & (np.minimum(n - place, other_n - other_place) >= similarity / (1 + similarity) * (n + other_n) - SLACK)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each prefix."""
    names = ["key", "place", "set_id", "n", "component"]
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            b = whole.slice(at, 200)
            keys = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("prefix")]
            size = np.array([len(k) for k in keys])
            row = np.repeat(np.arange(len(keys)), size)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            rest = [b.column(c).take(pa.array(row)) for c in ("set_id", "n", "component")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(place), *rest], names)


def _shared(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle: those of a shingle that sets of several components share, with how many there are
    (size), the first of them (hub) and another one (next). A run of `most` rows is passed on in parts, each with its own first set, none left out and size 0, so that memory is bounded."""
    parted = None
    names = ["key", "place", "set_id", "n", "component", "size"]
    names += [f"{who}_{c}" for who in ("hub", "next") for c in ("place", "set_id", "n", "component")]
    for t, runs in whole_runs(batches, ["key"], most):
        key, component = t.column("key").to_numpy(), t.column("component").to_numpy()
        first = np.searchsorted(runs, runs)
        several = np.zeros(runs[-1] + 1, bool)
        several[runs[component != component[first]]] = True
        size = np.bincount(runs)
        if key[0] == parted:
            several[0], size[0] = True, 0
        if not runs[-1] and t.num_rows >= most:
            several[0], size[0], parted = True, 0, key[0]
        keep = np.flatnonzero(several[runs])
        if len(keep):
            out = t.take(pa.array(keep)).combine_chunks()
            order = np.lexsort((np.random.default_rng(int(key[0]) & 0xFFFFFFFF).random(len(runs)), runs))
            following = np.empty(len(runs), np.int64)
            following[order] = np.r_[order[1:], order[-1:]]
            following = np.where(runs[following] == runs, following, np.arange(len(runs)))  # the last one's neighbour is itself
            others = [t.select(["place", "set_id", "n", "component"]).take(pa.array(at[keep])).combine_chunks() for at in (first, following)]
            columns = [*out.columns, pa.array(size[runs[keep]]), *(c for o in others for c in o.columns)]
            yield from pa.Table.from_arrays(columns, names).combine_chunks().to_batches(10_000)


def similar_links(docs: DataFrame, sets: DataFrame, similarity: float, width: int = 5, most: int = 1024) -> DataFrame:
    """Edges (u, v) between components of sets (set_id, n, prefix, bits, brief, row, component; set_id distinct) that connect
    just what pairs of at least this similarity connect. docs (row, text) has the texts; a set's row is one with its text."""
    ship(docs.sparkSession)
    row = "key bigint, place int, set_id bigint, n int, component bigint"
    others = "".join(f", {who}_place int, {who}_set_id bigint, {who}_n int, {who}_component bigint" for who in ("hub", "next"))
    rows = sets.select("set_id", "n", "prefix", "component").mapInArrow(_spread, row)
    rows = rows.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_shared, f"{row}, size bigint{others}")
    rows = written(rows, "shared")

    def is_open(n: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Whether the bitmaps leave open that pairs with n shingles together are similar."""
        return (n - differing_bits(a, b)) / 2 >= similarity / (1 + similarity) * n - SLACK

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            keep = np.flatnonzero(is_open(n, batch.column("x").to_pylist(), batch.column("y").to_pylist()))
            if len(keep):
                yield batch.select(["a", "b", "u", "v"]).take(pa.array(keep))

    def equal_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (xs, ys))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common) - SLACK:
                    keep.append(i)
            if keep:
                yield batch.select(["u", "v"]).take(pa.array(keep))

    def make():
        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [shingle_set(words_of(t), width).tobytes() for t in texts_of(batch)]
            return [pa.array(found, pa.binary())]

        return columns

    def verified(near: DataFrame, name: str) -> DataFrame:
        """The edges of the pairs (a, b, u, v) that are similar."""
        near = written(near, f"{name}-open")
        need = near.select(F.col("a").alias("set_id")).unionByName(near.select(F.col("b").alias("set_id")))
        need = written(only(sets.select("set_id", "row"), need, "set_id"), f"{name}-need")
        texts = append_columns(only(docs.select("row", "text"), need, "row"), [T.StructField("shingles", T.BinaryType())], make, 100)
        texts = written(texts.drop("text").join(need, "row").select("set_id", "shingles"), f"{name}-sets")
        left, right = (texts.select(F.col("set_id").alias(k), F.col("shingles").alias(x)) for k, x in (("a", "x"), ("b", "y")))
        exact = near.join(left, "a").join(right, "b").select("u", "v", "x", "y")
        return written(exact.mapInArrow(equal_enough, "u bigint, v bigint").distinct(), name)

    def with_other(who: str) -> DataFrame:
        """Pairs (a, b, u, v) of each set and its hub or next one that the length and positional filters leave."""
        n, place, set_id, component = (F.col(f"{who}_{c}") for c in ("n", "place", "set_id", "component"))
        least = F.lit(similarity) * F.greatest("n", n) - SLACK
        size = F.lit(similarity / (1 + similarity)) * (F.col("n") + n) - SLACK
        fits = (F.least("n", n) >= least) & (F.least(F.col("n") - F.col("place"), n - place) >= size)
        low = F.col("set_id") < set_id
        pairs = rows.where((F.col("component") != component) & fits)
        return pairs.select(
            F.least("set_id", set_id).alias("a"), F.greatest("set_id", set_id).alias("b"),
            F.when(low, F.col("component")).otherwise(component).alias("u"), F.when(low, component).otherwise(F.col("component")).alias("v"),
        )

    stars = with_other("hub").unionByName(with_other("next"))
    left, right = (sets.select(F.col("set_id").alias(k), F.col("bits").alias(x), F.col("n").alias(m)) for k, x, m in (("a", "x", "n"), ("b", "y", "m")))
    pair = "a bigint, b bigint, u bigint, v bigint"

    def by_bitmaps(pairs: DataFrame) -> DataFrame:
        """The pairs that the whole bitmaps leave open."""
        return pairs.join(left, "a").join(right, "b").select("a", "b", "u", "v", "x", "y", "n", "m").mapInArrow(open_pairs, pair)

    stars = verified(by_bitmaps(stars.distinct()), "stars")

    keys = ["key", "__i", "__j"]

    def apart(edges: DataFrame) -> DataFrame:
        """Rows of shingles that sets of several components share, after these edges, dealt out and sorted by shingle."""
        wider = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        now = sets.select("set_id", F.col("brief").alias("bits"), "component").join(wider, "component", "left")
        now = now.select("set_id", "bits", F.coalesce("wider", "component").alias("component"))
        own = rows.select("key", "place", "set_id", "n", "size").join(now, "set_id")
        few = own.where(F.col("size").between(1, most)).drop("size").withColumns({c: F.lit(0) for c in ("__r", "__i", "__j")})
        many = own.where(~F.col("size").between(1, most)).drop("size")
        mixed = many.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        many = split_hot(many.join(mixed.select("key"), "key", "left_semi"), ["key"], "set_id", most)
        return few.unionByName(many.select(few.columns)).repartition(*keys).sortWithinPartitions(*keys, "set_id")

    def open_in_runs(reach: int | None):
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, runs in whole_runs(batches, keys):
                if reach is not None:  # each set meets some others, different ones for each shingle
                    order = np.lexsort((np.random.default_rng(len(runs)).random(len(runs)), runs))
                    t, runs = t.take(pa.array(order)).combine_chunks(), runs[order]
                of, component, n, place, r, ci, cj = (t.column(c).to_numpy() for c in ("set_id", "component", "n", "place", "__r", "__i", "__j"))
                bits = t.column("bits").to_pylist()
                for a, b in pairs_in_runs(runs, reach):
                    near = (component[a] != component[b]) & same_block(a, b, r, ci, cj)
                    a, b = a[near], b[near]
                    near = may_be_similar(n[a], place[a], n[b], place[b], similarity)
                    a, b = a[near], b[near]
                    near = is_open(n[a].astype(np.int64) + n[b], [bits[k] for k in a], [bits[k] for k in b])
                    a, b = a[near], b[near]
                    if len(a):
                        swap = of[a] > of[b]
                        a, b = np.where(swap, b, a), np.where(swap, a, b)
                        whole = np.maximum(n[a], n[b]) <= 8 * BRIEF
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of[a], of[b], component[a], component[b], whole)], ["a", "b", "u", "v", "whole"])

        return pairs

    def linked(edges: DataFrame, reach: int | None, name: str) -> DataFrame:
        """The edges of similar pairs among what these edges leave apart. Pairs of sets whose rows have folded bitmaps are held
        against their whole ones before any text is read."""
        near = written(apart(edges).mapInArrow(open_in_runs(reach), f"{pair}, whole boolean").distinct(), f"{name}-pairs")
        long = near.where("NOT whole").drop("whole")
        near = near.where("whole").drop("whole")
        return verified(near if long.isEmpty() else near.unionByName(by_bitmaps(long)), name)

    edges = stars.unionByName(linked(stars, 8, "near"))
    return edges.unionByName(linked(edges, None, "rest"))
