"""The prefix trie of conversations, built level by level.

A node of depth d is a distinct sequence of the first d turns (role and text); it is named by its smallest member and its
depth. Construction is level-synchronous: the live conversations of a depth are grouped by (parent node, next turn), the
group's smallest conv_id names the node, and those that share it with another sequence live on. A conversation that is alone
in its node, with its exact copies, leaves the loop there: the nodes below are its own, and their rows follow from its length
and its running sum of bytes. So there are as many levels as two different conversations share turns. Then joins from
the deepest level upwards roll up children, leaves and savings.

What is shuffled are not the texts but 16 bytes of the SHA-256 of each turn. Exact copies of a conversation are one class
with a count before the loop starts, told by two 64-bit hashes over its turns, its length and its bytes. Turns are numbered by a sort over ranges of
(conv_id, turn), with prefix sums over the partitions, so one conversation may hold any share of the rows. Live conversations
carry their next BLOCK turns at most. A node with many members is a group with partial aggregation, and its members learn its
name by broadcast. The members that end in a node are hashed in order from chunks of ids: SHA-256 is sequential, so one task reads the
chunks of one node as a stream, and holds one chunk at a time.

Edge cases: turns are ordered by turn (null first), then role, the first 64 characters of the text, and the rest's hash. A null
role or text is empty. Rows with a null conv_id belong to no conversation. Repeated rows are turns each. Conversations without turns are members of the root.
Extra columns are ignored, whatever their names. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, join_hot, ship, whole_runs, written

BLOCK = 16
#: Members of a node that are hashed as one list; more are hashed chunk by chunk.
LISTED, CHUNK = 1000, 10_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart; the role's length keeps its end in place."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, bytes, upto: bytes of the conversation's turns up to this one."""
    ship(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.substring(role, 1, 64).alias("r"), F.substring(text, 1, 64).alias("t"), digest(role, text).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("nth"),
    )
    keys = ["conv_id", "turn", "r", "t", "digest", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, pos, upto = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv, size = b.column("conv_id").to_numpy(), b.column("bytes").to_numpy()
            start = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
            n, total = np.arange(1, len(conv) + 1), np.cumsum(size)
            at = np.maximum.accumulate(np.where(start, n - 1, -1))  # where the row's conversation starts in this batch
            n = n - np.where(at < 0, -pos, at)
            total = total - np.where(at < 0, -upto, (total - size)[at])
            last, pos, upto = conv[-1], int(n[-1]), int(total[-1])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n), b.column("digest"), b.column("bytes"), pa.array(total), pa.array(np.full(len(n), part))], names)

    names = ["conv_id", "pos", "digest", "bytes", "upto", "part"]
    rows = t.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "digest", "bytes")
    rows = written(rows.mapInArrow(run, "conv_id bigint, pos bigint, digest binary, bytes bigint, upto bigint, part bigint"), "turns")
    # what a partition's first conversation has before it: one row for each partition
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", "upto")).alias("last")).orderBy("part").collect()
    carry, held = [], (None, 0, 0)
    for e in ends:
        conv, pos, upto = e["last"]
        if e["first"] == held[0]:
            carry.append((e["part"], e["first"], held[1], held[2]))
            if conv == held[0]:
                pos, upto = pos + held[1], upto + held[2]
        held = (conv, pos, upto)
    if not carry:
        return rows.drop("part")
    before = F.broadcast(rows.sparkSession.createDataFrame(carry, "part bigint, conv_id bigint, more bigint, more_bytes bigint"))
    rows = rows.join(before, ["part", "conv_id"], "left")
    return rows.withColumns({"pos": F.col("pos") + F.coalesce("more", F.lit(0)), "upto": F.col("upto") + F.coalesce("more_bytes", F.lit(0))}).drop("part", "more", "more_bytes")


def rebuilt(turns: DataFrame, base: Column, borrowed: Column, most: int, is_base: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation's first turns, `borrowed` of them, replaced by those of the conversation `base`.
    base, borrowed (`most` at most) and is_base (whether any has it as its base) are expressions on conv_id. turns: as from numbered()."""
    turn = F.struct("pos", "digest", "bytes")
    own = turns.withColumn("h", borrowed.cast("bigint")).groupBy("conv_id").agg(
        F.count("*").alias("n_own"), F.sum("bytes").alias("own_bytes"), F.coalesce(F.sum(F.when(F.col("pos") <= F.col("h"), F.col("bytes"))), F.lit(0)).alias("given_up"),
        F.sort_array(F.collect_list(F.when(is_base & (F.col("pos") <= most), turn))).alias("head"),
    )
    own = written(own, "heads")
    of = own.select(F.col("conv_id").alias("base"), "head")
    c = own.drop("head").withColumns({"base": base, "h": borrowed}).join(of, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(own.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    c = c.withColumn("head", head).withColumn("taken", F.size("head").cast("bigint"))
    taken_bytes = F.aggregate("head", F.lit(0).cast("bigint"), lambda s, t: s + t["bytes"])
    shift = taken_bytes - F.col("given_up")
    c = c.withColumns({"n": F.col("taken") + F.greatest(F.lit(0), F.col("n_own") - F.col("h")), "shift_bytes": shift, "total": shift + F.col("own_bytes")})
    c = c.select("conv_id", "n_own", F.col("h").cast("bigint").alias("h"), "head", "taken", "n", "shift_bytes", "total")
    c = written(c, "conversations")
    heads = c.select("conv_id", F.posexplode("head").alias("k", "t"), "head")
    upto = F.aggregate(F.slice("head", F.lit(1), F.col("k") + 1), F.lit(0).cast("bigint"), lambda s, t: s + t["bytes"])
    first = heads.select("conv_id", (F.col("k") + 1).cast("bigint").alias("depth"), "t.digest", "t.bytes", upto.alias("upto"))
    rest = join_hot(turns, c.select("conv_id", "n_own", "h", "taken", "shift_bytes"), "conv_id", "n_own").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes", (F.col("upto") + F.col("shift_bytes")).alias("upto"))
    return c.select("conv_id", "n", "total"), written(first.unionByName(rest), "rebuilt")


def _classes(members: DataFrame, turns: DataFrame, listed_most: int) -> tuple[DataFrame, DataFrame]:
    """(classes, copies): conversations with equal turns are a class, rep (smallest conv_id), m (members), n, total, next (its first
    BLOCK turns), sha (of its members' ids). copies: rep, conv_id of the classes with several members."""
    turn = F.when(F.col("depth") <= BLOCK, F.struct("depth", "digest", "bytes"))
    prints = turns.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64("depth", "digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "digest", "depth")).alias("y"), F.sort_array(F.collect_list(turn)).alias("next")
    )
    none = F.array().cast(prints.schema["next"].dataType)
    own = members.join(prints, "conv_id", "left").withColumn("next", F.coalesce("next", none)).fillna(0, ["x", "y"])
    own = written(own, "prints")
    key = ["n", "total", "x", "y"]
    same = own.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("m"))
    same = written(same, "classes")
    several = same.where("m > 1").select(F.struct(*key).alias("key"), "rep", "m", F.col("m").alias("members"))
    copies = written(join_hot(own.select("conv_id", F.struct(*key).alias("key")), several, "key", "m").select("rep", "conv_id", "members"), "copies")
    listed = copies.where(F.col("members") <= listed_most).groupBy("rep").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ","), 256).alias("sha"))
    shas = listed.unionByName(_long_hashes(copies.where(F.col("members") > listed_most), CHUNK))
    c = same.join(own.select(F.col("conv_id").alias("rep"), "next"), "rep").join(shas, "rep", "left")
    return written(c.withColumn("sha", F.coalesce("sha", F.sha2(F.col("rep").cast("string"), 256))).drop("x", "y"), "sequences")


def _long_hashes(members: DataFrame, size: int) -> DataFrame:
    """rep, sha: SHA-256 of the conv_ids of each rep, ascending and comma-joined, from chunks that many tasks write."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in whole_runs(batches, ["rep"], size):
            at = np.searchsorted(runs, np.arange(runs[-1] + 2))
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                ids = t.column("conv_id").slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_pylist([{"rep": t.column("rep")[lo].as_py(), "first": ids[0], "ids": ",".join(map(str, ids))}])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep = sha = None
        for b in batches:
            for r, ids in zip(b.column("rep").to_pylist(), b.column("ids"), strict=True):
                if r != rep:
                    if sha:
                        yield pa.RecordBatch.from_pylist([{"rep": rep, "sha": sha.hexdigest()}])
                    rep, sha = r, hashlib.sha256(ids.as_buffer())
                else:
                    sha.update(b",")
                    sha.update(ids.as_buffer())
        if sha:
            yield pa.RecordBatch.from_pylist([{"rep": rep, "sha": sha.hexdigest()}])

    c = members.select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(chunks, "rep bigint, first bigint, ids string")
    return c.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(hashes, "rep bigint, sha string")


def trie(members: DataFrame, turns: DataFrame, listed: int = LISTED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node.

    members: conv_id (distinct), n (turns), total (bytes). turns: conv_id, depth (1 to n), digest, bytes, upto (bytes of the turns up to this one)."""
    classes = _classes(members, turns, listed)
    # level 0: the root; `before` is what the turns above a node hold
    level = classes.agg(
        F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("sequences"), F.min(F.when(F.col("n") == 0, F.col("rep"))).alias("ender"), F.max("n").alias("n"), F.max("total").alias("total"),
    )
    zero = F.lit(0).cast("bigint")
    level = level.where("sequences > 0").withColumns({"depth": zero, "parent": F.lit(None).cast("bigint"), "bytes": zero, "before": zero})
    levels = [written(level, "level")]
    root = levels[0].first()
    live = classes.select("rep", "m", "n", "total", "next", F.lit(0).cast("bigint").alias("before"), F.lit(root and root["conv_id"]).cast("bigint").alias("parent")).where("n > 0")
    shared = int(root is not None and root["sequences"] > 1)
    while shared:
        d = len(levels)
        if d > 1 and d % BLOCK == 1:  # the next turns of those that still live
            some = turns.where(F.col("depth").between(d, d + BLOCK - 1)).join(live.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
            some = some.groupBy(F.col("conv_id").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("next"))
            live = live.drop("next").join(some, "rep")
        live = written(live.withColumn("turn", F.get("next", F.lit((d - 1) % BLOCK))), "live")
        level = live.groupBy("parent", F.col("turn.digest").alias("digest")).agg(
            F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("sequences"), F.min(F.when(F.col("n") == d, F.col("rep"))).alias("ender"),
            F.max("n").alias("n"), F.max("total").alias("total"), F.max("turn.bytes").alias("bytes"), F.max("before").alias("before"),
        )
        level = written(level.withColumn("depth", F.lit(d).cast("bigint")), "level")
        levels.append(level)
        several = level.where("sequences > 1")
        shared = several.count()
        names = several.select(F.struct("parent", "digest").alias("node"), F.col("conv_id").alias("named"), "sequences")
        going = live.where(F.col("n") > d).withColumn("node", F.struct("parent", F.col("turn.digest").alias("digest")))
        going = going.join(F.broadcast(names.drop("sequences")), "node") if shared <= MOST_BROADCAST else join_hot(going, names, "node", "sequences").drop("sequences")
        live = going.select("rep", "m", "n", "total", "next", (F.col("before") + F.col("turn.bytes")).alias("before"), F.col("named").alias("parent"))
    # from the deepest level upwards
    done: list[DataFrame] = []
    for level in reversed(levels):
        alone = level.where("sequences = 1").select(
            "conv_id", "depth", "parent", "n_convs", (F.col("n") > F.col("depth")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * (F.col("total") - F.col("before"))).alias("saved"), "ender", "sequences",
        )
        if done:
            up = done[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
            several = level.where("sequences > 1").join(up, "conv_id").withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes") + F.col("below"))
            alone = alone.unionByName(several.select(*alone.columns))
        done.append(written(alone, "nodes"))
    nodes = reduce(DataFrame.unionByName, done)
    shas = classes.select(F.col("rep").alias("ender"), "sha")
    named = nodes.where("ender IS NOT NULL").join(shas, "ender").unionByName(nodes.where("ender IS NULL").withColumn("sha", F.lit(EMPTY_SHA)))
    named = named.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
    # below a node that one sequence has for itself: a node for each further turn
    last = nodes.where("sequences = 1 AND n_children > 0").select("conv_id", F.col("depth").alias("top"), "n_convs")
    last = last.join(classes.select(F.col("rep").alias("conv_id"), "n", "total", "sha", F.col("n").alias("turns")), "conv_id")
    tail = join_hot(turns.select("conv_id", "depth", "bytes", "upto"), last, "conv_id", "turns").where("depth > top")
    ends = F.col("depth") == F.col("n")
    tail = tail.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", F.when(ends, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"), F.when(ends, F.col("sha")).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )
    return named.unionByName(tail)
