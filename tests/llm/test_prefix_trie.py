"""The trie against a plain one."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string"


def sequences(rows, base, borrowed):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    return {c: own.get(base(c), [])[: borrowed(c)] + ts[borrowed(c) :] for c, ts in own.items()}


def plain(seqs):
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = own + sum(saved[x] for x in kids[k])
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(seqs[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(nodes[k]), len(k), parent, len(nodes[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def built(spark, rows, base=None, borrowed=None, parts=5, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "n": F.lit("x"), "pos": F.lit(2), "part": F.lit(3)}).repartition(parts)
    turns = T.numbered(df)
    c = F.col("conv_id")
    base, borrowed, most, has = (c, F.lit(0), 0, F.lit(False)) if base is None else (base, borrowed, 8, c % 5 == 0)
    return sorted(repr(tuple(r)) for r in T.trie(*T.rebuilt(turns, base, borrowed, most, has), **how).collect())


def op13(spark, rows, **how):
    c = F.col("conv_id")
    return built(spark, rows, c - c % 5, F.crc32(c.cast("string")) % 9, **how)


def op13_plain(rows):
    return plain(sequences(rows, lambda c: c - int(np.fmod(c, 5)), lambda c: zlib.crc32(str(c).encode()) % 9))


def test_awkward_rows(spark):
    rows = [
        (1, 2, "user", "b"), (1, 1, "user", "a"), (1, None, None, None), (2, 1, "", ""), (2, 1, None, ""), (2, 2, "user", "a"), (None, 1, "user", "lost"), (3, 1, "us", "era"), (3, 1, "use", "ra"), (4, 1, "user", "a"),
        (4, 1, "user", "a"), (4, 1, "user", "ä"), (5, 1, "x", "y" * 5000), (6, 1, "x", "y" * 5000), (-3, 1, "x", "y" * 5000), (-3, 2, "x", "z"), (7, 1, "x", "y" * 5000 + "!"), (10, 1, "x", "p" * 70 + "b"), (10, 1, "x", "p" * 70 + "a"),
    ]
    some = [r for r in rows if r[0] != 10]  # the order of tied texts that agree in 64 characters is that of their hashes
    assert built(spark, some) == plain(sequences(some, lambda c: None, lambda c: 0))
    assert op13(spark, some) == op13_plain(some)
    assert built(spark, rows) == built(spark, rows[::-1], parts=2)


def test_random_trees(spark):
    """Conversations that share prefixes, copies, and turnless ones; copies are hashed in lists and in chunks."""
    rng = np.random.default_rng(8)
    rows = [(int(c), t, "ab"[rng.integers(2)], "xy"[rng.integers(2)] * int(rng.integers(0, 3))) for c in rng.permutation(400)[:300] for t in range(rng.integers(1, 9))]
    want = op13_plain(rows)
    assert op13(spark, rows) == want
    assert op13(spark, rows, listed=1) == want


def test_long_shared_prefixes(spark, monkeypatch):
    """More shared turns than a conversation carries along; one conversation over all partitions; many copies in chunks."""
    monkeypatch.setattr(T, "CHUNK", 4)
    monkeypatch.setattr(T, "BLOCK", 3)
    turns = [("user", f"turn {k}") for k in range(11)]
    rows = [(c, t, *turns[t]) for c in (1, 2, 3) for t in range(11)] + [(2, 11, "user", "end")] + [(4, t, *turns[t]) for t in range(7)] + [(5, t, "user", f"other {t % 7}") for t in range(900)]
    rows += [(100 + c, t, *turns[t]) for c in range(40) for t in range(4)] + [(6, 0, *turns[0])]
    assert built(spark, rows, listed=10) == plain(sequences(rows, lambda c: None, lambda c: 0))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_nothing(spark, rows):
    assert built(spark, rows) == []


def test_one_sequence(spark):
    """The root is alone with its copies from the start; a conversation whose turns are all given up ends there."""
    rows = [(c, t, "user", "é" * t) for c in (7, 3, 12) for t in range(3)]
    assert built(spark, rows) == plain(sequences(rows, lambda c: None, lambda c: 0))
    gone = [(c, 0, "user", "x") for c in range(1, 5)]
    assert op13(spark, gone) == op13_plain(gone)


def test_conversation_over_partitions(spark):
    """Numbers and sums go on where a range of the sort ends inside a conversation."""
    rows = spark.createDataFrame([(1, t % 50, "u", "x" * (t % 3)) for t in range(5000)] + [(0, 1, "u", "y"), (2, 1, "u", "zz")], SCHEMA)
    got = T.numbered(rows.repartition(9)).orderBy("conv_id", "pos").collect()
    assert [r.pos for r in got] == [1, *range(1, 5001), 1]
    assert [r.upto for r in got[1:-1]] == np.cumsum([r.bytes for r in got[1:-1]]).tolist() and got[-1].upto == 2
