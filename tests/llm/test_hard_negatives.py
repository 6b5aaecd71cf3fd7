"""Block multiplication against plain scores on small tables with awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.llm import hard_negatives as H

WRAP = 1 << 64


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """What mine() gives for (vec_id, label, vector) rows, one score at a time."""
    sound = []
    for vec_id, label, x in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            sound.append((vec_id, label, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * c))) for c in x]))
    out = []

    def order(p):
        return -p[0], p[1] is None, p[1] or 0

    for k, (a, la, xa) in enumerate(sound):
        if not is_anchor(a):
            continue
        scored = []
        for j, (b, lb, xb) in enumerate(sound):
            if j != k and len(xb) == len(xa):
                s = (sum(p * q for p, q in zip(xa, xb, strict=True)) + (WRAP >> 1)) % WRAP - (WRAP >> 1)
                scored.append((s, b, lb))
        own = sorted((p for p in scored if p[2] == la), key=order)[:positives]
        others = sorted((p for p in scored if p[2] != la), key=order)
        for s, b, _ in own:
            found = [p for p in others if low * s <= 100 * p[0] <= high * s][:negatives]
            out += [(a, b, r + 1, p[1], s, p[0]) for r, p in enumerate(found)]
    return sorted(map(repr, out))


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit("x"), "kind": F.lit(1), "block": F.lit(2), "score": F.lit("y")})
    return H.mine(df, F.col("vec_id") % 10 == 0, **how)


def anchor(v):
    return v is not None and v % 10 == 0


ODD = [
    (0, 1, [0.5, 0.25, 0.1]), (10, 1, [0.5, 0.25, 0.1]), (1, 1, [0.5, 0.25, 0.1]), (1, 1, [0.5, 0.25, 0.1]), (2, 2, [0.5, 0.25, 0.09]), (3, 2, [0.5, 0.25, 0.1]), (None, 1, [0.4, 0.3, 0.1]),
    (None, 3, [0.49, 0.25, 0.1]), (20, None, [0.5, 0.2, 0.1]), (30, 1, None), (40, 1, [0.1, None, 0.2]), (50, 1, [0.1, float("nan"), 0.2]), (60, 1, [float("inf"), 0.0, 0.0]), (70, 1, []), (71, 1, []), (72, 2, []),
    (80, 4, [0.1, 0.2]), (81, 4, [0.1, 0.2]), (82, 5, [0.1, 0.19]), (90, 7, [0.5, 0.25, 0.1]), (100, 1, [-0.5, -0.25, -0.1]), (0, 2, [0.45, 0.3, 0.1]), (4, 6, [0.0, 0.0, 0.0]), (110, 6, [0.0, 0.0, 0.0]),
]


@pytest.mark.parametrize("how", [{}, {"anchor_block": 2, "row_block": 3, "chunks": 3}, {"chunks": 1, "row_block": 5}])
def test_awkward_rows(spark, how):
    got = sorted(repr(tuple(r)) for r in mined(spark, ODD, **how).collect())
    assert got == plain(ODD, anchor) and len(got) > 20


@pytest.mark.parametrize("hot", [False, True])
def test_random_rows(spark, hot):
    """Also with a label, an id and a vector that a third of all rows have."""
    rng = np.random.default_rng(3)
    common = [0.3] * 8
    rows = [(7 if hot and k % 3 == 0 else int(k), 1 if hot and k % 3 == 0 else int(rng.integers(0, 6)), common if hot and k % 3 == 0 else rng.normal(size=8).round(2).tolist()) for k in range(300)]
    got = sorted(repr(tuple(r)) for r in mined(spark, rows, anchor_block=7, row_block=32, positives=4, negatives=3, low=50).collect())
    assert got == plain(rows, anchor, positives=4, negatives=3, low=50)


def test_large_components_wrap(spark):
    """Sums beyond 64 bits wrap around, whatever the ranges of dimensions; components are held at 64 bits."""
    rows = [(10 * k, k % 2, [1e18 * (k - 3), -2e17 * k, 3e15 + k]) for k in range(8)] + [(1, 0, [1e300, -1e300, 0.5])]
    for chunks in (1, 2, 3):
        got = sorted(repr(tuple(r)) for r in mined(spark, rows, chunks=chunks).collect())
        assert got == plain(rows, anchor)


def test_exact_product_beyond_doubles():
    a = np.array([[1 << 40, 3], [5, -(1 << 62)]])
    b = np.array([[1 << 40, 1], [7, 9]])
    want = [[((int(p) * int(r) + int(q) * int(s)) + (WRAP >> 1)) % WRAP - (WRAP >> 1) for r, s in b] for p, q in a]
    assert H.exact_product(a, b).tolist() == want


def test_empty_table(spark):
    assert mined(spark, []).count() == 0 and mined(spark, [(1, 1, [0.5])]).count() == 0


def test_plan_has_no_cross_join(spark):
    plan = mined(spark, ODD)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
