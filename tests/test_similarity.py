"""Exact neighbours, leaders and the index against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import knn, search, vector_index


def vectors(rng, n, d, crowd=0):
    x = rng.normal(size=(n, d))
    if crowd:
        x[:crowd] = x[0] + rng.normal(size=(crowd, d)) * 0.05
        x[: crowd // 2] = x[0]
    return x


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(4)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("d", "k", "least", "crowd"), [(3, 4, -1.0, 0), (6, 5, 0.75, 0), (16, 3, 0.5, 200), (2, 700, 0.9, 300)])
def test_nearest(spark, monkeypatch, d, k, least, crowd):
    """Blocks are small here, so that groups, blocks and rounds meet; a crowd of copies ties."""
    monkeypatch.setattr(knn, "VECTORS", 64)
    monkeypatch.setattr(knn, "QUERIES", 32)
    rng = np.random.default_rng(d)
    q, v = vectors(rng, 90, d), vectors(rng, 600, d, crowd)
    q[:5] = v[:5]
    s = unit(q) @ unit(v).T
    want = {a: [(b, round(s[a, b], 9)) for b in sorted(range(len(v)), key=lambda b, a=a: (-round(s[a, b], 12), b))[:k] if s[a, b] >= least] for a in range(len(q))}
    got = {a: [] for a in want}
    for r in knn.nearest(frame(spark, q), knn.Cells(frame(spark, v)), k, least).orderBy("id", "rank").collect():
        got[r.id].append((r.other, round(r.similarity, 9)))
        assert r.rank == len(got[r.id])
    assert got == want


def test_nearest_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1e-200, 1e-200]), (7, [2.0, 0.0]), (8, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = [(r.id, r.other) for r in knn.nearest(df, knn.Cells(df), 1).orderBy("id").collect()]
    assert got == [(1, 1), (7, 1), (8, 8)]
    assert knn.nearest(df, knn.Cells(df.limit(0)), 3).count() == 0 and knn.nearest(df.limit(0), knn.Cells(df), 3).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        knn.nearest(spark.createDataFrame([(1, [1.0])], "id long, x array<double>"), knn.Cells(df), 1).count()


def plain_leaders(x, least):
    s, out, free = unit(x) @ unit(x).T, {}, list(range(len(x)))
    led = []
    for k in free:
        if k not in out:
            led.append(k)
            out[k] = k
            for j in range(k + 1, len(x)):
                if j not in out and s[k, j] >= least:
                    out[j] = k
    return out


@pytest.mark.parametrize(("d", "least", "crowd"), [(2, 0.9, 0), (4, 0.8, 150), (8, 0.5, 0)])
def test_leaders(spark, monkeypatch, d, least, crowd):
    monkeypatch.setattr(knn, "VECTORS", 64)
    monkeypatch.setattr(knn, "QUERIES", 32)
    x = vectors(np.random.default_rng(d), 400, d, crowd)
    assert {r.id: r.leader for r in knn.leaders(frame(spark, x), least).collect()} == plain_leaders(x, least)


def test_leaders_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (4, [1.0, 0.0]), (3, [1.0, 0.001])], "id long, x array<double>")
    assert {r.id: r.leader for r in knn.leaders(df, 0.9).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    assert knn.leaders(df.limit(0), 0.9).count() == 0 and {r.leader for r in knn.leaders(df.limit(2), 0.9).collect()} == {1, 2}


def test_no_cross_joins(spark):
    df = frame(spark, vectors(np.random.default_rng(1), 50, 3))
    for out in (knn.nearest(df, knn.Cells(df), 2), knn.leaders(df, 0.8), search.candidates(df, df.withColumn("topic_id", F.col("id")))):
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_index_answers_as_a_scan(spark, metric):
    """After building, adding vectors beyond the radii, and removing; far groups are not read."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 8)) * 4
    x = np.concatenate([c + rng.normal(size=(40, 8)) * 0.3 for c in centres])
    rows = [("a" if k % 3 else "b", k, k % 7, v.tolist()) for k, v in enumerate(x)] + [("a", 5000, 1, [0.0] * 8)]
    df = spark.createDataFrame(rows, "object_type string, id long, topic_id long, x array<double>").repartition(3)
    index = vector_index.scratch_index(df.where("id % 2 = 0"))
    index.add(df.where("id % 2 = 1"))
    index.add(df.where("id % 2 = 1"))  # the same again
    far = spark.createDataFrame([("a", 6000, 1, (centres[0] * 3).tolist())], df.schema)
    index.add(far)
    index.remove(spark.createDataFrame([("a", 1), ("a", 4)], "object_type string, id long"))
    now = df.unionByName(far).where("NOT (object_type = 'a' AND id IN (1, 4))")
    same = lambda a, b: [(r.id, r.distance) for r in a.collect()] == [(r.id, r.distance) for r in b.collect()]
    for q in (centres[3], centres[0] * 3, rng.normal(size=8)):
        q = q.tolist()
        assert same(index.search(q, 7, "a", metric), search.top_k(now, q, 7, "a", metric))
        pruned, every = set(index.read_parts), [p for p in index.store.partitions("index_vectors") if p.startswith("a-")]
        assert pruned <= set(every)
        assert same(index.search(q, 900, "a", metric), search.top_k(now, q, 900, "a", metric))
        assert same(index.search(q, 3, None, metric, F.col("topic_id") == 5), search.top_k(now.where("topic_id = 5"), q, 3, None, metric))
    index.search(centres[3].tolist(), 7, "a", metric)
    if metric != "ip":
        assert len(index.read_parts) < len(every) / 2
    assert search.topics_lenient(index, centres[3].tolist(), 2).count() == 0  # no vector of that type


@pytest.mark.parametrize(("d", "least"), [(2, 0.9), (4, 0.8), (16, 0.9)])
def test_leaders_by_group_in_rounds(spark, monkeypatch, d, least):
    """heads of a group double, and blocks are small here. Groups don't mix; rows without a group or direction lead themselves."""
    monkeypatch.setattr(knn, "HEAD", 16)
    monkeypatch.setattr(knn, "VECTORS", 4)
    x = vectors(np.random.default_rng(d), 300, d, 60)
    x[7] = 0
    df = frame(spark, x).withColumn("grp", F.when(F.col("id") % 10 > 0, F.when(F.col("id") % 3 == 0, "a").otherwise("b")))
    got = {r.id: r.leader for r in knn.leaders(df, least, by="grp").collect()}
    want = {k: k for k in range(300)}
    for own in ([k for k in want if k % 10 and k % 3 == 0], [k for k in want if k % 10 and k % 3 and k != 7]):
        want |= {own[k]: own[v] for k, v in plain_leaders(x[own], least).items()}
    assert got == want


def test_pairs_are_found_in_blocks(spark, monkeypatch):
    """vectors meet as products of blocks; pairs below the threshold are never joined rows. Odd vectors have no pairs."""
    monkeypatch.setattr(knn.blocks, "SLICE", 5)
    x = vectors(np.random.default_rng(3), 90, 4, 20)
    rows = [(k, k % 2, v.tolist()) for k, v in enumerate(x)] + [(900, 0, [0.0] * 4), (901, 0, None), (902, 0, [float("nan")] * 4), (903, None, x[0].tolist())]
    df = spark.createDataFrame(rows, "id long, g int, x array<double>")
    s = unit(x) @ unit(x).T
    want = sorted((a, b, round(s[a, b], 9)) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and s[a, b] >= 0.5)
    for most in (None, 7):
        out = search.cosine_pairs(df, "g", 0.5, most)
        assert sorted((r.a, r.b, round(r.cosine, 9)) for r in out.collect()) == want
        assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_queries_go_to_few_regions(spark, monkeypatch):
    """F5 to F8: where no bound prunes, a query is sent to regions of about a block, not to each centre's cell; none is lost."""
    monkeypatch.setattr(knn, "VECTORS", 256)
    x = vectors(np.random.default_rng(8), 1500, 24)
    cells = knn.Cells(frame(spark, x))
    assert len(cells.centres) > 30 and len(cells.held) <= 2 * 1500 / 256 + 1 and sum(cells.held.values()) == 1500
    asked, inner = [], cells.ask
    monkeypatch.setattr(cells, "ask", lambda q, *a: asked.append(q.count()) or inner(q, *a))
    got = {}
    for r in knn.nearest(frame(spark, x[:200]), cells, 3, 0.1).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    s = unit(x[:200]) @ unit(x).T
    assert got == {k: [b for b in np.argsort(-s[k], kind="stable")[:3].tolist() if s[k, b] >= 0.1] for k in range(200)}
    assert sum(asked) <= 200 * len(cells.held)
