"""A vector index as tables of the store: vectors by the coarse centre they are nearest to, and the radii of these cells.

A search orders the cells by a bound of what they can hold and reads partitions until the bound proves that no other cell has
one of the k nearest; so its answers are those of a scan. Centres stay as they were built. Vectors that are added go to
their nearest centre and widen its radii, first the radii, then the vectors, so that a search between the two, or after a
failure, is still exact. The driver holds the centres and a row for each cell, at most knn.MOST_CENTRES of each kind."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import Store, checkpointed
from . import knn
from .search import top_k

#: Bounds are loosened by this share, as sums of doubles are rounded.
LOOSE = 1e-9


class VectorIndex:
    """Vectors (object_type, id, topic_id, x, and more columns) in the index tables of a store."""

    def __init__(self, store: Store):
        self.store = store
        self.read_parts: list[str] = []  # partitions of the last search

    def _table(self, kind: str) -> str:
        return f"index_{kind}"

    def build(self, vectors: DataFrame) -> None:
        """Chooses centres from a sample of bounded size and replaces what is there."""
        unit = checkpointed(knn.units(vectors))
        centres = knn.centres_of(unit, unit.count())
        length = vectors.agg(F.avg(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)))).first()[0] or 0.0
        rows = [(k, c.tolist(), float(length)) for k, c in enumerate(centres)]
        for kind in ("vectors", "cells"):
            if self.store.exists(self._table(kind)):
                self.store.clear(self._table(kind))
        self.store.replace(self._table("centres"), self.store.spark.createDataFrame(rows, "cell int, centre array<double>, length double"))
        self.add(vectors)

    def _centres(self) -> tuple[np.ndarray, float]:
        rows = sorted(self.store.read(self._table("centres")).collect())
        return np.array([r["centre"] for r in rows]).reshape(len(rows), -1), rows[0]["length"] if rows else 0.0

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors, or the same ones again. One whose value changes has to be removed first."""
        centres, length = self._centres()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, near, reach = [], [], []
                for x in b.column("x"):
                    x = np.array(x.as_py() or [], dtype=np.float64)
                    n = math.sqrt((x * x).sum()) if len(x) == centres.shape[1] and np.isfinite(x).all() else 0.0
                    if not n:  # without a direction: a cell of its own, which every search by length reads
                        cells.append(-1)
                        near.append(None)
                        reach.append(float("inf"))
                        continue
                    d = knn.distances((x / n)[None, :], centres)[0]
                    cells.append(int(d.argmin()))
                    near.append(float(d.min()))
                    reach.append(float(np.linalg.norm(x - length * centres[cells[-1]])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32()), pa.array(near, pa.float64()), pa.array(reach, pa.float64())], names)

        own = vectors.drop("cell", "__near", "__reach").withColumn("x", F.col("x").cast("array<double>"))
        names = [*own.columns, "cell", "__near", "__reach"]
        schema = T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("__near", T.DoubleType()), T.StructField("__reach", T.DoubleType())])
        rows = checkpointed(own.mapInArrow(run, schema))
        widened = rows.groupBy("object_type", "cell").agg(F.count("*").alias("n"), F.max("__near").alias("radius"), F.max("__reach").alias("reach"))
        if self.store.exists(self._table("cells")):
            both = widened.unionByName(self.store.read(self._table("cells")).select(widened.columns))
            widened = both.groupBy("object_type", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("reach").alias("reach"))
        self.store.upsert(self._table("cells"), widened, ["object_type", "cell"])
        self.store.upsert(self._table("vectors"), rows.drop("__near", "__reach"), ["object_type", "id"])

    def remove(self, ids: DataFrame) -> int:
        """Deletes vectors by object_type and id; radii stay as they are, which is still exact."""
        return self.store.delete(self._table("vectors"), ids, ["object_type", "id"])

    def _bounds(self, q: np.ndarray, object_type: str | None, metric: str) -> list[tuple[float, str]]:
        """(the least distance, or for "ip" the negated largest product, that a row of the cell can have; its partition), in order."""
        centres, length = self._centres()
        cells = self.store.read(self._table("cells"))
        cells = cells.where(F.col("object_type") == object_type) if object_type else cells
        size = float(np.linalg.norm(q))
        here = set(self.store.partitions(self._table("vectors")))
        out = []
        for r in cells.collect():
            part = f"{r['object_type']}-{r['cell']}"
            if part not in here:
                continue
            if r["cell"] < 0:
                if metric != "cosine":
                    out.append((-math.inf, part))
                continue
            c = centres[r["cell"]]
            if metric == "cosine":
                low = max(0.0, float(knn.distances(q[None, :] / size, c[None, :])[0, 0]) - r["radius"]) ** 2 / 2 if size else 0.0
            elif metric == "ip":
                low = -(float(q @ c) * length + size * r["reach"])
            else:
                low = max(0.0, float(np.linalg.norm(q - length * c)) - r["reach"]) ** 2
            out.append((low - LOOSE * (1 + abs(low)), part))
        return sorted(out)

    def rows_for(self, q: list[float], k: int, object_type: str | None = None, metric: str = "cosine", where: Column | None = None) -> DataFrame:
        """The rows of the cells that can hold one of the k nearest (of those that meet the condition): what a top k may be taken from."""
        vector = np.array(q, dtype=np.float64)
        bounds, name = self._bounds(vector, object_type, metric), self._table("vectors")
        some, step = 0, 4

        def of(n: int) -> DataFrame:
            rows = self.store.read(name, [p for _, p in bounds[:n]])
            return rows if where is None else rows.where(where)

        while some < len(bounds):
            some = min(len(bounds), max(step, 2 * some))
            found = top_k(of(some), q, k, None, metric).select("distance").collect()  # k rows
            if len(found) == k:
                worst = max(-r[0] if metric == "ip" else r[0] for r in found)
                some = max(some, sum(b <= worst for b, _ in bounds))
                break
        self.read_parts = [p for _, p in bounds[:some]]
        return of(some)

    def search(self, q: list[float], k: int, object_type: str | None = None, metric: str = "cosine", where: Column | None = None) -> DataFrame:
        """As search.top_k over all vectors (that meet the condition)."""
        return top_k(self.rows_for(q, k, object_type, metric, where), q, k, None, metric)


def scratch_index(vectors: DataFrame) -> VectorIndex:
    """An index in a store of its own, in the shared folder."""
    index = VectorIndex(Store.scratch(vectors.sparkSession))
    index.build(vectors)
    return index
