"""What the operators of this subpackage share: scratch tables, appended columns, sorted runs, components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()
#: Texts go to Python in small batches: each is held several times, by Spark, Arrow and the worker. Only Spark's own
#: defaults are replaced, not what a session sets.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608b"}
BATCHES_UNSET = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}
#: Rows of scratch tables wait in a writer's memory until a row group is full.
ROW_GROUP = 16 << 20
#: Keys that are broadcast at most; more are shuffled.
MOST_BROADCAST = 100_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).parents[1]
        to = Path(tempfile.mkdtemp(prefix="pulsemill-")) / "pulsemill_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(to))
    for key, value in BATCHES.items():
        if spark.conf.get(key) == BATCHES_UNSET[key]:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulsemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/pulsemill-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def only(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows whose key is (or with left_anti: isn't) among the keys. Up to MOST_BROADCAST keys are broadcast; more are shuffled."""
    keys = written(keys.select(key).distinct(), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, key, how)


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """rows joined with table (key distinct; count: how many rows hold the key). Keys with over a `most`-th of all rows,
    of which there are fewer than `most`, are looked up by broadcast where the rows lie; the others are shuffled."""
    table = written(table, "keyed")
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(10_000, total // most)
    hot, others = table.where(F.col(count) > limit).drop(count), table.where(F.col(count) <= limit).drop(count)
    if hot.isEmpty():
        return rows.join(others, key)
    here = rows.join(F.broadcast(hot), key)
    return here.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key))


def cut(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint()


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], rows: int = 1000) -> DataFrame:
    """df with columns that Python computes from Arrow batches. make() runs once per task and returns the function
    of a batch, which gets at most `rows` rows, so that its memory is small beside the batch that Spark sends. Columns of
    df that have a new column's name are replaced."""
    ship(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    names = kept + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names)

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts one by one; null counts as empty."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or ""


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by keys: tables that hold whole runs of equal keys, and each row's run number. With `most`, a run
    comes in parts, each a table of its own, as soon as that many of its rows are held."""
    held: list[pa.Table] = []
    last: tuple | None = None

    def changes(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return change

    def numbered(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        t = pa.concat_tables(parts).combine_chunks()
        return t, np.cumsum(changes(t))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = changes(t)
        key = tuple(t.column(k)[0].as_py() for k in keys)
        if last is not None and key != last:
            change[0] = True
        at = np.flatnonzero(change)
        if len(at):  # what is held so far is complete up to the last change
            head = t.slice(0, int(at[-1]))
            parts = [*held, head] if head.num_rows else held
            if parts:
                yield numbered(parts)
            held = [t.slice(int(at[-1]))]
        else:
            held.append(t)
        last = tuple(t.column(k)[t.num_rows - 1].as_py() for k in keys)
        if most is not None and sum(x.num_rows for x in held) >= most:
            yield numbered(held)
            held = []
    if held:
        yield numbered(held)


def pairs_in_runs(run: np.ndarray, reach: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i, j), i < j, within each run, or those `reach` apart at most; a distance at a time, so that memory
    stays linear."""
    live, o = np.arange(len(run)), 1
    while reach is None or o <= reach:
        live = live[live + o < len(run)]
        live = live[run[live + o] == run[live]]
        if not len(live):
            return
        yield live, live + o
        o += 1


def forest(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, root) that connect what the edges a-b over n rows connect; roots have the smallest order."""
    rank = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    back = np.argsort(rank, kind="stable")
    a, b = rank[a], rank[b]
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        before = lab.copy()
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        np.minimum.at(lab, before[a], low)
        np.minimum.at(lab, before[b], low)
        lab = lab[lab]
        if (lab == before).all():
            break
    child = np.flatnonzero(lab != np.arange(n))
    return back[child], back[lab[child]]


def split_hot(rows: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """Rows with __i and __j: a group of more than `most` rows becomes chunks, and each two chunks meet in one block
    (__i, __j), so that no block has over about 2 x most rows and every two rows of a group meet in exactly one block
    that counts them (see same_block). Each row also gets its chunk, __r."""
    hot = rows.groupBy(*keys).count().where(F.col("count") > most).withColumn("__c", F.ceil(F.col("count") / most).cast("int")).drop("count")
    r = rows.join(hot, keys, "left").withColumn("__c", F.coalesce("__c", F.lit(1)))
    r = r.withColumn("__r", F.pmod(F.xxhash64(F.lit(7), by), F.col("__c").cast("bigint")).cast("int"))
    r = r.withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    return r.withColumns({"__i": F.least("__r", "__s"), "__j": F.greatest("__r", "__s")}).drop("__c", "__s")


def same_block(i: np.ndarray, j: np.ndarray, r: np.ndarray, ci: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """Which pairs this block counts: all in a block of one chunk, else those of two chunks."""
    return (ci[i] == cj[i]) | (r[i] != r[j])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v); component: the smallest node it reaches. Alternates large and
    small stars; each round is two joins over the edges, which only get fewer, and its result is checkpointed. Nothing
    goes to the driver but a count and a sum."""
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        near = e.join(low, "u")
        e = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
