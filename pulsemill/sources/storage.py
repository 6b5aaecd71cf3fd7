"""Parquet tables with the writes that the analytics need: append, upsert by key, replaced partitions, deletes, snapshots."""

from __future__ import annotations

import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import TABLES, Table


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).parents[1]
        to = Path(tempfile.mkdtemp(prefix="pulsemill-")) / "pulsemill_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(to))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, on one machine only, a folder of our own."""
    sc = spark.sparkContext
    ship(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pulsemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Conflict(RuntimeError):
    """A partition that a write was to replace has been changed by another writer since it was read."""


class Store:
    """Tables under a folder of any file system that Spark writes.

    A table is cut into partitions, as schema.TABLES says (a period, a day, a bucket of keys). A snapshot is a manifest, a small
    numbered file that names the folders of each partition; the highest number counts. A write puts its rows into new folders,
    only for the partitions it touches, and then publishes one manifest that points to them and to the untouched folders of
    before. Manifests are renamed into place and never overwritten, so readers and crashes see a snapshot or the next one.
    If another writer was faster, the write is published on top of theirs, unless they changed the same partitions: then it
    raises Conflict (appends never do). The last KEPT manifests and what they name stay for readers; vacuum() removes the rest."""

    KEPT = 3
    TRIES = 50

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), TABLES if tables is None else tables

    @classmethod
    def scratch(cls, spark: SparkSession) -> Store:
        """A store in the shared folder that goes when the application ends."""
        store = cls(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")
        store._fs(store.root).deleteOnExit(store._path(store.root))
        return store

    # ------------------------------------------------------------------ manifests

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self, where: str):
        return self._path(where).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder), self._path(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _numbers(self, name: str) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.root}/{name}/manifests") if n.endswith(".json") and n[0].isdigit()]

    def _load(self, name: str, number: int) -> dict:
        where = f"{self.root}/{name}/manifests/{number:012d}.json"
        stream = self._fs(where).open(self._path(where))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, name: str) -> dict:
        """number, parts (partition: its folders) and schema of the newest snapshot; number -1 if there is none."""
        numbers = self._numbers(name)
        return self._load(name, numbers[-1]) if numbers else {"number": -1, "parts": {}, "schema": None}

    def _create(self, name: str, manifest: dict) -> bool:
        """Whether the manifest got its number; False if another writer had it first."""
        jvm, folder = self.spark._jvm, f"{self.root}/{name}/manifests"
        waiting, final = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{manifest['number']:012d}.json")
        fs = self._fs(folder)
        out = fs.create(waiting, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(waiting), fs.makeQualified(final), options)
        except Py4JJavaError as x:
            fs.delete(waiting, False)
            if "FileAlreadyExists" in str(x.java_exception):
                return False
            raise
        return True

    def _publish(self, name: str, base: dict, changes: dict[str, list[str]], schema: T.StructType | None, whole: bool = False, add: bool = False) -> None:
        """A snapshot in which the partitions of `changes` have these folders (with add: besides those they have; none: the
        partition goes). whole: no other partitions stay."""
        for _ in range(self.TRIES):
            now = self.manifest(name)
            mine = set(changes) | (set(base["parts"]) | set(now["parts"]) if whole else set())
            if not add and any(now["parts"].get(p) != base["parts"].get(p) for p in mine):
                raise Conflict(f"{name} was written at the same time")
            parts = {} if whole else dict(now["parts"])
            for p, folders in changes.items():
                parts[p] = (parts.get(p, []) if add else []) + folders
            merged = _merged(None if whole or now["schema"] is None else T.StructType.fromJson(now["schema"]), schema, name)
            new = {"number": now["number"] + 1, "parts": {p: f for p, f in parts.items() if f}, "schema": merged.jsonValue()}
            if self._create(name, new):
                self._forget(name)
                return
        raise Conflict(f"{name} is written too often")

    def _forget(self, name: str) -> None:
        numbers = self._numbers(name)
        old, kept = numbers[: -self.KEPT], numbers[-self.KEPT :]
        if not old:
            return
        alive = {f for n in kept for folders in self._load(name, n)["parts"].values() for f in folders}
        fs = self._fs(self.root)
        for n in old:
            gone = {f for folders in self._load(name, n)["parts"].values() for f in folders} - alive
            for f in gone:
                fs.delete(self._path(f"{self.root}/{name}/{f}"), True)
            fs.delete(self._path(f"{self.root}/{name}/manifests/{n:012d}.json"), False)

    def vacuum(self, name: str) -> list[str]:
        """Deletes folders that no kept manifest names, as failed writes leave them; not to be called while others write."""
        alive = {f.split("/")[0] for n in self._numbers(name) for folders in self._load(name, n)["parts"].values() for f in folders}
        gone = [v for v in self._names(f"{self.root}/{name}") if v != "manifests" and v not in alive]
        for v in gone:
            self._fs(self.root).delete(self._path(f"{self.root}/{name}/{v}"), True)
        return gone

    # ------------------------------------------------------------------ reading

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def partitions(self, name: str) -> list[str]:
        """The values of the partitions that have rows, as text; 'all' for a table of one partition."""
        return sorted(p[1:] if p.startswith("v") else p for p in self.manifest(name)["parts"])

    def _read(self, name: str, manifest: dict, parts: Iterable[str] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"no such table: {name}")
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{name}/{f}" for p in (manifest["parts"] if parts is None else parts) for f in manifest["parts"].get(p, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, parts: Iterable[str] | None = None) -> DataFrame:
        """The newest snapshot, or these of its partitions only; their values as partitions() gives them."""
        return self._read(name, self.manifest(name), None if parts is None else [p if p in ("null", "all") else f"v{p}" for p in parts])

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows with these keys (columns of the table, by which it is cut), from the partitions that can hold them."""
        keys = self._table(name).typed(keys)
        cut = keys.select(self._table(name).part().alias("p")).distinct()
        m = self.manifest(name)
        found = self._read(name, m, [r["p"] for r in cut.collect()])  # a row for each partition at most
        return found.join(keys.distinct(), keys.columns, "left_semi").select(found.columns)

    def _table(self, name: str) -> Table:
        return self.tables.get(name) or Table()

    # ------------------------------------------------------------------ writing

    def _write(self, name: str, df: DataFrame) -> tuple[dict[str, list[str]], T.StructType]:
        """Writes df into a new folder for each of its partitions. AQE gives small partitions to one task and splits large ones."""
        t = self._table(name)
        df = t.checked(df)
        version = uuid.uuid4().hex
        out = df.withColumn("__part", t.part())
        if t.partition is not None:
            out = out.hint("rebalance", "__part")
        out.write.partitionBy("__part").parquet(f"{self.root}/{name}/{version}")
        parts = [n for n in self._names(f"{self.root}/{name}/{version}") if n.startswith("__part=")]
        return {unquote(n.removeprefix("__part=")): [f"{version}/{n}"] for n in parts}, df.schema

    def replace(self, name: str, df: DataFrame) -> None:
        base = self.manifest(name)
        parts, schema = self._write(name, df)
        self._publish(name, base, parts, schema, whole=True)

    def append(self, name: str, df: DataFrame) -> None:
        base = self.manifest(name)
        parts, schema = self._write(name, df)
        self._publish(name, base, parts, schema, add=True)

    def upsert(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """Rows of df take the place of rows with the same keys. df is written first; of the partitions it falls into, the
        other rows are written again; no other partition is read or written."""
        keys = list(keys or self._table(name).keys)
        base = self.manifest(name)
        parts, schema = self._write(name, df)
        touched = [p for p in parts if p in base["parts"]]
        if touched:
            new = self._read(name, {"parts": parts, "schema": schema.jsonValue()})
            rest, _ = self._write(name, self._read(name, base, touched).join(new.select(*keys).distinct(), keys, "left_anti"))
            parts = {p: f + rest.get(p, []) for p, f in parts.items()}
        self._publish(name, base, parts, schema)

    def replace_rows(self, name: str, df: DataFrame, keys: DataFrame) -> None:
        """Rows with these keys (columns by which the table is cut) go, and the rows of df, which have no other keys, come. Only
        the partitions that have or get such rows are written."""
        base = self.manifest(name)
        keys = checkpointed(self._table(name).typed(keys).distinct())
        parts, schema = self._write(name, df)
        touched = {r["p"] for r in keys.select(self._table(name).part().alias("p")).distinct().collect()} & set(base["parts"])  # a row for each partition at most
        if touched:
            rest, _ = self._write(name, self._read(name, base, sorted(touched)).join(keys, keys.columns, "left_anti"))
            parts = {p: parts.get(p, []) + rest.get(p, []) for p in touched | set(parts)}
        self._publish(name, base, parts, schema)

    def replace_parts(self, name: str, df: DataFrame, parts: Iterable[str] = ()) -> None:
        """The partitions that df has, and these, hold the rows of df only; they aren't read, and the others keep their files."""
        base = self.manifest(name)
        new, schema = self._write(name, df)
        self._publish(name, base, {f"v{p}": [] for p in parts} | new, schema)

    def replace_days(self, name: str, df: DataFrame) -> None:
        """The days that df has are replaced; the others keep their files."""
        self.replace_parts(name, df)

    def delete(self, name: str, victims: DataFrame, keys: list[str] | None = None) -> int:
        """Deletes the rows with these keys and returns their number; partitions without any keep their files."""
        keys = list(keys or self._table(name).keys)
        base = self.manifest(name)
        gone = victims.select(*keys).distinct()
        hit = self._read(name, base).join(gone, keys, "left_semi").groupBy(self._table(name).part().alias("p")).count().collect()  # a row for each partition at most
        if hit:
            rest, schema = self._write(name, self._read(name, base, [r["p"] for r in hit]).join(gone, keys, "left_anti"))
            self._publish(name, base, {r["p"]: rest.get(r["p"], []) for r in hit}, schema)
        return sum(r["count"] for r in hit)

    def clear(self, name: str) -> None:
        base = self.manifest(name)
        self._publish(name, base, {}, T.StructType.fromJson(base["schema"]), whole=True)


def _merged(old: T.StructType | None, new: T.StructType, name: str) -> T.StructType:
    """The columns of both, all nullable, as older rows lack newer columns."""
    have = {f.name: f.dataType for f in old or []}
    for f in new:
        if have.setdefault(f.name, f.dataType).simpleString() != f.dataType.simpleString():
            raise ValueError(f"{name}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(n, t, True) for n, t in have.items()])


#: For each table, the tables whose rows go with its rows: (table, its column, the parent's column).
CHILDREN = {
    "items": [("nodes", "item_id", "id"), ("placements", "item_id", "id"), ("topic_item_view", "item_id", "id")],
    "topics": [(t, "topic_id", "topic_id") for t in ("nodes", "placements", "period_heat", "topic_categories", "topic_stats", "topic_changes", "topic_item_view", "summaries")],
    "summaries": [("summary_vectors", "id", "id")],
}


def cascade(store: Store, victims: dict[str, DataFrame], dry_run: bool = True) -> dict[str, int]:
    """Deletes rows (by the keys of their tables) and all that hangs on them, children first; returns the number of rows by
    table. A dry run, the default, only counts. What goes is decided before anything does, so a run that failed can be
    repeated as long as the victims can be told: parents go last."""
    doomed: dict[str, DataFrame] = {}
    order: list[str] = []

    def add(name: str, rows: DataFrame) -> None:
        if not store.exists(name):
            return
        keys = list(store.tables[name].keys)
        own = store.read(name).join(rows.distinct(), rows.columns, "left_semi").select(*keys)
        doomed[name] = own if name not in doomed else doomed[name].unionByName(own)
        for child, column, parent in CHILDREN.get(name, []):
            add(child, own.select(F.col(parent).alias(column)))
        if name in order:
            order.remove(name)
        order.append(name)

    for name, rows in victims.items():
        add(name, rows)
    gone = {n: checkpointed(doomed[n].distinct()) for n in order}
    return {n: gone[n].count() if dry_run else store.delete(n, gone[n]) for n in order}


def cleanup_victims(items: DataFrame, topics: DataFrame, titles: list[str], url_parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, topics) that a clean-up would delete: items by title or a part of their url; topics by title, or of these items."""
    bad = F.col("title").isin(titles)
    for part in url_parts:
        bad = bad | F.contains("url", F.lit(part))
    gone = items.where(bad)
    by_title = topics.where(F.col("title").isin(titles)).select("topic_id")
    return gone.select("id"), by_title.unionByName(gone.select("topic_id")).distinct()
