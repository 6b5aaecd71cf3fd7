"""Token ids as flat binary files with 64-bit document offsets, written and read back by memory mapping.

Layout of a folder. `tokens-<part>-<attempt>.bin`: the ids of the part's documents one after the other, unsigned little-endian
16-bit numbers if the vocabulary allows it, else 32-bit. `offsets-<part>-<attempt>.bin`: n + 1 unsigned little-endian 64-bit
numbers, where each document starts in its part and where the last one ends. `docs-<part>-<attempt>.bin`: the n doc_ids,
signed little-endian 64-bit; the first n_null of them stand for null. `manifest`: one Parquet row for each part, with the names
of its files, its counts, and its bases: documents and ids of all parts before it, which are prefix sums over the parts.

Documents are dealt by ranges of doc_id and written in ascending order, null first; repeated doc_ids follow one another, and
ranges split them too. Each task writes files of its own name and tells it in its result; what Spark takes as the part's
result decides which files the manifest names, so a task that is lost, repeated or run twice leaves only files that nobody
reads, which are deleted. The manifest is written last: a folder without one isn't finished.

Encoding: the library encodes; but as the vocabulary's normalizer and splitter drop white space and no token crosses it
(checked on loading, else texts are encoded whole), texts are cut at spaces and line ends, and each distinct piece, without the
marks at its end, is encoded once for as long as the task remembers it.

Edge cases: null and empty texts hold only the end id. Very long texts are cut like others, a long run without white space
isn't. Strings of special tokens inside texts are handled as the library does by default. Repeated rows are written each.
Extra columns are ignored, whatever their names. An empty table gives a manifest without rows.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, written

#: Pieces of a generation that a worker remembers, and the longest one that it does.
REMEMBERED, LONGEST = 1 << 19, 64
#: What stands between pieces that are encoded in one call; pieces with this character are encoded alone.
SEPARATOR = " \x01 "
#: Marks at a piece's end that are tokens of their own after a letter or digit.
MARKS, ALNUM = ".,;:!?", set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
PROBES = ["it's 42 a.m.", "<|endoftext|>", "naïve ÀB中文字 😀", "été", "́x", "don't", "x" * 70, "3rd-party's", "ΑΣ ΑΣ", "tab\tin", "nb sp", "…!?"]


def filesystem(uri: str):
    """The file system of a folder's URI and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Encoder:
    """The ids of texts as bytes. Texts are cut at spaces and line ends where no token of the vocabulary crosses these (see
    `apart`); the ids of the pieces are remembered, in two generations of bounded size, so that frequent ones stay."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        self.special = [t["content"] for t in added]
        self.starts = re.compile("[" + re.escape("".join({t[0] for t in self.special} | {SEPARATOR.strip()})) + "]")
        between = self.tok.encode(SEPARATOR, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        gaps = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in added)
        ends = [x for p in [*PROBES, "The"] for x in (p, p + ".", p + "!?", p.upper() + ",;", p + "'s.")]
        two = [a + gap + b for a in PROBES for b in PROBES for gap in (" ", "\n", " \n ")]
        self.apart = gaps and self.between is not None and self.by_pieces(two + ends) == self.whole(two + ends)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """The ids of new pieces: many in one call, with a separator between them."""
        odd = [p for p in new if self.starts.search(p)]
        self.known.update(zip(odd, self.whole(odd), strict=True))
        plain = [p for p in new if not self.starts.search(p)] if odd else new
        size = self.kind.itemsize
        for at in range(0, len(plain), 2000):
            own = plain[at : at + 2000]
            found = np.array(self.tok.encode_batch_fast([SEPARATOR.join(own)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(found == self.between) * size).tolist()
            raw = found.tobytes()
            starts = [0, *[e + size for e in ends]]
            self.known.update(zip(own, [raw[s:e] for s, e in zip(starts, [*ends, len(raw)], strict=True)], strict=True))

    def by_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*pieces) - known.keys()
        again = new & older.keys()
        known.update([(p, older[p]) for p in again])
        split = []
        for p in new - again:
            # after a letter or digit, marks are tokens of their own; ASCII can be lowered before the normalizer does it
            core = p.rstrip(MARKS)
            core, tail = (core, p[len(core) :]) if core and core[-1] in ALNUM else (p, "")
            split.append((p, core.lower() if core.isascii() and not self.starts.search(core) else core, tail))
        parts = ({c for _, c, _ in split} | {t for _, _, t in split}) - known.keys()
        again = parts & older.keys()
        known.update([(p, older[p]) for p in again])
        self.learn(list(parts - again))
        known.update([(p, known[c] + known[t]) for p, c, t in split])
        out = [b"".join(map(known.__getitem__, own)) for own in pieces]
        for p in [x for x in parts | new if len(x) > LONGEST]:
            known.pop(p, None)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.by_pieces(texts) if self.apart else self.whole(texts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, end_id: int) -> tuple[Callable[[list[str]], list[bytes]], np.dtype]:
    """A function from texts to the bytes of their ids with the end id, and the ids' type. What is remembered stays for later
    tasks of the same worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    e = _encoders[path]
    kind = e.kind if end_id < 1 << 8 * e.kind.itemsize else np.dtype("<u4")
    end = np.array([end_id], kind).tobytes()
    if kind == e.kind:
        return lambda texts: [x + end for x in e(texts)], kind
    return lambda texts: [np.frombuffer(x, e.kind).astype(kind).tobytes() + end for x in e(texts)], kind


def write_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Writes the ids of docs (doc_id, text) to a folder, by default a new one in the shared folder that goes when the application ends; returns its name."""
    spark = docs.sparkSession
    ship(spark)
    if folder is None:
        folder = f"{shared_dir(spark).rstrip('/')}/pulsemill-token-files-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    found_schema = pa.schema([(c, pa.string() if c == "file" else pa.int32() if c == "width" else pa.int64()) for c in ("part", "file", "width", "n_docs", "n_null", "n_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(path, end_id)
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        part = TaskContext.get().partitionId()
        own = f"{part:06d}-{uuid.uuid4().hex}.bin"
        ends, ids, n_null = [np.zeros(1, np.uint64)], [], 0
        total = 0
        with files.open_output_stream(f"{at}/tokens-{own}") as out:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    rows = encode([t or "" for t in some.column("text").to_pylist()])
                    size = np.cumsum([len(r) // kind.itemsize for r in rows])
                    ends.append((size + total).astype(np.uint64))
                    total += int(size[-1])
                    ids.append(some.column("doc_id").fill_null(0).to_numpy().astype("<i8"))
                    n_null += some.column("doc_id").null_count
                    out.write(b"".join(rows))
        if not ids:
            files.delete_file(f"{at}/tokens-{own}")
            return
        for name, value in (("offsets", np.concatenate(ends).astype("<u8")), ("docs", np.concatenate(ids))):
            with files.open_output_stream(f"{at}/{name}-{own}") as out:
                out.write(value.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "file": own, "width": kind.itemsize, "n_docs": sum(map(len, ids)), "n_null": n_null, "n_tokens": total}], found_schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # what follows doc_id only splits and orders repeated ones
    keys = ["doc_id", "h", "nth"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    parts = written(rows.mapInArrow(run, "part bigint, file string, width int, n_docs bigint, n_null bigint, n_tokens bigint"), "parts")
    found = parts.orderBy("part").toPandas()  # one row for each part
    for base, size in (("doc_base", "n_docs"), ("token_base", "n_tokens")):
        found[base] = found[size].cumsum() - found[size]
    schema = "part bigint, file string, width int, n_docs bigint, n_null bigint, n_tokens bigint, doc_base bigint, token_base bigint"
    files, at = filesystem(folder)
    if len(found):
        from pyarrow import fs

        names = {f"{kind}-{own}" for kind in ("tokens", "offsets", "docs") for own in found["file"]}
        for f in files.get_file_info(fs.FileSelector(at)):
            if f.type == fs.FileType.File and f.base_name.endswith(".bin") and f.base_name not in names:
                files.delete_file(f.path)  # of attempts that don't count
    spark.createDataFrame(found, schema).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def mapped(files, name: str):
    """A file for reading: memory-mapped where it lies in a local or mounted folder."""
    from pyarrow import fs

    return pa.memory_map(name) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(name)


def read_files(spark: SparkSession, folder: str, some: int = 4096, documents: int = 1 << 17) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary as in the files), width: all documents of a folder,
    whose parts are read in ranges of so many documents, each range on its own."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/manifest")
    ranges = manifest.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(documents).cast("bigint"))))
    ranges = ranges.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, ranges.count())), "file", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = filesystem(folder)
        for batch in batches:
            for p in batch.to_pylist():
                hi = min(p["n_docs"], p["lo"] + documents)
                kind = np.dtype(f"<u{p['width']}")
                with mapped(files, f"{at}/offsets-{p['file']}") as f:
                    f.seek(8 * p["lo"])
                    ends = np.frombuffer(f.read(8 * (hi - p["lo"] + 1)), "<u8").astype(np.int64)
                with mapped(files, f"{at}/docs-{p['file']}") as f:
                    f.seek(8 * p["lo"])
                    docs = np.frombuffer(f.read(8 * (hi - p["lo"])), "<i8")
                with mapped(files, f"{at}/tokens-{p['file']}") as f:
                    for k in range(0, len(docs), some):
                        e, d = ends[k : k + some + 1], docs[k : k + some]
                        f.seek(int(e[0]) * kind.itemsize)
                        raw = f.read_buffer(int(e[-1] - e[0]) * kind.itemsize)
                        # split once more, so that long documents make small batches
                        cuts = np.unique(np.r_[0, np.searchsorted(e, np.arange(e[0], e[-1], 1 << 20)[1:]), len(d)])
                        for lo, to in zip(cuts[:-1], cuts[1:], strict=True):
                            own = e[lo : to + 1]
                            data = raw.slice(int(own[0] - e[0]) * kind.itemsize, int(own[-1] - own[0]) * kind.itemsize)
                            offsets = ((own - own[0]) * kind.itemsize).astype(np.int32)
                            nth = p["lo"] + k + lo + np.arange(to - lo)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(d[lo:to].astype(np.int64), mask=nth < p["n_null"]), pa.array(own[:-1] + p["token_base"]), pa.array(np.diff(own)),
                                    pa.Array.from_buffers(pa.binary(), int(to - lo), [None, pa.py_buffer(offsets), data]), pa.array(np.full(to - lo, p["width"], np.int32)),
                                ],
                                ["doc_id", "start", "n_tokens", "ids", "width"],
                            )

    return ranges.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary, width int")


def with_crc32(rows: DataFrame) -> DataFrame:
    """rows of read_files() with ids_crc32, the CRC-32 of their ids as 32-bit numbers, instead of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4")) for x, w in zip(b.column("ids"), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
