"""Token files against the library and against their own bytes."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.llm import queries, token_files

WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
LONG = " ".join(f"Word{k % 997}, don't" for k in range(30_000))
ODD = [
    (3, "Hello  World's\t3rd day \x1c  x"), (1, None), (2, ""), (9, "repeated id one"), (9, "repeated id two"), (9, "repeated id two"), (None, "null id"), (None, None), (7, LONG), (8, "a" * 5000 + " b"),
    (-5, "naïve ÀB 中文字 😀 <|endoftext|> x<|startoftext|>y é ́z ΑΣ İ ﬁ"), (4, " \n\t "), (11, "<|end oftext|>"),
]


def plain(rows, path, end):
    from tokenizers import Tokenizer

    tok, at, out = Tokenizer.from_file(path), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def read(spark, rows, path=WORD, end=2):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "nth": F.lit(2), "ids": F.lit("x")}).repartition(4)
    folder = token_files.write_files(df, path, end)
    return folder, token_files.read_files(spark, folder)


def key(r):
    return r[0] is not None, r[0] or 0, r[2], r[3]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_awkward_texts(spark, path):
    """The second vocabulary's pieces hold spaces, so its texts are encoded whole."""
    folder, rows = read(spark, ODD, path)
    got = [tuple(r) for r in token_files.with_crc32(rows).collect()]
    want = plain(ODD, path, 2)
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted(map(key, want))
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]


def test_encoder_pieces():
    """Texts cut at white space give the library's ids; remembered pieces are bounded."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    encode, kind = token_files.encoder(WORD, 2)
    rng = np.random.default_rng(4)
    marks = list("abcXYZ's  .,\n\t\r\x0b\x85　 é́ßΣς中😀<|>012") + ["'ll", "'s ", "<|endoftext|>", " ́", "ſ", "K"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 40))) for _ in range(5000)]
    assert kind == np.dtype("<u2")
    assert [np.frombuffer(x, kind).tolist() for x in encode(texts)] == [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_layout(spark, tmp_path):
    """The files' bytes are as the module says, with bases that are prefix sums; files of lost attempts are gone."""
    rows = [(k, f"text number {k} " * (k % 5)) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "tokens-000000-lost.bin").write_bytes(b"lost")
    folder = token_files.write_files(df, WORD, 2, folder=f"file://{tmp_path}/out")
    parts = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    assert not (tmp_path / "out" / "tokens-000000-lost.bin").exists()
    seen, docs, tokens = [], 0, 0
    for p in parts:
        assert (p.doc_base, p.token_base) == (docs, tokens)
        ids = np.memmap(tmp_path / "out" / f"tokens-{p.file}", "<u2", "r")
        ends = np.memmap(tmp_path / "out" / f"offsets-{p.file}", "<u8", "r")
        own = np.memmap(tmp_path / "out" / f"docs-{p.file}", "<i8", "r")
        assert len(ids) == p.n_tokens == ends[-1] and len(own) == p.n_docs == len(ends) - 1
        for k, d in enumerate(own):
            piece = ids[int(ends[k]) : int(ends[k + 1])]
            seen.append((int(d), tokens + int(ends[k]), len(piece), zlib.crc32(piece.astype("<u4").tobytes())))
        docs, tokens = docs + p.n_docs, tokens + p.n_tokens
    assert seen == plain(rows, WORD, 2)
    again = token_files.with_crc32(token_files.read_files(spark, folder, some=7, documents=31))
    assert sorted(tuple(r) for r in again.collect()) == seen


def test_wide_ids(spark):
    folder, rows = read(spark, [(1, "one"), (2, "two")], end=70_000)
    got = sorted((r.doc_id, r.width, np.frombuffer(r.ids, "<u4").tolist()[-1]) for r in rows.collect())
    assert got == [(1, 4, 70_000), (2, 4, 70_000)]


def test_empty_table(spark):
    assert read(spark, [])[1].count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in queries.op12_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], WORD, 2)
