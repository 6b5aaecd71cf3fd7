"""Token counts: Arrow functions that return lengths only.

Within an Arrow batch the texts are put together into library calls of about equal bytes, so that neither thousands of
tiny calls nor one huge call decides the memory. A text over `split_bytes` of UTF-8 is cut before a space that follows another
character. No piece of the vocabulary crosses such a place (checked on loading), and the library puts a space mark before
each call's text just where the space was; so the counts add up exactly.

Edge cases: null and empty texts have 0 tokens. Equal texts are counted each. A long run without a space isn't split. Only
lengths leave the Python worker. Other columns are carried along; one that has the result's name is replaced. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts_of

MARK = "▁"


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces of about `size` characters, to be encoded each on its own; a long run without a space stays whole."""
    at, n = 0, len(text)
    while n - at > size:
        cut = text.find(" ", at + size)
        while cut != -1 and (text[cut - 1] in (" ", MARK) or cut + 1 >= n):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", n_tokens: str = "n_tokens", batch_bytes: int = 1 << 20, split_bytes: int = 1 << 17) -> DataFrame:
    """docs with long `n_tokens`, without special tokens. Narrow: no shuffle."""

    def make():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        splits = not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            counts = np.zeros(batch.num_rows, np.int64)
            own: list[int] = []
            waiting: list[str] = []
            held = 0

            def flush():
                nonlocal held
                np.add.at(counts, own, [len(x) for x in sp.encode(waiting, num_threads=1)])
                own.clear()
                waiting.clear()
                held = 0

            for k, whole in enumerate(texts_of(batch, text)):
                size = n_bytes(whole)
                cut = splits and size > split_bytes
                for piece in safe_pieces(whole, max(1, split_bytes * len(whole) // size)) if cut else (whole,):
                    own.append(k)
                    waiting.append(piece)
                    held += n_bytes(piece) if cut else size
                    if held >= batch_bytes:
                        flush()
            if waiting:
                flush()
            return [pa.array(counts)]

        return compute

    return append_columns(docs, [T.StructField(n_tokens, T.LongType())], make)
