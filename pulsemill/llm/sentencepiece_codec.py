"""SentencePiece BPE encoding by backtracking, and decoding.

The vocabulary is the library's file; the segmentation is ours. A text's BPE segmentation is the one segmentation of
which each two adjacent tokens are compatible: merging their joint text again gives the same two tokens. An
Aho-Corasick automaton gives the longest tokens from the left; where two adjacent tokens are not compatible, the last
one is shortened to its next shorter prefix token, or given up; a bitfield remembers positions from which no
segmentation can follow, so that a text is done in linear time.

No piece of such a vocabulary holds a space mark after another character, or a Latin letter beside anything else (this is
checked when it is loaded), so no merge crosses such a place: texts are cut there, each chunk is segmented on its own, and
repeated chunks are looked up. Very long chunks go through the same code, without look-up.

Edge cases: null and empty texts give the end id alone, and decode to the empty text. Characters outside the vocabulary
become byte tokens. The space mark U+2581 in a text counts as a space, as in the library. Special strings are ordinary text.
Very long texts are encoded whole. Repeated rows are encoded each. Other columns are carried along; one that has a result's name is
replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts_of

MARK = "▁"
#: Chunks remembered by a Python worker, and the longest one that is remembered; these bound the worker's memory.
REMEMBERED, LONGEST = 400_000, 48


class Codec:
    """Encoder and decoder for one .model file of merge type."""

    #: Latin letters and digits; a chunk is a run of these or of other characters, after its space marks.
    word = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
    chunks = re.compile(rf"{MARK}*[{word}]+|{MARK}*[^{word}{MARK}]+|{MARK}+")
    crossing = re.compile(rf"[^{MARK}]{MARK}|[{word}][^{word}{MARK}]|[^{word}{MARK}][{word}]")

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [0] * 256
        self.out: list[bytes] = []  # bytes that each id decodes to
        usable: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.out.append(p.replace(MARK, " ").encode())
                usable[p] = i
                if self.crossing.search(p):
                    raise ValueError(f"piece {p!r} crosses a place where texts are cut")
        self.score = {p: sp.get_score(i) for p, i in usable.items()}
        self.id = usable
        self.joint: dict[tuple[str, str], bool] = {}
        # a piece that merging never makes can't be part of any segmentation
        self.made = {p for p in usable if len(p) == 1 or self.remerge(p) == [p]}
        self.shorter = {}
        for p in self.made:
            k = next((k for k in range(len(p) - 1, 0, -1) if p[:k] in self.made), 0)
            if k:
                self.shorter[p] = p[:k]
        # what the automaton's trie can walk along, with the longest token on the way
        self.below = {p[:k]: "" for p in self.made for k in range(1, len(p) + 1)}
        for p in self.below:
            self.below[p] = next(p[:k] for k in range(len(p), 0, -1) if p[:k] in self.made)
        self.single = {p for p in usable if len(p) == 1}
        self.auto = ahocorasick.Automaton()
        for p in self.made:
            self.auto.add_word(p, p)
        self.auto.make_automaton()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def remerge(self, text: str) -> list[str]:
        """Plain merging of a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        ok = self.joint.get((a, b))
        if ok is None:
            if len(self.joint) > 1_000_000:
                self.joint.clear()
            ok = self.joint[a, b] = self.remerge(a + b) == [a, b]
        return ok

    def segment(self, text: str) -> list[str]:
        """Tokens of a stretch of characters that are all in the vocabulary."""
        end, joint, ok, shorter = len(text), self.joint, self.compatible, self.shorter
        walk, below = self.auto.longest_prefix, self.below
        if end > 200:
            return self.segment_long(text, bytearray(end // 8 + 1))
        failed = 0
        tokens: list[str] = []
        last, at, token = "", 0, below[text[: walk(text)]]
        while True:
            stop = at + len(token)
            if not failed >> stop & 1 and (not at or (joint[last, token] if (last, token) in joint else ok(last, token))):
                tokens.append(token)
                if stop == end:
                    return tokens
                rest = text[stop:]
                last, at, token = token, stop, below[rest[: walk(rest)]]
            elif token in shorter:
                token = shorter[token]
            else:
                failed |= 1 << at
                token = tokens.pop()
                at -= len(token)
                last = tokens[-1] if tokens else ""

    def segment_long(self, text: str, failed: bytearray) -> list[str]:
        """The same for a long stretch: one pass of the automaton gives the longest token at every position."""
        end, ok, shorter = len(text), self.compatible, self.shorter
        longest: list[str] = [""] * end  # matches that end later come later
        for stop, p in self.auto.iter(text):
            longest[stop - len(p) + 1] = p
        tokens: list[str] = []
        at, token = 0, longest[0]
        while True:
            stop = at + len(token)
            if not failed[stop >> 3] >> (stop & 7) & 1 and (not tokens or ok(tokens[-1], token)):
                tokens.append(token)
                if stop == end:
                    return tokens
                at, token = stop, longest[stop]
            elif token in shorter:
                token = shorter[token]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)

    def chunk_ids(self, chunk: str) -> bytes:
        """ids as int32 bytes of a chunk in which spaces are already marks."""
        vocab = self.id
        if self.single.issuperset(chunk):
            return array("i", map(vocab.__getitem__, self.segment(chunk))).tobytes()
        ids = array("i")
        start, n = 0, len(chunk)
        while start < n:
            stop = start
            while stop < n and chunk[stop] in vocab:
                stop += 1
            if stop > start:
                ids.extend(vocab[p] for p in self.segment(chunk[start:stop]))
            if stop < n:
                ids.extend(self.byte[b] for b in chunk[stop].encode("utf-8", "surrogatepass"))
                stop += 1
            start = stop
        return ids.tobytes()


    def look_up(self, chunk: str) -> bytes:
        """ids of a chunk that the newer half of what is remembered doesn't hold."""
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.chunk_ids(chunk)
        if len(chunk) <= LONGEST:
            if len(self.known) >= REMEMBERED // 2:
                self.older, self.known = self.known, {}
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """int32 ids, the end id last."""
        if not text:
            return array("i", [self.eos]).tobytes()
        parts, get = [], self.known.get
        for c in self.chunks.findall(MARK + text.replace(" ", MARK)):
            ids = get(c)
            if ids is None:
                ids = self.look_up(c)
                get = self.known.get
            parts.append(ids)
        parts.append(array("i", [self.eos]).tobytes())
        return b"".join(parts)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with array<int> `ids` instead of the text, and, if named, with what they decode to in the column `decoded`, which
    spares sending the ids to Python again. Narrow: no shuffle; rows are as many as before."""

    def make():
        c = codec(model_path)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = [c.encode(x) for x in texts_of(batch, text)]
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            return [lists, pa.array((c.decode(memoryview(p).cast("i")) for p in parts), pa.string())] if decoded else [lists]

        return compute

    out = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField("__decoded", T.StringType())] if decoded else [])]
    encoded = append_columns(docs, out, make).drop(text)
    return encoded.drop(decoded).withColumnRenamed("__decoded", decoded) if decoded else encoded


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with `text`, decoded from its ids; null ids give a null text."""

    def make():
        c = codec(model_path)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(ids))
            return [pa.array([c.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in column], pa.string())]

        return compute

    return append_columns(encoded, [T.StructField(text, T.StringType())], make)


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
