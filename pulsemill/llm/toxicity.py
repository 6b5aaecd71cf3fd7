"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of hashes, to `bits` bits, of its words, word stems (first four letters), pairs of
neighbours and pairs with one word between. FTRL-proximal learns with a rate for each coordinate, and its L1 term leaves
most weights at zero: what is broadcast are the few others, bounded by 2^bits. It is fitted on at most `most` labelled
rows, and scores every text in one narrow pass. Rate and L1 term are chosen within the training rows, by log loss on a fifth
of them that is set aside, and the model is then fitted on all of them; held-out rows play no part in it.

Edge cases: null and empty texts have no features and get the score of the intercept. Very long texts are scored whole.
Without labels all scores are sigmoid(-30), about 1e-13. Of rows that share a labelled id, one is learned from; of settings that are equally
good, the first is taken. Rows are independent of each other and of all other columns; a column that has the result's name
is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, texts_of
from .text_stats import inner_split, labelled_sample, one_each

BITS, REMEMBERED = 20, 100_000
TRAIN = "pmod(crc32(cast(__id AS string)), 4) <> 2"
_word = re.compile(r"\w+")
_mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Hasher:
    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, tuple[int, int]] = {}

    def _pair(self, w: str) -> tuple[int, int]:
        got = self.known.get(w)
        if got is None:
            stem = "\x00" + w[:4] if len(w) > 4 else w
            got = zlib.crc32(w.encode("utf-8", "surrogatepass")) + 1, zlib.crc32(stem.encode("utf-8", "surrogatepass")) + 1
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(w) < 40:
                self.known[w] = got
        return got

    def features(self, text: str) -> np.ndarray:
        """Hashes, with repetitions."""
        words = _word.findall(text.lower())
        if not words:
            return np.zeros(0, np.int64)
        both = np.array(list(map(self._pair, words)), np.uint64)
        w, stem = both[:, 0] * _mix[0], both[:, 1] * _mix[1]
        parts = [w, stem]
        if len(w) > 1:
            parts.append((w[:-1] ^ (w[1:] >> np.uint64(17))) * _mix[2])
        if len(w) > 2:
            parts.append((w[:-2] ^ (w[2:] >> np.uint64(29))) * _mix[3])
        h = np.concatenate(parts)
        h ^= h >> np.uint64(32)
        return (h * _mix[0] >> self.shift).astype(np.int64)


#: Rates and L1 terms that fit() chooses from.
SETTINGS = [{"alpha": a, "l1": l1} for a in (1.0, 0.3) for l1 in (6.0, 2.0)]


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept) after FTRL-proximal over (feature set, label) rows."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    weights = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, y = rows[k]
            w, w0 = weights(z[f], n[f], l1), float(weights(z0, n0, 0.0))
            g = 1 / (1 + np.exp(-np.clip(w0 + w.sum(), -30, 30))) - y
            root = np.sqrt(n[f])
            z[f] += g - (np.sqrt(n[f] + g * g) - root) / alpha * w
            n[f] += g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
    w = weights(z, n, l1)
    at = np.flatnonzero(w)
    return at, w[at], float(weights(z0, n0, 0.0))


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000) -> tuple[np.ndarray, np.ndarray, float]:
    def make():
        h = Hasher()
        return lambda batch: [pa.array((np.unique(h.features(t)).astype("<i4").tobytes() for t in texts_of(batch, "__text")), pa.binary())]

    sample = labelled_sample(docs, labels, "toxic", TRAIN, most)
    rows = append_columns(sample, [T.StructField("__f", T.BinaryType())], make).select("__id", "__y", "__f")
    rows = one_each(rows).toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    y, f, ids = rows.column("__y").to_numpy(), rows.column("__f").chunk(0), rows.column("__id").to_numpy()
    order = np.argsort(ids, kind="stable")
    sets = [(np.frombuffer(f[int(k)].as_buffer(), "<i4"), int(y[k])) for k in order]
    return ftrl(sets, **choose(sets, inner_split(ids[order])))


def choose(rows: list[tuple[np.ndarray, int]], aside: np.ndarray) -> dict[str, float]:
    """The setting of SETTINGS with the least log loss on the rows aside when it is fitted on the others."""
    fitted, judged = ([r for r, a in zip(rows, aside, strict=True) if a == side] for side in (False, True))
    if not fitted or not judged:
        return SETTINGS[0]

    def loss(setting: dict[str, float]) -> float:
        at, weights, intercept = ftrl(fitted, **setting)
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        s = np.array([intercept + dense[f].sum() for f, _ in judged])
        return float(np.logaddexp(0, np.where([y == 1 for _, y in judged], -s, s)).mean())

    return min(SETTINGS, key=loss)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with double `out`, the probability of label 1."""
    at, weights, intercept = model

    def make():
        h = Hasher()
        dense = np.zeros(1 << BITS)
        dense[at] = weights

        def one(t: str) -> float:
            f = h.features(t)
            f = np.unique(f[dense[f] != 0])
            return float(1 / (1 + np.exp(-np.clip(intercept + dense[f].sum(), -30, 30))))

        return lambda batch: [pa.array((one(t) for t in texts_of(batch, text)), pa.float64())]

    return append_columns(docs, [T.StructField(out, T.DoubleType())], make)


def held_out(doc_id: str = "doc_id"):
    return F.expr(f"coalesce(pmod(crc32(cast({doc_id} AS string)), 4) = 2, false)")
