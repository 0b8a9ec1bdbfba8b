"""Text quality by logistic regression on hashed word n-grams, trained with FTRL-proximal.

A word is a run of letters and digits or a run of other visible bytes, so shouting, junk symbols
and table rules are words of their own; case is kept.  Words and word pairs are hashed into
``SIZE`` features valued by their share of the text, so a score is one sparse dot product.  The
weights are fitted on the driver by follow-the-regularised-leader over a bounded sample of labelled
rows, the ``SAMPLE`` rows whose hashed ids are smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import keyed_text, map_batches

BITS = 18
SIZE = 1 << BITS
#: the most labelled rows that training reads
SAMPLE = 12_000
#: features of a text sum to this before length normalisation
SCALE = 30.0

_SYMBOL = tv.lut(lambda b: 33 <= b < 127 and not chr(b).isalnum())
_ALNUM = tv.lut(lambda b: b >= 128 or chr(b).isalnum())


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words and word pairs in order, and each row's first; two for each word."""
    parts = [tv.words(data, offsets, keep) for keep in (_ALNUM, _SYMBOL)]
    starts, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    first = np.searchsorted(starts, offsets)
    h = tv.span_hash(data, starts, ends)
    before = np.empty_like(h)
    if len(h):
        before[1:] = h[:-1]
        before[first[:-1][np.diff(first) > 0]] = 77
    out = np.empty(2 * len(h), np.int64)
    out[0::2] = (h >> tv.U64(64 - BITS)).astype(np.int64)
    out[1::2] = (tv.mix(before * tv.U64(3) + h) >> tv.U64(64 - BITS)).astype(np.int64)
    return out, 2 * first


def _feature_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(text, label, place) to distinct feature numbers, how often each stands in the text, label and place."""
    for a, b, data, offsets in tv.chunks(batch.column(0)):
        x, first = features(data, offsets)
        row = np.repeat(np.arange(b - a), np.diff(first))
        pairs, n = np.unique(row * SIZE + x, return_counts=True)
        at = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) * SIZE).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (pairs % SIZE, n)]
        yield pa.RecordBatch.from_arrays([*lists, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["x", "n", "label", "place"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias; rows are (distinct feature numbers, their counts, label), visited in seeded order."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    packed = [(np.append(at, SIZE), np.append(count * (SCALE / max(int(count.sum()), 1)), 1.0), label) for at, count, label in rows]
    rng = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(packed)):
            at, value, label = packed[r]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - label) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    return w[:SIZE].astype(np.float32), float(w[SIZE])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, test_fold: int = 0, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of (doc_id, text) with a label 0 or 1 outside the test fold.

    A document with several labels takes the lowest, an id with several texts the first in order, so
    at most ``sample`` texts are read, as distinct features with their counts.  Without labels all
    weights are 0.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").where(fold != test_fold).groupBy("doc_id").agg(F.min("label").cast("long").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("text", "label", F.xxhash64("doc_id").alias("place"))
    found = map_batches(rows, _feature_rows, "x array<int>, n array<int>, label long, place long").toArrow()
    if not found.num_rows:
        return np.zeros(SIZE, np.float32), 0.0
    x, n, place = (found[c].combine_chunks() for c in ("x", "n", "place"))
    rows = [(x[k].values.to_numpy(), n[k].values.to_numpy(), label) for k, label in enumerate(found["label"].to_pylist())]
    # The same order however rows were dealt out and tasks were scheduled.
    order = sorted(range(len(rows)), key=lambda k: (place[k].as_py(), rows[k][0].tobytes(), rows[k][1].tobytes()))
    return ftrl([rows[k] for k in order])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score (probability of good quality), predicted.

    Null, empty and blank texts have no features and get the model's bias alone.  Repeated rows
    are scored alike; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for a, b, data, offsets in tv.chunks(batch.column(1)):
            x, first = features(data, offsets)
            z = tv.row_sums(weights[x], first) * SCALE / np.maximum(np.diff(first), 1) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    text = keyed_text(docs, id_col, text_col)
    return map_batches(text, run, f"doc_id {dict(text.dtypes)['doc_id']}, score double, predicted int")
