"""Toxicity by two Kneser-Ney models over byte n-grams, one of toxic and one of ordinary documents.

The n-grams (``ORDER`` bytes of lower-cased text, everything but letters and digits a space) of all
labelled training texts are counted by class on the executors: a partial table for each task, then
one hash aggregate.  The exact counts of all distinct n-grams go to the driver, which adds up their
contexts and suffixes; the model holds every one of them, so its size grows with their number.
For class c, byte x and the bytes h before it

    P_c(x | h) = [n_c(hx) - D(n_c(hx)) + S(x | h') * sum_y D(n_c(hy))] / n_c(h)

where the discounts D of a count of one, two, and three or more are estimated for each class from
its counts of counts and stay below the count (modified Kneser-Ney), so P_c sums to one.  S is a
chain of continuation distributions of the same form (in how many full contexts a suffix was seen)
pooled over both classes: rare and unseen expressions fall back on shared counts and favour no
class.  Byte n-grams rather than words, since in compounding languages a toxic stem hides inside
ever new words.  A text's margin is the mean of log P_toxic - log P_ordinary over its bytes; a
logistic curve fitted to the margins of a labelled fold that was not counted makes it a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Stages, keyed_text, map_batches

ORDER = 4
#: suffix lengths of the shared backoff chain, longest first
CHAIN = (3, 2, 1)
BINS = 8192
SPREAD = 1.0
#: a text's margin is a sum over its bytes divided by their number plus this
DAMP = 40.0
#: up to so many labels are sent to all executors (about 50 MB); more are joined by shuffle
LABELS_TO_SEND = 1_000_000

_SPACED = np.array([c if tv.ALNUM[c] else 32 for c in tv.LOWER.tolist()], np.uint8)


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes up to and including each byte, packed; before a row's first byte there are spaces."""
    text = _SPACED[data].astype(np.uint64)
    out = text.copy()
    rows = np.repeat(offsets[:-1], np.diff(offsets))
    since = np.arange(len(text)) - rows
    for k in range(1, ORDER):
        before = np.full(len(text), 32, np.uint64)
        before[k:] = text[:-k]
        before[since < k] = 32
        out |= before << tv.U64(8 * k)
    return out


def _suffix(grams: np.ndarray, k: int) -> np.ndarray:
    return grams & tv.U64((1 << 8 * k) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (gram, n0, n1); flushed at a fixed number of held distinct n-grams."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(label, grams):
        keys, n = np.unique(grams, return_counts=True)
        if label in held:
            keys, (n,) = _sums(np.concatenate((held[label][0], keys)), [np.concatenate((held[label][1], n))])
        held[label] = keys, n

    def flush():
        for label, (keys, n) in held.items():
            zero, n = pa.array(np.zeros(len(n), np.int64)), pa.array(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), zero if label else n, n if label else zero], ["gram", "n0", "n1"])
        held.clear()

    for batch in batches:
        if batch.num_rows:
            labels = np.asarray(batch.column(1))
            for a, b, data, offsets in tv.chunks(batch.column(0)):
                grams, toxic = _grams(data, offsets), np.repeat(labels[a:b] == 1, np.diff(offsets))
                for label in (0, 1):
                    if len(part := grams[toxic == label]):
                        add(label, part)
                if sum(len(keys) for keys, _ in held.values()) > 3_000_000:
                    yield from flush()
    yield from flush()


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], [np.add.reduceat(c[order], starts) for c in columns]


def _slot(ids: np.ndarray, slots: int) -> np.ndarray:
    return (tv.mix(ids) % tv.U64(slots)).astype(np.int64)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and 3 or more, from the counts of counts; less than the count itself."""
    n = [int(np.count_nonzero(counts == k)) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(out, [0.1, 0.1, 0.1], [0.9, 1.9, 2.9])])


def _cut(counts: np.ndarray) -> np.ndarray:
    return discounts(counts)[np.minimum(counts, 3)]


class _Table:
    """Every key with its number: most in hash slots, those whose slot another key holds in a sorted array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weights: np.ndarray):
        slots = 1 << (2 * len(keys)).bit_length()
        at, owner = _slot(keys, slots), np.full(slots, -1)
        order = np.argsort(weights, kind="stable")
        owner[at[order]] = order
        held = owner[owner >= 0]
        self.keys, self.values = np.full(slots, ~tv.U64(0)), np.zeros(slots)
        self.keys[at[held]], self.values[at[held]] = keys[held], values[held]
        rest = np.flatnonzero(owner[at] != np.arange(len(keys)))
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_values = keys[rest], values[rest]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, 0 for other keys, and where those stand."""
        at = _slot(keys, len(self.keys))
        out, other = self.values[at], np.flatnonzero(self.keys[at] != keys)
        out[other] = 0
        if len(self.rest) and len(other):
            at = np.minimum(np.searchsorted(self.rest, keys[other]), len(self.rest) - 1)
            known = self.rest[at] == keys[other]
            out[other[known]] = self.rest_values[at[known]]
            other = other[~known]
        return out, other


@dataclass
class Model:
    """Log ratios: of n-grams that were seen, and of contexts whose next byte was not."""

    gram: _Table
    context: _Table
    slope: float = 0.0
    bias: float = -10.0

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log ratio of the two models for each row of a chunk; 0 for empty rows."""
        grams = _grams(data, offsets)
        ratio, new = self.gram(grams)
        ratio[new], _ = self.context(grams[new] >> tv.U64(8))
        return tv.row_sums(ratio, offsets) / (np.diff(offsets) + DAMP)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.bias, -500, 500)))


class _Lookup:
    """Sorted keys to rows of numbers; zeros for other keys."""

    def __init__(self, keys: np.ndarray, columns: list[np.ndarray]):
        order = np.argsort(keys)
        self.keys, self.columns = keys[order], [c[order].astype(float) for c in columns]

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys)) for _ in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return [np.where(self.keys[at] == keys, c[at], 0.0) for c in self.columns]


def shared_chain(grams: np.ndarray) -> np.ndarray:
    """S(last byte | bytes before it) for each distinct n-gram, from the shortest suffix to the longest."""
    shared = np.full(len(grams), 1 / 256)
    for k in reversed(CHAIN):
        suffixes = _suffix(grams, k)
        ids, (seen,) = _sums(suffixes, [np.ones(len(grams), np.int64)])
        cut = _cut(seen)
        heads, (total, mass) = _sums(ids >> tv.U64(8), [seen, cut])
        (rest,) = _Lookup(ids, [seen - cut])(suffixes)
        total, mass = _Lookup(heads, [total, mass])(suffixes >> tv.U64(8))
        shared = (rest + mass * shared) / total
    return shared


def _build(grams: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> Model:
    """Log ratios from the counts of all n-grams in ordinary and in toxic texts."""
    shared, ratio = shared_chain(grams), np.zeros(len(grams))
    cuts = [_cut(n) for n in (n0, n1)]
    contexts, sums = _sums(grams >> tv.U64(8), [n0, n1, *cuts])
    back = np.zeros(len(contexts))
    for c, (n, cut, sign) in enumerate(((n0, cuts[0], -1), (n1, cuts[1], 1))):
        held, mass = sums[c], sums[2 + c]
        total, own = _Lookup(contexts, [held, mass])(grams >> tv.U64(8))
        ratio += sign * np.log(np.where(total > 0, (n - cut + own * shared) / np.maximum(total, 1), shared))
        back += sign * np.log(np.where(held > 0, mass / np.maximum(held, 1), 1))
    return Model(_Table(grams, ratio, n0 + n1), _Table(contexts, back, sums[0] + sums[1]))


def _logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps on binned counts, with a weak ridge on the slope."""
    slope, bias = 1.0, float(np.log((n1.sum() + 1) / (n0.sum() + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -500, 500)))
        total = n0 + n1
        error = n1 - total * p
        g = np.array([error @ x - 1e-3 * slope, error.sum()])
        q = total * p * (1 - p) + 1e-12
        h = np.array([[q @ (x * x) + 1e-3, q @ x], [q @ x, q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 20 / (np.abs(step).max() + 1e-9))
        slope, bias = slope + step[0], bias + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(bias)


def _margin_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, np.zeros((2, BINS), np.int64)
        for batch in batches:
            labels = np.asarray(batch.column(1)) == 1 if batch.num_rows else None
            for a, b, data, offsets in tv.chunks(batch.column(0)) if batch.num_rows else ():
                at = np.clip((model.margins(data, offsets) + SPREAD) / (2 * SPREAD) * BINS, 0, BINS - 1).astype(np.int64)
                for k in (0, 1):
                    counts[k] += np.bincount(at[labels[a:b] == k], minlength=BINS)
        some = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bin", "n0", "n1"])

    return run


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label); labels are sent to the executors while they are few, else joined by shuffle."""
    small = labels.limit(LABELS_TO_SEND + 1).count() <= LABELS_TO_SEND
    return docs.join(F.broadcast(labels) if small else labels, "doc_id")


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, test_fold: int = 2, curve_fold: int = 3) -> Model:
    """Fits on rows of (doc_id, text) that have a row in labels (doc_id, label 0 or 1).

    Rows whose crc32(doc_id) leaves ``test_fold`` are never read for training; ``curve_fold`` fits
    the curve and the other folds are counted.  A document with several labels counts as toxic if
    one of them says so.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "toxicity")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    labels = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").where(fold != test_fold).groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    labels = stages.write(labels, "labels")
    rows = labelled(docs.where("text IS NOT NULL AND doc_id IS NOT NULL"), labels).select("doc_id", "text", "label")
    grams = rows.where(fold != curve_fold).select("text", "label").mapInArrow(_count, "gram long, n0 long, n1 long")
    grams = grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = grams.toArrow()
    model = _build(np.asarray(counted["gram"]).view(np.uint64), np.asarray(counted["n0"]), np.asarray(counted["n1"]))
    del counted
    shared = spark.sparkContext.broadcast(model)
    curve = rows.where(fold == curve_fold).select("text", "label").mapInArrow(_margin_rows(shared), "bin long, n0 long, n1 long")
    curve = curve.groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    x = (np.asarray(curve["bin"], float) + 0.5) / BINS * 2 * SPREAD - SPREAD
    n0, n1 = np.asarray(curve["n0"], float), np.asarray(curve["n1"], float)
    if len(x) and n1.sum() and n0.sum():
        model.slope, model.bias = _logistic(x, n0, n1)
    shared.destroy()
    stages.drop("labels")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, score, margin, predicted.

    Null, empty and wordless texts have margin 0 and the score of an average text without evidence
    (below the threshold unless most training texts are toxic).  A text of any length is scored whole.
    Repeated rows are scored alike to the last bit; no other column is read.  Without usable labels
    every score is the fixed low prior.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in tv.chunks(batch.column(1)):
            margin = shared.value.margins(data, offsets)
            s = shared.value.score(margin)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array(margin), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "margin", "predicted"])

    text = keyed_text(docs, id_col, text_col)
    return map_batches(text, run, f"doc_id {dict(text.dtypes)['doc_id']}, score double, margin double, predicted int")


def keep_ordinary(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, columns as they were; rows with null text stay."""
    model = train(keyed_text(docs), labels)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, data, offsets in tv.chunks(batch.column(at)):
            keep = shared.value.score(shared.value.margins(data, offsets)) < threshold
            yield batch.slice(a, b - a).filter(pa.array(keep | np.asarray(batch.column(at).slice(a, b - a).is_null())))

    return map_batches(docs, run, docs.schema)
