"""Benchmark passages in documents: a prefix-filtered set join over item-sized windows.

A window is 10 consecutive words of an item (a shorter item is one window).  As a set of five-word
shingles it must be contained whole, so its necessary prefix is one shingle: the rarest of the
window in the corpus.  Document frequencies of all benchmark shingles are counted over every
document first.  A document's shingles probe the prefix index; position and length bounds place
the window, and a hit counts only if its words are the window's, byte for byte.

The benchmark is read item by item and cut into blocks of at most ``BLOCK`` windows, a fixed size.
The driver holds one block at a time; each is broadcast for its own count of frequencies and its own
pass, and the passes are linked over one scan of the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import map_batches, schema_of

WINDOW, SHINGLE = 10, 5
#: windows of one broadcast block: some 300 bytes each, under 80 MB
BLOCK = 1 << 18
_SMALL = 1 << 20


@dataclass
class Words:
    """The words of a chunk: lower-cased bytes, where each word stands, its hash, and each row's first."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        data = tv.LOWER[data]
        starts, ends, first = tv.words(data, offsets, tv.ALNUM)
        return cls(data, starts, ends, tv.span_hash(data, starts, ends), first)

    def joined(self, begin: int, end: int) -> bytes:
        """The bytes of some consecutive words, joined by blanks."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[begin:end].tolist(), self.ends[begin:end].tolist()))


@dataclass
class Probe:
    """Sorted 64-bit keys behind a bit table that turns most strangers away."""

    keys: np.ndarray
    gate: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray) -> Probe:
        gate = np.zeros(_SMALL, bool)
        gate[(keys % tv.U64(_SMALL)).astype(np.int64)] = True
        return cls(keys, gate)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in values that are keys, and which key."""
        at = np.flatnonzero(self.gate[(values & tv.U64(_SMALL - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        ok = self.keys[k] == values[at]
        return at[ok], k[ok]


Window = tuple[bytes, np.ndarray, list]


def item_windows(items: Iterable[tuple[str | None, str | None]], block: int = BLOCK) -> Iterator[list[Window]]:
    """Blocks of windows (bytes, word hashes, sorted ids of the items that hold it), distinct within a block."""
    found: dict[bytes, tuple[np.ndarray, set]] = {}

    def done() -> list[Window]:
        out = [(k, h, _ordered(ids)) for k, (h, ids) in sorted(found.items())]
        found.clear()
        return out

    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = Words.of(data, np.array([0, len(data)]))
        n = min(WINDOW, len(words.hashes))
        for at in range(len(words.hashes) - n + 1 if n else 0):
            found.setdefault(words.joined(at, at + n), (words.hashes[at : at + n], set()))[1].add(item)
            if len(found) >= block:
                yield done()
    if found:
        yield done()


def _ordered(ids: set) -> list:
    return sorted(ids - {None}) + [None] * (None in ids)


def _sizes(windows) -> list[int]:
    return sorted({min(SHINGLE, len(w)) for _, w, _ in windows})


def frequencies(docs: DataFrame, windows, text_col: str) -> dict[int, np.ndarray]:
    """For each shingle size the (keys, documents that hold them) of all shingles of the windows."""
    keys = {}
    for n in _sizes(windows):
        parts = [tv.ngrams(w, n) for _, w, _ in windows if min(SHINGLE, len(w)) == n]
        keys[n] = np.unique(np.concatenate(parts))
    shared = docs.sparkSession.sparkContext.broadcast({n: Probe.of(k) for n, k in keys.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: np.zeros(len(p.keys), np.int64) for n, p in shared.value.items()}
        for batch in batches:
            for _, _, data, offsets in tv.chunks(batch.column(0)) if batch.num_rows else ():
                words = Words.of(data, offsets)
                first = words.first
                for n, probe in shared.value.items():
                    at, k = probe.find(tv.ngrams(words.hashes, n))
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + n <= first[row + 1]
                    pairs = np.unique(row[inside] * len(probe.keys) + k[inside])
                    counts[n] += np.bincount(pairs % len(probe.keys), minlength=len(probe.keys))
        for n, c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int64)), pa.array(some), pa.array(c[some])], ["size", "k", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "size long, k long, n long").groupBy("size", "k").agg(F.sum("n").alias("n")).toArrow()
    out = {n: (k, np.zeros(len(k), np.int64)) for n, k in keys.items()}
    for n, k, c in zip(*(counted[x].to_pylist() for x in ("size", "k", "n"))):
        out[n][1][k] = c
    shared.destroy()
    return out


@dataclass
class Index:
    """Prefix shingles of one block: for each size a probe, and the windows behind each key."""

    probes: dict
    windows: list
    items: list[str | None]
    texts: list[bytes]


def build_index(windows, counts) -> Index:
    """Each window under its rarest shingle (the first of equals), with the shingle's place in it."""
    names = _ordered({i for _, _, ids in windows for i in ids})
    number = {name: k for k, name in enumerate(names)}
    probes, all_items = {}, [[number[i] for i in ids] for _, _, ids in windows]
    for n in _sizes(windows):
        keys, count = counts[n]
        rows = []
        for w, (_, words, _) in enumerate(windows):
            if min(SHINGLE, len(words)) == n:
                grams = tv.ngrams(words, n)
                at = int(np.argmin(count[np.searchsorted(keys, grams)]))
                rows.append((int(grams[at]), w, at))
        rows.sort()
        prefix, starts = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        width = max(len(windows[r[1]][1]) for r in rows)
        words = np.zeros((len(rows), width), np.uint64)
        for k, (_, w, _) in enumerate(rows):
            words[k, : len(windows[w][1])] = windows[w][1]
        size = np.array([len(windows[r[1]][1]) for r in rows])
        probes[n] = (Probe.of(prefix), np.append(starts, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), size, words)
    return Index(probes, all_items, names, [text for text, _, _ in windows])


def find_windows(index: Index, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, size, window) of every occurrence in a chunk; hashes propose, bytes decide."""
    found, hashes, first = [], words.hashes, words.first
    for n, (probe, starts, window, place, size, stored) in index.probes.items():
        at, k = probe.find(tv.ngrams(hashes, n))
        if not len(at):
            continue
        many = starts[k + 1] - starts[k]
        entry = np.repeat(starts[k] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        at = np.repeat(at, many)
        row = np.searchsorted(first, at, "right") - 1
        begin = at - place[entry]
        ok = (begin >= first[row]) & (begin + size[entry] <= first[row + 1])
        row, begin, entry = row[ok], begin[ok], entry[ok]
        same = np.ones(len(begin), bool)
        for j in range(stored.shape[1]):
            use = size[entry] > j
            same &= ~use | (hashes[np.minimum(begin + j, len(hashes) - 1)] == stored[entry, j])
        for k in np.flatnonzero(same).tolist():
            same[k] = words.joined(begin[k], begin[k] + size[entry[k]]) == index.texts[window[entry[k]]]
        found.append((row[same], begin[same], size[entry[same]], window[entry[same]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """All columns of docs plus dc_words (its number of words), dc_hits (hit word ranges, merged) and dc_items.

    dc_hits is an array of [first word, end) of the words inside any window's occurrence; dc_items
    are the ids, as strings, of the items with occurring windows, sorted.  Null or empty texts and
    items have no words and no windows; a text of any length is read whole.  Repeated rows and items
    of equal text are all reported.  Items with a null id make hits like any other and are one null at
    the end of dc_items.  An empty benchmark marks nothing; an empty table stays empty.  Columns of
    docs named like the three raise ValueError: drop or rename them first.
    """
    if clash := {"dc_words", "dc_hits", "dc_items"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are what this adds")
    rows = items.select(F.col(item_col).cast("string"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull()).toLocalIterator()
    columns, out = docs.columns, docs
    schema = schema_of(docs, columns, "dc_words long, dc_hits array<array<long>>, dc_items array<string>")
    for number, windows in enumerate(itertools.chain(item_windows(((r[0], r[1]) for r in rows), block), [None])):
        if windows is not None or number == 0:
            index = build_index(windows, frequencies(docs, windows, text_col)) if windows else Index({}, [], [], [])
            out = map_batches(out, _marker(out, index, columns, text_col, first_pass=number == 0), schema)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs without any window of the items, all columns as they were, whatever their names."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    marked = mark(plain, items, plain.columns[docs.columns.index(text_col)], **names)
    return marked.where(F.size("dc_hits") == 0).select(plain.columns).toDF(*docs.columns)


def _marker(docs, index, columns, text_col, first_pass):
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.list_(pa.int64()))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = shared.value
        at = batch.schema.get_field_index(text_col)
        for a, b, data, offsets in tv.chunks(batch.column(at)):
            words = Words.of(data, offsets)
            first = words.first
            row, begin, size, window = find_windows(index, words)
            hits, names = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
            if not first_pass:
                for r in range(b - a):
                    hits[r] += [tuple(x) for x in batch.column(len(columns) + 1)[a + r].as_py()]
                    names[r].update(batch.column(len(columns) + 2)[a + r].as_py())
            begin_in_row = begin - first[row]
            for r, s, n, w in zip(row.tolist(), begin_in_row.tolist(), size.tolist(), window.tolist()):
                hits[r].append((s, s + n))
                names[r].update(index.items[i] for i in index.windows[w])
            out = [batch.column(k).slice(a, b - a) for k in range(len(columns))]
            out += [pa.array(np.diff(first).astype(np.int64)), pa.array([_merged(h) for h in hits], kind), pa.array([_ordered(x) for x in names], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, [*columns, "dc_words", "dc_hits", "dc_items"])

    return run


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(set(ranges)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def digest(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("dc_hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return marked.select(
        F.col(id_col).alias("doc_id"),
        F.col("dc_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
