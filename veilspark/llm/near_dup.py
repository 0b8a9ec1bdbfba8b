"""MinHash near-duplicate classes by tensored banding, confirmed on full shingle sets.

Two small collections of minhash tuples are computed for every distinct text: ``tuples`` left ones
and as many right ones, each of ``width`` minhashes.  Each (left, right) pair is the key of one
table, so ``tuples ** 2`` tables come from ``2 * tuples * width`` minhashes, about the square root of
what independent bands would need.  Table keys are made lazily: only left tuples that two different
texts share are combined with right tuples.

A class is one word sequence, named by a 128-bit cryptographic hash of its lower-cased words; only
rows of equal words are taken as equal without a comparison.  Texts of equal sets and different
words share all tables and are confirmed like any other pair.  Steps, each of which reads what the
one before wrote to the shared folder:

1. rows become classes, each with a number of its own;
2. classes that share a left tuple are tied to the smallest class that has it (a star, never all
   pairs); ties that share a table key are confirmed on full sets and contracted to components;
3. table keys are combined by component, so a group of copies is one row of a table and not one for
   each copy.  Of left tuples or tables with the same members one is enough.  A key that still holds
   two components and no third class is a pair, confirmed like a tie;
4. other keys that hold several components could hide a link between any two of them.  Their
   components are tied into tangles, with all their classes.  A tangle of up to ``TANGLE`` classes
   is cut into blocks and block pairs are compared; a larger one is compared table by table, so
   only classes that share a table key meet.  Compared are pairs that share a table key and are not
   yet connected;
5. components of both rounds give every row its ``component_id``.

No step holds a whole group: stars and aggregates are combined map-side, hubs are salted, blocks
have a fixed size in rows and bytes, classes with very many rows are joined by a broadcast of bounded
size.  With the defaults (3, 24) a pair at similarity 0.75 exactly meets in no table with probability
4e-6, one at 0.8 with 7e-8; a component is lost only if all its paths are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Stages, keyed_text, map_batches, release, schema_of

SALTS = 64
#: classes and shingles of a block, about
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
#: classes of a tangle that is compared block by block, so a class is copied TANGLE / BLOCK times at most
TANGLE = 4096
SEND = 200_000
#: rounds of contraction whose maps are joined at once
ROUNDS = 6
#: sizes of the broadcast bit tables: sixteen bits for each key, at least and at most so many (32 MB)
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: a class is broadcast if it has at least so many rows, and at least one in HOT_SHARE of all rows
HOT_ROWS, HOT_SHARE = 10_000, 20_000


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(757)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) | tv.U64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhashes(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (uint32) of each row's set; rows without a set keep the largest value."""
    a, b = _coefficients(n)
    out = np.full((n, len(first) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        starts = first[:-1][full]
        for k in range(n):
            out[k, full] = np.minimum.reduceat(((values * a[k] + b[k]) >> tv.U64(32)).astype(np.uint32), starts)
    return out


def tuple_hashes(values: np.ndarray, first: np.ndarray, width: int, tuples: int) -> np.ndarray:
    """rows x (2 * tuples) uint64: the left tuples, then the right ones, each salted by its number."""
    mins = minhashes(values, first, 2 * tuples * width)
    out = np.empty((mins.shape[1], 2 * tuples), np.uint64)
    for t in range(2 * tuples):
        h = np.full(mins.shape[1], t + 1, np.uint64)
        for k in range(width):
            h = tv.mix(h * tv.U64(0x9E3779B97F4A7C15) + mins[t * width + k])
        out[:, t] = h
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[bytes | None], np.ndarray, np.ndarray]]:
    """For each chunk its rows, their keys, the sets' shingles and each set's first."""
    for a, b, data, offsets in tv.chunks(column):
        data = tv.LOWER[data]
        hashes, first = tv.word_hashes(data, offsets, tv.NOT_SPACE)
        yield a, b, tv.word_keys(data, offsets, tv.NOT_SPACE), *tv.shingles(hashes, first, size)


def _keys(column: pa.Array) -> list[bytes | None]:
    return [k for _, _, data, offsets in tv.chunks(column) for k in tv.word_keys(tv.LOWER[data], offsets, tv.NOT_SPACE)]


def _fixed(matrix: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Each row of a C-ordered matrix as one binary value; null where the mask is set."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width).buffers()[1]
    null = None if mask is None or not mask.any() else pa.array(~mask).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(matrix), [null, offsets, pa.py_buffer(matrix.tobytes())])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return tv.string_column(column)[0].view(kind).reshape(-1, width)


def signed_rows(docs: DataFrame, shingle: int, width: int, tuples: int) -> DataFrame:
    """(doc_id, nd_key, nd_n, nd_sig) of (doc_id, nd_text); nd_key and nd_sig are null without words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, keys, values, first in _sets(batch.column(1), shingle):
            n = np.diff(first)
            sig = _fixed(tuple_hashes(values, first, width, tuples), n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)), sig], ["doc_id", "nd_key", "nd_n", "nd_sig"])

    return map_batches(docs.select("doc_id", "nd_text"), run, schema_of(docs, ["doc_id"], "nd_key binary, nd_n long, nd_sig binary"))


def _left_rows(tuples: int, gate: Gate | None = None):
    """(nid, signature) to (left hash, nid); with a gate only the left hashes that pass it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nid = np.asarray(batch.column(0))
        left = _matrix(batch.column(1), np.int64, 2 * tuples)[:, :tuples].ravel()
        owner = np.repeat(nid, tuples)
        if gate is not None:
            ok = gate.passes(_long_probes(left))
            left, owner = left[ok], owner[ok]
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(owner)], ["part", "nid"])

    return run


def _table_rows(tuples: int):
    """(left hash, nid, root, signature) to (table key, nid, root), one row for each table of that left tuple."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left = np.asarray(batch.column(0)).view(np.uint64)
        right = _matrix(batch.column(3), np.uint64, 2 * tuples)[:, tuples:]
        at = tv.mix(left[:, None] * tv.U64(3) + right).view(np.int64)
        nid, root = (pa.array(np.repeat(np.asarray(batch.column(k)), tuples)) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), nid, root], ["at", "nid", "root"])

    return run


def components(stages: Stages, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of longs not below 0, by repeated contraction.

    Each round maps every node to the least node next to it, then to where that one went, until no
    edge is left.  What is least changes from round to round (the order of ``node XOR c``), so nodes
    in order, as along a path, are contracted as fast as nodes in random order.  A root is one node
    of its component.
    """
    orders = np.random.default_rng(31).integers(0, 1 << 62, 64).tolist()
    edges = stages.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    labels, hops = None, []

    def moved(labels: DataFrame | None, hops: list[DataFrame]) -> DataFrame:
        for hop in hops:
            if labels is None:
                labels = hop.select("node", F.col("to").alias("root"))
            else:
                labels = labels.join(hop.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return labels

    for k in itertools.count():
        if edges.isEmpty():
            break
        order = F.lit(orders[k % len(orders)])
        least = F.least(F.col("a").bitwiseXOR(order), F.col("b").bitwiseXOR(order)).alias("to")
        ends = edges.select(F.col("a").alias("node"), least).unionAll(edges.select(F.col("b").alias("node"), least))
        to = stages.write(ends.groupBy("node").agg(F.min("to").bitwiseXOR(order).alias("to")), f"{name}-to-{k}")
        hop = to.select(F.col("node").alias("to"), F.col("to").alias("root"))
        to = stages.write(to.join(hop, "to").select("node", F.col("root").alias("to")), f"{name}-hop-{k}")
        hops.append(to)
        if len(hops) == ROUNDS:
            labels, hops = stages.write(moved(labels, hops), f"{name}-labels-{k}"), []
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        rest = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = stages.write(rest, f"{name}-edges-{k + 1}")
    if hops:
        labels = stages.write(moved(labels, hops), f"{name}-labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _long_probes(values: np.ndarray) -> np.ndarray:
    h = tv.mix(np.asarray(values).view(np.uint64))
    return np.stack((h, tv.mix(h + tv.U64(1))), 1)


def _key_probes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


@dataclass
class Gate:
    """A broadcast bit table of some keys: a pass may be false, a refusal never is."""

    shared: object
    bits: int

    def passes(self, probes: np.ndarray) -> np.ndarray:
        k = probes % tv.U64(self.bits)
        return ((self.shared.value[(k >> tv.U64(3)).astype(np.int64)] >> (k & tv.U64(7)).astype(np.uint8)) & 1).all(1)

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose long in that column passes."""
        at = df.columns.index(column)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ok = self.passes(_long_probes(np.asarray(batch.column(at))))
            if ok.any():
                yield batch.filter(pa.array(ok))

        return map_batches(df, run, df.schema)


def gate_of(keys: DataFrame) -> Gate:
    """The gate of the one column of keys, long or 128-bit binary; its size follows their number up to a bound.

    Beyond the bound more rows pass falsely, which costs time and never a result.
    """
    bits = min(max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()), MOST_BITS)
    binary = keys.dtypes[0][1] == "binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if batch.num_rows:
                probes = _key_probes(batch.column(0).to_pylist()) if binary else _long_probes(np.asarray(batch.column(0)))
                k = (probes % tv.U64(bits)).ravel()
                np.bitwise_or.at(table, (k >> tv.U64(3)).astype(np.int64), (1 << (k & tv.U64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)])], ["bits"])

    import zlib

    table = np.zeros(bits // 8, np.uint8)
    for row in keys.coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        table |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    return Gate(keys.sparkSession.sparkContext.broadcast(table), bits)


def _full_sets(docs: DataFrame, gate: Gate, shingle: int) -> DataFrame:
    """(nd_key, nd_set) of the rows whose class passes the gate; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = _keys(batch.column(0))
            some = [r for r, k in enumerate(keys) if k is not None]
            if not some:
                continue
            some = np.array(some)[gate.passes(_key_probes([keys[r] for r in some]))].tolist()
            new = []
            for r in some:
                if keys[r] not in seen:
                    seen.add(keys[r])
                    new.append(r)
            if len(seen) > 500_000:
                seen.clear()
            for _, _, own, values, first in _sets(batch.column(0).take(pa.array(new, pa.int64())), shingle):
                sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(sets, pa.binary())], ["nd_key", "nd_set"])
        release()

    return docs.select("nd_text").mapInArrow(run, "nd_key binary, nd_set binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    total = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (total - common)


def _similar(percent: int):
    return lambda a, b: similar(a, b, percent)


def _meet(tuples: int):
    """Whether two signatures share a table key."""

    def test(a: np.ndarray, b: np.ndarray) -> bool:
        hit = a == b
        return bool(hit[:tuples].any() and hit[tuples:].any())

    return test


def _confirm_stars(test):
    """Rows sorted by (hub, salt, member first hub): keeps one hub's values and tests each member's against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_values = None, None
        for batch in batches:
            a, b = [], []
            for key, member, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = np.frombuffer(raw.as_buffer(), np.uint64)
                if key == member:
                    hub, hub_values = key, values.copy()
                elif key == hub and test(hub_values, values):
                    a.append(key)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        release()

    return run


def confirm_stars(stars: DataFrame, values: DataFrame, test) -> DataFrame:
    """The ties (hub, member) as (a, b) whose values, of the two columns nid and values, pass the test."""
    salted = stars.select("hub", "member", F.pmod(F.xxhash64("member"), F.lit(SALTS)).alias("salt"))
    hubs = salted.select("hub", F.col("hub").alias("member"), "salt").distinct()
    rows = salted.unionAll(hubs).join(values.toDF("member", "nd_values"), "member")
    rows = rows.repartition(F.col("hub"), F.col("salt")).sortWithinPartitions("hub", "salt", (F.col("hub") != F.col("member")))
    return rows.select("hub", "member", "nd_values").mapInArrow(_confirm_stars(test), "a long, b long")


def _block_links(percent: int, tuples: int):
    """All links inside one pair of blocks, thinned to a spanning forest."""

    def run(frame):
        sig = np.stack([np.frombuffer(x, np.uint64) for x in frame["nd_sig"]])
        sets = [np.frombuffer(x, np.uint64) for x in frame["nd_set"]]
        keys, side, root = frame["nid"].tolist(), frame["block"].to_numpy(), frame["root"].tolist()
        parent = {r: r for r in root}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = [], []
        alone = side.min() == side.max()
        for i in range(len(keys)):
            if alone:
                others = np.arange(i + 1, len(keys))
            elif side[i] == side.min():
                others = np.flatnonzero(side != side.min())
            else:
                continue
            hit = sig[others] == sig[i]
            for j in others[hit[:, :tuples].any(1) & hit[:, tuples:].any(1)]:
                x, y = find(root[i]), find(root[j])
                if x != y and similar(sets[i], sets[j], percent):
                    parent[max(x, y)] = min(x, y)
                    a.append(keys[i])
                    b.append(keys[j])
        import pandas as pd

        return pd.DataFrame({"a": a, "b": b}, columns=["a", "b"], dtype="int64")

    return run


def _sent(stages: Stages, df: DataFrame, name: str) -> DataFrame:
    """df, written; with a broadcast hint while it has at most SEND rows (some 20 MB), else to be joined by shuffle."""
    df = stages.write(df, name)
    return F.broadcast(df) if df.limit(SEND + 1).count() <= SEND else df


def _members(nid: str = "nid") -> list:
    """Aggregates that tell a group's members: how many, and two sums of hashes."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(nid)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), nid)).alias("y")]


def _distinct_groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, hub) of the groups with two members or more, hub being the least; of groups with the same members one."""
    groups = rows.groupBy(key).agg(F.min("nid").alias("hub"), F.max("nid").alias("hi"), *_members())
    return groups.where("hub <> hi").groupBy("hub", "hi", "n", "x", "y").agg(F.min(key).alias(key)).select(key, "hub")


def _mixed_tables(cells: DataFrame) -> DataFrame:
    """(at, a, b, hub, member, n) of the tables that hold several components; of tables with the same members one.

    cells has (at, root, nid, n, x, y): of each component in a table its least class and its members'
    aggregates.  a and b are two of the components, hub and member the least and the largest of the
    least classes: the two members of a table of two.
    """
    roots, ends = [F.min("root").alias("a"), F.max("root").alias("b")], [F.min("nid").alias("hub"), F.max("nid").alias("member")]
    tables = cells.groupBy("at").agg(*roots, *ends, F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return tables.where("a <> b").groupBy("a", "b", "hub", "member", "n", "x", "y").agg(F.min("at").alias("at")).select("at", "a", "b", "hub", "member", "n")


def _rooted(rows: DataFrame, labels: DataFrame, column: str, root: str) -> DataFrame:
    """rows plus the component of that column's class, itself where it has no link."""
    known = labels.select(F.col("node").alias(column), F.col("root").alias(root))
    return rows.join(known, column, "left").withColumn(root, F.coalesce(root, column))


def _tangles(stages: Stages, cells: DataFrame, tables: DataFrame, labels: DataFrame) -> DataFrame:
    """(nid, root, tangle) of all classes of the components that tables of three classes or more tie, however far.

    The two components that each of these tables names are tied first.  What still falls apart after
    that is aggregated by table, and only tables of three such parts or more are joined with them.
    """
    near = components(stages, tables.where("n > 2").select("a", "b"), "near")
    parts = _rooted(cells.select("at", "root", "n"), _sent(stages, near, "near-roots"), "root", "part")
    parts = stages.write(parts.groupBy("at", "part").agg(F.sum("n").alias("n")), "near-parts")
    marks = [F.bit_xor(F.xxhash64("part")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "part")).alias("y")]
    loose = parts.groupBy("at").agg(F.count("*").alias("held"), F.sum("n").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"), *marks).where("held > 1 AND n > 2")
    loose = stages.write(loose.groupBy("held", "lo", "hi", "x", "y").agg(F.min("at").alias("at")), "loose")
    others = parts.select("at", "part").join(_sent(stages, loose.where("held > 2").select("at", "lo"), "looser"), "at").select("lo", "part")
    ties = near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(loose.where("held = 2").select("lo", "hi")).unionAll(others)
    tangle = components(stages, ties, "tangle").select(F.col("node").alias("root"), F.col("root").alias("tangle"))
    linked = labels.select(F.col("node").alias("nid"), "root").join(tangle, "root").select("nid", "root", "tangle")
    alone = tangle.join(labels.select("root").distinct(), "root", "left_anti").select(F.col("root").alias("nid"), "root", "tangle")
    placed = stages.write(linked.unionAll(alone), "placed")
    stages.drop("near-roots", "near-parts", "loose", "looser")
    return placed


def _resolve_tangles(stages: Stages, placed: DataFrame, tables: DataFrame, live: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, tuples: int) -> DataFrame:
    """Links between components of a tangle.

    placed has (nid, root, tangle); live has (part, nid) of all classes, of which a very large
    tangle's tables are made again.
    """
    size = placed.groupBy("tangle").agg(F.count("*").alias("held"))
    wide = stages.write(size.where(F.col("held") > TANGLE).select("tangle"), "wide")
    cell = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key")).alias("cell")
    cells = placed.join(wide, "tangle", "left_anti").select(cell(0, "tangle"), "nid")
    if not wide.isEmpty():
        own = placed.join(wide, "tangle", "left_semi").select("nid", "root")
        mixed = tables.where("n > 2").join(own.select(F.col("root").alias("a")).distinct(), "a").select("at")
        some = live.join(own, "nid").join(signed, "nid").select("part", "nid", "root", "nd_sig")
        at = map_batches(some, _table_rows(tuples), "at long, nid long, root long")
        cells = cells.unionAll(at.join(_sent(stages, mixed, "mixed"), "at").select(cell(1, "at"), "nid"))
    cells = stages.write(cells, "cells")
    members = cells.select("nid").distinct().join(placed.select("nid", "root"), "nid").join(sets, "nid").join(signed, "nid")
    members = stages.write(members.withColumn("size", F.octet_length("nd_set") / 8), "members")
    cells = cells.join(members.select("nid", "size"), "nid")
    blocks = cells.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("long").alias("blocks"))
    dealt = cells.join(stages.write(blocks, "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("cell", "nid", "block", other).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = dealt.join(members.select("nid", "root", "nd_set", "nd_sig"), "nid")
    return dealt.groupBy("cell", "lo", "hi").applyInPandas(_block_links(percent, tuples), "a long, b long")


def class_components(docs: DataFrame, rows: DataFrame, stages: Stages, shingle: int, percent: int, width: int, tuples: int) -> DataFrame:
    """(nd_key, held, component_id, nd_linked) of every class: its rows, the smallest id that links reach, whether it has any.

    rows has doc_id, nd_key, nd_n, nd_sig of every row.
    """
    classes = rows.where("nd_key IS NOT NULL").groupBy("nd_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("held"), F.first("nd_sig").alias("nd_sig"))
    classes = stages.write(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    signed = classes.select("nid", "nd_sig")
    left = map_batches(signed, _left_rows(tuples), "part long, nid long")
    shared = left.groupBy("part").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo <> hi").select("part")
    shared = stages.write(shared, "shared")
    if shared.isEmpty():
        return classes.select("nd_key", "held", F.col("least_id").alias("component_id"), F.lit(False).alias("nd_linked"))
    gates = [gate_of(shared)]
    live = map_batches(signed, _left_rows(tuples, gates[0]), "part long, nid long").join(shared, "part")
    live = stages.write(live, "live")
    live = stages.write(live.join(_sent(stages, _distinct_groups(live, "part"), "parts"), "part").select("part", "hub", "nid"), "live-parts")
    gates.append(gate_of(live.select("nid")))
    signed = gates[1].keep(signed, "nid")

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        involved = stages.write(nodes.join(classes.select("nid", "nd_key"), "nid"), f"{name}-involved")
        gates.append(gate_of(involved.select("nd_key")))
        sets = _full_sets(docs, gates[-1], shingle).groupBy("nd_key").agg(F.first("nd_set").alias("nd_set"))
        return stages.write(sets.join(involved, "nd_key").select("nid", "nd_set"), f"{name}-sets")

    ends = lambda stars: stars.select(F.col("hub").alias("nid")).unionAll(stars.select("member")).distinct()
    ties = confirm_stars(live.where("hub <> nid").select("hub", F.col("nid").alias("member")).distinct(), signed, _meet(tuples))
    ties = stages.write(ties.toDF("hub", "member"), "ties")
    sets = sets_of(ends(ties), "part")
    labels = components(stages, confirm_stars(ties, sets, _similar(percent)), "part")
    at = _rooted(live.select("part", "nid"), _sent(stages, labels, "part-roots"), "nid", "root").join(signed, "nid").select("part", "nid", "root", "nd_sig")
    at = map_batches(at, _table_rows(tuples), "at long, nid long, root long")
    cells = stages.write(at.groupBy("at", "root").agg(F.min("nid").alias("nid"), *_members()), "at")
    tables = stages.write(_mixed_tables(cells), "tables")
    stages.drop("shared", "live", "parts")
    placed = _tangles(stages, cells, tables, labels)
    stages.drop("at")
    pairs = stages.write(tables.where("n = 2").select("hub", "member").distinct(), "pairs")
    nodes = ends(pairs).unionAll(placed.select("nid")).distinct()
    sets = sets.unionAll(sets_of(nodes.join(sets.select("nid"), "nid", "left_anti"), "more"))
    more = confirm_stars(pairs, sets, _similar(percent)).unionAll(_resolve_tangles(stages, placed, tables, live, signed, sets, percent, tuples))
    more = stages.write(more, "more")
    if not more.isEmpty():
        labels = components(stages, labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more), "all")
    own = classes.select("nid", "nd_key", "held", "least_id")
    known = stages.write(labels.select(F.col("node").alias("nid"), "root").join(own, "nid"), "known")
    smallest = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # One root may hold a third of all classes; then AQE splits its partition of this join.
    linked = known.join(smallest, "root").select("nid", "component_id")
    whole = own.join(linked.withColumn("nd_linked", F.lit(True)), "nid", "left")
    component = F.when(F.col("nd_linked"), F.col("component_id")).otherwise(F.col("least_id"))
    whole = stages.write(whole.select("nd_key", "held", component.alias("component_id"), F.coalesce("nd_linked", F.lit(False)).alias("nd_linked")), "components")
    stages.drop_all_but("components", "rows")
    for gate in gates:
        gate.shared.destroy()
    return whole


def _split_hot(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes with very many rows, hinted for broadcast (at most HOT_SHARE of them), and the others."""
    least = max(HOT_ROWS, (whole.agg(F.sum("held")).first()[0] or 0) // HOT_SHARE)
    return F.broadcast(whole.where(F.col("held") >= least)), whole.where(F.col("held") < least)


def _gated_rows(docs: DataFrame, id_col: str, text_col: str, gate: Gate, hot: DataFrame) -> DataFrame:
    """docs plus ``nd_key``: the class where it passes the gate, else null.

    Of the classes with very many rows, which hot has, only rows with the id that stays go on, and a
    task sends rows of equal class and id once, so no copy is shuffled a million times.
    """
    stays = docs.sparkSession.sparkContext.broadcast({bytes(r["nd_key"]): r["component_id"] for r in hot.collect()})
    at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    as_text = not dict(docs.dtypes)[text_col].startswith(("string", "binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(text_at)
            keys = _keys(text.cast(pa.string()) if as_text else text)
            some = [r for r, k in enumerate(keys) if k is not None]
            ok = gate.passes(_key_probes([keys[r] for r in some])) if some else ()
            out, keep = [None] * len(keys), np.ones(len(keys), bool)
            ids = batch.column(at).to_pylist()
            for r in itertools.compress(some, ok):
                key = keys[r]
                if (key, ids[r]) in seen or key in stays.value and stays.value[key] != ids[r]:
                    keep[r] = False
                else:
                    seen.add((key, ids[r]))
                    out[r] = key
            if len(seen) > 500_000:
                seen.clear()
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "nd_key"])
            yield whole if keep.all() else whole.filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, schema_of(docs, docs.columns, "nd_key binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, width: int = 3, tuples: int = 24) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their distinct word
    shingles; component_id is the smallest doc_id that links reach.  Null, empty and blank texts
    have no shingles, link with nothing and keep their own id.  Equal rows get equal results; rows
    of equal text are one class.  A null id links like any other but is never the smallest; if all
    ids of a class are null, its component_id is null and its rows are kept.  A text of any length is
    taken whole.  Columns other than id and text are not read.  An empty table gives an empty result.
    """
    stages = Stages(docs.sparkSession, "near-dup")
    text = keyed_text(docs, id_col, text_col).withColumnRenamed("text", "nd_text")
    rows = stages.write(signed_rows(text, shingle, width, tuples), "rows")
    whole = class_components(text, rows, stages, shingle, percent, width, tuples).select("nd_key", "held", "component_id")
    hot, rest = _split_hot(whole)
    rows = rows.select("doc_id", "nd_key", F.col("nd_n").alias("n_shingles"))
    alone = rows.where("nd_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = rows.where("nd_key IS NOT NULL")
    out = some.join(hot, "nd_key").unionByName(some.join(hot, "nd_key", "left_anti").join(rest, "nd_key")).select("doc_id", "n_shingles", "component_id").unionAll(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, width: int = 3, tuples: int = 24) -> DataFrame:
    """The rows of docs with one row for each group of near copies, all columns as they were.

    The row with the smallest id stays; of repeated rows with that id and equal words, one.  Texts
    without words (null, empty, blank) are never dropped.  A null id stays only where a group has no
    other.  Columns may have any names; an empty table stays empty.
    """
    stages = Stages(docs.sparkSession, "near-dup")
    text = keyed_text(docs, id_col, text_col).withColumnRenamed("text", "nd_text")
    rows = stages.write(signed_rows(text, shingle, width, tuples), "rows")
    whole = class_components(text, rows, stages, shingle, percent, width, tuples)
    stages.drop("rows")
    # Classes of one row and no link stay as they are; only the other rows are shuffled with their text.
    grouped = stages.write(whole.where("held > 1 OR nd_linked").select("nd_key", "held", "component_id"), "grouped")
    # Carried columns get names of their own, whatever they are called in docs.
    names = [f"c{k}" for k in range(len(docs.columns))]
    id_name, text_name = (names[docs.columns.index(c)] for c in (id_col, text_col))
    keyed = _gated_rows(docs.toDF(*names), id_name, text_name, gate_of(grouped.select("nd_key")), _split_hot(grouped)[0])
    some = keyed.where("nd_key IS NOT NULL").join(grouped.select("nd_key", F.col("component_id").alias("nd_least"), F.lit(True).alias("nd_known")), "nd_key", "left")
    # What the gate let pass falsely is not known, and a class of its own.
    some = some.where(F.col("nd_known").isNull() | F.col(id_name).eqNullSafe(F.col("nd_least"))).dropDuplicates(["nd_key", id_name])
    return some.select(names).unionAll(keyed.where("nd_key IS NULL").select(names)).toDF(*docs.columns)
