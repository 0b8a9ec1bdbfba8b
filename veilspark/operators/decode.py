"""Scores to labels (argmax or constrained Viterbi) and labels to merged spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import entity_type

GAP = 1
LOWEST = -np.finfo(np.float32).max


@dataclass(frozen=True)
class Bias:
    """Bonuses for entering a span and for staying outside one; zero leaves pure legality."""

    span_entry: float = 0.0
    stay_outside: float = 0.0


def _parts(label: str) -> tuple[str, str]:
    """Kind (O, B, I, E, S) and entity type of a label."""
    tagged = len(label) > 2 and label[1] == "-" and label[0] != "-"
    kind = label[0] if tagged and label[0] in "BIES" else "O"
    return kind, label[2:] if tagged else label


class Transitions:
    """Which label may follow which, with bonuses, as float32 matrices [before, after]."""

    def __init__(self, labels: Sequence[str], bias: Bias = Bias()):
        kinds, types = zip(*map(_parts, labels)) if labels else ((), ())
        n = len(labels)
        kind, of = np.array(kinds), np.array(types)
        closed = np.isin(kind, ["O", "E", "S"])
        opens = np.isin(kind, ["O", "B", "S"])
        same = of[:, None] == of[None, :]
        self.legal = np.where(closed[:, None], opens[None, :], np.isin(kind, ["I", "E"])[None, :] & same) if n else np.zeros((0, 0), bool)
        entry = np.isin(kind, ["B", "S"]) * np.float32(bias.span_entry)
        self.first = (entry + (kind == "O") * np.float32(bias.stay_outside)).astype(np.float32)
        stay = (kind == "O")[:, None] & (kind == "O")[None, :]
        self.bonus = (np.broadcast_to(entry, (n, n)) + stay * np.float32(bias.stay_outside)).astype(np.float32)
        self.may_start, self.may_end = opens, closed


def viterbi(scores: np.ndarray, labels: Sequence[str], transitions: Transitions | None = None) -> list[str]:
    """The best legal label path of a float32 matrix (tokens x labels).

    All sums are float32, added as (best before + bonus) + score; ties go to the lowest label.
    Without a legal end the best label of all ends the path.
    """
    scores = np.asarray(scores, np.float32).reshape(-1, max(len(labels), 1))
    if not len(scores) or not labels:
        return []
    t = transitions or Transitions(labels)
    best = np.where(t.may_start, scores[0] + t.first, LOWEST).astype(np.float32)
    back = np.full(scores.shape, -1, np.int64)
    with np.errstate(over="ignore"):
        for i in range(1, len(scores)):
            reach = np.where(t.legal & (best > LOWEST)[:, None], best[:, None] + t.bonus, LOWEST)
            before = reach.argmax(0)
            top = reach[before, np.arange(len(labels))]
            ok = top > LOWEST
            back[i] = np.where(ok, before, -1)
            best = np.where(ok, top + scores[i], LOWEST).astype(np.float32)
    ends = np.where(t.may_end, best, LOWEST)
    last = int(ends.argmax()) if (ends > LOWEST).any() else int(best.argmax())
    path = [last]
    for i in range(len(scores) - 1, 0, -1):
        path.append(max(int(back[i][path[-1]]), 0))
    return [labels[c] for c in reversed(path)]


def first_best(scores: np.ndarray, labels: Sequence[str]) -> list[str]:
    """Label of the first largest score of each token; NaN never wins."""
    scores = np.asarray(scores, np.float32).reshape(-1, max(len(labels), 1))
    if not labels:
        return []
    return [labels[c] for c in np.where(np.isnan(scores), -np.inf, scores).argmax(1)]


def decode_udf(labels: Sequence[str], decoder: str = "viterbi", bias: Bias = Bias()):
    """Pandas UDF: flat scores of a line to its labels.  ``argmax`` picks first_best, any other name the Viterbi path."""
    labels = list(labels)

    @F.pandas_udf("array<string>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transitions = Transitions(labels, bias)
        for batch in batches:
            if decoder == "argmax":
                yield pd.Series([first_best(x, labels) for x in batch])
            else:
                yield pd.Series([viterbi(x, labels, transitions) for x in batch])

    return decode


def merged(tokens: Sequence[tuple[int, int]], labels: Sequence[str], gap: int = GAP) -> list[tuple[int, int, str]]:
    """Spans (s, e, category) of labelled tokens in plain Python, for scorers whose labels never reach the JVM."""
    out: list[tuple[int, int, str]] = []
    for (s, e), label in zip(tokens, labels):
        if label == "O":
            continue
        category = _parts(label)[1]
        if out and out[-1][2] == category and s <= out[-1][1] + gap:
            out[-1] = out[-1][0], max(out[-1][1], e), category
        else:
            out.append((s, e, category))
    return out


def merge_in_row(tokens: Column, labels: Column, gap: int = GAP) -> Column:
    """Spans (s, e, category) of tokens (s, e) with labels, equal neighbours merged over gaps up to ``gap``."""
    kind = "array<struct<s:int,e:int,category:string>>"
    pairs = F.zip_with(tokens, labels, lambda t, x: F.struct(t["s"].alias("s"), t["e"].alias("e"), x.alias("label")))

    def add(out, p):
        category, last = entity_type(p["label"]), F.element_at(out, -1)
        joined = (F.size(out) > 0) & (last["category"] == category) & (p["s"] <= last["e"] + gap)
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], p["e"]).alias("e"), category.alias("category"))
        new = F.struct(p["s"].alias("s"), p["e"].alias("e"), category.alias("category"))
        return F.when(joined, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wider))).otherwise(F.concat(out, F.array(new)))

    safe = F.array().cast(kind)
    return F.aggregate(F.filter(pairs, lambda p: p["label"] != "O"), safe, lambda out, p: F.when(F.size(out) == 0, F.array(F.struct(p["s"].alias("s"), p["e"].alias("e"), entity_type(p["label"]).alias("category")))).otherwise(add(out, p)))


def merge_tokens(tokens: DataFrame, keys: Sequence[str], gap: int = GAP, order: Sequence[str] = ("ord",)) -> DataFrame:
    """The same over rows (keys, ord, s, e, label): gaps and islands with a running end."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = tokens.where("label <> 'O'").withColumn("category", entity_type(F.col("label")))
    changed = F.coalesce(F.lag("category").over(by) != F.col("category"), F.lit(True))
    rows = rows.withColumn("run", F.sum(changed.cast("int")).over(by))
    inside = Window.partitionBy(*keys, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", (F.coalesce(F.col("s") > F.max("e").over(inside) + gap, F.lit(True))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(by))
    return rows.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("category").alias("category"))
