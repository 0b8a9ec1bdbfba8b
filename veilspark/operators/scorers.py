"""Scorers: text to token offsets and scores, behind one interface that may fail line by line."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import Bias, Transitions, first_best, merged, viterbi

SCORED = "ok boolean, err string, tokens array<struct<s:int,e:int>>, labels array<string>"
_BLANK = " \t\n\r"


def anchor_pieces(text: str, pieces: Sequence[str]) -> list[tuple[int, int]]:
    """Offsets of decoded pieces found one after another in the text.

    A piece stands at the cursor, or after skipped blanks, or does so without its own leading
    space.  An empty piece, half a character, or a piece found nowhere raises ValueError.
    """
    out, cursor = [], 0
    for piece in pieces:
        if not piece or "�" in piece:
            raise ValueError("a piece has no text of its own")
        after = cursor
        while after < len(text) and text[after] in _BLANK:
            after += 1
        tries = [(piece, cursor), (piece, after)]
        if piece[0] == " " and len(piece) > 1:
            tries += [(piece[1:], cursor), (piece[1:], after)]
        at = next(((p, s) for p, s in tries if text.startswith(p, s)), None)
        if at is None:
            raise ValueError("a piece is not where it should be")
        cursor = at[1] + len(at[0])
        out.append((at[1], cursor))
    return out


class TokenizerEncoder:
    """ids and offsets by a tokenizer file of the ``tokenizers`` library; loaded on first use in a worker."""

    def __init__(self, path: str):
        self.path, self._tool = path, None

    def __getstate__(self):
        return {"path": self.path, "_tool": None}

    def __call__(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        if self._tool is None:
            from tokenizers import Tokenizer

            self._tool = Tokenizer.from_file(self.path)
        got = self._tool.encode(text, add_special_tokens=False)
        return got.ids, got.offsets


class FixtureScorer:
    """Replays known lines: text to (offsets, scores); other lines fail."""

    def __init__(self, labels: Sequence[str], known: dict[str, tuple[list[tuple[int, int]], list[list[float]]]]):
        self.labels, self.known = list(labels), known

    def __call__(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        if not text:
            return [], np.zeros((0, len(self.labels)), np.float32)
        offsets, scores = self.known[text]
        return offsets, np.asarray(scores, np.float32)


class MarkScorer:
    """A scorer without weights: blank-separated words that hold a mark are singletons of its category.

    A line of more than ``longest`` characters raises, as a model does whose input is too long.
    """

    def __init__(self, marks: dict[str, str], longest: int | None = None):
        self.marks, self.longest = dict(marks), longest
        self.labels = ["O"] + [f"{k}-{c}" for c in dict.fromkeys(self.marks.values()) for k in "BIES"]

    def __call__(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        if self.longest is not None and len(text) > self.longest:
            raise ValueError("too long")
        words, offsets, at = text.split(" ") if text else [], [], 0
        scores = np.zeros((len(words), len(self.labels)), np.float32)
        for k, word in enumerate(words):
            offsets.append((at, at + len(word)))
            at += len(word) + 1
            found = next((c for mark, c in self.marks.items() if mark in word), None)
            scores[k, self.labels.index(f"S-{found}") if found else 0] = 1
        return offsets, scores


class ModelScorer:
    """An encoder and a token classifier; ids are clamped into the vocabulary."""

    def __init__(self, encoder: Callable, model, labels: Sequence[str]):
        self.encoder, self.model, self.labels = encoder, model, list(labels)

    def __call__(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        ids, offsets = self.encoder(text)
        if not len(ids):
            return [], np.zeros((0, len(self.labels)), np.float32)
        return offsets, self.model.logits(np.clip(np.asarray(ids), 0, self.model.vocabulary - 1))


def labelled(scorer, line: str, decoder: str, transitions: Transitions) -> tuple[list[tuple[int, int]], list[str]]:
    """Token offsets and labels of one line; raises where the scorer does or where they differ in number."""
    offsets, scores = scorer(line)
    labels = first_best(scores, scorer.labels) if decoder == "argmax" else viterbi(scores, scorer.labels, transitions)
    if len(labels) != len(offsets):
        raise ValueError("labels and tokens differ in number")
    return offsets, labels


def _udf(scorer, shared, decoder: str, bias: Bias, schema: str, columns: list[str], row: Callable, failed: tuple):
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = shared.value
        transitions = Transitions(tool.labels, bias)
        for batch in batches:
            rows = []
            for line in batch:
                try:
                    rows.append((True, None, *row(*labelled(tool, line, decoder, transitions))))
                except Exception as e:
                    rows.append((False, type(e).__name__, *failed))
            yield pd.DataFrame(rows, columns=columns)

    return run


def score_lines(lines: DataFrame, scorer, text: str = "text", decoder: str = "viterbi", bias: Bias = Bias()) -> DataFrame:
    """lines plus ``scored`` (ok, err, tokens, labels), in one Python stage: scores never leave it.

    An exception in a line marks that line as failed with the exception's type only, never its text.
    A line without tokens is fine and has no labels; a label count that differs from the tokens fails.
    """
    shared = lines.sparkSession.sparkContext.broadcast(scorer)
    row = lambda offsets, labels: ([{"s": int(s), "e": int(e)} for s, e in offsets], labels)
    return lines.withColumn("scored", _udf(scorer, shared, decoder, bias, SCORED, ["ok", "err", "tokens", "labels"], row, ([], []))(F.col(text)))


def span_lines(lines: DataFrame, scorer, text: str = "text", decoder: str = "viterbi", bias: Bias = Bias()) -> DataFrame:
    """lines plus ``scored`` (ok, err, spans): as ``score_lines``, with the labels merged to spans in the same stage."""
    shared = lines.sparkSession.sparkContext.broadcast(scorer)
    row = lambda offsets, labels: ([{"s": int(s), "e": int(e), "category": c} for s, e, c in merged(offsets, labels)],)
    return lines.withColumn("scored", _udf(scorer, shared, decoder, bias, "ok boolean, err string, spans array<struct<s:int,e:int,category:string>>", ["ok", "err", "spans"], row, ([],))(F.col(text)))
