"""Redaction of streams: placeholder numbers live in keyed state across micro-batches.

Messages are (scope, seq, payload); a scope is a connection or a conversation.  Numbers depend on
(scope, seq, position) order, so the batch result over the same ordered input is the same.  A row
with ``closed`` set ends its scope and drops its state; late rows never renumber what was emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import WITHHELD
from ..operators.patterns import pattern_spans
from ..operators.redaction import clamp, enabled
from ..sources.frames import MAX_FRAME, OK, PROTOCOL, FrameReader, Oversize, encode_response

OUTPUT = "scope string, seq long, redacted string"


class _Numbering(StatefulProcessor):
    """Keeps (category, value) to number and category to count for each scope."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "category string, value string", "n int", self.ttl_ms)
        self.counts = handle.getMapState("counts", "category string", "n int", self.ttl_ms)

    def token(self, category: str, value: str) -> str:
        key = (category, value)
        if self.numbers.containsKey(key):
            n = self.numbers.getValue(key)[0]
        else:
            n = (self.counts.getValue((category,))[0] if self.counts.containsKey((category,)) else 0) + 1
            self.counts.updateValue((category,), (n,))
            self.numbers.updateValue(key, (n,))
        return f"<{category.upper()}_{n}>"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, ended = [], False
        for seq, payload, ok, lines, closed in zip(frame["seq"], frame["payload"], frame["ok"], frame["lines"], frame["closed"]):
            if payload is not None:
                out.append((str(key[0]), int(seq), self.message(lines) if ok else WITHHELD))
            ended = ended or bool(closed)
        if ended:
            self.numbers.clear()
            self.counts.clear()
        yield pd.DataFrame(out, columns=["scope", "seq", "redacted"])

    def message(self, lines) -> str:
        done = []
        for line in lines:
            text, cursor = [], 0
            for span in line["found"]:
                text += (line["text"][cursor : span["s"]], self.token(span["category"], span["value"]))
                cursor = span["e"]
            done.append("".join(text) + line["text"][cursor:])
        return "\n".join(done)

    def close(self) -> None:
        pass


def redact_stream(messages: DataFrame, only: Sequence[str] | None = None, skip: Sequence[str] = (), spans_of: Callable = pattern_spans, ttl_ms: int | None = None) -> DataFrame:
    """(scope, seq, redacted) for a stream (scope, seq, payload, closed); detection is stateless, only numbering has state."""

    def line(text):
        found = clamp(text, enabled(spans_of(text), only, skip))
        return F.struct(text.alias("text"), found.alias("found"))

    lines = F.transform(F.split(F.coalesce("payload", F.lit("")), "\n", -1), line)
    rows = messages.select(F.col("scope").cast("string").alias("scope"), "seq", "payload", F.coalesce("closed", F.lit(False)).alias("closed"), F.lit(True).alias("ok"), lines.alias("lines"))
    return rows.groupBy("scope").transformWithStateInPandas(_Numbering(ttl_ms), OUTPUT, "Update", "None")


class _Frames(StatefulProcessor):
    """Keeps the bytes of a frame that is not whole yet; an oversized header ends the scope with status 2."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "data binary, frames long, broken boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        data, n, broken = self.rest.get() if self.rest.exists() else (b"", 0, False)
        reader, out = FrameReader(False, self.limit, bytes(data)), []
        for chunk in frame["chunk"]:
            if broken:
                break
            if chunk is None:
                continue
            reader.feed(chunk)
            try:
                for _, text in reader.frames():
                    out.append((str(key[0]), n, OK, text))
                    n += 1
            except Oversize:
                out.append((str(key[0]), n, PROTOCOL, ""))
                broken = True
        if frame["closed"].any():
            self.rest.clear()
        else:
            self.rest.update((reader.rest if not broken else b"", n, broken))
        yield pd.DataFrame(out, columns=["scope", "seq", "status", "payload"])

    def close(self) -> None:
        pass


def frames_of_chunks(chunks: DataFrame, limit: int = MAX_FRAME) -> DataFrame:
    """(scope, seq, status, payload) of a stream of byte chunks (scope, seq, chunk) with or without ``closed``.

    A row with ``closed`` set ends its scope: what is left of a frame is dropped with the state.  A null chunk adds nothing.
    """
    closed = F.coalesce(F.col("closed"), F.lit(False)) if "closed" in chunks.columns else F.lit(False)
    rows = chunks.select(F.col("scope").cast("string").alias("scope"), "seq", "chunk", closed.alias("closed"))
    return rows.groupBy("scope").transformWithStateInPandas(_Frames(limit), "scope string, seq long, status int, payload string", "Update", "None")


def respond(status: int, text: str) -> bytes:
    """The response to one frame."""
    return encode_response(status, text)
