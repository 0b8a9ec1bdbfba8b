"""Length-prefixed frames: a reader of byte chunks, and a table function over binary columns.

A request is a four-byte big-endian length and UTF-8 bytes; a response has one status byte before
it.  Statuses pass through unchecked; bytes that are not UTF-8 become replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf

#: the longest payload in bytes
MAX_FRAME = 16 * 1024 * 1024
OK, FAILED, PROTOCOL = 0, 1, 2


class Oversize(ValueError):
    """A header announces more than the reader accepts."""


class FrameReader:
    """Collects chunks and yields whole frames in order; what is left waits for the next chunk."""

    def __init__(self, status: bool = False, limit: int = MAX_FRAME, rest: bytes = b""):
        self.extra, self.limit, self.rest = int(status), limit, bytes(rest)

    def feed(self, chunk: bytes) -> None:
        self.rest += bytes(chunk)

    def next(self) -> tuple[int, str] | None:
        """The next (status, text), or None while it is not whole.  The length is checked before the body arrives."""
        head = self.extra + 4
        if len(self.rest) < head:
            return None
        size = int.from_bytes(self.rest[self.extra : head], "big")
        if size > self.limit:
            raise Oversize(size)
        if len(self.rest) < head + size:
            return None
        status = self.rest[0] if self.extra else 0
        body, self.rest = self.rest[head : head + size], self.rest[head + size :]
        return status, body.decode("utf-8", "replace")

    def frames(self) -> Iterator[tuple[int, str]]:
        while (frame := self.next()) is not None:
            yield frame


def encode_request(text: str) -> bytes:
    data = text.encode()
    return len(data).to_bytes(4, "big") + data


def encode_response(status: int, text: str) -> bytes:
    return bytes([status]) + encode_request(text)


@udtf(returnType="seq int, status int, text string")
class DecodeFrames:
    """``decode_frames(bytes, has_status, limit)``: the frames in one value; an oversized header ends it with status 2."""

    def eval(self, data: bytes, has_status: bool, limit: int):
        reader = FrameReader(has_status, limit, data or b"")
        seq = 0
        try:
            for status, text in reader.frames():
                yield seq, status, text
                seq += 1
        except Oversize:
            yield seq, PROTOCOL, ""
