"""Column functions of the redaction engine: labels, scores, placeholders, overlap, bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what a line becomes if it cannot be processed (a fixed value)
WITHHELD = "⟦pf:line-redacted⟧"
PLACEHOLDER = r"<([A-Z][A-Z0-9_]*?)_([0-9]+)>"


def entity_type(label: Column) -> Column:
    """``B-secret`` to ``secret``: drops one character and a hyphen in front; other labels stay."""
    tagged = (F.length(label) > 2) & (F.substring(label, 2, 1) == "-") & (F.substring(label, 1, 1) != "-")
    return F.when(tagged, F.substring(label, 3, 1 << 30)).otherwise(label)


def label_kind(label: Column) -> Column:
    """One of O, B, I, E, S; whatever is not tagged with one of the last four is O."""
    first = F.substring(label, 1, 1)
    return F.when((F.length(label) > 2) & (F.substring(label, 2, 1) == "-") & first.isin("B", "I", "E", "S"), first).otherwise("O")


def argmax(scores: Column) -> Column:
    """0-based place of the first largest score; -1 for an empty array.  Scores must not be NaN."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int")).otherwise(-1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays with the customary 1e-9 in the denominator."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two values, trimmed and lower-cased, are not empty and one contains the other."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def placeholders(text: Column) -> Column:
    """All placeholders in a text, with repeats."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)


def flat_lines(text: Column) -> Column:
    """Each line break (CRLF counts once) as one blank; one at the very end is dropped, as joining split lines does."""
    return F.regexp_replace(F.regexp_replace(text, BREAK + r"\z", ""), BREAK, " ")


BREAK = "(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])"


def clamp_id(token: Column, vocabulary: int) -> Column:
    return F.greatest(F.lit(0), F.least(token, F.lit(vocabulary - 1)))


def big_endian(n: Column) -> Column:
    """Four bytes of an unsigned number, most significant first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def frame_request(text: Column) -> Column:
    """Length in four bytes, then the UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    return F.concat(big_endian(F.octet_length(data)), data)


def frame_response(status: Column, text: Column) -> Column:
    """One status byte, then a request frame."""
    return F.concat(F.unhex(F.lpad(F.hex(status.cast("long")), 2, "0")), frame_request(text))


def read_length(frame: Column, at: int = 0) -> Column:
    """The length in the four bytes after ``at`` bytes."""
    return F.conv(F.hex(F.substring(frame, at + 1, 4)), 16, 10).cast("long")


def start_decision(responsive: Column, force: Column) -> Column:
    """What starting does about a server that may be there."""
    return F.when(responsive & ~force, "alreadyRunning").when(responsive, "displace").otherwise("reclaim")
