"""Texts to numbered lines and back; order is a column, never the place of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_lines(df: DataFrame, scope: str, text: str = "text", one_shot: bool = False) -> DataFrame:
    """(scope, line_no, text): a line for each newline and one more, empty lines kept.

    A null text is one line without text, so no row is lost.  ``one_shot`` drops one carriage return
    at a line's end, as a line reader does.
    """
    parts = F.when(F.col(text).isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.split(text, "\n", -1))
    rows = df.select(F.col(scope).alias("scope"), F.posexplode(parts).alias("line_no", "text"))
    return rows.withColumn("text", F.regexp_replace("text", "\r$", "")) if one_shot else rows


def to_text(lines: DataFrame, text: str = "text") -> DataFrame:
    """(scope, text): the lines of each scope joined by newlines in order; null if none of them has a text."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.col(text).alias("line"))))
    whole = F.array_join(F.transform(parts, lambda p: p["line"]), "\n")
    return lines.groupBy("scope").agg(F.when(F.count(text) > 0, whole).alias("text"))
