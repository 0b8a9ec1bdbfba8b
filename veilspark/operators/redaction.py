"""Spans to stable placeholders: clamp, number, splice, vault.

Two plans for one meaning.  If a scope lies in one row (a document), everything happens inside the
row with array functions: no shuffle.  If a scope spans rows (a conversation, a stream), only the
lines with spans are shuffled: distinct values are reduced first, as hashes, numbered by first
occurrence, written without any value, and joined back.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WITHHELD
from ..shared import remove_folder, shared_folder
from .patterns import pattern_spans
from .scorers import span_lines

#: up to so many distinct values are numbered by one window for each scope and category
NARROW = 1_000_000
FOUND = "array<struct<s:int,e:int,category:string,value:string>>"


def enabled(spans: Column, only: Sequence[str] | None = None, skip: Sequence[str] = ()) -> Column:
    """Spans of the wanted categories; with ``only`` given, ``skip`` has no effect.  Comes before clamping."""
    if only is not None:
        return F.filter(spans, lambda s: s["category"].isin(list(only))) if only else F.filter(spans, lambda s: F.lit(False))
    return F.filter(spans, lambda s: ~s["category"].isin(list(skip))) if skip else spans


def clamp(text: Column, spans: Column) -> Column:
    """Array of (s, e, category, value) without overlaps, inside the text, by start; never less covered than before."""
    numbered = F.array_sort(F.transform(spans, lambda x, n: F.struct(x["s"].alias("s"), n.alias("n"), x["e"].alias("e"), x["category"].alias("category"))))

    def add(state, x):
        s, e = F.greatest(state["cursor"], x["s"]), F.least(x["e"], F.length(text))
        span = F.struct(s.alias("s"), e.alias("e"), x["category"].alias("category"), F.substring(text, s + 1, e - s).alias("value"))
        kept = F.struct(e.alias("cursor"), F.concat(state["out"], F.array(span)).alias("out"))
        return F.when(s < e, kept).otherwise(state)

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(FOUND).alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(numbered, start, add, lambda state: state["out"])).otherwise(F.array().cast(FOUND))


def splice(text: Column, spans: Column) -> Column:
    """The text with each clamped span (s, e, token) replaced; everything else stays to the character."""

    def add(state, x):
        piece = F.concat(state["out"], F.substring(text, state["cursor"] + 1, x["s"] - state["cursor"]), x["token"])
        return F.struct(x["e"].alias("cursor"), piece.alias("out"))

    start = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substring(text, s["cursor"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def placeholder(category: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), F.upper(category), F.lit("_"), n.cast("string"), F.lit(">"))


def number_in_row(clamped: Column) -> Column:
    """Clamped spans with their tokens, numbered by first occurrence inside the row."""
    keys = F.array_distinct(F.transform(clamped, lambda x: F.struct(x["category"].alias("c"), x["value"].alias("v"))))

    def named(x):
        place = F.array_position(keys, F.struct(x["category"].alias("c"), x["value"].alias("v"))).cast("int")
        n = F.size(F.filter(F.slice(keys, 1, place), lambda k: k["c"] == x["category"]))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), placeholder(x["category"], n).alias("token"), x["category"].alias("category"), x["value"].alias("value"))

    return F.transform(clamped, named)


def redact_rows(df: DataFrame, spans: str = "spans", text: str = "text", only: Sequence[str] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """df plus ``found`` (s, e, token, category, value) and ``redacted``; each row is a scope of its own.  No shuffle."""
    df = df.withColumn("found", clamp(F.col(text), enabled(F.col(spans), only, skip)))
    df = df.withColumn("found", number_in_row(F.col("found")))
    return df.withColumn("redacted", splice(F.col(text), F.col("found")))


def vault_of_rows(redacted: DataFrame, scope: str) -> DataFrame:
    """(scope, category, value, token) of ``redact_rows``.  Sensitive: it holds the original values."""
    return redacted.select(F.col(scope).alias("scope"), F.explode("found").alias("f")).select("scope", "f.category", "f.value", "f.token").distinct()


def _first_seen(lines: DataFrame) -> DataFrame:
    """(scope, category, digest, first): each distinct value, as a hash, with the place of its first occurrence.

    Lines of one number come in the order of a hash of their text; null numbers and scopes come first.
    """
    seen = lines.where(F.size("found") > 0).select("scope", "line_no", F.xxhash64("text").alias("h"), F.explode("found").alias("f"))
    return seen.groupBy("scope", "f.category", _digest(F.col("f.value")).alias("digest")).agg(F.min(F.struct("line_no", "h", "f.s")).alias("first"))


def _digest(value: Column) -> Column:
    return F.sha2(value, 256)


def _numbered(first: DataFrame, wide: bool | None) -> DataFrame:
    """(scope, category, digest, n), written to the shared folder: values stand there as hashes only.

    ``wide``: numbers come from counts by range partition, for scopes with more distinct values than one
    task should sort; None takes that way if there are more than ``NARROW`` distinct values in all.
    """
    folder = f"{shared_folder(first.sparkSession)}/numbers-{uuid.uuid4().hex[:12]}"
    spark = first.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    atexit.register(_forget, spark, folder)
    first = written(first, "first")
    if wide is None:
        wide = first.limit(NARROW + 1).count() > NARROW
    if not wide:
        return first.withColumn("n", F.row_number().over(Window.partitionBy("scope", "category").orderBy("first", "digest")))
    ordered = written(first.repartitionByRange("scope", "category", "first", "digest").withColumn("part", F.spark_partition_id()), "ordered")
    held = ordered.groupBy("scope", "category", "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("scope", "category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col("scope").alias("scope_"), F.col("category").alias("category_"), F.col("part").alias("part_"), before.alias("before"))
    here = F.row_number().over(Window.partitionBy("part", "scope", "category").orderBy("first", "digest"))
    same = F.col("scope").eqNullSafe(F.col("scope_")) & (F.col("category") == F.col("category_")) & (F.col("part") == F.col("part_"))
    return ordered.withColumn("n", here).join(held, same).withColumn("n", (F.col("n") + F.col("before")).cast("int"))


def _forget(spark, folder: str) -> None:
    with contextlib.suppress(Exception):
        remove_folder(spark, folder)


def _tokens(first: DataFrame, wide: bool | None) -> DataFrame:
    numbered = _numbered(first, wide)
    return numbered.select(F.col("scope").alias("scope_"), F.col("category").alias("category_"), F.col("digest").alias("digest_"), "n", placeholder(F.col("category"), F.col("n")).alias("token"))


def _same() -> Column:
    return F.col("scope").eqNullSafe(F.col("scope_")) & (F.col("category") == F.col("category_")) & (F.col("digest") == F.col("digest_"))


def vault_of_lines(lines: DataFrame, wide: bool | None = None) -> DataFrame:
    """(scope, category, value, n, token) for lines (scope, line_no, text, found): numbers by first occurrence in (line_no, s)."""
    return _vault(lines, _tokens(_first_seen(lines), wide))


def _vault(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    values = lines.where(F.size("found") > 0).select("scope", F.explode("found").alias("f")).select("scope", "f.category", "f.value").distinct()
    return values.withColumn("digest", _digest(F.col("value"))).join(tokens, _same()).select("scope", "category", "value", "n", "token")


def redact_lines(lines: DataFrame, spans: str = "spans", only: Sequence[str] | None = None, skip: Sequence[str] = (), wide: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(out, vault) for lines (scope, line_no, text, spans) whose scopes span rows.

    out has scope, line_no, text and redacted, a row for each line, whatever its scope, number or
    text: a null text stays null, lines of one scope and number do not meet, a null scope is a scope.
    Only lines with spans are joined, with their spans; the rest pass by.  Two passes detect: one
    numbers the distinct values (see ``_numbered``), one redacts.
    """
    found = F.coalesce(clamp(F.col("text"), enabled(F.col(spans), only, skip)), F.array().cast(FOUND))
    # Filters on an exploded column stay above it, so spans are found once in a pass and not again for each filter.
    found = lines.select("scope", "line_no", "text", F.explode(F.array(found)).alias("found"))
    tokens = _tokens(_first_seen(found), wide)
    clean = found.where(F.size("found") == 0).select("scope", "line_no", "text", F.col("text").alias("redacted"))
    hit = found.where(F.size("found") > 0).select("scope", "line_no", "text", F.posexplode("found").alias("k", "f"))
    hit = hit.select("scope", "line_no", "text", "k", "f.s", "f.e", "f.category", _digest(F.col("f.value")).alias("digest"))
    named = hit.join(tokens, _same()).groupBy("scope", "line_no", "text")
    # Equal lines have equal spans: each span comes as often as the line does.
    named = named.agg(F.array_sort(F.collect_set(F.struct("s", "e", "token"))).alias("tokens"), F.sum(F.when(F.col("k") == 0, 1)).alias("copies"))
    dirty = named.select("scope", "line_no", "text", splice(F.col("text"), F.col("tokens")).alias("redacted"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return clean.unionAll(dirty.select(clean.columns)), _vault(found, tokens)


def redact(lines: DataFrame, scorer=None, text: str = "text", decoder: str = "viterbi", only: Sequence[str] | None = None, skip: Sequence[str] = (), fail_open: bool = False, wide: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(out, vault): lines (scope, line_no, text) scored, decoded, merged, redacted, and withheld where that failed.

    out has scope, line_no, redacted and ok.  ``scorer`` is any of ``scorers``, or None for the patterns.
    A line whose scorer raises, or whose labels do not match its tokens, becomes the fixed placeholder
    (its text if ``fail_open``) and leaves no value in the vault; other lines are not touched by it.  A
    line without text is fine and stays null.
    """
    lines = lines.select("scope", "line_no", F.col(text).alias("text"))
    if scorer is None:
        ready = lines.withColumn("spans", pattern_spans(F.col("text"))).withColumn("ok", F.lit(True))
    else:
        scored = span_lines(lines.withColumn("blank", F.coalesce("text", F.lit(""))), scorer, "blank", decoder)
        ready = scored.select("scope", "line_no", "text", "scored.spans", "scored.ok")
    # The outcome is a part of the key that keeps lines apart.
    keyed = ready.withColumn("line_no", F.struct("line_no", "ok"))
    out, vault = redact_lines(keyed, only=only, skip=skip, wide=wide)
    line = withhold(F.col("line_no.ok"), F.col("redacted"), F.col("text"), fail_open)
    return out.select("scope", F.col("line_no.line_no").alias("line_no"), line.alias("redacted"), F.col("line_no.ok").alias("ok")), vault


def withhold(ok: Column, redacted: Column, raw: Column, fail_open: bool = False) -> Column:
    """The redacted line, or the fixed placeholder where processing failed (the raw line if fail_open)."""
    return F.when(F.coalesce(ok, F.lit(False)), redacted).otherwise(raw if fail_open else F.lit(WITHHELD))
