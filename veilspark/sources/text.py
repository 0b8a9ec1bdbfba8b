"""Line sources and sinks, labelled records, the vault file."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import flat_lines

log = logging.getLogger("veilspark")
GOLD = "text string, spans array<struct<category:string,value:string>>"

#: fine labels of a public PII corpus to categories (fixed values); others are dropped
FINE_LABELS = {
    "FIRSTNAME": "private_person", "LASTNAME": "private_person", "MIDDLENAME": "private_person",
    "EMAIL": "private_email", "PHONENUMBER": "private_phone",
    "STREET": "private_address", "BUILDINGNUMBER": "private_address", "SECONDARYADDRESS": "private_address", "STREETADDRESS": "private_address",
    "DATE": "private_date", "DOB": "private_date",
    "ACCOUNTNUMBER": "account_number", "CREDITCARDNUMBER": "account_number", "IBAN": "account_number", "SSN": "account_number",
    "URL": "private_url", "IP": "private_url", "IPV4": "private_url", "IPV6": "private_url",
    "PASSWORD": "secret",
}
FINE_GAP = 3


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(scope, line_no, text) of text files: each file is a scope, lines end at newlines, a trailing CR is dropped.

    A file is read in splits by many tasks.  Rows are numbered inside a split as they come; the lines of
    the splits before it, of which there is one row each, are added.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("scope"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("text"))
    splits = rows.groupBy("scope", "block").agg(F.min("id").alias("first"), F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("scope").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("scope", "block", (before - F.col("first")).alias("shift"))
    return rows.join(splits, ["scope", "block"]).select("scope", (F.col("id") + F.col("shift")).alias("line_no"), "text")


def write_lines(out: DataFrame, path: str, column: str = "redacted") -> None:
    """Lines as text files in the order of scope and line number."""
    out.orderBy("scope", "line_no").select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_vault(vault: DataFrame, scope, path: str) -> int:
    """The placeholder map of one scope as sorted JSON in a new file that only its owner reads; the number of entries.

    The values are secrets: they go to this file alone, and a file that was there is removed first.
    """
    pairs = {r["token"]: r["value"] for r in vault.where(F.col("scope") == F.lit(scope)).select("token", "value").toLocalIterator()}
    if os.path.lexists(path):
        os.unlink(path)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        json.dump(pairs, f, indent=2, sort_keys=True, ensure_ascii=False)
    return len(pairs)


def report(message: str) -> None:
    """Diagnostics: reasons and counts, never texts."""
    log.warning(message)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text, spans) of JSON lines in a file; line breaks inside a text become blanks, blank lines are skipped."""
    rows = read_lines(spark, path).where(F.trim("text") != "")
    rows = rows.select("line_no", F.from_json("text", GOLD).alias("g")).select("line_no", "g.*")
    return rows.withColumn("text", flat_lines(F.col("text")))


def write_gold(gold: DataFrame, path: str) -> None:
    """JSON lines in order, in as many files as there are partitions, named in that order."""
    gold.orderBy("line_no").select(F.to_json(F.struct("text", "spans")).alias("value")).write.mode("overwrite").text(path)


def coarse(label: Column) -> Column:
    """Category of a fine label, null if it has none."""
    return F.create_map(*[F.lit(x) for pair in FINE_LABELS.items() for x in pair])[F.upper(label)]


def coarse_spans(mask: Column) -> Column:
    """Spans (s, e, category) of (label, start, end) entries: mapped, sorted, merged over gaps up to three."""
    from ..operators.decode import merge_in_row

    mapped = F.filter(F.transform(mask, lambda m: F.struct(m["start"].cast("int").alias("s"), m["end"].cast("int").alias("e"), coarse(m["label"]).alias("c"))), lambda m: m["c"].isNotNull())
    ordered = F.array_sort(mapped)
    return merge_in_row(F.transform(ordered, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))), F.transform(ordered, lambda m: m["c"]), FINE_GAP)


def in_language(docs: DataFrame, language: str, limit: int, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first rows of one language."""
    return docs.where(F.lower("lang") == language.lower()).orderBy(*order).limit(limit)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text, length, scores) of an npz file with texts, lengths and padded reference scores."""
    import numpy as np

    with np.load(path, allow_pickle=False) as z:
        rows = [(k, str(t), int(n), [list(map(float, x)) for x in s[: int(n)]]) for k, (t, n, s) in enumerate(zip(z["texts"], z["lengths"], z["ref_logits"]))]
    return spark.createDataFrame(rows, "line_no long, text string, length int, scores array<array<float>>")
