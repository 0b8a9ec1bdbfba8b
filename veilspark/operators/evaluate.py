"""Quality reports over redacted text: leak rate, precision and recall, agreement, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WITHHELD, cosine, overlaps, placeholders

#: the highest leak rate in percent that passes
LEAK_TARGET = 3.0


def aligned(left: DataFrame, right: DataFrame, on: str | list[str] = "line_no") -> DataFrame:
    """Inner join of two line tables that must pair up one to one; anything else raises."""
    n, m = left.count(), right.count()
    joined = left.join(right, on)
    if n != m or joined.count() != n:
        raise ValueError(f"{n} lines against {m}: they do not pair up")
    return joined


def leaks(values: DataFrame, out: DataFrame) -> DataFrame:
    """values (line_no, ord, category, value) with ``leaked``: whether the value still stands in its output line.

    A value whose line is missing from the output counts as leaked: losing lines never looks better.
    Of several output lines of one number, any may leak it.  Only lines that hold a value are compared.
    """
    lines = out.join(values.select("line_no").distinct(), "line_no", "left_semi").groupBy("line_no").agg(F.collect_set("redacted").alias("lines"))
    joined = values.join(lines, "line_no", "left")
    return joined.withColumn("leaked", F.coalesce(F.exists("lines", lambda line: F.contains(line, F.col("value"))), F.lit(True))).drop("lines")


def leak_rate(leaked: DataFrame, target: float = LEAK_TARGET) -> DataFrame:
    """(category, total, leaked, rate, passed) with one row for all categories, whose category is ``overall``."""
    rows = leaked.rollup("category").agg(F.count("*").alias("total"), F.sum(F.col("leaked").cast("long")).alias("leaked"))
    rate = F.when(F.col("total") > 0, F.round(100.0 * F.col("leaked") / F.col("total"), 6)).otherwise(0.0)
    rows = rows.select(F.coalesce("category", F.lit("overall")).alias("category"), "total", F.coalesce("leaked", F.lit(0).cast("long")).alias("leaked"))
    return rows.withColumn("rate", rate).withColumn("passed", F.col("rate") <= target)


def matched(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows (line_no, ord, category, value) with ``hit``: whether an overlapping value of that line and category is among others."""
    other = others.select("line_no", "category", F.col("value").alias("other"))
    others = other.groupBy("line_no", "category").agg(F.collect_set("other").alias("others"))
    hit = F.exists("others", lambda o: overlaps(F.col("value"), o))
    return rows.join(others, ["line_no", "category"], "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("others")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def precision_recall(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(category, gold, gold_hits, found, found_hits, precision, recall, f1).

    Recall is counted over gold rows and precision over found rows, each on its own; a zero
    denominator gives 0; categories of either side appear.
    """
    g = matched(gold, found).groupBy("category").agg(F.count("*").alias("gold"), F.sum(F.col("hit").cast("long")).alias("gold_hits"))
    f = matched(found, gold).groupBy("category").agg(F.count("*").alias("found"), F.sum(F.col("hit").cast("long")).alias("found_hits"))
    rows = g.join(f, "category", "full_outer").na.fill(0, ["gold", "gold_hits", "found", "found_hits"])
    return _with_rates(rows)


def _with_rates(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("precision", _ratio(F.col("found_hits"), F.col("found"))).withColumn("recall", _ratio(F.col("gold_hits"), F.col("gold")))
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def micro(report: DataFrame) -> DataFrame:
    """One row: sums of all categories and their rates."""
    return _with_rates(report.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("gold", "gold_hits", "found", "found_hits")]))


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def withheld_count(out: DataFrame, column: str = "redacted") -> DataFrame:
    return out.agg(F.count("*").alias("lines"), F.coalesce(F.sum((F.col(column) == WITHHELD).cast("long")), F.lit(0).cast("long")).alias("withheld"))


def samples(rows: DataFrame, k: int = 3) -> DataFrame:
    """The first k rows of each category in the order of lines."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("line_no", "ord"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def detections(out: DataFrame, vault: DataFrame) -> DataFrame:
    """(line_no, ord, category, value) of all placeholders in output lines that the vault knows."""
    seen = out.select("scope", "line_no", F.posexplode(placeholders(F.col("redacted"))).alias("ord", "token"))
    return seen.join(vault.select("scope", "token", "category", "value"), ["scope", "token"]).select("line_no", "ord", "category", "value")


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(tokens, agreeing, percent) of two label columns."""
    same = F.coalesce(F.sum((F.col(a) == F.col(b)).cast("long")), F.lit(0).cast("long"))
    rows = pairs.agg(F.count("*").alias("tokens"), same.alias("agreeing"))
    return rows.withColumn("percent", F.round(100.0 * _ratio(F.col("agreeing"), F.col("tokens")), 6))


def parity_passed(gate: str, tokens: int, agreeing: int, cosine: float) -> bool:
    """The quality gates fp32, quantised and prequantised."""
    flips = tokens - agreeing
    if gate == "fp32":
        return flips == 0 and cosine >= 0.9999995
    if gate == "quantised":
        return cosine >= 0.995 and flips <= max(2, math.ceil(0.01 * tokens))
    if gate == "prequantised":
        return flips == 0 and cosine >= 0.9999
    raise ValueError(f"no such gate: {gate}")


def difference(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Largest absolute and relative difference of two number columns."""
    return pairs.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs"), (F.max(F.abs(F.col(a) - F.col(b))) / (F.max(F.abs(F.col(a))) + F.lit(1e-9))).alias("relative"))


def histogram(rows: DataFrame, column: str = "category", top: int = 15) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)


def length_stats(rows: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(column)
    return rows.agg(F.min(n).cast("long").alias("shortest"), F.percentile(n, F.lit(0.5)).alias("median"), F.max(n).cast("long").alias("longest"))


def mean_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the mean of the rows' cosines, and the cosine of all rows taken as one vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col(a), F.col(b)
    whole = F.sum(dot(x, y)) / (F.sqrt(F.sum(dot(x, x))) * F.sqrt(F.sum(dot(y, y))) + 1e-9)
    return pairs.agg(F.avg(cosine(x, y)).alias("mean_cosine"), whole.alias("whole_cosine"))


def lines_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: line counts of both tables and whether they are equal."""
    a, b = before.agg(F.count("*").alias("lines_in")), after.agg(F.count("*").alias("lines_out"))
    return a.join(b, F.lit(True)).withColumn("conserved", F.col("lines_in") == F.col("lines_out"))
