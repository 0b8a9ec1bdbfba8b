"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source with mass m (characters) and target share w of an output of B characters is repeated at
the mean rate w * B / m.  Each document draws its number of copies from the Poisson distribution of
that mean by inverting it at a uniform number hashed from the seed and the document's id, so a rerun
or a retried task draws the same.  Copies are exploded and dealt out by a hash of seed, id and copy
number, sorted inside each partition: a seeded permutation of the whole output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages

#: so many sources at most are broadcast with their rates (about 30 MB); more are joined on salted keys
RATES_TO_SEND = 100_000
SALTS = 64
#: a table of more entries is searched by halves
LONG_TABLE = 64
UNIFORM_DIGITS = 12


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) hashed from the seed and the parts (null counts as an empty string)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, UNIFORM_DIGITS), 16, 10).cast("long") / F.lit(float(16**UNIFORM_DIGITS))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where the rest is below the resolution of the uniform numbers.

    Terms are kept as logarithms, so large rates underflow to 0 and not to an error.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums"))

    def step(s, k):
        log = s["log"] + F.log(rate / k)
        return F.struct(log.alias("log"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + F.exp(log))).alias("sums"))

    sums = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["sums"])
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None, budget: float, source_col: str, text_col: str) -> DataFrame:
    """(mix_source, rate) of every source; weights None gives all sources the same share."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    mass = docs.groupBy(source.alias("mix_source")).agg(F.sum(F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("double").alias("mass"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [F.lit(x) for k, w in sorted(weights.items()) for x in (k, float(w))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("mix_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    weighed = Stages(docs.sparkSession, "mixing").write(mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(0.0)), "mass")
    total = weighed.agg(F.sum("mass"), F.sum("weight")).first()
    all_mass, all_weight = float(total[0] or 0), float(total[1] or 0)
    rate = F.when((F.col("mass") > 0) & F.lit(all_weight > 0), F.col("weight") / F.lit(all_weight or 1.0) * F.lit(all_mass * budget) / F.col("mass")).otherwise(0.0)
    return weighed.select("mix_source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Copies of the rows of docs, all columns as they were, plus ``mix_copy`` (from 1) and ``mix_key``.

    ``weights`` are target shares of characters by source (normalised; sources that are not named
    get none; None: equal shares); ``budget`` is the output's expected size over the input's.  A
    null source counts as the source ``''``; sources whose texts are all null or empty have no mass
    and are left out; an empty text in any other source is drawn like the rest.  Rows of equal id
    are drawn alike, null ids as one id; texts of any length are copied whole.  An empty table gives
    an empty result.  Columns of docs named mix_copy or mix_key are replaced.
    """
    docs = docs.drop("mix_copy", "mix_key")
    columns = [f"c{k}" for k in range(len(docs.columns))]
    id_col, source_col, text_col = (columns[docs.columns.index(c)] for c in (id_col, source_col, text_col))
    names, docs = docs.columns, docs.toDF(*columns)
    rate = rates(docs, weights, budget, source_col, text_col)
    table = rate.select("mix_source", poisson_table(F.col("rate")).alias("mix_table"))
    rows = docs.withColumn("mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    if rate.limit(RATES_TO_SEND + 1).count() <= RATES_TO_SEND:
        rows = rows.join(F.broadcast(table), "mix_source")
    else:
        rows = rows.withColumn("mix_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        rows = rows.join(table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["mix_source", "mix_salt"])
    u = uniform(seed, F.col(id_col))
    rows = rows.withColumn("mix_u", u).withColumn("mix_n", _below(F.col("mix_table"), F.col("mix_u"))).where("mix_n > 0")
    # Rows of one id, null above all, may be a third of all rows: their place in the table deals them out as well.
    rows = rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("mix_copy"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("mix_salt"))
    rows = rows.withColumn("mix_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col("mix_copy")))
    rows = rows.repartition("mix_key", "mix_salt").sortWithinPartitions("mix_key", "mix_salt")
    return rows.drop("mix_salt").toDF(*names, "mix_copy", "mix_key")


def _below(table: Column, u: Column) -> Column:
    """How many entries of a sorted array are u or less; a long array is searched by halves."""

    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.element_at(table, mid + 1) <= u
        step = F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))
        return F.when(s["lo"] < s["hi"], step).otherwise(s)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(table) + F.lit(1.0))).cast("int") + 1)
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi")), halve, lambda s: s["lo"])
    return F.when(F.size(table) > LONG_TABLE, found).otherwise(F.size(F.filter(table, lambda c: c <= u)))
