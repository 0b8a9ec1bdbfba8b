"""Registered queries of the redaction engine, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import decode, evaluate, redaction, scorers
from ..operators.lines import to_lines, to_text
from ..operators.patterns import PATTERNS, WEAK, pattern_spans
from ..sources.frames import DecodeFrames
from ..sources.text import FINE_LABELS, coarse, coarse_spans, in_language

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WIDE = 1_000_000
LABELS = ["O"] + [f"{k}-{c}" for c in ("secret", "private_email") for k in "BIES"]
ALL_LABELS = ["O"] + [f"{k}-{c}" for c in ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret") for k in "BIES"]


def query(sql: str | None = None):
    """Registers a query under its name, with SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


# ---------------------------------------------------------------- SQL building blocks

DOC_ROWS = "SELECT doc_id AS scope, 0 AS line, text FROM documents"
DOC_LINES = "SELECT doc_id AS scope, k - 1 AS line, p[k] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) x, unnest(range(1, len(p) + 1)) AS u(k)"
STREAM_LINES = f"SELECT 0 AS scope, scope * {WIDE} + line AS line, text FROM ({DOC_LINES})"


def _matches(source: str, of: dict[str, str]) -> str:
    one = """
SELECT scope, line, {rank} * 1000000 + i AS ord, '{category}' AS cat, m[i] AS hit,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
FROM (SELECT scope, line, string_split_regex(text, '{regex}') AS p, regexp_extract_all(text, '{regex}') AS m FROM {source}), unnest(range(1, len(m) + 1)) AS u(i)"""
    parts = " UNION ALL ".join(one.format(rank=k, category=c, regex=r, source=source) for k, (c, r) in enumerate(of.items()))
    return f"SELECT scope, line, ord, cat, hit, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM ({parts})"


def _chain(rows: str, of: dict[str, str] = PATTERNS, p: str = "", where: str = "true") -> str:
    """CTEs t, sp, c, k, d, o: rows, spans, clamped spans, values, tokens, redacted rows (names after a prefix)."""
    return f"""
{p}t AS ({rows}),
{p}sp AS ({_matches(p + "t", of)}),
{p}v AS (SELECT scope, line, ord, s, greatest(s, 0) AS s1, least(e, length(text)) AS e1, cat, text FROM {p}sp JOIN {p}t USING (scope, line) WHERE greatest(s, 0) < least(e, length(text)) AND {where}),
{p}c AS (SELECT *, greatest(s1, coalesce(max(e1) OVER (PARTITION BY scope, line ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s2 FROM {p}v),
{p}k AS (SELECT scope, line, text, s2, e1, cat, substring(text, s2 + 1, e1 - s2) AS val FROM {p}c WHERE s2 < e1),
{p}f AS (SELECT scope, cat, val, min(line * 1000000000 + s2) AS first FROM {p}k GROUP BY ALL),
{p}d AS (SELECT *, row_number() OVER (PARTITION BY scope, cat ORDER BY first) AS n FROM {p}f),
{p}tk AS (SELECT scope, cat, val, n, '<' || upper(cat) || '_' || n || '>' AS token FROM {p}d),
{p}r AS (SELECT {p}k.*, token, coalesce(lag(e1) OVER (PARTITION BY scope, line ORDER BY s2), 0) AS pe FROM {p}k JOIN {p}tk USING (scope, cat, val)),
{p}g AS (SELECT scope, line, string_agg(substring(text, pe + 1, s2 - pe) || token, '' ORDER BY s2) AS body, max(e1) AS le FROM {p}r GROUP BY ALL),
{p}o AS (SELECT scope, line, text, coalesce(body || substring(text, le + 1), text) AS redacted FROM {p}t LEFT JOIN {p}g USING (scope, line))"""


def _lines(spark, sf_dir, of=None) -> DataFrame:
    return to_lines(_docs(spark, sf_dir), "doc_id").withColumn("spans", pattern_spans(F.col("text"), of))


def _stream(lines: DataFrame) -> DataFrame:
    """All documents as one scope, in the order of document and line."""
    return lines.withColumn("line_no", F.col("scope") * WIDE + F.col("line_no")).withColumn("scope", F.lit(0).cast("long"))


# ---------------------------------------------------------------- lines


@query(f"SELECT scope AS doc_id, line::BIGINT AS line_no, text FROM ({DOC_LINES})")
def lines_explode(spark, sf_dir):
    return to_lines(_docs(spark, sf_dir), "doc_id").select(F.col("scope").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "text")


@query("SELECT doc_id, text FROM documents")
def lines_roundtrip(spark, sf_dir):
    return to_text(to_lines(_docs(spark, sf_dir), "doc_id")).select(F.col("scope").alias("doc_id"), "text")


@query("SELECT doc_id, replace(regexp_replace(text, '\\n$', ''), chr(10), ' ') AS text FROM documents")
def lines_flattened(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.flat_lines(F.col("text")).alias("text"))


# ---------------------------------------------------------------- detection and spans


@query(f"WITH t AS ({DOC_LINES}), sp AS ({_matches('t', PATTERNS)}) SELECT scope AS doc_id, line::BIGINT AS line_no, s::BIGINT AS s, e::BIGINT AS e, cat AS category FROM sp")
def detect_spans(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(F.col("scope").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.explode("spans").alias("x"))
    return rows.select("doc_id", "line_no", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), F.col("x.category").alias("category"))


@query(f"WITH {_chain(DOC_LINES)} SELECT scope AS doc_id, line::BIGINT AS line_no, s2::BIGINT AS s, e1::BIGINT AS e, cat AS category, val AS value FROM k")
def span_clamp(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("found", redaction.clamp(F.col("text"), F.col("spans")))
    rows = lines.select(F.col("scope").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.explode("found").alias("x"))
    return rows.select("doc_id", "line_no", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), "x.category", "x.value")


_TOKENS = """
w AS (SELECT doc_id, string_split(text, ' ') AS p FROM documents),
tok AS (
  SELECT doc_id, i AS ord, list_sum(list_transform(p[1:i], lambda x: length(x))) + i - 1 - length(p[i]) AS s, length(p[i]) AS n,
    CASE WHEN length(p[i]) = 0 THEN 'O' WHEN length(p[i]) % 5 = 0 THEN 'B-long' WHEN length(p[i]) % 5 = 1 THEN 'I-long' WHEN length(p[i]) % 5 = 2 THEN 'S-other' ELSE 'O' END AS label
  FROM w, unnest(range(1, len(p) + 1)) AS u(i)
)"""


def _islands(gap: int) -> str:
    return f"""
WITH {_TOKENS},
a AS (SELECT doc_id, ord, s, s + n AS e, substr(label, 3) AS cat FROM tok WHERE label <> 'O'),
b AS (SELECT *, CASE WHEN lag(cat) OVER q = cat AND s <= lag(e) OVER q + {gap} THEN 0 ELSE 1 END AS brk FROM a WINDOW q AS (PARTITION BY doc_id ORDER BY ord)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY ord) AS isl FROM b)
SELECT doc_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e, any_value(cat) AS category FROM i GROUP BY doc_id, isl
"""


def _word_tokens(spark, sf_dir) -> DataFrame:
    """Blank-separated words of the documents as tokens, labelled by their length."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("ord", "word"))
    n = F.length("word")
    e = F.sum(n + 1).over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    label = F.when(n == 0, "O").when(n % 5 == 0, "B-long").when(n % 5 == 1, "I-long").when(n % 5 == 2, "S-other").otherwise("O")
    return rows.select("doc_id", "ord", (e - n).alias("s"), e.alias("e"), label.alias("label"))


@query(_islands(1))
def span_gap_merge(spark, sf_dir):
    return decode.merge_tokens(_word_tokens(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "category")


@query(_islands(3))
def span_gap_merge_wide(spark, sf_dir):
    return decode.merge_tokens(_word_tokens(spark, sf_dir), ["doc_id"], 3).select("doc_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "category")


# ---------------------------------------------------------------- redaction


@query(f"WITH {_chain(DOC_ROWS)} SELECT scope AS doc_id, redacted FROM o")
def redact_documents(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("spans", pattern_spans(F.col("text")))
    return redaction.redact_rows(rows).select("doc_id", "redacted")


@query(f"WITH {_chain('SELECT page_id AS scope, 0 AS line, html AS text FROM pages')} SELECT scope AS page_id, redacted FROM o")
def redact_pages(spark, sf_dir):
    rows = _read(spark, sf_dir, "pages").select("page_id", "html").withColumn("spans", pattern_spans(F.col("html")))
    return redaction.redact_rows(rows, text="html").select("page_id", "redacted")


@query(f"WITH {_chain('SELECT conv_id AS scope, turn AS line, text FROM conversations')} SELECT scope AS conv_id, line AS turn, redacted FROM o")
def redact_conversations(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("line_no"), "text")
    out, _ = redaction.redact_lines(rows.withColumn("spans", pattern_spans(F.col("text"))))
    return out.select(F.col("scope").alias("conv_id"), F.col("line_no").alias("turn"), "redacted")


@query(f"WITH {_chain(STREAM_LINES)} SELECT line AS line_no, redacted FROM o")
def redact_stream_scope(spark, sf_dir):
    out, _ = redaction.redact_lines(_stream(_lines(spark, sf_dir)), wide=False)
    return out.select("line_no", "redacted")


@query(f"WITH {_chain(DOC_ROWS, where="cat IN ('private_email', 'secret')")} SELECT scope AS doc_id, redacted FROM o")
def redact_only(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("spans", pattern_spans(F.col("text")))
    return redaction.redact_rows(rows, only=["private_email", "secret"], skip=["secret"]).select("doc_id", "redacted")


@query(f"WITH {_chain(DOC_ROWS, where="cat NOT IN ('secret')")} SELECT scope AS doc_id, redacted FROM o")
def redact_except(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumn("spans", pattern_spans(F.col("text")))
    return redaction.redact_rows(rows, skip=["secret"]).select("doc_id", "redacted")


@query(f"WITH {_chain(DOC_LINES)} SELECT scope AS doc_id, cat AS category, val AS value, n::BIGINT AS n, token FROM tk")
def stable_tokens_doc(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("found", redaction.clamp(F.col("text"), F.col("spans")))
    return redaction.vault_of_lines(lines).select(F.col("scope").alias("doc_id"), "category", "value", F.col("n").cast("long").alias("n"), "token")


@query(f"WITH {_chain(STREAM_LINES)} SELECT cat AS category, val AS value, n::BIGINT AS n, token FROM tk")
def stable_tokens_stream(spark, sf_dir):
    lines = _stream(_lines(spark, sf_dir)).withColumn("found", redaction.clamp(F.col("text"), F.col("spans")))
    return redaction.vault_of_lines(lines).select("category", "value", F.col("n").cast("long").alias("n"), "token")


@query(f"WITH {_chain(DOC_ROWS)} SELECT scope AS doc_id, cat AS category, val AS value, token FROM tk")
def vault(spark, sf_dir):
    rows = redaction.redact_rows(_docs(spark, sf_dir).withColumn("spans", pattern_spans(F.col("text"))))
    return redaction.vault_of_rows(rows, "doc_id").withColumnRenamed("scope", "doc_id")


_ODD_ROWS = """
SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 3 END AS scope, doc_id * 3 AS line, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text FROM documents
UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 3 END, doc_id * 3 + 1, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 3 END, doc_id * 3 + 2, 'nothing to hide' FROM documents WHERE doc_id % 5 = 1"""


def _odd_lines(spark, sf_dir) -> DataFrame:
    """Every document as a line, with null scopes, null texts, repeated lines and other lines of the same number."""
    n = F.col("doc_id")
    lines = _docs(spark, sf_dir).select(F.when(n % 3 != 0, n % 3).alias("scope"), n.alias("line_no"), F.when(n % 7 != 0, F.col("text")).alias("text"))
    again, other = lines.where("line_no % 5 = 0"), lines.where("line_no % 5 = 1").withColumn("text", F.lit("nothing to hide"))
    return lines.unionAll(again).unionAll(other)


@query(f"WITH {_chain(_ODD_ROWS)} SELECT nullif(scope, -1)::VARCHAR AS scope, line // 3 AS line_no, redacted FROM o")
def redact_odd_lines(spark, sf_dir):
    out, _ = redaction.redact(_odd_lines(spark, sf_dir))
    return out.select(F.col("scope").cast("string").alias("scope"), "line_no", "redacted")


@query(f"WITH {_chain(_ODD_ROWS)} SELECT nullif(scope, -1)::VARCHAR AS scope, cat AS category, val AS value, n::BIGINT AS n FROM tk")
def vault_wide(spark, sf_dir):
    """The vault of scopes over many rows, numbered by range partitions."""
    _, vault = redaction.redact_lines(_odd_lines(spark, sf_dir).withColumn("spans", pattern_spans(F.col("text"))), wide=True)
    return vault.select(F.col("scope").cast("string").alias("scope"), "category", "value", F.col("n").cast("long").alias("n"))


#: the scorer of the two queries below: words with an at sign are addresses, lines over 2,000 characters fail
_SCORER = scorers.MarkScorer({"@": "private_email"}, 2000)
_AT_WORDS = {"private_email": "[^ ]*@[^ ]*(?: [^ ]*@[^ ]*)*"}


@query(f"WITH {_chain(DOC_LINES, _AT_WORDS, where='length(text) <= 2000')} SELECT scope AS doc_id, line::BIGINT AS line_no, CASE WHEN length(text) <= 2000 THEN redacted ELSE '{C.WITHHELD}' END AS redacted FROM o")
def redact_scored(spark, sf_dir):
    """Scorer, decoder, merging, numbering and withholding in one; the scorer fails on long lines."""
    out, _ = redaction.redact(to_lines(_docs(spark, sf_dir), "doc_id"), _SCORER, decoder="argmax")
    return out.select(F.col("scope").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "redacted")


@query(f"WITH l AS ({DOC_LINES}) SELECT count(*) AS lines, sum(CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END)::BIGINT AS withheld FROM l")
def withheld_scored(spark, sf_dir):
    return evaluate.withheld_count(redact_scored(spark, sf_dir))


@query(f"WITH {_chain(DOC_LINES)} SELECT scope AS doc_id, line::BIGINT AS line_no, CASE WHEN length(text) <= 2000 THEN redacted ELSE '{C.WITHHELD}' END AS redacted FROM o")
def withheld_lines(spark, sf_dir):
    out, _ = redaction.redact_lines(_lines(spark, sf_dir))
    line = redaction.withhold(F.length("text") <= 2000, F.col("redacted"), F.col("text"))
    return out.select(F.col("scope").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), line.alias("redacted"))


@query(f"WITH {_chain(DOC_LINES)} SELECT count(*) AS lines, sum(CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END)::BIGINT AS withheld FROM o")
def withheld_count(spark, sf_dir):
    return evaluate.withheld_count(withheld_lines(spark, sf_dir))


@query(f"""WITH {_chain(DOC_ROWS)},
x AS (SELECT scope, unnest(regexp_extract_all(redacted, '<([A-Z][A-Z0-9_]*?)_([0-9]+)>')) AS token FROM o)
SELECT scope AS doc_id, token, cat AS category, val AS value, count(*) AS n FROM x JOIN tk USING (scope, token) GROUP BY ALL""")
def placeholder_extract(spark, sf_dir):
    rows = redaction.redact_rows(_docs(spark, sf_dir).withColumn("spans", pattern_spans(F.col("text"))))
    out = rows.select(F.col("doc_id").alias("scope"), F.lit(0).alias("line_no"), "redacted")
    seen = out.select("scope", F.explode(C.placeholders(F.col("redacted"))).alias("token"))
    known = seen.join(redaction.vault_of_rows(rows, "doc_id"), ["scope", "token"])
    return known.groupBy(F.col("scope").alias("doc_id"), "token", "category", "value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- labels and decoding

_LABEL_VALUES = ", ".join(f"('{x}')" for x in [*ALL_LABELS, "X-foo", "-x", "B-", "BB-x", "B-a-b", ""])


def _label_rows(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in [*ALL_LABELS, "X-foo", "-x", "B-", "BB-x", "B-a-b", ""]], "label string")


@query(f"SELECT label, CASE WHEN regexp_matches(label, '^[^-]-.') THEN substr(label, 3) ELSE label END AS category FROM (VALUES {_LABEL_VALUES}) t(label)")
def label_category(spark, sf_dir):
    return _label_rows(spark).select("label", C.entity_type(F.col("label")).alias("category"))


@query(f"SELECT label, CASE WHEN regexp_matches(label, '^[BIES]-.') THEN label[1] ELSE 'O' END AS kind FROM (VALUES {_LABEL_VALUES}) t(label)")
def label_kind(spark, sf_dir):
    return _label_rows(spark).select("label", C.label_kind(F.col("label")).alias("kind"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def argmax_decode(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", C.argmax(F.col("embedding")).cast("long").alias("best"))


_NEVER = -1e30


def _viterbi_sql() -> str:
    """The decoder unrolled: one column for each label's best score and path, one CTE for each of 8 tokens.

    A vector of 64 scores is 7 tokens of 9 labels and one more whose other labels are out of question.
    """
    kind, of = [x[0] for x in LABELS], [x[2:] for x in LABELS]
    n, steps = len(LABELS), []
    start = ", ".join(f"(CASE WHEN {kind[c] in 'OBS'} THEN embedding[{c + 1}] END)::FLOAT AS b{c}, '{LABELS[c]}' AS p{c}" for c in range(n))
    steps.append(f"e AS (SELECT vec_id, list_concat(embedding, list_transform(range(1, {n}), lambda i: ({_NEVER})::FLOAT)) AS embedding FROM embeddings)")
    steps.append(f"s0 AS (SELECT vec_id, embedding, {start} FROM e)")
    for t in range(1, 8):
        columns = []
        for c in range(n):
            before = [p for p in range(n) if (kind[p] in "OES" and kind[c] in "OBS") or (kind[p] in "BI" and kind[c] in "IE" and of[p] == of[c])]
            top = f"greatest({', '.join(f'b{p}' for p in before)})"
            path = "CASE " + " ".join(f"WHEN b{p} = {top} THEN p{p}" for p in before) + " END"
            columns.append(f"({top} + embedding[{t * n + c + 1}])::FLOAT AS b{c}, {path} || ' {LABELS[c]}' AS p{c}")
        steps.append(f"s{t} AS (SELECT vec_id, embedding, {', '.join(columns)} FROM s{t - 1})")
    ends = [c for c in range(n) if kind[c] in "OES"]
    top = f"greatest({', '.join(f'b{c}' for c in ends)})"
    return f"WITH {', '.join(steps)} SELECT vec_id, CASE {' '.join(f'WHEN b{c} = {top} THEN p{c}' for c in ends)} END AS labels FROM s7"


@query(_viterbi_sql())
def viterbi_decode(spark, sf_dir):
    """Whole vectors as scores of 9 labels a token; what is missing of the last token's scores is out of question."""
    n, size = len(LABELS), F.size("embedding")
    rest = F.array_repeat(F.lit(_NEVER).cast("float"), ((n - size % n) % n).cast("int"))
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", F.concat("embedding", rest).alias("scores"))
    return rows.select("vec_id", F.array_join(decode.decode_udf(LABELS)(F.col("scores")), " ").alias("labels"))


_PAIR = "(SELECT a.vec_id, a.embedding AS x, b.embedding AS y, a.label AS la, b.label AS lb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _neighbours(spark, sf_dir) -> DataFrame:
    a = _read(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("lb"))
    return a.select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("la")).join(b, "vec_id")


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i]::DOUBLE * y[i]::DOUBLE)) /
  (sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(y, lambda v: v::DOUBLE * v::DOUBLE))) + 1e-9), 6) AS cosine FROM {_PAIR}""")
def cosine_parity(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("vec_id", F.round(C.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


def _dots(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(f"""SELECT round(avg(xy / (sqrt(xx) * sqrt(yy) + 1e-9)), 6) AS mean_cosine, round(sum(xy) / (sqrt(sum(xx)) * sqrt(sum(yy)) + 1e-9), 6) AS whole_cosine
  FROM (SELECT {_dots("x", "y")} AS xy, {_dots("x", "x")} AS xx, {_dots("y", "y")} AS yy FROM {_PAIR})""")
def cosine_of_all(spark, sf_dir):
    rows = evaluate.mean_cosine(_neighbours(spark, sf_dir), "x", "y")
    return rows.select(F.round("mean_cosine", 6).alias("mean_cosine"), F.round("whole_cosine", 6).alias("whole_cosine"))


@query(f"SELECT count(*) AS tokens, sum((la = lb)::INT)::BIGINT AS agreeing, round(100.0 * sum((la = lb)::INT) / count(*), 6)::DOUBLE AS percent FROM {_PAIR}")
def argmax_agreement(spark, sf_dir):
    return evaluate.agreement(_neighbours(spark, sf_dir), "la", "lb")


@query(f"""SELECT max(d) AS max_abs, round(max(d) / (max(m) + 1e-9), 6) AS relative FROM (
  SELECT list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))) AS d, list_max(list_transform(x, lambda v: abs(v))) AS m
  FROM (SELECT x::DOUBLE[] AS x, y::DOUBLE[] AS y FROM {_PAIR}))""")
def score_difference(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).select(F.explode(F.arrays_zip("x", "y")).alias("p")).select(F.col("p.x").cast("double").alias("a"), F.col("p.y").cast("double").alias("b"))
    return evaluate.difference(pairs, "a", "b").select("max_abs", F.round("relative", 6).alias("relative"))


# ---------------------------------------------------------------- evaluation

_GOLD = f"gold AS (SELECT scope * {WIDE} + line AS line_no, row_number() OVER (PARTITION BY scope, line ORDER BY s2) - 1 AS ord, cat AS category, val AS value FROM k)"
_FOUND = f"""found AS (
  SELECT line_no, i - 1 AS ord, cat AS category, val AS value
  FROM (SELECT scope, line_no, i, m[i] AS token FROM (SELECT scope, scope * {WIDE} + line AS line_no, regexp_extract_all(redacted, '<([A-Z][A-Z0-9_]*?)_([0-9]+)>') AS m FROM wo) y, unnest(range(1, len(m) + 1)) AS u(i)) z
  JOIN wtk USING (scope, token)
)"""
_BOTH = f"WITH {_chain(DOC_LINES)}, {_chain(DOC_LINES, WEAK, 'w')}, {_GOLD}, {_FOUND}"
_HITS = """
gh AS (SELECT g.*, EXISTS (SELECT 1 FROM found f WHERE f.line_no = g.line_no AND f.category = g.category AND (contains(lower(trim(f.value)), lower(trim(g.value))) OR contains(lower(trim(g.value)), lower(trim(f.value))))) AS hit FROM gold g),
fh AS (SELECT f.*, EXISTS (SELECT 1 FROM gold g WHERE f.line_no = g.line_no AND f.category = g.category AND (contains(lower(trim(f.value)), lower(trim(g.value))) OR contains(lower(trim(g.value)), lower(trim(f.value))))) AS hit FROM found f),
ga AS (SELECT category, count(*) AS gold, sum(hit::INT)::BIGINT AS gold_hits FROM gh GROUP BY 1),
fa AS (SELECT category, count(*) AS found, sum(hit::INT)::BIGINT AS found_hits FROM fh GROUP BY 1),
ra AS (SELECT coalesce(ga.category, fa.category) AS category, coalesce(gold, 0) AS gold, coalesce(gold_hits, 0) AS gold_hits, coalesce(found, 0) AS found, coalesce(found_hits, 0) AS found_hits FROM ga FULL JOIN fa USING (category))"""


def _rates(x: str) -> str:
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM
  (SELECT *, CASE WHEN found > 0 THEN found_hits / found ELSE 0 END::DOUBLE AS precision, CASE WHEN gold > 0 THEN gold_hits / gold ELSE 0 END::DOUBLE AS recall FROM {x}))"""


def _evaluation(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold values, redacted lines, detections): the full patterns against what the weaker ones redact."""
    lines = _lines(spark, sf_dir)
    found = lines.withColumn("found", redaction.clamp(F.col("text"), F.col("spans")))
    gold = found.select((F.col("scope") * WIDE + F.col("line_no")).alias("line_no"), F.posexplode("found").alias("ord", "f")).select("line_no", "ord", "f.category", "f.value")
    out, tokens = redaction.redact_lines(_lines(spark, sf_dir, WEAK))
    out = out.withColumn("line_no", F.col("scope") * WIDE + F.col("line_no"))
    return gold, out, evaluate.detections(out, tokens)


@query(f"""{_BOTH},
lk AS (SELECT category, contains(redacted, value) AS leaked FROM gold JOIN (SELECT scope * {WIDE} + line AS line_no, redacted FROM wo) USING (line_no))
SELECT coalesce(category, 'overall') AS category, count(*) AS total, sum(leaked::INT)::BIGINT AS leaked, round(100.0 * sum(leaked::INT) / count(*), 6)::DOUBLE AS rate,
  round(100.0 * sum(leaked::INT) / count(*), 6) <= 3.0 AS passed FROM lk GROUP BY ROLLUP (category)""")
def leak_rate(spark, sf_dir):
    gold, out, _ = _evaluation(spark, sf_dir)
    return evaluate.leak_rate(evaluate.leaks(gold, out))


@query(f"{_BOTH}, {_HITS} SELECT category, gold, gold_hits, found, found_hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_rates('ra')}")
def prf(spark, sf_dir):
    gold, _, found = _evaluation(spark, sf_dir)
    return _rounded(evaluate.precision_recall(gold, found))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"{_BOTH}, {_HITS}, ma AS (SELECT sum(gold)::BIGINT AS gold, sum(gold_hits)::BIGINT AS gold_hits, sum(found)::BIGINT AS found, sum(found_hits)::BIGINT AS found_hits FROM ra) SELECT gold, gold_hits, found, found_hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {_rates('ma')}")
def prf_micro(spark, sf_dir):
    gold, _, found = _evaluation(spark, sf_dir)
    return _rounded(evaluate.micro(evaluate.precision_recall(gold, found)))


@query(f"{_BOTH}, {_HITS} SELECT round(avg(f1), 6) AS macro_f1 FROM {_rates('ra')}")
def macro_f1(spark, sf_dir):
    gold, _, found = _evaluation(spark, sf_dir)
    return evaluate.macro_f1(evaluate.precision_recall(gold, found)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"{_BOTH}, {_HITS} SELECT category, line_no, ord::BIGINT AS ord, value, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY line_no, ord) AS place FROM gh WHERE NOT hit) WHERE place <= 3")
def sample_misses(spark, sf_dir):
    gold, _, found = _evaluation(spark, sf_dir)
    missed = evaluate.samples(evaluate.matched(gold, found).where("NOT hit"))
    return missed.select("category", "line_no", F.col("ord").cast("long").alias("ord"), "value", F.col("place").cast("long").alias("place"))


@query(f"WITH {_chain(DOC_LINES)} SELECT cat AS category, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, category LIMIT 15")
def category_histogram(spark, sf_dir):
    lines = _lines(spark, sf_dir).select(F.explode(redaction.clamp(F.col("text"), F.col("spans"))).alias("f"))
    return evaluate.histogram(lines.select("f.category"))


@query("SELECT min(length(text))::BIGINT AS shortest, quantile_cont(length(text), 0.5)::DOUBLE AS median, max(length(text))::BIGINT AS longest FROM documents")
def length_stats(spark, sf_dir):
    return evaluate.length_stats(_docs(spark, sf_dir))


@query(f"WITH {_chain(_ODD_ROWS)}, i AS (SELECT count(*) AS lines_in FROM t), u AS (SELECT count(*) AS lines_out FROM o) SELECT lines_in, lines_out, lines_in = lines_out AS conserved FROM i, u")
def lines_conserved(spark, sf_dir):
    lines = _odd_lines(spark, sf_dir)
    out, _ = redaction.redact(lines)
    return evaluate.lines_conserved(lines, out)


@query(f"WITH {_chain(DOC_LINES)} SELECT toxic::BIGINT AS toxic, cat AS category, count(*) AS n FROM k JOIN labels ON doc_id = scope GROUP BY ALL")
def categories_by_label(spark, sf_dir):
    spans = _lines(spark, sf_dir).select("scope", F.explode(redaction.clamp(F.col("text"), F.col("spans"))).alias("f"))
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("scope"), F.col("toxic").cast("long").alias("toxic"))
    return spans.join(labels, "scope").groupBy("toxic", "f.category").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sources and control


@query("SELECT doc_id, text FROM documents WHERE lower(lang) = 'fr' ORDER BY doc_id LIMIT 20")
def lang_filter_limit(spark, sf_dir):
    return in_language(_read(spark, sf_dir, "documents"), "fr", 20).select("doc_id", "text")


_MASKS = [
    (0, [("FIRSTNAME", 3, 7), ("LastName", 8, 14), ("CITY", 15, 20), ("EMAIL", 30, 41)]),
    (1, [("DOB", 12, 20), ("DATE", 0, 9), ("IP", 25, 30), ("URL", 34, 40)]),
    (2, [("PASSWORD", 5, 9), ("PASSWORD", 6, 20), ("PASSWORD", 23, 24)]),
    (3, [("STATE", 0, 4)]),
]
_MASK_VALUES = ", ".join(f"({i}, '{lab}', {s}, {e})" for i, m in _MASKS for lab, s, e in m)
_FINE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in FINE_LABELS.items())


@query(f"""WITH m AS (SELECT id, s, e, category FROM (VALUES {_MASK_VALUES}) t(id, label, s, e) JOIN (VALUES {_FINE_VALUES}) f(fine, category) ON upper(label) = fine),
b AS (SELECT *, CASE WHEN lag(category) OVER w = category AND s <= max(e) OVER (PARTITION BY id, category ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS brk FROM m WINDOW w AS (PARTITION BY id ORDER BY s, e, category)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY id ORDER BY s, e, category) AS isl FROM b)
SELECT id::BIGINT AS id, min(s)::BIGINT AS s, max(e)::BIGINT AS e, any_value(category) AS category FROM i GROUP BY id, isl""")
def label_map_merge(spark, sf_dir):
    rows = spark.createDataFrame(_MASKS, "id long, mask array<struct<label:string,start:int,end:int>>")
    rows = rows.select("id", F.explode(coarse_spans(F.col("mask"))).alias("x"))
    return rows.select("id", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), "x.category")


@query(f"SELECT label, category, count(*) AS n FROM (VALUES {_MASK_VALUES}) t(id, label, s, e) LEFT JOIN (VALUES {_FINE_VALUES}) f(fine, category) ON upper(label) = fine GROUP BY ALL")
def label_map_histogram(spark, sf_dir):
    rows = spark.createDataFrame(_MASKS, "id long, mask array<struct<label:string,start:int,end:int>>").select(F.explode("mask").alias("m"))
    return rows.groupBy(F.col("m.label").alias("label"), coarse(F.col("m.label")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 0::BIGINT AS seq, 0::BIGINT AS status, octet_length(encode(text))::BIGINT + 4 AS n_bytes, text FROM documents")
def frame_roundtrip(spark, sf_dir):
    frames = _docs(spark, sf_dir).select("doc_id", C.frame_request(F.col("text")).alias("frame"))
    spark.udtf.register("decode_frames", DecodeFrames)
    frames.createOrReplaceTempView("veilspark_frames")
    rows = spark.sql("SELECT doc_id, f.seq, f.status, octet_length(frame) AS n_bytes, f.text FROM veilspark_frames, LATERAL decode_frames(frame, false, 16777216) AS f")
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("status").cast("long").alias("status"), F.col("n_bytes").cast("long").alias("n_bytes"), "text")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS length, octet_length(encode(text)) <= 4096 AS fits, octet_length(encode(text))::BIGINT + 5 AS n_bytes FROM documents")
def frame_guard(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", C.frame_response(F.lit(0), F.col("text")).alias("frame"))
    length = C.read_length(F.col("frame"), 1)
    return rows.select("doc_id", length.alias("length"), (length <= 4096).alias("fits"), F.octet_length("frame").cast("long").alias("n_bytes"))


@query("SELECT responsive, force, CASE WHEN NOT responsive THEN 'reclaim' WHEN force THEN 'displace' ELSE 'alreadyRunning' END AS decision FROM (VALUES (true, true), (true, false), (false, true), (false, false)) t(responsive, force)")
def start_decision(spark, sf_dir):
    rows = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "responsive boolean, force boolean")
    return rows.select("responsive", "force", C.start_decision(F.col("responsive"), F.col("force")).alias("decision"))


@query("SELECT i AS id, greatest(0, least(i, 199)) AS clamped FROM (SELECT unnest([-5, 0, 7, 199, 200, 100000])::BIGINT AS i)")
def id_clamp(spark, sf_dir):
    rows = spark.createDataFrame([(i,) for i in (-5, 0, 7, 199, 200, 100000)], "id long")
    return rows.select("id", C.clamp_id(F.col("id"), 200).cast("long").alias("clamped"))


@query(f"SELECT scope AS doc_id, line::BIGINT AS line_no, (length(text) - length(replace(text, ' ', '')) + (length(text) > 0)::INT)::BIGINT AS tokens, length(text) <= 2000 AS ok FROM ({DOC_LINES})")
def empty_line_bypass(spark, sf_dir):
    """Scored lines and their token counts; empty lines have no tokens and are fine."""
    lines = scorers.score_lines(to_lines(_docs(spark, sf_dir), "doc_id"), _SCORER, decoder="argmax")
    tokens = F.when(F.col("scored.ok"), F.size("scored.tokens")).otherwise(F.size(F.split("text", " ", -1)))
    return lines.select(F.col("scope").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), tokens.cast("long").alias("tokens"), F.col("scored.ok").alias("ok"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
