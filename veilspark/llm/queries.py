"""Registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, near_dup, pii, quality, token_counts, toxicity, transport, url_filter
from .common import held_out, keyed_text, table

# Fixed values of the URL query.
HOST_RULES = [
    url_filter.HostRule("block", "com", "/en/"),
    url_filter.HostRule("allow", "example.com", "/en/7"),
    url_filter.HostRule("allow", "net", "/de/"),
    url_filter.HostRule("block", "example.net", "/de/8"),
    url_filter.HostRule("block", "org", "/es/"),
]
PATTERNS = [
    url_filter.Pattern("block", r"[?&]utm_(?:source|medium|campaign)="),
    url_filter.Pattern("block", r"/(?:wp-login|xmlrpc)[.]php"),
    url_filter.Pattern("block", r"[?&]page=[0-9]+&ref="),
    url_filter.Pattern("block", r"://m[.][a-z]+[.]example[.]org/"),
    url_filter.Pattern("block", r"[.](?:exe|zip|apk)(?:[?#]|$)"),
]
SEED, BUDGET = 17, 1.0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.train(keyed_text(docs), labels))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(keyed_text(docs), labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.digest(transport.to_streams(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), HOST_RULES, PATTERNS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    nodes, leaves = chat.format_conversations(rows.unionByName(more))
    return chat.digest(chat.read_back(nodes, leaves))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), None, BUDGET, SEED).drop("mix_key")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_quality, op3_pii, op4_token_counts, op5_transport_streams, op6_near_duplicates, op7_decontaminate, op8_url_filter, op9_chat_tree, op10_mix_sources, pipeline]
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
), c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP7 = f"""
WITH i AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
),
d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
),
m AS (SELECT dw.doc_id, dw.n, dw.k, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _op8() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    )
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)
    patterns = " ".join(f"WHEN regexp_matches(coalesce(url, ''), '{p.regex}') THEN '{p.verdict}'" for p in PATTERNS)
    return f"""
WITH u AS (
  SELECT page_id, url, {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (SELECT *, CASE {fits} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE {verdicts} {patterns} ELSE 'allow' END AS verdict FROM r
"""


def _escaped(x: str) -> str:
    return rf"regexp_replace(replace({x}, '\', '\\'), '{chat.CONTROL}', '\1\3\\\2\4', 'g')"


_OP9 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP10 = f"""
WITH m AS (SELECT coalesce(source, '') AS s, sum(length(coalesce(text, '')))::DOUBLE AS mass FROM documents GROUP BY 1),
r AS (
  SELECT s, CASE WHEN mass > 0 THEN 1.0 / (SELECT count(*) FROM m WHERE mass > 0) * ((SELECT sum(mass) FROM m) * {BUDGET}) / mass ELSE 0 END AS rate FROM m
),
t AS (
  SELECT s, sum(p) OVER (PARTITION BY s ORDER BY k) AS c
  FROM (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT s, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 24))::BIGINT + 1)) AS k FROM r WHERE rate > 0))
),
d AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents),
n AS (SELECT d.*, (SELECT count(*) FROM t WHERE t.s = coalesce(d.source, '') AND t.c <= d.u) AS copies FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INTEGER AS mix_copy FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_near_duplicates": _OP6,
        "op7_decontaminate": _OP7,
        "op8_url_filter": _op8(),
        "op9_chat_tree": _OP9,
        "op10_mix_sources": _OP10,
    }
