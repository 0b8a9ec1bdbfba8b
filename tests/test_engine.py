"""The redaction engine: unit expectations, goldens, streams against batch, SQL against Spark."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import columns as C
from veilspark.operators import decode, evaluate, model, redaction, scorers
from veilspark.operators.patterns import pattern_spans
from veilspark.plans import queries as plans
from veilspark.sources import corpus, frames, hub, text

TOY = ["O"] + [f"{k}-{c}" for c in ("secret", "email") for k in "BIES"]


def redact(spark, rows, **options):
    """Outputs of lines (text, [(s, e, category)]) that share one scope."""
    table = spark.createDataFrame([(0, k, t, s) for k, (t, s) in enumerate(rows)], "scope long, line_no long, text string, spans array<struct<s:int,e:int,category:string>>")
    out, vault = redaction.redact_lines(table, **options)
    return [r.redacted for r in out.orderBy("line_no").collect()], {r.token: r.value for r in vault.collect()}


@pytest.mark.parametrize(
    "line, spans, expected",
    [
        ("hi john@x.com", [(3, 13, "private_email")], "hi <PRIVATE_EMAIL_1>"),
        ("café x@y.io", [(5, 11, "private_email")], "café <PRIVATE_EMAIL_1>"),
        ("ableakzoneXX", [(2, 6, "secret"), (4, 9, "secret")], "ab<SECRET_1><SECRET_2>eXX"),
        ("abcdef", [(2, 99, "secret")], "ab<SECRET_1>"),
        ("abcxyz", [(-3, 3, "secret")], "<SECRET_1>xyz"),
        ("abxcd", [(3, 5, "secret"), (0, 2, "secret")], "<SECRET_1>x<SECRET_2>"),
        ("a\tb\nc", [(2, 3, "secret")], "a\t<SECRET_1>\nc"),
        ("abc", [(2, 1, "secret"), (5, 9, "secret")], "abc"),
        ("", [(0, 1, "secret")], ""),
    ],
)
def test_one_line(spark, line, spans, expected):
    assert redact(spark, [(line, spans)])[0] == [expected]
    row = spark.createDataFrame([(line, spans)], "text string, spans array<struct<s:int,e:int,category:string>>")
    assert redaction.redact_rows(row).first().redacted == expected


def test_stable_numbers_filters_and_vault(spark):
    lines = [("key A", [(4, 5, "secret")]), ("B A", [(0, 1, "secret"), (2, 3, "secret")]), ("a@b", [(0, 3, "private_email")])]
    out, vault = redact(spark, lines)
    assert out == ["key <SECRET_1>", "<SECRET_2> <SECRET_1>", "<PRIVATE_EMAIL_1>"] and vault == {"<SECRET_1>": "A", "<SECRET_2>": "B", "<PRIVATE_EMAIL_1>": "a@b"}
    assert redact(spark, lines, wide=True) == (out, vault)
    assert redact(spark, lines, only=["private_email"], skip=["private_email"])[0] == ["key A", "B A", "<PRIVATE_EMAIL_1>"]
    assert redact(spark, lines, skip=["secret"])[0][:2] == ["key A", "B A"]


def scores(rows):
    return np.array(rows, np.float32)


def one(label, value=1.0):
    return [value if x == label else 0.0 for x in TOY]


def test_viterbi():
    assert decode.viterbi(scores([]), TOY) == []
    assert decode.viterbi(scores([one("B-secret"), one("E-secret"), one("O")]), TOY) == ["B-secret", "E-secret", "O"]
    assert decode.viterbi(scores([one("O", 5.0), one("I-secret", 5.0)]), TOY)[0] == "O"
    assert decode.viterbi(scores([one("B-secret", 9.0)]), TOY)[0] in ("O", "S-secret")
    row = [1.0 if x == "O" else 0.9 if x == "S-secret" else 0.0 for x in TOY]
    assert decode.viterbi(scores([row]), TOY) == ["O"]
    assert decode.viterbi(scores([row]), TOY, decode.Transitions(TOY, decode.Bias(span_entry=0.5))) == ["S-secret"]


def test_viterbi_is_the_best_legal_path():
    import itertools

    rng, t = np.random.default_rng(1), decode.Transitions(TOY)
    for _ in range(20):
        s = rng.standard_normal((3, len(TOY))).astype(np.float32)
        legal = [p for p in itertools.product(range(len(TOY)), repeat=3) if t.may_start[p[0]] and t.may_end[p[-1]] and all(t.legal[a, b] for a, b in zip(p, p[1:]))]
        best = max(legal, key=lambda p: sum(s[k, c] for k, c in enumerate(p)))
        assert decode.viterbi(s, TOY) == [TOY[c] for c in best]


def test_merging(spark):
    def merged(labels, offsets, gap=1):
        row = spark.createDataFrame([([{"s": s, "e": e} for s, e in offsets], labels)], "tokens array<struct<s:int,e:int>>, labels array<string>")
        got = row.select(decode.merge_in_row(F.col("tokens"), F.col("labels"), gap).alias("x")).first().x
        rows = spark.createDataFrame([(0, k, s, e, x) for k, ((s, e), x) in enumerate(zip(offsets, labels))], "id int, ord int, s int, e int, label string")
        assert sorted((r.s, r.e, r.category) for r in decode.merge_tokens(rows, ["id"], gap).collect()) == [tuple(x) for x in got]
        return [tuple(x) for x in got]

    assert merged(["O", "B-secret", "E-secret"], [(0, 1), (1, 5), (6, 11)]) == [(1, 11, "secret")]
    assert merged(["S-secret", "S-email"], [(0, 4), (4, 8)]) == [(0, 4, "secret"), (4, 8, "email")]
    assert merged(["I-secret", "O", "I-secret"], [(0, 3), (3, 4), (4, 7)]) == [(0, 7, "secret")]
    assert merged(["I-secret", "O", "I-secret"], [(0, 3), (3, 6), (6, 9)]) == [(0, 3, "secret"), (6, 9, "secret")]
    assert merged(["O", "O"], [(0, 1), (1, 2)]) == []


def test_scored_lines_fail_closed(spark):
    known = {"key A": ([(0, 3), (3, 5)], [one("O"), one("S-secret")]), "short": ([(0, 5)], [one("O"), one("O")])}
    lines = spark.createDataFrame([(0, "key A"), (1, "unknown"), (2, ""), (3, "short")], "line_no long, text string")
    rows = {r.line_no: r.scored for r in scorers.score_lines(lines, scorers.FixtureScorer(TOY, known)).collect()}
    assert rows[0].ok and rows[0].labels == ["O", "S-secret"] and rows[2].ok and rows[2].labels == []
    assert not rows[1].ok and rows[1].err == "KeyError" and not rows[3].ok
    assert spark.range(1).select(redaction.withhold(F.lit(False), F.lit("a"), F.lit("raw"))).first()[0] == C.WITHHELD


def test_anchors():
    assert scorers.anchor_pieces("Contact John", ["Contact", " John"]) == [(0, 7), (7, 12)]
    assert scorers.anchor_pieces("a  b", ["a", "b"]) == [(0, 1), (3, 4)] and scorers.anchor_pieces("ab", [" a", "b"]) == [(0, 1), (1, 2)]
    for bad in (["x"], [""], ["�"]):
        with pytest.raises(ValueError):
            scorers.anchor_pieces("ab", bad)


def tiny(**other):
    base = {"layers": 2, "width": 8, "heads": 4, "kv_heads": 2, "head_dim": 4, "experts": 6, "top_k": 2, "inner": 8, "radius": 3, "vocabulary": 20, "labels": ("O", "S-x")}
    return model.Shape(**(base | other))


def test_model_forms_agree():
    shape = tiny(factor=4.0)
    weights, ids = model.random_weights(shape), np.random.default_rng(2).integers(0, 20, 70)
    plain = model.Classifier(shape, weights, banded=False, sorted_dispatch=False).logits(ids)
    assert np.abs(plain - model.Classifier(shape, weights).logits(ids)).max() < 1e-4
    back = model.unflatten(model.read_safetensors(model.write_safetensors(model.flatten(weights))))
    assert np.array_equal(model.Classifier(shape, back).logits(ids), model.Classifier(shape, weights).logits(ids))
    w = np.random.default_rng(3).standard_normal((5, 128)).astype(np.float32)
    q = model.Quantised.of(w, 8)
    assert np.abs(q.dense() - w).max() < 0.02 and q.nbytes < w.nbytes
    mixed = {"a": q, "b": model.Quantised.of(w, 4)}
    tensors = model.read_safetensors(model.write_safetensors(model.flatten(mixed)))
    for block in (None, {"bits": 4, "group_size": 64, "a": {"bits": 8, "group_size": 64}}):
        again = model.unflatten(tensors, quantization=block)
        assert all(np.array_equal(again[k].dense(), mixed[k].dense()) and again[k].bits == mixed[k].bits for k in mixed)
    with pytest.raises(ValueError):
        model.unflatten(tensors, 4)


def test_frames():
    for cut in (1, 2, 5, 100):
        data, reader, got = frames.encode_request("héllo") + frames.encode_request("") + frames.encode_request("x"), frames.FrameReader(), []
        for at in range(0, len(data), cut):
            reader.feed(data[at : at + cut])
            got += [t for _, t in reader.frames()]
        assert got == ["héllo", "", "x"] and reader.rest == b""
    reader = frames.FrameReader(True)
    reader.feed(frames.encode_response(7, "a") + b"\x00")
    assert reader.next() == (7, "a") and reader.next() is None
    exact = frames.FrameReader(limit=3, rest=frames.encode_request("abc") + frames.encode_request("abcd"))
    assert exact.next() == (0, "abc")
    with pytest.raises(frames.Oversize):
        exact.next()
    assert frames.FrameReader(rest=b"\0\0\0\1\xff").next() == (0, "�")


def test_hub(tmp_path):
    assert hub.repo_folder("a/b") == "models--a--b" and hub.plain_etag('W/"x"') == "x" and hub.link_target("q/c.json", "e") == "../../../blobs/e"
    assert hub.cache_base(None, {"HF_HOME": "/h"}) == "/h/hub" and hub.cache_base("/o", {"HF_HUB_CACHE": "/c"}) == "/o"
    with pytest.raises(ValueError):
        hub.variant_files("none")
    assert hub.variant_files("q4-8emb", ["config"]) == ["q4-8emb/config.json"]
    root = tmp_path / "models--a--b"
    (root / "snapshots" / "c1").mkdir(parents=True)
    (root / "refs").mkdir()
    (root / "refs" / "main").write_text("c1\n")
    assert hub.cached_model("a/b", "bf16", str(tmp_path)) is None
    for f in hub.REQUIRED:
        (root / "snapshots" / "c1" / f).write_text("x")
    assert hub.model_folder(None, "a/b", "bf16", str(tmp_path)).endswith("c1")


def test_vault_file(spark, tmp_path):
    vault = spark.createDataFrame([(0, "<B_1>", "x"), (0, "<A_1>", "y"), (1, "<C_1>", "z")], "scope long, token string, value string")
    path = tmp_path / "map.json"
    assert text.write_vault(vault, 0, str(path)) == 2 and os.stat(path).st_mode & 0o777 == 0o600 and list(__import__("json").loads(path.read_text())) == ["<A_1>", "<B_1>"]


def test_generated_corpus_is_redacted_without_leaks_of_patterns(spark):
    gold = corpus.gold(spark, 60)
    assert corpus.records(5) == corpus.records(5) and len(corpus.tiled([1, 2], 5)) == 5
    lines = gold.select(F.lit(0).alias("scope"), "line_no", "text", pattern_spans(F.col("text")).alias("spans"))
    out, _ = redaction.redact_lines(lines)
    values = gold.select("line_no", F.posexplode("spans").alias("ord", "s")).select("line_no", "ord", "s.category", "s.value").where("category IN ('private_email', 'account_number')")
    assert {r.category: r.leaked for r in evaluate.leak_rate(evaluate.leaks(values, out)).collect()}["overall"] == 0
    assert evaluate.parity_passed("quantised", 100, 98, 0.996) and not evaluate.parity_passed("fp32", 10, 9, 1.0)


def test_stream_equals_batch(spark, tmp_path):
    from veilspark.streaming.redact_stream import redact_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    messages = [("c1", k, f"mail a{k % 3}@b.co and\nip 1.2.3.{k % 2}") for k in range(6)] + [("c2", 0, "x@y.zz"), ("c2", 1, "plain")]
    source = str(tmp_path / "in")
    schema = "scope string, seq long, payload string, closed boolean"
    for part in (messages[:3], messages[3:]):
        spark.createDataFrame([(*m, False) for m in part], schema).coalesce(1).write.mode("append").json(source)
    stream = redact_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
    query = stream.writeStream.format("memory").queryName("redacted_stream").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.scope, r.seq): r.redacted for r in spark.table("redacted_stream").collect()}
    rows = spark.createDataFrame(messages, "scope string, line_no long, text string").withColumn("spans", pattern_spans(F.col("text")))
    out, _ = redaction.redact_lines(rows)
    assert got == {(r.scope, r.line_no): r.redacted for r in out.collect()}


@pytest.mark.parametrize("name", ["redact_documents", "stable_tokens_stream", "span_clamp", "prf", "viterbi_decode", "label_kind"])
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = plans.queries()[name](spark, sf_dir)
    expected = db.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, got.select(sorted(got.columns)).collect()))) == sorted(map(repr, db.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({plans.oracle_sql()[name]})").fetchall()))


def test_score_difference_takes_whole_vectors(spark, tmp_path):
    rows = [(0, [0.0, 1.0, 0.0], 0), (1, [0.0, -1.0, 0.5], 0), (2, [0.5, -1.0, 0.5], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tuple(plans.queries()["score_difference"](spark, str(tmp_path)).first()) == (2.0, 2.0)


# ---------------------------------------------------------------- the golden line: best three scores of each token

GOLDEN = "Contact John Smith at john@acme.com, key sk-proj-abc123def456."
ENDS = [0, 7, 12, 18, 21, 26, 27, 29, 31, 35, 36, 40, 43, 47, 48, 49, 52, 55, 58, 61, 62]
# Fixed values.
SCORES = """
O=15.26 I-private_url=3.00 E-private_url=2.25
B-private_person=20.33 O=10.96 S-private_person=5.73
E-private_person=20.24 O=11.62 S-private_person=5.00
O=20.27 B-private_email=4.19 E-private_url=1.12
B-private_email=20.79 B-private_person=7.88 O=7.84
I-private_email=20.90 I-private_person=8.00 I-secret=7.78
I-private_email=21.91 I-private_person=7.96 I-secret=7.30
I-private_email=21.53 I-private_person=6.85 I-private_date=6.80
E-private_email=18.58 I-private_email=8.95 S-private_phone=6.32
O=16.63 I-private_address=4.54 I-private_person=3.45
O=12.46 B-private_phone=4.81 B-private_person=4.55
B-private_phone=13.26 B-secret=11.71 O=8.14
I-secret=13.09 I-private_phone=11.31 O=9.33
I-secret=13.99 I-private_phone=12.61 O=9.20
I-secret=13.97 I-private_phone=13.42 O=9.70
I-secret=14.37 I-private_phone=13.55 O=9.05
I-private_phone=14.90 I-secret=13.70 O=9.67
I-private_phone=14.50 I-secret=13.61 O=9.33
E-private_phone=14.64 E-secret=13.09 O=10.36
O=14.89 E-private_address=4.08 E-secret=2.61
"""


def golden_scorer():
    rows = np.full((20, len(plans.ALL_LABELS)), -9.0, np.float32)
    for row, line in zip(rows, SCORES.strip().splitlines()):
        for pair in line.split():
            label, value = pair.split("=")
            row[plans.ALL_LABELS.index(label)] = float(value)
    return scorers.FixtureScorer(plans.ALL_LABELS, {GOLDEN: (list(zip(ENDS, ENDS[1:])), rows.tolist())})


@pytest.mark.parametrize(
    "decoder, expected",
    [
        ("argmax", "Contact<PRIVATE_PERSON_1> at<PRIVATE_EMAIL_1>, key<PRIVATE_PHONE_1><SECRET_1><PRIVATE_PHONE_2>."),
        ("viterbi", "Contact<PRIVATE_PERSON_1> at<PRIVATE_EMAIL_1>, key<PRIVATE_PHONE_1>."),
    ],
)
def test_golden_line_and_failing_lines(spark, decoder, expected):
    lines = spark.createDataFrame([(0, 0, GOLDEN), (0, 1, "no such line"), (0, 2, ""), (0, 3, None), (None, 4, GOLDEN), (0, 5, GOLDEN)], "scope long, line_no long, text string")
    out, vault = redaction.redact(lines, golden_scorer(), decoder=decoder)
    assert [r.redacted for r in out.orderBy("line_no").collect()] == [expected, C.WITHHELD, "", None, expected, expected]
    assert {r.value for r in vault.collect()} >= {" John Smith", " john@acme.com"}
    open_ = redaction.redact(lines, golden_scorer(), decoder=decoder, fail_open=True)[0]
    assert [(r.redacted, r.ok) for r in open_.where("line_no = 1").collect()] == [("no such line", False)]
    only = redaction.redact(lines, golden_scorer(), decoder=decoder, only=["private_email"], skip=["private_email"])[0]
    assert only.where("line_no = 0").first().redacted == "Contact John Smith at<PRIVATE_EMAIL_1>, key sk-proj-abc123def456."


@pytest.mark.parametrize("wide", [False, True])
def test_lines_never_meet_nor_vanish(spark, wide):
    rows = [(1, 1, "mail a@b.com now"), (1, 1, "zz c@dd.org yy"), (1, 1, "zz c@dd.org yy"), (None, 2, "x a@b.com"), (None, None, "y a@b.com"), (1, 3, None), (1, None, "plain")]
    lines = spark.createDataFrame(rows, "scope long, line_no long, text string").withColumn("spans", pattern_spans(F.col("text")))
    out, vault = redaction.redact_lines(lines, wide=wide)
    got = sorted((r.redacted or "", r.text or "") for r in out.collect())
    first, second = ("1", "2") if any(t.startswith("mail <PRIVATE_EMAIL_1>") for t, _ in got) else ("2", "1")
    assert got == sorted([(f"mail <PRIVATE_EMAIL_{first}> now", rows[0][2]), *[(f"zz <PRIVATE_EMAIL_{second}> yy", rows[1][2])] * 2, ("x <PRIVATE_EMAIL_1>", rows[3][2]), ("y <PRIVATE_EMAIL_1>", rows[4][2]), ("", ""), ("plain", "plain")])
    assert vault.count() == 3
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not any(b"dd.org" in open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) if "numbers-" in d for f in names)


def test_lines_of_null_texts(spark):
    from veilspark.operators.lines import to_lines, to_text

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb\r\n")], "doc_id long, text string")
    lines = to_lines(docs, "doc_id")
    assert sorted((r.scope, r.line_no, r.text) for r in lines.where("scope > 1").collect()) == [(2, 0, ""), (3, 0, "a"), (3, 1, ""), (3, 2, "b\r"), (3, 3, "")]
    assert {r.scope: r.text for r in to_text(lines).collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert to_lines(docs, "doc_id", one_shot=True).where("scope = 3 AND line_no = 2").first().text == "b"


def test_missing_lines_count_as_leaks(spark):
    values = spark.createDataFrame([(0, 0, "secret", "k1"), (1, 0, "secret", "k2"), (2, 0, "secret", "k3")], "line_no long, ord int, category string, value string")
    out = spark.createDataFrame([(0, 0, "<SECRET_1>"), (0, 2, "k3 stands")], "scope long, line_no long, redacted string")
    assert {r.line_no: r.leaked for r in evaluate.leaks(values, out).collect()} == {0: False, 1: True, 2: True}
    with pytest.raises(ValueError):
        evaluate.aligned(values, out)


def test_line_files(spark, tmp_path):
    big = [f"line {k} of a file" for k in range(5000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("\n".join(big).encode())
    (tmp_path / "in" / "b.txt").write_bytes(b"one\r\ntwo\rhalf\n\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = text.read_lines(spark, str(tmp_path / "in"))
        rows = [(os.path.basename(r.scope), r.line_no, r.text) for r in lines.orderBy("scope", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[1:] for r in rows if r[0] == "a.txt"] == list(enumerate(big))
    assert [r[1:] for r in rows if r[0] == "b.txt"] == [(0, "one"), (1, "two\rhalf"), (2, ""), (3, "last")]
    text.write_lines(spark.createDataFrame([(0, k, t) for k, t in enumerate(["b", "a", "c"])], "scope long, line_no long, redacted string").coalesce(1), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "b\na\nc\n"


def test_gold_and_eval_files(spark, tmp_path):
    gold = corpus.gold(spark, 20)
    text.write_gold(gold.coalesce(1), str(tmp_path / "gold"))
    back = text.read_gold(spark, str(tmp_path / "gold")).orderBy("line_no").collect()
    assert [(r.text, [tuple(s) for s in r.spans]) for r in back] == [(r.text, [tuple(s) for s in r.spans]) for r in gold.orderBy("line_no").collect()]
    np.savez(tmp_path / "ref.npz", texts=np.array(["a", "bc"]), lengths=np.array([1, 2]), ref_logits=np.arange(8, dtype=np.float32).reshape(2, 2, 2))
    rows = text.read_eval(spark, str(tmp_path / "ref.npz")).orderBy("line_no").collect()
    assert [(r.text, r.length, r.scores) for r in rows] == [("a", 1, [[0.0, 1.0]]), ("bc", 2, [[4.0, 5.0], [6.0, 7.0]])]


def test_leak_gate_over_a_generated_corpus(spark):
    gold = corpus.gold(spark, 100)
    out, vault = redaction.redact(gold.select(F.lit(0).alias("scope"), "line_no", "text"))
    values = gold.select("line_no", F.posexplode("spans").alias("ord", "s")).select("line_no", "ord", "s.category", "s.value")
    values = values.where("category IN ('private_email', 'account_number', 'private_phone', 'private_url')")
    report = {r.category: r for r in evaluate.leak_rate(evaluate.leaks(values, evaluate.aligned(gold.select("line_no"), out))).collect()}
    assert report["overall"].total > 50 and report["overall"].passed and report["overall"].leaked == 0
    assert evaluate.lines_conserved(gold, out).first().conserved


def test_flat_lines(spark):
    rows = spark.createDataFrame([("a\nb",), ("a\r\nb\n",), ("\n",), ("a\n\n",), (None,)], "t string").select(C.flat_lines(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a b", "a b", "", "a ", None]


def test_stream_of_chunks_keeps_parts_and_ends_scopes(spark, tmp_path):
    from veilspark.streaming.redact_stream import frames_of_chunks

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    whole = frames.encode_request("first") + frames.encode_request("zweité")
    huge = b"\x7f" * 8
    batches = [
        [("a", 0, whole[:7], False), ("b", 0, huge, False), ("c", 0, whole[:11], True)],
        [("a", 1, whole[7:12], False), ("b", 1, whole, False), ("c", 1, whole, False)],
        [("a", 2, whole[12:], False), ("a", 3, None, True)],
    ]
    schema, folder = "scope string, seq long, chunk binary, closed boolean", str(tmp_path / "in")
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = frames_of_chunks(spark.readStream.schema(schema).parquet(folder))
        keep = lambda df, _: got.extend(tuple(r) for r in df.collect())
        run = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
    by = lambda scope: [r[1:] for r in got if r[0] == scope]
    assert by("a") == [(0, 0, "first"), (1, 0, "zweité")]
    assert by("b") == [(0, 2, "")]
    assert by("c") == [(0, 0, "first"), (0, 0, "first"), (1, 0, "zweité")]
