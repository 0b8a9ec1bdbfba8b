"""The corpus pipeline on a small table, each stage against brute force on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import brute_components, brute_marks, brute_sets, prose  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows, labels = random.Random(12), [], []
    items = [(k, prose(rng, 14)) for k in range(3)]
    for k in range(300):
        words, toxic = prose(rng, rng.randint(25, 60)).split(), k % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilescum", "grubtoad"]))
        text = " ".join(words) + (f" {items[k % 3][1]}" if k % 31 == 0 else "") + (" mail a.b@c.example" if k % 17 == 0 else "")
        rows.append((k, text, "en", f"s{k % 2}", len(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, r[1], "en", "s0", r[4]) for k, r in enumerate(rows[1:9])] + [(2000, None, "en", "s1", None), (2001, "", "en", "s1", 0)]
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.mode("overwrite").parquet(f"{sf_dir}/stage-{name}")
        docs = spark.read.parquet(f"{sf_dir}/stage-{name}")
        assert docs.columns == columns + ["mix_copy"] * (name == "mix_sources")
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            toxic = {k for k, t in before.items() if t and ("vilescum" in t or "grubtoad" in t)}
            assert len(toxic & set(after)) <= 3 and len(set(before) - toxic - set(after)) <= 3
        if name == "near_dedup":
            ids = sorted(before)
            least = brute_components(ids, brute_sets([before[i] for i in ids]))
            assert set(after) == {i for i, c in zip(ids, least) if i == c}
        if name == "decontaminate":
            assert set(after) == {i for i, t in before.items() if not brute_marks(t, items)[4]}
        if name == "pii":
            assert set(after) == set(before) and not any("@" in (t or "") for t in after.values())
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
            assert all(after[i] == t for i, t in before.items() if not t or "@" not in t)
        if name == "mix_sources":
            assert all(before[i] == t for i, t in after.items())
        before = after


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[-1] == "mix_copy"
