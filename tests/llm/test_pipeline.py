"""The corpus pipeline: its stages one after another, each against what its operator says of the same input."""

import random

import pytest

import corpus_pipeline
from panelforge.llm import decontaminate, quality, queries, shinglejoin

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert ids(steps[1]) == ids(quality.quality(steps[0], labels).where("kept"))
    assert 0 < steps[1].count() < steps[0].count()


def test_near_copy_stage(steps):
    assert ids(steps[2]) == ids(shinglejoin.similar_groups(steps[1]).where("doc_id = component_id"))
    again = shinglejoin.similar_groups(steps[2])
    assert again.where("doc_id <> component_id").count() == 0


def test_repeat_and_benchmark_stages(spark, steps):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert ids(steps[3]) == ids(steps[2])
    bad = {r["doc_id"] for r in decontaminate.overlaps(steps[3], bench).collect()}
    assert ids(steps[4]) == [i for i in ids(steps[3]) if i not in bad]


def test_packing_stage(spark, steps):
    tokens = {r["doc_id"]: r["n"] for r in steps[5].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert sorted(tokens) == ids(steps[4])
    assert steps[5].where("offset + length > 1024").count() == 0


def test_run_is_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SMALL).count() == steps[5].count()
    assert corpus_pipeline.ORACLE_SQL is None and queries.bpe_path()


KIND = "doc_id long, text string, lang string, source string, n_chars long, _bad_id long, _bad_key string, node string, label string"


def through(spark, rows, folder):
    out = [spark.createDataFrame(rows, KIND).repartition(3)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SMALL).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null ids, texts and languages, repeated rows, exact and near copies, a benchmark passage, names that clash."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    clean = [" ".join(word() for _ in range(120)) for _ in range(12)]
    near = clean[0].split()
    near[-1] = "other"
    passage = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak = f"{clean[1][:300]} {passage} {' '.join(word() for _ in range(60))}"
    texts = [(k, t) for k, t in enumerate(clean)] + [(50, " ".join(near)), (51, clean[2]), (60, leak), (70, None), (71, ""), (None, clean[3]), (None, None), (None, " ".join(word() for _ in range(90)))]
    rows = [(i, t, None if k % 3 == 0 else "en", "s", None, k, "x", "y", None) for k, (i, t) in enumerate(texts)]
    steps = through(spark, rows + [rows[4], rows[4], rows[-1]], tmp_path)
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert all(r["text"] for r in steps[1].collect())  # null and empty texts are rejected
    passed = {r["text"] for r in steps[1].collect()}
    kept = [(r["doc_id"], r["text"]) for r in steps[4].collect()]
    assert len({t for _, t in kept}) == len(kept) and not {60, 51} & {i for i, _ in kept}
    for k in range(2, 12):  # each clean text that passed stays once and whole, also where its rows repeat
        assert [t for _, t in kept if t == clean[k]] == [clean[k]] * (clean[k] in passed)
    assert sum(clean[k] in passed for k in range(2, 12)) >= 4
    assert len([t for _, t in kept if t in (clean[0], " ".join(near))]) <= 1
    lengths = sum(r["length"] for r in steps[5].collect())
    assert lengths == sum(r["doc_tokens"] for r in steps[5].where("start = 0").collect())


def test_no_rows_go_through_all_stages(spark, tmp_path):
    assert [s.count() for s in through(spark, [], tmp_path)] == [0] * 6
