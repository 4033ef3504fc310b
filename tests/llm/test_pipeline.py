"""The pipeline on a small corpus: each stage's decisions take effect, and clean documents stay."""

import random

import corpus_pipeline
from strandline.llm import mixing, near_dedup, quality

from .helpers import SCHEMA, corpus, words


def _write(spark, path, rows, benchmark, labels):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")


def test_pipeline(spark, tmp_path):
    r = random.Random(31)
    w = lambda k: " ".join(f"q{r.randrange(9000)}" for _ in range(k))
    prose = lambda: "\n".join(w(r.randint(12, 64)).capitalize() + r.choice([".", ""]) for _ in range(4))
    good = [prose() for _ in range(120)]
    bad = [" ".join(w(20).upper().split(" ") * 3).replace(" ", "!! ") for _ in range(40)]
    item = w(30)
    passage = w(60)
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(good + bad)]
    rows += [(500, good[0], "en", "a", 0), (501, good[1] + " end", "en", "a", 0), (502, prose() + "\n" + item, "en", "b", 0), (503, prose() + "\n" + passage, "en", "a", 0), (504, prose() + "\n" + passage, "en", "b", 0), (505, None, None, None, None)]
    labels = [(i, int(i < 120), 0) for i in range(160)]
    _write(spark, str(tmp_path), rows, [(1, item)], labels)
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]
    assert not set(out) & set(range(120, 160)) and not {500, 501, 502} & set(out)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert set(range(120)) <= set(kept) and passage in kept[503] and passage not in kept[504]
    mixed = {x["doc_id"]: x["taken"] for x in mixing.mix(docs).collect()}
    assert {i: x["taken"] for i, x in out.items()} == {i: t for i, t in mixed.items() if t}
    assert all(x["repeats"] * x["size"] == x["taken"] and x["size"] == len(words(x["text"])) for x in out.values())


def test_empty_and_odd_tables(spark, tmp_path):
    _write(spark, str(tmp_path / "none"), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    _write(spark, str(tmp_path / "odd"), corpus(60), [(1, None)], [])
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.count() > 0 and near_dedup.near_duplicates(out.drop("repeats", "taken", "target", "size", "source_size")).where("not kept").count() >= 0
    assert quality.score_quality(spark.createDataFrame(corpus(5), SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).count() == len(corpus(5))


def test_near_copies_without_ids(spark):
    r = random.Random(13)
    w = lambda k: " ".join(f"q{r.randrange(9000)}" for _ in range(k))
    a, b, c = w(100), w(100), w(100)
    rows = [(1, a), (None, a + " end"), (None, b), (None, b + " end"), (None, c), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, "")
    texts = {x["text"] for x in got.collect()}
    assert got.columns == docs.columns and got.count() == 4 and {a, c, None} <= texts and len(texts & {b, b + " end"}) == 1
