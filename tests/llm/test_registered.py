"""The ten queries as they are registered, and the odd cases that they and the pipeline's stages define."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import line_dedup as L
from strandline.llm import near_dedup as N
from strandline.llm.exact_dedup import DigestIndex
from strandline.llm.queries import QUERIES
from strandline.llm.shared import fresh

from .helpers import SCHEMA, corpus, fold, frame, with_clashes, words

COLUMNS = {
    "op1_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_decontamination": ["doc_id", "item_id", "coverage", "n_tiles", "contaminated"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op10_line_dedup": ["doc_id", "text", "n_lines", "n_dropped"],
}
ROWS = [*corpus(50), (None, "no id\nbut a text", None, None, None), (None, None, None, None, None), (9000, "word " * 3000, "en", "a", 15000)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    with_clashes(frame(spark, ROWS)).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five"), (None, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(r[0], i % 3 > 0, i % 5 == 0) for i, r in enumerate(ROWS)], "doc_id long, quality boolean, toxic boolean").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, tables, name):
    out = QUERIES[name](spark, tables)
    got = out.collect()
    assert out.columns == COLUMNS[name]
    if name == "op4_decontamination":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 1) for i, t, *_ in ROWS if (t or "").lower().startswith("one two three four")}
        return
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in ROWS)
    if "held_out" in out.columns:
        assert all(r["held_out"] == (fold(r["doc_id"]) == (1 if name == "op1_lm_scoring" else 0)) for r in got)
    if name == "op1_lm_scoring":
        train = sum(len(words(t)) + 1 for i, t, *_ in ROWS if fold(i) != 1)
        assert {r["train_tokens"] for r in got} == {train} and all(r["score"] < 0 and 0 <= r["n_known"] <= r["n_tokens"] for r in got)
    if name == "op2_token_counts":
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and any(r["over_limit"] for r in got) and not all(r["over_limit"] for r in got)
    if "predicted" in out.columns:
        assert all(r["predicted"] == int(r["score"] >= (0.3 if name == "op9_quality_classifier" else 0.5)) for r in got)
    if name == "op10_line_dedup":
        assert all(r["n_dropped"] <= r["n_lines"] and r["n_lines"] == (r["n_dropped"] + r["text"].count("\n") + 1 if r["text"] else r["n_lines"]) for r in got)


def test_an_index_is_reopened_with_any_setting(spark):
    path, rows = fresh(spark, "index"), [(i, f"text {i}", None, None, 0) for i in range(200)]
    with DigestIndex(spark, path, 3) as index:
        assert index.deduplicate(frame(spark, rows)).where("kept").count() == 200
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("5", "2"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            with DigestIndex(spark, path) as index:
                again = index.deduplicate(frame(spark, [*rows, (1000 + int(n), f"new {n}", None, None, 0)]))
                assert again.where("kept").count() == 1 and index.buckets == 3
                assert again.where("doc_id < 1000 and keep_id = doc_id").count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for wrong in ({"buckets": 4}, {"id_type": "string"}):
        with pytest.raises(ValueError):
            DigestIndex(spark, path, **wrong)


def test_near_copies_by_shared_and_missing_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a), (5, a + " x"), (5, b), (9, b), (11, c), (None, c + " y"), (None, d), (None, d), (2**63 - 1, "alone here"), (5, b), (20, None), (None, "")]
    got = N.near_duplicates(with_clashes(frame(spark, [(i, t, None, None, 0) for i, t in rows]))).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert all(by[k] == (3, k[0] == 3) for k in ((3, 36), (5, 37), (5, 36), (9, 36)))
    assert by[11, 36] == (11, True) and by[None, 37] == (11, False) and by[None, 36] == (None, True) and by[2**63 - 1, 1] == (2**63 - 1, True) and by[20, 0] == (20, True)
    with pytest.raises(TypeError):
        N.near_duplicates(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_lines_of_any_length_and_id(spark):
    rows = [(2**63 - 1, "ab\nlonger line of text\n日本語の行です。とても長い行"), (None, "AB\nown words of this one"), (4, "ab\n \nLonger  line of text"), (4, "日本語の行です。とても長い行"), (5, ""), (6, None)]
    df = spark.createDataFrame([(i, t, 777, "x") for i, t in rows], "doc_id long, text string, n_lines int, _id string").withColumns({c: F.lit(1) for c in ("_digest", "_gone", "_text_digest", "_i", "hash")})
    out = L.dedup_lines(df)
    got = sorted(((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=str)
    want = [(str(2**63 - 1), "", 3, 3), ("None", "own words of this one", 2, 1), ("4", "ab\n \nLonger  line of text", 3, 0), ("4", "日本語の行です。とても長い行", 1, 0), ("5", "", 0, 0), ("6", None, 0, 0)]
    assert got == sorted(want, key=str) and out.columns == ["doc_id", "text", "_id", "_digest", "_gone", "_text_digest", "_i", "hash", "n_lines", "n_dropped"]
    with pytest.raises(TypeError):
        L.dedup_lines(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_stages_keep_columns_of_any_name(spark, tables):
    names = ["_id", "_digest", "_gone", "_text_digest", "target", "size", "taken", "n_lines", "source_size", "repeats", "_own", "_row", "_statistics"]
    docs = spark.createDataFrame([r for r in ROWS if r[0] is None or r[0] < 100], SCHEMA).withColumns({c: F.lit(f"<{c}>") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        got = out.collect()
        own = corpus_pipeline.OWN if name == "mixing" else []
        assert sorted(out.columns) == sorted(set(docs.columns) | set(own)), name
        assert got and all(r[c] == f"<{c}>" for r in got for c in names if c not in own), name


def test_lines_that_leave_a_remnant_take_the_document(spark):
    line = lambda x: " ".join(f"{x}{k}" for k in range(30))
    first = [line(x) for x in "abcd"]
    rows = [(1, "\n".join(first)), (2, "\n".join([*first, "two words"])), (3, "\n".join([first[0], line("e")])), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.fuzzy_lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 3: (line("e"), len(line("e"))), 4: (None, 0)}


def test_repeated_rows_get_shares_of_their_own(spark):
    rows = [(1, "w " * 10, "en", "a", 0)] * 3 + [(2, "v " * 90, "en", "b", 0), (None, "u " * 10, "en", "a", 0)]
    got = corpus_pipeline.target_mix(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    taken = sum(r["taken"] for r in got if r["source"] == "a")
    assert abs(taken - next(r["target"] for r in got if r["source"] == "a")) <= 10 and all(r["repeats"] * r["size"] == r["taken"] for r in got)
