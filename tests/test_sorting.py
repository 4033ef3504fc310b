import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandline import operators as O
from strandline import plans as P
from strandline.sources import from_rows
from strandline.spec import SortSpec, directed

TEXT = "key string, value string"


def _sorted(spark, rows, schema=TEXT, **kw):
    return [tuple(r) for r in O.global_sort(from_rows(spark, rows, schema, 3), SortSpec(["key"], ["value"], **kw)).collect()]


@pytest.mark.parametrize("partitions", [None, 1, 4])
def test_order_and_rows_are_kept(spark, partitions):
    rows = [(f"{i * 7919 % 1000:05d}", str(i)) for i in range(1000)] + [("00500", "again")] * 20
    got = _sorted(spark, rows, partitions=partitions)
    assert [k for k, _ in got] == sorted(k for k, _ in rows) and sorted(got) == sorted(rows)


def test_bytes_unicode_and_case(spark):
    words = ["Apple", "apple", "APPLE", "123", "émile", "z", "日本", "😀", "￿", "", "a", "a\0b", "ab"]
    assert [k for k, _ in _sorted(spark, [(w, "") for w in words])] == sorted(words, key=lambda w: w.encode())
    keys = [bytes([i, 0, 255 - i]) for i in range(256)] + [b"", b"\0", b"\xff" * 40]
    random.Random(2).shuffle(keys)
    got = [bytes(r["key"]) for r in O.global_sort(from_rows(spark, [(k, b"") for k in keys]), SortSpec(["key"])).collect()]
    assert got == sorted(keys)


def test_numbers_with_special_values(spark):
    v = [float("inf"), -1000.0, float("-inf"), 1.0, 0.0, -1.0, 1000.0, float("nan"), None]
    got = [r["key"] for r in O.global_sort(from_rows(spark, [(x,) for x in v], "key double"), SortSpec(["key"])).collect()]
    assert got[0] is None and got[1:8] == [float("-inf"), -1000.0, -1.0, 0.0, 1.0, 1000.0, float("inf")] and got[8] != got[8]


def test_identical_keys_large_values_and_empty(spark):
    assert len(_sorted(spark, [("same", str(i)) for i in range(3000)], partitions=4)) == 3000
    big = _sorted(spark, [(f"k{i}", "x" * 1_000_000) for i in (3, 1, 2)])
    assert [k for k, _ in big] == ["k1", "k2", "k3"]
    assert _sorted(spark, []) == []


def test_stable(spark):
    rows = [(str(i % 3), str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, TEXT).coalesce(1)
    got = [tuple(r) for r in O.global_sort(df, SortSpec(["key"], ["value"], stable=True)).collect()]
    assert got == sorted(rows, key=lambda r: r[0])


def test_spec_errors(spark):
    df = from_rows(spark, [("a", "b")], TEXT)
    with pytest.raises(ValueError):
        SortSpec([])
    with pytest.raises(ValueError):
        SortSpec(["key"], partitions=0)
    with pytest.raises(IndexError):
        O.global_sort(df, SortSpec([5]))
    with pytest.raises(ValueError):
        O.global_sort(df, SortSpec(["none"]))
    with pytest.raises(TypeError):
        O.global_sort(spark.sql("select map(1, 2) as m"), SortSpec(["m"]))
    assert O.global_sort(df, SortSpec([0], [1, 0])).columns == ["key", "value", "key_2"]


def test_runs_and_parallel_merge(spark):
    rows = [(f"{i * 31 % 997:04d}", str(i)) for i in range(997)]
    runs = O.generate_runs(from_rows(spark, rows, TEXT), SortSpec(["key"], ["value"]), 5)
    by = {}
    for r in runs.collect():
        by.setdefault(r["run_id"], []).append(r["key"])
    assert len(by) == 5 and all(v == sorted(v) for v in by.values())
    merged = O.parallel_merge(runs, SortSpec(["key"], ["value"]), 3)
    assert [r["key"] for r in merged.collect()] == sorted(k for k, _ in rows)
    assert O.is_sorted(merged, ["key"]) and not O.is_sorted(from_rows(spark, rows, TEXT), ["key"])
    assert O.same_rows(merged, from_rows(spark, rows, TEXT)) and not O.same_rows(merged, from_rows(spark, rows[1:], TEXT))


def test_merge_ties_come_in_input_order(spark):
    a, b, c = ([(k, s) for k in ("a", "b", "b")] for s in "123")
    got = [(r["key"], r["src"]) for r in O.merge_sorted([from_rows(spark, x, TEXT) for x in (a, b, c)], SortSpec(["key"], ["value"])).collect()]
    assert got == sorted(got)
    assert O.merge_sorted([from_rows(spark, a, TEXT)], SortSpec(["key"])).count() == 3
    none = O.merge_sorted([], SortSpec(["key"]))
    assert none.columns == ["key", "value", "src"] and none.count() == 0


def test_range_scan_golden(spark):
    rows = [(k, str(i)) for k, n in zip("abcde", (100, 200, 150, 100, 50), strict=True) for i in range(n)]
    df = from_rows(spark, rows, TEXT)
    n = lambda lo, hi: O.range_scan(df, "key", lo, hi).count()
    assert [n("b", "d"), n("c", "c"), n("c", "d"), n("d", None), n(None, "c"), n(None, None)] == [350, 0, 150, 150, 300, 600]


@pytest.mark.parametrize("kind", ["rank", "row_number", "dense_rank", "cume_dist"])
def test_global_rank_equals_the_window(spark, kind):
    r = random.Random(4)
    df = spark.createDataFrame([(r.choice([None, *range(40)]), r.choice("abc"), i) for i in range(2000)], "x int, y string, id int")
    keys = ["x", "y"] if kind != "row_number" else ["x", "y", "id"]
    got = O.global_rank(df, keys, kind, "p", ranges=7)
    want = df.withColumn("p", getattr(F, kind)().over(W.partitionBy().orderBy(*keys)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    if kind == "rank":
        assert sorted(map(str, O.rank_by_distinct(df, keys, "p").select(*got.columns).collect())) == sorted(map(str, got.collect()))
    assert O.global_rank(df.limit(0), keys, kind).count() == 0


def test_quantiles(spark):
    df = spark.range(1, 11).selectExpr("cast(id as double) v", "cast(id as string) s")
    assert [r["value"] for r in O.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()] == [1.0, 5.0, 10.0]
    assert O.value_at(O.cdf(df, "v"), 0.5).first()[0] == 5.0 and O.value_at(O.cdf(df.limit(0), "v"), 0.5).first()[0] is None
    big = spark.range(100_000).selectExpr("cast(id as double) v")
    for r in O.kll_quantiles(big, "v", [0.1, 0.5, 0.9]).collect():
        assert abs(r["value"] / 100_000 - r["p"]) < 0.03
    assert O.kll_summary(big, "v").first()["n"] == 100_000
    assert abs(O.kll_rank(big, "v", 25_000.0).first()["quantile"] - 0.25) < 0.03
    with pytest.raises(TypeError):
        O.kll_summary(df, "s")
    assert len(O.split_points(df, ["s"], 4)) == 3
    assert O.histogram_text(df.limit(0), "v", 4) == "Empty sketch" and "equal" in O.histogram_text(df.where("v = 3"), "v", 4)
    assert sum(r["n"] for r in O.histogram(df, "v", 3).collect()) == 10 and len(O.histogram_text(df, "v", 3).splitlines()) == 3


def test_policies():
    c = P.SortConfig(1024, 32768, 64, 32)
    got = {p.name: p for p in P.all_policies(c)}
    tiny, gen = P.policy_by_name("Tiny", c), P.policy_by_name("GenBound", c)
    assert (tiny.run_size_mb, tiny.run_gen_threads, tiny.merge_threads) == (2.0, 32, 1.0) and (gen.run_size_mb, gen.run_gen_threads) == (32.0, 32)
    want = {  # run size, generation threads, merge threads, generation memory, merge memory, runs
        P.POLICIES[0]: (2, 32, 1, 64, 1024, 16384), P.POLICIES[1]: (1024, 1, 32, 1024, 64, 32), P.POLICIES[2]: (45.25, 22.63, 22.63, 1024, 1024, 724.1),
        P.POLICIES[3]: (32, 32, 16, 1024, 1024, 1024), P.POLICIES[4]: (64, 16, 32, 1024, 1024, 512),
    }
    for name, values in want.items():
        p = got[name]
        assert (p.run_size_mb, p.run_gen_threads, p.merge_threads, p.run_gen_memory_mb, p.merge_memory_mb, P.run_count(p, 32768)) == pytest.approx(values, rel=1e-3)
        assert P.is_feasible(p, 1024.001) and min(P.partitions_for(p, 32768)) >= 1
    assert P.bottleneck(tiny) == "Merge Phase" and P.bottleneck(got[P.POLICIES[1]]) == "Run Generation" and P.policy_by_name("no") is None
    with pytest.raises(ValueError):
        P.SortConfig(0)
    assert P.memory_list("512MB, 1GB,2") == [512.0, 1024.0, 2.0] and P.human_bytes(1536) == "1.50 KB"


def test_stats_and_estimate(spark):
    df = spark.range(20_000).selectExpr("(id * 7919) % 20000 as k", "cast(id as string) as v")
    out, s = P.sort_with_stats(df, SortSpec(["k"], ["v"]), 4)
    assert sum(s.entries) == 20_000 and len(s.entries) == 4 and s.imbalance()["imbalance"] < 2 and s.shuffle_write_bytes > 0 and "avg" in str(s)
    assert P.partition_imbalance(P.partition_counts(out)).first()["total"] == 20_000
    assert P.SortStats().read_amplification() is None and P.SortStats().imbalance() == {}
    mb = P.estimate_sort_mb(df, SortSpec(["k"], ["v"]))
    assert 20_000 * 13 / 2**20 < mb < 20_000 * 17 / 2**20 and P.estimate_sort_mb(df.limit(0), SortSpec(["k"])) == 0


def test_ranks_in_any_direction(spark):
    texts = ["a" * 70, "a" * 64, "a" * 63, "a" * 70 + "b", None, "b", ""]  # longer than the prefix that bounds look at, and of just that length
    d = spark.createDataFrame([(a, b, i % 2 / 0.5 if i % 5 else float("nan")) for i, (a, b) in enumerate((a, b) for a in texts for b in (3, 1, None))], "k string, v int, f double")
    for down, last in ((False, False), (True, False), ([True, False, True], [False, True, True])):
        for kind in ("rank", "row_number", "dense_rank", "cume_dist"):
            keys = ["k", "f", "v"]
            got = O.global_rank(d.repartition(3), keys, kind, "r", ranges=5, descending=down, nulls_last=last).collect()
            want = d.withColumn("r", getattr(F, kind)().over(W.orderBy(*directed(keys, down, last)))).collect()
            assert sorted(map(str, got)) == sorted(map(str, want))
        one = O.rank_by_distinct(d.union(d), ["k"], "r", descending=bool(down), nulls_last=bool(last)).collect()
        want = d.union(d).withColumn("r", F.rank().over(W.orderBy(*directed(["k"], bool(down), bool(last))))).collect()
        assert sorted(map(str, one)) == sorted(map(str, want))
        for n in (1, 4):
            order = directed(["k", "f", "v"], down, last)
            assert O.is_sorted(d.repartitionByRange(n, *order).sortWithinPartitions(*order), ["k", "f", "v"], down, last)
    assert not O.is_sorted(d.coalesce(1), ["k", "v"]) and O.is_sorted(d.limit(0), ["k"])
    assert O.global_rank(d.limit(0), ["k"]).count() == 0
    clash = O.global_rank(d.withColumns({"_range": F.lit(1), "_at": F.lit(2), "rank": F.lit(9)}), ["k"])
    assert clash.columns == ["k", "v", "f", "_range", "_at", "rank"] and clash.where("rank = 1").count() == 3


def test_order_violations_overall(spark):
    rows = [(i, v) for i, v in enumerate([3, 1, None, 0, 5, 5, 4])]
    df = spark.createDataFrame(rows, "i int, v int").repartition(4)
    assert tuple(O.order_violations(df, "v", ["i"]).first()) == (7, 2)


def test_order_sketches(spark):
    df = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(5)
    sketch = O.order_sketch(df, "t", k=256)
    assert sketch.count() < 256 * 12
    for cut in ("0", "3", "8", "fz"):
        exact, got = df.where(F.col("t") <= cut).count(), O.sketch_rank(sketch, cut).first()
        assert got["n"] == 20_000 and abs(got["rank"] - exact) < 800
    both = O.merge_order_sketches([sketch, O.order_sketch(df.where("t < '8'"), "t", k=256)], k=256)
    assert O.sketch_rank(both, "8").first()["n"] == 20_000 + df.where("t < '8'").count()
    assert O.order_sketch(df.limit(0), "t").count() == 0 and O.sketch_quantiles(sketch.limit(0), [0.5]).first()["value"] is None
    few = O.order_sketch(spark.createDataFrame([(b"b",), (b"a",), (None,)], "k binary"), "k").collect()
    assert sorted((bytes(r["value"]), r["weight"]) for r in few) == [(b"a", 1), (b"b", 1)]


def test_statistics_of_a_sort(spark):
    df = spark.range(0, 1000, 1, 3).select((F.col("id") * 37 % 1000).alias("k"))
    out, stats = P.sort_with_stats(df, SortSpec(["k"]), 4)
    assert sum(stats.run_rows) == sum(stats.entries) == out.count() == 1000 and stats.runs == 3 == stats.write_tasks and stats.read_tasks == 4
    assert stats.run_ms is not None and stats.merge_ms is not None and stats.shuffle_read_bytes == stats.shuffle_write_bytes > 0 and "generation" in str(stats)
