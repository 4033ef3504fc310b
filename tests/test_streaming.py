from strandline.operators import is_sorted
from strandline.spec import SortSpec
from strandline.streaming import streaming_kll, write_sorted_batches


def test_batches_are_sorted_runs(spark, tmp_path):
    spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long").parquet(str(tmp_path / "in"))
    q = write_sorted_batches(stream, SortSpec(["k"]), str(tmp_path / "out"), str(tmp_path / "cp"), 2, once=True)
    q.awaitTermination()
    runs = list((tmp_path / "out").glob("batch=*"))
    assert runs and sum(spark.read.parquet(str(r)).count() for r in runs) == 1000
    for r in runs:
        for f in sorted(r.glob("*.parquet")):
            assert is_sorted(spark.read.parquet(str(f)), ["k"])


def test_sketch_of_a_stream(spark, tmp_path):
    spark.range(1000).selectExpr("timestamp_seconds(id) as ts", "cast(id as double) as v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = streaming_kll(stream, "v", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("kll_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("kll_test").selectExpr("sum(n)").first()[0] == 1000
