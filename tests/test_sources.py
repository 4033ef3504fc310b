import datetime as dt
import random
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from strandline import sources as S
from strandline.operators import range_scan
from strandline.spec import SortSpec

TEXT = T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())])


def _write(tmp_path, text, name="a.csv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_csv_splits_lose_and_repeat_nothing(spark, tmp_path):
    path = _write(tmp_path, "id,value\n" + "".join(f"{i:02d},val_{i:02d}\n" for i in range(20)))
    for size in ("16", "64", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted(r["id"] for r in S.read_csv(spark, path, TEXT).collect())
        assert got == [f"{i:02d}" for i in range(20)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_empty_fields_are_empty_text(spark, tmp_path):
    path = _write(tmp_path, "id,value\n,empty_key\nnormal,\nkey1,value1\n,\n")
    assert sorted(map(tuple, S.read_csv(spark, path, TEXT).collect())) == [("", ""), ("", "empty_key"), ("key1", "value1"), ("normal", "")]


def test_csv_rows_that_are_left_out(spark, tmp_path):
    schema = T.StructType([*TEXT.fields, T.StructField("d", T.DateType()), T.StructField("n", T.IntegerType())])
    path = _write(tmp_path, 'id,value,d,n\n1,"a,""q""",2024-01-01,5\n2,b,2024-01-02, 8\n3,short\n4,c,2024,7\n5,d,2024-01-06,12f\n\n6,"",2024-02-02,9,more\r\n7,mid"d,l"e,2024-1-2,1\n')
    got = {r["id"]: (r["value"], r["d"], r["n"]) for r in S.read_csv(spark, path, schema).collect()}
    assert got == {"1": ('a,"q"', dt.date(2024, 1, 1), 5), "6": ("", dt.date(2024, 2, 2), 9), "7": ("midd,le", dt.date(2024, 1, 2), 1)}
    assert S.read_csv(spark, path, schema, [0, 1]).count() == 7  # fields that aren't selected can't spoil a row


def test_csv_delimiters_and_errors(spark, tmp_path):
    path = _write(tmp_path, "name|age|city\nA|1|X\nB|2|Y\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "age", "city")])
    assert sorted(map(tuple, S.read_csv(spark, path, schema, [0, 2], sep="pipe").collect())) == [("A", "X"), ("B", "Y")]
    assert S.read_text_columns(spark, path, sep="|").columns == ["col_0", "col_1", "col_2"]
    with pytest.raises(IndexError):
        S.read_csv(spark, path, schema, [7])
    with pytest.raises(ValueError):
        S.read_csv(spark, path, schema, [])
    with pytest.raises(ValueError):
        S.read_csv(spark, _write(tmp_path, "", "empty.csv"), schema)
    with pytest.raises(FileNotFoundError):
        S.read_csv(spark, str(tmp_path / "none.csv"), schema)


def test_parquet_types_ordinals_and_length(spark, tmp_path):
    t = pa.table({
        "s": pa.array(["b", "a", "c"]), "i": pa.array([100, -50, 0], pa.int32()), "f": [10.5, -5.5, 0.0], "b": pa.array([b"\xff", b"\x00", b"\x7f"]),
        "d": pa.array([dt.date(2022, 1, 8), dt.date(2022, 1, 7), dt.date(2022, 1, 9)]), "x": pa.array([Decimal("12.00"), Decimal("10.00"), Decimal("11.00")], pa.decimal128(10, 2)),
    })
    pq.write_table(t, tmp_path / "t.parquet", compression="GZIP", row_group_size=1)
    path = str(tmp_path / "t.parquet")
    assert S.parquet_length(spark, path) == 3
    assert S.read_parquet(spark, path, [3, "s", 0]).columns == ["b", "s", "s_2"]
    with pytest.raises(IndexError):
        S.read_parquet(spark, path, [9])
    for c in t.column_names:
        got = [r[0] for r in S.read_parquet(spark, path, [c]).orderBy(c).collect()]
        assert got == sorted(t[c].to_pylist())


def test_gensort(spark, tmp_path):
    rows = [(f"key{i:07d}".encode(), bytes([i % 256]) * 90) for i in range(1000)]
    random.Random(1).shuffle(rows)
    (tmp_path / "r.bin").write_bytes(b"".join(k + v for k, v in rows))
    df = S.read_gensort(spark, str(tmp_path / "r.bin"))
    got = [(bytes(r["key"]), bytes(r["payload"])) for r in df.orderBy("key").collect()]
    assert got == sorted(rows)
    (tmp_path / "bad.bin").write_bytes(bytes(150))
    with pytest.raises(ValueError):
        S.read_gensort(spark, str(tmp_path / "bad.bin"))
    (tmp_path / "none.bin").write_bytes(b"")
    assert S.read_gensort(spark, str(tmp_path / "none.bin")).count() == 0
    S.write_gensort(df.orderBy("key"), str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))) == b"".join(k + v for k, v in sorted(rows))


def test_sorted_files_are_in_order_and_prune(spark, tmp_path):
    df = spark.range(10_000).selectExpr("(id * 7919) % 10000 as k", "id as v")
    spec = SortSpec(["k"], ["v"], partitions=4)
    S.write_sorted(df, str(tmp_path / "s"), spec)
    files = sorted((tmp_path / "s").glob("*.parquet"))
    keys = [x for f in files for x in pq.read_table(f)["k"].to_pylist()]
    assert keys == sorted(keys) and len(keys) == 10_000
    scan = range_scan(S.read_parquet(spark, str(tmp_path / "s")), "k", 100, 200)
    assert "GreaterThanOrEqual(k,100)" in scan._jdf.queryExecution().executedPlan().toString() and scan.count() == 100
    assert [r["k"] for r in S.iterate(scan.orderBy("k"))] == list(range(100, 200))


def test_generators(spark):
    a = S.zipf_records(spark, 2000, 0.9, partitions=3)
    assert a.where("length(key) = 10 and length(payload) = 90").count() == 2000
    ranks = S.zipf_keys(spark, 20_000, 0.9).groupBy("rank").count().orderBy("rank").limit(3).collect()
    assert ranks[0]["count"] > ranks[1]["count"] > ranks[2]["count"] > 100
    even = S.zipf_keys(spark, 20_000, 0.0, items=10).groupBy("rank").count().collect()
    assert len(even) == 10 and max(r["count"] for r in even) < 1.3 * min(r["count"] for r in even)
    with pytest.raises(ValueError):
        S.zipf_keys(spark, 10, 1.0)
    assert S.uniform_records(spark, 100).collect() == S.uniform_records(spark, 100).collect()


def test_trips(spark, tmp_path):
    pq.write_table(pa.table({"VendorID": [1.0, 2.0], "fare_amount": [3, 4], "extra": ["1.5", "x"]}), tmp_path / "trips_2018-01.parquet")
    pq.write_table(pa.table({"vendorid": [7], "Airport_fee": [1.25], "tpep_pickup_datetime": pa.array([dt.datetime(2020, 1, 1)], pa.timestamp("us"))}), tmp_path / "trips_2020-01.parquet")
    df = S.normalise_trips(spark, str(tmp_path / "trips_*.parquet"))
    assert df.columns == list(S.TRIP_COLUMNS) and df.count() == 3
    got = {r["vendorid"]: r for r in df.collect()}
    assert got[1]["fare_amount"] == 3.0 and got[1]["extra"] == 1.5 and got[2]["extra"] is None and got[7]["airport_fee"] == 1.25
    assert S.normalise_trips(spark, str(tmp_path / "trips_*.parquet"), 2019).count() == 1
    with pytest.raises(FileNotFoundError):
        S.normalise_trips(spark, str(tmp_path / "none_*.parquet"))


def test_in_memory(spark):
    assert S.from_rows(spark, [(b"a", b"1")], partitions=2).count() == 1
    with pytest.raises(ValueError):
        S.from_rows(spark, [], partitions=0)


def test_csv_fields_of_any_length(spark, tmp_path):
    plain, quotes, pieces = "x" * 1_000_000, '""' * 250_000, '"a,",b' * 200_000
    (tmp_path / "long.csv").write_text(f'a,b\n{plain},1\n"{quotes}",2\n{pieces.replace(",b", "b")},3\n"open,4\n')
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    got = {r["b"]: r["a"] for r in S.read_csv(spark, str(tmp_path / "long.csv"), schema).collect()}
    assert got == {1: plain, 2: '"' * 250_000, 3: "a,b" * 200_000}  # an open quote takes the rest of its line, so that row lacks a column


def test_records_of_a_wrong_size(spark, tmp_path):
    with pytest.raises(Exception, match="a record has a key of 10"):
        S.write_gensort(spark.createDataFrame([(b"k" * 10, b"v" * 90), (b"k" * 9, b"v" * 90)], "key binary, payload binary").coalesce(1), str(tmp_path / "r"))
