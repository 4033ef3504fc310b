import datetime as dt
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import functions as X

NAN, INF = float("nan"), float("inf")
CASES = [
    (T.IntegerType(), [-(2**31), -1, 0, 1, 2**31 - 1, None]),
    (T.LongType(), [-(2**63), -5, 0, 7, 2**63 - 1, None]),
    (T.FloatType(), [-INF, -1.5, 0.0, 1.5, INF, None]),
    (T.DoubleType(), [-INF, -1000.0, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1000.0, INF, None]),
    (T.DecimalType(15, 2), [Decimal("-999.99"), Decimal("0.00"), Decimal("0.01"), Decimal("123456.78"), None]),
    (T.DateType(), [dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 1, 1), None]),
    (T.StringType(), ["", "a", "aé", "b", None]),
    (T.BinaryType(), [b"", b"\0", b"\x7f", b"\xff", None]),
]


@pytest.mark.parametrize("kind,values", CASES, ids=lambda x: x.simpleString() if isinstance(x, T.DataType) else "")
def test_codec_keeps_order_and_comes_back(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    coded = df.withColumn("k", X.encode_key(F.col("v"), kind)).withColumn("back", X.decode_key(F.col("k"), kind))
    rows = sorted(coded.collect(), key=lambda r: r["i"])
    keys = [bytes(r["k"]) if r["k"] is not None else None for r in rows]
    assert keys[-1] is None and keys[:-1] == sorted(keys[:-1])
    assert [r["back"] for r in rows] == values


def test_known_bytes_and_wrong_lengths(spark):
    r = spark.range(1).select(
        X.encode_key(F.lit(-1), T.IntegerType()).alias("i"), X.encode_key(F.lit(-1.0), T.DoubleType()).alias("d"), X.decode_key(F.lit(bytearray(b"123")), T.IntegerType()).alias("short"),
        X.decode_key(F.lit(bytearray(b"123")), T.DoubleType()).alias("short_d"), X.decode_utf8(F.lit(bytearray(b"\xff"))).alias("bad"), X.decode_text(F.lit(bytearray(b"\x80\0\0\x05")), "Int32").alias("shown"),
        X.decode_text(F.lit(bytearray(b"abc")), "list").alias("other"), X.format_ce_days(F.lit(719163)).alias("day"), X.format_ce_days(F.lit(2**30)).alias("none"), X.encode_key(F.lit(NAN), T.DoubleType()).alias("nan"), X.encode_key(F.lit(INF), T.DoubleType()).alias("inf"),
    ).first()
    assert bytes(r["i"]) == b"\x7f\xff\xff\xff" and bytes(r["d"]) == bytes(255 - x for x in struct.pack(">d", -1.0))
    assert r["short"] is None and r["short_d"] is None and r["bad"] is None and r["shown"] == "5" and r["other"] == "<3 bytes>"
    assert r["day"] == "1970-01-01" and r["none"].startswith("Invalid") and bytes(r["nan"]) > bytes(r["inf"])
    with pytest.raises(TypeError):
        X.encode_key(F.lit(True), T.BooleanType())


def test_composite(spark):
    r = random.Random(6)
    rows = [(r.choice(["", "a", "ab", "b"]), r.randint(-9, 9), dt.date(2024, 1, r.randint(1, 28))) for _ in range(200)]
    df = spark.createDataFrame(rows, "s string, n int, d date")
    coded = df.withColumn("k", X.composite_key(df, ["s", "n", "d"]))
    parts = X.split_composite(F.col("k"), [T.StringType(), T.IntegerType(), T.DateType()])
    got = coded.select("k", *[p.alias(f"c{i}") for i, p in enumerate(parts)]).orderBy("k").collect()
    assert [tuple(x)[1:] for x in got] == sorted(rows)


def test_ovc_golden(spark):
    keys = [b"\1\2\3", b"\1\2\3", b"\1\2\3\0", b"\1\2\3\0\0", b"\x09\1\3", b"\x09\1\4", b"abcdefgh", b"abcdefgi"]
    df = spark.createDataFrame([(0, k) for k in keys], "run_id int, k binary")
    got = [tuple(r) for r in X.ovc_runs(df, "k").orderBy("k").select(*X.ovc_fields(F.col("ovc"))).collect()]
    assert got == [(3, None, None), (1, None, None), (2, 0, "010203000000"), (2, 0, "010203000000"), (2, 0, "090103000000"), (2, 0, "090104000000"), (2, 0, "616263646566"), (2, 6, "676900000000")]


def test_ovc_order_is_key_order_for_one_base(spark):
    r = random.Random(8)
    base = b"\0"
    keys = sorted({bytes(r.randint(0, 3) for _ in range(r.randint(1, 20))) for _ in range(300)} - {base})
    df = spark.createDataFrame([(k, base) for k in keys if k > base], "k binary, p binary")
    got = df.select("k", X.ovc_column(F.col("k"), F.col("p")).alias("c")).collect()
    for a, b in zip(sorted(got, key=lambda x: bytes(x["k"])), sorted(got, key=lambda x: bytes(x["k"]))[1:], strict=False):
        assert a["c"] <= b["c"]


def test_decimals_wide_and_narrow(spark):
    values = [Decimal(x) for x in ("-99999999999.99", "-1.25", "0.00", "0.01", "99999999999.99")]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "d decimal(13,2)")
    narrow, wide = T.DecimalType(13, 2), T.DecimalType(38, 2)
    rows = df.select("d", X.encode_key(F.col("d"), narrow).alias("n"), X.encode_key(F.col("d").cast(wide), wide).alias("w"))
    got = rows.select("d", "n", "w", X.decode_key(F.col("n"), narrow).alias("back"), X.decode_text(F.col("w"), "i128").alias("text")).collect()
    assert all(r["n"] == r["w"] and r["back"] == r["d"] for r in got) and [r["d"] for r in sorted((r for r in got if r["n"]), key=lambda r: bytes(r["n"]))] == values
    assert {r["text"] for r in got} == {"-9999999999999", "-125", "0", "1", "9999999999999", None}


def test_codes_of_partitions_are_those_of_runs(spark):
    keys = [b"", b"a", b"a", b"ab", b"ab\0", b"abcdef", b"abcdefg", b"abcdefghijkl", b"abcdefghijklm" * 5, b"b" * 9000, b"b" * 9001, b"\xff"]
    df = spark.createDataFrame([(k, 0) for k in sorted(keys)], "k binary, run_id int").coalesce(1).sortWithinPartitions("k")
    a, b = (sorted(map(str, x.select("k", "ovc").collect())) for x in (X.ovc_partitions(df, "k"), X.ovc_runs(df, "k")))
    assert a == b
