"""Trip records from many Parquet files of different shapes, brought to one shape."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns and their types.
TRIP_COLUMNS = {
    "vendorid": "bigint",
    "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz",
    "passenger_count": "double",
    "trip_distance": "double",
    "ratecodeid": "double",
    "store_and_fwd_flag": "string",
    "pulocationid": "bigint",
    "dolocationid": "bigint",
    "payment_type": "bigint",
    "fare_amount": "double",
    "extra": "double",
    "mta_tax": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "improvement_surcharge": "double",
    "total_amount": "double",
    "congestion_surcharge": "double",
    "airport_fee": "double",
}


def _one(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    have = {c.lower(): c for c in df.columns}
    shaped = []
    for name, kind in TRIP_COLUMNS.items():
        if name not in have:
            value = F.lit(None).cast(kind)
        else:
            value = F.col(f"`{have[name]}`")
            if kind == "bigint" and dict(df.dtypes)[have[name]] in ("double", "float"):
                value = F.floor(F.abs(value)) * F.signum(value)  # fractions are cut off
            value = value.try_cast(kind)
        shaped.append(value.alias(name))
    return df.select(*shaped)


def normalise_trips(spark: SparkSession, pattern: str, start_year: int | None = None) -> DataFrame:
    """All files of a glob in the 19 columns: names in lower case, missing columns and values that can't be cast as null.

    start_year leaves out files whose name, like trips_2019-03.parquet, has an earlier year, or none.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    paths = sorted(x.getPath().toString() for x in found)
    if start_year is not None:
        year = lambda path: int(m[1]) if (m := re.search(r"_(\d{4})-[^/]*$", path)) else -1
        paths = [x for x in paths if year(x) >= start_year]
    if not paths:
        raise FileNotFoundError(pattern)
    out = _one(spark, paths[0])
    for x in paths[1:]:
        out = out.unionByName(_one(spark, x))
    return out


def write_trips_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
