"""Generated records with uniform or Zipf keys, in parallel and repeatable by seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _payload(seed: int) -> Column:
    """90 bytes that look random, from the row number."""
    blocks = [F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit(i)).cast("binary"), 256)) for i in range(3)]
    return F.substring(F.concat(*blocks), 1, 90)


def uniform_records(spark: SparkSession, n: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n records whose 10-byte keys are uniform."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select(F.substring(F.unhex(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary"))), 1, 10).alias("key"), _payload(seed).alias("payload"))


def zeta(n: int, theta: float) -> float:
    """Sum of i ** -theta for i from 1 to n; beyond a million terms the tail by Euler and Maclaurin, right to 12 digits."""
    near = min(n, 1_000_000)
    total = math.fsum(i**-theta for i in range(1, near + 1))
    if n > near:
        a, b = float(near), float(n)
        total += (b ** (1 - theta) - a ** (1 - theta)) / (1 - theta) + (b**-theta - a**-theta) / 2 + theta * (a ** (-theta - 1) - b ** (-theta - 1)) / 12
    return total


def zipf_keys(spark: SparkSession, n: int, theta: float, items: int | None = None, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n draws of a Zipf rank in [0, items), skew theta in [0, 1): id and rank. The quick approximation with a closed form."""
    items = items or n
    if items < 1 or not 0 <= theta < 1:
        raise ValueError("theta must be in [0, 1) and there must be 1 item or more")
    whole = zeta(items, theta)
    power = 1 / (1 - theta)
    eta = (1 - (2 / items) ** (1 - theta)) / (1 - zeta(min(2, items), theta) / whole) if items > 2 else 1.0
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    u = F.rand(seed)
    draw = ids.withColumn("u", u)
    reach = F.col("u") * whole
    rank = F.when(reach < 1, 0).when(reach < 1 + 0.5**theta, 1).otherwise(F.floor(F.lit(float(items)) * F.pow(F.lit(eta) * F.col("u") - eta + 1, F.lit(power))))
    return draw.select("id", F.least(rank.cast("long"), F.lit(items - 1)).alias("rank"))


def zipf_records(spark: SparkSession, n: int, theta: float, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """n records whose keys are zero-padded Zipf ranks of 10 digits."""
    keys = zipf_keys(spark, n, theta, seed=seed, partitions=partitions)
    return keys.select(F.lpad(F.col("rank").cast("string"), 10, "0").cast("binary").alias("key"), _payload(seed).alias("payload"))
