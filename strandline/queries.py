"""Registered queries over the driver's tables, and DuckDB SQL for each that SQL can express.

Results are compared without regard to row order, so every sort shows its order as data: a rank, a row number, a bucket, a flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as X
from . import operators as O
from . import plans as P
from . import sources as S
from .scratch import fresh as scratch
from .sources.generate import zeta
from .spec import SortSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEYS = ["l_shipdate", "l_extendedprice", "l_partkey"]


@query("""
SELECT l_shipdate, l_extendedprice, l_partkey, l_orderkey, l_linenumber,
       rank() OVER (ORDER BY l_shipdate NULLS FIRST, l_extendedprice NULLS FIRST, l_partkey NULLS FIRST) AS rank
FROM lineitem""")
def sort_shipdate_price_part(spark, sf_dir):
    rows = SortSpec(LINE_KEYS, ["l_orderkey", "l_linenumber"]).project(table(spark, sf_dir, "lineitem"))
    return O.global_rank(rows, LINE_KEYS)


@query("SELECT o_orderdate, o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_totalprice NULLS FIRST, o_orderkey NULLS FIRST) AS rn FROM orders")
def sort_orders_rownum(spark, sf_dir):
    keys = ["o_orderdate", "o_totalprice", "o_orderkey"]
    return O.global_rank(table(spark, sf_dir, "orders").select(*keys), keys, "row_number", "rn")


@query("SELECT doc_id, rank() OVER (ORDER BY text NULLS FIRST) AS rank FROM documents")
def sort_string_bytes(spark, sf_dir):
    return O.global_rank(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).drop("text")


@query("SELECT event_id, user_id, ts, rank() OVER (ORDER BY ts NULLS FIRST, user_id NULLS FIRST) AS rank FROM events")
def events_composite_sort(spark, sf_dir):
    return O.global_rank(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["ts", "user_id"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, rank() OVER (ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST) AS rank FROM lineitem")
def low_cardinality_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return O.rank_by_distinct(rows, ["l_returnflag", "l_linestatus"])


@query("SELECT l_orderkey, l_shipdate, dense_rank() OVER (ORDER BY l_shipdate NULLS FIRST) AS day_number FROM lineitem")
def sort_dense_rank(spark, sf_dir):
    return O.global_rank(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), ["l_shipdate"], "dense_rank", "day_number")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC NULLS LAST) AS rank FROM orders")
def sort_descending(spark, sf_dir):
    """Extension: another direction."""
    return O.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], descending=True, nulls_last=True).drop("o_totalprice")


@query("SELECT doc_id, rank() OVER (ORDER BY text DESC NULLS FIRST) AS rank FROM documents")
def sort_descending_text(spark, sf_dir):
    return O.global_rank(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], descending=True).drop("text")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice ASC NULLS FIRST, o_orderkey) AS rn FROM orders")
def sort_mixed_directions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return O.global_rank(rows, ["o_orderstatus", "o_totalprice"], "row_number", "rn", tie=["o_orderkey"], descending=[True, False], nulls_last=[True, False]).select("o_orderkey", "rn")


@query("SELECT o_orderkey, cume_dist() OVER (ORDER BY o_orderdate DESC NULLS LAST) AS share FROM orders")
def sort_cume_dist(spark, sf_dir):
    return O.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"], "cume_dist", "share", descending=True, nulls_last=True).drop("o_orderdate")


@query("SELECT o_orderkey, rank() OVER (ORDER BY coalesce(o_orderstatus, ''), coalesce(strftime(o_orderdate, '%Y-%m-%d'), '')) AS rank FROM orders")
def text_sort(spark, sf_dir):
    """Order of the text forms of two columns: each row's place among the sorted ranges."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("d"))
    done = O.text_sort(rows, ["o_orderstatus", "d"], 4)
    return O.global_rank(done.select("o_orderkey", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("o_orderstatus", "d")]), ["o_orderstatus", "d"]).select("o_orderkey", "rank")


TOP = SortSpec([*LINE_KEYS, "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax"])
_TOP_SQL = "SELECT l_shipdate, l_extendedprice, l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem ORDER BY {} LIMIT 10"


@query(_TOP_SQL.format("1, 2, 3, 4, 5, 6, 7, 8, 9"))
def topk_lineitem(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "lineitem"), TOP, 10)


@query(_TOP_SQL.format(", ".join(f"{i} DESC" for i in range(1, 10))))
def bottomk_lineitem(spark, sf_dir):
    return O.bottom_k(table(spark, sf_dir, "lineitem"), TOP, 10)


@query("SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 1")
def offset_orders(spark, sf_dir):
    return O.offset_limit(table(spark, sf_dir, "orders"), SortSpec(["o_orderdate", "o_orderkey"]), 1, 20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000.0 AND o_totalprice < 200000.0")
def range_scan_half_open(spark, sf_dir):
    return O.range_scan(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100000.0, 200000.0)


@query("""
SELECT 'below' AS part, count(*) AS n FROM orders WHERE o_totalprice < 100000.0 UNION ALL
SELECT 'from', count(*) FROM orders WHERE o_totalprice >= 100000.0 UNION ALL
SELECT 'none', 0 UNION ALL SELECT 'all', count(*) FROM orders""")
def range_scan_bounds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice")
    asked = {"below": (None, 1e5), "from": (1e5, None), "none": (1e5, 1e5), "all": (None, None)}
    out = None
    for name, (lo, hi) in asked.items():
        n = O.range_scan(rows, "o_totalprice", lo, hi).agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-03-01'")
def sorted_files_range_scan(spark, sf_dir):
    """Sorted files written, then a key range of them read: row groups outside it are skipped."""
    path = scratch(spark, "sorted")
    spec = SortSpec(["l_shipdate"], ["l_orderkey", "l_extendedprice"])
    S.write_sorted(spec.project(table(spark, sf_dir, "lineitem")), path, spec, 8)
    from datetime import datetime

    rows = O.range_scan(S.read_parquet(spark, path), "l_shipdate", datetime(1995, 1, 1), datetime(1995, 3, 1))
    return rows.select("l_orderkey", "l_extendedprice")


@query("SELECT DISTINCT l_linenumber, printf('%08x', l_linenumber::BIGINT + 2147483648) AS code FROM lineitem")
def encode_i32(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return rows.withColumn("code", F.lower(F.hex(X.encode_key(F.col("l_linenumber"), T.IntegerType()))))


@query("SELECT o_orderkey, printf('%016x', (-o_orderkey)::HUGEINT + 9223372036854775808::HUGEINT) AS code FROM orders")
def encode_i64(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return rows.withColumn("code", F.lower(F.hex(X.encode_key(-F.col("o_orderkey"), T.LongType()))))


@query("SELECT DISTINCT o_orderdate::DATE AS d, datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 719163 AS ce_days, strftime(o_orderdate::DATE, '%Y-%m-%d') AS shown FROM orders")
def encode_date_ce(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select("d", X.days_from_ce(F.col("d")).cast("long").alias("ce_days")).withColumn("shown", X.format_ce_days(F.col("ce_days")))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice - 150000) AS rank FROM orders")
def encode_f64_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.encode_key(F.col("o_totalprice") - 150000, T.DoubleType()).alias("k"))
    return O.global_rank(rows, ["k"]).drop("k")


@query("SELECT o_orderkey, rank() OVER (ORDER BY (o_totalprice - 150000)::FLOAT) AS rank FROM orders")
def encode_f32_rank(spark, sf_dir):
    v = (F.col("o_totalprice") - 150000).cast("float")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.encode_key(v, T.FloatType()).alias("k"))
    return O.global_rank(rows, ["k"]).drop("k")


@query("SELECT o_orderkey, rank() OVER (ORDER BY (o_totalprice - 150000)::DECIMAL(15,2)) AS rank FROM orders")
def encode_decimal_rank(spark, sf_dir):
    kind = T.DecimalType(15, 2)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.encode_key((F.col("o_totalprice") - 150000).cast(kind), kind).alias("k"))
    return O.global_rank(rows, ["k"]).drop("k")


@query("SELECT o_orderkey, o_orderkey AS k, o_totalprice AS price, o_orderdate::DATE AS d, o_orderstatus AS status FROM orders")
def decode_composite(spark, sf_dir):
    """Key bytes of four columns, taken apart again."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("status"))
    names = ["k", "price", "d", "status"]
    keyed = rows.select("o_orderkey", X.composite_key(rows, names).alias("key"))
    parts = X.split_composite(F.col("key"), [rows.schema[c].dataType for c in names])
    return keyed.select("o_orderkey", *[p.alias(c) for p, c in zip(parts, names, strict=True)])


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority, o_orderdate::DATE, o_orderkey) AS rank FROM orders")
def composite_key_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    rows = rows.select("o_orderkey", X.composite_key(rows, ["o_orderpriority", "d", "o_orderkey"]).alias("k"))
    return O.global_rank(rows, ["k"]).drop("k")


@query("""
WITH s AS (SELECT c_nationkey AS run_id, c_custkey, c_name AS k, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name) AS p FROM customer),
c AS (SELECT *, [i FOR i IN range(0, length(k) // 6 + 1) IF substr(k, i * 6 + 1, 6) <> substr(p, i * 6 + 1, 6)][1] AS step FROM s)
SELECT run_id, c_custkey,
       CASE WHEN p IS NULL THEN 3 WHEN k = p THEN 1 ELSE 2 END AS flag,
       CASE WHEN p IS NOT NULL AND k <> p THEN (step * 6)::INTEGER END AS "offset",
       CASE WHEN p IS NOT NULL AND k <> p THEN rpad(lower(hex(substr(k, step * 6 + 1, 6))), 12, '0') END AS value
FROM c""")
def ovc_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), "c_custkey", F.col("c_name").cast("binary").alias("k"))
    return X.ovc_runs(rows, "k").select("run_id", "c_custkey", *X.ovc_fields(F.col("ovc")))


@query("SELECT count(*) AS n_rows, count(*) - count(DISTINCT o_orderdate::DATE) AS n_duplicate, 4::BIGINT AS n_first, 4::BIGINT AS n_ranges FROM orders")
def sort_with_codes(spark, sf_dir):
    """The sort by offset-value codes: equal keys get a duplicate's code, and each range begins anew."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    out = O.global_sort(rows, SortSpec(["d"], ["o_orderkey"], partitions=4, method="ovc")).withColumn("p", F.spark_partition_id())
    flag = X.ovc_fields(F.col("ovc"))[0]
    return out.select("p", flag).agg(F.count("*").alias("n_rows"), F.sum((F.col("flag") == 1).cast("long")).alias("n_duplicate"), F.sum((F.col("flag") == 3).cast("long")).alias("n_first"), F.count_distinct("p").alias("n_ranges"))


_KINDS = {"i64": ("o_orderkey", T.LongType()), "f64": ("o_totalprice", T.DoubleType()), "date32": ("d", T.DateType()), "utf8": ("o_orderstatus", T.StringType()), "i128": ("cents", T.DecimalType(15, 2)), "other": ("o_orderkey", T.LongType())}


@query("""
SELECT o_orderkey AS id, o_orderkey::VARCHAR AS i64, o_totalprice AS f64, strftime(o_orderdate::DATE, '%Y-%m-%d') AS date32, o_orderstatus AS utf8,
       round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT::VARCHAR AS i128, '<8 bytes>' AS other FROM orders""")
def decode_by_name(spark, sf_dir):
    """Keys in bytes and their readable forms by type name; the double is cast back, as engines write it in different ways."""
    rows = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date")).withColumn("cents", F.col("o_totalprice").cast("decimal(15,2)"))
    text = {n: X.decode_text(X.encode_key(F.col(c), kind), n) for n, (c, kind) in _KINDS.items()}
    text["f64"] = text["f64"].cast("double")
    return rows.select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in text.items()])


@query("SELECT c_custkey, c_name AS name, c_custkey % 3 = 0 AS broken FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, NULL, true FROM customer WHERE c_custkey % 3 = 0")
def decode_utf8(spark, sf_dir):
    """Bytes as text; those that aren't UTF-8 give null."""
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_name").cast("binary"), F.lit(bytearray(b"\xff")))).otherwise(F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.decode_utf8(raw).alias("name"), (F.col("c_custkey") % 3 == 0).alias("broken"))


_PS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, quantile_disc(o_totalprice, {p}) AS value FROM orders" for p in _PS))
def quantiles_exact(spark, sf_dir):
    return O.exact_quantiles(table(spark, sf_dir, "orders"), "o_totalprice", list(_PS))


@query(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, quantile_disc(c_name, {p}) AS value FROM customer" for p in _PS))
def quantiles_of_text(spark, sf_dir):
    return O.exact_quantiles(table(spark, sf_dir, "customer"), "c_name", list(_PS))


@query("SELECT DISTINCT o_orderdate AS value, cume_dist() OVER (ORDER BY o_orderdate) AS probability FROM orders")
def cdf_orders(spark, sf_dir):
    return O.cdf(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT sum((o_totalprice <= 100000.0)::BIGINT)::BIGINT AS rank, count(*) AS n FROM orders")
def rank_of_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(O.rank_of("o_totalprice", 100000.0).alias("rank"), F.count("*").alias("n"))


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def price_histogram(spark, sf_dir):
    return O.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20).select("bin", "n")


def near_exact(rows: DataFrame, column: str, quantiles: DataFrame, bound: float) -> DataFrame:
    """p, the number of rows, and whether the share of rows up to the value given is within the bound of p."""
    got = quantiles.collect()  # a row for each p asked for
    near = [F.struct(F.lit(r["p"]).alias("p"), F.count("*").alias("n"), (F.abs(F.avg((F.col(column) <= F.lit(r["value"])).cast("double")) - r["p"]) <= bound).alias("near")) for r in got]
    return rows.agg(F.array(*near).alias("q")).select(F.explode("q").alias("q")).select("q.p", "q.n", "q.near")


def _near_sql(name: str) -> str:
    return " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, count(*) AS n, true AS near FROM {name}" for p in _PS)


@query(_near_sql("orders"))
def kll_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_totalprice")
    return near_exact(rows, "o_totalprice", O.kll_quantiles(rows, "o_totalprice", list(_PS)), 0.03)


@query("SELECT count(*) AS n, true AS near FROM orders")
def kll_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    exact = rows.agg(O.rank_of("o_totalprice", 100000.0)).first()[0]
    return O.kll_rank(rows, "o_totalprice", 100000.0).select("n", (F.abs(F.col("rank") - exact) <= 0.03 * F.col("n")).alias("near"))


@query("SELECT count(*) AS n, true AS near, true AS shown FROM orders")
def kll_merged(spark, sf_dir):
    """A sketch for each order status, stored as rows, and then one of all."""
    rows = table(spark, sf_dir, "orders")
    stored = rows.groupBy("o_orderstatus").agg(F.kll_sketch_agg_double("o_totalprice").alias("sketch"))
    share = F.kll_sketch_get_rank_double("sketch", F.lit(100000.0))
    exact = rows.agg(F.avg((F.col("o_totalprice") <= 100000.0).cast("double"))).first()[0]
    return O.kll_merge(stored, "double").select("n", (F.abs(share - exact) <= 0.03).alias("near"), (F.length("text") > 0).alias("shown"))


@query(_near_sql("documents"))
def sketch_of_text(spark, sf_dir):
    """Quantiles of whole texts from an order sketch, which takes any type that has an order."""
    rows = table(spark, sf_dir, "documents").select("text")
    return near_exact(rows, "text", O.sketch_quantiles(O.order_sketch(rows, "text"), list(_PS)), 0.03)


@query("SELECT count(*) AS n, true AS near FROM customer")
def sketches_merged(spark, sf_dir):
    """Order sketches of binary keys, one a region's half, merged afterwards."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").cast("binary").alias("k"))
    both = O.merge_order_sketches([O.order_sketch(rows.where(F.col("c_nationkey") % 2 == i), "k") for i in (0, 1)])
    cut = bytearray(b"Customer#000000700")
    exact = rows.agg(O.rank_of("k", cut)).first()[0]
    return O.sketch_rank(both, cut).select("n", (F.abs(F.col("rank") - exact) <= 0.03 * F.col("n")).alias("near"))


@query("SELECT o_orderkey, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS bucket FROM orders")
def range_buckets(spark, sf_dir):
    """Four buckets of equal depth, from exact positions: the first n % 4 have one row more."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    n = rows.count()
    placed = O.global_rank(rows, ["o_totalprice", "o_orderkey"], "row_number", "at")
    small, more = divmod(n, 4)
    at = F.col("at") - 1
    bucket = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / max(1, small)))
    return placed.select("o_orderkey", (bucket + 1).cast("long").alias("bucket"))


@query("SELECT 4::BIGINT AS ranges, count(*) AS n, true AS even FROM orders")
def split_point_ranges(spark, sf_dir):
    """Rows in each half-open range between sampled split points: they follow the sample, so only their number, sum and evenness are facts."""
    rows = table(spark, sf_dir, "orders").select("o_totalprice")
    cuts = [c[0] for c in O.split_points(rows, ["o_totalprice"], 4)]
    n = rows.groupBy(O.bucket_by(F.col("o_totalprice"), cuts).alias("range")).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("ranges"), F.sum("n").alias("n"), (F.max("n") <= 0.4 * F.sum("n")).alias("even"))


@query("SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders) WHERE position % 1000 = 0")
def systematic_sample(spark, sf_dir):
    return O.systematic_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1000, ["o_orderkey"]).select("o_orderkey", "position")


@query("SELECT l_returnflag, least(count(*), 100) AS n, least(count(*), 100) AS n_real, true AS again FROM lineitem GROUP BY 1")
def reservoir_sample(spark, sf_dir):
    """At most 100 rows a group, all of them real rows, and the same ones for the same seed."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    one, two = (O.reservoir(rows, "l_returnflag", 100, seed=5).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.xxhash64("l_orderkey", "l_linenumber").cast("decimal(38,0)")).alias("digest")) for _ in "ab")
    real = O.reservoir(rows, "l_returnflag", 100, seed=5).join(rows.distinct(), rows.columns, "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n_real"))
    return one.join(two.withColumnRenamed("digest", "digest2").drop("n"), "l_returnflag").join(real, "l_returnflag").select("l_returnflag", "n", "n_real", (F.col("digest") == F.col("digest2")).alias("again"))


@query("""
SELECT count(*) AS n_rows, sum((value < before)::BIGINT)::BIGINT AS n_violations
FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def order_violations(spark, sf_dir):
    return O.order_violations(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], ["user_id"])


@query("SELECT count(*) AS n_rows, sum((value < before)::BIGINT)::BIGINT AS n_violations FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events)")
def order_violations_overall(spark, sf_dir):
    return O.order_violations(table(spark, sf_dir, "events").select("event_id", "value"), "value", ["event_id"])


@query("SELECT count(*) AS n_rows, true AS sorted, false AS shuffled_sorted, sum(l_orderkey)::BIGINT AS content FROM lineitem")
def verify_sorted(spark, sf_dir):
    """The sorted frame is in order, the one dealt out by another column is not, and the rows are the same."""
    rows = table(spark, sf_dir, "lineitem")
    done = O.global_sort(rows, SortSpec(LINE_KEYS, ["l_orderkey"], partitions=8))
    other = rows.repartition(4, "l_orderkey")
    return done.agg(F.count("*").alias("n_rows"), F.lit(O.is_sorted(done, LINE_KEYS)).alias("sorted"), F.lit(O.is_sorted(other, LINE_KEYS)).alias("shuffled_sorted"), F.sum("l_orderkey").cast("long").alias("content"))


@query("SELECT (o_orderkey % 4)::INTEGER AS run_id, o_orderkey, rank() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_totalprice) AS rank FROM orders")
def sorted_runs(spark, sf_dir):
    """Four runs, each sorted where it lies: a row's place in its run."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartitionById(4, (F.col("o_orderkey") % 4).cast("int"))
    runs = O.generate_runs(rows, SortSpec(["o_totalprice"], ["o_orderkey"]))
    at = F.monotonically_increasing_id() - F.shiftleft(F.col("run_id").cast("long"), 33)
    same = W.partitionBy("run_id", "o_totalprice")
    return runs.withColumn("at", at).select("run_id", "o_orderkey", (F.min("at").over(same) + 1).alias("rank"))


@query("SELECT count(*) AS n_rows, 4::BIGINT AS n_ranges, 0::BIGINT AS n_overlaps, true AS sorted, sum(o_orderkey)::BIGINT AS content FROM orders")
def merged_runs(spark, sf_dir):
    """Runs merged in parallel: each merge range is sorted, and no range reaches into the next."""
    spec = SortSpec(["o_totalprice"], ["o_orderkey"])
    merged = O.parallel_merge(O.generate_runs(table(spark, sf_dir, "orders"), spec, 6), spec, 4)
    ends = merged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n"), F.sum("o_orderkey").alias("content"))
    before = F.lag("hi").over(W.partitionBy().orderBy("p"))  # a row for each range
    seen = ends.withColumn("over", F.coalesce((before > F.col("lo")).cast("long"), F.lit(0)))
    return seen.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ranges"), F.sum("over").alias("n_overlaps"), F.lit(O.is_sorted(merged, ["o_totalprice"])).alias("sorted"), F.sum("content").cast("long").alias("content"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') AS keys FROM customer GROUP BY 1")
def sorted_arrays(spark, sf_dir):
    """Lists small enough to be one value, each in order."""
    lists = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("keys"))
    return lists.select("c_nationkey", F.array_join(O.sort_column_array("keys").cast("array<string>"), ",").alias("keys"))


@query("SELECT n_name, n_nationkey, row_number() OVER (ORDER BY n_name) AS at FROM nation")
def iterate_in_order(spark, sf_dir):
    """A sorted result iterated twice, a partition at a time, in order."""
    rows = O.global_sort(table(spark, sf_dir, "nation"), SortSpec(["n_name"], ["n_nationkey"], partitions=3))
    once, again = ([tuple(r) for r in S.iterate(rows)] for _ in "ab")  # nation has 25 rows
    assert once == again
    return spark.createDataFrame([(*r, i) for i, r in enumerate(once, 1)], "n_name string, n_nationkey long, at long").select("n_name", F.col("n_nationkey").cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), "at")


@query("SELECT 0::BIGINT AS n_rows, 'key,src,value' AS columns")
def merge_of_nothing(spark, sf_dir):
    none = O.merge_sorted([], SortSpec(["key"], ["value"]))
    return none.agg(F.count("*").alias("n_rows"), F.lit(",".join(sorted(none.columns))).alias("columns"))


@query("SELECT count(*) AS run_rows, count(*) AS entries, 4::BIGINT AS ranges, true AS timed, true AS moved FROM orders")
def sort_statistics(spark, sf_dir):
    """What a sort says of itself: rows of its runs and ranges, times, bytes."""
    _, stats = P.sort_with_stats(table(spark, sf_dir, "orders"), SortSpec(["o_totalprice"], ["o_orderkey"]), 4)
    timed = None not in (stats.run_ms, stats.merge_ms) and stats.runs == stats.write_tasks > 0
    moved = stats.shuffle_write_bytes > 0 and 0.9 < (stats.read_amplification() or 0) < 1.1
    return spark.createDataFrame([(sum(stats.run_rows), sum(stats.entries), len(stats.entries), timed, moved)], "run_rows long, entries long, ranges long, timed boolean, moved boolean")


@query("SELECT unnest([1, 4])::BIGINT AS partitions, (SELECT count(*) FROM lineitem) AS rows, true AS timed")
def scan_scaling(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    got = P.scan_scaling(lambda n: rows.coalesce(n) if n == 1 else rows.repartition(n), [1, 4], 0, 1)
    return spark.createDataFrame([(r["partitions"], r["rows"], r["rows_per_second"] > 0) for r in got], "partitions long, rows long, timed boolean")


@query("SELECT name, (SELECT count(*) FROM orders) AS rows, true AS sorted FROM (VALUES ('TinyRuns_MaxParallelGen_SerialMerge'), ('HugeRuns_SerialGen_MaxParallelMerge')) t(name)")
def sort_benchmark(spark, sf_dir):
    got = P.sort_benchmark(table(spark, sf_dir, "orders"), SortSpec(["o_totalprice"], ["o_orderkey"]), [64.0], [4], P.POLICIES[:2], 0, 1, verify=True)
    return spark.createDataFrame([(r["policy"], r["rows"], r["sorted"]) for r in got], "name string, rows long, sorted boolean")


@query("SELECT l_partkey, count(*) AS n, sum((dup > 1)::BIGINT)::BIGINT AS n_duplicate FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey) AS dup FROM lineitem) GROUP BY 1")
def duplicate_flag(spark, sf_dir):
    rows = O.duplicate_flags(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])
    return rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("duplicate").cast("long")).alias("n_duplicate"))


@query("""
WITH u AS (SELECT o_orderdate AS k, o_orderkey AS id, 0 AS src FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
           SELECT o_orderdate, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, id, src, rank() OVER (ORDER BY k, src) AS rank FROM u""")
def merge_sorted_streams(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("k"), F.col("o_orderkey").alias("id"))
    spec = SortSpec(["k"], ["id"])
    merged = O.merge_sorted([rows.where("id % 2 = 0").orderBy("k"), rows.where("id % 2 = 1").orderBy("k")], spec)
    return O.global_rank(merged, ["k", "src"])


@query("""
WITH c AS (SELECT o_orderkey % 8 AS b, count(*) AS entries FROM orders GROUP BY 1)
SELECT count(*) AS partitions, sum(entries)::BIGINT AS total, avg(entries) AS avg, min(entries) AS min, max(entries) AS max,
       round(stddev_pop(entries), 9) AS std_dev, round(stddev_pop(entries) / avg(entries) * 100, 9) AS cv_percent, max(entries)::DOUBLE / min(entries) AS imbalance FROM c""")
def partition_imbalance(spark, sf_dir):
    """Of eight real partitions, which hold what the key's remainder says."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey").repartitionById(8, (F.col("o_orderkey") % 8).cast("int"))
    out = P.partition_imbalance(P.partition_counts(rows))
    return out.withColumn("std_dev", F.round("std_dev", 9)).withColumn("cv_percent", F.round("cv_percent", 9))


@query("SELECT sum(length(o_orderpriority) + 2 + 9 + 9)::BIGINT AS bytes FROM orders")
def sort_bytes_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.agg(F.sum(sum((P.column_bytes(rows, c) for c in ("o_orderkey", "o_totalprice")), P.column_bytes(rows, "o_orderpriority"))).alias("bytes"))


@query("SELECT count(*) AS n, true AS near FROM orders")
def sort_size_estimate(spark, sf_dir):
    """The size estimated from a sample is within a tenth of the sum over all rows."""
    rows = table(spark, sf_dir, "orders")
    mb = P.estimate_sort_mb(rows, SortSpec(["o_orderpriority"], ["o_orderkey", "o_totalprice"]))
    exact = sum((P.column_bytes(rows, c) for c in ("o_orderkey", "o_totalprice")), P.column_bytes(rows, "o_orderpriority"))
    return rows.agg(F.count("*").alias("n"), (F.abs(F.sum(exact) / 1024**2 - mb) <= 0.1 * mb).alias("near"))


@query("SELECT * FROM (VALUES (0, '3 B'), (1, '3.00 KB'), (2, '3.00 MB'), (3, '3.00 GB'), (4, '3.00 TB')) t(power, shown)")
def human_sizes(spark, sf_dir):
    return spark.createDataFrame([(i, P.human_bytes(3 * 1024**i)) for i in range(5)], "power int, shown string")


@query("""
WITH c AS (SELECT 4096.0::DOUBLE AS m, 32768.0::DOUBLE AS d, 64.0::DOUBLE / 1024 AS p, 32.0::DOUBLE AS t),
b AS (SELECT *, m / sqrt(d * p) AS bal FROM c),
r AS (SELECT 'TinyRuns_MaxParallelGen_SerialMerge' AS name, d * p / m AS run, b.* FROM b UNION ALL
      SELECT 'HugeRuns_SerialGen_MaxParallelMerge', m, b.* FROM b UNION ALL
      SELECT 'MediumRuns_BalancedParallelism', m / bal, b.* FROM b UNION ALL
      SELECT 'GenBoundRuns_MaxParallelGen_LimitedParallelMerge', m / t, b.* FROM b UNION ALL
      SELECT 'MergeBoundRuns_LimitedParallelGen_MaxParallelMerge', d * p * t / m, b.* FROM b)
SELECT name, run AS run_size_mb,
       CASE WHEN name LIKE 'Huge%' THEN 1 WHEN name LIKE 'GenB%' THEN t WHEN name LIKE 'Medium%' THEN least(bal, t) ELSE least(m / run, t) END::DOUBLE AS run_gen_threads,
       CASE WHEN name LIKE 'MergeB%' THEN t WHEN name LIKE 'Medium%' THEN least(bal, t) ELSE least(m / (d / run * p), t) END::DOUBLE AS merge_threads,
       d / run AS runs, name NOT LIKE 'none%' AS feasible,
       CASE WHEN name LIKE 'Huge%' OR name LIKE 'GenB%' OR name LIKE 'Medium%' THEN 'Run Generation' ELSE 'Merge Phase' END AS bottleneck
FROM r""")
def policy_table(spark, sf_dir):
    return P.policy_frame(spark).select("name", "run_size_mb", "run_gen_threads", "merge_threads", "runs", "feasible", "bottleneck")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate::DATE AS d FROM orders")
def csv_roundtrip(spark, sf_dir):
    """Orders written as CSV with a header and read with a schema; only the selected columns are parsed."""
    path = scratch(spark, "csv")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("d"))
    rows.write.csv(path, header=True)
    return S.read_csv(spark, path, rows.schema, ["o_orderkey", "o_orderpriority", "o_totalprice", "d"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0")
def csv_bad_rows(spark, sf_dir):
    """Lines with a bad or missing number are left out; quotes, empty text and further fields are not bad."""
    path = scratch(spark, "csv_bad")
    n = table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 3 != 0, F.concat_ws(",", F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"')), F.lit("more"))).otherwise(F.concat_ws(",", F.concat(F.col("n_nationkey").cast("string"), F.lit("x")), "n_name"))
    n.select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    return S.read_csv(spark, path, schema, [0, 1], header=False)


@query("""
SELECT substr(md5('1:' || i), 1, 20) AS key, rank() OVER (ORDER BY substr(md5('1:' || i), 1, 20)) AS rank, substr(sha256('1:' || i || ':0'), 1, 8) AS payload
FROM range((SELECT count(*) FROM orders)) t(i)""")
def gensort_sort(spark, sf_dir):
    """As many binary records as there are orders, written, read again and sorted with their payload."""
    path = scratch(spark, "gensort")
    S.write_gensort(S.uniform_records(spark, table(spark, sf_dir, "orders").count(), partitions=4), path)
    ranked = O.global_rank(S.read_gensort(spark, path), ["key"])
    return ranked.select(F.lower(F.hex("key")).alias("key"), "rank", F.lower(F.hex(F.substring("payload", 1, 4))).alias("payload"))


@query("SELECT count(*) AS n, true AS within, true AS head_near FROM orders")
def zipf_keys(spark, sf_dir):
    """As many draws as there are orders: ranks within the domain, and the head as often as its share says, within five standard deviations."""
    n = table(spark, sf_dir, "orders").count()
    head = 1 / zeta(n, 0.9)
    drawn = S.zipf_keys(spark, n, 0.9)
    near = F.abs(F.avg((F.col("rank") == 0).cast("double")) - head) <= 5 * (head * (1 - head) / n) ** 0.5
    return drawn.agg(F.count("*").alias("n"), ((F.min("rank") >= 0) & (F.max("rank") < n)).alias("within"), near.alias("head_near"))


@query("SELECT count(*) AS n_rows, count(*) AS n_records FROM orders")
def zipf_records(spark, sf_dir):
    """Skewed records through the binary format and a sort: none is lost, keys are ten digits."""
    path = scratch(spark, "zipf")
    n = table(spark, sf_dir, "orders").count()
    S.write_gensort(S.zipf_records(spark, n, 0.7, partitions=3), path)
    rows = O.global_sort(S.read_gensort(spark, path), SortSpec(["key"], ["payload"], partitions=4))
    return rows.agg(F.count("*").alias("n_rows"), F.sum((F.col("key").cast("string").rlike("^[0-9]{10}$") & (F.length("payload") == 90)).cast("long")).alias("n_records"))


@query("SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS content, true AS split FROM orders")
def csv_splits(spark, sf_dir):
    """A CSV file read in many byte ranges: each line belongs to just one of them."""
    path = scratch(spark, "csv_splits")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows.coalesce(1).write.csv(path, header=True)
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "16k")
    try:
        read = S.read_csv(spark, path, rows.schema)
        splits = S.scan_splits(read.select("o_orderkey")).collect()
        content = read.agg(F.sum("o_orderkey")).first()[0]
    finally:
        spark.conf.set(key, old)
    return spark.createDataFrame([(sum(r["entries"] for r in splits), content, len(splits) > 1)], "n_rows long, content long, split boolean")


@query("SELECT count(*) AS n_rows, sum(l_orderkey)::BIGINT AS content, true AS split FROM lineitem")
def parquet_row_groups(spark, sf_dir):
    """A Parquet file of many row groups read in several splits."""
    path = scratch(spark, "row_groups")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    rows.coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(path)
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "48k")
    try:
        read = S.read_parquet(spark, path, ["l_orderkey"])
        splits = S.scan_splits(read).collect()
        content = read.agg(F.sum("l_orderkey")).first()[0]
    finally:
        spark.conf.set(key, old)
    return spark.createDataFrame([(sum(r["entries"] for r in splits), content, len(splits) > 1)], "n_rows long, content long, split boolean")


@query("SELECT n_nationkey::VARCHAR AS col_0, n_name AS col_1, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_regionkey::VARCHAR END AS col_2 FROM nation")
def csv_of_unknown_schema(spark, sf_dir):
    """Text between pipes, without a schema; empty fields are empty texts."""
    path = scratch(spark, "pipes")
    n = table(spark, sf_dir, "nation")
    n.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 != 0, F.col("n_regionkey"))).write.csv(path, sep=S.delimiter("pipe"), header=True)
    return S.read_text_columns(spark, path, "pipe")


@query("""
SELECT n_nationkey AS id, md5(repeat(n_name || '"', 4000)) AS long_quoted, md5(repeat('x', 100000)) AS long_plain FROM nation""")
def csv_long_fields(spark, sf_dir):
    """Fields of thousands of quotes and of 100,000 characters."""
    path = scratch(spark, "csv_long")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.repeat(F.concat("n_name", F.lit('"')), F.lit(4000)).alias("quoted"), F.repeat(F.lit("x"), F.lit(100_000)).alias("plain"))
    line = F.concat_ws(",", F.col("id").cast("string"), F.concat(F.lit('"'), F.replace(F.col("quoted"), F.lit('"'), F.lit('""')), F.lit('"')), F.col("plain"))
    rows.select(line.alias("value")).write.text(path)
    read = S.read_csv(spark, path, rows.schema, header=False)
    return read.select("id", F.md5(F.col("quoted").cast("binary")).alias("long_quoted"), F.md5(F.col("plain").cast("binary")).alias("long_plain"))


@query("""
SELECT o_orderkey AS vendorid, o_orderdate AS tpep_pickup_datetime, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS fare_amount, o_orderstatus AS store_and_fwd_flag, NULL::BIGINT AS pulocationid FROM orders""")
def trip_files(spark, sf_dir):
    """Files of two shapes brought to one: names in another case, a fraction for a number, missing columns."""
    path = scratch(spark, "trips")
    o = table(spark, sf_dir, "orders")
    o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("double").alias("VendorID"), F.col("o_orderdate").alias("tpep_pickup_datetime"), F.col("o_totalprice").alias("Fare_Amount"), F.col("o_orderstatus").alias("store_and_fwd_flag")).coalesce(1).write.parquet(f"{path}/a_2019-01")
    o.where("o_orderkey % 2 = 1").select("o_comment" if "o_comment" in o.columns else F.lit("x").alias("o_comment"), F.col("o_orderstatus").alias("Store_And_Fwd_Flag"), F.col("o_orderkey").alias("vendorid"), F.col("o_orderdate").alias("TPEP_pickup_datetime")).coalesce(1).write.parquet(f"{path}/b_2020-01")
    return S.normalise_trips(spark, f"{path}/*").select("vendorid", "tpep_pickup_datetime", "fare_amount", "store_and_fwd_flag", "pulocationid")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def sorted_csv_sink(spark, sf_dir):
    """A sort written as CSV files in key order, and read again."""
    path = scratch(spark, "csv_sink")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    S.write_sorted(rows, path, SortSpec(["o_totalprice"], ["o_orderkey"]), 4, "csv")
    return S.read_csv(spark, path, rows.schema, header=False)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def in_memory_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return S.from_rows(spark, [tuple(r) for r in n.collect()], n.schema, 3)  # nation has 25 rows


@query("SELECT count(*) AS n FROM lineitem")
def parquet_length(spark, sf_dir):
    return spark.range(1).select(F.lit(S.parquet_length(spark, f"{sf_dir}/lineitem.parquet")).cast("long").alias("n"))


@query("SELECT l_returnflag, l_quantity, l_returnflag AS l_returnflag_2 FROM lineitem")
def project_by_ordinal(spark, sf_dir):
    """Columns by number; one asked for again comes again."""
    return S.read_parquet(spark, f"{sf_dir}/lineitem.parquet", [8, 4, 8])
