"""Offset-value codes of sorted keys, as a derived column.

A code says where a key first differs from the one before it, in steps of 6 bytes, and what it has there: flag (3 bits), 8191 - offset (13 bits),
value (48 bits). Between keys coded against the same base, codes order as the keys do. Here they are for inspection and for comparing
formats; sorting uses Spark's own key prefixes. Codes restart with INITIAL in each run. Offsets beyond 8191 saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The layout and the flags.
STEP, MOST_OFFSET, FLAG_SHIFT, OFFSET_SHIFT = 6, 8191, 61, 48
EARLY_FENCE, DUPLICATE, NORMAL, INITIAL, LATE_FENCE = 0, 1, 2, 3, 4


def ovc_column(key: Column, before: Column) -> Column:
    """The code of a binary key after `before` (null: the first of its run). All in the JVM."""
    steps = F.sequence(F.lit(0), F.floor(F.length(key) / STEP).cast("int"))
    piece = lambda k, i: F.substring(k, i * STEP + 1, F.lit(STEP))
    step = F.element_at(F.filter(steps, lambda i: piece(key, i) != piece(before, i)), 1)
    value = F.conv(F.rpad(F.hex(piece(key, step)), 2 * STEP, "0"), 16, 10).cast("bigint")
    offset = F.lit(MOST_OFFSET) - F.least(step * STEP, F.lit(MOST_OFFSET))
    flag = lambda f: F.lit(f << FLAG_SHIFT).cast("bigint")
    normal = flag(NORMAL) + F.shiftleft(offset.cast("bigint"), OFFSET_SHIFT) + value
    return F.when(before.isNull(), flag(INITIAL)).when(key == before, flag(DUPLICATE)).otherwise(normal)


def ovc_fields(code: Column) -> list[Column]:
    """flag, offset and value (hexadecimal) of a code."""
    flag = F.shiftrightunsigned(code, FLAG_SHIFT).cast("int")
    offset = (F.lit(MOST_OFFSET) - F.shiftrightunsigned(code, OFFSET_SHIFT).bitwiseAND(F.lit(MOST_OFFSET).cast("bigint"))).cast("int")
    value = F.lpad(F.lower(F.hex(code.bitwiseAND(F.lit((1 << OFFSET_SHIFT) - 1).cast("bigint")))), 12, "0")
    return [flag.alias("flag"), F.when(flag == NORMAL, offset).alias("offset"), F.when(flag == NORMAL, value).alias("value")]


def ovc_runs(df: DataFrame, key: str, run: str = "run_id") -> DataFrame:
    """df with the code of each row's binary key after the one before it in its run."""
    return df.withColumn("ovc", ovc_column(F.col(key), F.lag(key).over(W.partitionBy(run).orderBy(key))))


def _codes(key: pa.Array) -> np.ndarray:
    """Codes of all keys but the first, each after the one before it; the keys have no nulls."""
    key = key.cast(pa.large_binary())
    _, offs, data = key.buffers()
    offs = np.frombuffer(offs, np.int64)[key.offset : key.offset + len(key) + 1]
    raw = np.concatenate([np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    wide = np.ndarray((len(raw) - 7,), ">u8", raw.tobytes(), strides=(1,))
    start, size = offs[:-1] - offs[0], np.diff(offs)
    out = np.full(len(key) - 1, DUPLICATE << FLAG_SHIFT, np.int64)
    open_, step = np.arange(1, len(key)), 0
    while len(open_):
        at, left = [], []
        for i in (open_ - 1, open_):
            more = np.clip(size[i] - step, 0, STEP)
            value = wide[np.minimum(start[i] + step, len(wide) - 1)].astype(np.uint64) >> np.uint64(16)
            at.append(value & ~((np.uint64(1) << (8 * (STEP - more)).astype(np.uint64)) - np.uint64(1)))
            left.append(more)
        apart = (at[0] != at[1]) | (left[0] != left[1])
        found = open_[apart]
        offset = MOST_OFFSET - min(step, MOST_OFFSET)
        out[found - 1] = (NORMAL << FLAG_SHIFT) + (offset << OFFSET_SHIFT) + at[1][apart].astype(np.int64)
        open_ = open_[~apart & (left[0] == STEP) & (left[1] == STEP)]
        step += STEP
    return out


def ovc_partitions(df: DataFrame, key: str) -> DataFrame:
    """df with the code of each row's binary key after the one before it in its partition, whose first row has INITIAL; the partitions are sorted by it. Null
    keys count as empty. Rows stay where they are."""
    schema = T.StructType([*df.schema.fields, T.StructField("ovc", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            own = b.column(b.schema.get_field_index(key)).cast(pa.binary()).fill_null(b"")
            if not len(own):
                continue
            got = _codes(own if last is None else pa.concat_arrays([last, own]))
            got = np.concatenate([[INITIAL << FLAG_SHIFT], got]).astype(np.int64) if last is None else got
            last = own.slice(len(own) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, "ovc"])

    return df.mapInArrow(run, schema)
