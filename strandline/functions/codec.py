"""Keys as bytes whose unsigned order is the order of the values, and back.

Integers, dates, text, binary and decimals of up to 18 digits stay in the JVM as expressions; the bits of floating-point numbers and of wider
decimals need Arrow UDFs, so keep those out of hot paths: sorting typed columns never needs a codec.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: days of the common era (1 is 0001-01-01) at 1970-01-01.
CE_OFFSET = 719_163
#: Bytes of the fixed-width encodings.
WIDTHS = {"int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "decimal": 16}


def _hex(number: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), digits, "0"))


def _signed(digits: Column) -> Column:
    """The number of 16 hexadecimal digits, the first bit being the sign."""
    top, rest = (F.conv(F.substring(digits, at, n), 16, 10).cast("bigint") for at, n in ((1, 1), (2, 15)))
    return F.shiftleft(top, 60) + rest


def days_from_ce(date: Column) -> Column:
    """A date as its day of the common era."""
    return (F.datediff(date, F.lit("1970-01-01").cast("date")) + CE_OFFSET).cast("int")


def format_ce_days(days: Column) -> Column:
    """The date of a day of the common era as text; a note where there is none."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), (days - CE_OFFSET).cast("int"))
    valid = days.between(-364, 3_652_059 + 366)
    return F.when(valid, F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat(F.lit("Invalid date ("), days.cast("string"), F.lit(" days)")))


def _float_bits(size: int):
    wide, top = (">u4", np.uint32(1 << 31)) if size == 4 else (">u8", np.uint64(1 << 63))
    plain = np.dtype(wide).newbyteorder("=")
    kind = np.float32 if size == 4 else np.float64

    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        bits = v.fillna(np.nan).to_numpy(kind).view(plain)
        bits = np.where(bits & top, ~bits, bits ^ top).astype(wide).tobytes()  # whole array at once: single items would be of native order
        return pd.Series([bits[i : i + size] for i in range(0, len(bits), size)])

    return encode


def _unfloat_bits(size: int):
    wide, top = (">u4", np.uint32(1 << 31)) if size == 4 else (">u8", np.uint64(1 << 63))
    plain = np.dtype(wide).newbyteorder("=")
    kind = np.float32 if size == 4 else np.float64

    @F.pandas_udf("float" if size == 4 else "double")
    def decode(v: pd.Series) -> pd.Series:
        good = np.array([x is not None and len(x) == size for x in v], bool)
        bits = np.frombuffer(b"".join(x if g else bytes(size) for x, g in zip(v, good, strict=True)), wide).astype(plain)
        out = np.where(bits & top, bits ^ top, ~bits).astype(plain).view(kind)
        return pd.Series(out).where(good)

    return decode


def _decimal_bits(scale: int):
    @F.pandas_udf("binary")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (int(x.scaleb(scale)) + (1 << 127)).to_bytes(16, "big") for x in v])

    return encode


def _undecimal_bits(kind: T.DecimalType):
    @F.pandas_udf(kind.simpleString())
    def decode(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or len(x) != 16 else Decimal(int.from_bytes(x, "big") - (1 << 127)).scaleb(-kind.scale) for x in v], dtype=object)

    return decode


def encode_key(column: Column, kind: T.DataType) -> Column:
    """The column as order-preserving bytes; null stays null. Dates become days of the common era; decimals lose their scale."""
    if isinstance(kind, T.BinaryType):
        return column
    if isinstance(kind, T.StringType):
        return F.encode(column, "UTF-8")
    if isinstance(kind, T.DateType):
        column, kind = days_from_ce(column), T.IntegerType()
    if isinstance(kind, T.IntegerType):
        return _hex(column.cast("bigint") + F.lit(2**31).cast("bigint"), 8)
    if isinstance(kind, T.LongType):
        return _hex(column.bitwiseXOR(F.lit(-(2**63)).cast("bigint")), 16)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # the UDF gets nulls as NaN, so they are put back here
        return F.when(column.isNotNull(), _float_bits(4 if isinstance(kind, T.FloatType) else 8)(column))
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            return _decimal_bits(kind.scale)(column)
        unscaled = (column.cast("decimal(38,18)") * F.lit(Decimal(10) ** kind.scale)).cast("bigint") if kind.scale else column.cast("bigint")
        # the sign's 64 bits with the first one flipped, then the number's own
        return F.unhex(F.concat(F.when(unscaled < 0, F.lit("7" + "F" * 15)).otherwise(F.lit("8" + "0" * 15)), F.lpad(F.hex(unscaled), 16, "0")))
    raise TypeError(f"no key encoding for {kind.simpleString()}")


def decode_key(column: Column, kind: T.DataType) -> Column:
    """Back from encode_key; null where the bytes have another length than the type's."""
    if isinstance(kind, T.BinaryType):
        return column
    if isinstance(kind, T.StringType):
        return decode_utf8(column)
    if isinstance(kind, T.DateType):
        return F.date_add(F.lit("1970-01-01").cast("date"), decode_key(column, T.IntegerType()) - CE_OFFSET)
    if isinstance(kind, T.IntegerType):
        return F.when(F.length(column) == 4, (F.conv(F.hex(column), 16, 10).cast("bigint") - F.lit(2**31).cast("bigint")).cast("int"))
    if isinstance(kind, T.LongType):
        return F.when(F.length(column) == 8, _signed(F.hex(column)).bitwiseXOR(F.lit(-(2**63)).cast("bigint")))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _unfloat_bits(4 if isinstance(kind, T.FloatType) else 8)(column)
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            return _undecimal_bits(kind)(column)
        unscaled = _signed(F.substring(F.hex(column), 17, 16))
        return F.when(F.length(column) == 16, (unscaled.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-kind.scale))).cast(kind))
    raise TypeError(f"no key encoding for {kind.simpleString()}")


def decode_utf8(column: Column) -> Column:
    """Text of valid UTF-8, null otherwise."""
    return F.try_validate_utf8(column.cast("string"))


def decode_text(column: Column, name: str) -> Column:
    """A readable form by type name (int, bigint, float, double, date, a 128-bit integer, string); for others the number of bytes. Bytes of
    another length than the type's give null."""
    kinds = {
        "int": T.IntegerType(), "int32": T.IntegerType(), "i32": T.IntegerType(), "bigint": T.LongType(), "int64": T.LongType(), "i64": T.LongType(),
        "float": T.FloatType(), "float32": T.FloatType(), "f32": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(), "f64": T.DoubleType(),
        "i128": T.DecimalType(38, 0), "int128": T.DecimalType(38, 0), "decimal128": T.DecimalType(38, 0), "string": T.StringType(), "utf8": T.StringType(),
    }
    if name.lower() == "date32":
        return format_ce_days(decode_key(column, T.IntegerType()))
    if name.lower() not in kinds:
        return F.concat(F.lit("<"), F.length(column).cast("string"), F.lit(" bytes>"))
    return decode_key(column, kinds[name.lower()]).cast("string")


def composite_key(df: DataFrame, columns: list[str]) -> Column:
    """The columns' encodings with a zero byte between. Its order is that of the columns unless a text contains a zero byte."""
    if not columns:
        raise ValueError("at least one column is needed")
    out = encode_key(F.col(columns[0]), df.schema[columns[0]].dataType)
    for c in columns[1:]:
        out = F.concat(out, F.lit(bytearray(b"\0")), encode_key(F.col(c), df.schema[c].dataType))
    return out


def split_composite(key: Column, kinds: list[T.DataType]) -> list[Column]:
    """The values of a composite key: fixed widths by type, text up to the next zero byte."""
    out, at = [], F.lit(1)
    text = F.decode(key, "ISO-8859-1")  # a character for each byte
    for kind in kinds:
        name = "decimal" if isinstance(kind, T.DecimalType) else kind.simpleString()
        if name in WIDTHS:
            size: Column = F.lit(WIDTHS[name])
        else:
            stop = F.call_function("locate", F.lit("\0"), text, at)
            size = F.when(stop > 0, stop - at).otherwise(F.length(key) - at + 1)
        out.append(decode_key(F.substring(key, at, size), kind))
        at = at + size + 1
    return out
