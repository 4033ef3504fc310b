"""What to sort: key and payload columns, by name or ordinal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, columns: list[int | str]) -> list[str]:
    """Names of columns given by name or ordinal; repeats and overlaps are allowed."""
    if not columns:
        raise ValueError("at least one column is needed")
    out = []
    for c in columns:
        if isinstance(c, int):
            if not 0 <= c < len(df.columns):
                raise IndexError(f"column {c} is out of bounds: there are {len(df.columns)}")
            c = df.columns[c]
        elif c not in df.columns:
            raise ValueError(f"no column {c!r}")
        out.append(c)
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many _ more as it takes to be none of df's columns."""
    low = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out


def picked(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns in the order asked for. One that is asked for again comes again, as name_2, name_3 and so on (with a further _ where
    the frame has that name itself)."""
    taken, out, times = set(names), [], dict.fromkeys(names, 0)
    for c in names:
        times[c] += 1
        name = c if times[c] == 1 else f"{c}_{times[c]}"
        while times[c] > 1 and name in taken:
            name += "_"
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def each(flag: bool | Sequence[bool], n: int) -> list[bool]:
    """One flag for all keys, or one for each."""
    if isinstance(flag, bool):
        return [flag] * n
    if len(flag) != n:
        raise ValueError(f"{len(flag)} flags for {n} keys")
    return list(flag)


def directed(keys: Sequence[Column | str], descending: bool | Sequence[bool] = False, nulls_last: bool | Sequence[bool] = False) -> list[Column]:
    """Sort columns of keys: ascending with nulls first unless said otherwise, for all keys or for each."""
    out = []
    for k, d, last in zip(keys, each(descending, len(keys)), each(nulls_last, len(keys)), strict=True):
        c = F.col(f"`{k}`") if isinstance(k, str) else k
        out.append(getattr(c, ("desc" if d else "asc") + ("_nulls_last" if last else "_nulls_first"))())
    return out


@dataclass(frozen=True)
class SortSpec:
    """Keys in order, payload columns, and how to run the sort.

    Ascending with nulls first unless said otherwise (`descending` and `nulls_last`, for all keys or one flag for each, are extensions).
    `partitions`: of the range exchange; Spark's own choice if None. `stable` keeps ties in source order. `method`: "plain", or "ovc" for
    a sort whose rows also carry the offset-value code of their key after the one before in their range; the rows are the same.
    """

    keys: list[int | str]
    values: list[int | str] = field(default_factory=list)
    descending: bool | Sequence[bool] = False
    nulls_last: bool | Sequence[bool] = False
    partitions: int | None = None
    stable: bool = False
    method: str = "plain"

    def __post_init__(self):
        if not self.keys:
            raise ValueError("at least one key column is needed")
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("partitions must be 1 or more")
        if self.method not in ("plain", "ovc"):
            raise ValueError(f"no sort method {self.method!r}")
        each(self.descending, len(self.keys))
        each(self.nulls_last, len(self.keys))

    def key_names(self, df: DataFrame) -> list[str]:
        names = resolve(df, self.keys)
        for k in names:
            if isinstance(df.schema[k].dataType, T.MapType):
                raise TypeError(f"{k}: a map has no order")
        return names

    def project(self, df: DataFrame) -> DataFrame:
        """Keys and payload only, so that the scan reads nothing else. A column that is asked for again comes again, numbered."""
        return picked(df, self.key_names(df) + (resolve(df, self.values) if self.values else []))

    def order(self, df: DataFrame) -> list[Column]:
        return directed(self.key_names(df), self.descending, self.nulls_last)
