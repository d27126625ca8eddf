"""Metadata filters: every key has to hold."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.project import CONTROL_KEYS


def predicate(df: DataFrame, filters: dict[str, Any] | None) -> Column:
    """Equality; membership for a list of values; containment for an array column. A key that a row, or the
    table, doesn't have fails. Keys that steer the search are passed over. It is for ``where``: a row without
    a value gives null, and a plain conjunction reaches partitions and row groups."""
    out = F.lit(True)
    types = {f.name: f.dataType for f in df.schema.fields}
    for key, value in (filters or {}).items():
        if key in CONTROL_KEYS:
            continue
        if key not in types:
            return F.lit(False)
        if isinstance(value, (list, tuple, set)):
            out &= F.col(key).isin(list(value)) if not isinstance(types[key], T.ArrayType) else F.lit(False)
        elif isinstance(types[key], T.ArrayType):
            out &= F.array_contains(key, value)
        else:
            out &= F.col(key) == F.lit(value)
    return out


def apply(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    return df.where(predicate(df, filters)) if filters else df
