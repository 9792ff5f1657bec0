"""Null policy and column housekeeping. Every verb is DataFrame -> DataFrame, for df.transform(...)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """NaN becomes null in float columns: Spark counts NaN as a value, the engine as missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in set(cols))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def values_to_null(df: DataFrame, values: Iterable, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*values), F.col(c)) for c in cols})


def bool_to_str(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.initcap(F.col(c).cast("string")) for c in names})


def drop_columns_if_present(df: DataFrame, cols: Iterable[str] = ("py_inserttime",)) -> DataFrame:
    return df.drop(*cols)


def missing_indicator(cols: Iterable[str]) -> Column:
    """1 where every listed column is null."""
    test = F.lit(True)
    for c in cols:
        test = test & F.col(c).isNull()
    return test.cast("int")


def rename_all(df: DataFrame, how: str = "lower") -> DataFrame:
    change = {"lower": str.lower, "upper": str.upper, "capitalize": str.capitalize}[how]
    return df.toDF(*map(change, df.columns))


def move_column(df: DataFrame, name: str, index: int) -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest[:index], name, *rest[index:])


def select_regex(df: DataFrame, pattern: str, case_sensitive: bool = True) -> DataFrame:
    test = re.compile(pattern, 0 if case_sensitive else re.I)
    return df.select(*(c for c in df.columns if test.match(c)))


def filter_regex(df: DataFrame, column: str, pattern: str, case_sensitive: bool = True) -> DataFrame:
    return df.where(F.col(column).cast("string").rlike(pattern if case_sensitive else f"(?i){pattern}"))


def bucket_by_condition(df: DataFrame, conditions: Mapping[str, str], name: str, drop_unmatched: bool = True, default=None) -> DataFrame:
    """Label rows by named conditions. With drop_unmatched a row appears once for each condition that it meets (one
    explode, not one scan a condition); else the last condition that holds wins."""
    if drop_unmatched:
        labels = F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in conditions.items()))
        return df.withColumn(name, F.explode(F.array_compact(labels)))
    label = F.lit(default).cast("string")
    for k, c in conditions.items():
        label = F.when(F.expr(c), F.lit(k)).otherwise(label)
    return df.withColumn(name, label)


def schema_listing(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    if absent := [c for c in cols if c not in df.columns]:
        raise ValueError(f"columns not found: {', '.join(absent)}")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def unpivot_values(df: DataFrame, keys: list[str], cols: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(keys, cols, name, value)


def transpose(df: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """Rows to columns by key; the number of keys must be small, as each becomes a column."""
    cols = cols or [c for c in df.columns if c != key]
    return unpivot_values(df, [key], cols, "column", "value").groupBy("column").pivot(key).agg(F.first("value"))
