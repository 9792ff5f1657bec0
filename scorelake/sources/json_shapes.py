"""JSON payloads as tables and back, on JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def rows_to_payload(df: DataFrame, inputs: Sequence[str], order: str, meta: Sequence[str] = (), groups: Sequence[str] = (), key: str = "inputs", unwrap: bool = False) -> DataFrame:
    """One JSON object a group: meta columns as scalars, inputs as arrays in the given order. A group must fit a row."""
    values = {f.name: finite(F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema}
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *(values[c].alias(c) for c in inputs))))
    out = df.groupBy(*groups).agg(packed.alias("__rows"), *(F.first(m).alias(m) for m in meta))
    arrays = []
    for c in inputs:
        column = F.transform("__rows", _field(c))
        arrays.append(column.alias(c))
    body = F.struct(*(F.get(a, 0).alias(c) for a, c in zip(arrays, inputs))) if unwrap else F.struct(*arrays)
    return out.select(*groups, F.to_json(F.struct(*(F.col(m) for m in meta), body.alias(key))).alias("json"))


def _field(name: str):
    return lambda r: r[name]


def arrays_to_rows(df: DataFrame, column: str, schema: str, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """{meta..., key: {name: [..], ...}} -> one row an index, meta broadcast; unequal lengths raise."""
    parsed = df.select(*keep, F.from_json(column, schema).alias("j"))
    names = [f.name for f in parsed.schema["j"].dataType[key].dataType.fields]
    sizes = F.array_distinct(F.array(*(F.size(F.col(f"j.{key}.{n}")) for n in names)))
    checked = parsed.where(F.when(F.size(sizes) > 1, F.raise_error(F.lit("arrays of different lengths")).cast("boolean")).otherwise(True))
    meta = [f.name for f in parsed.schema["j"].dataType.fields if f.name != key]
    zipped = F.arrays_zip(*(F.col(f"j.{key}.{n}").alias(n) for n in names))
    return checked.select(*keep, *(F.col(f"j.{m}") for m in meta), F.posexplode(zipped).alias("pos", "r")).select(*keep, *meta, "pos", *(F.col(f"r.{n}") for n in names))


def records_to_rows(df: DataFrame, column: str, schema: str, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """{meta..., key: [{...}, ...]} -> one row a record."""
    parsed = df.select(*keep, F.from_json(column, schema).alias("j"))
    meta = [f.name for f in parsed.schema["j"].dataType.fields if f.name != key]
    return parsed.select(*keep, *(F.col(f"j.{m}") for m in meta), F.inline(F.col(f"j.{key}")))


def write_payloads(df: DataFrame, path: str, column: str = "json") -> None:
    """One payload a line, in as many files as df has partitions; null payloads are not written."""
    df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Column json: one payload a line, or one a file (for files that are laid out over lines). Blank ones are passed over."""
    found = spark.read.text(path, wholetext=whole_files)
    return found.where(F.col("value").rlike(r"\S")).select(F.col("value").alias("json"))
