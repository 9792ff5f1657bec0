"""Keyed comparison of two tables, and online/offline consistency checks.

Both sides are joined once, full outer and null-safe on the keys; all reports are aggregates or projections of that join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import require_columns
from ..functions.ordered import present


@dataclass(frozen=True)
class CompareConfig:
    keys: Sequence[str]
    columns: Sequence[str] | None = None
    ignore: Sequence[str] = ()
    tolerance: float = 0.0
    relative: float = 0.0
    seconds: float = 0.0
    column_tolerance: dict[str, float | dict[str, float]] = field(default_factory=dict)  # or tol, rtol, seconds
    missing: Sequence[str] = ()
    duplicates: str = "first"  # first, all or raise
    both_null_equal: bool = True
    detail: str = "top"  # none, top or full
    most_details: int = 1000


#: What a text must look like to be a number.
NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def number(c: Column) -> Column:
    """The value as a double; null where a text is no number, and for NaN."""
    text = F.trim(c.cast("string"))
    d = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(d), d)


class Comparison:
    def __init__(self, left: DataFrame, right: DataFrame, config: CompareConfig):
        require_columns(left, config.keys)
        require_columns(right, config.keys)
        self.config, self.raw = config, (left, right)
        shared = [c for c in (config.columns or left.columns) if c in left.columns and c in right.columns]
        self.columns = [c for c in shared if c not in {*config.keys, *config.ignore}]
        if config.duplicates == "raise" and not self.duplicate_keys().isEmpty():
            raise ValueError("a key occurs more than once")
        sides = [self._side(df, s) for df, s in zip(self.raw, "lr")]
        same = F.lit(True)
        for k in config.keys:
            same = same & F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}"))
        joined = sides[0].join(sides[1], same, "full_outer")
        keys = [F.when(F.col("__l").isNotNull(), F.col(f"l_{k}")).otherwise(F.col(f"r_{k}")).alias(k) for k in config.keys]
        where = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
        values = [x for c in self.columns for x in (F.col(f"v_l_{c}"), F.col(f"v_r_{c}"))]
        self.joined = joined.select(*keys, where.alias("side"), *values)
        self.numeric_texts = self._numeric_texts(sides)
        self.kinds = {c: self._kind(c) for c in self.columns}

    def _side(self, df: DataFrame, s: str) -> DataFrame:
        if self.config.missing:
            text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in self.config.keys]
            df = df.withColumns({c: F.when(~F.col(c).isin(*self.config.missing), F.col(c)) for c in text})
        if self.config.duplicates == "first":
            order = Window.partitionBy(*self.config.keys).orderBy(*(F.col(c).asc_nulls_last() for c in self.columns)) if self.columns else Window.partitionBy(*self.config.keys).orderBy(F.lit(0))
            df = df.withColumn("__n", F.row_number().over(order)).where("__n = 1")
        # two namespaces: a key is l_<key>, a value v_l_<column>
        return df.select(*(F.col(k).alias(f"{s}_{k}") for k in self.config.keys), *(F.col(c).alias(f"v_{s}_{c}") for c in self.columns), F.lit(1).alias(f"__{s}"))

    def _kind(self, c: str) -> str:
        types = [df.schema[c].dataType for df in self.raw]
        if any(isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)) for t in types):
            return "time"
        if any(isinstance(t, T.NumericType) for t in types):
            return "number"
        return "number" if c in self.numeric_texts else "text"

    def _numeric_texts(self, sides: Sequence[DataFrame]) -> set[str]:
        """Text columns whose values, on both sides, are all numbers; one aggregate a side for all of them."""
        texts = [c for c in self.columns if all(isinstance(df.schema[c].dataType, T.StringType) for df in self.raw)]
        if not texts:
            return set()
        counts = []
        for df, s in zip(sides, "lr"):
            each = [f for c in texts for f in (F.count(f"v_{s}_{c}").alias(f"n_{c}"), F.count(F.when(F.col(f"v_{s}_{c}").rlike(NUMBER), 1)).alias(f"k_{c}"))]
            counts.append(df.agg(*each).first())
        return {c for c in texts if any(r[f"n_{c}"] for r in counts) and all(r[f"n_{c}"] == r[f"k_{c}"] for r in counts)}

    def coerced(self, c: str) -> tuple[Column, Column]:
        """Both values in the kind they are compared in; what cannot be read as that kind is null."""
        out = []
        for df, s in zip(self.raw, "lr"):
            x, kind = F.col(f"v_{s}_{c}"), df.schema[c].dataType
            if self.kinds[c] == "text":
                out.append(x.cast("string"))
            elif self.kinds[c] == "time":
                moment = isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType))
                out.append((x.cast("timestamp") if moment else x.cast("string").try_cast("timestamp")).cast("double"))
            else:
                out.append(present(x) if isinstance(kind, T.NumericType) else number(x))
        return out[0], out[1]

    def difference(self, c: str) -> Column:
        a, b = self.coerced(c)
        return a - b if self.kinds[c] != "text" else F.lit(None).cast("double")

    def tolerance(self, c: str) -> tuple[float, float, float]:
        """(absolute, relative, seconds) of a column."""
        own, config = self.config.column_tolerance.get(c), self.config
        if isinstance(own, dict):
            return own.get("tol", config.tolerance), own.get("rtol", config.relative), own.get("seconds", config.seconds)
        return (own, config.relative, own) if own is not None else (config.tolerance, config.relative, config.seconds)

    def differs(self, c: str) -> Column:
        """Beyond tolerance, or null on one side alone after coercion; null on both where that does not count as equal."""
        a, b = self.coerced(c)
        absolute, relative, seconds = self.tolerance(c)
        if self.kinds[c] == "text":
            over = a != b
        elif self.kinds[c] == "time":
            over = F.abs(a - b) > seconds
        else:
            over = F.abs(a - b) > absolute + relative * F.abs(b)
        out = F.coalesce(over, F.lit(False)) | (a.isNull() != b.isNull())
        return out if self.config.both_null_equal else out | (a.isNull() & b.isNull())

    def coverage(self) -> DataFrame:
        return self.joined.groupBy("side").agg(F.count("*").alias("n"))

    def schema_report(self) -> DataFrame:
        left, right = (dict(df.dtypes) for df in self.raw)
        rows = [
            (c, left.get(c), right.get(c), "key" if c in self.config.keys else "value", "both" if c in left and c in right else "left_only" if c in left else "right_only")
            for c in dict.fromkeys([*left, *right])
        ]
        return self.joined.sparkSession.createDataFrame(rows, "column string, left_type string, right_type string, role string, status string")

    def duplicate_keys(self) -> DataFrame:
        parts = [df.groupBy(*self.config.keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("side", F.lit(s)) for df, s in zip(self.raw, ("left", "right"))]
        return parts[0].unionByName(parts[1])

    def _cells(self) -> DataFrame:
        both = self.joined.where("side = 'both'")
        each = []
        for c in self.columns:
            a, b = self.coerced(c)
            each.append(F.struct(
                F.lit(c).alias("column"), F.col(f"v_l_{c}").cast("string").alias("left_value"), F.col(f"v_r_{c}").cast("string").alias("right_value"), self.difference(c).alias("diff"),
                self.differs(c).alias("differs"), (a.isNull() != b.isNull()).alias("one_null"), (a.isNull() & b.isNull()).alias("both_null"),
            ))
        return both.select(*self.config.keys, F.explode(F.array(*each)).alias("c")).select(*self.config.keys, "c.*")

    def column_report(self) -> DataFrame:
        """Per column over common rows: mismatches, their share, greatest and mean absolute difference, nulls after coercion."""
        d = F.abs("diff")
        out = self._cells().groupBy("column").agg(
            F.count("*").alias("n"), F.count_if("differs").alias("n_diff"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"),
            F.count_if("one_null").alias("n_one_null"), F.count_if("both_null").alias("n_both_null"),
        )
        return out.withColumn("diff_rate", F.col("n_diff") / F.col("n"))

    def row_report(self) -> DataFrame:
        """Keys of common rows with mismatches: their number and the columns' names."""
        names = F.array_compact(F.array(*(F.when(self.differs(c), F.lit(c)) for c in self.columns)))
        rows = self.joined.where("side = 'both'").select(*self.config.keys, F.array_join(names, ",").alias("columns"), F.size(names).alias("n_diff"))
        return rows.where("n_diff > 0")

    def cell_report(self, top: int | None = None) -> DataFrame:
        """Mismatched cells, the largest absolute differences first, nulls last. Without `top`, as the detail mode says."""
        cells = self._cells().where("differs").drop("differs", "one_null", "both_null")
        most = top if top is not None else {"none": 0, "top": self.config.most_details}.get(self.config.detail)
        order = [F.abs("diff").desc_nulls_last(), *(F.col(k) for k in self.config.keys), F.col("column")]
        return cells.orderBy(*order).limit(most) if most is not None else cells

    def reports(self) -> dict[str, DataFrame]:
        return {
            "coverage": self.coverage(), "schema": self.schema_report(), "columns": self.column_report(), "rows": self.row_report(),
            "cells": self.cell_report(), "duplicates": self.duplicate_keys(),
        }

    def write(self, folder: str, format: str = "parquet") -> None:
        """Each report as a table of its own under the folder."""
        for name, report in self.reports().items():
            report.write.mode("overwrite").format(format).save(f"{folder}/{name}")


def compare_files(spark, left: str, right: str, config: CompareConfig, format: str = "csv") -> Comparison:
    """Two files or folders; CSV values are texts, and columns of numbers are recognised as such."""
    read = (lambda p: spark.read.csv(p, header=True)) if format == "csv" else (lambda p: spark.read.format(format).load(p))
    return Comparison(read(left), read(right), config)


def uat_features(joined: DataFrame, pairs: Sequence[tuple[str, str]], tolerance: float = 1e-6) -> DataFrame:
    """Per feature pair (offline, online): rows, comparable rows (null on neither side), mismatches over those, greatest
    difference. `joined` is the full outer join of both sides."""
    each = []
    for a, b in pairs:
        x, y = F.col(a).try_cast("double"), F.col(b).try_cast("double")
        each.append(F.struct(F.lit(a).alias("feature"), x.alias("x"), y.alias("y"), (F.coalesce(F.abs(x - y) > tolerance, F.lit(False)) | (x.isNull() != y.isNull())).alias("bad")))
    cells = joined.select(F.explode(F.array(*each)).alias("c")).select("c.*")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = cells.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(both).alias("n_both"), F.count_if("bad").alias("n_mismatch"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"))
    return out.withColumn("mismatch_rate", F.try_divide(F.col("n_mismatch"), F.nullif(F.col("n_both"), F.lit(0))))


def uat_times(joined: DataFrame, pairs: Sequence[tuple[str, str]], seconds: float = 0.0) -> DataFrame:
    each = []
    for a, b in pairs:
        d = F.abs(F.col(a).try_cast("timestamp").cast("double") - F.col(b).try_cast("timestamp").cast("double"))
        each.append(F.struct(F.lit(a).alias("field"), d.alias("d"), (F.coalesce(d > seconds, F.lit(False)) | (F.col(a).isNull() != F.col(b).isNull())).alias("bad")))
    cells = joined.select(F.explode(F.array(*each)).alias("c")).select("c.*")
    return cells.groupBy("field").agg(F.count("*").alias("n"), F.count("d").alias("n_both"), F.count_if("bad").alias("n_mismatch"), F.max("d").alias("max_seconds"))


def uat_per_key(joined: DataFrame, key: str, pairs: Sequence[tuple[str, str]], tolerance: float = 1e-6) -> DataFrame:
    """Per key: mismatching features, their number, and whether all agree."""
    names = []
    for a, b in pairs:
        x, y = F.col(a).try_cast("double"), F.col(b).try_cast("double")
        names.append(F.when(F.coalesce(F.abs(x - y) > tolerance, F.lit(False)) | (x.isNull() != y.isNull()), F.lit(a)))
    wrong = F.array_compact(F.array(*names))
    return joined.select(key, F.size(wrong).alias("n_mismatch"), F.array_join(wrong, ",").alias("features"), (F.size(wrong) == 0).alias("ok"))


def uat_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides, on one alone, and repeated keys of each side, in one aggregate over keys."""
    keys = left.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = keys.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return per.agg(
        F.count_if(F.expr("a > 0 AND b > 0")).alias("both"), F.count_if(F.expr("b = 0")).alias("left_only"), F.count_if(F.expr("a = 0")).alias("right_only"), F.count_if(F.expr("a > 1")).alias("left_repeated"), F.count_if(F.expr("b > 1")).alias("right_repeated")
    )
