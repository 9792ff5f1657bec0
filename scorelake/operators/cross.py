"""Cross risk: two binned scores against any aggregate, with margins by CUBE over raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edges import bin_number, ensure, equal_frequency_many


def cross_risk(df: DataFrame, first: str, second: str, aggregates: dict[str, Column], n_bins: int = 5, method: str | Sequence[float] = "frequency", edges: tuple[Sequence[float], Sequence[float]] | None = None) -> DataFrame:
    """bin1, bin2 (null: all), is_margin and the aggregates. Margins aggregate rows, so means and ratios are right too."""
    if edges is None and method == "frequency":
        found = equal_frequency_many(df, [first, second], n_bins)
        edges = found[first], found[second]
    a, b = edges or (ensure(df, first, n_bins, method), ensure(df, second, n_bins, method))
    binned = df.withColumns({"bin1": bin_number(F.col(first), a), "bin2": bin_number(F.col(second), b)}).where("bin1 IS NOT NULL AND bin2 IS NOT NULL")
    out = binned.cube("bin1", "bin2").agg(F.grouping_id("bin1", "bin2").alias("is_margin"), *(c.alias(k) for k, c in aggregates.items()))
    return out


def ratio(numerator: str, denominator: str, zero_division: float | None = None) -> Column:
    """Sum over sum of rows with both and a denominator other than 0; zero_division where none is left."""
    valid = F.col(numerator).isNotNull() & F.col(denominator).isNotNull() & (F.col(denominator) != 0)
    value = F.try_divide(F.sum(F.when(valid, F.col(numerator).cast("double"))), F.nullif(F.sum(F.when(valid, F.col(denominator).cast("double"))), F.lit(0.0)))
    return F.coalesce(value, F.lit(zero_division)) if zero_division is not None else value


def pivoted(cross: DataFrame, value: str, n_bins: int) -> DataFrame:
    """For display: rows bin1, a column for each bin2 and one for all."""
    named = cross.withColumns({"row": F.coalesce(F.col("bin1").cast("string"), F.lit("all")), "col": F.coalesce(F.col("bin2").cast("string"), F.lit("all"))})
    return named.groupBy("row").pivot("col", [*(str(i) for i in range(1, n_bins + 1)), "all"]).agg(F.first(value))
