"""User functions over tables: by rows, by groups, by columns; aggregates as struct results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The function sees Arrow batches of rows; its result must not depend on where batches end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def by_groups(df: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The function sees a whole group, which must fit a worker."""
    return df.groupBy(*keys).applyInPandas(lambda part: function(part), schema)


def by_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str], size: int, function: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """The function sees a lazy table of each chunk of columns, always with the columns to keep."""
    return [function(df.select(*keep, *columns[i : i + size])) for i in range(0, len(columns), size)]


def row_wise(function: Callable[[pd.DataFrame], pd.DataFrame], probe: pd.DataFrame) -> bool:
    """Whether the function gives the same on 20 rows at once and in two halves."""
    rows = probe.head(20)
    half = len(rows) // 2
    try:
        parts = pd.concat([function(rows.iloc[:half]), function(rows.iloc[half:])], ignore_index=True)
        return parts.equals(function(rows).reset_index(drop=True))
    except Exception:
        return False


def evaluate(df: DataFrame, leaf: Callable[[DataFrame, list[str]], DataFrame], groups: Sequence[str] = (), subsets: dict[str, str] | None = None, labels: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """A leaf over group x subset x label in one plan, whatever their number. Groups below min_rows rows are left out.

    The leaf gets a table with a row for each subset and label that a row belongs to (columns subset, label, __label: the
    label's value; group_<g>) and the key columns that it must group by. Null labels do not count."""
    tests = list((subsets or {"all": "true"}).items())
    cells = [
        F.when(F.expr(f"({test})") & (F.col(label).isNotNull() if label else F.lit(True)), F.struct(F.lit(subset).alias("subset"), F.lit(label).cast("string").alias("label"), (F.col(label) if label else F.lit(None)).cast("double").alias("__label")))
        for subset, test in tests for label in (labels or [None])
    ]
    named = df.withColumns({f"group_{g}": F.col(g) for g in groups})
    long = named.withColumn("__cell", F.explode(F.array_compact(F.array(*cells)))).select(*named.columns, "__cell.*")
    keys = ["subset", "label", *(f"group_{g}" for g in groups)]
    if min_rows > 1 and groups:
        counted = long.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_rows)
        same = F.lit(True)
        for k in keys:
            same = same & long[k].eqNullSafe(counted[k])
        long = long.join(counted, same, "left_semi")
    return leaf(long, keys)

