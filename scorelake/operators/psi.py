"""Population stability and distribution shift: edges from the expected side, one aggregate for all groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import bin_number, equal_frequency, equal_frequency_many
from ..functions.ordered import percentiles

FLOOR = 1e-6


def _parts(counts: DataFrame, keys: Sequence[str], smoothing: str, floor: float) -> DataFrame:
    whole = Window.partitionBy(*keys)
    share = lambda c: F.try_divide(F.col(c), F.nullif(F.sum(c).over(whole), F.lit(0)).cast("double"))
    level = (lambda c: F.greatest(share(c), F.lit(floor))) if smoothing == "clip" else (lambda c: share(c) + floor)
    out = counts.withColumns({"e": level("expected"), "a": level("actual")})
    return out.withColumn("psi", (F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e")))


def psi_details(df: DataFrame, actual: Column, column: str, n_bins: int = 10, groups: Sequence[str] = (), smoothing: str = "clip", floor: float = FLOOR, keep_missing: bool = False) -> DataFrame:
    """Per bin: counts, shares and part of PSI. `actual` marks the rows of the actual side; edges come from the others.

    Bins absent from both sides of a group do not count; bins absent from one count with the floor."""
    edges = equal_frequency(df.where(~actual), column, n_bins)
    binned = df.select(*groups, bin_number(F.col(column), edges, (), keep_missing).alias("bin"), actual.alias("__actual")).where("bin IS NOT NULL")
    counts = binned.groupBy(*groups, "bin").agg(F.count_if(~F.col("__actual")).alias("expected"), F.count_if("__actual").alias("actual"))
    keyed = counts if groups else counts.withColumn("__all", F.lit(0))
    return _parts(keyed, groups or ["__all"], smoothing, floor).drop("__all")


def psi(details: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Sum over bins; null where one side has no rows (PSI is then impossible)."""
    both = (F.sum("expected") > 0) & (F.sum("actual") > 0)
    return details.groupBy(*groups).agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"), F.when(both, F.sum("psi")).alias("psi"))


def psi_many(df: DataFrame, actual: Column, columns: Sequence[str], n_bins: int = 10, floor: float = FLOOR) -> DataFrame:
    """PSI of many columns, in two passes over the data whatever their number."""
    edges = equal_frequency_many(df.where(~actual), columns, n_bins)
    cells = F.array(*(F.struct(F.lit(c).alias("variable"), bin_number(F.col(c), edges[c]).alias("bin")) for c in columns))
    long = df.select(actual.alias("__actual"), F.explode(cells).alias("c")).select("__actual", "c.*").where("bin IS NOT NULL")
    counts = long.groupBy("variable", "bin").agg(F.count_if(~F.col("__actual")).alias("expected"), F.count_if("__actual").alias("actual"))
    return psi(_parts(counts, ["variable"], "clip", floor), ["variable"])


def psi_within(df: DataFrame, group: str, benchmark, column: str, n_bins: int = 10, floor: float = FLOOR) -> DataFrame:
    """PSI of each group value against the benchmark value's rows. Nulls of group and column are dropped."""
    known = df.where(F.col(group).isNotNull())
    base = F.col(group) == benchmark
    edges = equal_frequency(known.where(base), column, n_bins)
    counts = known.select(group, bin_number(F.col(column), edges).alias("bin")).where("bin IS NOT NULL").groupBy(group, "bin").agg(F.count("*").alias("actual"))
    reference = counts.where(base).select("bin", F.col("actual").alias("expected"))
    frame = counts.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(len(edges) - 1))))
    full = frame.join(counts, [group, "bin"], "left").join(reference, "bin", "left").na.fill(0, ["actual", "expected"])
    present = full.where("actual > 0 OR expected > 0")
    return psi(_parts(present, [group], "clip", floor), [group])


def distribution_shift(df: DataFrame, group: str, benchmark, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Share of each group above the benchmark group's quantiles, one row a group, variable and quantile."""
    row = percentiles(df.where(F.col(group) == benchmark), {c: F.col(c) for c in columns}, shares)
    each = [F.avg((F.col(c) > row[c][i]).cast("double")).alias(f"{c}|{q}") for c in columns for i, q in enumerate(shares)]
    wide = df.where(F.col(group).isNotNull()).groupBy(group).agg(*each)
    long = wide.unpivot([group], [f"`{c}|{q}`" for c in columns for q in shares], "cell", "above")
    name = F.split("cell", r"\|")
    return long.select(group, name[0].alias("variable"), name[1].cast("double").alias("quantile"), "above")
