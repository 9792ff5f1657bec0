"""Descriptive statistics: means, frequencies, correlation, slopes, VIF, categorical distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import bin_number, equal_frequency_many
from ..functions.ordered import cut_points, grouped_percentiles, part_of, percentiles, present, running_sums


def proc_means(df: DataFrame, cols: Sequence[str], groups: Sequence[str] = (), shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """N_ALL, N, mean, sample deviation, min, linear quantiles, max and missing rate of each column; null groups dropped.

    NaN is missing. Moments are one aggregate; quantiles come from distinct values, cut into parts by value."""
    known = df
    for g in groups:
        known = known.where(F.col(g).isNotNull())
    each = []
    for c in cols:
        v = present(F.col(c))
        each.append(F.struct(
            F.lit(c).alias("variable"), F.count("*").alias("n_all"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max"), (1 - F.count(v) / F.count("*")).alias("missing_rate"),
        ))
    moments = known.groupBy(*groups).agg(F.array(*each).alias("p")).select(*groups, F.explode("p").alias("p")).select(*groups, "p.*")
    quantiles = column_percentiles(known, cols, groups, shares)
    out = moments.join(quantiles, [*groups, "variable"], "left")
    return out.withColumns({f"p{round(q * 100)}": F.get("q", F.lit(i)) for i, q in enumerate(shares)}).drop("q")


def column_percentiles(df: DataFrame, cols: Sequence[str], groups: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """groups, variable, q: exact linear percentiles of each column in each group."""
    cuts = cut_points(df, {c: F.col(c) for c in cols})
    values = F.array(*(F.struct(F.lit(c).alias("variable"), part_of(F.col(c), cuts[c]).alias("__part"), present(F.col(c)).alias("v")) for c in cols))
    cells = df.select(*groups, F.explode(values).alias("c")).select(*groups, "c.*").where("v IS NOT NULL").groupBy(*groups, "variable", "__part", "v").agg(F.count("*").alias("n"))
    return grouped_percentiles(cells, [*groups, "variable"], shares)


def proc_freq(df: DataFrame, column: str, by: str = "value") -> DataFrame:
    """Counts of values with null, percent and cumulative forms, in order of the value or of descending frequency."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = [F.col("value").asc_nulls_last()] if by == "value" else [F.desc("n"), F.col("value").asc_nulls_last()]
    whole, running = Window.partitionBy(F.lit(0)), Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    return counts.withColumns({"percent": F.col("n") / total, "cum_n": F.sum("n").over(running), "cum_percent": F.sum("n").over(running) / total})


def correlation(df: DataFrame, cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each pair (a < b by place), rows with a null in the pair left out; one aggregate for all."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    each = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        each.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.corr(x, y).alias("corr"), F.count(x).alias("n")))
    return df.groupBy(*groups).agg(F.array(*each).alias("p")).select(*groups, F.explode("p").alias("p")).select(*groups, "p.*")


def high_pairs(corr: DataFrame, cut: float) -> DataFrame:
    return corr.where(F.abs("corr") > cut)


def correlation_filter(corr_rows: Sequence[tuple[str, str, float]], strength: dict[str, float], cut: float) -> list[str]:
    """Variables to keep: in descending strength (IV or KS), one is dropped if it correlates with a kept one above cut."""
    linked = {frozenset(p[:2]) for p in corr_rows if p[2] is not None and abs(p[2]) > cut}
    kept: list[str] = []
    for v in sorted(strength, key=lambda k: (-strength[k], k)):
        if not any(frozenset((v, k)) in linked for k in kept):
            kept.append(v)
    return kept


def cross_products(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """The uncentred cross-product matrix of complete rows with a constant first, from one aggregate."""
    known = df.select(F.lit(1.0).alias("__one"), *(F.col(c).cast("double").alias(c) for c in cols)).na.drop()
    names = ["__one", *cols]
    sums = known.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    m = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            m[i, j] = m[j, i] = sums[f"{i}_{j}"] or 0.0
    return m


def vif(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """1 / (1 - R^2) of each column on the others: the diagonal of the inverse correlation matrix."""
    m = cross_products(df, cols)
    mean = m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    scale = np.sqrt(np.diag(cov))
    return dict(zip(cols, np.diag(np.linalg.pinv(cov / np.outer(scale, scale))).tolist()))


def slopes(df: DataFrame, y: str, x: str, groups: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and r of y on x, rows with both."""
    known = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return known.groupBy(*groups).agg(F.count("*").alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.corr(a, b).alias("r"))


def top_values(df: DataFrame, column: str, groups: Sequence[str], k: int = 5) -> DataFrame:
    """Per group: count, missing, distinct values, and the k most frequent as 'value:count' joined by ';'.

    Counts are aggregated to (group, value) first; the ranking window sees those."""
    counts = df.groupBy(*groups, F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("value").isNull(), F.desc("n"), "value")))
    top = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull() & (F.col("rank") <= k), F.struct("rank", F.concat_ws(":", "value", F.col("n").cast("string")).alias("text")))))
    return ranked.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("n_unique"),
        F.array_join(F.transform(top, lambda t: t["text"]), ";").alias("top"),
    )


def rate_tables(df: DataFrame, time_dims: Sequence[str], population_dims: Sequence[str], aggregates: Sequence, cross: bool = True) -> DataFrame:
    """Global, per time bucket, per population, and per pair of both, in one grouping-sets aggregate.

    `level` names the grouping; dimensions outside it are null."""
    dims = [*time_dims, *population_dims]
    sets = [[], *([t] for t in time_dims), *([p] for p in population_dims), *([t, p] for t in time_dims for p in population_dims if cross)]
    out = df.groupingSets([[F.col(d) for d in s] for s in sets], *(F.col(d) for d in dims)).agg(F.grouping_id(*dims).alias("__id"), *aggregates)
    level = F.lit(None).cast("string")
    for s in sets:
        number = sum((d not in s) << (len(dims) - 1 - i) for i, d in enumerate(dims))
        level = F.when(F.col("__id") == number, "x".join(s) or "global").otherwise(level)
    return out.withColumn("level", level).drop("__id")


def chi2_selection(df: DataFrame, features: Sequence[str], target: str, level: float = 0.05) -> DataFrame:
    """feature, chi2, p_value, selected: features scaled to [0, 1] (null and NaN: 0), their sums by class against the sums
    that class sizes expect. Two aggregates whatever the number of features; one degree of freedom, as for two classes."""
    v = {c: F.coalesce(present(F.col(c)), F.lit(0.0)) for c in features}
    known = df.where(F.col(target).isin(0, 1))
    ends = known.agg(*(f for i, c in enumerate(features) for f in (F.min(v[c]).alias(f"a{i}"), F.max(v[c]).alias(f"z{i}")))).first()
    scaled = {c: (v[c] - (ends[f"a{i}"] or 0.0)) / ((ends[f"z{i}"] or 0.0) - (ends[f"a{i}"] or 0.0) or 1.0) for i, c in enumerate(features)}
    row = known.agg(F.avg(F.col(target).cast("double")).alias("share"), *(f for i, c in enumerate(features) for f in (F.sum(scaled[c]).alias(f"s{i}"), F.sum(scaled[c] * F.col(target)).alias(f"b{i}")))).first()
    rows = []
    for i, c in enumerate(features):
        total, bad, chi = row[f"s{i}"] or 0.0, row[f"b{i}"] or 0.0, 0.0
        for seen, expected in ((bad, total * (row["share"] or 0.0)), (total - bad, total * (1 - (row["share"] or 0.0)))):
            chi += (seen - expected) ** 2 / expected if expected else 0.0
        rows.append((c, chi, math.erfc(math.sqrt(chi / 2))))
    return df.sparkSession.createDataFrame([(c, x, p, p < level) for c, x, p in sorted(rows, key=lambda r: (-r[1], r[0]))], "feature string, chi2 double, p_value double, selected boolean")


def standardizer(df: DataFrame, features: Sequence[str], robust: bool = False) -> dict[str, tuple[float, float]]:
    """Centre and scale of each feature: mean and deviation, or median and quartile range; a constant's scale is 1."""
    if robust:
        found = percentiles(df, {c: F.col(c) for c in features}, [0.25, 0.5, 0.75])
        return {c: (q[1], q[2] - q[0] or 1.0) if q else (0.0, 1.0) for c, q in found.items()}
    row = df.agg(*(f for i, c in enumerate(features) for f in (F.avg(present(F.col(c))).alias(f"m{i}"), F.stddev_pop(present(F.col(c))).alias(f"s{i}")))).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(features)}


def standardized(df: DataFrame, scales: dict[str, tuple[float, float]], suffix: str = "_std") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c) - m) / s for c, (m, s) in scales.items()})


def rank_association(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """var_a, var_b, corr: Spearman correlation over rows with all columns. Mean ranks come from counts of distinct values,
    so ties share a rank and no task orders all rows."""
    known = df.select(*(present(F.col(c)).alias(c) for c in cols)).na.drop()
    cuts = cut_points(known, {c: F.col(c) for c in cols})
    ranked = known
    for c in cols:
        cells = known.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).withColumn("__part", part_of(F.col("v"), cuts[c]))
        ran = running_sums(cells, "__part", [F.col("v")], ["n"]).select(F.col("v").alias(c), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(f"__r_{c}"))
        ranked = ranked.join(ran, c)
    return correlation(ranked.select(*(F.col(f"__r_{c}").alias(c) for c in cols)), cols)


def variable_report(df: DataFrame, target: str, columns: Sequence[str], n_bins: int = 10, iv_cut: float = 0.0) -> DataFrame:
    """One row a variable: rows, missing rate, min, mean, max, bins, KS, greatest lift, IV, bumps; IV above the cut. All
    variables are binned and counted together."""
    from .gains import gains_columns, gains_summary

    edges = equal_frequency_many(df.where(F.col(target).isin(0, 1)), columns, n_bins)
    cells = F.array(*(F.struct(F.lit(c).alias("variable"), bin_number(F.col(c), edges[c], (), True).alias("bin"), present(F.col(c)).alias("v")) for c in columns))
    long = df.select(F.col(target).alias("y"), F.explode(cells).alias("c")).select("y", "c.*")
    counts = long.groupBy("variable", "bin").agg(
        F.count("*").alias("n"), F.count("y").alias("perf"), F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.count("v").alias("known"),
    )
    shown = gains_summary(gains_columns(counts, ["variable"]), ["variable"])
    ends = counts.groupBy("variable").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.try_divide(F.sum("sum"), F.nullif(F.sum("known"), F.lit(0)).cast("double")).alias("mean"), (1 - F.sum("known") / F.sum("n")).alias("missing_rate"))
    return shown.join(ends, "variable").where(F.col("iv") >= iv_cut)
