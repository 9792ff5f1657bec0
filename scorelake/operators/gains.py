"""Gains tables: one aggregate per bin, then windows over the few bins.

Rows are pre-aggregated to (group, bin) before anything is ordered, so the windows see at most groups times bins rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import bin_number, label_column
from ..functions.ordered import cut_points, part_of, present, running_sums
from .binning import fitted_edges, grouped_bin_number
from .stats import column_percentiles


def safe_ln_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null where either is 0: a pure bin has no finite weight of evidence."""
    return F.when((a > 0) & (b > 0), F.ln(F.when(b > 0, a / b)))


def gains_columns(counts: DataFrame, groups: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """counts: groups, bin, n, perf, bad, good, score sums ... -> the whole gains table."""
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ordered = whole.orderBy("bin" if ascending else F.desc("bin"))
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x, y: F.try_divide(x, F.nullif(y.cast("double"), F.lit(0.0)))
    out = counts.withColumns({"bads": F.sum("bad").over(whole), "goods": F.sum("good").over(whole), "total": F.sum("n").over(whole)})
    out = out.withColumns(
        {
            "prop": share(F.col("n"), F.col("total")),
            "bad_rate": share(F.col("bad"), F.col("perf")),
            "lift": share(share(F.col("bad"), F.col("perf")), share(F.col("bads"), F.col("bads") + F.col("goods"))),
            "bad_pct": share(F.col("bad"), F.col("bads")),
            "good_pct": share(F.col("good"), F.col("goods")),
            "cum_bad_pct": share(F.sum("bad").over(running), F.col("bads")),
            "cum_good_pct": share(F.sum("good").over(running), F.col("goods")),
        }
    )
    before = F.lag("bad_rate").over(ordered)
    shift = F.try_divide(F.col("bad_rate"), F.nullif(before, F.lit(0.0))) - 1 if ascending else F.try_divide(before, F.nullif(F.col("bad_rate"), F.lit(0.0))) - 1
    woe = safe_ln_ratio(F.col("bad_pct"), F.col("good_pct"))
    out = out.withColumns({"ks": F.abs(F.col("cum_bad_pct") - F.col("cum_good_pct")), "bad_shift": shift, "woe": woe})
    out = out.withColumns({"bump": F.when(F.col("bad_shift") < 0, 1).otherwise(0), "iv": (F.col("bad_pct") - F.col("good_pct")) * F.col("woe")})
    return out.drop("bads", "goods", "total")


def bin_counts(df: DataFrame, target: str, score: str, edges: Sequence[float], groups: Sequence[str] = (), specials: Sequence[float] = (), keep_missing: bool = False, metrics: dict[str, Column] | None = None) -> DataFrame:
    return _counts(df.withColumn("bin", bin_number(F.col(score), edges, specials, keep_missing)), target, score, groups, metrics)


def _counts(df: DataFrame, target: str, score: str, groups: Sequence[str], metrics: dict[str, Column] | None) -> DataFrame:
    binned = df.where("bin IS NOT NULL")
    y = F.col(target)
    each = [
        F.count("*").alias("n"),
        F.count(y).alias("perf"),
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("bad"),
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("good"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("avg_score"),
    ]
    return binned.groupBy(*groups, "bin").agg(*each, *(c.alias(k) for k, c in (metrics or {}).items()))


def gains_table(df: DataFrame, target: str, score: str, n_bins: int = 10, method: str | Sequence[float] = "frequency", groups: Sequence[str] = (), min_group: int = 0, specials: Sequence[float] = (), keep_missing: bool = False, ascending: bool = True, metrics: dict[str, Column] | None = None, edges: Sequence[float] | None = None) -> DataFrame:
    """method: frequency, width, tree, chi2, or the edges. Edges come from all rows, and every group is cut at the same ones
    (`gains_by_own_edges` cuts each at its own). Groups below min_group rows are left out."""
    edges = list(edges) if edges else fitted_edges(df, target, score, n_bins, method, specials)
    counts = bin_counts(df, target, score, edges, groups, specials, keep_missing, metrics)
    if groups and min_group:
        counts = counts.withColumn("__rows", F.sum("n").over(Window.partitionBy(*groups))).where(F.col("__rows") >= min_group).drop("__rows")
    out = gains_columns(counts, groups, ascending)
    return out.withColumn("range", label_column(F.col("bin"), edges, specials))


def gains_by_own_edges(df: DataFrame, target: str, score: str, groups: Sequence[str], n_bins: int = 10, ascending: bool = True, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Each group is cut at its own percentiles, in one plan whatever the number of groups. Null groups are left out."""
    known = df
    for g in groups:
        known = known.where(F.col(g).isNotNull())
    found = column_percentiles(known, [score], groups, [k / n_bins for k in range(1, n_bins)])
    cut = found.select(*groups, F.array_distinct("q").alias("__edges"))
    binned = known.join(cut, list(groups)).withColumn("bin", grouped_bin_number(F.col(score), F.col("__edges")))
    return gains_columns(_counts(binned, target, score, groups, metrics), groups, ascending)


def with_summary(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The table with a row of totals for each group, whose bin is null."""
    total = table.groupBy(*groups).agg(
        F.lit(None).cast("int").alias("bin"), *(F.sum(c).alias(c) for c in ("n", "perf", "bad", "good", "iv")), F.min("min_score").alias("min_score"), F.max("max_score").alias("max_score"),
        F.try_divide(F.sum(F.col("avg_score") * F.col("n")), F.sum("n")).alias("avg_score"), F.max("ks").alias("ks"), F.sum("bump").alias("bump"),
    )
    total = total.withColumns({"bad_rate": F.try_divide(F.col("bad").cast("double"), F.nullif(F.col("perf"), F.lit(0)).cast("double")), "prop": F.lit(1.0), "lift": F.lit(1.0)})
    return table.unionByName(total, allowMissingColumns=True)


def cumulative_rates(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """bin, share, capture rate, cumulative bads, gain, and the bad rate of all rows up to the bin."""
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    running = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return table.select(
        *groups, "bin", "n", F.col("prop").alias("proportion"), F.col("bad").alias("sum_true"), F.col("bad_rate").alias("avg_true"), F.col("bad_pct").alias("capture_rate"), "lift",
        F.sum("bad").over(running).alias("cumsum_true"), F.col("cum_bad_pct").alias("gain"), (F.sum("bad").over(running) / F.sum("n").over(running)).alias("cumavg_true"),
    )


def gains_summary(table: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row (a group): rows, labelled rows, bad rate, greatest KS and lift, IV, bumps, bins."""
    return table.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.sum("perf").alias("perf"),
        F.sum("bad").alias("bad"),
        F.try_divide(F.sum("bad").cast("double"), F.nullif(F.sum("perf"), F.lit(0))).alias("bad_rate"),
        F.max("ks").alias("ks"),
        F.max("lift").alias("max_lift"),
        F.coalesce(F.sum("iv"), F.lit(0.0)).alias("iv"),
        F.sum("bump").alias("bumps"),
        F.count("*").alias("bins"),
    )


def weighted_rank_bins(df: DataFrame, target: str, score: str, weight: str, n_bins: int = 10) -> DataFrame:
    """Weighted gains: bins of equal cumulative weight in descending score order, tied scores in one bin.

    Rows of one score are summed first; the running sums are cut into parts by score.
    """
    w = F.col(weight).cast("double")
    known = df.where(F.col(target).isNotNull()).withColumn("__s", present(F.col(score))).where("__s IS NOT NULL")
    cuts = cut_points(known, {"s": F.col("__s")})["s"]
    by_score = known.groupBy(F.col("__s").alias("s")).agg(F.sum(w).alias("w"), F.sum(w * F.col(target)).alias("wb"), F.count("*").alias("n"))
    ran = running_sums(by_score.withColumn("__part", part_of(F.col("s"), cuts)), "__part", [F.desc("s")], ["w"], descending=True)
    number = F.least(F.greatest(F.ceil(F.try_divide(F.col("cum_w"), F.col("all_w")) * n_bins - 1e-9), F.lit(1)), F.lit(n_bins))
    binned = ran.withColumn("bin", number.cast("int")).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("w").alias("weight"), F.sum("wb").alias("bad"), F.min("s").alias("min_score"), F.max("s").alias("max_score"))
    whole, running = Window.partitionBy(F.lit(0)), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("weight") - F.col("bad")
    out = binned.withColumns({"good": good, "bad_rate": F.try_divide(F.col("bad"), F.col("weight"))})
    overall = F.sum("bad").over(whole) / F.sum("weight").over(whole)
    cum_bad, cum_good = F.sum("bad").over(running) / F.sum("bad").over(whole), F.sum("good").over(running) / F.sum("good").over(whole)
    return out.withColumns({"lift": F.try_divide(F.col("bad_rate"), overall), "cum_bad_pct": cum_bad, "cum_good_pct": cum_good, "ks": F.abs(cum_bad - cum_good)})
