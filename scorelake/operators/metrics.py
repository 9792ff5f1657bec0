"""ROC, PR, AUC, KS and percentile tables, also weighted and by group.

Rows are summed to distinct scores first; running sums over them are cut into parts by score (`functions.ordered`), so no
task sees all distinct scores, however many there are, and none are rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import equal_frequency
from ..functions.ordered import cut_points, part_of, present, running_sums


def _running(df: DataFrame, target: str, score: str, groups: Sequence[str], weight: str | None) -> DataFrame:
    """groups, threshold, bad, good with their running sums from the highest score down, and totals."""
    s = present(F.col(score))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(target).isin(0, 1)).withColumn("__s", s).where("__s IS NOT NULL")
    cuts = cut_points(known, {"s": F.col("__s")})["s"]
    counts = known.groupBy(*groups, F.col("__s").alias("threshold")).agg(F.sum(w * F.col(target)).alias("bad"), F.sum(w * (1 - F.col(target))).alias("good"))
    parted = counts.withColumn("__part", part_of(F.col("threshold"), cuts))
    return running_sums(parted, "__part", [F.desc("threshold")], ["bad", "good"], groups, descending=True).drop("__part")


def share(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def roc_points(df: DataFrame, target: str, score: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """threshold, bad, good, tpr, fpr at each distinct score."""
    points = _running(df, target, score, groups, weight)
    out = points.withColumns({"tpr": share(F.col("cum_bad"), F.col("all_bad")), "fpr": share(F.col("cum_good"), F.col("all_good"))})
    return out.select(*groups, "threshold", "bad", "good", "tpr", "fpr")


def auc_ks(df: DataFrame, target: str, score: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n (weight), bad rate, AUC by the trapezoid rule, KS and its threshold; null AUC and KS where one class is absent."""
    points = _running(df, target, score, groups, weight)
    tpr, fpr = share(F.col("cum_bad"), F.col("all_bad")), share(F.col("cum_good"), F.col("all_good"))
    before = share(F.col("cum_bad") - F.col("bad"), F.col("all_bad"))
    points = points.withColumns({"tpr": tpr, "fpr": fpr, "area": share(F.col("good"), F.col("all_good")) * (tpr + before) / 2})
    both = (F.sum("bad") > 0) & (F.sum("good") > 0)
    gap = F.abs(F.col("tpr") - F.col("fpr"))
    return points.groupBy(*groups).agg(
        F.sum(F.col("bad") + F.col("good")).alias("n"),
        share(F.sum("bad"), F.sum(F.col("bad") + F.col("good"))).alias("bad_rate"),
        F.when(both, F.sum("area")).alias("auc"),
        F.when(both, F.max(gap)).alias("ks"),
        F.when(both, F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12).alias("gap"), "threshold"))["threshold"]).alias("ks_threshold"),
    )


def pr_points(df: DataFrame, target: str, score: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    points = _running(df, target, score, groups, weight)
    out = points.withColumns({"precision": F.try_divide(F.col("cum_bad"), F.col("cum_bad") + F.col("cum_good")), "recall": share(F.col("cum_bad"), F.col("all_bad"))})
    return out.select(*groups, "threshold", "bad", "good", "precision", "recall")


def break_even(points: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The point of least |precision - recall|."""
    at = F.min(F.struct(F.round(F.abs(F.col("precision") - F.col("recall")), 12).alias("gap"), "threshold", "precision", "recall"))
    return points.groupBy(*groups).agg(at.alias("p")).select(*groups, "p.threshold", "p.precision", "p.recall")


def percentile_table(df: DataFrame, target: str, score: str, n_bins: int = 10, key: str | None = None) -> DataFrame:
    """Equal-count bins by place in the score order: floor(n / bins) rows each, the last takes the remainder.

    Places come from running counts of distinct (score, key) values; `key` breaks ties, else tied scores share a bin. A
    numeric key also splits a score that very many rows share over several tasks."""
    known = df.where(F.col(target).isin(0, 1)).select(present(F.col(score)).alias("s"), F.col(target).alias("y"), (F.col(key) if key else F.lit(0)).alias("k")).where("s IS NOT NULL")
    numeric = key is not None and known.schema["k"].dataType.typeName() not in ("string", "binary", "boolean", "timestamp", "date")
    cuts = cut_points(known, {"s": F.col("s")} | ({"k": F.col("k")} if numeric else {}))
    part = part_of(F.col("s"), cuts["s"], F.col("k") if numeric else None, cuts.get("k", ()))
    order = ["s", "k"] if key else ["s"]
    cells = known.groupBy(*order).agg(F.count("*").alias("n"), F.sum("y").alias("bad"), F.sum("s").alias("sum")).withColumn("__part", part)
    ran = running_sums(cells, "__part", [F.col(c) for c in order], ["n"])
    place = F.col("cum_n") - 1
    number = F.least(F.floor(place / F.greatest(F.floor(F.col("all_n") / n_bins), F.lit(1))) + 1, F.lit(n_bins)).cast("int")
    binned = ran.withColumn("bin", number).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("s").alias("min_score"), F.max("s").alias("max_score"), (F.sum("sum") / F.sum("n")).alias("avg_score"))
    whole, running = Window.partitionBy(F.lit(0)), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rate, overall = F.col("bad") / F.col("n"), F.sum("bad").over(whole) / F.sum("n").over(whole)
    return binned.withColumns({"bad_rate": rate, "lift": F.try_divide(rate, overall), "cum_n": F.sum("n").over(running), "cum_bad": F.sum("bad").over(running), "gain": F.try_divide(F.sum("bad").over(running).cast("double"), F.sum("bad").over(whole))})


def lift_grid(table: DataFrame, grid: Sequence[float]) -> DataFrame:
    """For each wanted lift, from the best bins on, the deepest cumulative share of rows that still has it.

    A theta join of two bounded sides (the grid, the bins of a percentile table)."""
    spark = table.sparkSession
    whole, running = Window.partitionBy(F.lit(0)), Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    rate = F.sum("bad").over(running) / F.sum("n").over(running)
    cumulative = table.select((F.sum("n").over(running) / F.sum("n").over(whole)).alias("depth"), (rate / (F.sum("bad").over(whole) / F.sum("n").over(whole))).alias("actual"))
    wanted = spark.createDataFrame([(float(g),) for g in grid], "lift double")
    met = F.broadcast(wanted).join(cumulative, F.col("actual") >= F.col("lift"), "left")
    return met.groupBy("lift").agg(F.max("depth").alias("depth"), F.max_by("actual", "depth").alias("actual"))


def score_ties(df: DataFrame, score: str) -> DataFrame:
    """rows, distinct values (null is one) and tie rate 1 - distinct / rows."""
    distinct = F.countDistinct(score) + F.max(F.when(F.col(score).isNull(), 1).otherwise(0))
    return df.agg(F.count("*").alias("n"), distinct.alias("n_distinct"), (1 - F.try_divide(distinct, F.count("*"))).alias("tie_rate"))


def calibration(df: DataFrame, target: str, probability: str, n_bins: int = 10) -> DataFrame:
    """Observed against predicted rate by uniform probability bins, and each bin's part of the Brier score."""
    b = F.least(F.floor(F.col(probability) * n_bins) + 1, F.lit(n_bins)).cast("int")
    known = df.where(F.col(target).isin(0, 1) & F.col(probability).isNotNull())
    return known.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("predicted"), F.avg(F.col(target).cast("double")).alias("observed"), F.avg(F.pow(F.col(probability) - F.col(target), F.lit(2.0))).alias("brier"))


def perf_summary(frames: dict[str, DataFrame], target: str, score: str, n_bins: int = 10, weight: str | None = None) -> DataFrame:
    """One row for each named table (train, validation, ...): rows, bad rate, AUC, KS, greatest lift of bins cut at the
    first table's percentiles, and PSI against it, all from one union."""
    from .gains import gains_table
    from .psi import psi, psi_details

    first = next(iter(frames))
    columns = [target, score, *([weight] if weight else [])]
    parts = [df.select(*columns).withColumn("dataset", F.lit(name)) for name, df in frames.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    edges = equal_frequency(frames[first], score, n_bins)
    lift = gains_table(union, target, score, groups=["dataset"], edges=edges).groupBy("dataset").agg(F.max("lift").alias("max_lift"))
    out = auc_ks(union, target, score, ["dataset"], weight).drop("ks_threshold").join(lift, "dataset")
    base = frames[first].select(score)
    shift = None
    for name, df in frames.items():  # few tables
        pair = base.withColumn("__new", F.lit(False)).unionByName(df.select(score).withColumn("__new", F.lit(True)))
        one = psi(psi_details(pair, F.col("__new"), score, n_bins)).select(F.lit(name).alias("dataset"), "psi")
        shift = one if shift is None else shift.unionByName(one)
    return out.join(shift, "dataset")


def validated_weight(df: DataFrame, weight: str | None = None) -> Column:
    """The weight column as doubles, 1 without one. Raises where a weight is null, NaN, infinite or negative."""
    if weight is None:
        return F.lit(1.0)
    w = F.col(weight).cast("double")
    bad = df.agg(F.count_if(w.isNull() | F.isnan(w) | (w < 0) | (F.abs(w) == float("inf")))).first()[0]
    if bad:
        raise ValueError(f"{bad} weights of {weight} are null, negative or not finite")
    return w


def brier_score(df: DataFrame, target: str, probability: str, weight: str | None = None) -> DataFrame:
    """Mean squared distance of the probability from the label, over labelled rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(target).isin(0, 1) & F.col(probability).isNotNull())
    return known.agg(F.try_divide(F.sum(w * F.pow(F.col(probability) - F.col(target), F.lit(2.0))), F.sum(w)).alias("brier"))


def calibration_comparison(df: DataFrame, target: str, raw: str, calibrated: str, n_bins: int = 10) -> DataFrame:
    """The reliability curves of a raw and a calibrated probability side by side, with each one's Brier score."""
    parts = []
    for name, p in (("raw", raw), ("calibrated", calibrated)):
        total = brier_score(df, target, p).first()[0]
        parts.append(calibration(df, target, p, n_bins).withColumns({"total": F.lit(total), "which": F.lit(name)}))
    return parts[0].unionByName(parts[1])
