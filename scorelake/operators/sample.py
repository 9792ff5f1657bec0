"""Sampling, splits, reweighting and reject inference.

Splits are functions of a key's hash, not of a random generator: the same rows give the same split on any cluster and after
any retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import bin_number, equal_frequency, equal_width


def unit_hash(keys: Sequence[str], seed: int = 0) -> Column:
    """A number in [0, 1) that the keys and the seed decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


def hash_split(df: DataFrame, keys: Sequence[str], shares: dict[str, float], seed: int = 0, name: str = "sample") -> DataFrame:
    """Each row to a part with the given share, in expectation; no shuffle."""
    u, at, out = unit_hash(keys, seed), 0.0, F.lit(list(shares)[-1])
    for part, share in reversed(list(_ranges(shares))):
        out = F.when(u < share, part).otherwise(out)
    return df.withColumn(name, out)


def _ranges(shares: dict[str, float]):
    at = 0.0
    for part, share in shares.items():
        at += share
        yield part, at


def stratified_sample(df: DataFrame, strata: Sequence[str], keys: Sequence[str], share: float, seed: int = 0, blocks: int = 64) -> DataFrame:
    """round(share * n) rows of each stratum exactly, those with the least hash.

    Ranks come from counts of hash blocks; only the one block of a stratum that holds the cut is ordered."""
    marked = df.withColumn("__u", unit_hash(keys, seed)).withColumn("__b", F.floor(F.col("__u") * blocks))
    per = marked.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*strata)
    upto = per.withColumns({"__take": F.round(F.sum("__n").over(whole) * share), "__before": F.coalesce(F.sum("__n").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = F.col("l.__b") == F.col("r.__b")
    for s in strata:
        same = same & F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}"))
    joined = marked.alias("l").join(upto.alias("r"), same).select("l.*", "r.__take", "r.__before", "r.__n")
    inside = joined.where(F.col("__before") + F.col("__n") <= F.col("__take"))
    cut = joined.where((F.col("__before") < F.col("__take")) & (F.col("__before") + F.col("__n") > F.col("__take")))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("__u", *keys))
    cut = cut.withColumn("__rank", rank).where(F.col("__before") + F.col("__rank") <= F.col("__take")).drop("__rank")
    return inside.unionByName(cut).select(*df.columns)


def undersample(df: DataFrame, target: str, keys: Sequence[str], rate: float, seed: int = 0) -> DataFrame:
    """Goods thinned by hash so that bads make up `rate`, in expectation."""
    bad, good = df.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    keep = min(1.0, bad * (1 - rate) / rate / good) if good else 1.0
    return df.where((F.col(target) == 1) | (unit_hash(keys, seed) < keep))


def oversample(df: DataFrame, target: str, keys: Sequence[str], rate: float, seed: int = 0) -> DataFrame:
    """Bads repeated so that they make up `rate`, in expectation: whole times each, and once more by hash."""
    bad, good = df.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    times = max(1.0, good * rate / (1 - rate) / bad) if bad else 1.0
    n = F.when(F.col(target) == 1, F.floor(F.lit(times)) + (unit_hash(keys, seed) < times % 1).cast("int")).otherwise(1).cast("int")
    return df.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n))).drop("__copy")


def odds_weights(p: Column, low: float = 0.1, high: float = 10.0) -> Column:
    """Density ratio from a domain classifier's probability, clipped; divide by its mean for mean 1."""
    return F.least(F.greatest(F.try_divide(p, 1 - p), F.lit(low)), F.lit(high))


def reweighted(df: DataFrame, probability: str, name: str = "weight") -> DataFrame:
    w = odds_weights(F.col(probability))
    mean = df.agg(F.avg(w)).first()[0] or 1.0
    return df.withColumn(name, w / mean)


def reject_augment(rejected: DataFrame, target: str, keys: Sequence[str], bad_rate: float, seed: int = 42) -> DataFrame:
    return rejected.withColumn(target, (unit_hash(keys, seed) < bad_rate).cast("double"))


def reject_hard(rejected: DataFrame, target: str, score: str, cutoff: float, higher_is_bad: bool = False) -> DataFrame:
    bad = F.col(score) >= cutoff if higher_is_bad else F.col(score) < cutoff
    return rejected.withColumn(target, bad.cast("double"))


def reject_fuzzy(approved: DataFrame, rejected: DataFrame, target: str, score: str, higher_is_bad: bool = False) -> DataFrame:
    """Approved rows weigh s*y + (1-s)*(1-y); rejected ones have the fractional target 1-s (s, if high is bad), weight 1."""
    s = F.col(score).cast("double")
    known = approved.withColumn("weight", s * F.col(target) + (1 - s) * (1 - F.col(target))).withColumn(target, F.col(target).cast("double"))
    return known.unionByName(rejected.withColumns({target: s if higher_is_bad else 1 - s, "weight": F.lit(1.0)}))


def reject_parcels(approved: DataFrame, rejected: DataFrame, target: str, score: str, n: int = 10, aligned: bool = True) -> DataFrame:
    """Rejected rows take the bad rate of their parcel among approved ones, else the overall rate.

    aligned: both sides share the approved side's quantile edges; else rejected parcels are equal widths of their own."""
    edges = equal_frequency(approved, score, n)
    other = edges if aligned else equal_width(rejected, score, n)
    rates = approved.groupBy(bin_number(F.col(score), edges).alias("parcel")).agg(F.avg(F.col(target).cast("double")).alias("__rate"))
    mean = approved.agg(F.avg(F.col(target).cast("double"))).first()[0]
    placed = rejected.withColumn("parcel", bin_number(F.col(score), other))
    return placed.join(F.broadcast(rates), "parcel", "left").withColumn(target, F.coalesce("__rate", F.lit(mean))).drop("__rate")  # n rows


def split_candidates(df: DataFrame, time: str, label: str, key: str, windows: Sequence[int], ratios: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """For each out-of-time window (last k periods), ratio in percent and seed: sizes and bad rates of ins, oos and oot and
    the greatest gap among them. Candidates share one scan: each row is in one cell of (period, hash bucket, seed)."""
    known = df.where(F.col(label).isin(0, 1))
    buckets = F.array(*(F.struct(F.lit(s).alias("seed"), F.pmod(F.col(key) * 31 + s * 17, F.lit(100)).cast("int").alias("bucket")) for s in seeds))
    cells = known.select(time, F.col(label).alias("y"), F.explode(buckets).alias("b")).groupBy(time, "b.seed", "b.bucket").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    places = known.select(time).distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc(time))))  # one row a period
    options = F.array(*(F.struct(F.lit(w).alias("window"), F.lit(r).alias("ratio")) for w in windows for r in ratios))
    part = F.when(F.col("age") <= F.col("window"), "oot").when(F.col("bucket") < F.col("ratio"), "ins").otherwise("oos")
    long = cells.join(F.broadcast(places), time).withColumn("o", F.explode(options)).select("seed", "bucket", "n", "bad", "age", "o.*").withColumn("part", part)
    n = lambda p: F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"n_{p}")
    rate = lambda p: F.try_divide(F.sum(F.when(F.col("part") == p, F.col("bad")).otherwise(0)).cast("double"), F.nullif(F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)), F.lit(0))).alias(f"rate_{p}")
    parts = ("ins", "oos", "oot")
    out = long.groupBy("window", "ratio", "seed").agg(*map(n, parts), *map(rate, parts))
    rates = [F.col(f"rate_{p}") for p in parts]
    return out.withColumn("gap", F.greatest(*rates) - F.least(*rates))


def recommend_split(candidates: DataFrame, least_oot: int = 0, ratio: int = 70) -> DataFrame:
    """The best candidate: enough out-of-time rows if any has them, then least gap, most such rows, nearest ratio."""
    order = [F.desc(F.col("n_oot") >= least_oot), F.col("gap"), F.desc("n_oot"), F.abs(F.col("ratio") - ratio), F.col("window"), F.col("seed")]
    return candidates.orderBy(*order).limit(1)
