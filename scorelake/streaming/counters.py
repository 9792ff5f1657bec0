"""Streaming counters for monitoring: binned counts by time window, with edges fixed on a reference table.

These let gains and PSI be watched on one. State is windows times groups times bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edges import bin_number


def windowed_counts(stream: DataFrame, time: str, score: str, edges: Sequence[float], groups: Sequence[str] = (), window: str = "1 day", late: str = "1 day", target: str | None = None) -> DataFrame:
    """window start, groups, bin, n (and bad), for batch and streaming tables alike."""
    bad = [F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("bad")] if target else []
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))  # event time must have a time zone
    timed = timed.withWatermark(time, late) if stream.isStreaming else timed
    counts = timed.groupBy(F.window(time, window).alias("w"), *groups, bin_number(F.col(score), edges, (), True).alias("bin")).agg(F.count("*").alias("n"), *bad)
    return counts.select(F.col("w.start").alias("start"), *groups, "bin", "n", *(["bad"] if target else []))


def psi_of_counts(counts: DataFrame, reference: DataFrame, floor: float = 1e-6) -> DataFrame:
    """PSI of each window against reference shares (bin, share): one aggregate, as bins without rows are added by floor."""
    total = counts.groupBy("start").agg(F.sum("n").alias("total"))
    bins = sorted((r["bin"], r["share"]) for r in reference.collect())  # one row a bin
    listed = F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(float(s)).alias("share")) for b, s in bins))
    frame = total.select("start", "total", F.explode(listed).alias("b")).select("start", "total", "b.*")
    full = frame.join(counts.groupBy("start", "bin").agg(F.sum("n").alias("n")), ["start", "bin"], "left")
    a, e = F.greatest(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(floor)), F.greatest("share", F.lit(floor))
    return full.groupBy("start").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))
