"""Weight of evidence: tables, mappings, application, monotone and chi-square merging, categorical merging.

Merging works on the driver, on rows already aggregated to at most some hundred initial bins; applying a mapping is a `when`
chain over the data.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edges import INF, bin_number, closed, equal_frequency_many, labels
from .binning import EPS, chi_merge, chi_square, chi_square_p, merged_edges, tree_cuts, tree_edges
from .gains import bin_counts, safe_ln_ratio


def woe_table(df: DataFrame, target: str, score: str, edges: Sequence[float], specials: Sequence[float] = (), keep_missing: bool = True, groups: Sequence[str] = ()) -> DataFrame:
    """Per bin: counts, shares, rate, lift over the unweighted mean of bin rates, WOE and IV (null for pure bins)."""
    counts = bin_counts(df.where(F.col(target).isNotNull()), target, score, edges, groups, specials, keep_missing)
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    rate = F.try_divide(F.col("bad").cast("double"), F.nullif(F.col("perf"), F.lit(0)))
    out = counts.withColumns({"bad_rate": rate, "bad_pct": F.try_divide(F.col("bad"), F.nullif(F.sum("bad").over(whole), F.lit(0)).cast("double")), "good_pct": F.try_divide(F.col("good"), F.nullif(F.sum("good").over(whole), F.lit(0)).cast("double"))})
    out = out.withColumns({"lift": F.try_divide(F.col("bad_rate"), F.nullif(F.avg("bad_rate").over(whole), F.lit(0.0))), "woe": safe_ln_ratio(F.col("bad_pct"), F.col("good_pct"))})
    return out.withColumn("iv", (F.col("bad_pct") - F.col("good_pct")) * F.col("woe"))


def screening_woe(df: DataFrame, target: str, column: str, edges: Sequence[float], keep_missing: bool = True) -> DataFrame:
    """Per bin: counts, smoothed WOE and IV with totals of at least 1, as screening wants them: defined for any bin."""
    counts = bin_counts(df.where(F.col(target).isin(0, 1)), target, column, edges, keep_missing=keep_missing).select("bin", "n", "bad", "good")
    whole = Window.partitionBy(F.lit(0))
    part = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1))
    out = counts.withColumns({"bad_pct": part("bad"), "good_pct": part("good")})
    woe = F.ln((F.col("bad_pct") + EPS) / (F.col("good_pct") + EPS))
    return out.withColumns({"woe": woe, "iv": (F.col("bad_pct") - F.col("good_pct")) * woe})


def mapped_summary(df: DataFrame, target: str, model: "WoeModel", groups: Sequence[str] = ()) -> DataFrame:
    """feature, bin of a fitted mapping (0: missing), counts, shares, rate and WOE on these rows, by group if asked: all
    features in one aggregate. Bins without rows in a group are there with counts of 0, so groups are aligned."""
    known = df.where(F.col(target).isin(0, 1))
    cells = F.array(*(F.struct(F.lit(f.name).alias("feature"), F.coalesce(f.number(), F.lit(0)).alias("bin")) for f in model.features))
    long = known.select(*groups, F.col(target).alias("y"), F.explode(cells).alias("c")).select(*groups, "y", "c.*")
    counts = long.groupBy(*groups, "feature", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("bad"))
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(b).alias("bin"), F.lit(text).alias("range")) for f, b, text, _ in model.mapping()))
    each = known.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    frame = each.select(*groups, F.explode(bins).alias("b")).select(*groups, "b.*")
    out = frame.join(counts, [*groups, "feature", "bin"], "left").na.fill(0, ["n", "bad"]).withColumn("good", F.col("n") - F.col("bad"))
    whole = Window.partitionBy(*groups, "feature")
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.nullif(F.sum(c).over(whole), F.lit(0)).cast("double"))
    out = out.withColumns({"bad_rate": F.try_divide(F.col("bad").cast("double"), F.nullif(F.col("n"), F.lit(0)).cast("double")), "bad_pct": share("bad"), "good_pct": share("good")})
    return out.withColumn("woe", safe_ln_ratio(F.col("bad_pct"), F.col("good_pct")))


def smoothed(bad: float, good: float, bads: float, goods: float, eps: float = EPS) -> tuple[float, float]:
    """(WOE, IV) of the monotone engine."""
    pb, pg = bad / (bads + eps), good / (goods + eps)
    woe = math.log((pb + eps) / (pg + eps))
    return woe, (pb - pg) * woe


def is_monotone(values: Sequence[float | None], strict: bool = False) -> bool:
    v = [x for x in values if x is not None]
    steps = [b - a for a, b in zip(v[:-1], v[1:])]
    return all(s > 0 for s in steps) or all(s < 0 for s in steps) if strict else all(s >= 0 for s in steps) or all(s <= 0 for s in steps)


def direction(values: Sequence[float | None]) -> str:
    v = [x for x in values if x is not None]
    return "flat" if len(set(v)) < 2 else "none" if not is_monotone(v) else "up" if v[-1] > v[0] else "down"


def monotone_merge(counts: Sequence[tuple[float, float]]) -> list[int]:
    """counts (bad, good) by ascending bin -> sizes of merged runs. Pools neighbours that break the prevailing direction,
    the closest pair in WOE first, until the WOE is monotone."""
    runs = [[b, g, 1] for b, g in counts]
    bads, goods = sum(b for b, _ in counts), sum(g for _, g in counts)
    while len(runs) > 2:
        woe = [smoothed(b, g, bads, goods)[0] for b, g, _ in runs]
        steps = [y - x for x, y in zip(woe[:-1], woe[1:])]
        up, down = [i for i, s in enumerate(steps) if s > 0], [i for i, s in enumerate(steps) if s < 0]
        rarer = min(up, down, key=len)
        if not rarer:
            break
        i = min(rarer, key=lambda k: (abs(steps[k]), k))
        runs[i : i + 2] = [[x + y for x, y in zip(runs[i], runs[i + 1])]]
    return [n for _, _, n in runs]


def cluster_categories(rates: Sequence[tuple[str, float, float]], most: int, least_share: float = 0.02, tolerance: float = 0.0) -> list[list[str]]:
    """(category, bad, good) -> groups of categories with neighbouring bad rates."""
    runs = [[[c], b, g] for c, b, g in sorted(rates, key=lambda r: (r[1] / max(r[1] + r[2], EPS), r[0]))]
    least = least_share * sum(b + g for _, b, g in rates)
    gap = lambda x, y: abs(x[1] / max(x[1] + x[2], EPS) - y[1] / max(y[1] + y[2], EPS))
    while len(runs) > 1:
        small = [i for i, r in enumerate(runs) if r[1] + r[2] < least]
        pairs = range(len(runs) - 1)
        i = min((j for k in small[:1] for j in (k - 1, k) if j in pairs), key=lambda j: gap(runs[j], runs[j + 1])) if small else min(pairs, key=lambda j: gap(runs[j], runs[j + 1]))
        if not small and len(runs) <= most and gap(runs[i], runs[i + 1]) > tolerance:
            break
        runs[i : i + 2] = [[x + y for x, y in zip(runs[i], runs[i + 1])]]
    return [r[0] for r in runs]


@dataclass
class FeatureBins:
    """A fitted binning: edges of a numeric feature or groups of a categorical one, with WOE per bin and per special."""

    name: str
    edges: list[float] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    woe: list[float] = field(default_factory=list)
    iv: float = 0.0
    specials: dict[str, float] = field(default_factory=dict)
    missing: float = 0.0

    @property
    def categorical(self) -> bool:
        return bool(self.groups)

    def number(self) -> Column:
        c = F.col(self.name)
        if not self.categorical:
            return bin_number(c, self.edges)
        out = F.lit(None).cast("int")
        for i, members in enumerate(self.groups, 1):
            out = F.when(c.isin(members), i).otherwise(out)
        return out

    def apply(self) -> Column:
        """WOE of a value; unseen categories and missing values have the WOE of missing."""
        out = F.lit(self.missing)
        number = self.number()
        for i, w in enumerate(self.woe, 1):
            out = F.when(number == i, w).otherwise(out)
        for value, w in self.specials.items():
            out = F.when(F.col(self.name) == float(value), w).otherwise(out)
        return out


@dataclass
class WoeModel:
    features: list[FeatureBins]

    def transform(self, df: DataFrame, suffix: str = "_woe") -> DataFrame:
        return df.withColumns({f.name + suffix: f.apply() for f in self.features})

    def mapping(self) -> list[tuple[str, int, str, float]]:
        rows = []
        for f in self.features:
            named = labels(f.edges) if not f.categorical else {i: "|".join(g) for i, g in enumerate(f.groups, 1)}
            rows += [(f.name, i, named[i], w) for i, w in enumerate(f.woe, 1)] + [(f.name, 0, "missing", f.missing)]
        return rows

    def to_json(self) -> str:
        return json.dumps([asdict(f) for f in self.features])

    @staticmethod
    def from_json(text: str) -> "WoeModel":
        return WoeModel([FeatureBins(**f) for f in json.loads(text)])

    def updated(self, other: "WoeModel") -> "WoeModel":
        """This model with the features of the other in place of its own of the same name; new ones come last."""
        new = {f.name: f for f in other.features}
        return WoeModel([new.pop(f.name, f) for f in self.features] + list(new.values()))

    def iv_summary(self) -> list[tuple[str, float, int]]:
        return sorted(((f.name, f.iv, len(f.woe)) for f in self.features), key=lambda r: (-r[1], r[0]))


def fit_woe(df: DataFrame, target: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (), n_init: int = 20, n_bins: int = 10, specials: Sequence[float] = (), monotone: bool = True, chi_p: float | None = None, most_categories: int = 8, method: str = "frequency") -> WoeModel:
    """method: frequency (initial bins, then merging) or tree (Gini splits, a few aggregates a feature).

    By frequency, all numeric features are fitted together (edges, then counts of all in one pass by unpivoting), and each
    categorical one by an aggregate. What reaches the driver is features times n_init rows."""
    labelled, out = df.where(F.col(target).isin(0, 1)), []
    if method == "tree":
        edges = {c: tree_cuts(labelled, target, c, n_bins, specials=specials) for c in numeric}
    else:
        edges = equal_frequency_many(labelled, numeric, n_init, specials) if numeric else {}
    total_bad, total_good = labelled.agg(F.sum(F.when(F.col(target) == 1, 1).otherwise(0)), F.sum(F.when(F.col(target) == 0, 1).otherwise(0))).first()
    if numeric:
        cells = F.array(*(F.struct(F.lit(c).alias("feature"), bin_number(F.col(c), edges[c], specials, True).alias("bin")) for c in numeric))
        counts = labelled.select(F.col(target).alias("y"), F.explode(cells).alias("c")).groupBy("c.feature", "c.bin").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).collect()
        for c in numeric:
            own = {r["bin"]: (float(r["bad"]), float(r["n"] - r["bad"])) for r in counts if r["feature"] == c}
            n = len(edges[c]) - 1
            normal = [own.get(i, (0.0, 0.0)) for i in range(1, n + 1)]
            sizes = [1] * n
            kept = closed([e for e in edges[c][1:-1]])
            if monotone:
                sizes = monotone_merge(normal)
            if chi_p is not None or len(sizes) > n_bins:
                pooled = _pool(normal, sizes)
                again = chi_merge(pooled, n_bins, chi_p or 0.0, 0.0)
                sizes = [sum(run) for run in _runs(sizes, again)]
            pooled = _pool(normal, sizes)
            bads, goods = sum(b for b, _ in pooled), sum(g for _, g in pooled)
            scored = [smoothed(b, g, bads, goods) for b, g in pooled]
            special = {str(s): smoothed(*own[n + k], total_bad, total_good)[0] for k, s in enumerate(specials, 1) if n + k in own}
            missing = smoothed(*own[0], total_bad, total_good)[0] if 0 in own else 0.0
            out.append(FeatureBins(c, merged_edges(kept, sizes), [], [w for w, _ in scored], sum(i for _, i in scored), special, missing))
    for c in categorical:
        rates = [(r[c], float(r["bad"]), float(r["n"] - r["bad"])) for r in labelled.groupBy(c).agg(F.sum(target).alias("bad"), F.count("*").alias("n")).collect()]
        groups = cluster_categories([r for r in rates if r[0] is not None], most_categories)
        known = {r[0]: r[1:] for r in rates}
        scored = [smoothed(sum(known[m][0] for m in g), sum(known[m][1] for m in g), total_bad, total_good) for g in groups]
        missing = smoothed(*known[None], total_bad, total_good)[0] if None in known else 0.0
        out.append(FeatureBins(c, [], groups, [w for w, _ in scored], sum(i for _, i in scored), {}, missing))
    return WoeModel(out)


def _runs(values: Sequence, sizes: Sequence[int]) -> list[list]:
    out, at = [], 0
    for n in sizes:
        out.append(list(values[at : at + n]))
        at += n
    return out


def _pool(counts: Sequence[tuple[float, float]], sizes: Sequence[int]) -> list[tuple[float, float]]:
    return [tuple(map(sum, zip(*run))) for run in _runs(counts, sizes)]
