"""Scorecard models on aggregates: logistic regression by Newton steps, boosted trees by histograms, selection, search,
calibration and explanation.

Rows never reach the driver. A Newton step is one aggregate of k * (k + 3) / 2 sums; a tree level is one aggregate of nodes
times features times bins. Fitted models are column expressions, so scoring stays inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edges import bin_number, equal_frequency_many


def sigmoid(m: Column) -> Column:
    return 1 / (1 + F.exp(-m))


def log_odds(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]  # the intercept first
    covariance: np.ndarray
    log_likelihood: float
    n: float

    def margin(self, replace: dict[str, Column] | None = None) -> Column:
        out = F.lit(self.coefficients[0])
        for name, b in zip(self.features, self.coefficients[1:]):
            out = out + (replace or {}).get(name, F.col(name)).cast("double") * b
        return out

    def predict(self, replace: dict[str, Column] | None = None) -> Column:
        return sigmoid(self.margin(replace))

    def aic(self) -> float:
        return 2 * len(self.coefficients) - 2 * self.log_likelihood

    def bic(self) -> float:
        return len(self.coefficients) * math.log(self.n) - 2 * self.log_likelihood

    def summary(self) -> list[tuple[str, float, float, float, float]]:
        """(name, coefficient, standard error, Wald z, p)."""
        out = []
        for name, b, v in zip(("intercept", *self.features), self.coefficients, np.diag(self.covariance)):
            se = math.sqrt(max(float(v), 0.0))
            z = b / se if se else math.nan
            out.append((name, b, se, z, math.erfc(abs(z) / math.sqrt(2)) if se else math.nan))
        return out

    def contributions(self, means: dict[str, float]) -> dict[str, Column]:
        """Exact Shapley values of a linear margin: coefficient times distance from the mean."""
        return {f: (F.col(f).cast("double") - means[f]) * b for f, b in zip(self.features, self.coefficients[1:])}


def fit_logistic(df: DataFrame, target: str, features: Sequence[str], weight: str | None = None, c: float = math.inf, rounds: int = 25, tolerance: float = 1e-8) -> Logistic:
    """Rows with all values and a target of 0 or 1. c is the inverse ridge strength on the coefficients (not the intercept)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(target).isin(0, 1)).select(F.col(target).cast("double").alias("__y"), w.alias("__w"), F.lit(1.0).alias("__x0"), *(F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features, 1))).na.drop()
    k, beta = len(features) + 1, np.zeros(len(features) + 1)
    ridge = np.diag([0.0] + [0.0 if math.isinf(c) else 1.0 / c] * (k - 1))
    x = [F.col(f"__x{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    likelihood, n, h = -math.inf, 0.0, np.eye(k)
    for _ in range(rounds):
        margin = F.lit(0.0)
        for b, xi in zip(beta, x):
            margin = margin + xi * float(b)
        p = sigmoid(margin)
        scored = known.withColumns({"__p": F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))})
        v = F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        loss = F.col("__w") * (F.col("__y") * F.ln("__p") + (1 - F.col("__y")) * F.ln(1 - F.col("__p")))
        row = scored.agg(F.sum("__w"), F.sum(loss), *(F.sum(F.col("__w") * (F.col("__y") - F.col("__p")) * xi) for xi in x), *(F.sum(v * x[i] * x[j]) for i, j in pairs)).first()
        if not row[0]:
            raise ValueError("no complete rows with a target")
        n, now = row[0], row[1] - float(beta @ ridge @ beta) / 2
        h = ridge.copy()
        for (i, j), s in zip(pairs, row[2 + k :]):
            h[i, j] += s
            if i != j:
                h[j, i] += s
        likelihood = row[1]
        step = np.linalg.lstsq(h, np.array(row[2 : 2 + k]) - ridge @ beta, rcond=None)[0]
        if np.abs(step).max() < tolerance:
            break
        beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return Logistic(tuple(features), tuple(map(float, beta)), np.linalg.pinv(h), float(likelihood), float(n))


def stepwise(df: DataFrame, target: str, features: Sequence[str], criterion: str = "aic", direction: str = "both", weight: str | None = None) -> Logistic:
    """forward starts empty, backward and both full; a step is taken while it lowers the criterion."""
    score = lambda m: m.aic() if criterion == "aic" else m.bic()
    fit = lambda names: fit_logistic(df, target, names, weight)
    now = fit([]) if direction == "forward" else fit(list(features))
    while True:
        options = []
        if direction in ("forward", "both"):
            options += [[*now.features, f] for f in features if f not in now.features]
        if direction in ("backward", "both"):
            options += [[g for g in now.features if g != f] for f in now.features]
        fitted = [fit(o) for o in options]
        best = min(fitted, key=score, default=None)
        if best is None or score(best) >= score(now) - 1e-9:
            return now
        now = best


@dataclass(frozen=True)
class Split:
    feature: str = ""
    cut: float = 0.0
    low: "Split | float" = 0.0
    high: "Split | float" = 0.0


@dataclass
class Boosted:
    features: list[str]
    base: float
    trees: list = field(default_factory=list)
    gain: dict[str, float] = field(default_factory=dict)
    offset: str | None = None

    def margin(self, replace: dict[str, Column] | None = None) -> Column:
        """Missing values go to the low side."""
        value = lambda name: (replace or {}).get(name, F.col(name)).cast("double")

        def walk(node) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            return F.when(value(node.feature) > node.cut, walk(node.high)).otherwise(walk(node.low))

        out = F.col(self.offset).cast("double") if self.offset else F.lit(self.base)
        for t in self.trees:
            out = out + walk(t)
        return out

    def predict(self, replace: dict[str, Column] | None = None) -> Column:
        return sigmoid(self.margin(replace))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(((f, self.gain.get(f, 0.0)) for f in self.features), key=lambda r: (-r[1], r[0]))


def fit_boosted(df: DataFrame, target: str, features: Sequence[str], weight: str | None = None, rounds: int = 10, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 20.0, offset: str | None = None, evaluate: DataFrame | None = None, patience: int = 3) -> Boosted:
    """Histogram boosting. offset: a column with a margin to start from (a warm start). With evaluate, rounds stop after
    `patience` without a lower loss there."""
    edges = equal_frequency_many(df.where(F.col(target).isin(0, 1)), list(features), bins)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(target).isin(0, 1)).withColumns({"__y": F.col(target).cast("double"), "__w": w})
    if offset:
        known = known.where(F.col(offset).isNotNull())
    bad, total = known.agg(F.sum(F.col("__w") * F.col("__y")), F.sum("__w")).first()
    share = min(max((bad or 0.0) / total if total else 0.5, 1e-6), 1 - 1e-6)
    model = Boosted(list(features), math.log(share / (1 - share)), offset=offset)
    binned = known.withColumns({f"__b{i}": F.coalesce(bin_number(F.col(f), edges[f]), F.lit(0)) for i, f in enumerate(features)})
    best, since = (math.inf, 0), 0
    for _ in range(rounds):
        graded = binned.withColumn("__p", model.predict()).withColumns({"__g": F.col("__w") * (F.col("__p") - F.col("__y")), "__h": F.col("__w") * F.col("__p") * (1 - F.col("__p"))})
        nodes, splits, leaves = {1: F.lit(True)}, {}, {}
        for level in range(depth + 1):
            number = F.lit(0)
            for k, test in nodes.items():
                number = F.when(test, k).otherwise(number)
            cells = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"__b{i}").alias("b")) for i in range(len(features))))
            sums = graded.select(number.alias("node"), "__g", "__h", F.explode(cells).alias("c")).where("node > 0").groupBy("node", "c.f", "c.b").agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"), F.count("*").alias("n")).collect()
            after = {}
            for k, test in nodes.items():
                own = [r for r in sums if r["node"] == k]
                g, h = (sum(r[c] for r in own if r["f"] == 0) for c in "gh")
                leaves[k] = -rate * g / (h + l2)
                found = None if level == depth else _best_split(own, g, h, l2, least, len(features))
                if found:
                    gain, f, b = found
                    name = features[f]
                    splits[k] = (name, edges[name][b])
                    model.gain[name] = model.gain.get(name, 0.0) + gain
                    high = F.col(f"__b{f}") > b
                    after |= {2 * k: test & ~high, 2 * k + 1: test & high}
            nodes = after
            if not nodes:
                break

        def build(k: int):
            return Split(*splits[k], build(2 * k), build(2 * k + 1)) if k in splits else leaves[k]  # noqa: B023

        model.trees.append(build(1))
        if evaluate is not None:
            loss = evaluate.where(F.col(target).isin(0, 1)).agg(F.avg(-F.ln(F.greatest(F.when(F.col(target) == 1, model.predict()).otherwise(1 - model.predict()), F.lit(1e-12))))).first()[0]
            if loss is not None and loss < best[0]:
                best = (loss, len(model.trees))
            elif len(model.trees) - best[1] >= patience:
                model.trees = model.trees[: best[1]]
                break
    return model


def _best_split(rows, g: float, h: float, l2: float, least: float, n_features: int):
    best = None
    for f in range(n_features):
        own = sorted((r["b"], r["g"], r["h"], r["n"]) for r in rows if r["f"] == f)
        gl = hl = nl = 0.0
        n = sum(r[3] for r in own)
        for b, dg, dh, dn in own[:-1]:
            gl, hl, nl = gl + dg, hl + dh, nl + dn
            if b == 0 or min(nl, n - nl) < least:
                continue
            gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
            if gain > 1e-9 and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def backward(df: DataFrame, target: str, features: Sequence[str], share: float = 0.99, least: int = 1, rounds: int = 3, **params) -> list[list[str]]:
    """Features kept after each round: those with gain, up to the given cumulative share of it, at least `least`."""
    kept, out = list(features), []
    for _ in range(rounds):
        ranked = fit_boosted(df, target, kept, **params).importance()
        total, at, new = sum(g for _, g in ranked) or 1.0, 0.0, []
        for name, g in ranked:
            if len(new) >= least and (at / total >= share or g == 0):
                break
            new.append(name)
            at += g
        out.append(new)
        if new == kept:
            break
        kept = new
    return out


def stable_features(rounds: Sequence[Sequence[str]]) -> list[str]:
    common = set.intersection(*map(set, rounds)) if rounds else set()
    return [f for f in rounds[0] if f in common] if rounds else []


def grid_search(fit: Callable[..., object], grid: dict[str, Sequence], score: Callable[[object], dict[str, float]], primary: str = "oos", reference: Sequence[str] = ("ins",)) -> list[tuple[dict, float, dict[str, float]]]:
    """(parameters, objective, scores), best first. Objective: primary - |mean(reference) - primary|."""
    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        scores = score(fit(**params))
        out.append((params, scores[primary] - abs(sum(scores[r] for r in reference) / len(reference) - scores[primary]), scores))
    return sorted(out, key=lambda r: -r[1])


def platt(df: DataFrame, target: str, margin: str) -> Logistic:
    return fit_logistic(df, target, [margin])


def isotonic(df: DataFrame, target: str, score: str, bins: int = 200) -> list[tuple[float, float]]:
    """(upper score, rate) steps of a non-decreasing fit, by pooling adjacent violators over at most `bins` bins."""
    edges = equal_frequency_many(df, [score], bins)[score]
    rows = df.where(F.col(target).isin(0, 1)).groupBy(bin_number(F.col(score), edges).alias("b")).agg(F.max(F.col(score).cast("double")).alias("top"), F.sum(target).alias("bad"), F.count("*").alias("n")).where("b IS NOT NULL").collect()
    runs: list[list[float]] = []
    for r in sorted(rows, key=lambda r: r["b"]):
        runs.append([r["top"], float(r["bad"]), float(r["n"])])
        while len(runs) > 1 and runs[-2][1] / runs[-2][2] >= runs[-1][1] / runs[-1][2]:
            top, bad, n = runs.pop()
            runs[-1] = [top, runs[-1][1] + bad, runs[-1][2] + n]
    return [(top, bad / n) for top, bad, n in runs]


def isotonic_column(c: Column, steps: Sequence[tuple[float, float]]) -> Column:
    out = None
    for top, rate in steps[:-1]:
        out = F.when(c <= top, rate) if out is None else out.when(c <= top, rate)
    last = F.lit(steps[-1][1])
    return last if out is None else F.when(c.isNotNull(), out.otherwise(last))


def partial_dependence(df: DataFrame, model, feature: str, grid: Sequence[float]) -> DataFrame:
    """Mean prediction with the feature set to each value: one scan for the whole grid."""
    each = [F.struct(F.lit(float(v)).alias("value"), F.avg(model.predict({feature: F.lit(float(v))})).alias("prediction")) for v in grid]
    return df.agg(F.array(*each).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def individual_curves(df: DataFrame, model, feature: str, grid: Sequence[float], key: str, centred: bool = False) -> DataFrame:
    first = model.predict({feature: F.lit(float(grid[0]))})
    each = [F.struct(F.lit(float(v)).alias("value"), (model.predict({feature: F.lit(float(v))}) - (first if centred else 0)).alias("prediction")) for v in grid]
    return df.select(key, F.explode(F.array(*each)).alias("p")).select(key, "p.*")


def accumulated_effects(df: DataFrame, model, feature: str, bins: int = 10) -> list[tuple[float, float]]:
    """(upper edge, effect), centred by counts: mean differences across each quantile bin, summed up."""
    low, high = df.agg(F.min(F.col(feature).cast("double")), F.max(F.col(feature).cast("double"))).first()
    inner = equal_frequency_many(df, [feature], bins)[feature][1:-1]
    points = sorted({low, *inner, high})
    number = bin_number(F.col(feature), [-math.inf, *points[1:-1], math.inf])
    lower, upper = F.lit(points[0]), F.lit(points[-1])
    for i in range(len(points) - 1):
        lower, upper = F.when(number == i + 1, points[i]).otherwise(lower), F.when(number == i + 1, points[i + 1]).otherwise(upper)
    rows = df.where(F.col(feature).isNotNull()).groupBy(number.alias("b")).agg(F.avg(model.predict({feature: upper}) - model.predict({feature: lower})).alias("d"), F.count("*").alias("n")).collect()
    by = {r["b"]: (r["d"], r["n"]) for r in rows}
    total, out = 0.0, []
    for i in range(1, len(points)):
        total += by.get(i, (0.0, 0))[0]
        out.append((points[i], total, by.get(i, (0.0, 0))[1]))
    centre = sum(e * n for _, e, n in out) / max(sum(n for *_, n in out), 1)
    return [(p, e - centre) for p, e, _ in out]


def correlation_clusters(pairs: Sequence[tuple[str, str, float | None]], names: Sequence[str], cut: float = 0.5) -> list[list[str]]:
    """Average linkage on 1 - |correlation|, merged while the distance is at most cut."""
    near = {frozenset(p[:2]): 1 - min(abs(p[2] or 0.0), 1.0) for p in pairs}
    groups = [[n] for n in names]
    distance = lambda a, b: sum(near.get(frozenset((x, y)), 1.0) for x in a for y in b) / (len(a) * len(b))
    while len(groups) > 1:
        d, i, j = min((distance(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > cut:
            break
        groups[i] += groups.pop(j)
    return groups
