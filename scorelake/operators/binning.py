"""Supervised edges: Gini trees on exact running counts, chi-square merging of fine bins, edges of each group."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edges import INF, bin_number, closed, ensure, equal_frequency, without
from ..functions.ordered import cut_points, part_of, present, running_sums

EPS = 1e-6


def chi_square(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Of two bins' (bad, good), with 1e-6 added to each cell."""
    cells = [[x + EPS for x in a], [x + EPS for x in b]]
    columns, total = [x + y for x, y in zip(*cells)], sum(map(sum, cells))
    return sum((x - sum(row) * c / total) ** 2 / (sum(row) * c / total) for row in cells for x, c in zip(row, columns))


def chi_square_p(x: float) -> float:
    """Upper tail with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2))


def chi_merge(counts: Sequence[tuple[float, float]], most: int, p: float = 0.95, least_share: float = 0.05) -> list[int]:
    """Sizes of merged runs: pool the pair with the least chi-square while there are too many bins, a bin is too small, or a
    pair does not differ at confidence p."""
    runs = [[b, g, 1] for b, g in counts]
    least = least_share * sum(map(sum, counts))
    while len(runs) > 1:
        chi = [chi_square(x[:2], y[:2]) for x, y in zip(runs[:-1], runs[1:])]
        small = [i for i, r in enumerate(runs) if r[0] + r[1] < least]
        if small:
            k = small[0]
            i = min((j for j in (k - 1, k) if 0 <= j < len(chi)), key=lambda j: chi[j])
        else:
            i = min(range(len(chi)), key=lambda j: (chi[j], j))
            if len(runs) <= most and chi_square_p(chi[i]) <= 1 - p:
                break
        runs[i : i + 2] = [[x + y for x, y in zip(runs[i], runs[i + 1])]]
    return [n for _, _, n in runs]


def merged_edges(edges: Sequence[float], sizes: Sequence[int]) -> list[float]:
    out, at = [edges[0]], 0
    for n in sizes:
        at += n
        out.append(edges[at])
    return out


def labelled_counts(df: DataFrame, target: str, column: str, edges: Sequence[float]) -> list[tuple[float, float]]:
    """(bad, good) of each bin, also of empty ones."""
    known = df.where(F.col(target).isin(0, 1)).select(F.col(target).alias("y"), bin_number(F.col(column), edges).alias("bin")).where("bin IS NOT NULL")
    found = {r["bin"]: (float(r["bad"]), float(r["n"] - r["bad"])) for r in known.groupBy("bin").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).collect()}
    return [found.get(i, (0.0, 0.0)) for i in range(1, len(edges))]


def chi_edges(df: DataFrame, target: str, column: str, n_bins: int = 10, fine: int = 50, p: float = 0.95, least_share: float = 0.05, specials: Sequence[float] = ()) -> list[float]:
    """Fine equal-frequency bins of the labelled rows, merged by chi-square."""
    known = df.where(F.col(target).isin(0, 1)).withColumn(column, without(F.col(column), specials))
    edges = equal_frequency(known, column, fine)
    return merged_edges(edges, chi_merge(labelled_counts(known, target, column, edges), n_bins, p, least_share))


def tree_edges(histogram: Iterable[tuple[float, float, float]], most_leaves: int, least_share: float = 0.05) -> list[float]:
    """Best-first Gini splits of (value, bad, good) rows, the histogram of a small column; a threshold lies midway between
    neighbours."""
    rows = sorted(histogram)
    least = least_share * sum(b + g for _, b, g in rows)
    gini = lambda b, g: (b + g) - (b * b + g * g) / (b + g) if b + g else 0.0

    def best(a: int, z: int):
        bads, goods = sum(r[1] for r in rows[a:z]), sum(r[2] for r in rows[a:z])
        found, b, g = None, 0.0, 0.0
        for i in range(a, z - 1):
            b, g = b + rows[i][1], g + rows[i][2]
            if min(b + g, bads + goods - b - g) >= least:
                gain = gini(bads, goods) - gini(b, g) - gini(bads - b, goods - g)
                if gain > 1e-12 and (found is None or gain > found[0]):
                    found = (gain, i + 1)
        return found

    leaves = [(0, len(rows), best(0, len(rows)))]
    edges = []
    while len(leaves) < most_leaves and any(x[2] for x in leaves):
        a, z, (_, cut) = leaf = max((x for x in leaves if x[2]), key=lambda x: x[2][0])
        leaves.remove(leaf)
        leaves += [(a, cut, best(a, cut)), (cut, z, best(cut, z))]
        edges.append((rows[cut - 1][0] + rows[cut][0]) / 2)
    return [-INF, *sorted(edges), INF]


def tree_cuts(df: DataFrame, target: str, column: str, most_leaves: int, least_share: float = 0.05, specials: Sequence[float] = ()) -> list[float]:
    """The edges of `tree_edges` for a column with any number of distinct values.

    Counts run over distinct values once; each split is then one aggregate over the values of the new leaves, so what
    reaches the driver is a row a leaf. Equal gains go to the lowest value."""
    v = present(without(F.col(column), specials))
    known = df.where(F.col(target).isin(0, 1)).select(v.alias("v"), F.col(target).cast("double").alias("y")).where("v IS NOT NULL")
    cuts = cut_points(known, {"v": F.col("v")})["v"]
    cells = known.groupBy("v").agg(F.sum("y").alias("bad"), F.count("*").cast("double").alias("n")).withColumn("__part", part_of(F.col("v"), cuts))
    ran = running_sums(cells, "__part", [F.col("v")], ["bad", "n"]).select("v", "cum_n", "cum_bad", "all_n", "all_bad").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        whole = ran.agg(F.max("all_n"), F.max("all_bad")).first()
        if not whole[0]:
            return [-INF, INF]
        least = least_share * whole[0]
        gini = lambda b, n: F.when(n > 0, n - (b * b + (n - b) * (n - b)) / n).otherwise(0.0)

        def split(leaves: list[tuple[float, float, float, float]]) -> list[tuple[tuple, tuple | None]]:
            """leaves (rows before, bad before, rows upto, bad upto) with their best (gain, value, rows, bad)."""
            each = []
            for i, (n0, b0, n1, b1) in enumerate(leaves):
                n, b = F.col("cum_n") - n0, F.col("cum_bad") - b0
                gain = gini(F.lit(b1 - b0), F.lit(n1 - n0)) - gini(b, n) - gini((b1 - b0) - b, (n1 - n0) - n)
                fits = (F.col("cum_n") > n0) & (F.col("cum_n") < n1) & (n >= least) & ((n1 - n0) - n >= least) & (gain > 1e-12)
                each.append(F.max(F.when(fits, F.struct(gain.alias("gain"), (-F.col("v")).alias("v"), "cum_n", "cum_bad"))).alias(f"s{i}"))
            row = ran.agg(*each).first()
            return [(leaf, row[f"s{i}"]) for i, leaf in enumerate(leaves)]

        leaves, chosen = split([(0.0, 0.0, whole[0], whole[1])]), []
        while len(leaves) < most_leaves and any(s for _, s in leaves):
            best = max((x for x in leaves if x[1]), key=lambda x: x[1]["gain"])
            (n0, b0, n1, b1), s = best
            leaves.remove(best)
            chosen.append(-s["v"])
            leaves += split([(n0, b0, s["cum_n"], s["cum_bad"]), (s["cum_n"], s["cum_bad"], n1, b1)])
        if not chosen:
            return [-INF, INF]
        above = ran.agg(*(F.min(F.when(F.col("v") > c, F.col("v"))).alias(f"v{i}") for i, c in enumerate(chosen))).first()
        return [-INF, *sorted((c + above[i]) / 2 for i, c in enumerate(chosen)), INF]
    finally:
        ran.unpersist()


def fitted_edges(df: DataFrame, target: str, column: str, n_bins: int, method: str | Sequence[float] = "frequency", specials: Sequence[float] = (), **options) -> list[float]:
    """Edges by any method: frequency, width, tree, chi2, or the given ones."""
    if method == "tree":
        return tree_cuts(df, target, column, n_bins, specials=specials, **options)
    if method == "chi2":
        return chi_edges(df, target, column, n_bins, specials=specials, **options)
    return ensure(df, column, n_bins, method, specials)


def pivot_counts(df: DataFrame, column: str, target: str) -> DataFrame:
    """Per value: goods, bads, rows and target rate, rows with both; values in which a class is absent count 0."""
    known = df.where(F.col(column).isNotNull() & F.col(target).isin(0, 1))
    out = known.groupBy(F.col(column).alias("value")).agg(F.count_if(F.col(target) == 0).alias("good"), F.count_if(F.col(target) == 1).alias("bad"), F.count("*").alias("n"))
    return out.withColumn("rate", F.col("bad") / F.col("n"))


def merge_small_bins(counts: Sequence[tuple[float, float]], least_share: float = 0.05) -> list[int]:
    """Sizes of merged runs in which no run holds less than a share of all rows: the smallest joins its smaller neighbour."""
    runs = [[b + g, 1] for b, g in counts]
    least = least_share * sum(r[0] for r in runs)
    while len(runs) > 1 and min(r[0] for r in runs) < least:
        i = min(range(len(runs)), key=lambda k: (runs[k][0], k))
        j = min((k for k in (i - 1, i + 1) if 0 <= k < len(runs)), key=lambda k: (runs[k][0], k))
        a, b = sorted((i, j))
        runs[a : b + 1] = [[runs[a][0] + runs[b][0], runs[a][1] + runs[b][1]]]
    return [n for _, n in runs]


def edges_of_labels(labels: Iterable[str]) -> list[float]:
    """The sorted distinct bounds of interval labels such as '(1, 2.5]'; other labels have none."""
    out = set()
    for text in labels:
        if text[:1] in "([" and text[-1:] in ")]" and text.count(",") == 1:
            out |= {float(x) for x in text[1:-1].split(",")}
    return sorted(out)


def grouped_bin_number(c: Column, edges: Column) -> Column:
    """1.. for a value among an array column of inner edges, right-closed; null for null and NaN."""
    v = present(c)
    return F.when(v.isNotNull(), 1 + F.size(F.filter(edges, lambda e: e < v)))


def rounded_edges(edges: Sequence[float], digits: int) -> list[float]:
    """Inner edges rounded; equal ones are one."""
    return closed([round(e, digits) for e in edges if not math.isinf(e)])
