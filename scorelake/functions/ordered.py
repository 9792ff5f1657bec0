"""Exact order statistics at any size: percentiles and running sums in which no task and no driver sees all values.

* `order_statistics` brackets the wanted ranks by approximate percentiles (a mergeable sketch of bounded size), counts the
  zones between the brackets and gathers only the values inside them. A bracket with more than MOST_GATHERED rows is
  bracketed again first. Each round is one aggregate; what reaches the driver is bounded, what comes out is exact.
* `running_sums` cuts the ordered values into parts of about PART_ROWS rows, sums within each part by a window, and adds the
  sums of the parts before. One value that many rows share is split by a tie column where that is given.

NaN and null are missing: they have no place in an order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of a sketch is 1 / ACCURACY; rows gathered from one bracket; rows and number of parts of a running sum.
ACCURACY, MOST_GATHERED, PART_ROWS, MOST_PARTS = 4000, 20_000, 50_000, 4096
#: Columns that one aggregate handles together.
TOGETHER = 40


def present(c: Column) -> Column:
    """The value as a double; NaN becomes null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def tree(c: Column, bounds: Sequence[float], leaf: Callable[[int], Column], low: int = 0, high: int | None = None) -> Column:
    """leaf(i) where i bounds lie strictly below c, by a balanced tree of comparisons: about log2(len(bounds)) a row."""
    high = len(bounds) if high is None else high
    if low == high:
        return leaf(low)
    mid = (low + high) // 2
    return F.when(c <= F.lit(bounds[mid]), tree(c, bounds, leaf, low, mid)).otherwise(tree(c, bounds, leaf, mid + 1, high))


def place(c: Column, bounds: Sequence[float]) -> Column:
    """How many bounds lie strictly below c. Many bounds take two steps, so that the expression stays small."""
    if len(bounds) <= 128:
        return tree(c, bounds, lambda i: F.lit(i))
    step = 64
    runs = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
    run = tree(c, [r[-1] for r in runs], lambda i: F.lit(i))
    table = F.array(*(F.array(*map(F.lit, r)) for r in runs), F.array().cast("array<double>"))
    return run * step + F.size(F.filter(F.get(table, run), lambda b: b < c))


def sketch(df: DataFrame, values: dict[str, Column], shares: Sequence[float], accuracy: int = ACCURACY) -> dict[str, tuple[int, list[float]]]:
    """(rows, approximate percentiles) of each column, in one aggregate for every TOGETHER columns."""
    out, names = {}, list(values)
    for at in range(0, len(names), TOGETHER):
        own = names[at : at + TOGETHER]
        each = []
        for i, name in enumerate(own):
            v = present(values[name])
            each += [F.count(v).alias(f"n{i}"), F.percentile_approx(v, F.array(*map(F.lit, shares)), accuracy).alias(f"p{i}")]
        row = df.agg(*each).first()
        out |= {name: (row[f"n{i}"], list(row[f"p{i}"] or [])) for i, name in enumerate(own)}
    return out


def _zones(v: Column, bounds: Sequence[float]) -> Column:
    """2j for a value between bounds j-1 and j, 2j + 1 for one that equals bound j."""
    return tree(v, bounds, lambda j: F.when(v == F.lit(bounds[j]), 2 * j + 1).otherwise(2 * j) if j < len(bounds) else F.lit(2 * j))


def _count_zones(df: DataFrame, values: dict[str, Column], bounds: dict[str, list[float]], gather: dict[str, set[int]]) -> dict[str, dict[int, tuple[int, dict[float, int]]]]:
    """{column: {zone: (rows, {value: rows} where the zone is to be gathered)}}."""
    names, cells = list(values), []
    for i, name in enumerate(names):
        v = present(values[name])
        cells.append(F.struct(F.lit(i).alias("i"), _zones(v, bounds[name]).alias("zone"), v.alias("v")))
    wide = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v IS NOT NULL")
    inside = [1000 * i + zone for i, name in enumerate(names) for zone in sorted(gather[name])]  # a column has few hundred zones
    long = wide.withColumn("v", F.when((F.col("i") * 1000 + F.col("zone")).isin(inside), F.col("v")))
    out: dict[str, dict[int, tuple[int, dict[float, int]]]] = {name: {} for name in names}
    for r in long.groupBy("i", "zone", "v").agg(F.count("*").alias("n")).collect():  # zones, and gathered values
        n, histogram = out[names[r["i"]]].setdefault(r["zone"], (0, {}))
        if r["v"] is not None:
            histogram[r["v"]] = r["n"]
        out[names[r["i"]]][r["zone"]] = (n + r["n"], histogram)
    return out


def _between(bounds: Sequence[float], low: float, high: float) -> set[int]:
    """Zones of the values strictly between two numbers of bounds, or infinity."""
    ends = [-math.inf, *bounds, math.inf]
    return {2 * j for j in range(len(bounds) + 1) if ends[j] >= low and ends[j + 1] <= high}


def _pick(histogram: dict[float, int], ranks: Sequence[int]) -> list[float]:
    out, seen, left = [], 0, list(ranks)
    for v in sorted(histogram):
        seen += histogram[v]
        while left and left[0] < seen:
            out.append(v)
            left.pop(0)
    return out


def order_statistics(df: DataFrame, values: dict[str, Column], shares: Sequence[float], ranks: Callable[[int], list[int]]) -> dict[str, tuple[int, dict[int, float]]]:
    """{column: (rows, {rank: value})} for the zero-based ranks that ranks(rows) names, which lie near the given shares."""
    names, out = list(values), {}
    sides = [(max(0.0, q - 1.5 / ACCURACY), min(1.0, q + 1.5 / ACCURACY)) for q in shares]
    near = sorted({x for side in sides for x in side})
    for at in range(0, len(names), TOGETHER):
        own = {name: values[name] for name in names[at : at + TOGETHER]}
        first = sketch(df, own, near) if near else {}
        wanted = {name: sorted(set(ranks(n))) if n else [] for name, (n, _) in first.items()}
        found: dict[str, dict[int, float]] = {name: {} for name in own}
        bounds = {name: sorted(set(p)) for name, (_, p) in first.items()}
        gather = {
            name: set().union(*(_between(bounds[name], p[near.index(a)], p[near.index(b)]) for a, b in sides)) if n and n * 4 <= MOST_GATHERED * ACCURACY else set()
            for name, (n, p) in first.items()
        }
        while left := {name: own[name] for name in first if len(found[name]) < len(wanted[name])}:
            counted = _count_zones(df, left, bounds, gather)
            for name, column in left.items():
                below, cut, ends = 0, [], [-math.inf, *bounds[name], math.inf]
                for zone, (n, histogram) in sorted(counted[name].items()):
                    here = [r for r in wanted[name] if below <= r < below + n and r not in found[name]]
                    if here and zone % 2:
                        found[name] |= dict.fromkeys(here, bounds[name][zone // 2])
                    elif here and histogram:
                        found[name] |= dict(zip(here, _pick(histogram, [r - below for r in here])))
                    elif here:
                        cut.append((ends[zone // 2], ends[zone // 2 + 1], n))
                    below += n
                if cut:
                    v = present(column)
                    large = {str(i): F.when((v > low) & (v < high), v) for i, (low, high, n) in enumerate(cut) if n > MOST_GATHERED}
                    inner = sketch(df, large, [k / 200 for k in range(1, 200)])
                    edges = {e for low, high, _ in cut for e in (low, high)} | {e for _, p in inner.values() for e in p}
                    bounds[name] = sorted(e for e in edges if not math.isinf(e))
                    gather[name] = set().union(*(_between(bounds[name], low, high) for low, high, n in cut if n <= MOST_GATHERED))
        out |= {name: (first[name][0] if name in first else 0, found[name]) for name in own}
    return out


def linear(n: int, found: dict[int, float], q: float) -> float:
    """The linear percentile of n values, from the two ranks about it."""
    at = q * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    a, b = found[low], found[high]
    return a if a == b else (high - at) * a + (at - low) * b


def percentiles(df: DataFrame, values: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float]]:
    """Exact linear percentiles of each column; none for a column without values."""
    found = order_statistics(df, values, shares, lambda n: [r for q in shares for r in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))}])
    return {name: [linear(n, own, q) for q in shares] if n else [] for name, (n, own) in found.items()}


def cut_points(df: DataFrame, values: dict[str, Column]) -> dict[str, list[float]]:
    """Bounds that cut each column's rows into parts of about PART_ROWS rows; a value of many rows is there more than once."""
    grid = [k / 256 for k in range(1, 256)]
    first, out = sketch(df, values, grid, 2000), {}
    wanted = {name: min(max(1, n // PART_ROWS), MOST_PARTS) for name, (n, _) in first.items()}
    large = {name: values[name] for name, parts in wanted.items() if parts > 256}
    most = max(wanted.values(), default=1)
    second = sketch(df, large, [k / most for k in range(1, most)], 4 * most) if large else {}
    for name, parts in wanted.items():
        steps, found = (most, second[name][1]) if name in large else (256, first[name][1])
        out[name] = [found[k * steps // parts - 1] for k in range(1, parts)]
    return out


def part_of(c: Column, bounds: Sequence[float], tie: Column | None = None, tie_bounds: Sequence[float] = ()) -> Column:
    """The part of a value, and of the tie column where one value fills more than a part: (part, part within the value).

    Such a value is the upper bound of its part, so its rows come last there."""
    distinct = sorted(set(bounds))
    hot = sorted({b for b in distinct if bounds.count(b) > 1}) if tie is not None and tie_bounds else []
    v = present(c)
    within = F.when(v.isin(hot), 1 + place(present(tie), sorted(set(tie_bounds)))).otherwise(0) if hot else F.lit(0)
    return F.struct(place(v, distinct).alias("a"), within.alias("b"))


def running_sums(cells: DataFrame, part: str, order: Sequence[Column], sums: Sequence[str], groups: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """cells with cum_<c> (up to and with the row, in the order given) and all_<c> (of the group) for each column c of sums.

    part: a column that grows with the order. Windows see one part; the parts' sums are few and are joined to them."""
    keyed = cells.withColumn("__zero", F.lit(0)) if not groups else cells
    keys = list(groups) or ["__zero"]
    by_part = F.desc(part) if descending else F.asc(part)
    parts = keyed.groupBy(*keys, part).agg(*(F.sum(c).alias(f"__s_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy(by_part).rowsBetween(Window.unboundedPreceding, -1)
    zero = {c: F.lit(0).cast(parts.schema[f"__s_{c}"].dataType) for c in sums}
    offsets = parts.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(part).alias("__of"),
        *(F.coalesce(F.sum(f"__s_{c}").over(before), zero[c]).alias(f"__b_{c}") for c in sums),
        *(F.sum(f"__s_{c}").over(Window.partitionBy(*keys)).alias(f"all_{c}") for c in sums),
    )
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.withColumns({f"__c_{c}": F.sum(c).over(within) for c in sums})
    same = F.col(part) == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = summed.join(offsets, same).withColumns({f"cum_{c}": F.col(f"__c_{c}") + F.col(f"__b_{c}") for c in sums})
    return out.drop("__zero", "__of", *(f"__k{i}" for i in range(len(keys))), *(f"__{x}_{c}" for x in "cb" for c in sums))


def grouped_percentiles(cells: DataFrame, groups: Sequence[str], shares: Sequence[float], value: str = "v", part: str = "__part", n: str = "n") -> DataFrame:
    """groups, q: the exact linear percentiles of each group, from cells (groups, part, value, n rows) of distinct values."""
    ran = running_sums(cells, part, [F.col(value)], [n], groups)
    spots = []
    for i, q in enumerate(shares):
        at = F.lit(q) * (F.col(f"all_{n}") - 1)
        for side, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            here = (F.col(f"cum_{n}") - F.col(n) <= rank) & (rank < F.col(f"cum_{n}"))
            spots.append(F.max(F.when(here, F.col(value))).alias(f"{side}{i}"))
        spots.append(F.max(at - F.floor(at)).alias(f"f{i}"))
    found = ran.groupBy(*groups).agg(*spots)
    each = [F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(F.col(f"a{i}") * (1 - F.col(f"f{i}")) + F.col(f"b{i}") * F.col(f"f{i}")) for i in range(len(shares))]
    return found.select(*groups, F.array(*each).alias("q"))
