"""Bin edges on the driver, bins as column expressions.

Bins are right-closed, (a, b], open at both ends (-inf, +inf). Missing values have bin 0 where they are kept, special
values a bin each after the normal ones; NaN is missing. Edges are few (at most some hundred): they become a balanced tree of
comparisons, so assigning bins is a projection inside whole-stage code generation, without a join or a Python function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import order_statistics, percentiles, present, tree

INF = float("inf")


def most_bins(n_bins: int, rows: int, least_share: float = 0.05) -> int:
    """min(n_bins, max(5, n // (share * n)))."""
    return min(n_bins, max(5, int(rows // (least_share * rows)))) if rows and least_share else n_bins


def closed(inner: Sequence[float | None]) -> list[float]:
    return [-INF, *sorted({float(e) for e in inner if e is not None and not math.isinf(e)}), INF]


def equal_frequency(df: DataFrame, column: str, n_bins: int = 10, specials: Sequence[float] = ()) -> list[float]:
    """Exact linear percentiles, in one aggregate."""
    return equal_frequency_many(df, [column], n_bins, specials)[column]


def equal_frequency_many(df: DataFrame, columns: Sequence[str], n_bins: int = 10, specials: Sequence[float] = ()) -> dict[str, list[float]]:
    """The edges of many columns together; exact, and no task or driver sees all values."""
    shares = [k / n_bins for k in range(1, n_bins)]
    found = percentiles(df, {c: without(F.col(c), specials) for c in columns}, shares)
    return {c: closed(found[c]) for c in columns}


def equal_width(df: DataFrame, column: str, n_bins: int = 10, specials: Sequence[float] = ()) -> list[float]:
    value = without(F.col(column), specials)
    low, high = df.agg(F.min(present(value)), F.max(present(value))).first()
    if low is None:
        return [-INF, INF]
    return closed([low + (high - low) * k / n_bins for k in range(1, n_bins)])


def higher_percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """The value at zero-based sorted place ceil(q * (n - 1))."""
    n, found = order_statistics(df, {column: F.col(column)}, shares, lambda n: [math.ceil(q * (n - 1)) for q in shares])[column]
    return [found[math.ceil(q * (n - 1))] for q in shares] if n else []


def without(c: Column, specials: Sequence[float]) -> Column:
    return F.when(~c.isin(*specials), c) if specials else c


def bin_number(c: Column, edges: Sequence[float], specials: Sequence[float] = (), keep_missing: bool = False) -> Column:
    """1..n for (edges[i-1], edges[i]], n+1.. for special values, null (or 0 with keep_missing) for null and NaN."""
    n = len(edges) - 1
    out = F.when(present(c).isNull(), F.lit(0 if keep_missing else None).cast("int"))
    for k, s in enumerate(specials, 1):
        out = out.when(c == s, n + k)
    return out.otherwise(tree(c, edges[1:-1], lambda i: F.lit(i + 1)))


def labels(edges: Sequence[float], specials: Sequence[float] = ()) -> dict[int, str]:
    text = lambda v: ("inf" if v > 0 else "-inf") if math.isinf(v) else f"{v:.6g}"
    named = {0: "missing"} | {i: f"({text(a)}, {text(b)}]" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]), 1)}
    return named | {len(edges) - 1 + k: f"[{text(s)}]" for k, s in enumerate(specials, 1)}


def label_column(number: Column, edges: Sequence[float], specials: Sequence[float] = ()) -> Column:
    out = F.lit(None).cast("string")
    for i, text in labels(edges, specials).items():
        out = F.when(number == i, text).otherwise(out)
    return out


def ensure(df: DataFrame, column: str, n_bins: int, method: str | Sequence[float], specials: Sequence[float] = ()) -> list[float]:
    if not isinstance(method, str):
        return closed(method)
    return {"frequency": equal_frequency, "width": equal_width}[method](df, column, n_bins, specials)


def edges_text(edges: Sequence[float], specials: Sequence[float] = ()) -> dict[int, str]:
    """Bin numbers with their labels; 0 is missing."""
    return labels(edges, specials)
