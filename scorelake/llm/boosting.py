"""Gradient boosting of small trees with logistic loss on a table of any size, and trees as Spark expressions.

Rows stay in Spark, counted by the steps of their features: integers below FINE are steps of their own, above each octave has
8. Groups of rows get trees of their own, grown side by side: for each level of a round's trees the driver gets sums of
gradients by (group, node, feature, step), a bounded number, and picks each node's best split among all steps. Gradients are
summed as integers and leaves are multiples of 1 / GRID, so sums are exact: the order of rows and tasks changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values below this are steps of their own; the unit of gradients; leaves are multiples of 1 / GRID up to MOST.
FINE, UNIT, GRID, MOST = 64, 1 << 20, 256, 2.0


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def step(value: Column) -> Column:
    """The least integer of the value's step."""
    v = value.cast("long")
    drop = F.char_length(F.bin(v)) - 4
    return F.when(v < FINE, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop))


def last(of: int) -> int:
    """The largest integer of a step."""
    return of if of < FINE else of + (1 << (of.bit_length() - 4)) - 1


def leaf(g: int, h: int, rate: float, l2: float) -> Node:
    value = -rate * (g / UNIT) / (h / UNIT + l2)
    return Node(round(max(-MOST, min(MOST, value)) * GRID) / GRID)


def best_split(sums: dict[int, list[tuple[int, int, int]]], l2: float, least: float) -> tuple | None:
    """sums: feature -> (step, g, h). (feature, cut, low's g and h, high's g and h) of the largest gain, the first of equals."""
    gain_of = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + l2)
    best, found = 1e-6, None
    for feature in sorted(sums):
        steps = sorted(sums[feature])
        g, h = sum(s[1] for s in steps), sum(s[2] for s in steps)
        gl = hl = 0
        for (a, ga, ha), (b, _, _) in zip(steps[:-1], steps[1:]):
            gl, hl = gl + ga, hl + ha
            if min(hl, h - hl) < least / 16 * UNIT:
                continue
            gain = gain_of(gl, hl) + gain_of(g - gl, h - hl) - gain_of(g, h)
            if gain > best:
                best, found = gain, (feature, (last(a) + b) / 2, gl, hl, g - gl, h - hl)
    return found


def _walk(nodes: dict[int, Node], depth: int) -> tuple[list[int], list[float], list[float]]:
    """Features, cuts and values of a whole tree of the depth: below a leaf everything goes low."""
    features, cuts, values = [], [], {}
    for k in range(2**depth - 1):
        node = nodes.get(k)
        features.append(node.feature if node and node.feature >= 0 else 0)
        cuts.append(node.cut if node and node.feature >= 0 else float("inf"))
    for k, node in nodes.items():
        if node.feature < 0:
            while k < 2**depth - 1:
                k = 2 * k + 1
            values[k] = node.value
    return features, cuts, [values.get(k, 0.0) for k in range(2**depth - 1, 2 ** (depth + 1) - 1)]


def _array(values: list, kind: str) -> str:
    """One literal of SQL, so that plans of equal shape share their compiled code."""
    return f"cast(split('{','.join(map(str, values)).replace('inf', 'Infinity')}', ',') AS array<{kind}>)"


def _node_of(features: list[int], cuts: list[float], first: str, levels: int) -> str:
    """SQL of the node that x reaches after so many levels of the tree whose nodes begin at first."""
    low = f"get(x, get({_array(features, 'int')}, {first} + k)) <= get({_array(cuts, 'double')}, {first} + k)"
    return f"aggregate(sequence(1, {levels}), 0, (k, l) -> 2 * k + if({low}, 1, 2))" if levels else "0"


def margins(trees: list[list[dict[int, Node]]], depth: int) -> Column:
    """The sum of group g's trees for x, an array of features or of their steps. trees: of each group, equally many."""
    if not trees or not trees[0]:
        return F.lit(0.0)
    features, cuts, values = (sum(parts, []) for parts in zip(*(_walk(t, depth) for own in trees for t in own)))
    n, inner, leaves = len(trees[0]), 2**depth - 1, 2**depth
    node = _node_of(features, cuts, f"(g * {n} + t) * {inner}", depth)
    return F.expr(f"aggregate(sequence(0, {n - 1}), 0D, (a, t) -> a + get({_array(values, 'double')}, (g * {n} + t) * {leaves} + {node} - {inner}))")


def boost(cells: DataFrame, groups: int, rounds: int = 24, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 4.0) -> list[list[dict[int, Node]]]:
    """cells: g (below groups), x (array of steps), n, hits: so many rows, so many of them positive. Of each group its trees:
    nodes by their place, children of k at 2k + 1 (low) and 2k + 2."""
    trees: list[list[dict[int, Node]]] = [[] for _ in range(groups)]
    p = F.col("p")
    slope = F.col("n") * F.round(p * UNIT).cast("long") - F.col("hits") * UNIT
    bend = F.col("n") * F.round(p * (1 - p) * UNIT).cast("long")
    for _ in range(rounds):
        rows = cells.select("g", "x", "n", "hits", (1 / (1 + F.exp(-margins(trees, depth)))).alias("p"))
        rows = rows.select("g", "x", slope.alias("slope"), bend.alias("bend"))
        nodes: list[dict[int, Node]] = [{} for _ in range(groups)]
        open_ = [{0: (0, 0)} for _ in range(groups)]
        for level in range(depth):
            features, cuts = (sum(parts, []) for parts in list(zip(*(_walk(t, depth) for t in nodes)))[:2])
            at = F.expr(_node_of(features, cuts, f"g * {2**depth - 1}", level))
            each = rows.select("g", at.alias("node"), "slope", "bend", F.posexplode("x").alias("f", "s"))
            sums: dict[tuple[int, int], dict[int, list[tuple[int, int, int]]]] = {}
            for r in each.groupBy("g", "node", "f", "s").agg(F.sum("slope"), F.sum("bend")).collect():  # groups * nodes * features * steps
                sums.setdefault((r["g"], r["node"]), {}).setdefault(r["f"], []).append((r["s"], r[4], r[5]))
            for g in range(groups):
                below = {}
                for k, own in open_[g].items():
                    found = sums.get((g, k), {})
                    if split := best_split(found, l2, least):
                        nodes[g][k] = Node(0.0, split[0], split[1])
                        below |= {2 * k + 1: split[2:4], 2 * k + 2: split[4:6]}
                    else:
                        nodes[g][k] = leaf(sum(s[1] for s in found.get(0, [])), sum(s[2] for s in found.get(0, [])), rate, l2)
                open_[g] = below
            if not any(open_):
                break
        for g in range(groups):
            nodes[g] |= {k: leaf(*own, rate, l2) for k, own in open_[g].items()}
            trees[g].append(nodes[g])
    return trees


def linked(nodes: dict[int, Node], k: int = 0) -> Node:
    """The tree from its nodes by place."""
    node = nodes[k]
    return node if node.feature < 0 else Node(0.0, node.feature, node.cut, linked(nodes, 2 * k + 1), linked(nodes, 2 * k + 2))


def expression(trees: list[Node], features: list[Column]) -> Column:
    def walk(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(node.value)
        return F.when(features[node.feature] <= node.cut, walk(node.low)).otherwise(walk(node.high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + walk(tree)
    return total


def threshold(margin: np.ndarray, n: np.ndarray, hits: np.ndarray, precision: float = 0.99) -> float:
    """The least margin of a positive example down to which at least the given share is positive, and no less than even odds;
    above all margins where there is none. n examples have each margin, hits of them positive."""
    order = np.argsort(-margin, kind="stable")
    share = np.cumsum(hits[order]) / np.cumsum(n[order])
    good = np.flatnonzero((share >= precision) & (hits[order] > 0))
    return max(0.0, float(margin[order[good[-1]]])) if len(good) else float("inf")
