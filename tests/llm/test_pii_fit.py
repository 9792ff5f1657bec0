"""The trees and thresholds of all labelled spans: counts, and growth against a plain version that sees every row."""

import math

import numpy as np
from pyspark.sql import functions as F

from scorelake.llm import boosting, pii


def test_every_labelled_span_counts(spark):
    """6,000 numbers of 16 digits and as many tokens: four times what one sample of a kind held."""
    text = F.concat_ws(" ", F.lit("number"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**16)).cast("string"), 16, "7"), F.lit("token"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"))
    spans = pii.labelled_spans(docs).withColumn("held", F.pmod(F.xxhash64("kind", "m", "before"), F.lit(3)) == 0)
    want = {r["kind"]: (r["n"], r["held"], r["hits"]) for r in spans.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("held").cast("int")).alias("held"), F.sum(F.when(F.col("held"), F.col("y"))).alias("hits")).collect()}
    assert want["id_number"][0] == 6000 and want["secret"][0] > 5900
    report = pii.fit(docs).report
    for kind in ("id_number", "secret"):
        n, held, hits = want[kind]
        if 0 < hits < held:
            assert report[kind][:3] == ("documents", held, hits / held)
    assert report["id_number"][0] == "documents" and report["id_number"][1] > 1800
    counted = pii.span_counts(docs).where("documents").groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {list(pii.MORE)[r["g"]]: r["n"] for r in counted} == {kind: n for kind, (n, _, _) in want.items()}


def step(v):
    return v if v < 64 else v >> (v.bit_length() - 4) << (v.bit_length() - 4)


def grown(x, y, rounds, depth):
    """Margins of each row and the trees' (feature, cut) in order, level by level, row by row in whole numbers."""
    margin, splits = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = [round(v * 2**20) - int(t) * 2**20 for v, t in zip(p, y)], [round(v * (1 - v) * 2**20) for v in p]
        level = [list(range(len(y)))]
        gain = lambda rows: (sum(g[i] for i in rows) / 2**20) ** 2 / (sum(h[i] for i in rows) / 2**20 + 1)
        leaves = []
        for _ in range(depth):
            below = []
            for rows in level:
                best, found = 1e-6, None
                for f in range(x.shape[1]):
                    steps = sorted({step(int(x[i, f])) for i in rows})
                    for a, b in zip(steps[:-1], steps[1:]):
                        low, high = [i for i in rows if step(int(x[i, f])) <= a], [i for i in rows if step(int(x[i, f])) > a]
                        if min(sum(h[i] for i in low), sum(h[i] for i in high)) < 2**18:
                            continue
                        if (now := gain(low) + gain(high) - gain(rows)) > best:
                            largest = a if a < 64 else a + 2 ** (a.bit_length() - 4) - 1
                            best, found = now, (f, (largest + b) / 2, low, high)
                if found:
                    splits.append(found[:2])
                    below += found[2:]
                else:
                    leaves.append(rows)
            level = below
        for rows in leaves + level:
            value = -0.3 * (sum(g[i] for i in rows) / 2**20) / (sum(h[i] for i in rows) / 2**20 + 1)
            margin[rows] += round(max(-2, min(2, value)) * 256) / 256
    return margin, splits


def test_trees_against_all_rows(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 12, 90), rng.integers(0, 2, 90), (2.0 ** rng.uniform(3, 14, 90)).astype(int)])
    group = np.arange(90) % 2
    y = np.where(group == 0, (x[:, 0] > 5) ^ (rng.random(90) < 0.1), (x[:, 2] > 900) & (x[:, 1] == 1)).astype(int)
    rows = spark.createDataFrame([(int(g), [float(v) for v in r], int(t)) for g, r, t in zip(group, x, y)], "g int, raw array<double>, y int")
    cells = rows.select("g", "raw", F.transform("raw", boosting.step).alias("x"), "y")
    trees = boosting.boost(cells.groupBy("g", "x").agg(F.count("*").alias("n"), F.sum("y").alias("hits")), 2, rounds=3, depth=2)
    for g in (0, 1):
        want, splits = grown(x[group == g], y[group == g], 3, 2)
        got = [(t[k].feature, t[k].cut) for t in trees[g] for k in sorted(t) if t[k].feature >= 0]
        assert got == splits and len(got) >= 4
        plain = boosting.expression([boosting.linked(t) for t in trees[g]], [F.get("raw", k) for k in range(3)])
        both = cells.where(F.col("g") == g).select("raw", boosting.margins(trees, 2).alias("by_steps"), plain.alias("by_values")).collect()
        by_row = {tuple(map(float, r)): float(m) for r, m in zip(x[group == g], want)}
        assert all(r["by_steps"] == r["by_values"] == by_row[tuple(r["raw"])] for r in both)


def test_threshold_takes_whole_ties():
    margin, n, hits = np.array([0.5, 3.0, 2.0, 1.0]), np.array([50.0, 90.0, 20.0, 5.0]), np.array([0.0, 90.0, 19.0, 5.0])
    assert boosting.threshold(margin, n, hits, 0.99) == 1.0
    assert boosting.threshold(margin, n, hits, 0.995) == 3.0
    assert math.isinf(boosting.threshold(margin, n, np.zeros(4), 0.99))
