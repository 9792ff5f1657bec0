import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm import quality
from scorelake.llm.common import documents

from . import test_decontaminate, test_line_dedup, test_ngram_join


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    kept = corpus_pipeline.keep_quality(spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0.6 < kept.count() / docs.count() < 0.99
    lines = corpus_pipeline.drop_lines(spark, kept, sf).cache()
    want = test_line_dedup.brute(rows_of(kept))
    got = Counter((r["doc_id"], r["sha"]) for r in lines.select("doc_id", F.sha2("text", 256).alias("sha")).collect())
    assert got == Counter({(i, sha): n for (i, _, _, sha), n in want.items()})
    near = corpus_pipeline.drop_near_duplicates(spark, lines, sf).cache()
    groups = test_ngram_join.brute(rows_of(lines))
    assert sorted(i for i, _ in rows_of(near)) == sorted(i for i, _, c in groups if i == c)
    clean = corpus_pipeline.drop_contaminated(spark, near, sf).cache()
    bad = {i for i, _ in test_decontaminate.brute(rows_of(near), [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])}
    assert [i for i, _ in rows_of(clean)] == [i for i, _ in rows_of(near) if i not in bad]
    packed = corpus_pipeline.pack_sequences(spark, clean, sf)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in rows_of(clean)}
    assert corpus_pipeline.run(spark, sf).select(F.sum("length")).first() == packed.select(F.sum("length")).first()


def test_quality_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.quality_scores(docs, model).join(labels, "doc_id").where(quality.held_out("doc_id"))
    rows = scored.select("score", "predicted", "quality").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert (good[:, None] > bad).mean() > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None, 0) for i in range(25)] + [(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.quality_scores(odd, model)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())
    assert quality.quality_scores(empty, model).count() == 0
    none = quality.train(odd, labels.limit(0))
    assert {r["predicted"] for r in quality.quality_scores(odd, none).collect()} == {1}
    held = {r["doc_id"]: r["h"] for r in odd.select("doc_id", quality.held_out("doc_id").alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_solver_reaches_the_least_primal_cost():
    """Against subgradient steps on half the squared weights plus the hinge losses."""
    rng = np.random.default_rng(3)
    dims, n = 12, 60
    rows = [np.sort(rng.choice(dims, size=4, replace=False)) for _ in range(n)]
    values = [rng.normal(size=4) for _ in range(n)]
    y = np.where(rng.random(n) < 0.5, 1.0, -1.0)
    cost = rng.uniform(0.2, 2.0, n)
    x = np.zeros((n, dims + 1))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, dims] = v, 1.0
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, bias = quality.descend(rows, values, y, cost, dims, rounds=4000)
    solved = primal(np.append(w, bias))
    z, best = np.zeros(dims + 1), np.inf
    for k in range(20_000):
        bad = y * (x @ z) < 1
        z = z - (z - ((cost * y)[bad, None] * x[bad]).sum(axis=0)) / (k + 2)
        best = min(best, primal(z))
    assert solved <= best + 1e-2 * abs(best)
    assert all(primal(np.append(w, bias) + rng.normal(scale=0.05, size=dims + 1)) >= solved - 1e-2 for _ in range(200))


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = documents(spark, sf).withColumns({c: F.lit(f"own {c}") for c in ("score", "predicted", "n_lines", "n_dropped", "h1", "spans", "item")}).limit(60)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r["score"] == "own score" and r["n_dropped"] == "own n_dropped" and r["item"] == "own item" for r in out.collect())
