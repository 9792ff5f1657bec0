import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.functions import edges, scalars
from scorelake.operators import apply, metrics, models, sample, woe
from scorelake.plans import pipelines
from scorelake.sources import tables
from scorelake.streaming import counters


@pytest.fixture(scope="module")
def apps(spark):
    df = pipelines.mock_sample(spark, rows=3000, features=6, scores=2)
    df = sample.hash_split(df, ["flow_id"], {"ins": 0.6, "oos": 0.2, "oot": 0.2})
    return df.withColumn("y", F.col("y_flag_dpd7_in_30d").cast("int")).cache()


def test_mock_sample(apps):
    row = apps.agg(F.count("y_flag_dpd7_in_30d"), F.count("y_flag_dpd7_in_90d"), F.count("y_flag_dpd7_in_180d"), F.countDistinct("flow_id")).first()
    assert row[0] > row[1] > row[2] and row[3] == 3000


def test_logistic_equals_numpy(apps):
    fit = models.fit_logistic(apps, "y", ["feat_01", "feat_02", "feat_03"])
    pdf = apps.where("y IS NOT NULL").select("y", "feat_01", "feat_02", "feat_03").toPandas()
    x, y, b = np.column_stack([np.ones(len(pdf)), pdf.iloc[:, 1:]]), pdf["y"].to_numpy(), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T * (p * (1 - p)) @ x, x.T @ (y - p))
    assert np.allclose(fit.coefficients, b, atol=1e-6)
    assert fit.log_likelihood == pytest.approx(float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), rel=1e-6)
    assert fit.aic() == pytest.approx(8 - 2 * fit.log_likelihood) and len(fit.summary()) == 4
    step = models.stepwise(apps, "y", ["feat_01", "feat_03"], "bic", "forward")
    assert "feat_03" in step.features


def test_boosting_and_explanations(apps):
    known = apps.where("y IS NOT NULL")
    fit = models.fit_boosted(known.where("sample = 'ins'"), "y", ["feat_01", "feat_03", "feat_05"], rounds=4, depth=2, evaluate=known.where("sample = 'oos'"))
    auc = metrics.auc_ks(known.withColumn("s", fit.predict()), "y", "s").first()["auc"]
    assert auc > 0.55 and fit.importance()[0][0] == "feat_03"
    curve = models.partial_dependence(known, fit, "feat_03", [-1.0, 0.0, 1.0]).orderBy("value").collect()
    assert curve[0]["prediction"] < curve[-1]["prediction"]
    each = models.individual_curves(known, fit, "feat_03", [-1.0, 1.0], "flow_id", centred=True)
    assert each.where("value = -1.0").agg(F.max(F.abs("prediction"))).first()[0] == 0
    effects = models.accumulated_effects(known, fit, "feat_03", 5)
    assert effects[0][1] < effects[-1][1]
    rounds = models.backward(known, "y", ["feat_01", "feat_03"], share=0.9, rounds=1)
    assert rounds[0][0] == "feat_03" and models.stable_features([["a", "b"], ["b"]]) == ["b"]
    steps = models.isotonic(known.withColumn("s", fit.predict()), "y", "s", 20)
    assert [r for _, r in steps] == sorted(r for _, r in steps)
    ranked = models.grid_search(lambda c: c, {"c": [1, 2]}, lambda c: {"ins": 0.8, "oos": 0.7 + c / 100})
    assert ranked[0][0] == {"c": 2}
    assert models.correlation_clusters([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.0)], ["a", "b", "c"]) == [["a", "b"], ["c"]]


def test_monotone_woe(apps):
    model = woe.fit_woe(apps, "y", ["feat_03"], ["month"], n_init=15, n_bins=6)
    for f in model.features:
        assert f.categorical or woe.is_monotone([round(w, 9) for w in f.woe])
    got = model.transform(apps).select("feat_03", "feat_03_woe").limit(50).collect()
    numeric = model.features[0]
    for r in got:
        k = int(np.searchsorted(numeric.edges[1:-1], r["feat_03"], side="left"))
        assert r["feat_03_woe"] == pytest.approx(numeric.woe[k])
    assert len(woe.tree_cuts(apps, "y", "feat_03", 4)) <= 5
    assert woe.WoeModel.from_json(model.to_json()).mapping() == model.mapping()


def test_samples(apps):
    got = sample.stratified_sample(apps, ["month"], ["flow_id"], 0.25, blocks=8)
    want = {r["month"]: math.floor(r["count"] * 0.25 + 0.5) for r in apps.groupBy("month").count().collect()}
    assert {r["month"]: r["count"] for r in got.groupBy("month").count().collect()} == want
    known = apps.where("y IS NOT NULL")
    for f in (sample.undersample, sample.oversample):
        assert f(known, "y", ["flow_id"], 0.5).agg(F.avg("y")).first()[0] == pytest.approx(0.5, abs=0.05)
    weights = sample.reweighted(known.withColumn("p", F.lit(0.3)), "p").agg(F.avg("weight")).first()[0]
    assert weights == pytest.approx(1)


def test_pipelines(spark, apps):
    report = pipelines.sample_analysis(apps.withColumn("n", F.substring("flow_id", 6, 8).cast("long")), ["y"], ["month"], ["is_approved"], ["feat_01"], "n", ratios=(70,), seeds=(0, 1))
    assert report["label_coverage"].first()["n"] == 3000 and report["recommended_y"].count() == 1
    report = pipelines.score_comparison(apps, "y", ["online_model_pb_1", "online_model_pb_2"], ["month"], 5)
    assert report["performance"].count() == 2 and report["gains_online_model_pb_1"].agg(F.sum("n")).first()[0] == 3000
    report = pipelines.feature_validation(apps, ["y"], ["feat_01", "feat_03"])
    assert report["psi"].count() == 2 and report["iv_y"].orderBy(F.desc("iv")).first()["feature"] == "feat_03"
    online = apps.withColumn("feat_01", F.col("feat_01") + F.when(F.col("flow_id") == "FLOW_00000003", 1).otherwise(0))
    report = pipelines.score_uat(apps, online, "flow_id", "online_model_pb_1", ["feat_01"], ["apply_timestamp"])
    assert {r["feature"]: r["status"] for r in report["summary"].collect()} == {"online_model_pb_1": "PASS", "feat_01": "FAIL"}
    report, fitted = pipelines.credit_model(apps, pipelines.CreditModelConfig("y", [f"feat_{i:02d}" for i in range(6)], split="sample", rounds=3))
    auc = {r["sample"]: r["auc"] for r in report["performance_lr"].collect()}
    assert auc["oos"] > 0.55 and "feat_03" in [f.name for f in fitted["woe"].features]
    apps2 = apps.withColumn("target", F.when(F.col("is_approved") == 1, F.col("y")))
    report = pipelines.reject_inference(apps2, "target", "is_approved", ["feat_00", "feat_03"], ["flow_id"], evaluate_on=apps2.where("sample = 'oot' AND target IS NOT NULL"))
    assert report["ranking"].count() == 5 and report["summary"].count() == 4
    assert pipelines.multi_dimension(apps, ["y"], "feat_03", ["sample"], {"all": "true", "high": "feat_01 > 0"}, 50).count() == 6


def test_user_functions(spark, apps):
    df = apps.select("flow_id", "month", "feat_01", "feat_03")
    double = lambda p: p.assign(feat_01=p["feat_01"] * 2)
    assert apply.by_rows(df, double, df.schema).agg(F.sum("feat_01")).first()[0] == pytest.approx(2 * df.agg(F.sum("feat_01")).first()[0])
    top = apply.by_groups(df, ["month"], lambda p: pd.DataFrame({"month": [p["month"].iloc[0]], "n": [len(p)]}), "month string, n long")
    assert {(r["month"], r["n"]) for r in top.collect()} == {(r["month"], r["count"]) for r in df.groupBy("month").count().collect()}
    assert [p.columns for p in apply.by_columns(df, ["feat_01", "feat_03"], ["flow_id"], 1, lambda d: d)] == [["flow_id", "feat_01"], ["flow_id", "feat_03"]]
    probe = df.limit(20).toPandas()
    assert apply.row_wise(double, probe) and not apply.row_wise(lambda p: p.assign(feat_01=p["feat_01"] - p["feat_01"].mean()), probe)


def test_cipher_column(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string").withColumn("c", scalars.encrypt_column(F.col("t"), "k"))
    assert [r["d"] for r in df.select(scalars.encrypt_column(F.col("c"), "k", True).alias("d")).collect()] == ["abc", None]


def test_sources(spark, apps, tmp_path):
    small = apps.select("flow_id", "feat_01", "month").limit(20).cache()
    tables.write_csv(small, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "flow_id string, feat_01 double, month string").exceptAll(small).count() == 0
    tables.save_table(small, "kept_rows", stamp=True)
    tables.insert_rows(spark.table("kept_rows"), "kept_rows")
    assert tables.read_table(spark, "kept_rows", "flow_id IS NOT NULL").count() == 40
    assert tables.union_all([small, small.drop("month")], "side", ["a", "b"]).where("side = 'b' AND month IS NULL").count() == 20
    files = tables.write_report(str(tmp_path / "report"), {"a/b": small, "none": None})
    assert list(files) == ["a/b"] and len(pd.read_csv(files["a/b"])) == 20
    large = tables.write_report(str(tmp_path / "report"), {"x": small}, most_rows=5)
    assert large["x"].endswith(".parquet") and spark.read.parquet(large["x"]).count() == 20
    parts = tables.pull_parts(spark, "kept_rows", ["flow_id"], 3, str(tmp_path / "parts"))
    assert tables.push_parts(spark, [p for p in parts if (tmp_path / "parts" / p.rsplit("/", 1)[1]).exists()], "kept_again") == 40
    tables.save_model(str(tmp_path / "model"), "[1]", auc=0.7)
    assert tables.load_model(str(tmp_path / "model")) == ("[1]", {"auc": 0.7})


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    cuts = edges.equal_frequency(events, "value", 4)
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = counters.windowed_counts(stream, "ts", "value", cuts, ["event_type"], late="60 days").writeStream.outputMode("complete").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    batch = counters.windowed_counts(events, "ts", "value", cuts, ["event_type"])
    assert {tuple(r) for r in spark.table("seen").collect()} == {tuple(r) for r in batch.collect()}
    reference = spark.createDataFrame([(i, 0.25) for i in range(1, 5)], "bin int, share double")
    assert counters.psi_of_counts(batch, reference).where("psi < 0").count() == 0
