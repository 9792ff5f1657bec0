"""Pipelines that chain the operators. Each returns a dict of lazy report tables; nothing is swallowed on failure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.ordered import percentiles
from ..functions.cleaning import nan_to_null, numeric_columns, require_columns
from ..operators import compare, cross, gains, metrics, models, psi, sample, stats, woe
from ..operators.apply import evaluate

Report = dict[str, DataFrame]


def with_periods(df: DataFrame, time: str) -> DataFrame:
    """week, month and quarter of a timestamp; null where it does not parse."""
    t = F.col(time).try_cast("timestamp")
    return df.withColumns({"week": scalars.iso_week_period(t), "month": scalars.month_period(t), "quarter": scalars.quarter_period(t)})


def mock_sample(spark: SparkSession, rows: int = 80_000, features: int = 20, scores: int = 5, seed: int = 7, months: int = 12, start: str = "2024-01-01") -> DataFrame:
    """Applications with features, scores and labels that mature: a function of the row number and the seed alone."""
    unit = lambda k: sample.unit_hash(["n"], seed * 1000 + k)
    normal = lambda k: F.sqrt(-2 * F.ln(unit(2 * k) + 1e-12)) * F.cos(6.283185307179586 * unit(2 * k + 1))
    df = spark.range(rows).withColumnRenamed("id", "n")
    days = months * 30
    df = df.withColumns({"flow_id": F.concat(F.lit("FLOW_"), F.lpad(F.col("n").cast("string"), 8, "0")), "apply_timestamp": (F.lit(start).cast("timestamp").cast("long") + F.floor(unit(9001) * days * 86400)).cast("timestamp"), "is_approved": (unit(9002) < 0.6).cast("int"), "latent": normal(500)})
    df = df.withColumns({f"feat_{i:02d}": F.col("latent") * (0.5 if i % 3 == 0 else 0.0) + normal(600 + i) if i % 4 else F.floor(-F.ln(unit(600 + i) + 1e-12) * 3).cast("double") for i in range(features)})
    df = df.withColumns({f"online_model_pb_{i}": F.round(models.sigmoid(F.col("latent") * (1.5 - 0.2 * i) + normal(700 + i) - 2), 6) for i in range(1, scores + 1)})
    age = F.lit(days) - F.floor((F.col("apply_timestamp").cast("long") - F.lit(start).cast("timestamp").cast("long")) / 86400)
    bad = unit(9003) < models.sigmoid(F.col("latent") * 1.5 - 2)
    labels = {f"y_flag_dpd7_in_{d}d": F.when((F.col("is_approved") == 1) & (age >= d), bad.cast("double")) for d in (30, 90, 180)}
    return with_periods(df.withColumns(labels), "apply_timestamp").drop("n", "latent")


def sample_analysis(df: DataFrame, labels: Sequence[str], time_dims: Sequence[str], population_dims: Sequence[str], profile: Sequence[str], key: str, windows: Sequence[int] = (1, 2), ratios: Sequence[int] = (70, 80), seeds: Sequence[int] = (0, 1, 2), least_oot: int = 0) -> Report:
    require_columns(df, [*labels, *time_dims, *population_dims, *profile, key])
    df = nan_to_null(df)
    coverage = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).cast("double").alias("y")) for x in labels))).alias("c")).groupBy("c.label").agg(
        F.count("*").alias("n"), F.count("c.y").alias("observed"), (F.count("c.y") / F.count("*")).alias("observed_rate"), F.avg("c.y").alias("bad_rate")
    )
    rates = [f for x in labels for f in (F.count(x).alias(f"n_{x}"), F.avg(x).alias(f"rate_{x}"))]
    means = [f for c in profile for f in (F.avg(c).alias(f"mean_{c}"), F.percentile(c, 0.5).alias(f"median_{c}"))]
    out = {"label_coverage": coverage, "segment_bad_rate": stats.rate_tables(df, time_dims, population_dims, rates), "profile": stats.rate_tables(df, time_dims, population_dims, means)}
    for x in labels:
        tried = sample.split_candidates(df.withColumn(x, F.col(x).cast("int")), time_dims[0], x, key, windows, ratios, seeds)
        out[f"split_candidates_{x}"], out[f"recommended_{x}"] = tried, sample.recommend_split(tried, least_oot)
    return out


def score_comparison(df: DataFrame, target: str, scores: Sequence[str], groups: Sequence[str] = (), n_bins: int = 10, min_rows: int = 0) -> Report:
    """Performance overall and by group, gains per score, cross risk of the first score with each other."""
    df = nan_to_null(df)
    long = df.select(*groups, F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("s")) for s in scores))).alias("c")).select(*groups, "y", "c.*")
    out = {"performance": metrics.auc_ks(long, "y", "s", ["score"])}
    for g in groups:
        out[f"performance_{g}"] = metrics.auc_ks(long, "y", "s", ["score", g]).where(F.col("n") >= min_rows)
    for s in scores:
        out[f"gains_{s}"] = gains.gains_table(df, target, s, n_bins)
    for s in scores[1:]:
        out[f"cross_{scores[0]}_{s}"] = cross.cross_risk(df, scores[0], s, {"n": F.count("*"), "bad_rate": F.avg(F.col(target).cast("double"))}, 5)
    out["correlation"] = stats.correlation(df, list(scores))
    return out


def score_uat(offline: DataFrame, online: DataFrame, key: str, score: str, features: Sequence[str], times: Sequence[str] = (), tolerance: float = 1e-6, seconds: float = 0.0) -> Report:
    """Consistency of an online score with its offline twin; online columns get the suffix _online."""
    right = online.select(key, *(F.col(c).alias(f"{c}_online") for c in (score, *features, *times)))
    joined = offline.select(key, score, *features, *times).join(right, key, "full_outer")
    pairs = [(c, f"{c}_online") for c in (score, *features)]
    found = compare.uat_features(joined, pairs, tolerance)
    out = {"coverage": compare.uat_coverage(offline, online, key), "features": found, "per_key": compare.uat_per_key(joined, key, pairs, tolerance)}
    out["summary"] = found.select("feature", "n_mismatch", F.when(F.col("n_mismatch") == 0, "PASS").otherwise("FAIL").alias("status"))
    if times:
        out["times"] = compare.uat_times(joined, [(c, f"{c}_online") for c in times], seconds)
    return out


def feature_validation(df: DataFrame, targets: Sequence[str], features: Sequence[str], split: str = "sample", group: str | None = None, corr_cut: float = 0.75, n_bins: int = 10) -> Report:
    """Per target: WOE fit on ins, IV and KS per part; PSI against ins; correlated pairs and what to keep."""
    df = nan_to_null(df)
    require_columns(df, [*targets, *features, split])
    spark, out = df.sparkSession, {}
    out["distribution"] = stats.proc_means(df, list(features), [split])
    ins = F.col(split) == "ins"
    out["psi"] = psi.psi_many(df, ~ins, list(features), n_bins)
    pairs = stats.correlation(df.where(ins), list(features))
    out["correlated"] = stats.high_pairs(pairs, corr_cut)
    rows = [(r["var_a"], r["var_b"], r["corr"]) for r in pairs.collect()]
    for y in targets:
        model = woe.fit_woe(df.where(ins), y, list(features), n_bins=n_bins)
        long = model.transform(df).select(split, *([group] if group else []), F.col(y).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}_woe").alias("w")) for f in features))).alias("c")).select(split, *([group] if group else []), "y", "c.*")
        out[f"ks_{y}"] = metrics.auc_ks(long, "y", "w", [split, "feature", *([group] if group else [])])
        out[f"iv_{y}"] = spark.createDataFrame(model.iv_summary(), "feature string, iv double, bins int")
        kept = stats.correlation_filter(rows, {f: iv for f, iv, _ in model.iv_summary()}, corr_cut)
        out[f"keep_{y}"] = spark.createDataFrame([(k,) for k in kept], "feature string")
    return out


@dataclass
class CreditModelConfig:
    target: str
    features: Sequence[str] | None = None
    split: str | None = None
    keys: Sequence[str] = ()
    shares: dict[str, float] | None = None
    psi_most: float = 0.2
    iv_least: float = 0.02
    corr_most: float = 0.75
    algorithms: Sequence[str] = ("lr", "gbt")
    rounds: int = 10
    warm_start: str | None = None


def credit_model(df: DataFrame, config: CreditModelConfig) -> tuple[Report, dict[str, object]]:
    """Split, selection by PSI, IV and correlation, WOE, logistic regression and boosting, evaluation. (reports, models)."""
    df, y = nan_to_null(df), config.target
    features = list(config.features or numeric_columns(df, [y, *config.keys]))
    split = config.split or "sample"
    if not config.split:
        df = sample.hash_split(df, config.keys, config.shares or {"ins": 0.6, "oos": 0.2, "oot": 0.2}, name=split)
    ins = df.where(F.col(split) == "ins")
    drift = {r["variable"]: r["psi"] for r in psi.psi_many(df, F.col(split) != "ins", features).collect()}
    model = woe.fit_woe(ins, y, features)
    ivs = {f: iv for f, iv, _ in model.iv_summary()}
    kept = [f for f in features if (drift.get(f) or 0.0) < config.psi_most and ivs[f] >= config.iv_least] or features
    pairs = [(r["var_a"], r["var_b"], r["corr"]) for r in stats.correlation(ins, kept).collect()] if len(kept) > 1 else []
    kept = stats.correlation_filter(pairs, {f: ivs[f] for f in kept}, config.corr_most)
    model = woe.WoeModel([f for f in model.features if f.name in kept])
    scored, fitted, reports = model.transform(df), {"woe": model}, {}
    if config.warm_start:
        scored = scored.withColumn("__start", models.log_odds(F.col(config.warm_start)))
    part = scored.where(F.col(split) == "ins")
    if "lr" in config.algorithms:
        fitted["lr"] = models.fit_logistic(part, y, [f"{f}_woe" for f in kept])
    if "gbt" in config.algorithms:
        fitted["gbt"] = models.fit_boosted(part, y, kept, rounds=config.rounds, offset="__start" if config.warm_start else None, evaluate=scored.where(F.col(split) == "oos"))
    for name in config.algorithms:
        scored = scored.withColumn(f"score_{name}", fitted[name].predict())
        reports[f"performance_{name}"] = metrics.auc_ks(scored, y, f"score_{name}", [split])
        reports[f"gains_{name}"] = gains.gains_table(scored, y, f"score_{name}", groups=[split], ascending=False)
    reports["scored"] = scored
    return reports, fitted


def reject_inference(df: DataFrame, target: str, approved: str, features: Sequence[str], keys: Sequence[str], methods: Sequence[str] = ("augment", "hard", "fuzzy", "parcel"), score: str | None = None, evaluate_on: DataFrame | None = None) -> Report:
    """A prescore (fitted on approved rows if none is given: a bad probability), each method's combined sample, a model on
    each, and their AUC on labelled rows kept out."""
    df = nan_to_null(df)
    known = df.where((F.col(approved) == 1) & F.col(target).isNotNull())
    if score is None:
        score = "prescore"
        pre = models.fit_logistic(known, target, features).predict()
        df, known = df.withColumn(score, pre), known.withColumn(score, pre)
        evaluate_on = evaluate_on.withColumn(score, pre) if evaluate_on is not None else None
    rejected = df.where(F.col(approved) == 0)
    base = known.withColumns({target: F.col(target).cast("double"), "weight": F.lit(1.0)})
    rate = known.agg(F.avg(F.col(target).cast("double"))).first()[0]
    cut = (percentiles(known.where(F.col(target) == 1), {"s": F.col(score)}, [0.25])["s"] or [None])[0]
    combined, rows = {}, []
    for m in methods:
        if m == "fuzzy":
            combined[m] = sample.reject_fuzzy(known, rejected, target, score, higher_is_bad=True)
            continue
        if m == "augment":
            found = sample.reject_augment(rejected, target, keys, rate)
        elif m == "hard":
            found = sample.reject_hard(rejected, target, score, cut, higher_is_bad=True)
        elif m == "parcel":
            found = sample.reject_parcels(known, rejected, target, score).drop("parcel")
        else:
            raise ValueError(f"unknown method {m}")
        combined[m] = base.unionByName(found.withColumn("weight", F.lit(1.0)))
    out: Report = {f"sample_{m}": c for m, c in combined.items()}
    summary = None
    for m, c in combined.items():
        part = c.agg(F.lit(m).alias("method"), F.count("*").alias("n"), F.avg(target).alias("bad_rate"))
        summary = part if summary is None else summary.unionByName(part)
    out["summary"] = summary
    if evaluate_on is not None:
        for m, c in {"approved_only": base, **combined}.items():
            if m in ("fuzzy", "parcel"):  # a fractional target is two weighted rows
                w = F.col("weight")
                c = c.withColumn("__y", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("weight", w * F.when(F.col("__y") == 1, F.col(target)).otherwise(1 - F.col(target))).withColumn(target, F.col("__y")).drop("__y")
            fit = models.fit_logistic(c, target, features, "weight")
            r = metrics.auc_ks(evaluate_on.withColumn("__s", fit.predict()), target, "__s").first()
            rows.append((m, r["auc"], r["ks"]))
        out["ranking"] = df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -(r[1] or 0)), "method string, auc double, ks double")
    return out


def multi_dimension(df: DataFrame, labels: Sequence[str], score: str, groups: Sequence[str], subsets: dict[str, str], min_rows: int = 0) -> DataFrame:
    """AUC and KS for group x subset x label, in one plan."""
    return evaluate(df, lambda long, keys: metrics.auc_ks(long, "__label", score, keys), groups, subsets, labels, min_rows)
