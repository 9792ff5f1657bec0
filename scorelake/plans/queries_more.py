"""Further queries with their SQL: edges of groups and trees, models at given or fitted coefficients, explanation, samples,
reports of pipelines, user functions, sources and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, scalars, sqltext
from ..functions.edges import bin_number, edges_text, equal_frequency
from ..functions.ordered import percentiles
from ..operators import apply, binning, gains, metrics, models, sample, stats, woe
from ..sources import tables
from . import pipelines
from .queries import FREQ10, LINES, bin_sql, gains_sql, lines, no_range, query, quantiles, rnd, roc_sql

OWN = f"SELECT l_returnflag AS flag, {quantiles('l_extendedprice', 5)} AS edges FROM lines GROUP BY 1"


@query(gains_sql(OWN, groups=("l_returnflag",), y="yn", source="lines JOIN (SELECT flag FROM e) f ON f.flag = l_returnflag", number=bin_sql("l_extendedprice", "edges")).replace(", e GROUP BY ALL", " JOIN e ON e.flag = l_returnflag GROUP BY ALL").replace("lines JOIN (SELECT flag FROM e) f ON f.flag = l_returnflag", "lines"))
def gains_own_edges(t):
    """Each group is cut at its own percentiles."""
    return gains.gains_by_own_edges(lines(t), "yn", "l_extendedprice", ["l_returnflag"], 5)


@query(gains_sql(FREQ10, final="SELECT bin, n, bad, round(iv, 6) AS iv, round(ks, 6) AS ks, round(bad_rate, 6) AS bad_rate FROM w UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(bad) AS BIGINT), round(sum(iv), 6), round(max(ks), 6), round(sum(bad) / sum(perf)::DOUBLE, 6) FROM w"))
def gains_with_summary(t):
    return gains.with_summary(gains.gains_table(lines(t), "y", "l_extendedprice", 10)).select("bin", "n", "bad", "iv", "ks", "bad_rate")


@query(gains_sql(FREQ10, final="SELECT bin, n, round(prop, 6) AS proportion, bad AS sum_true, round(bad_rate, 6) AS avg_true, round(bad_pct, 6) AS capture_rate, round(lift, 6) AS lift, CAST(sum(bad) OVER (ORDER BY bin) AS BIGINT) AS cumsum_true, round(cum_bad_pct, 6) AS gain, round(sum(bad) OVER (ORDER BY bin) / sum(n) OVER (ORDER BY bin), 6) AS cumavg_true FROM w"))
def gains_cumulative(t):
    return gains.cumulative_rates(gains.gains_table(lines(t), "y", "l_extendedprice", 10))


@query(gains_sql(FREQ10, tail=", n_unique", extra=", count(DISTINCT l_extendedprice) AS n_unique"))
def gains_unique_scores(t):
    return no_range(gains.gains_table(lines(t), "y", "l_extendedprice", 10, metrics={"n_unique": F.count_distinct("l_extendedprice")}))


def split_sql(column: str) -> str:
    """The best Gini split of a column into two leaves of at least 5 % of the rows."""
    gini = lambda b, n: f"({n} - ({b} * {b} + ({n} - {b}) * ({n} - {b})) / {n})"
    return f"""
h AS (SELECT {column} AS v, sum(y)::DOUBLE AS b, count(*)::DOUBLE AS n FROM lines GROUP BY 1),
r AS (SELECT v, sum(b) OVER (ORDER BY v) AS lb, sum(n) OVER (ORDER BY v) AS ln, sum(b) OVER () AS tb, sum(n) OVER () AS tn, lead(v) OVER (ORDER BY v) AS nx FROM h),
s AS (SELECT v, nx, {gini('tb', 'tn')} - {gini('lb', 'ln')} - {gini('(tb - lb)', '(tn - ln)')} AS gain FROM r WHERE nx IS NOT NULL AND ln >= 0.05 * tn AND tn - ln >= 0.05 * tn),
best AS (SELECT (v + nx) / 2 AS edge FROM s WHERE gain > 1e-12 ORDER BY gain DESC, v LIMIT 1)"""


@query(f"WITH {LINES}, {split_sql('l_extendedprice')} SELECT round(edge, 6) AS edge FROM best")
def tree_split(t):
    """The first split of a Gini tree over a column of nearly as many values as rows."""
    df = lines(t)
    edges = binning.tree_cuts(df, "y", "l_extendedprice", 2)
    return df.sparkSession.createDataFrame([(e,) for e in edges[1:-1]], "edge double")


@query(f"WITH {LINES}, {split_sql('l_quantity')}, e AS (SELECT edge FROM best) SELECT CASE WHEN l_quantity <= edge THEN 1 ELSE 2 END AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS bad FROM lines, e GROUP BY 1")
def gains_tree_edges(t):
    return gains.gains_table(lines(t), "y", "l_quantity", 2, "tree").select("bin", "n", "bad")


@query(f"WITH {LINES}, e AS (SELECT list_sort({quantiles('l_extendedprice', 4)}) AS edges FROM lines) SELECT i AS bin, '(' || CASE WHEN i = 1 THEN '-inf' ELSE printf('%.6g', edges[i - 1]) END || ', ' || CASE WHEN i = len(edges) + 1 THEN 'inf' ELSE printf('%.6g', edges[i]) END || ']' AS range FROM e, (SELECT unnest([1, 2, 3, 4]) AS i)")
def bin_labels(t):
    """Labels of the bins, and that labels lead back to their edges."""
    df = lines(t)
    edges = equal_frequency(df, "l_extendedprice", 4)
    named = edges_text(edges)
    assert len(binning.edges_of_labels(named.values())) == len(edges)
    return df.sparkSession.createDataFrame([(i, text) for i, text in named.items() if i], "bin int, range string")


@query(f"WITH {LINES} SELECT l_discount AS value, count(*) FILTER (WHERE yn = 0) AS good, count(*) FILTER (WHERE yn = 1) AS bad, count(*) AS n, round(avg(yn), 6) AS rate FROM lines WHERE yn IS NOT NULL GROUP BY 1")
def pivot_counts(t):
    return binning.pivot_counts(lines(t), "l_discount", "yn")


SCREEN = f"""WITH {LINES}, e AS (SELECT {quantiles('taxn', 4)} AS edges FROM lines),
c AS (SELECT CASE WHEN taxn IS NULL THEN 0 ELSE {bin_sql('taxn', 'edges')} END AS bin, count(*) AS n, CAST(sum(yn) AS BIGINT) AS bad, CAST(sum(1 - yn) AS BIGINT) AS good FROM lines, e WHERE yn IS NOT NULL GROUP BY 1),
p AS (SELECT *, bad / greatest(sum(bad) OVER (), 1)::DOUBLE AS bad_pct, good / greatest(sum(good) OVER (), 1)::DOUBLE AS good_pct FROM c),
w AS (SELECT *, ln((bad_pct + 1e-6) / (good_pct + 1e-6)) AS woe FROM p)"""


@query(SCREEN + f" SELECT bin, n, bad, good, {rnd('bad_pct', 'good_pct', 'woe')}, round((bad_pct - good_pct) * woe, 6) AS iv FROM w")
def woe_screening(t):
    df = lines(t)
    return woe.screening_woe(df, "yn", "taxn", equal_frequency(df, "taxn", 4))


def fitted(t) -> woe.WoeModel:
    model = woe.fit_woe(lines(t), "y", ["taxn", "l_quantity"], n_init=4, monotone=False)
    again = woe.WoeModel.from_json(model.to_json())
    return again.updated(woe.WoeModel([f for f in model.features if f.name == "taxn"]))


MAPPED = f"""WITH {LINES}, e AS (SELECT {quantiles('taxn', 4)} AS te, {quantiles('l_quantity', 4)} AS qe FROM lines),
x AS (SELECT l_returnflag, l_linestatus, y, 'taxn' AS feature, CASE WHEN taxn IS NULL THEN 0 ELSE {bin_sql('taxn', 'te')} END AS bin FROM lines, e
  UNION ALL SELECT l_returnflag, l_linestatus, y, 'l_quantity', {bin_sql('l_quantity', 'qe')} FROM lines, e),
f AS (SELECT 'taxn' AS feature, unnest(range(0, len(te) + 2)) AS bin FROM e UNION ALL SELECT 'l_quantity', unnest(range(0, len(qe) + 2)) FROM e),
g AS (SELECT DISTINCT l_linestatus FROM lines),
c AS (SELECT g.l_linestatus, f.feature, CAST(f.bin AS INTEGER) AS bin, count(x.y) AS n, CAST(coalesce(sum(x.y), 0) AS BIGINT) AS bad FROM f CROSS JOIN g LEFT JOIN x ON x.feature = f.feature AND x.bin = f.bin AND x.l_linestatus = g.l_linestatus GROUP BY ALL),
s AS (SELECT *, n - bad AS good, bad / nullif(sum(bad) OVER (PARTITION BY l_linestatus, feature), 0)::DOUBLE AS bad_pct, (n - bad) / nullif(sum(n - bad) OVER (PARTITION BY l_linestatus, feature), 0)::DOUBLE AS good_pct FROM c)
SELECT l_linestatus, feature, bin, n, bad, good, round(bad / nullif(n, 0)::DOUBLE, 6) AS bad_rate, round(bad_pct, 6) AS bad_pct, round(good_pct, 6) AS good_pct, round(CASE WHEN bad > 0 AND good > 0 THEN ln(bad_pct / good_pct) END, 6) AS woe FROM s
"""


@query(MAPPED)
def woe_mapped_by_group(t):
    """A mapping, stored and loaded and with a feature updated, summarised on the rows of each group; bins are aligned."""
    return woe.mapped_summary(lines(t), "y", fitted(t), ["l_linestatus"]).drop("range")


@query(f"""WITH {LINES}, e AS (SELECT {quantiles('l_extendedprice', 10)} AS edges FROM lines),
c AS (SELECT {bin_sql('l_extendedprice', 'edges')} AS bin, count(*) FILTER (WHERE y = 1) AS bad, count(*) FILTER (WHERE y = 0) AS good FROM lines, e GROUP BY 1),
w AS (SELECT bin, ln((bad / (sum(bad) OVER () + 1e-6) + 1e-6) / (good / (sum(good) OVER () + 1e-6) + 1e-6)) AS woe FROM c),
d AS (SELECT woe - lag(woe) OVER (ORDER BY bin) AS step FROM w)
SELECT bool_and(step >= 0) OR bool_and(step <= 0) AS monotone, bool_and(step > 0) OR bool_and(step < 0) AS strict FROM d WHERE step IS NOT NULL""")
def woe_monotonicity(t):
    df = lines(t)
    model = woe.fit_woe(df, "y", ["l_extendedprice"], n_init=10, monotone=False)
    w = model.features[0].woe
    return df.sparkSession.createDataFrame([(woe.is_monotone(w), woe.is_monotone(w, strict=True))], "monotone boolean, strict boolean")


def newton_sql(rounds: int = 8) -> str:
    """Newton steps of a logistic regression of y on one scaled feature, unrolled."""
    out = f"WITH {LINES}, d AS (SELECT y::DOUBLE AS y, l_quantity / 50 AS x FROM lines), b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1)"
    for i in range(1, rounds + 1):
        out += f""",
s{i} AS MATERIALIZED (SELECT sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, count(*)::DOUBLE AS n
  FROM (SELECT y, x, 1 / (1 + exp(-(c0 + c1 * x))) AS p FROM d, b{i - 1})),
b{i} AS MATERIALIZED (SELECT c0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS c0, c1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS c1 FROM b{i - 1}, s{i})"""
    return out


def scaled(t) -> DataFrame:
    return lines(t).withColumn("x", F.col("l_quantity") / 50)


LAST = "s8, b8"


@query(newton_sql() + f""" SELECT 'intercept' AS term, round(c0, 6) AS coefficient, round(sqrt(h11 / (h00 * h11 - h01 * h01)), 6) AS error FROM {LAST}
UNION ALL SELECT 'x', round(c1, 6), round(sqrt(h00 / (h00 * h11 - h01 * h01)), 6) FROM {LAST}""")
def logistic_fit(t):
    fit = models.fit_logistic(scaled(t), "y", ["x"])
    rows = [(name, b, float(v**0.5)) for name, b, v in zip(("intercept", "x"), fit.coefficients, fit.covariance.diagonal())]
    return t("region").sparkSession.createDataFrame(rows, "term string, coefficient double, error double")


@query(newton_sql() + f" SELECT round(4 - 2 * ll, 4) AS aic, round(2 * ln(n) - 2 * ll, 4) AS bic, round(ll, 4) AS log_likelihood FROM {LAST}")
def logistic_criteria(t):
    fit = models.fit_logistic(scaled(t), "y", ["x"])
    return t("region").sparkSession.createDataFrame([tuple(round(v, 4) for v in (fit.aic(), fit.bic(), fit.log_likelihood))], "aic double, bic double, log_likelihood double")


@query(newton_sql() + " SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(c0 + c1 * l_quantity / 50))), 6) AS p FROM lines, b8")
def logistic_predict(t):
    df = scaled(t)
    return df.select("l_orderkey", "l_linenumber", models.fit_logistic(df, "y", ["x"]).predict().alias("p"))


@query(newton_sql() + " SELECT round(avg((1 / (1 + exp(-(c0 + c1 * x))) - y) ** 2), 6) AS brier FROM d, b8")
def brier(t):
    df = scaled(t)
    return metrics.brier_score(df.withColumn("p", models.fit_logistic(df, "y", ["x"]).predict()), "y", "p")


#: A model with given coefficients: what explanation does with it can be said in SQL.
GIVEN = models.Logistic(("l_quantity", "l_discount"), (-1.0, 0.02, 3.0), None, 0.0, 0.0)
P = "1 / (1 + exp(-(-1.0 + 0.02 * {q} + 3.0 * {d})))"


@query(f"SELECT v AS value, round(avg({P.format(q='v', d='l_discount')}), 6) AS prediction FROM lineitem, (SELECT unnest([1.0, 10.0, 25.0, 50.0])::DOUBLE AS v) GROUP BY 1")
def partial_dependence(t):
    return models.partial_dependence(t("lineitem"), GIVEN, "l_quantity", [1, 10, 25, 50])


@query(f"SELECT o AS k, v AS value, round({P.format(q='v', d='l_discount')} - {P.format(q='1.0', d='l_discount')}, 6) AS prediction FROM (SELECT l_orderkey * 10 + l_linenumber AS o, l_discount FROM lineitem WHERE l_orderkey % 50 = 0), (SELECT unnest([1.0, 25.0])::DOUBLE AS v)")
def individual_curves(t):
    df = t("lineitem").where("l_orderkey % 50 = 0").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return models.individual_curves(df, GIVEN, "l_quantity", [1, 25], "k", centred=True)


@query(f"""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [0.25, 0.5, 0.75])) AS i, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
p AS (SELECT list_sort(list_distinct(list_concat([lo], list_concat(i, [hi])))) AS pts FROM e),
b AS (SELECT l_discount, least(1 + len(list_filter(pts[2:len(pts) - 1], lambda z: l_quantity > z)), len(pts) - 1) AS k, pts FROM lineitem, p),
d AS (SELECT k, avg({P.format(q='pts[k + 1]', d='l_discount')} - {P.format(q='pts[k]', d='l_discount')}) AS d, count(*) AS n, any_value(pts[k + 1]) AS edge FROM b GROUP BY k),
a AS (SELECT edge, n, sum(d) OVER (ORDER BY k) AS e FROM d)
SELECT round(edge, 6) AS edge, round(e - sum(e * n) OVER () / sum(n) OVER (), 6) AS effect FROM a""")
def accumulated_effects(t):
    rows = models.accumulated_effects(t("lineitem"), GIVEN, "l_quantity", 4)
    return t("region").sparkSession.createDataFrame(rows, "edge double, effect double")


@query("WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - q) * 0.02, 6) AS l_quantity, round((l_discount - d) * 3.0, 6) AS l_discount FROM lineitem, m")
def linear_contributions(t):
    """Shapley values of a linear margin."""
    df = t("lineitem")
    means = df.agg(F.avg("l_quantity"), F.avg("l_discount")).first()
    parts = GIVEN.contributions({"l_quantity": means[0], "l_discount": means[1]})
    return df.select("l_orderkey", "l_linenumber", *(c.alias(f) for f, c in parts.items()))


TREES = models.Boosted(["l_quantity", "taxn"], -0.5, [models.Split("l_quantity", 24.0, models.Split("taxn", 0.03, -0.2, 0.1), 0.4), models.Split("taxn", 0.05, -0.1, 0.3)])


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.5 + CASE WHEN l_quantity > 24 THEN 0.4 WHEN taxn > 0.03 THEN 0.1 ELSE -0.2 END + CASE WHEN taxn > 0.05 THEN 0.3 ELSE -0.1 END))), 6) AS p FROM lines")
def boosted_predict(t):
    """Given trees; missing values go to the low side."""
    return lines(t).select("l_orderkey", "l_linenumber", TREES.predict().alias("p"))


@query(f"WITH {LINES}, s AS (SELECT l_orderkey, l_linenumber, l_discount * 10 - 0.5 AS start, l_quantity FROM lines) SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(start + CASE WHEN l_quantity > 24 THEN 0.4 ELSE -0.2 END))), 6) AS p FROM s")
def boosted_warm_start(t):
    model = models.Boosted(["l_quantity"], 0.0, [models.Split("l_quantity", 24.0, -0.2, 0.4)], offset="start")
    return lines(t).withColumn("start", F.col("l_discount") * 10 - 0.5).select("l_orderkey", "l_linenumber", model.predict().alias("p"))


@query(f"WITH {LINES}, v AS (SELECT coalesce(taxn, 0) AS a, l_discount AS b, yn AS y FROM lines WHERE yn IS NOT NULL), z AS (SELECT (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b, y FROM v), s AS (SELECT 'taxn' AS feature, sum(a) AS t, sum(a * y) AS o, avg(y) AS r FROM z UNION ALL SELECT 'l_discount', sum(b), sum(b * y), avg(y) FROM z) SELECT feature, round((o - t * r) ** 2 / (t * r) + (t - o - t * (1 - r)) ** 2 / (t * (1 - r)), 6) AS chi2 FROM s")
def chi2_selection(t):
    return stats.chi2_selection(lines(t), ["taxn", "l_discount"], "yn").select("feature", "chi2")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity_std, round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS l_tax_std FROM lineitem")
def standardized(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return stats.standardized(df, stats.standardizer(df, ["l_quantity", "l_tax"])).select("l_orderkey", "l_linenumber", "l_quantity_std", "l_tax_std")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS q, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS d, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS p FROM lineitem)
SELECT 'l_quantity' AS var_a, 'l_discount' AS var_b, round(corr(q, d), 6) AS corr FROM r UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(q, p), 6) FROM r UNION ALL SELECT 'l_discount', 'l_extendedprice', round(corr(d, p), 6) FROM r""")
def rank_association(t):
    return stats.rank_association(t("lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]).select("var_a", "var_b", "corr")


@query(gains_sql(f"SELECT {quantiles('taxn', 10)} AS edges FROM lines WHERE y IS NOT NULL", s="taxn", number=f"CASE WHEN taxn IS NULL THEN 0 ELSE {bin_sql('taxn', 'edges')} END", final="SELECT 'taxn' AS variable, CAST(sum(n) AS BIGINT) AS n, round(sum(iv), 6) AS iv, round(max(ks), 6) AS ks, round(max(lift), 6) AS max_lift, count(*) AS bins, round((SELECT avg(taxn) FROM lines), 6) AS mean, round((SELECT 1 - count(taxn) / count(*) FROM lines), 6) AS missing_rate FROM w"))
def variable_report(t):
    return stats.variable_report(lines(t), "y", ["taxn", "l_quantity"]).where("variable = 'taxn'").select("variable", "n", "iv", "ks", "max_lift", "bins", "mean", "missing_rate")


PERF = [("train", "l_orderkey % 3 = 0"), ("validation", "l_orderkey % 3 = 1"), ("oot", "l_orderkey % 3 = 2")]


@query(roc_sql("l_extendedprice", "dataset").replace(f"WITH {LINES}", f"WITH base AS (SELECT *, ['train', 'validation', 'oot'][1 + l_orderkey % 3] AS dataset FROM lineitem), {LINES.replace('FROM lineitem', 'FROM base')}") + f""",
e AS (SELECT {quantiles('l_extendedprice', 10)} AS edges FROM lines WHERE dataset = 'train'),
k AS (SELECT dataset, {bin_sql('l_extendedprice', 'edges')} AS bin, count(*) AS n, avg(y) AS rate FROM lines, e GROUP BY 1, 2),
m AS (SELECT k.dataset, max(rate / o.r) AS max_lift, sum((greatest(k.n / o.n, 1e-6) - greatest(t.tn / t.tt, 1e-6)) * ln(greatest(k.n / o.n, 1e-6) / greatest(t.tn / t.tt, 1e-6))) AS psi
  FROM k JOIN (SELECT dataset, avg(y) AS r, count(*)::DOUBLE AS n FROM lines GROUP BY 1) o USING (dataset) JOIN (SELECT bin, n AS tn, sum(n) OVER () AS tt FROM k WHERE dataset = 'train') t USING (bin) GROUP BY 1)
SELECT a.dataset, round(sum(bad + good), 6) AS n, round(sum(bad) / sum(bad + good), 6) AS bad_rate, round(sum(area), 6) AS auc, round(max(abs(tpr - fpr)), 6) AS ks, round(any_value(m.max_lift), 6) AS max_lift, round(any_value(m.psi), 6) AS psi FROM a JOIN m USING (dataset) GROUP BY a.dataset""")
def perf_summary(t):
    df = lines(t)
    return metrics.perf_summary({name: df.where(test) for name, test in PERF}, "y", "l_extendedprice")


DIM = "SELECT '{s}' AS subset, '{l}' AS label, l_returnflag AS group_l_linestatus, {l}::DOUBLE AS y, l_quantity AS threshold FROM lines WHERE {t} AND {l} IS NOT NULL"


@query(f"""WITH {LINES},
x AS ({' UNION ALL '.join(DIM.replace('l_returnflag', 'l_linestatus').format(s=s, l=l, t=w) for s, w in (('all', 'true'), ('big', 'l_quantity > 20')) for l in ('y', 'yn'))}),
c AS (SELECT subset, label, group_l_linestatus, threshold, sum(y) AS bad, sum(1 - y) AS good FROM x GROUP BY ALL),
r AS (SELECT *, sum(bad) OVER (w ORDER BY threshold DESC) / sum(bad) OVER w AS tpr, sum(good) OVER (w ORDER BY threshold DESC) / sum(good) OVER w AS fpr, bad / sum(bad) OVER w AS db, good / sum(good) OVER w AS dg FROM c WINDOW w AS (PARTITION BY subset, label, group_l_linestatus))
SELECT subset, label, group_l_linestatus, round(sum(bad + good), 6) AS n, round(sum(dg * (2 * tpr - db) / 2), 6) AS auc, round(max(abs(tpr - fpr)), 6) AS ks FROM r GROUP BY ALL""")
def multi_dimension(t):
    """Two labels, two subsets and a group, in one plan."""
    return pipelines.multi_dimension(lines(t), ["y", "yn"], "l_quantity", ["l_linestatus"], {"all": "true", "big": "l_quantity > 20"}).select("subset", "label", "group_l_linestatus", "n", "auc", "ks")


@query(f"""WITH {LINES}, x AS (SELECT 'l_quantity' AS score, l_quantity AS threshold, y FROM lines UNION ALL SELECT 'l_discount', l_discount, y FROM lines),
c AS (SELECT score, threshold, sum(y)::DOUBLE AS bad, sum(1 - y)::DOUBLE AS good FROM x GROUP BY ALL),
r AS (SELECT *, sum(bad) OVER (w ORDER BY threshold DESC) / sum(bad) OVER w AS tpr, bad / sum(bad) OVER w AS db, good / sum(good) OVER w AS dg FROM c WINDOW w AS (PARTITION BY score))
SELECT score, round(sum(bad + good), 6) AS n, round(sum(dg * (2 * tpr - db) / 2), 6) AS auc FROM r GROUP BY 1""")
def pipeline_score_comparison(t):
    return pipelines.score_comparison(lines(t), "y", ["l_quantity", "l_discount"])["performance"].select("score", "n", "auc")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS s, o_custkey AS f FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS s, o_custkey AS f FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT a.s AS s1, b.s AS s2, a.f AS f1, b.f AS f2 FROM a FULL JOIN b USING (o_orderkey))
SELECT 's' AS feature, count(*) FILTER (WHERE coalesce(abs(s1 - s2) > 1e-6, false) OR (s1 IS NULL) <> (s2 IS NULL)) AS n_mismatch, 'FAIL' AS status FROM j
UNION ALL SELECT 'f', count(*) FILTER (WHERE coalesce(abs(f1 - f2) > 1e-6, false) OR (f1 IS NULL) <> (f2 IS NULL)), 'FAIL' FROM j""")
def pipeline_score_uat(t):
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("s"), F.col("o_custkey").alias("f"))
    online = o.where("o_orderkey % 11 != 0").withColumn("s", F.col("s") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    return pipelines.score_uat(o.where("o_orderkey % 7 != 0"), online, "o_orderkey", "s", ["f"])["summary"]


@query(f"""WITH {LINES}, p AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'ins' ELSE 'oot' END AS sample, * FROM lines),
u AS (SELECT sample, 'taxn' AS variable, taxn AS value FROM p UNION ALL SELECT sample, 'l_quantity', l_quantity FROM p)
SELECT sample, variable, count(*) AS n_all, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50 FROM u GROUP BY ALL""")
def pipeline_feature_distribution(t):
    df = lines(t).withColumn("sample", F.when(F.col("l_linestatus") == "F", "ins").otherwise("oot"))
    return pipelines.feature_validation(df, ["y"], ["taxn", "l_quantity"])["distribution"].select("sample", "variable", "n_all", "n", "mean", "p50")


@query(f"""WITH {LINES}, s AS (SELECT *, 1 - l_discount * 5 AS score FROM lines), k AS (SELECT * FROM s WHERE l_linestatus = 'F'), r AS (SELECT * FROM s WHERE l_linestatus = 'O'), q AS (SELECT quantile_cont(score, 0.25) FILTER (WHERE y = 1) AS cut FROM k)
SELECT 'hard' AS method, count(*) AS n, round(avg(y), 6) AS bad_rate FROM (SELECT y::DOUBLE AS y FROM k UNION ALL SELECT CASE WHEN score >= cut THEN 1.0 ELSE 0.0 END FROM r, q)
UNION ALL SELECT 'fuzzy', count(*), round(avg(y), 6) FROM (SELECT y::DOUBLE AS y FROM k UNION ALL SELECT score FROM r)""")
def pipeline_reject_inference(t):
    df = lines(t).select("l_orderkey", "l_linenumber", "y", "l_quantity", (1 - F.col("l_discount") * 5).alias("score"), (F.col("l_linestatus") == "F").cast("int").alias("approved"))
    return pipelines.reject_inference(df, "y", "approved", ["l_quantity"], ["l_orderkey", "l_linenumber"], ["hard", "fuzzy"], score="score")["summary"]


@query("SELECT l_returnflag, l_linenumber, CAST(round(count(*) * 0.3) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def stratified_sizes(t):
    """Exact sizes of a stratified sample."""
    return sample.stratified_sample(t("lineitem"), ["l_returnflag", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey"], 0.3).groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey * 10 + l_linenumber) AS distinct_rows, true AS near FROM lineitem")
def hash_split_parts(t):
    """Each row is in one part, the same on each run, and parts are near their shares."""
    parts = {"ins": 0.6, "oos": 0.2, "oot": 0.2}
    df = sample.hash_split(t("lineitem"), ["l_orderkey", "l_linenumber"], parts).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    near = [F.abs(F.avg((F.col("sample") == p).cast("double")) - share) < 0.03 for p, share in parts.items()]
    return df.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("sample").isin(*parts), F.col("k"))).alias("distinct_rows"), (near[0] & near[1] & near[2]).alias("near"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS bads, true AS near FROM orders")
def undersampled(t):
    """All bads stay; goods are thinned until bads are near the wanted share."""
    df = t("orders").withColumn("y", (F.col("o_orderstatus") == "P").cast("int"))
    return sample.undersample(df, "y", ["o_orderkey"], 0.6).agg(F.sum("y").cast("long").alias("bads"), (F.abs(F.avg("y") - 0.6) < 0.05).alias("near"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS goods, true AS near FROM orders")
def oversampled(t):
    df = t("orders").withColumn("y", (F.col("o_orderstatus") == "P").cast("int"))
    return sample.oversample(df, "y", ["o_orderkey"], 0.6).agg(F.sum(1 - F.col("y")).cast("long").alias("goods"), (F.abs(F.avg("y") - 0.6) < 0.05).alias("near"))


@query("WITH w AS (SELECT o_orderkey, least(greatest(p / (1 - p), 0.1), 10) AS w FROM (SELECT o_orderkey, (o_orderkey % 97 + 1) / 99 AS p FROM orders)) SELECT o_orderkey, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def density_ratio(t):
    return sample.reweighted(t("orders").withColumn("p", (F.col("o_orderkey") % 97 + 1) / 99), "p").select("o_orderkey", "weight")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem")
def apply_by_rows(t):
    """A user function over batches of rows."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return apply.by_rows(df, lambda p: p.assign(twice=p["l_quantity"] * 2)[["l_orderkey", "l_linenumber", "twice"]], "l_orderkey long, l_linenumber int, twice double")


@query("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 6) AS spread FROM orders GROUP BY 1")
def apply_by_groups(t):
    df = t("orders").select("o_orderpriority", "o_totalprice")
    return apply.by_groups(df, ["o_orderpriority"], lambda p: p.groupby("o_orderpriority", as_index=False).agg(spread=("o_totalprice", lambda v: v.max() - v.min())), "o_orderpriority string, spread double")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean FROM lineitem" for c in ("l_quantity", "l_tax", "l_discount")))
def apply_by_columns(t):
    """A table function over chunks of columns."""
    def means(df: DataFrame) -> DataFrame:
        names = [c for c in df.columns if c != "l_orderkey"]
        return df.agg(F.array(*(F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean")) for c in names)).alias("m")).select(F.explode("m").alias("m")).select("m.*")

    return tables.union_all(apply.by_columns(t("lineitem"), ["l_quantity", "l_tax", "l_discount"], ["l_orderkey"], 2, means))


@query("SELECT o_orderkey, o_custkey, c_name, n_name, n_nationkey AS n_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_all(t):
    """Several tables joined in turn on a key; a name that is there already gets a number."""
    named = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("o_orderstatus"))
    joined = tables.join_all([t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), named], ["o_custkey"])
    nation = t("nation").select(F.col("n_nationkey").alias("o_orderstatus_1"), "n_name")
    return tables.join_all([joined, nation], ["o_orderstatus_1"]).select("o_orderkey", "o_custkey", "c_name", "n_name", F.col("o_orderstatus_1").alias("n_nationkey"))


@query("SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS n_name, 'region' AS source FROM region UNION ALL SELECT n_regionkey, NULL, n_name, 'nation' FROM nation")
def union_tagged(t):
    return tables.union_all([t("region").select("r_regionkey", "r_name"), t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")], "source", ["region", "nation"])


@query("SELECT CAST(o_orderkey % 5 AS VARCHAR) || '%' AS text, round((o_orderkey % 5) / 100, 6) AS share, round(least(o_totalprice / 99991, 0.9999999), 6) AS capped, round(o_totalprice - o_custkey, 6) AS diff, abs(o_totalprice - o_custkey) <= 1000 AS equal, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS last_day FROM orders")
def scalar_verbs(t):
    text = F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit("%"))
    a, b = F.col("o_totalprice"), F.col("o_custkey")
    return t("orders").select(text.alias("text"), scalars.percent_to_double(text).alias("share"), scalars.capped_score(a / 99991).alias("capped"), scalars.safe_difference(a, b).alias("diff"), scalars.safe_equal(a, b, 1000).alias("equal"), scalars.last_day_of_previous_month(F.col("o_orderdate")).alias("last_day"))


@query("SELECT c_custkey, c_name AS name, length(c_name) AS n FROM customer")
def cipher_round_trip(t):
    c = scalars.encrypt_column(F.col("c_name"), "key")
    made = t("customer").select("c_custkey", c.alias("code"))
    back = scalars.encrypt_column(F.col("code"), "key", decrypt=True)
    return made.select("c_custkey", back.alias("name"), F.length(back).alias("n"))


@query("SELECT unnest([202311, 202312, 202401, 202402])::BIGINT AS vintage")
def vintages(t):
    return t("region").sparkSession.createDataFrame([(v,) for v in scalars.valid_vintages(202311, 202402)], "vintage long")


@query("SELECT n_name AS N_NAME, n_nationkey AS N_NATIONKEY, n_regionkey AS N_REGIONKEY FROM nation WHERE regexp_matches(lower(n_name), '^(nation_?1|a)')")
def column_verbs(t):
    """Columns moved, renamed and dropped, rows chosen by a pattern."""
    df = cleaning.drop_columns_if_present(t("nation").withColumn("py_inserttime", F.lit("now")))
    df = cleaning.filter_regex(cleaning.move_column(df, "n_name", 0), "n_name", "^(nation_?1|a)", case_sensitive=False)
    return cleaning.rename_all(cleaning.select_regex(df, "N_", case_sensitive=False), "upper")


@query("SELECT c.name AS \"column\", max(CASE WHEN r = 0 THEN v END) AS \"0\", max(CASE WHEN r = 1 THEN v END) AS \"1\" FROM (SELECT o_orderstatus, 1 AS i FROM orders LIMIT 0) z RIGHT JOIN (SELECT 'a' AS name, r_regionkey AS r, r_regionkey * 2.0::DOUBLE AS v FROM region UNION ALL SELECT 'b', r_regionkey, r_regionkey + 0.5::DOUBLE FROM region) c ON false GROUP BY 1")
def transposed(t):
    df = t("region").where("r_regionkey < 2").select("r_regionkey", (F.col("r_regionkey") * 2).alias("a"), (F.col("r_regionkey") + 0.5).alias("b"))
    return cleaning.transpose(df, "r_regionkey")


@query("""SELECT * FROM (VALUES ('comments', 'SELECT 1 ,  ''--kept'' FROM t'), ('fields', 'a|f(b, c)|d AS e'), ('list', 'x.a, x.c'), ('statements', '2')) v(what, text)""")
def sql_texts(t):
    """Comments removed, statements and fields split, select lists made."""
    plain = sqltext.remove_comments("SELECT 1 /* one */,  '--kept' FROM t -- tail").strip()
    rows = [
        ("comments", " ".join(plain.split(" ")) if "/*" in plain else plain), ("fields", "|".join(f.strip() for f in sqltext.split_fields("a, f(b, c), d AS e"))),
        ("list", sqltext.select_list(["a", "b", "c"], ("b",), "x")), ("statements", str(len(sqltext.split_statements("SELECT 1; SELECT ';';")))),
    ]
    return t("region").sparkSession.createDataFrame(rows, "what string, text string")


@query("SELECT r_regionkey, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sql_script(t):
    """A script of two statements with a comment and a template."""
    t("nation").createOrReplaceTempView("script_nation")
    t("region").createOrReplaceTempView("script_region")
    text = "CREATE OR REPLACE TEMPORARY VIEW script_joined AS SELECT * FROM script_nation JOIN script_region ON n_regionkey = r_regionkey; -- next\nSELECT {key}, count(*) AS n FROM script_joined GROUP BY {key}"
    return tables.run_script(t("region").sparkSession, text, key="r_regionkey")


@query("SELECT * FROM (VALUES ('id', 'bigint'), ('name', 'string')) v(name, type)")
def schema_texts(t):
    found = tables.parsed_schema(["<column id, type bigint>", "<column name, type string>"])
    return t("region").sparkSession.createDataFrame(list(found.items()), "name string, type string")


@query(f"WITH {LINES} SELECT round(quantile_cont(taxn, 0.333), 6) AS a, round(quantile_cont(l_extendedprice, 0.01), 6) AS b, round(quantile_cont(l_extendedprice, 0.999), 6) AS c FROM lines")
def exact_percentiles(t):
    df = lines(t)
    tax = percentiles(df, {"taxn": F.col("taxn")}, [0.333])["taxn"]
    price = percentiles(df, {"p": F.col("l_extendedprice")}, [0.01, 0.999])["p"]
    return df.sparkSession.createDataFrame([(tax[0], *price)], "a double, b double, c double")


@query("SELECT CASE WHEN isnan(x) OR x IS NULL THEN 0 WHEN x <= 2 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderkey % 5 END AS x FROM orders) GROUP BY 1")
def nan_is_missing(t):
    k = F.col("o_orderkey") % 5
    x = F.when(k == 0, F.lit(float("nan"))).when(k > 1, k.cast("double"))
    return t("orders").select(bin_number(x, [-float("inf"), 2.0, float("inf")], keep_missing=True).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
