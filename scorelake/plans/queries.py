"""Queries over the driver tables, one or more for each operator, each with the DuckDB SQL that must give the same rows.

Doubles are rounded to 6 places on both sides, as the engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning, scalars
from ..functions.edges import equal_frequency, equal_width, higher_percentiles
from ..operators import compare, cross, gains, metrics, psi, sample, stats, woe
from ..sources import json_shapes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if isinstance(f.dataType, T.DoubleType)})


def lines(table) -> DataFrame:
    """lineitem with a target, a nullable target and a nullable score."""
    return table("lineitem").withColumns(
        {
            "y": F.when(F.col("l_returnflag") == "R", 1).otherwise(0),
            "yn": F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), F.lit(None)).when(F.col("l_returnflag") == "R", 1).otherwise(0),
            "taxn": F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_tax")),
        }
    )


LINES = """lines AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS yn,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS taxn FROM lineitem)"""


def rnd(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def quantiles(column: str, n: int) -> str:
    return f"list_distinct(quantile_cont({column}, [{', '.join(repr(k / n) for k in range(1, n))}]))"


def bin_sql(column: str, edges: str) -> str:
    return f"CAST(1 + len(list_filter({edges}, lambda x: {column} > x)) AS INTEGER)"


GAINS_DOUBLES = ("prop", "bad_rate", "lift", "bad_pct", "good_pct", "cum_bad_pct", "cum_good_pct", "ks", "bad_shift", "woe", "iv")


def gains_sql(edges: str, y: str = "y", s: str = "l_extendedprice", groups: tuple[str, ...] = (), number: str | None = None, tail: str = "", source: str = "lines", having: str = "", extra: str = "", final: str | None = None, descending: bool = False) -> str:
    g = "".join(f"{x}, " for x in groups)
    over = f"PARTITION BY {', '.join(groups)}" if groups else ""
    order = f"{over} ORDER BY bin{' DESC' if descending else ''}"
    shift = "lag(bad_rate) OVER (O) / nullif(bad_rate, 0) - 1" if descending else "bad_rate / nullif(lag(bad_rate) OVER (O), 0) - 1"
    shift = shift.replace("(O)", f"({order})")
    columns = f"{g}bin, n, perf, bad, good, {rnd('min_score', 'max_score', 'avg_score', *GAINS_DOUBLES)}, bump{tail}"
    return f"""
WITH {LINES},
e AS ({edges}),
c AS (SELECT {g}{number or bin_sql(s, 'edges')} AS bin, count(*) AS n, count({y}) AS perf, count(*) FILTER (WHERE {y} = 1) AS bad,
    count(*) FILTER (WHERE {y} = 0) AS good, CAST(min({s}) AS DOUBLE) AS min_score, CAST(max({s}) AS DOUBLE) AS max_score, avg({s}) AS avg_score{extra}
  FROM {source}, e GROUP BY ALL),
k AS (SELECT * FROM c WHERE bin IS NOT NULL {having}),
t AS (SELECT *, sum(bad) OVER ({over}) AS bads, sum(good) OVER ({over}) AS goods, n / sum(n) OVER ({over}) AS prop, CAST(bad AS DOUBLE) / nullif(perf, 0) AS bad_rate,
    sum(bad) OVER ({order}) AS cb, sum(good) OVER ({order}) AS cg FROM k),
u AS (SELECT *, bad_rate / (bads / (bads + goods)) AS lift, bad / nullif(bads, 0)::DOUBLE AS bad_pct, good / nullif(goods, 0)::DOUBLE AS good_pct,
    cb / nullif(bads, 0)::DOUBLE AS cum_bad_pct, cg / nullif(goods, 0)::DOUBLE AS cum_good_pct, {shift} AS bad_shift FROM t),
v AS (SELECT *, abs(cum_bad_pct - cum_good_pct) AS ks, CASE WHEN bad > 0 AND good > 0 THEN ln(bad_pct / good_pct) END AS woe,
    CASE WHEN bad_shift < 0 THEN 1 ELSE 0 END AS bump FROM u),
w AS (SELECT *, (bad_pct - good_pct) * woe AS iv FROM v)
""" + (final or f"SELECT {columns} FROM w")


def no_range(df: DataFrame) -> DataFrame:
    return df.drop("range")


FREQ10 = f"SELECT {quantiles('l_extendedprice', 10)} AS edges FROM lines"


@query(gains_sql(FREQ10))
def gains_equal_freq(t):
    return no_range(gains.gains_table(lines(t), "y", "l_extendedprice", 10))


@query(gains_sql(FREQ10, descending=True))
def gains_descending(t):
    return no_range(gains.gains_table(lines(t), "y", "l_extendedprice", 10, ascending=False))


WIDTH8 = "SELECT list_transform(range(1, 8), lambda k: lo + (hi - lo) * k / 8) AS edges FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lines)"


@query(gains_sql(WIDTH8, s="l_quantity"))
def gains_equal_width(t):
    return no_range(gains.gains_table(lines(t), "y", "l_quantity", 8, "width"))


@query(gains_sql("SELECT [0.02, 0.05] AS edges", y="yn", s="taxn", number="CASE WHEN taxn IS NULL THEN 0 WHEN taxn = 0.08 THEN 4 ELSE " + bin_sql("taxn", "edges") + " END"))
def gains_fixed_edges(t):
    """Given edges, a special value in a bin of its own, missing values in bin 0, and unlabelled rows."""
    return no_range(gains.gains_table(lines(t), "yn", "taxn", method=[0.02, 0.05], specials=[0.08], keep_missing=True))


@query(gains_sql(FREQ10, groups=("l_linestatus", "l_linenumber"), having="QUALIFY sum(n) OVER (PARTITION BY l_linestatus, l_linenumber) >= 20"))
def gains_by_group_synced(t):
    return no_range(gains.gains_table(lines(t), "y", "l_extendedprice", 10, groups=["l_linestatus", "l_linenumber"], min_group=20))


SUMMARY = f"""SELECT l_linenumber, CAST(sum(n) AS BIGINT) AS n, CAST(sum(perf) AS BIGINT) AS perf, CAST(sum(bad) AS BIGINT) AS bad, round(sum(bad) / nullif(sum(perf), 0)::DOUBLE, 6) AS bad_rate,
  round(max(ks), 6) AS ks, round(max(lift), 6) AS max_lift, round(coalesce(sum(iv), 0), 6) AS iv, CAST(sum(bump) AS BIGINT) AS bumps, count(*) AS bins FROM w GROUP BY l_linenumber"""


@query(gains_sql(FREQ10, groups=("l_linenumber",), final=SUMMARY))
def gains_summary(t):
    return gains.gains_summary(gains.gains_table(lines(t), "y", "l_extendedprice", 10, groups=["l_linenumber"]), ["l_linenumber"])


@query(gains_sql(FREQ10, tail=", " + rnd("mean_discount", "max_qty"), extra=", avg(l_discount) AS mean_discount, CAST(max(l_quantity) AS DOUBLE) AS max_qty"))
def gains_custom_metrics(t):
    return no_range(gains.gains_table(lines(t), "y", "l_extendedprice", 10, metrics={"mean_discount": F.avg("l_discount"), "max_qty": F.max("l_quantity")}))


@query(f"""
WITH {LINES},
s AS (SELECT l_discount AS s, sum(l_quantity) AS w, sum(l_quantity * y) AS wb, count(*) AS n FROM lines GROUP BY 1),
b AS (SELECT *, CAST(least(greatest(ceil(sum(w) OVER (ORDER BY s DESC) / sum(w) OVER () * 5 - 1e-9), 1), 5) AS INTEGER) AS bin FROM s),
g AS (SELECT bin, CAST(sum(n) AS BIGINT) AS n, sum(w) AS weight, sum(wb) AS bad, min(s) AS min_score, max(s) AS max_score FROM b GROUP BY bin),
h AS (SELECT *, weight - bad AS good, bad / weight AS bad_rate FROM g),
i AS (SELECT *, bad_rate / (sum(bad) OVER () / sum(weight) OVER ()) AS lift, sum(bad) OVER (ORDER BY bin) / sum(bad) OVER () AS cum_bad_pct,
  sum(good) OVER (ORDER BY bin) / sum(good) OVER () AS cum_good_pct FROM h)
SELECT bin, n, {rnd('weight', 'bad', 'min_score', 'max_score', 'good', 'bad_rate', 'lift', 'cum_bad_pct', 'cum_good_pct')}, round(abs(cum_bad_pct - cum_good_pct), 6) AS ks FROM i
""")
def gains_weighted(t):
    return gains.weighted_rank_bins(lines(t), "y", "l_discount", "l_quantity", 5)


WOE_SQL = f"""
WITH {LINES},
e AS (SELECT {quantiles('taxn', 5)} AS edges FROM lines),
c AS (SELECT l_linestatus, CASE WHEN taxn IS NULL THEN 0 ELSE {bin_sql('taxn', 'edges')} END AS bin, count(*) AS n, count(*) FILTER (WHERE yn = 1) AS bad, count(*) FILTER (WHERE yn = 0) AS good
  FROM lines, e WHERE yn IS NOT NULL GROUP BY GROUPING SETS ((l_linestatus, bin))),
r AS (SELECT *, bad::DOUBLE / n AS bad_rate, bad / sum(bad) OVER p::DOUBLE AS bad_pct, good / sum(good) OVER p::DOUBLE AS good_pct FROM c WINDOW p AS (PARTITION BY l_linestatus)),
w AS (SELECT *, bad_rate / avg(bad_rate) OVER (PARTITION BY l_linestatus) AS lift, CASE WHEN bad > 0 AND good > 0 THEN ln(bad_pct / good_pct) END AS woe FROM r)
"""


def grouped_woe(t):
    df = lines(t)
    edges = equal_frequency(df, "taxn", 5)
    return woe.woe_table(df, "yn", "taxn", edges, groups=["l_linestatus"])


@query(WOE_SQL + f"SELECT l_linestatus, bin, n, bad, good, {rnd('bad_rate', 'bad_pct', 'good_pct', 'lift', 'woe')}, round((bad_pct - good_pct) * woe, 6) AS iv FROM w")
def woe_group_table(t):
    return grouped_woe(t).select("l_linestatus", "bin", "n", "bad", "good", "bad_rate", "bad_pct", "good_pct", "lift", "woe", "iv")


@query(WOE_SQL + "SELECT l_linestatus, round(sum((bad_pct - good_pct) * woe), 6) AS iv, count(*) AS bins FROM w GROUP BY 1")
def iv_summary(t):
    return grouped_woe(t).groupBy("l_linestatus").agg(F.sum("iv").alias("iv"), F.count("*").alias("bins"))


SMOOTH = "ln(((bad / (bads + 1e-6)) + 1e-6) / ((good / (goods + 1e-6)) + 1e-6))"


@query(f"""
WITH {LINES},
e AS (SELECT {quantiles('taxn', 4)} AS edges FROM lines),
c AS (SELECT CASE WHEN taxn IS NULL THEN 0 ELSE {bin_sql('taxn', 'edges')} END AS bin, count(*) FILTER (WHERE y = 1) AS bad, count(*) FILTER (WHERE y = 0) AS good FROM lines, e GROUP BY 1),
tot AS (SELECT sum(bad) AS ab, sum(good) AS ag, sum(bad) FILTER (WHERE bin > 0) AS nb, sum(good) FILTER (WHERE bin > 0) AS ng FROM c),
m AS (SELECT bin, {SMOOTH.replace('bads', 'CASE WHEN bin = 0 THEN ab ELSE nb END').replace('goods', 'CASE WHEN bin = 0 THEN ag ELSE ng END')} AS woe FROM c, tot)
SELECT l_orderkey, l_linenumber, round(woe, 6) AS taxn_woe FROM lines, e JOIN m ON m.bin = CASE WHEN taxn IS NULL THEN 0 ELSE {bin_sql('taxn', 'edges')} END
""")
def woe_apply(t):
    """A smoothed mapping (missing values have their own WOE) applied to every row."""
    df = lines(t)
    model = woe.fit_woe(df, "y", ["taxn"], n_init=4, monotone=False)
    return model.transform(df).select("l_orderkey", "l_linenumber", "taxn_woe")


def roc_sql(score: str, groups: str, weight: str = "1.0") -> str:
    g = f"{groups}, " if groups else ""
    p = f"PARTITION BY {groups}" if groups else ""
    return f"""
WITH {LINES},
c AS (SELECT {g}{score} AS threshold, sum({weight} * y)::DOUBLE AS bad, sum({weight} * (1 - y))::DOUBLE AS good FROM lines GROUP BY ALL),
r AS (SELECT *, sum(bad) OVER ({p} ORDER BY threshold DESC) / sum(bad) OVER ({p}) AS tpr, sum(good) OVER ({p} ORDER BY threshold DESC) / sum(good) OVER ({p}) AS fpr FROM c),
a AS (SELECT *, (fpr - coalesce(lag(fpr) OVER o, 0)) * (tpr + coalesce(lag(tpr) OVER o, 0)) / 2 AS area FROM r WINDOW o AS ({p} ORDER BY threshold DESC))
"""


@query(roc_sql("l_discount", "") + f"SELECT {rnd('threshold', 'bad', 'good', 'tpr', 'fpr')} FROM r")
def roc_points(t):
    return metrics.roc_points(lines(t), "y", "l_discount")


AUC = f"round(sum(bad + good), 6) AS n, round(sum(bad) / sum(bad + good), 6) AS bad_rate, round(sum(area), 6) AS auc, round(max(abs(tpr - fpr)), 6) AS ks, round(arg_max(threshold, (round(tpr - fpr, 12), threshold)), 6) AS ks_threshold FROM a"


@query(roc_sql("l_extendedprice", "") + f"SELECT {AUC}")
def auc_ks(t):
    return metrics.auc_ks(lines(t), "y", "l_extendedprice")


@query(roc_sql("l_discount", "l_linenumber", "l_quantity") + f"SELECT l_linenumber, {AUC} GROUP BY l_linenumber")
def auc_ks_by_group(t):
    return metrics.auc_ks(lines(t), "y", "l_discount", ["l_linenumber"], "l_quantity")


PR = f"""
WITH {LINES},
c AS (SELECT l_quantity AS threshold, sum(y)::DOUBLE AS bad, sum(1 - y)::DOUBLE AS good FROM lines GROUP BY ALL),
r AS (SELECT *, sum(bad) OVER (ORDER BY threshold DESC) / sum(bad + good) OVER (ORDER BY threshold DESC) AS precision, sum(bad) OVER (ORDER BY threshold DESC) / sum(bad) OVER () AS recall FROM c)
"""


@query(PR + f"SELECT {rnd('threshold', 'bad', 'good', 'precision', 'recall')} FROM r")
def pr_points(t):
    return metrics.pr_points(lines(t), "y", "l_quantity")


@query(PR + f"SELECT {rnd('threshold', 'precision', 'recall')} FROM r ORDER BY round(abs(precision - recall), 12), r.threshold LIMIT 1")
def pr_break_even(t):
    return metrics.break_even(metrics.pr_points(lines(t), "y", "l_quantity"))


PERCENTILES = f"""
WITH {LINES},
o AS (SELECT l_extendedprice AS s, y, row_number() OVER (ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) - 1 AS place, count(*) OVER () AS total FROM lines),
b AS (SELECT CAST(least(place // greatest(total // 10, 1) + 1, 10) AS INTEGER) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS bad, min(s) AS min_score, max(s) AS max_score, avg(s) AS avg_score FROM o GROUP BY 1),
p AS (SELECT *, bad::DOUBLE / n AS bad_rate, (bad::DOUBLE / n) / (sum(bad) OVER () / sum(n) OVER ()) AS lift, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(bad) OVER w AS BIGINT) AS cum_bad, sum(bad) OVER w / sum(bad) OVER ()::DOUBLE AS gain FROM b WINDOW w AS (ORDER BY bin))
"""


def percentiles(t):
    df = lines(t).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return metrics.percentile_table(df, "y", "l_extendedprice", 10, "k")


@query(PERCENTILES + f"SELECT bin, n, bad, cum_n, cum_bad, {rnd('min_score', 'max_score', 'avg_score', 'bad_rate', 'lift', 'gain')} FROM p")
def percentile_table(t):
    return percentiles(t)


@query(PERCENTILES + """,
q AS (SELECT sum(n) OVER w / sum(n) OVER () AS depth, (sum(bad) OVER w / sum(n) OVER w) / (sum(bad) OVER () / sum(n) OVER ()) AS actual FROM p WINDOW w AS (ORDER BY bin DESC)),
g AS (SELECT unnest([0.95, 1.0, 1.02, 3.0])::DOUBLE AS lift)
SELECT lift, round(max(depth), 6) AS depth, round(arg_max(actual, depth), 6) AS actual FROM g LEFT JOIN q ON actual >= lift GROUP BY lift""")
def lift_grid(t):
    return metrics.lift_grid(percentiles(t), [0.95, 1.0, 1.02, 3.0])


@query(f"WITH {LINES} SELECT count(*) AS n, count(DISTINCT taxn) + 1 AS n_distinct, round(1 - (count(DISTINCT taxn) + 1) / count(*), 6) AS tie_rate FROM lines")
def score_ties(t):
    return metrics.score_ties(lines(t), "taxn")


@query("""
WITH p AS (SELECT value / 200 AS p, CASE WHEN event_type = 'purchase' OR event_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM events WHERE value BETWEEN 0 AND 200)
SELECT CAST(least(floor(p * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, round(avg((p - y) * (p - y)), 6) AS brier FROM p GROUP BY 1
""")
def calibration(t):
    df = t("events").where("value BETWEEN 0 AND 200").select((F.col("value") / 200).alias("p"), F.when((F.col("event_type") == "purchase") | (F.col("event_id") % 3 == 0), 1).otherwise(0).alias("y"))
    return metrics.calibration(df, "y", "p")


def means_sql(groups: str) -> str:
    g = f"{groups}, " if groups else ""
    each = " UNION ALL ".join(f"SELECT {g}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM lines" for c in ("taxn", "l_discount", "l_quantity"))
    return f"""
WITH {LINES}, u AS ({each})
SELECT {g}variable, count(*) AS n_all, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(1 - count(value) / count(*), 6) AS missing_rate, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75
FROM u GROUP BY ALL"""


@query(means_sql(""))
def proc_means(t):
    return stats.proc_means(lines(t), ["taxn", "l_discount", "l_quantity"])


@query(means_sql("l_linestatus"))
def proc_means_by_group(t):
    return stats.proc_means(lines(t), ["taxn", "l_discount", "l_quantity"], ["l_linestatus"])


@query(f"""
WITH {LINES}, c AS (SELECT taxn AS value, count(*) AS n FROM lines GROUP BY 1)
SELECT value, n, round(n / sum(n) OVER (), 6) AS percent, CAST(sum(n) OVER w AS BIGINT) AS cum_n, round(sum(n) OVER w / sum(n) OVER (), 6) AS cum_percent FROM c WINDOW w AS (ORDER BY value NULLS LAST)
""")
def proc_freq(t):
    return stats.proc_freq(lines(t), "taxn")


@query("""
WITH c AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)
SELECT value, n, round(n / sum(n) OVER (), 6) AS percent, CAST(sum(n) OVER w AS BIGINT) AS cum_n, round(sum(n) OVER w / sum(n) OVER (), 6) AS cum_percent FROM c WINDOW w AS (ORDER BY n DESC, value)
""")
def proc_freq_by_count(t):
    return stats.proc_freq(t("orders"), "o_orderpriority", "frequency")


CORR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "taxn"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "taxn"), ("l_discount", "taxn")]
CORR_SQL = f"WITH {LINES}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS corr, count(*) AS n FROM lines WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in CORR) + ") "


@query(CORR_SQL + "SELECT var_a, var_b, round(corr, 6) AS corr, n FROM p")
def corr_matrix(t):
    return stats.correlation(lines(t), ["l_quantity", "l_extendedprice", "l_discount", "taxn"])


@query(CORR_SQL + "SELECT var_a, var_b, round(corr, 6) AS corr, n FROM p WHERE abs(corr) > 0.5")
def high_corr_pairs(t):
    return stats.high_pairs(stats.correlation(lines(t), ["l_quantity", "l_extendedprice", "l_discount", "taxn"]), 0.5)


@query(f"""
WITH {LINES} SELECT l_linenumber, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
  round(corr(l_extendedprice, l_quantity), 6) AS r FROM lines GROUP BY 1
""")
def slope_by_group(t):
    return stats.slopes(lines(t), "l_extendedprice", "l_quantity", ["l_linenumber"])


@query("""
WITH d AS (SELECT e.value AS a, e.value + 3 * (e.event_id % 10) AS b, CAST(e.event_id % 7 AS DOUBLE) AS c FROM events e WHERE value IS NOT NULL),
r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM d),
det AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d FROM r)
SELECT 'a' AS variable, round((1 - bc * bc) / d, 6) AS vif FROM det UNION ALL SELECT 'b', round((1 - ac * ac) / d, 6) FROM det UNION ALL SELECT 'c', round((1 - ab * ab) / d, 6) FROM det
""")
def vif(t):
    e = t("events").where("value IS NOT NULL")
    df = e.select(F.col("value").alias("a"), (F.col("value") + 3 * (F.col("event_id") % 10)).alias("b"), (F.col("event_id") % 7).cast("double").alias("c"))
    return e.sparkSession.createDataFrame(list(stats.vif(df, ["a", "b", "c"]).items()), "variable string, vif double")


@query("""
WITH q AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS g, CAST(l_quantity AS BIGINT)::VARCHAR AS value FROM lineitem),
c AS (SELECT g, value, count(*) AS n FROM q GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, value) AS rank FROM c)
SELECT g, CAST(sum(n) AS BIGINT) AS n, 0::BIGINT AS missing, count(value) AS n_unique, string_agg(value || ':' || n, ';' ORDER BY rank) FILTER (WHERE rank <= 5) AS top FROM k GROUP BY g
""")
def categorical_distribution(t):
    df = t("lineitem").select(F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("g"), F.col("l_quantity").cast("long").alias("q"))
    return stats.top_values(df, "q", ["g"])


@query(f"""
WITH {LINES}, q AS (SELECT [0.25, 0.5, 0.9] AS p, quantile_cont(l_quantity, [0.25, 0.5, 0.9]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.9]) AS b FROM lines WHERE l_returnflag = 'N'),
i AS (SELECT unnest([1, 2, 3]) AS i)
SELECT l_returnflag, 'l_quantity' AS variable, p[i]::DOUBLE AS quantile, round(avg(CASE WHEN l_quantity > a[i] THEN 1 ELSE 0 END), 6) AS above FROM lines, q, i GROUP BY ALL
UNION ALL SELECT l_returnflag, 'l_extendedprice', p[i]::DOUBLE, round(avg(CASE WHEN l_extendedprice > b[i] THEN 1 ELSE 0 END), 6) FROM lines, q, i GROUP BY ALL
""")
def distribution_shift(t):
    return psi.distribution_shift(lines(t), "l_returnflag", "N", ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.9])


def psi_sql(level: str, groups: str = "", missing: bool = False) -> str:
    g = f"{groups}, " if groups else ""
    number = bin_sql("taxn", "edges")
    number = f"CASE WHEN taxn IS NULL THEN {0 if missing else 'NULL'} ELSE {number} END"
    share = lambda c: f"{c} / sum({c}) OVER ({'PARTITION BY ' + groups if groups else ''})"
    put = lambda c: f"greatest({share(c)}, 1e-6)" if level == "clip" else f"{share(c)} + 1e-6"
    return f"""
WITH {LINES}, l AS (SELECT *, l_shipdate >= TIMESTAMP '1999-01-01' AS late FROM lines),
e AS (SELECT {quantiles('taxn', 5)} AS edges FROM l WHERE NOT late),
b AS (SELECT {g}{number} AS bin, late FROM l, e),
c AS (SELECT {g}bin, count(*) FILTER (WHERE NOT late) AS expected, count(*) FILTER (WHERE late) AS actual FROM b WHERE bin IS NOT NULL GROUP BY ALL),
s AS (SELECT *, {put('expected')} AS e, {put('actual')} AS a FROM c),
p AS (SELECT *, (a - e) * ln(a / e) AS psi FROM s)
"""


def late():
    return F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")


@query(psi_sql("clip") + f"SELECT bin, expected, actual, {rnd('e', 'a', 'psi')} FROM p")
def psi_details(t):
    return psi.psi_details(lines(t), late(), "taxn", 5)


@query(psi_sql("add", missing=True) + f"SELECT bin, expected, actual, {rnd('e', 'a', 'psi')} FROM p")
def psi_details_smoothed(t):
    return psi.psi_details(lines(t), late(), "taxn", 5, smoothing="add", keep_missing=True)


@query(psi_sql("clip", "l_linenumber") + "SELECT l_linenumber, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, CASE WHEN sum(expected) > 0 AND sum(actual) > 0 THEN round(sum(psi), 6) END AS psi FROM p GROUP BY 1")
def psi_two_sets(t):
    return psi.psi(psi.psi_details(lines(t), late(), "taxn", 5, ["l_linenumber"]), ["l_linenumber"])


@query(f"""
WITH {LINES}, e AS (SELECT {quantiles('l_extendedprice', 6)} AS edges FROM lines WHERE l_linenumber = 1),
c AS (SELECT l_linenumber, {bin_sql('l_extendedprice', 'edges')} AS bin, count(*) AS actual FROM lines, e GROUP BY ALL),
f AS (SELECT g.l_linenumber, b.bin, coalesce(c.actual, 0) AS actual, coalesce(r.actual, 0) AS expected FROM (SELECT DISTINCT l_linenumber FROM c) g, (SELECT DISTINCT bin FROM c) b
  LEFT JOIN c ON c.l_linenumber = g.l_linenumber AND c.bin = b.bin LEFT JOIN c r ON r.l_linenumber = 1 AND r.bin = b.bin),
s AS (SELECT *, greatest(expected / sum(expected) OVER w, 1e-6) AS e, greatest(actual / sum(actual) OVER w, 1e-6) AS a FROM f WINDOW w AS (PARTITION BY l_linenumber))
SELECT l_linenumber, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, round(sum((a - e) * ln(a / e)), 6) AS psi FROM s GROUP BY 1
""")
def psi_within_groups(t):
    return psi.psi_within(lines(t), "l_linenumber", 1, "l_extendedprice", 6)


def psi_many_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_discount", "taxn"):
        parts.append(f"""SELECT '{c}' AS variable, bin, count(*) FILTER (WHERE NOT late) AS expected, count(*) FILTER (WHERE late) AS actual FROM (
  SELECT {bin_sql(c, 'edges')} AS bin, late FROM l, (SELECT {quantiles(c, 5)} AS edges FROM l WHERE NOT late) WHERE {c} IS NOT NULL) GROUP BY ALL""")
    return f"""
WITH {LINES}, l AS (SELECT *, l_shipdate >= TIMESTAMP '1999-01-01' AS late FROM lines), c AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, greatest(expected / sum(expected) OVER w, 1e-6) AS e, greatest(actual / sum(actual) OVER w, 1e-6) AS a FROM c WINDOW w AS (PARTITION BY variable))
SELECT variable, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, round(sum((a - e) * ln(a / e)), 6) AS psi FROM s GROUP BY 1"""


@query(psi_many_sql())
def psi_multivariable(t):
    return psi.psi_many(lines(t), late(), ["l_quantity", "l_discount", "taxn"], 5)


def cross_sql(aggregates: str) -> str:
    return f"""
WITH {LINES}, e AS (SELECT {quantiles('l_extendedprice', 4)} AS ea, {quantiles('l_discount', 3)} AS eb FROM lines),
b AS (SELECT *, {bin_sql('l_extendedprice', 'ea')} AS bin1, {bin_sql('l_discount', 'eb')} AS bin2 FROM lines, e)
SELECT bin1, bin2, CAST(grouping(bin1, bin2) AS BIGINT) AS is_margin, {aggregates} FROM b GROUP BY CUBE (bin1, bin2)"""


def crossed(t, aggregates):
    df = lines(t)
    return cross.cross_risk(df, "l_extendedprice", "l_discount", aggregates, edges=(equal_frequency(df, "l_extendedprice", 4), equal_frequency(df, "l_discount", 3)))


@query(cross_sql("count(*) AS n, round(avg(y), 6) AS rate, round(median(l_quantity), 6) AS mid"))
def cross_risk_mean(t):
    return crossed(t, {"n": F.count("*"), "rate": F.avg("y"), "mid": F.percentile("l_quantity", 0.5)})


@query(cross_sql("round(sum(CASE WHEN taxn <> 0 THEN l_quantity END) / sum(CASE WHEN taxn <> 0 THEN taxn END), 6) AS ratio"))
def cross_risk_ratio(t):
    return crossed(t, {"ratio": cross.ratio("l_quantity", "taxn")})


@query(cross_sql("round(sum(taxn * l_quantity) / sum(l_quantity), 6) AS weighted"))
def cross_risk_weighted(t):
    return crossed(t, {"weighted": scalars.weighted_mean(F.col("taxn"), F.col("l_quantity"))})


SEGMENTS = """
WITH d AS (SELECT strftime(o_orderdate, '%Y') AS year, o_orderpriority AS priority, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice FROM orders)
SELECT CASE grouping(year, priority, status) WHEN 7 THEN 'global' WHEN 3 THEN 'year' WHEN 5 THEN 'priority' WHEN 6 THEN 'status' WHEN 1 THEN 'yearxpriority' ELSE 'yearxstatus' END AS level, year, priority, status, {0}
FROM d GROUP BY GROUPING SETS ((), (year), (priority), (status), (year, priority), (year, status))"""


def segments(t):
    return t("orders").select(
        F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), "o_totalprice",
    )


@query(SEGMENTS.format("count(y) AS n, round(avg(y), 6) AS bad_rate"))
def segment_bad_rate(t):
    return stats.rate_tables(segments(t), ["year"], ["priority", "status"], [F.count("y").alias("n"), F.avg("y").alias("bad_rate")])


@query(SEGMENTS.format("count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS mid"))
def profile_summary(t):
    return stats.rate_tables(segments(t), ["year"], ["priority", "status"], [F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.percentile("o_totalprice", 0.5).alias("mid")])


@query(f"""
WITH {LINES} SELECT 'yn' AS label, count(*) AS n, count(yn) AS observed, round(count(yn) / count(*), 6) AS observed_rate, round(avg(yn), 6) AS bad_rate,
  min(l_shipdate) FILTER (WHERE yn IS NOT NULL) AS first_time, max(l_shipdate) FILTER (WHERE yn IS NOT NULL) AS last_time FROM lines
""")
def label_coverage(t):
    known = F.col("yn").isNotNull()
    return lines(t).agg(
        F.lit("yn").alias("label"), F.count("*").alias("n"), F.count("yn").alias("observed"), (F.count("yn") / F.count("*")).alias("observed_rate"), F.avg("yn").alias("bad_rate"),
        F.min(F.when(known, F.col("l_shipdate"))).alias("first_time"), F.max(F.when(known, F.col("l_shipdate"))).alias("last_time"),
    )


CANDIDATES = """
WITH d AS (SELECT strftime(o_orderdate, '%Y') AS period, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS age FROM (SELECT DISTINCT period FROM d)),
o AS (SELECT "window", ratio, seed FROM (SELECT unnest([1, 2]) AS "window"), (SELECT unnest([60, 70]) AS ratio), (SELECT unnest([0, 1]) AS seed)),
m AS (SELECT "window", ratio, seed, y, CASE WHEN age <= "window" THEN 'oot' WHEN (o_orderkey * 31 + seed * 17) % 100 < ratio THEN 'ins' ELSE 'oos' END AS part FROM d JOIN a USING (period), o),
r AS (SELECT "window", ratio, seed, count(*) FILTER (WHERE part = 'ins') AS n_ins, count(*) FILTER (WHERE part = 'oos') AS n_oos, count(*) FILTER (WHERE part = 'oot') AS n_oot,
  avg(y) FILTER (WHERE part = 'ins') AS rate_ins, avg(y) FILTER (WHERE part = 'oos') AS rate_oos, avg(y) FILTER (WHERE part = 'oot') AS rate_oot FROM m GROUP BY ALL),
g AS (SELECT *, greatest(rate_ins, rate_oos, rate_oot) - least(rate_ins, rate_oos, rate_oot) AS gap FROM r)
SELECT "window", ratio, seed, n_ins, n_oos, n_oot, round(rate_ins, 6) AS rate_ins, round(rate_oos, 6) AS rate_oos, round(rate_oot, 6) AS rate_oot, round(gap, 6) AS gap FROM g"""


def candidates(t):
    df = t("orders").where("o_orderstatus != 'P'").select(F.date_format("o_orderdate", "yyyy").alias("period"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    return sample.split_candidates(df, "period", "y", "o_orderkey", [1, 2], [60, 70], [0, 1])


@query(CANDIDATES)
def split_candidates(t):
    return candidates(t)


@query(CANDIDATES + ' ORDER BY n_oot >= 10 DESC, g.gap, n_oot DESC, abs(ratio - 70), "window", seed LIMIT 1')
def split_recommendation(t):
    return sample.recommend_split(candidates(t), 10, 70)


def order_sides(t):
    left = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    right = left.where("o_orderkey % 89 != 0").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 53 != 0, F.col("o_totalprice") + F.when(F.col("o_orderkey") % 97 == 0, 1).otherwise(0)).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_orderdate") + F.when(F.col("o_orderkey") % 71 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))).alias("o_orderdate"),
    )
    return left.where("o_orderkey % 83 != 0"), right


def comparison(t):
    return compare.Comparison(*order_sides(t), compare.CompareConfig(["o_orderkey"], tolerance=0.5, seconds=3600))


SIDES = """
WITH l AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 83 <> 0),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 53 <> 0 THEN o_totalprice + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END END AS o_totalprice,
  CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate + CASE WHEN o_orderkey % 71 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS o_orderdate FROM orders WHERE o_orderkey % 89 <> 0),
j AS (SELECT l.o_orderkey AS lk, r.o_orderkey AS rk, l.o_totalprice AS lp, r.o_totalprice AS rp, l.o_orderstatus AS ls, r.o_orderstatus AS rs, l.o_orderdate AS ld, r.o_orderdate AS rd FROM l FULL JOIN r ON l.o_orderkey IS NOT DISTINCT FROM r.o_orderkey),
c AS (SELECT lk AS o_orderkey, 'o_totalprice' AS "column", lp - rp AS diff, (lp IS NULL) <> (rp IS NULL) AS one_null, coalesce(abs(lp - rp) > 0.5, false) AS over FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL
  UNION ALL SELECT lk, 'o_orderstatus', NULL, (ls IS NULL) <> (rs IS NULL), coalesce(ls <> rs, false) FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL
  UNION ALL SELECT lk, 'o_orderdate', epoch(ld) - epoch(rd), (ld IS NULL) <> (rd IS NULL), coalesce(abs(epoch(ld) - epoch(rd)) > 3600, false) FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL)
"""


@query(SIDES + "SELECT CASE WHEN rk IS NULL THEN 'left_only' WHEN lk IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM j GROUP BY 1")
def compare_coverage(t):
    return comparison(t).coverage()


@query(SIDES + 'SELECT "column", count(*) AS n, count(*) FILTER (WHERE over OR one_null) AS n_diff, round(max(abs(diff)), 6) AS max_diff, round(avg(abs(diff)), 6) AS mean_diff, count(*) FILTER (WHERE one_null) AS n_one_null, CAST(0 AS BIGINT) AS n_both_null, round(count(*) FILTER (WHERE over OR one_null) / count(*), 6) AS diff_rate FROM c GROUP BY 1')
def compare_columns(t):
    return comparison(t).column_report()


MIXED = """
WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'abc' WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS la,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 10 + CASE WHEN o_orderkey % 17 = 0 THEN 1.0 ELSE 0.0 END END AS ra,
  CAST(o_orderkey % 5 AS VARCHAR) || '.0' AS lb, CASE WHEN o_orderkey % 19 = 0 THEN '9' WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS rb,
  'x' || CAST(o_orderkey % 3 AS VARCHAR) AS lc, CASE WHEN o_orderkey % 29 = 0 THEN '1' ELSE 'x' || CAST(o_orderkey % 3 AS VARCHAR) END AS rc FROM orders),
n AS (SELECT TRY_CAST(la AS DOUBLE) AS la, CAST(ra AS DOUBLE) AS ra, CAST(lb AS DOUBLE) AS lb, CAST(rb AS DOUBLE) AS rb, lc, rc FROM v),
c AS (SELECT 'a' AS "column", la - ra AS diff, la IS NULL AS ln, ra IS NULL AS rn, abs(la - ra) > 0.5 * abs(ra) AS over FROM n
  UNION ALL SELECT 'b', lb - rb, lb IS NULL, rb IS NULL, abs(lb - rb) > 0 FROM n UNION ALL SELECT 'c', NULL, lc IS NULL, rc IS NULL, lc <> rc FROM n)
SELECT "column", count(*) AS n, count(*) FILTER (WHERE coalesce(over, false) OR ln OR rn) AS n_diff, round(max(abs(diff)), 6) AS max_diff, round(avg(abs(diff)), 6) AS mean_diff,
  count(*) FILTER (WHERE ln <> rn) AS n_one_null, count(*) FILTER (WHERE ln AND rn) AS n_both_null, round(count(*) FILTER (WHERE coalesce(over, false) OR ln OR rn) / count(*), 6) AS diff_rate FROM c GROUP BY 1
"""


@query(MIXED)
def compare_mixed_types(t):
    """Text against number (some texts are none), numbers written as texts on both sides, and texts; nulls never equal."""
    key, num = F.col("o_orderkey"), lambda n: (F.col("o_orderkey") % n).cast("string")
    left = t("orders").select("o_orderkey", F.when(key % 7 == 0, "abc").when(key % 11 == 0, None).otherwise(num(10)).alias("a"), F.concat(num(5), F.lit(".0")).alias("b"), F.concat(F.lit("x"), num(3)).alias("c"))
    right = t("orders").select(
        "o_orderkey",
        F.when(key % 13 != 0, key % 10 + F.when(key % 17 == 0, 1.0).otherwise(0.0)).alias("a"),
        F.when(key % 19 == 0, "9").when(key % 23 == 0, None).otherwise(num(5)).alias("b"),
        F.when(key % 29 == 0, "1").otherwise(F.concat(F.lit("x"), num(3))).alias("c"),
    )
    config = compare.CompareConfig(["o_orderkey"], both_null_equal=False, column_tolerance={"a": {"rtol": 0.5}})
    return compare.Comparison(left, right, config).column_report()


@query(SIDES + """, n AS (SELECT *, CASE "column" WHEN 'o_totalprice' THEN 1 WHEN 'o_orderstatus' THEN 2 ELSE 3 END AS k FROM c WHERE over OR one_null)
SELECT o_orderkey, string_agg("column", ',' ORDER BY k) AS columns, CAST(count(*) AS INTEGER) AS n_diff FROM n GROUP BY 1""")
def compare_rows(t):
    return comparison(t).row_report()


@query(SIDES + 'SELECT o_orderkey, "column", round(diff, 6) AS diff FROM c WHERE over OR one_null ORDER BY abs(c.diff) DESC NULLS LAST, o_orderkey, "column" LIMIT 25')
def compare_cells_topn(t):
    return comparison(t).cell_report(25).select("o_orderkey", "column", "diff")


@query("""
WITH k AS (SELECT l_orderkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_suppkey, count(*) AS n, 'left' AS side FROM k GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT l_orderkey, l_suppkey, count(*), 'right' FROM k WHERE l_orderkey % 2 = 0 GROUP BY ALL HAVING count(*) > 1
""")
def compare_duplicates(t):
    left = t("lineitem").select("l_orderkey", "l_suppkey")
    return compare.Comparison(left, left.where("l_orderkey % 2 = 0"), compare.CompareConfig(["l_orderkey", "l_suppkey"])).duplicate_keys()


@query("""
SELECT 'o_orderkey' AS "column", 'bigint' AS left_type, 'bigint' AS right_type, 'key' AS role, 'both' AS status UNION ALL SELECT 'o_totalprice', 'double', 'double', 'value', 'both'
UNION ALL SELECT 'o_orderstatus', 'string', NULL, 'value', 'left_only' UNION ALL SELECT 'extra', NULL, 'int', 'value', 'right_only'
""")
def compare_schema(t):
    o = t("orders")
    return compare.Comparison(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), o.select("o_orderkey", "o_totalprice", F.lit(1).alias("extra")), compare.CompareConfig(["o_orderkey"])).schema_report()


UAT = """
WITH a AS (SELECT event_id, value, user_id, ts FROM events WHERE event_id % 50 <> 0),
b AS (SELECT event_id, CASE WHEN event_id % 40 = 0 THEN NULL WHEN event_id % 11 = 0 THEN value + 0.25 ELSE value END AS value_online, user_id + CASE WHEN event_id % 31 = 0 THEN 2 ELSE 0 END AS user_online,
  ts + CASE WHEN event_id % 13 = 0 THEN INTERVAL 5 SECOND ELSE INTERVAL 0 SECOND END AS ts_online FROM events WHERE event_id % 60 <> 0),
j AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, value, value_online, user_id, user_online, ts, ts_online FROM a FULL JOIN b ON a.event_id = b.event_id),
m AS (SELECT *, coalesce(abs(value - value_online) > 1e-6, false) OR (value IS NULL) <> (value_online IS NULL) AS bad_v, coalesce(abs(user_id - user_online) > 1e-6, false) OR (user_id IS NULL) <> (user_online IS NULL) AS bad_u,
  coalesce(abs(epoch(ts) - epoch(ts_online)) > 1, false) OR (ts IS NULL) <> (ts_online IS NULL) AS bad_t FROM j)
"""


def uat_sides(t):
    e = t("events")
    a = e.where("event_id % 50 != 0").select("event_id", "value", "user_id", "ts")
    b = e.where("event_id % 60 != 0").select(
        F.col("event_id"),
        F.when(F.col("event_id") % 40 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.col("value") + 0.25).otherwise(F.col("value")).alias("value_online"),
        (F.col("user_id") + F.when(F.col("event_id") % 31 == 0, 2).otherwise(0)).alias("user_online"),
        F.when(F.col("event_id") % 13 == 0, F.col("ts") + F.expr("INTERVAL 5 SECONDS")).otherwise(F.col("ts")).alias("ts_online"),
    )
    return a, b


PAIRS = [("value", "value_online"), ("user_id", "user_online")]


@query(UAT + """SELECT 'value' AS feature, count(*) AS n, count(value - value_online) AS n_both, count(*) FILTER (WHERE bad_v) AS n_mismatch, round(max(abs(value - value_online)), 6) AS max_diff, round(count(*) FILTER (WHERE bad_v) / count(value - value_online), 6) AS mismatch_rate FROM m
UNION ALL SELECT 'user_id', count(*), count(user_id - user_online), count(*) FILTER (WHERE bad_u), round(max(abs(user_id - user_online))::DOUBLE, 6), round(count(*) FILTER (WHERE bad_u) / count(user_id - user_online), 6) FROM m""")
def uat_features(t):
    a, b = uat_sides(t)
    return compare.uat_features(a.join(b, "event_id", "full_outer"), PAIRS)


@query(UAT + "SELECT 'ts' AS field, count(*) AS n, count(epoch(ts) - epoch(ts_online)) AS n_both, count(*) FILTER (WHERE bad_t) AS n_mismatch, round(max(abs(epoch(ts) - epoch(ts_online))), 6) AS max_seconds FROM m")
def uat_times(t):
    a, b = uat_sides(t)
    return compare.uat_times(a.join(b, "event_id", "full_outer"), [("ts", "ts_online")], 1)


@query(UAT + "SELECT event_id, CAST(bad_v AS INTEGER) + CAST(bad_u AS INTEGER) AS n_mismatch, concat_ws(',', CASE WHEN bad_v THEN 'value' END, CASE WHEN bad_u THEN 'user_id' END) AS features, NOT bad_v AND NOT bad_u AS ok FROM m")
def uat_per_key(t):
    a, b = uat_sides(t)
    return compare.uat_per_key(a.join(b, "event_id", "full_outer"), "event_id", PAIRS)


@query(UAT + "SELECT count(*) FILTER (WHERE a.event_id IS NOT NULL AND b.event_id IS NOT NULL) AS \"both\", count(*) FILTER (WHERE b.event_id IS NULL) AS left_only, count(*) FILTER (WHERE a.event_id IS NULL) AS right_only, 0::BIGINT AS left_repeated, 0::BIGINT AS right_repeated FROM a FULL JOIN b ON a.event_id = b.event_id")
def uat_coverage(t):
    return compare.uat_coverage(*uat_sides(t), "event_id")


@query("""
SELECT 'big' AS bucket, count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'
""")
def bucket_by_condition(t):
    rules = {"big": "o_totalprice > 200000", "urgent": "o_orderpriority LIKE '1%'", "open": "o_orderstatus = 'O'"}
    return cleaning.bucket_by_condition(t("orders"), rules, "bucket").groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice > 200000 THEN 'big' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def bucket_last_wins(t):
    rules = {"big": "o_totalprice > 200000", "open": "o_orderstatus = 'O'"}
    return cleaning.bucket_by_condition(t("orders"), rules, "bucket", drop_unmatched=False).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^(?i)(b|m)')")
def regex_filter(t):
    return cleaning.select_regex(cleaning.filter_regex(t("customer"), "c_mktsegment", "^(b|m)", False), "c_(custkey|name|mktsegment)$")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS vintage, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS quarter,
  CASE WHEN month(o_orderdate) % 3 = 0 THEN strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) END AS closed, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y%m') AS previous,
  strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) - INTERVAL 1 DAY AS DATE) AS sunday, strftime(o_orderdate - INTERVAL 28 DAY, '%Y%m%d') AS buffer FROM orders
""")
def periods(t):
    d = F.col("o_orderdate")
    v = scalars.vintage(F.date_format(d, "yyyy-MM-dd"))
    return t("orders").select(
        "o_orderkey", v.alias("vintage"), scalars.quarter_of_vintage(v).alias("quarter"), scalars.quarter_if_closed(v).alias("closed"), scalars.previous_vintage(d).alias("previous"),
        scalars.iso_week_period(d).alias("week"), scalars.sunday_before_week(d).alias("sunday"), scalars.buffer_date(d).alias("buffer"),
    )


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 5 + l_tax AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p > 0 AND p < 1 THEN round(500 - 20 / ln(2) * (ln(15) + ln(p / (1 - p))), 6) END AS score, round(least(p * 1.112, 0.9999999), 6) AS scaled FROM p
""")
def odds_score(t):
    p = F.col("l_discount") * 5 + F.col("l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", scalars.odds_score(p).alias("score"), scalars.scaled_score(p).alias("scaled"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_discount AS s FROM lineitem WHERE l_linestatus = 'O'), a AS (SELECT quantile_cont(l_discount, 0.25) AS cut FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, CASE WHEN s < cut THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM r, a
""")
def reject_hard(t):
    df = lines(t)
    cut = df.where("l_linestatus = 'F' AND y = 1").agg(F.percentile("l_discount", 0.25)).first()[0]
    rejected = df.where("l_linestatus = 'O'")
    return sample.reject_hard(rejected.select("l_orderkey", "l_linenumber", "l_discount"), "y", "l_discount", math.inf if cut is None else cut).drop("l_discount")


@query(f"""
WITH {LINES}, s AS (SELECT l_orderkey, l_linenumber, l_linestatus, y, l_discount * 8 AS s FROM lines)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linestatus = 'F' THEN y ELSE 1 - s END, 6)::DOUBLE AS y, round(CASE WHEN l_linestatus = 'F' THEN s * y + (1 - s) * (1 - y) ELSE 1 END, 6)::DOUBLE AS weight FROM s
""")
def reject_fuzzy(t):
    df = lines(t).select("l_orderkey", "l_linenumber", "l_linestatus", "y", (F.col("l_discount") * 8).alias("s"))
    return sample.reject_fuzzy(df.where("l_linestatus = 'F'"), df.where("l_linestatus = 'O'").drop("y"), "y", "s").select("l_orderkey", "l_linenumber", "y", "weight")


@query(f"""
WITH {LINES}, a AS (SELECT * FROM lines WHERE l_linestatus = 'F'), e AS (SELECT {quantiles('l_extendedprice', 5)} AS edges FROM a),
r AS (SELECT {bin_sql('l_extendedprice', 'edges')} AS parcel, avg(y) AS rate FROM a, e GROUP BY 1)
SELECT l_orderkey, l_linenumber, {bin_sql('l_extendedprice', 'edges')} AS parcel, round(coalesce(rate, (SELECT avg(y) FROM a)), 6) AS y FROM lines, e LEFT JOIN r ON r.parcel = {bin_sql('l_extendedprice', 'edges')} WHERE l_linestatus = 'O'
""")
def reject_parcel(t):
    df = lines(t).select("l_orderkey", "l_linenumber", "l_linestatus", "y", "l_extendedprice")
    return sample.reject_parcels(df.where("l_linestatus = 'F'"), df.where("l_linestatus = 'O'").drop("y"), "y", "l_extendedprice", 5).select("l_orderkey", "l_linenumber", "parcel", "y")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_explode(t):
    return json_shapes.records_to_rows(t("events").select("event_id", F.concat(F.lit('{"r":['), "props", F.lit("]}")).alias("j")), "j", "r array<struct<k:bigint>>", "r", ["event_id"])


@query("SELECT o_custkey, 'm' || o_custkey AS meta, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, o_orderkey AS k, o_totalprice AS p FROM orders")
def json_round_trip(t):
    """Rows to one payload a customer, ordered arrays, and back."""
    o = t("orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("meta"))
    packed = json_shapes.rows_to_payload(o, ["k", "p"], "k", ["meta"], ["o_custkey"])
    return json_shapes.arrays_to_rows(packed, "json", "meta string, inputs struct<k:array<bigint>,p:array<double>>", "inputs", ["o_custkey"])


@query(f"""
WITH {LINES} SELECT round(sum(l_quantity * l_discount) / sum(l_discount), 6) AS mean, round(sum(CASE WHEN y = 1 THEN l_discount ELSE 0 END) / sum(l_discount), 6) AS rate FROM lines
""")
def weighted_aggregates(t):
    return lines(t).agg(scalars.weighted_mean(F.col("l_quantity"), F.col("l_discount")).alias("mean"), scalars.weighted_rate(F.col("y") == 1, F.col("l_discount")).alias("rate"))


@query("""
WITH v AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem), q AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q)
SELECT q, min(v) AS value FROM v, q WHERE k >= ceil(q * (n - 1)) GROUP BY q
""")
def higher_percentile(t):
    shares = [0.1, 0.5, 0.9]
    found = higher_percentiles(t("lineitem"), "l_extendedprice", shares)
    return t("lineitem").sparkSession.createDataFrame(list(zip(shares, found)), "q double, value double")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END AS even, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS size_clean,
  CASE WHEN p_size > 25 AND p_size % 2 = 0 THEN 1 ELSE 0 END AS all_missing FROM part
""")
def cleaning_verbs(t):
    p = t("part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("even"), F.when(F.col("p_size") <= 25, F.col("p_size")).alias("size_clean"), F.when(F.col("p_size") % 2 != 0, 1).alias("odd"))
    return cleaning.bool_to_str(p.withColumn("all_missing", cleaning.missing_indicator(["size_clean", "odd"])).drop("odd"))


@query(gains_sql("SELECT list_transform(range(1, 4), lambda k: lo + (hi - lo) * k / 4) AS edges FROM (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lines)", groups=("l_returnflag",), final="SELECT l_returnflag, bin, n, round(prop, 6) AS prop FROM w"))
def distribution_table(t):
    """Equal-width distribution of a score by group."""
    df = lines(t)
    table = gains.gains_table(df, "y", "l_extendedprice", groups=["l_returnflag"], edges=equal_width(df, "l_extendedprice", 4))
    return table.select("l_returnflag", "bin", "n", "prop")


from . import queries_more  # noqa: E402, F401 (registers further queries, which use the helpers above)
