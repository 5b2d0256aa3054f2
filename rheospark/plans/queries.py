"""Queries for the operators over the given tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves, scalar
from ..operators import aggs, calibrate, joins, metrics, recommend, splits, windows
from ..sources.io import cut, latest_dates, table
from .registry import ORACLE, QUERIES, query
from .views import BATCH_SQL, EVENT_SQL, batches, events

__all__ = ["ORACLE", "QUERIES"]

B = BATCH_SQL.strip()
E = EVENT_SQL.strip()
ERRORS = """count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
 CASE WHEN sum(y * y) - sum(y) * sum(y) / count(*) > 1e-12 THEN 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) END AS r2"""


# ---- labels, materials, pivots -----------------------------------------------------------------------------------------


@query("label_collapse", f"""{B}
FINAL SELECT order_id, pallet, avg(y) AS y, arg_min(compound, batch_no) AS compound, arg_min(mixer, batch_no) AS mixer, count(*) AS n_tests FROM g GROUP BY order_id, pallet""", "y")
def _(spark, d):
    return aggs.collapse_retests(batches(spark, d), ["order_id", "pallet"], "y", "batch_no", ["compound", "mixer"])


@query("material_pct", f"""{B}
FINAL SELECT order_id, {", ".join(f"100.0 * sum(CASE WHEN family = '{k}' THEN y ELSE 0 END) / sum(y) AS pct_{k.lower()}" for k in ("ECONOMY", "LARGE", "PROMO"))} FROM g GROUP BY order_id""", "pct_economy pct_large pct_promo")
def _(spark, d):
    return aggs.material_pct(batches(spark, d), ["order_id"], "family", "y", ["ECONOMY", "LARGE", "PROMO"])


@query("pivot_param", f"""{B}
FINAL SELECT compound, {", ".join(f"avg(CASE WHEN flag = '{k}' THEN price END) AS price_{k}" for k in "ANR")} FROM g GROUP BY compound""", "price_A price_N price_R")
def _(spark, d):
    return aggs.pivot_mean(batches(spark, d), ["compound"], "flag", "price", ["A", "N", "R"], "price_")


@query("recipe_params", """
FINAL SELECT o_orderkey, max(CASE WHEN upper(l_returnflag) LIKE 'A%' THEN l_tax END) AS tax_a, max(CASE WHEN upper(l_returnflag) LIKE 'R%' THEN l_tax END) AS tax_r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""", "tax_a tax_r")
def _(spark, d):
    params = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_tax")
    return joins.recipe_params(table(spark, d, "orders").select("o_orderkey"), params, "o_orderkey", "l_returnflag", "l_tax", {"tax_a": "A%", "tax_r": "R%"})


@query("group_centroid", f"""{B}
FINAL SELECT order_id, pallet, avg(y) AS y, avg(price) AS price, arg_min(family, batch_no) AS family, count(*) AS n_batches FROM g GROUP BY order_id, pallet""", "y price")
def _(spark, d):
    return aggs.centroid(batches(spark, d), ["order_id", "pallet"], ["y", "price"], ["family"], "batch_no")


@query("batch_list", f"""{B}
FINAL SELECT order_id, pallet, string_agg(DISTINCT CAST(batch_no AS VARCHAR), ',' ORDER BY CAST(batch_no AS VARCHAR)) AS batches FROM g WHERE batch_no < 10 GROUP BY order_id, pallet""")
def _(spark, d):
    return aggs.batch_list(batches(spark, d).where("batch_no < 10"), ["order_id", "pallet"], "batch_no")


@query("workoff_ratio", f"""{B},
m AS (SELECT order_id, compound, avg(y) AS w, max(CASE WHEN family = 'PROMO' THEN 1 ELSE 0 END) AS off FROM g GROUP BY order_id, compound)
FINAL SELECT order_id, CAST(sum(off) AS BIGINT) AS n_workoff, sum(CASE WHEN off = 1 THEN w ELSE 0 END) AS workoff_weight, sum(CASE WHEN off = 1 THEN w ELSE 0 END) / sum(w) AS workoff_ratio FROM m GROUP BY order_id""", "workoff_weight workoff_ratio")
def _(spark, d):
    return aggs.workoff_ratio(batches(spark, d), "order_id", "compound", "y", F.col("family") == "PROMO")


# ---- outliers and bounds -----------------------------------------------------------------------------------------------


@query("order_range_filter", f"""{B}
FINAL SELECT order_id, batch_no, y FROM g WHERE order_id IN (SELECT order_id FROM g GROUP BY order_id HAVING max(y) - min(y) <= 10)""")
def _(spark, d):
    return aggs.drop_wide(batches(spark, d), ["order_id"], "y", 10.0).select("order_id", "batch_no", "y")


MAD = f"""{B},
m AS (SELECT compound, quantile_cont(y, 0.5) AS med FROM g GROUP BY compound),
o AS (SELECT g.*, abs(y - med) AS off FROM g JOIN m USING (compound)),
k AS (SELECT compound, greatest(5.0, least(10.0, 2.5 * greatest(1.4826 * quantile_cont(off, 0.5), 1.5))) AS lim FROM o GROUP BY compound)"""


@query("mad_outliers", f"""{MAD}
FINAL SELECT order_id, batch_no, compound, y FROM o JOIN k USING (compound) WHERE off <= lim""")
def _(spark, d):
    return aggs.drop_mad_outliers(batches(spark, d), ["compound"], "y").select("order_id", "batch_no", "compound", "y")


@query("far_from_median", f"""{B},
m AS (SELECT family, quantile_cont(y, 0.5) AS group_median FROM g GROUP BY family)
FINAL SELECT order_id, batch_no, group_median, abs(y - group_median) > 20 AS far FROM g JOIN m USING (family)""")
def _(spark, d):
    return aggs.flag_far_from_median(batches(spark, d), ["family"], "y", 20.0).select("order_id", "batch_no", "group_median", "far")


@query("safe_bounds", f"""{B},
s AS (SELECT compound, mixer, family, count(*) AS n, count(y) AS c, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi, quantile_cont(y, 0.5) AS med,
      CASE WHEN grouping(compound) = 1 THEN 2 WHEN grouping(mixer) = 1 THEN 1 ELSE 0 END AS level
      FROM g GROUP BY GROUPING SETS ((compound, mixer, family), (compound, family), (family)))
FINAL SELECT compound, mixer, family, CAST(level AS BIGINT) AS level, n, round_even(lo, 2) AS y_low, round_even(hi, 2) AS y_high, round_even(med, 2) AS y_median FROM s WHERE n >= 20""", "y_low y_high y_median")
def _(spark, d):
    return aggs.safe_bounds(batches(spark, d), [["compound", "mixer", "family"], ["compound", "family"], ["family"]], ["y"])


@query("energy_benchmark", f"""{B}
FINAL SELECT compound, count(y) AS n, avg(y) AS mean, quantile_cont(y, 0.1) AS p10, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.9) AS p90, avg(y) - quantile_cont(y, 0.1) AS saving_potential FROM g GROUP BY compound""", "mean p10 p50 p90 saving_potential")
def _(spark, d):
    return aggs.energy_benchmark(batches(spark, d), ["compound"], "y")


@query("label_audit", f"""{B}
FINAL SELECT family, count(y) AS n, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, max(y) AS max FROM g GROUP BY family""", "mean std min max")
def _(spark, d):
    return aggs.label_audit(batches(spark, d), ["family"], "y")


@query("stage_share", f"""{B}
FINAL SELECT family, sum(discount) / (sum(discount) + sum(tax)) AS discount_share, sum(tax) / (sum(discount) + sum(tax)) AS tax_share FROM g GROUP BY family""", "discount_share tax_share")
def _(spark, d):
    return aggs.stage_share(batches(spark, d), ["family"], ["discount", "tax"])


@query("shrunk_bias", f"""{B},
q AS (SELECT compound, family, sum(y) * sum(y) / sum(y * y) AS n_eff, sum(y * (y - p)) / sum(y) AS raw_bias FROM g GROUP BY compound, family),
c AS (SELECT family, sum(y * (y - p)) / sum(y) AS cluster_bias FROM g GROUP BY family)
FINAL SELECT q.*, cluster_bias, n_eff / (n_eff + 5) * raw_bias + (1 - n_eff / (n_eff + 5)) * cluster_bias AS bias FROM q JOIN c USING (family)""", "n_eff raw_bias cluster_bias bias")
def _(spark, d):
    return aggs.shrunk_bias(batches(spark, d).withColumn("r", F.col("y") - F.col("p")), "compound", "family", "r", "y")


@query("weighted_mean", f"""{B}
FINAL SELECT compound, sum(y * price) / sum(price) AS weighted_mean FROM g GROUP BY compound""", "weighted_mean")
def _(spark, d):
    return aggs.weighted_mean(batches(spark, d), ["compound"], "y", "price")


@query("process_delta", f"""{B},
m AS (SELECT mixer, flag, avg(price) AS m FROM g WHERE batch_no <= 3 GROUP BY mixer, flag), a AS (SELECT avg(price) AS a FROM g WHERE batch_no <= 3)
FINAL SELECT order_id, batch_no, coalesce(price - coalesce(m, a), 0) AS delta_price FROM g LEFT JOIN m USING (mixer, flag), a""", "delta_price")
def _(spark, d):
    return aggs.process_delta(batches(spark, d), F.col("batch_no") <= 3, ["mixer", "flag"], ["price"]).select("order_id", "batch_no", "delta_price")


PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM g" for c in ("y", "price", "discount"))


@query("reference_profile", f"""{B}, u AS ({PROFILE})
FINAL SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, {", ".join(f"quantile_cont(value, {p}) AS p{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))} FROM u GROUP BY feature""", "mean std p01 p05 p25 p50 p75 p95 p99")
def _(spark, d):
    return aggs.reference_profile(batches(spark, d), ["y", "price", "discount"])


def _rank(c: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@query("feature_audit", f"""{B},
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, y FROM g" for c in ("price", "discount", "tax"))}),
c AS (SELECT feature, value, count(*) AS c FROM u GROUP BY feature, value),
t AS (SELECT feature, max(c) AS top, count(*) AS n_distinct, sum(c) AS known FROM c GROUP BY feature),
r AS (SELECT feature, {_rank("value", "feature")} AS a, {_rank("y", "feature")} AS b FROM u),
s AS (SELECT feature, corr(a, b) AS rho FROM r GROUP BY feature)
FINAL SELECT feature, 0.0 AS missing_rate, top / known AS dominant_rate, n_distinct, rho, abs(rho) AS score, CASE WHEN n_distinct < 2 THEN 'constant' WHEN top / known > 0.98 THEN 'dominant' ELSE '' END AS drop_reason FROM t JOIN s USING (feature)""", "missing_rate dominant_rate rho score")
def _(spark, d):
    return aggs.feature_audit(batches(spark, d), ["price", "discount", "tax"], "y", "batch_no")


@query("group_corr", f"""{B},
u AS ({" UNION ALL ".join(f"SELECT family, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, y FROM g" for c in ("price", "tax"))}),
r AS (SELECT family, feature, {_rank("value", "family, feature")} AS a, {_rank("y", "family, feature")} AS b, value, y FROM u)
FINAL SELECT family, feature, count(*) AS n, corr(value, y) AS pearson, corr(a, b) AS spearman, 1.0 AS coverage FROM r GROUP BY family, feature HAVING count(*) > 30""", "pearson spearman coverage")
def _(spark, d):
    return aggs.group_correlation(batches(spark, d), "family", ["price", "tax"], "y")


@query("redundancy", f"""{B}, c AS (SELECT abs(corr(price, y)) AS a, abs(corr(price, discount)) AS b FROM g)
FINAL SELECT 'price' AS feature, CASE WHEN a > b THEN 'y' ELSE 'discount' END AS nearest, greatest(a, b) AS abs_r, CASE WHEN greatest(a, b) >= 0.9 THEN 'HIGH' WHEN greatest(a, b) >= 0.75 THEN 'MEDIUM' ELSE 'LOW' END AS redundancy FROM c""", "abs_r")
def _(spark, d):
    return aggs.max_redundancy(batches(spark, d), ["price"], ["y", "discount"])


@query("fingerprint", f"""{B}
FINAL SELECT compound, count(*) AS n, quantile_cont(y, 0.5) AS y_median, quantile_cont(price, 0.5) AS price_median FROM g GROUP BY compound""", "y_median price_median")
def _(spark, d):
    return aggs.fingerprint(batches(spark, d), "compound", ["y", "price"])


@query("coverage", f"""{B}, c AS (SELECT family, flag, count(*) AS n FROM g GROUP BY family, flag)
FINAL SELECT family, flag, n, 100.0 * n / sum(n) OVER (PARTITION BY family) AS pct FROM c""", "pct")
def _(spark, d):
    return aggs.coverage(batches(spark, d), ["family", "flag"], ["family"])


@query("pilot_window", f"""{B}, c AS (SELECT compound, flag, count(*) AS k FROM g GROUP BY compound, flag), m AS (SELECT compound, arg_min(flag, (-k, flag)) AS flag FROM c GROUP BY compound)
FINAL SELECT compound, count(*) AS n, quantile_cont(price, 0.25) AS price_p25, quantile_cont(price, 0.5) AS price_p50, quantile_cont(price, 0.75) AS price_p75, min(price) AS price_min, max(price) AS price_max, any_value(m.flag) AS flag FROM g JOIN m USING (compound) GROUP BY compound""", "price_p25 price_p50 price_p75 price_min price_max")
def _(spark, d):
    return aggs.pilot_window(batches(spark, d), ["compound"], ["price"], "flag")


@query("distinct_counts", f"""{B}
FINAL SELECT count(DISTINCT order_id) AS n_order_id, count(DISTINCT compound) AS n_compound, count(DISTINCT label_group) AS n_label_group FROM g""")
def _(spark, d):
    return aggs.distinct_counts(batches(spark, d), ["order_id", "compound", "label_group"])


@query("label_conflicts", f"""{B}
FINAL SELECT label_group, count(y) AS n, stddev_samp(y) AS std, max(y) - min(y) AS range FROM g GROUP BY label_group HAVING count(*) > 1 AND (stddev_samp(y) > 3 OR max(y) - min(y) > 6)""", "std range")
def _(spark, d):
    return aggs.label_conflicts(batches(spark, d), "label_group", "y")


@query("label_group_summary", f"""{B}, q AS (SELECT label_group, count(*) AS size, avg(y) AS y, sum(price) AS w FROM g GROUP BY label_group)
FINAL SELECT count(*) AS n_groups, CAST(sum(size) AS BIGINT) AS n_rows, avg(size) AS mean_size, max(size) AS max_size, avg(y) AS mean_label, stddev_samp(y) AS std_label, sum(w) AS weight FROM q""", "mean_size mean_label std_label weight")
def _(spark, d):
    return aggs.label_group_summary(batches(spark, d), "label_group", "y", "price")


SPLIT = "CASE WHEN order_id % 10 < 7 THEN 'train' ELSE 'test' END"


@query("leakage_audit", f"""{B}, s AS (SELECT *, {SPLIT} AS split FROM g), a AS (SELECT compound AS v, count(DISTINCT split) AS n FROM s GROUP BY 1), o AS (SELECT label_group AS v, count(DISTINCT split) AS n FROM s GROUP BY 1)
FINAL SELECT 'recipe' AS key, count(*) AS n_keys, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaks, CASE WHEN sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM a
UNION ALL SELECT 'label_group', count(*), CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT), CASE WHEN sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'FAIL' END FROM o""")
def _(spark, d):
    return aggs.leakage_audit(batches(spark, d).withColumn("split", F.expr(SPLIT)), {"recipe": "compound", "label_group": "label_group"}, "split")


@query("mgmt_summary", """
FINAL SELECT n_name, count(s_suppkey) AS n, count(CASE WHEN s_acctbal > 5000 THEN 1 END) AS n_hit, coalesce(sum(s_acctbal), 0) AS total, avg(s_acctbal) AS mean FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name""", "total mean")
def _(spark, d):
    nation = table(spark, d, "nation")
    rows = table(spark, d, "supplier").where("s_acctbal > 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return aggs.mgmt_summary(nation, rows, "n_name", "s_acctbal", F.col("s_acctbal") > 5000)


@query("few_shot_bias", f"""{B}, f AS (SELECT compound, avg(y - p) AS f, count(*) AS n FROM g WHERE order_id % 50 = 0 GROUP BY compound), t AS (SELECT family, avg(y - p) AS t FROM g WHERE order_id % 50 = 0 GROUP BY family)
FINAL SELECT order_id, batch_no, coalesce(CASE WHEN n >= 2 THEN f END, t, 0) AS bias, CASE WHEN coalesce(n >= 2, false) THEN 'family' WHEN t IS NOT NULL THEN 'track' ELSE 'none' END AS bias_source FROM g LEFT JOIN f USING (compound) LEFT JOIN t USING (family) WHERE order_id % 50 <> 0""", "bias")
def _(spark, d):
    rows = batches(spark, d).withColumn("r", F.col("y") - F.col("p"))
    out = aggs.few_shot_bias(rows.where("order_id % 50 <> 0"), rows.where("order_id % 50 = 0"), "compound", "family", "r")
    return out.select("order_id", "batch_no", "bias", "bias_source")


@query("calibration_bias", f"""{B}, m AS (SELECT avg(y - p) AS bias FROM g)
FINAL SELECT any_value(bias) AS bias, avg(abs(y - p)) AS mae_before, avg(abs(y - p - bias)) AS mae_after FROM g, m""", "bias mae_before mae_after")
def _(spark, d):
    return aggs.calibration_bias(batches(spark, d), "y", "p")


@query("qcut_report", f"""{B}, e AS (SELECT list_distinct(quantile_cont(price, [0.0, 0.25, 0.5, 0.75, 1.0])) AS edges FROM g),
q AS (SELECT y, p, flag, greatest(1, len(list_filter(edges, lambda x: x < price))) AS bucket FROM g, e)
FINAL SELECT bucket, {ERRORS} FROM q GROUP BY bucket""", "mae rmse r2")
def _(spark, d):
    return metrics.regression_metrics(aggs.qcut(batches(spark, d), "price", 4), "y", "p", ["bucket"])


# ---- metrics -----------------------------------------------------------------------------------------------------------


@query("regression_metrics", f"""{B}
FINAL SELECT compound, {ERRORS} FROM g GROUP BY compound""", "mae rmse r2")
def _(spark, d):
    return metrics.regression_metrics(batches(spark, d), "y", "p", ["compound"])


@query("energy_metrics", f"""{B}
FINAL SELECT family, {ERRORS}, avg(100.0 * abs(y - p) / abs(y)) AS mape, avg(abs(y - p) / (price / 1000)) AS mae_per_ton, avg(CASE WHEN abs(y - p) <= 2 THEN 1.0 ELSE 0 END) AS hit_2kwh, avg(CASE WHEN abs(y - p) <= 0.05 * abs(y) THEN 1.0 ELSE 0 END) AS hit_5pct FROM g GROUP BY family""", "mae rmse r2 mape mae_per_ton hit_2kwh hit_5pct")
def _(spark, d):
    return metrics.energy_metrics(batches(spark, d).withColumn("ton", F.col("price") / 1000), "y", "p", "ton", ["family"])


COLLAPSED = f"""{B}, q AS (SELECT label_group, avg(y) AS y, avg(p) AS p, arg_min(family, batch_no) AS family FROM g GROUP BY label_group)"""


@query("metrics_rollup", f"""{COLLAPSED}
FINAL SELECT coalesce(family, 'OVERALL') AS family, {ERRORS} FROM q GROUP BY ROLLUP (family)""", "mae rmse r2")
def _(spark, d):
    rows = metrics.collapse_label_groups(batches(spark, d).withColumn("w", F.lit(1.0)), "label_group", "order_id", "batch_no", "y", "p", "w", ["family"])
    return metrics.metrics_rollup(rows, "y", "p", "family")


@query("variance_ratio", f"""{B}, q AS (SELECT order_id, count(*) AS n, var_pop(y) AS vy, var_pop(p) AS vp FROM g GROUP BY order_id)
FINAL SELECT count(*) AS n_orders, avg(vp / vy) AS variance_ratio FROM q WHERE n >= 3 AND vy > 1e-5""", "variance_ratio")
def _(spark, d):
    return metrics.variance_ratio(batches(spark, d), "order_id", "y", "p")


PAIRS = """q AS (SELECT a.compound, a.order_id, count(*) AS n, sum(CASE WHEN sign(b.y - a.y) = sign(b.p - a.p) THEN 1 ELSE 0 END) AS k
 FROM g a JOIN g b ON a.order_id = b.order_id AND a.batch_no < b.batch_no AND abs(b.y - a.y) > 0.3 GROUP BY 1, 2)"""


@query("direction_accuracy", f"""{B}, q AS (SELECT a.order_id, count(*) AS n, sum(CASE WHEN sign(b.y - a.y) = sign(b.p - a.p) THEN 1 ELSE 0 END) AS k
 FROM g a JOIN g b ON a.order_id = b.order_id AND a.batch_no < b.batch_no AND abs(b.y - a.y) > 0.3 GROUP BY 1)
FINAL SELECT count(*) AS n_orders, avg(k / n) AS direction_accuracy FROM q""", "direction_accuracy")
def _(spark, d):
    return metrics.direction_accuracy(batches(spark, d), "order_id", "batch_no", "y", "p")


@query("step_direction", f"""{B}, q AS (SELECT sign(y - lag(y) OVER w) AS a, sign(p - lag(p) OVER w) AS b FROM g WINDOW w AS (PARTITION BY order_id ORDER BY batch_no))
FINAL SELECT count(*) AS n_steps, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS step_direction FROM q WHERE a <> 0""", "step_direction")
def _(spark, d):
    return metrics.step_direction(batches(spark, d), "order_id", "batch_no", "y", "p")


@query("order_spearman", f"""{B}, f AS (SELECT * FROM g WHERE order_id IN (SELECT order_id FROM g GROUP BY 1 HAVING count(*) >= 3)),
r AS (SELECT order_id, {_rank("y", "order_id")} AS a, {_rank("p", "order_id")} AS b FROM f), c AS (SELECT order_id, corr(a, b) AS rho FROM r GROUP BY order_id)
FINAL SELECT count(*) AS n_orders, avg(rho) AS spearman FROM c WHERE rho IS NOT NULL AND NOT isnan(rho)""", "spearman")
def _(spark, d):
    return metrics.order_spearman(batches(spark, d), "order_id", "y", "p")


@query("high_dev_mae", f"""{B}, q AS (SELECT *, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s FROM g WINDOW w AS (PARTITION BY compound))
FINAL SELECT count(*) AS n, sum(price * abs(y - p)) / sum(price) AS high_dev_mae FROM q WHERE s > 0.5 AND abs(y - m) > 1.5 * s""", "high_dev_mae")
def _(spark, d):
    return metrics.high_dev_mae(batches(spark, d), "compound", "y", "p", "price")


@query("variance_layers", f"""{B}, u AS (SELECT order_id, 'y' AS layer, y AS value FROM g UNION ALL SELECT order_id, 'p', p FROM g),
w AS (SELECT layer, var_pop(value) AS global_var, stddev_pop(value) AS global_std FROM u GROUP BY layer),
i AS (SELECT layer, order_id, var_pop(value) AS v, stddev_pop(value) AS s FROM u GROUP BY layer, order_id HAVING count(*) >= 2),
j AS (SELECT layer, avg(v) AS intra_order_var, avg(s) AS intra_order_std FROM i GROUP BY layer)
FINAL SELECT w.*, intra_order_var, intra_order_std, intra_order_var / (SELECT intra_order_var FROM j WHERE layer = 'y') AS intra_order_var_ratio FROM w JOIN j USING (layer)""", "global_var global_std intra_order_var intra_order_std intra_order_var_ratio")
def _(spark, d):
    return metrics.variance_layers(batches(spark, d), ["p"], "order_id", "y")


@query("std_ratio_gate", f"""{B}, q AS (SELECT compound, count(*) AS n, greatest(0, least(5, stddev_pop(p) / stddev_pop(y))) AS ratio FROM g GROUP BY compound HAVING count(*) >= 5 AND stddev_pop(y) > 0.2)
FINAL SELECT count(*) AS n_groups, quantile_cont(ratio, 0.5) AS median_ratio, sum(ratio * n) / sum(n) AS weighted_ratio FROM q""", "median_ratio weighted_ratio")
def _(spark, d):
    return metrics.std_ratio_gate(batches(spark, d), "compound", "y", "p")


@query("deviation_corr", f"""{B}, q AS (SELECT count(*) OVER w AS n, y - avg(y) OVER w AS a, p - avg(p) OVER w AS b FROM g WINDOW w AS (PARTITION BY compound))
FINAL SELECT count(*) AS n, corr(a, b) AS deviation_corr, stddev_pop(b) / stddev_pop(a) AS std_ratio FROM q WHERE n >= 3""", "deviation_corr std_ratio")
def _(spark, d):
    return metrics.deviation_corr(batches(spark, d), "compound", "y", "p")


@query("bucket_report", f"""{B}, u AS (SELECT 'family' AS bucket_type, family AS bucket_value, y, p, flag FROM g UNION ALL SELECT 'mixer', CAST(mixer AS VARCHAR), y, p, flag FROM g),
r AS (SELECT bucket_type, bucket_value, {_rank("y", "bucket_type, bucket_value")} AS a, {_rank("p", "bucket_type, bucket_value")} AS b FROM u),
s AS (SELECT bucket_type, bucket_value, corr(a, b) AS rho FROM r GROUP BY ALL),
c AS (SELECT bucket_type, bucket_value, flag, count(*) AS k FROM u GROUP BY ALL), m AS (SELECT bucket_type, bucket_value, arg_min(flag, (-k, flag)) AS reason_top1 FROM c GROUP BY ALL),
t AS (SELECT bucket_type, bucket_value, avg(y) AS actual_mean, avg(p) AS pred_mean, avg(y - p) AS residual_mean, {ERRORS} FROM u GROUP BY bucket_type, bucket_value)
FINAL SELECT t.*, rho, reason_top1 FROM t JOIN s USING (bucket_type, bucket_value) JOIN m USING (bucket_type, bucket_value)""", "actual_mean pred_mean residual_mean mae rmse r2 rho")
def _(spark, d):
    return metrics.bucket_report(batches(spark, d), ["family", "mixer"], "y", "p", "flag")


@query("reason_audit", f"""{B}, c AS (SELECT flag, family, count(*) AS n FROM g GROUP BY flag, family)
FINAL SELECT flag, family, n, n / sum(n) OVER () AS share FROM c""", "share")
def _(spark, d):
    return metrics.reason_audit(batches(spark, d), "flag", "family")


@query("trend_validity", f"""{B}, q AS (SELECT order_id, count(*) AS n, count(DISTINCT round_even(y, 2)) AS unique_y, count(DISTINCT round_even(p, 2)) AS unique_p FROM g GROUP BY order_id)
FINAL SELECT *, 1 - unique_y / n AS tie_ratio_y, 1 - unique_p / n AS tie_ratio_p, CASE WHEN n < 3 THEN 'too_few' WHEN unique_y < 2 THEN 'constant_label' WHEN unique_p < 2 THEN 'constant_prediction' ELSE 'valid' END AS failure FROM q""", "tie_ratio_y tie_ratio_p")
def _(spark, d):
    return metrics.trend_validity(batches(spark, d), "order_id", "y", "p")


@query("compound_report", f"""{B}, {PAIRS}, o AS (SELECT compound, avg(k / n) AS direction_accuracy FROM (
 SELECT a.compound, a.order_id, count(*) AS n, sum(CASE WHEN sign(b.y - a.y) = sign(b.p - a.p) THEN 1 ELSE 0 END) AS k FROM g a JOIN g b ON a.order_id = b.order_id AND a.compound = b.compound AND a.batch_no < b.batch_no AND abs(b.y - a.y) > 0.3 GROUP BY 1, 2) GROUP BY compound),
r AS (SELECT compound, {_rank("y", "compound")} AS a, {_rank("p", "compound")} AS b FROM g), s AS (SELECT compound, corr(a, b) AS rho FROM r GROUP BY compound),
t AS (SELECT compound, {ERRORS} FROM g GROUP BY compound HAVING count(*) >= 10)
FINAL SELECT t.*, direction_accuracy, rho FROM t LEFT JOIN o USING (compound) LEFT JOIN s USING (compound)""", "mae rmse r2 direction_accuracy rho")
def _(spark, d):
    return metrics.compound_report(batches(spark, d), "compound", "order_id", "batch_no", "y", "p")


@query("detector_metrics", f"""{B}, q AS (SELECT CAST(p > 28 AS INT) AS f, CAST(y > 40 AS INT) AS t FROM g)
FINAL SELECT sum(f * t) / sum(f) AS precision, sum(f * t) / sum(t) AS recall, avg(f) AS activation FROM q""", "precision recall activation")
def _(spark, d):
    return metrics.detector_metrics(batches(spark, d).withColumns({"f": F.col("p") > 28, "t": F.col("y") > 40}), "f", "t")


@query("gates", f"""{B}, m AS (SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM g)
FINAL SELECT 'mae' AS gate, mae <= 14 AS passed, mae AS value, CAST(14.0 AS DOUBLE) AS threshold FROM m UNION ALL SELECT 'rmse', rmse <= 1, rmse, CAST(1.0 AS DOUBLE) FROM m""", "value threshold")
def _(spark, d):
    return metrics.evaluate_gates(metrics.regression_metrics(batches(spark, d), "y", "p"), [("mae", "mae", "<=", 14), ("rmse", "rmse", "<=", 1)])


@query("risk_alert", f"""{B}, m AS (SELECT compound, {ERRORS}, 100.0 * avg(CASE WHEN abs(y - p) > 20 THEN 1 ELSE 0 END) AS outlier_pct FROM g GROUP BY compound)
FINAL SELECT compound, CASE WHEN rmse > 4.5 OR outlier_pct > 10 THEN 'CRITICAL' WHEN r2 < 0.7 OR mae > 3 THEN 'WARNING' ELSE 'NORMAL' END AS level,
 concat_ws('; ', CASE WHEN rmse > 4.5 THEN 'RMSE above 4.5' END, CASE WHEN outlier_pct > 10 THEN 'outliers above 10 %' END, CASE WHEN r2 < 0.7 THEN 'R2 below 0.70' END, CASE WHEN mae > 3 THEN 'MAE above 3' END) AS reasons FROM m""")
def _(spark, d):
    rows = batches(spark, d)
    m = rows.groupBy("compound").agg(*metrics.error_aggs("y", "p"), (100.0 * F.avg((F.abs(F.col("y") - F.col("p")) > 20).cast("double"))).alias("outlier_pct"))
    return metrics.risk_alert(m).select("compound", "level", "reasons")


@query("gap_report", f"""{B}, l AS (SELECT family, quantile_cont(y, 0.9) AS threshold FROM g WHERE order_id % 10 < 7 GROUP BY family)
FINAL SELECT family, any_value(threshold) AS threshold, count(*) AS n, avg(y - p) AS bias, avg(abs(y - p)) AS abs_gap, avg(100.0 * (y - p) / y) AS pct_gap FROM g JOIN l USING (family) WHERE y > threshold GROUP BY family""", "threshold bias abs_gap pct_gap")
def _(spark, d):
    return metrics.gap_report(batches(spark, d), F.col("order_id") % 10 < 7, "family", "y", "p")


@query("subset_metrics", f"""{B}, u AS (SELECT 'promo' AS subset, y, p FROM g WHERE family = 'PROMO' UNION ALL SELECT 'late', y, p FROM g WHERE batch_no > 4)
FINAL SELECT subset, {ERRORS} FROM u GROUP BY subset UNION ALL SELECT 'none', 0, NULL, NULL, NULL""", "mae rmse r2")
def _(spark, d):
    return metrics.subset_metrics(batches(spark, d), {"promo": F.col("family") == "PROMO", "late": F.col("batch_no") > 4, "none": F.col("y") < 0}, "y", "p")


# ---- joins -------------------------------------------------------------------------------------------------------------


@query("latest_per_key", """
FINAL SELECT c_custkey, m.o_orderkey AS latest_o_orderkey, m.o_totalprice AS latest_o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_max({'o_orderkey': o_orderkey, 'o_totalprice': o_totalprice}, (o_orderdate, o_orderkey)) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""", "latest_o_totalprice")
def _(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = joins.latest_per_key(table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], "o_orderdate", ["o_orderkey", "o_totalprice"], ["o_orderkey"])
    return out.select("c_custkey", "latest_o_orderkey", "latest_o_totalprice")


@query("step_with_prev", f"""{B}
FINAL SELECT a.order_id, a.batch_no, a.price, b.price AS prev_price FROM g a LEFT JOIN g b ON a.order_id = b.order_id AND b.batch_no = a.batch_no - 1 WHERE a.flag = 'R'""", "price prev_price")
def _(spark, d):
    rows = batches(spark, d)
    return joins.step_with_prev(rows.select("order_id", "batch_no", "price"), rows.where("flag = 'R'"), ["order_id"], "batch_no", "price")


@query("interval_agg", f"""{E}, w AS (SELECT user_id, day, min(t) AS s, max(t) AS f FROM e WHERE event_type = 'view' GROUP BY user_id, day)
FINAL SELECT e.user_id, CAST(e.day AS VARCHAR) AS day, count(*) AS n, avg(value) AS mean, max(value) AS top FROM e JOIN w ON e.user_id = w.user_id AND e.day = w.day AND t BETWEEN s AND f GROUP BY e.user_id, e.day""", "mean top")
def _(spark, d):
    points = events(spark, d)
    spans = points.where("event_type = 'view'").groupBy("user_id", "day").agg(F.min("t").alias("s"), F.max("t").alias("f"))
    return joins.window_agg(points, spans, ["user_id", "day"], [], "t", "s", "f", [F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")])


@query("interval_agg_cells", f"""{E}, w AS (SELECT user_id, min(t) AS s, max(t) AS f FROM e WHERE event_type = 'signup' GROUP BY user_id)
FINAL SELECT e.user_id, count(*) AS n, sum(value) AS total FROM e JOIN w ON e.user_id = w.user_id AND t BETWEEN s AND f GROUP BY e.user_id""", "total")
def _(spark, d):
    points = events(spark, d)
    spans = points.where("event_type = 'signup'").groupBy("user_id").agg(F.min("t").alias("s"), F.max("t").alias("f"))
    return joins.window_agg(points, spans, ["user_id"], [], "t", "s", "f", [F.count("*").alias("n"), F.sum("value").alias("total")])


@query("asof_value", f"""{E}, v AS (SELECT user_id, t, event_id, value FROM e WHERE event_type = 'view')
FINAL SELECT p.event_id, p.user_id, (SELECT arg_max(v.value, (v.t, v.event_id)) FROM v WHERE v.user_id = p.user_id AND v.t <= p.t) AS asof_value FROM e p WHERE p.event_type = 'purchase'""", "asof_value")
def _(spark, d):
    rows = events(spark, d)
    out = joins.asof_value(rows.where("event_type = 'view'").select("user_id", "t", "event_id", "value"), rows.where("event_type = 'purchase'").select("event_id", "user_id", "t"), ["user_id"], "t", "t", ["value"])
    return out.select("event_id", "user_id", "asof_value")


@query("value_at_last", f"""{E}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, arg_max(value, sec) AS last_value FROM e GROUP BY user_id, day""", "last_value")
def _(spark, d):
    return joins.value_at_last(events(spark, d), ["user_id", "day"], "sec", ["value"])


@query("trace_chain", """
FINAL SELECT DISTINCT o_orderkey, l_partkey, p_brand, s_name FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    out = joins.trace(table(spark, d, "orders").select("o_orderkey"), [(line, ["o_orderkey"]), (part, ["l_partkey"]), (supplier, ["l_suppkey"])])
    return out.drop("l_suppkey").distinct()


@query("unseen_anti", """
FINAL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def _(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.unseen(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), seen, ["c_custkey"])


@query("exclude_neighbours", f"""{B}
FINAL SELECT order_id, batch_no FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.order_id = a.order_id AND b.y >= 49 AND abs(b.batch_no - a.batch_no) <= 1)""")
def _(spark, d):
    rows = batches(spark, d)
    return joins.exclude_neighbours(rows, rows.where("y >= 49"), ["order_id"], "batch_no").select("order_id", "batch_no")


@query("tiered_fill", f"""{B}, v AS (SELECT order_id, batch_no, compound, family, CASE WHEN order_id % 5 = 0 THEN NULL ELSE price END AS price FROM g),
a AS (SELECT compound, avg(price) AS m FROM v WHERE order_id % 7 = 1 GROUP BY 1), c AS (SELECT family, avg(price) AS m FROM v WHERE order_id % 7 = 1 GROUP BY 1), t AS (SELECT avg(price) AS m FROM v WHERE order_id % 7 = 1)
FINAL SELECT order_id, batch_no, compound, family, coalesce(price, a.m, c.m, t.m) AS price FROM v LEFT JOIN a USING (compound) LEFT JOIN c USING (family), t""", "price")
def _(spark, d):
    rows = batches(spark, d).select("order_id", "batch_no", "compound", "family", F.expr("CASE WHEN order_id % 5 = 0 THEN NULL ELSE price END").alias("price"))
    return joins.tiered_fill(rows, rows.where("order_id % 7 = 1"), ["price"], [["compound"], ["family"], []])


@query("bounds_match", f"""{B}, a AS (SELECT compound, mixer, quantile_cont(price, 0.05) AS low FROM g GROUP BY 1, 2 HAVING count(*) >= 20), c AS (SELECT family, quantile_cont(price, 0.05) AS low FROM g GROUP BY 1 HAVING count(*) >= 20)
FINAL SELECT order_id, batch_no, CASE WHEN a.low IS NOT NULL THEN 'EXACT' WHEN c.low IS NOT NULL THEN 'GLOBAL' ELSE 'UNAVAILABLE' END AS match_level, coalesce(a.low, c.low) AS low FROM g LEFT JOIN a USING (compound, mixer) LEFT JOIN c USING (family)""", "low")
def _(spark, d):
    rows = batches(spark, d)
    of = lambda *keys: rows.groupBy(*keys).agg(F.count("*").alias("n"), aggs.pct("price", 0.05).alias("low")).where("n >= 20").drop("n")
    out = joins.match_bounds(rows.select("order_id", "batch_no", "compound", "mixer", "family"), [("EXACT", of("compound", "mixer"), ["compound", "mixer"]), ("GLOBAL", of("family"), ["family"])], ["low"])
    return out.select("order_id", "batch_no", "match_level", "low")


@query("nearest_match", f"""{B}, s AS (SELECT order_id, max(batch_no) + 1 - order_id % 3 AS sample FROM g GROUP BY order_id), q AS (SELECT order_id, pallet, max(batch_no) AS last_batch FROM g GROUP BY 1, 2),
n AS (SELECT order_id, count(DISTINCT batch_no) AS n_batches FROM g GROUP BY 1),
r AS (SELECT s.order_id, sample, pallet, last_batch, n_batches, row_number() OVER (PARTITION BY s.order_id, sample ORDER BY abs(last_batch - sample), pallet) AS rn FROM s JOIN q USING (order_id) JOIN n USING (order_id))
FINAL SELECT order_id, sample, pallet, last_batch, n_batches FROM r WHERE rn = 1""")
def _(spark, d):
    rows = batches(spark, d)
    samples = rows.groupBy("order_id").agg((F.max("batch_no") + 1 - F.col("order_id") % 3).alias("sample"))
    return joins.sample_to_batch_nearest(samples, rows, ["order_id"], "pallet", "sample", "batch_no")


@query("pit_last_n", f"""{B}, f AS (SELECT order_id, batch_no, l_suppkey, start FROM g), h AS (
 SELECT f.order_id, f.batch_no, g.y, row_number() OVER (PARTITION BY f.order_id, f.batch_no ORDER BY g.start DESC, g.order_id DESC, g.batch_no DESC) AS rn FROM f JOIN g ON g.l_suppkey = f.l_suppkey AND g.visible < f.start),
m AS (SELECT order_id, batch_no, avg(y) AS last3_mean, count(y) AS last3_n FROM h WHERE rn <= 3 GROUP BY 1, 2)
FINAL SELECT f.order_id, f.batch_no, last3_mean, last3_n FROM f LEFT JOIN m USING (order_id, batch_no)""", "last3_mean")
def _(spark, d):
    rows = cut(batches(spark, d).select("order_id", "batch_no", "l_suppkey", "start", "visible", "y"), "batches")
    df = rows.select("order_id", "batch_no", "l_suppkey", "start")
    history = rows.select("l_suppkey", "visible", F.col("start").alias("h_start"), F.col("order_id").alias("h_order"), F.col("batch_no").alias("h_batch"), "y")
    return joins.pit_last_n(df, history, ["l_suppkey"], "start", "visible", ["h_start", "h_order", "h_batch"], "y", 3).select("order_id", "batch_no", "last3_mean", "last3_n")


@query("nearest_centroid", """c4 AS (SELECT label, avg(embedding[1]) AS a, avg(embedding[2]) AS b, avg(embedding[3]) AS c FROM embeddings GROUP BY label),
q AS (SELECT vec_id, c4.label AS centroid, sqrt((embedding[1] - a) ** 2 + (embedding[2] - b) ** 2 + (embedding[3] - c) ** 2) AS distance FROM embeddings, c4)
FINAL SELECT vec_id, CAST(arg_min(centroid, (distance, centroid)) AS BIGINT) AS centroid, min(distance) AS distance FROM q GROUP BY vec_id""", "distance")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    means = rows.groupBy("label").agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(3)])
    return joins.nearest_centroid(rows, means, ["x0", "x1", "x2"], "label").select("vec_id", "centroid", "distance")


@query("union_prefer_first", """
FINAL SELECT o_orderkey, o_totalprice, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS came_from FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0""", "o_totalprice")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    parts = [orders.where("o_orderkey % 3 = 0").withColumn("came_from", F.lit(0)), orders.where("o_orderkey % 2 = 0").withColumn("came_from", F.lit(1))]
    return joins.union_prefer_first(parts, ["o_orderkey"], [F.col("o_totalprice")])


@query("merge_metrics", f"""{B}, a AS (SELECT compound, avg(abs(y - p)) AS mae_a FROM g GROUP BY 1), c AS (SELECT compound, avg(abs(y - 25)) AS mae_b FROM g WHERE flag = 'R' GROUP BY 1)
FINAL SELECT compound, mae_a, mae_b, CASE WHEN mae_a = least(mae_a, mae_b) THEN 'a' ELSE 'b' END AS best_model FROM a FULL JOIN c USING (compound)""", "mae_a mae_b")
def _(spark, d):
    rows = batches(spark, d)
    a = rows.groupBy("compound").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    b = rows.where("flag = 'R'").groupBy("compound").agg(F.avg(F.abs(F.col("y") - 25)).alias("mae"))
    return joins.merge_metrics({"a": a, "b": b}, "compound", "mae")


# ---- windows, orders, sets ---------------------------------------------------------------------------------------------


@query("number_in_group", f"""{B}
FINAL SELECT order_id, batch_no, row_number() OVER (PARTITION BY order_id ORDER BY batch_no DESC) AS n_in_group, count(*) OVER (PARTITION BY order_id) AS group_size FROM g""")
def _(spark, d):
    return windows.number_in_group(batches(spark, d), ["order_id"], [F.desc("batch_no")]).select("order_id", "batch_no", "n_in_group", "group_size")


@query("islands", """q AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders), n AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM q)
FINAL SELECT o_custkey, o_orderkey FROM n WHERE nx IS NULL OR nx - o_orderkey > 1000""")
def _(spark, d):
    return windows.collapse_islands(table(spark, d, "orders").select("o_custkey", "o_orderkey").distinct(), ["o_custkey"], "o_orderkey", 1000)


@query("labelled_lag", f"""{B}, l AS (SELECT order_id, batch_no, y - p AS r FROM g WHERE flag <> 'N')
FINAL SELECT order_id, batch_no, lag(r, 1) OVER w AS feedback, lag(r, 2) OVER w AS feedback_before FROM l WINDOW w AS (PARTITION BY order_id ORDER BY batch_no)""", "feedback feedback_before")
def _(spark, d):
    rows = batches(spark, d).withColumn("r", F.when(F.col("flag") != "N", F.col("y") - F.col("p")))
    return windows.labelled_lag(rows, ["order_id"], [F.col("batch_no")], "r", 2).select("order_id", "batch_no", "feedback", "feedback_before")


@query("rolling_visible", f"""{B}, f AS (SELECT l_suppkey, order_id, batch_no, start, visible, y FROM g), h AS (
 SELECT a.order_id, a.batch_no, c.y, row_number() OVER (PARTITION BY a.order_id, a.batch_no ORDER BY c.start DESC, c.order_id DESC, c.batch_no DESC) AS rn
 FROM f a JOIN f c ON a.l_suppkey = c.l_suppkey AND (c.start, c.order_id, c.batch_no) < (a.start, a.order_id, a.batch_no) AND c.visible < a.start),
m AS (SELECT order_id, batch_no, avg(CASE WHEN rn <= 3 THEN y END) AS roll3_mean, stddev_pop(CASE WHEN rn <= 10 THEN y END) AS roll10_std FROM h WHERE rn <= 10 GROUP BY 1, 2)
FINAL SELECT f.order_id, f.batch_no, roll3_mean, roll10_std FROM f LEFT JOIN m USING (order_id, batch_no)""", "roll3_mean roll10_std")
def _(spark, d):
    rows = cut(batches(spark, d).select("order_id", "batch_no", "l_suppkey", "start", "visible", "y"), "batches")
    out = windows.rolling_visible(rows, ["l_suppkey"], [F.col("start"), F.col("order_id"), F.col("batch_no")], "start", "visible", "y")
    return out.select("order_id", "batch_no", "roll3_mean", "roll10_std")


@query("order_offset", f"""{B}
FINAL SELECT order_id, batch_no, coalesce(last_value(CASE WHEN flag <> 'N' THEN y - p END IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ FROM g""", "offset_")
def _(spark, d):
    rows = batches(spark, d).withColumn("r", F.when(F.col("flag") != "N", F.col("y") - F.col("p")))
    return windows.rolling_offset(rows, ["order_id"], [F.col("batch_no")], "r").select("order_id", "batch_no", F.col("offset").alias("offset_"))


@query("pct_of_total", f"""{B}
FINAL SELECT order_id, batch_no, 100.0 * price / sum(price) OVER (PARTITION BY order_id) AS pct FROM g""", "pct")
def _(spark, d):
    return windows.pct_of_total(batches(spark, d), "price", ["order_id"]).select("order_id", "batch_no", "pct")


@query("avg_rank", f"""{B}
FINAL SELECT order_id, batch_no, {_rank("y", "order_id")} AS rk FROM g""", "rk")
def _(spark, d):
    return batches(spark, d).select("order_id", "batch_no", windows.avg_rank(F.col("y"), ["order_id"]).alias("rk"))


@query("top_volatile", f"""{B}, t AS (SELECT order_id, stddev_samp(y) AS volatility FROM g GROUP BY 1 HAVING stddev_samp(y) > 5 ORDER BY 2 DESC, 1 LIMIT 10)
FINAL SELECT order_id, batch_no, y, volatility FROM g JOIN t USING (order_id)""", "volatility")
def _(spark, d):
    return windows.top_volatile(batches(spark, d), "order_id", "y", 10, 5.0).select("order_id", "batch_no", "y", "volatility")


@query("head_per_group", f"""{B}, r AS (SELECT compound, order_id, batch_no, row_number() OVER (PARTITION BY compound ORDER BY price DESC, order_id, batch_no) AS rn FROM g)
FINAL SELECT compound, order_id, batch_no FROM r WHERE rn <= 5""")
def _(spark, d):
    return windows.head_per_group(batches(spark, d), ["compound"], [F.desc("price"), F.col("order_id"), F.col("batch_no")], 5).select("compound", "order_id", "batch_no")


@query("top_cohort", f"""{B}, l AS (SELECT compound, quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.3) AS hi FROM g GROUP BY 1),
r AS (SELECT compound, order_id, batch_no, price, row_number() OVER (PARTITION BY compound ORDER BY price, order_id, batch_no) AS rn FROM g JOIN l USING (compound) WHERE price BETWEEN lo AND hi AND y BETWEEN 5 AND 45)
FINAL SELECT compound, order_id, batch_no, price FROM r WHERE rn <= 20""", "price")
def _(spark, d):
    out = windows.best_cohort(batches(spark, d), ["compound"], "price", F.col("y").between(5, 45), [F.col("order_id"), F.col("batch_no")])
    return out.select("compound", "order_id", "batch_no", "price")


@query("set_operations", """
FINAL SELECT 'both' AS kind, c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def _(spark, d):
    a, b = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    both = windows.intersect_keys(a, b, ["c_custkey"]).withColumn("kind", F.lit("both"))
    return windows.union_all([both, windows.except_keys(a, b, ["c_custkey"]).withColumn("kind", F.lit("only"))])


# ---- splits, calibration, recommendation ---------------------------------------------------------------------------------


@query("effective_weights", f"""{B}, l AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY label_group) AS lw FROM g), c AS (SELECT compound, 1 / sqrt(count(DISTINCT label_group)) AS b FROM l GROUP BY 1),
k AS (SELECT compound, greatest(1.0 / 3, least(3.0, b / (SELECT quantile_cont(b, 0.5) FROM c))) AS bal FROM c), w AS (SELECT order_id, batch_no, greatest(0.05, least(5.0, lw * bal)) AS effective_weight FROM l JOIN k USING (compound))
FINAL SELECT order_id, batch_no, effective_weight, effective_weight * count(*) OVER () / sum(effective_weight) OVER () AS loss_weight FROM w""", "effective_weight loss_weight")
def _(spark, d):
    rows = splits.label_groups(batches(spark, d).drop("label_group"), "order_id", "pallet")
    return splits.effective_weights(rows, "compound", "label_group", "label_weight").select("order_id", "batch_no", "effective_weight", "loss_weight")


@query("time_holdout", """m AS (SELECT o_custkey, quantile_cont(CAST(epoch_us(o_orderdate) AS DOUBLE), 0.5) AS median_time FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY median_time, o_custkey) AS rn, count(*) OVER () AS n FROM m)
FINAL SELECT o_custkey, CASE WHEN rn > floor(n * 0.85) THEN 'oot' ELSE 'train' END AS split FROM r""")
def _(spark, d):
    return splits.time_holdout(table(spark, d, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "split")


def _uniform(seed: int, *columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), 1, 12) AS BIGINT) / 281474976710656.0"


@query("group_kfold", f"""
FINAL SELECT o_orderkey, CAST(floor({_uniform(0, "o_custkey")} * 5) AS BIGINT) AS fold FROM orders""")
def _(spark, d):
    return splits.group_kfold(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "fold")


@query("stratified_split", f"""r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_uniform(42, "c_custkey")}, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
FINAL SELECT c_custkey, CASE WHEN (rn - 0.5) / n <= 0.7 THEN 'train' WHEN (rn - 0.5) / n <= 0.85 THEN 'val' ELSE 'test' END AS split FROM r""")
def _(spark, d):
    return splits.stratified_group_split(table(spark, d, "customer"), "c_custkey", "c_mktsegment").select("c_custkey", "split")


@query("cold_start", f"""{B}, t AS (SELECT l_partkey, count(*) AS n FROM g WHERE order_id % 10 < 7 GROUP BY 1)
FINAL SELECT order_id, batch_no FROM g LEFT JOIN t USING (l_partkey) WHERE order_id % 10 >= 7 AND coalesce(n, 0) < 20""")
def _(spark, d):
    rows = batches(spark, d)
    return splits.cold_start(rows.where("order_id % 10 >= 7"), rows.where("order_id % 10 < 7"), "l_partkey", 20).select("order_id", "batch_no")


@query("high_energy_flags", f"""{B}, t AS (SELECT family, quantile_cont(price, 0.9) AS a, quantile_cont(price / y, 0.9) AS b FROM g WHERE order_id % 10 < 7 GROUP BY 1)
FINAL SELECT order_id, batch_no, price > a AS high_energy, price / y > b AS high_per_ton FROM g JOIN t USING (family)""")
def _(spark, d):
    rows = batches(spark, d).withColumn("per", F.col("price") / F.col("y"))
    return splits.high_energy_flags(rows.where("order_id % 10 < 7"), rows, "family", "price", "per").select("order_id", "batch_no", "high_energy", "high_per_ton")


@query("super_groups", f"""RECURSIVE {B}, r AS (SELECT DISTINCT 'o' || order_id AS order_id, 'p' || l_partkey AS l_partkey FROM g WHERE flag = 'R'),
l(node, label) USING KEY (node) AS (SELECT order_id, order_id FROM r UNION SELECT l_partkey, min(order_id) FROM r GROUP BY 1
 UNION (SELECT n.node, min(n.label) AS label FROM (SELECT r.l_partkey AS node, l.label FROM l JOIN r ON r.order_id = l.node UNION ALL SELECT r.order_id, l.label FROM l JOIN r ON r.l_partkey = l.node) n
  JOIN recurring.l AS o ON o.node = n.node WHERE n.label < o.label GROUP BY 1))
FINAL SELECT order_id, l_partkey, label AS super_group FROM r JOIN l ON l.node = r.order_id""")
def _(spark, d):
    rows = batches(spark, d).where("flag = 'R'").select("order_id", "l_partkey").distinct()
    return splits.super_groups(rows.withColumns({"order_id": F.concat(F.lit("o"), "order_id"), "l_partkey": F.concat(F.lit("p"), "l_partkey")}), "order_id", "l_partkey")


EWMA_SQL = f"""RECURSIVE {B}, r AS (SELECT l_suppkey, order_id, batch_no, p, CASE WHEN flag <> 'N' THEN y - p END AS res, row_number() OVER (PARTITION BY l_suppkey ORDER BY start, order_id, batch_no) AS i FROM g),
l AS (SELECT l_suppkey, i, lag(res, 2) OVER w AS f, lag(res, 3) OVER w AS gb FROM r WHERE res IS NOT NULL WINDOW w AS (PARTITION BY l_suppkey ORDER BY i)),
j AS (SELECT r.*, f, CASE WHEN gb IS NULL THEN 0.3 WHEN abs(f - gb) >= 2 OR (sign(f) = sign(gb) AND abs(f) >= 2.5 AND abs(gb) >= 2.5) THEN 0.65 ELSE 0.2 END AS a FROM r LEFT JOIN l USING (l_suppkey, i)),
s AS (SELECT l_suppkey, i, order_id, batch_no, p, CAST(0.0 AS DOUBLE) AS before, CAST(CASE WHEN f IS NULL THEN 0.0 ELSE a * f END AS DOUBLE) AS state FROM j WHERE i = 1
 UNION ALL SELECT j.l_suppkey, j.i, j.order_id, j.batch_no, j.p, s.state, CASE WHEN j.f IS NULL THEN s.state ELSE (1 - j.a) * s.state + j.a * j.f END FROM s JOIN j ON j.l_suppkey = s.l_suppkey AND j.i = s.i + 1)
FINAL SELECT l_suppkey, order_id, batch_no, greatest(-4.0, least(4.0, before)) AS correction, p + greatest(-4.0, least(4.0, before)) AS calibrated FROM s"""


@query("ewma_calibrate", EWMA_SQL, "correction calibrated")
def _(spark, d):
    rows = batches(spark, d).select("l_suppkey", "start", "order_id", "batch_no", F.when(F.col("flag") != "N", F.col("y")).alias("y"), "p")
    return calibrate.ewma_calibrate(rows, ["l_suppkey"], ["start", "order_id", "batch_no"], "y", "p").select("l_suppkey", "order_id", "batch_no", "correction", "calibrated")


@query("recommend_gates", f"""{B}, c AS (SELECT order_id, batch_no - 1 AS candidate, price / 500 AS kwh, price / y AS per_ton, y < 45 AS ok FROM g),
q AS (SELECT order_id, count(*) AS n_candidates, count(CASE WHEN ok THEN 1 END) AS n_valid, arg_min({{'c': candidate, 'k': kwh}}, (per_ton, candidate)) FILTER (WHERE ok) AS best, max(CASE WHEN candidate = 0 THEN kwh END) AS nominal_kwh FROM c GROUP BY order_id)
FINAL SELECT order_id, n_candidates, n_valid, best.c AS candidate, best.k AS best_kwh, nominal_kwh - best.k AS saving_model,
 CASE WHEN n_valid = 0 THEN 'NO_VALID_CANDIDATE' WHEN n_valid < 2 THEN 'TOO_FEW_VALID' WHEN coalesce(nominal_kwh - best.k <= 0, true) THEN 'NO_SAVING' WHEN NOT coalesce(nominal_kwh - best.k >= 3 OR (nominal_kwh - best.k) / nominal_kwh >= 0.08, false) THEN 'SAVING_TOO_SMALL' ELSE '' END AS rejection_reason FROM q""", "best_kwh saving_model")
def _(spark, d):
    rows = batches(spark, d).select("order_id", (F.col("batch_no") - 1).alias("candidate"), (F.col("price") / 500).alias("kwh"), (F.col("price") / F.col("y")).alias("per_ton"), (F.col("y") < 45).alias("valid"))
    out = recommend.recommend(rows.withColumn("actual", F.col("kwh")), ["order_id"], "kwh", "per_ton", "actual", min_valid=2)
    return out.select("order_id", "n_candidates", "n_valid", "candidate", "best_kwh", "saving_model", "rejection_reason")


@query("candidates", f"""c AS (SELECT s_suppkey, unnest(range(0, 26)) AS candidate FROM supplier)
FINAL SELECT s_suppkey, candidate, round_even(CASE WHEN candidate = 0 THEN 50.0 ELSE 40 + 20 * ({_uniform(42, "s_suppkey", "candidate", "'speed'")}) END, 1) AS speed FROM c""", "speed")
def _(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey")
    return recommend.generate_candidates(base, ["s_suppkey"], {"speed": (F.lit(50.0), F.lit(40.0), F.lit(60.0), F.lit(True))}).select("s_suppkey", F.col("candidate").cast("long").alias("candidate"), "speed")


# ---- curves ------------------------------------------------------------------------------------------------------------

CURVE = f"""{E}, c AS (SELECT user_id, day, list(value ORDER BY sec) AS v FROM e GROUP BY user_id, day)"""


def _curves(spark, d):
    rows = events(spark, d).groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("sec", "value"))).alias("r"))
    return rows.select("user_id", "day", F.transform("r", lambda x: x["value"]).alias("v"))


@query("hex_decode", f"""{E}, h AS (SELECT user_id, day, list(CAST(round_even(value * 10, 0) AS BIGINT) ORDER BY sec) AS v FROM e GROUP BY user_id, day)
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, len(v) AS n, list_sum(v) AS total FROM h""", "total")
def _(spark, d):
    rows = events(spark, d).withColumn("h", F.lpad(F.hex(F.bround(F.col("value") * 10).cast("long")), 4, "0"))
    text = rows.groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec", "h"))), lambda x: x["h"]), "").alias("t"))
    out = text.withColumn("v", curves.decode_hex(F.col("t")))
    return out.select("user_id", "day", F.size("v").alias("n"), curves.total(F.col("v")).alias("total"))


@query("dropout_runs", f"""{E}, l AS (SELECT user_id, sec, t, event_id, value, value < 20 AS low FROM e), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM l),
r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, low ORDER BY i) AS run FROM i), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, low, run) AS k FROM r)
FINAL SELECT event_id, CASE WHEN low AND k <= 3 THEN NULL ELSE value END AS value FROM n""", "value")
def _(spark, d):
    rows = events(spark, d).select("event_id", "user_id", F.struct("t", "event_id").alias("at"), "value")
    return curves.null_short_dropouts(rows, ["user_id"], "at", "value", 20.0).select("event_id", "value")


@query("interpolate", f"""{E}, h AS (SELECT user_id, day, sec, CASE WHEN value < 20 THEN NULL ELSE value END AS v FROM e),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'t': sec, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY sec) AS a,
 first_value(CASE WHEN v IS NOT NULL THEN {{'t': sec, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY sec ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM h)
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, sec, coalesce(v, a.v + (z.v - a.v) * (sec - a.t) / (z.t - a.t), a.v, z.v, 0) AS value FROM b""", "value")
def _(spark, d):
    rows = events(spark, d).select("user_id", "day", "sec", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return curves.interpolate(rows, ["user_id", "day"], "sec", "value")


@query("resample", f"""{CURVE}, k AS (SELECT user_id, day, v, unnest(range(0, 5)) AS i FROM c), x AS (SELECT *, i * (len(v) - 1) / 4.0 AS x FROM k)
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, i, v[CAST(floor(x) AS INT) + 1] + (v[CAST(ceil(x) AS INT) + 1] - v[CAST(floor(x) AS INT) + 1]) * (x - floor(x)) AS value FROM x""", "value")
def _(spark, d):
    return _curves(spark, d).select("user_id", "day", F.posexplode(curves.resample(F.col("v"), 5)).alias("i", "value"))


@query("peer_fill", f"""{E}, h AS (SELECT event_id, event_type, sec, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM e), m AS (SELECT event_type, sec, avg(v) AS m, count(v) AS n FROM h GROUP BY 1, 2)
FINAL SELECT event_id, coalesce(v, CASE WHEN n >= 2 THEN m END) AS value FROM h JOIN m USING (event_type, sec)""", "value")
def _(spark, d):
    rows = events(spark, d).select("event_id", "event_type", "sec", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    return curves.fill_by_peer_mean(rows, ["event_type"], "sec", "value").select("event_id", "value")


@query("stage_stats", f"""{CURVE}, s AS (SELECT user_id, day, 'a' AS stage, v[1:2] AS v FROM c UNION ALL SELECT user_id, day, 'b', v[3:] FROM c)
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, stage, list_avg(v) AS v_mean, list_stddev_pop(v) AS v_std,
 CASE WHEN len(v) = 1 THEN v[1] WHEN len(v) = 0 THEN 0 ELSE list_sum(v) - (v[1] + v[len(v)]) / 2 END AS v_integral, len(v) AS duration FROM s""", "v_mean v_std v_integral")
def _(spark, d):
    rows = _curves(spark, d)
    n = F.size("v")
    cells = F.array(F.struct(F.lit("a").alias("stage"), F.lit(0).alias("s"), F.least(F.lit(2), n).alias("e")), F.struct(F.lit("b").alias("stage"), F.least(F.lit(2), n).alias("s"), n.alias("e")))
    rows = rows.select("user_id", "day", "v", F.explode(cells).alias("x")).select("user_id", "day", "v", "x.*")
    out = curves.stage_stats(rows, ["v"], ["v"], "v", "v")
    return out.select("user_id", "day", "stage", "v_mean", "v_std", "v_integral", "duration")


@query("thermal_metrics", f"""{CURVE}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, list_max(v) AS temp_max, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS temp_argmax, v[1] AS temp_init, CASE WHEN len(v) = 1 THEN 0 ELSE list_sum(v) - (v[1] + v[len(v)]) / 2 END AS temp_integral FROM c""", "temp_max temp_init temp_integral")
def _(spark, d):
    return curves.thermal_metrics(_curves(spark, d), "v", F.lit(3)).select("user_id", "day", "temp_max", "temp_argmax", "temp_init", "temp_integral")


@query("arrhenius_dose", f"""{CURVE}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, coalesce(list_sum(list_transform(list_filter(v, lambda x: x >= 135 AND x <= 200), lambda x: exp(-75000.0 / 8.314 * (1 / (x + 273.15) - 1 / CAST(423.15 AS DOUBLE))))), 0) AS dose FROM c""", "dose")
def _(spark, d):
    return _curves(spark, d).select("user_id", "day", curves.arrhenius_dose(F.col("v")).alias("dose"))


@query("curve_slope", f"""{E}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN count(*) >= 4 THEN regr_slope(value, sec) END AS slope FROM e GROUP BY user_id, day""", "slope")
def _(spark, d):
    return _curves(spark, d).select("user_id", "day", curves.slope(F.col("v")).alias("slope"))


@query("curve_agg", f"""{E}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, avg(value) AS value_avg, max(value) AS value_max FROM e GROUP BY user_id, day""", "value_avg value_max")
def _(spark, d):
    return curves.curve_agg(events(spark, d), ["user_id", "day"], ["value"])


@query("batch_kpis", f"""{E}, w AS (SELECT user_id, min(t) AS s, max(t) AS f FROM e WHERE event_type = 'view' GROUP BY user_id),
a AS (SELECT e.user_id, t, event_id, value, s, f, lag(t) OVER o AS pt, (t - lag(t) OVER o) * (value + lag(value) OVER o) / 2 AS area FROM e JOIN w USING (user_id) WINDOW o AS (PARTITION BY e.user_id ORDER BY t))
FINAL SELECT user_id, avg(CASE WHEN t BETWEEN s AND f THEN value END) AS view_value_mean, max(CASE WHEN t BETWEEN s AND f THEN value END) AS view_value_max, sum(CASE WHEN t BETWEEN s AND f AND pt >= s THEN area END) / 1e6 AS view_value_integral FROM a GROUP BY user_id""", "view_value_mean view_value_max view_value_integral")
def _(spark, d):
    points = events(spark, d).select("user_id", "t", "value")
    spans = events(spark, d).where("event_type = 'view'").groupBy("user_id").agg(F.min("t").alias("s"), F.max("t").alias("f"))
    out = joins.batch_kpis(points, spans, ["user_id"], "t", {"view": ("s", "f")}, ["value"])
    return out.withColumn("view_value_integral", F.col("view_value_integral") / 1e6)


# ---- scalars and sources -------------------------------------------------------------------------------------------------


@query("scalar_names", r"""
FINAL SELECT p_partkey, CASE WHEN regexp_replace(split_part(trim(p_name), ' ', 1), '-+$', '') = '' THEN 'Unknown' ELSE regexp_replace(split_part(trim(p_name), ' ', 1), '-+$', '') END AS family, substr(p_name, 1, 14) AS base, p_brand || '_' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS key,
 round_even(least(greatest(p_retailprice, 950), 1500), 1) AS clipped FROM part""", "clipped")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", scalar.compound_family(F.col("p_name")).alias("family"), scalar.base_compound(F.col("p_name")).alias("base"), scalar.batch_key(F.col("p_brand"), F.col("p_size")).alias("key"), scalar.half_even(scalar.clip(F.col("p_retailprice"), 950.0, 1500.0), 1).alias("clipped"))


@query("json_field", """
FINAL SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", scalar.json_field(F.col("props"), "$.k").alias("k"))


@query("route_tracks", f"""{B}, v AS (SELECT order_id, batch_no, 'f=' || flag || '/m=' || mixer AS full_, 'f=' || flag AS short FROM g), a AS (SELECT full_, count(*) AS n FROM v WHERE order_id % 10 = 0 GROUP BY 1), c AS (SELECT short, count(*) AS m FROM v WHERE order_id % 10 = 0 GROUP BY 1)
FINAL SELECT order_id, batch_no, CASE WHEN coalesce(n, 0) >= 120 THEN full_ WHEN coalesce(m, 0) >= 120 THEN short ELSE 'global' END AS track FROM v LEFT JOIN a USING (full_) LEFT JOIN c USING (short)""")
def _(spark, d):
    rows = batches(spark, d).withColumns({"f": F.col("flag"), "m": F.col("mixer")})
    return scalar.route_tracks(rows, rows.where("order_id % 10 = 0"), ["f", "m"], "f").select("order_id", "batch_no", "track")


@query("latest_dates", """
FINAL SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS x FROM events ORDER BY x DESC LIMIT 3)""")
def _(spark, d):
    return latest_dates(table(spark, d, "events").withColumn("date", F.to_date("ts")), "date", 3).select("event_id")


@query("minimum_slice", f"""{MAD}, w AS (SELECT * FROM g WHERE order_id IN (SELECT order_id FROM g GROUP BY order_id HAVING max(y) - min(y) <= 40)),
f AS (SELECT w.*, lim, abs(w.y - med) AS o2 FROM w JOIN m USING (compound) JOIN k USING (compound)), u AS (SELECT * FROM f WHERE o2 <= lim)
FINAL SELECT coalesce(compound, 'OVERALL') AS compound, {ERRORS} FROM u GROUP BY ROLLUP (compound)""", "mae rmse r2")
def flagship(spark, d):
    """Orders of narrow range, without robust outliers; errors of the expected value by compound and overall."""
    rows = cut(batches(spark, d).select("order_id", "compound", "y", "p"), "batches")
    kept = aggs.drop_mad_outliers(rows, ["compound"], "y").join(aggs.narrow_keys(rows, ["order_id"], "y", 40.0), "order_id", "left_semi")
    return metrics.metrics_rollup(kept, "y", "p", "compound")
