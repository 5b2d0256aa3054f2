"""Further queries: scalar rules, enrichment, audits, splits, models (rows only) and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curves, scalar
from ..operators import aggs, calibrate, features, joins, metrics, models, recommend, splits, windows
from ..sources.io import cut, shared_dir, table
from ..streaming import jobs
from .queries import B, CURVE, E, _curves, _uniform
from .registry import query
from .views import batches, events

KEYS = ["order_id", "batch_no"]


# ---- scalar rules --------------------------------------------------------------------------------------------------------


@query("filter_lab", f"""{B}
FINAL SELECT order_id, batch_no FROM g WHERE flag IN ('A', 'R') AND family = 'PROMO' AND upper(compound) LIKE 'BRAND#1%' AND mixer IN (1, 2, 3) AND start >= TIMESTAMP '1997-01-01'""")
def _(spark, d):
    r = {"variable": "family", "status": "flag", "name": "compound", "equipment": "mixer", "time": "start"}
    return scalar.filter_lab(batches(spark, d), "PROMO", ["A", "R"], "brand#1%", [1, 2, 3], "1997-01-01", r).select(*KEYS)


@query("material_class", """c AS (SELECT p_partkey, ['CE1', 'CE19', 'CN', 'CS100', 'CS2', 'CA551', 'CB', 'CC', 'CTP', 'XX'][1 + CAST(p_partkey % 10 AS INT)] || p_size AS code FROM part)
FINAL SELECT p_partkey, CASE WHEN code LIKE 'CS100%' THEN 'silica' WHEN code LIKE 'CS%' THEN 'oil' WHEN code LIKE 'CA551%' THEN 'silane' WHEN code LIKE 'CN%' THEN 'natural_rubber' WHEN code LIKE 'CE%' AND code NOT LIKE 'CE19%' THEN 'elastomer' WHEN code LIKE 'CB%' THEN 'carbon_black' WHEN code LIKE 'CC%' THEN 'masterbatch' WHEN code LIKE 'CTP%' THEN 'ctp' ELSE 'other' END AS kind FROM c""")
def _(spark, d):
    codes = F.array(*map(F.lit, ("CE1", "CE19", "CN", "CS100", "CS2", "CA551", "CB", "CC", "CTP", "XX")))
    code = F.concat(F.get(codes, (F.col("p_partkey") % 10).cast("int")), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", scalar.material_class(code).alias("kind"))


@query("order_keys", """
FINAL SELECT o_orderkey, split_part('2024~' || o_orderkey, '~', -1) AS norm, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 4 THEN '9000' || substr(CAST(o_orderkey AS VARCHAR), 5) ELSE CAST(o_orderkey AS VARCHAR) END AS lot, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS day FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select("o_orderkey", scalar.norm_order_id(F.concat(F.lit("2024~"), key)).alias("norm"), scalar.rewrite_lot(key).alias("lot"), scalar.production_date(F.lit(None), F.col("o_orderdate")).alias("day"))


@query("system_and_route", f"""{B}
FINAL SELECT order_id, batch_no, CASE WHEN discount > tax THEN 'Silica' WHEN tax > discount THEN 'CarbonBlack' WHEN upper(compound) LIKE '%SILICA%' THEN 'Silica' ELSE 'CarbonBlack' END AS system,
 CASE WHEN tax > 0.04 THEN 'oil' ELSE 'dry' END AS route, coalesce(y >= 25 AND tax > 0, false) AS silica_flag, coalesce(y >= 5, false) AS oil_flag FROM g""")
def _(spark, d):
    rows = batches(spark, d)
    route = scalar.phase_route(F.when(F.col("tax") > 0.04, F.col("tax")), F.lit(None).cast("double"))
    return rows.select(*KEYS, scalar.material_system(F.col("compound"), F.col("discount"), F.col("tax")).alias("system"), route.alias("route"), scalar.silica_flag(F.col("y"), F.col("tax")).alias("silica_flag"), scalar.oil_flag(F.col("y")).alias("oil_flag"))


@query("recipe_features", f"""{B}
FINAL SELECT order_id, batch_no, discount * tax AS dt, CASE WHEN flag = 'R' THEN discount ELSE 0 END AS gated, y / (y + price) AS nr_share, 100 * (tax / (y + price)) / 100 AS oil_polymer,
 compound || '-' || CASE WHEN y = floor(y) THEN CAST(CAST(y AS BIGINT) AS VARCHAR) || '.0' END AS code, CAST(flag = 'A' AS BIGINT) AS flag_A, CAST(flag = 'N' AS BIGINT) AS flag_N, CAST(0 AS BIGINT) AS flag_missing FROM g""", "dt gated nr_share oil_polymer")
def _(spark, d):
    rows = scalar.gate(scalar.add_products(batches(spark, d), {"dt": ["discount", "tax"]}), "flag", "R", {"gated": "discount"})
    rows = scalar.recipe_ratios(rows, ["y", "price"], "y", ["discount"], "tax")
    rows = scalar.one_hot(rows, "flag", ["A", "N"])
    return rows.select(*KEYS, "dt", "gated", "nr_share", "oil_polymer", scalar.recipe_code(F.col("compound"), [F.col("y")]).alias("code"), "flag_A", "flag_N", "flag_missing")


@query("sample_to_batch_120", f"""{B}, m AS (SELECT *, max(batch_no) OVER (PARTITION BY order_id, pallet) AS mp, max(batch_no) OVER (PARTITION BY order_id) AS mo FROM g)
FINAL SELECT order_id, batch_no, least(CASE WHEN batch_no <= 2 THEN 1 WHEN batch_no = 3 THEN 2 ELSE CAST(floor(batch_no / 1.2::DOUBLE - 1) AS BIGINT) END, mp, mo) AS batch FROM m""")
def _(spark, d):
    rows = windows.group_transform(windows.group_transform(batches(spark, d), ["order_id", "pallet"], {"mp": F.max("batch_no")}), ["order_id"], {"mo": F.max("batch_no")})
    return rows.select(*KEYS, scalar.sample_to_batch_120(F.col("batch_no"), F.col("mp"), F.col("mo")).alias("batch"))


@query("out_of_tolerance", f"""{B}
FINAL SELECT DISTINCT order_id, batch_no, y, p FROM g WHERE abs(p - y) > 10 AND abs(p - y) > 0.015 * y AND y > 5""", "p")
def _(spark, d):
    rows = batches(spark, d).withColumn("tol", F.lit(10.0))
    return scalar.out_of_tolerance(rows.select(*KEYS, "y", "p", "tol"), "y", "p", "tol").drop("tol")


@query("row_gates", f"""{B}
FINAL SELECT order_id, batch_no FROM g WHERE price < 65000 AND tax > 0.01 AND NOT (pallet < 0) AND y BETWEEN 1 AND 40""")
def _(spark, d):
    rows = scalar.safe_net(batches(spark, d), "price", "tax", False)
    rows = scalar.valid_stage_order(rows, ["pallet"], ["pallet", "batch_no"])
    return scalar.eligible_batch(rows.withColumns({"ok": F.lit(True), "wt": F.lit(0.5), "fill": F.col("y") * 2.5}), "ok", ["y"], "wt", "fill").where("y >= 1").select(*KEYS)


@query("reasons_and_levels", f"""{B}
FINAL SELECT order_id, batch_no, CASE WHEN tax - 0.04 <= -0.04 THEN 'OVER_SILANISED' WHEN tax - 0.04 >= 0.04 THEN 'UNDER_SILANISED' WHEN discount >= 0.08 THEN 'DISPERSION' ELSE 'NORMAL' END AS reason,
 CASE WHEN size < 5 THEN 'L0' WHEN size < 20 THEN 'L1' WHEN flag <> 'R' THEN 'L2' WHEN mixer > 4 THEN 'L3' ELSE 'L4' END AS maturity,
 CASE WHEN y > 40 THEN 'W1' WHEN y > 20 THEN 'W2' ELSE 'NONE' END AS window, CASE flag WHEN 'A' THEN 'temperature' WHEN 'N' THEN 'rotor_speed' ELSE 'recipe' END AS lever FROM g""")
def _(spark, d):
    rows = scalar.match_window(batches(spark, d), [("W1", F.col("y") > 40), ("W2", F.col("y") > 20)])
    # 0.08 - 0.04 isn't exactly 0.04 in either engine, but the same number in both
    reason = scalar.reason_code(F.col("tax") - 0.04, F.col("discount"), -0.04, 0.04, 0.08)
    name = F.when(F.col("flag") == "A", "max_temp").when(F.col("flag") == "N", "rotor_mean").otherwise("phr")
    return rows.select(*KEYS, reason.alias("reason"), scalar.maturity(F.col("size"), F.col("flag") == "R", F.col("mixer") <= 4).alias("maturity"), "window", scalar.lever_category(name).alias("lever"))


@query("context_and_factors", f"""{B}
FINAL SELECT order_id, batch_no, abs(y - p) AS diff_y, CAST(flag IS DISTINCT FROM family AS BIGINT) AS diff_flag, CAST(date_diff('day', start, visible) AS BIGINT) AS age_days, CASE WHEN y >= p THEN 'y' ELSE 'p' END AS top FROM g""", "diff_y")
def _(spark, d):
    rows = scalar.context_diff(batches(spark, d), [("y", "p")], [("flag", "family")], ("visible", "start"))
    top = scalar.top_factors({"y": F.col("y"), "p": F.when(F.col("p") == F.col("y"), F.lit(-1.0)).otherwise(F.col("p"))}, 1)
    return rows.select(*KEYS, "diff_y", "diff_flag", "age_days", top[0].alias("top"))


# ---- joins, sets, windows ----------------------------------------------------------------------------------------------


@query("map_labels", f"""{B}, l AS (SELECT order_id, pallet, avg(y) AS lab FROM g WHERE order_id % 3 = 0 GROUP BY 1, 2)
FINAL SELECT order_id, pallet, batch_no, lab FROM g JOIN l USING (order_id, pallet)""", "lab")
def _(spark, d):
    rows = batches(spark, d)
    lab = rows.where("order_id % 3 = 0").groupBy("order_id", "pallet").agg(F.avg("y").alias("lab"))
    return joins.map_labels(lab, rows.select("order_id", "pallet", "batch_no"), ["order_id", "pallet"])


@query("enrich_by_day", """w AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS temp FROM events GROUP BY 1)
FINAL SELECT event_id, temp FROM events JOIN w ON CAST(ts AS DATE) = day""", "temp")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return joins.enrich_left(rows.select("event_id", "day"), rows.groupBy("day").agg(F.avg("value").alias("temp")), ["day"]).drop("day")


@query("lot_quality", """
FINAL SELECT l_orderkey, upper(trim(p_brand)) AS lot, p_retailprice AS quality FROM lineitem JOIN part ON p_partkey = l_partkey""", "quality")
def _(spark, d):
    part = table(spark, d, "part")
    charges = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_partkey", F.concat(F.lit(" "), F.lower("p_brand")).alias("lot"))
    qm = part.select(F.col("p_partkey"), F.concat(F.col("p_brand"), F.lit(" ")).alias("lot"), F.col("p_retailprice").alias("quality"))
    return joins.lot_quality(charges, qm, "lot").where("l_partkey = p_partkey").select("l_orderkey", "lot", "quality")


@query("value_at", f"""{E}
FINAL SELECT a.event_id, b.value AS at_value FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND b.sec = 0 WHERE a.sec = 1""", "at_value")
def _(spark, d):
    rows = events(spark, d)
    times = rows.where("sec = 1").select("event_id", "user_id", "day", F.lit(0).cast("long").alias("at"))
    return joins.value_at(rows, times, ["user_id", "day"], "sec", "at", ["value"]).select("event_id", "at_value")


@query("trace_workoff", """
FINAL SELECT DISTINCT l_orderkey, l_suppkey, s_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""")
def _(spark, d):
    consumed = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("p_partkey"))
    produced = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.trace_workoff(consumed, table(spark, d, "part").where("p_type = 'PROMO'"), produced, ["p_partkey"], ["l_suppkey"]).drop("p_partkey").distinct()


@query("semi_and_groups", """
FINAL SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = joins.semi(table(spark, d, "orders"), big, ["o_orderkey"])
    return joins.keep_groups(rows, table(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey")


@query("match_feedback", f"""{B}, l AS (SELECT label_group, min(visible) AS t FROM g WHERE flag = 'R' GROUP BY 1)
FINAL SELECT order_id, batch_no, CASE WHEN t IS NULL THEN 'PENDING' ELSE 'MATCHED' END AS status FROM g LEFT JOIN l USING (label_group)""")
def _(spark, d):
    rows = batches(spark, d)
    lab = rows.where("flag = 'R'").select("label_group", F.col("visible").alias("lab_time"))
    return joins.match_feedback(rows.select(*KEYS, "label_group"), lab, "label_group", "lab_time").select(*KEYS, "status")


@query("class_phr", f"""{B}
FINAL SELECT compound, sum(discount) AS PROMO_phr FROM g WHERE family = 'PROMO' GROUP BY compound""", "PROMO_phr")
def _(spark, d):
    return joins.class_phr(batches(spark, d), "compound", F.col("family"), "discount", "PROMO")


@query("expand_candidates", """
FINAL SELECT c_custkey, n_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return joins.expand_candidates(c, table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@query("first_differences", f"""{B}
FINAL SELECT order_id, batch_no, y - lag(y) OVER (PARTITION BY order_id ORDER BY batch_no) AS y_diff, avg(y) OVER (PARTITION BY order_id) AS mean FROM g""", "y_diff mean")
def _(spark, d):
    rows = windows.diff(batches(spark, d), ["order_id"], [F.col("batch_no")], "y")
    return windows.group_transform(rows, ["order_id"], {"mean": F.avg("y")}).select(*KEYS, "y_diff", "mean")


@query("dedup_orders", """
FINAL SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def _(spark, d):
    return windows.dedup(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("latest_batches", """
FINAL SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25""")
def _(spark, d):
    return windows.latest_batches(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 25).select("o_orderkey", "o_custkey")


@query("union_cohorts", """
FINAL SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS cohort FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return windows.union_cohorts(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"], [F.col("o_orderkey")])


@query("pairs_distinct", f"""{B}
FINAL SELECT DISTINCT compound, mixer FROM g""")
def _(spark, d):
    return windows.union_all([batches(spark, d).select("compound", "mixer")]).distinct()


# ---- audits ------------------------------------------------------------------------------------------------------------


@query("lever_importance", f"""{B}, c AS (SELECT CASE flag WHEN 'A' THEN 'temperature' ELSE 'recipe' END AS lever, sum(price) AS importance FROM g GROUP BY 1)
FINAL SELECT lever, importance, 100.0 * importance / sum(importance) OVER () AS pct FROM c""", "importance pct")
def _(spark, d):
    name = F.when(F.col("flag") == "A", "temp").otherwise("phr")
    return aggs.lever_importance(batches(spark, d), scalar.lever_category(name), "price")


@query("contribution_pct", f"""{B}
FINAL SELECT order_id, batch_no, coalesce(100 * discount / nullif(discount + tax, 0), NULL) AS discount_pct, 100 * tax / nullif(discount + tax, 0) AS tax_pct FROM g""", "discount_pct tax_pct")
def _(spark, d):
    return aggs.contribution_pct(batches(spark, d), ["discount", "tax"]).select(*KEYS, "discount_pct", "tax_pct")


@query("delta_variance", f"""{B}, q AS (SELECT price, price - avg(price) OVER (PARTITION BY mixer) AS delta FROM g)
FINAL SELECT 'price' AS feature, var_pop(price) / 1e6 AS raw_var, var_pop(delta) / 1e6 AS delta_var, var_pop(delta) / var_pop(price) AS ratio FROM q""", "raw_var delta_var ratio")
def _(spark, d):
    out = aggs.delta_variance(aggs.process_delta(batches(spark, d), F.lit(True), ["mixer"], ["price"]), ["price"])
    return out.withColumns({"raw_var": F.col("raw_var") / 1e6, "delta_var": F.col("delta_var") / 1e6})


@query("apply_bias", f"""{B}, k AS (SELECT compound, min(family) AS family, avg(y - p) AS bias FROM g WHERE order_id % 40 = 0 GROUP BY 1), c AS (SELECT family, avg(bias) AS c FROM k GROUP BY 1)
FINAL SELECT order_id, batch_no, coalesce(k.bias, c.c, (SELECT avg(bias) FROM k)) AS bias FROM g LEFT JOIN k ON k.compound = g.compound LEFT JOIN c ON c.family = g.family""", "bias")
def _(spark, d):
    rows = batches(spark, d)
    b = rows.where("order_id % 40 = 0").groupBy("compound").agg(F.min("family").alias("family"), F.avg(F.col("y") - F.col("p")).alias("bias"))
    return aggs.apply_bias(rows, b, "compound", "family").select(*KEYS, "bias")


@query("stage2_capture", f"""{B}, q AS (SELECT order_id, count(*) AS n, var_pop(y) AS vy, var_pop(p) AS vp FROM g GROUP BY 1), r AS (SELECT count(*) AS n_orders, avg(vp / vy) AS capture FROM q WHERE n >= 3 AND vy > 1e-5)
FINAL SELECT *, CASE WHEN capture >= 0.3 THEN 'HIGH' WHEN capture >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM r""", "capture")
def _(spark, d):
    return metrics.stage2_capture(batches(spark, d), "order_id", "p", "y")


@query("compare_models", f"""{B}, a AS (SELECT compound, avg(abs(y - p)) AS before FROM g GROUP BY 1), c AS (SELECT compound, avg(abs(y - 25)) AS after FROM g GROUP BY 1)
FINAL SELECT compound, before, after, after - before AS change, CASE WHEN after < before THEN 'improved' WHEN after > before THEN 'worse' ELSE 'unchanged' END AS diagnosis FROM a JOIN c USING (compound)""", "before after change")
def _(spark, d):
    rows = batches(spark, d)
    mae = lambda p: rows.groupBy("compound").agg(F.avg(F.abs(F.col("y") - p)).alias("mae"))
    return metrics.compare_models(mae(F.col("p")), mae(F.lit(25)), "compound", "mae")


@query("stability_audit", f"""{B}, q AS (SELECT mixer, corr(price, y) AS price, corr(tax, y) AS tax FROM g GROUP BY mixer), u AS (SELECT 'price' AS expert, price AS r FROM q UNION ALL SELECT 'tax', tax FROM q),
s AS (SELECT expert, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, max(r) AS max FROM u GROUP BY 1)
FINAL SELECT *, 100 * std / abs(mean) AS cv_pct, min * max < 0 AS sign_flip, abs(mean) = max(abs(mean)) OVER () AS dominant FROM s""", "mean std min max cv_pct")
def _(spark, d):
    return metrics.stability_audit(batches(spark, d), "mixer", ["price", "tax"], "y")


@query("date_coverage", """
FINAL SELECT 'o_orderdate' AS "column", CAST(min(o_orderdate) AS VARCHAR) AS first, CAST(max(o_orderdate) AS VARCHAR) AS last, count(*) AS n_parsed FROM orders""")
def _(spark, d):
    out = aggs.date_coverage(table(spark, d, "orders"), ["o_orderdate"])
    return out.withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query("fingerprint_distance", f"""{B}, m AS (SELECT compound, quantile_cont(y, 0.5) AS y, quantile_cont(tax, 0.5) AS t FROM g GROUP BY 1)
FINAL SELECT compound, sqrt((y - 25) ** 2 + (t - 0.04) ** 2) AS distance FROM m""", "distance")
def _(spark, d):
    f = aggs.fingerprint(batches(spark, d), "compound", ["y", "tax"])
    return f.select("compound", F.sqrt(F.pow(F.col("y_median") - 25, 2) + F.pow(F.col("tax_median") - 0.04, 2)).alias("distance"))


# ---- features, splits, calibration -----------------------------------------------------------------------------------------


@query("silica_pid", f"""{B}
FINAL SELECT order_id, batch_no, greatest(100 + y * 2 - 145, 0) * size AS pid_linear, greatest(100 + y * 2 - 160, 0) * size AS pid_over, size * exp(-8500.0 * (1 / (100 + y * 2 + CAST(273.15 AS DOUBLE)) - 1 / CAST(145 + 273.15 AS DOUBLE))) AS pid_arrhenius, tax / (100 + y * 2) AS pid_instability, price * size AS pid_work, size > 0 AND 100 + y * 2 BETWEEN 100 AND 200 AS pid_valid FROM g""", "pid_linear pid_over pid_arrhenius pid_instability pid_work")
def _(spark, d):
    rows = batches(spark, d).withColumn("t", 100 + F.col("y") * 2)
    return features.silica_pid(rows, "t", "size", "tax", "price", "y").select(*KEYS, "pid_linear", "pid_over", "pid_arrhenius", "pid_instability", "pid_work", "pid_valid")


@query("cb_dispersion", f"""{B}, z AS (SELECT *, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS zy, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS zp, (tax - avg(tax) OVER ()) / stddev_samp(tax) OVER () AS zt FROM g)
FINAL SELECT order_id, batch_no, (zy + zp + zt) / 3 AS cb_difficulty, price * size / (1 + (zy + zp + zt) / 3 - min((zy + zp + zt) / 3) OVER ()) AS cb_effective_energy FROM z""", "cb_difficulty cb_effective_energy")
def _(spark, d):
    return features.cb_v21(batches(spark, d), "y", "price", "tax", "price", "size", "discount", "mixer", "y").select(*KEYS, "cb_difficulty", "cb_effective_energy")


@query("energy_labels", f"""{B}
FINAL SELECT order_id, batch_no, CASE WHEN y > 5 AND y < 200 THEN y ELSE price / 3600 + size / 3600.0::DOUBLE END AS total_kwh, CASE WHEN y > 5 AND y < 200 THEN 'METER' ELSE 'INTEGRAL' END AS energy_source FROM g""", "total_kwh")
def _(spark, d):
    rows = batches(spark, d).withColumns({"m0": F.lit(0.0), "bottom": F.col("size").cast("double")})
    return features.energy_labels(rows, "price", "bottom", "m0", "y", "tax").select(*KEYS, "total_kwh", "energy_source")


@query("label_groups", f"""{B}
FINAL SELECT order_id, batch_no, label_group, 1.0 / count(*) OVER (PARTITION BY label_group) AS label_weight FROM g""", "label_weight")
def _(spark, d):
    return splits.label_groups(batches(spark, d).drop("label_group"), "order_id", "pallet").select(*KEYS, "label_group", "label_weight")


@query("strata", f"""{B}, q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM g),
s AS (SELECT order_id, flag || '-' || (mixer > 4) || '-' || (CAST(y > a AS INT) + CAST(y > b AS INT) + CAST(y > c AS INT)) AS stratum FROM g, q), n AS (SELECT order_id, stratum, count(*) AS k FROM s GROUP BY 1, 2)
FINAL SELECT order_id, arg_min(stratum, (-k, stratum)) AS stratum FROM n GROUP BY order_id""")
def _(spark, d):
    return splits.strata(batches(spark, d).withColumn("wet", F.col("mixer") > 4), "order_id", "flag", "wet", "y")


@query("kfold_and_split", f"""
FINAL SELECT o_orderkey, CAST(floor({_uniform(0, "o_orderkey")} * 5) AS BIGINT) AS fold, CASE WHEN {_uniform(0, "o_orderkey")} < 0.8 THEN 'train' ELSE 'test' END AS split FROM orders""")
def _(spark, d):
    return splits.random_split(splits.kfold(table(spark, d, "orders"), ["o_orderkey"]), ["o_orderkey"]).select("o_orderkey", "fold", "split")


@query("balanced_kfold", """c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT o_custkey, (row_number() OVER (ORDER BY n DESC, o_custkey) - 1) % 5 AS fold FROM c)
FINAL SELECT o_orderkey, fold FROM orders JOIN f USING (o_custkey)""")
def _(spark, d):
    return splits.balanced_group_kfold(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "fold")


KALMAN_SQL = f"""RECURSIVE {B}, r AS (SELECT l_suppkey, order_id, batch_no, CASE WHEN flag <> 'N' THEN y - p END AS res, row_number() OVER (PARTITION BY l_suppkey ORDER BY start, order_id, batch_no) AS i FROM g),
s AS (SELECT l_suppkey, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS BIGINT) AS batch_no, CAST(0.0 AS DOUBLE) AS before, CAST(0.0 AS DOUBLE) AS b, CAST(1.0 AS DOUBLE) AS v FROM r WHERE i = 1
 UNION ALL SELECT r.l_suppkey, r.i, r.order_id, r.batch_no, s.b, CASE WHEN res IS NULL THEN s.b ELSE s.b + (s.v + 0.01) / (s.v + 0.01 + 1) * (res - s.b) END, CASE WHEN res IS NULL THEN s.v ELSE (1 - (s.v + 0.01) / (s.v + 0.01 + 1)) * (s.v + 0.01) END FROM s JOIN r ON r.l_suppkey = s.l_suppkey AND r.i = s.i + 1)
FINAL SELECT l_suppkey, order_id, batch_no, greatest(-6.0, least(6.0, before)) AS kalman FROM s WHERE i > 0"""


@query("kalman_calibrate", KALMAN_SQL, "kalman")
def _(spark, d):
    rows = batches(spark, d).select("l_suppkey", "start", *KEYS, F.when(F.col("flag") != "N", F.col("y")).alias("y"), "p")
    return calibrate.kalman_calibrate(rows, ["l_suppkey"], ["start", *KEYS], "y", "p").select("l_suppkey", *KEYS, "kalman")


@query("quality_check", f"""{B}, h AS (SELECT *, 1.96 * size / 10 AS half FROM g), q AS (SELECT *, coalesce(p - half >= 20 AND p + half <= 60, false) AS in_spec, greatest(0, least(1, 1 - least(p - 20, 60 - p) / nullif(half, 0) / 2)) AS risk, tax > 0.06 AS ood FROM h)
FINAL SELECT order_id, batch_no, in_spec, risk, ood, CASE WHEN ood THEN 'LOW' WHEN risk < 0.3 THEN 'HIGH' WHEN risk < 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, in_spec AND NOT ood AS valid FROM q""", "risk")
def _(spark, d):
    rows = batches(spark, d).withColumns({"lo": F.lit(20.0), "hi": F.lit(60.0), "far": F.col("tax") * 20})
    return recommend.quality_check(rows, "p", "size", "lo", "hi", "far", unit=10.0).select(*KEYS, "in_spec", "risk", "ood", "confidence", "valid")


# ---- curves --------------------------------------------------------------------------------------------------------------


@query("curve_fractions", f"""{CURVE}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, list_avg(v) AS v_mean, list_max(v) AS v_max, list_avg(v[1:CAST(floor(len(v) * 0.35::DOUBLE) AS INT)]) AS v_early_mean FROM c""", "v_mean v_max v_early_mean")
def _(spark, d):
    out = curves.fraction_features(_curves(spark, d), ["v"], {"early": (0.0, 0.35)})
    return out.select("user_id", "day", "v_mean", "v_max", "v_early_mean")


@query("power_metrics", f"""{CURVE}
FINAL SELECT user_id, CAST(day AS VARCHAR) AS day, list_avg(v) AS power_mean, list_max(v) AS power_peak, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS power_argmax, CASE WHEN len(v) >= 2 THEN list_min(list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i])) END AS power_max_drop FROM c""", "power_mean power_peak power_max_drop")
def _(spark, d):
    return curves.power_metrics(_curves(spark, d), "v", F.lit(0), F.lit(3)).select("user_id", "day", "power_mean", "power_peak", "power_argmax", "power_max_drop")


@query("duration_audit", f"""{B}
FINAL SELECT flag, count(CASE WHEN flag <> 'R' OR y > 10 THEN y END) AS n, min(CASE WHEN flag <> 'R' OR y > 10 THEN y END) AS min, max(CASE WHEN flag <> 'R' OR y > 10 THEN y END) AS max, avg(CASE WHEN flag <> 'R' OR y > 10 THEN y END) AS mean, stddev_samp(CASE WHEN flag <> 'R' OR y > 10 THEN y END) AS std, count(CASE WHEN y < 0 OR y > 45 THEN 1 END) AS n_absurd FROM g GROUP BY flag""", "min max mean std")
def _(spark, d):
    rows = batches(spark, d).withColumn("y", F.when((F.col("flag") == "R") & (F.col("y") <= 10), -0.0).otherwise(F.col("y")))
    return curves.duration_audit(rows, "flag", "y", ["R"], 45.0)


# ---- models: rows only ---------------------------------------------------------------------------------------------------


def _train(spark, d, *columns):
    """Rows of a model, written once: a fit reads them many times, and would join and number them each time."""
    rows = batches(spark, d).withColumns({"fold": F.col("order_id") % 3, "row": F.concat_ws("_", *KEYS), "size": F.col("size").cast("double")})
    return cut(rows.select(*columns), "train")


@query("model_two_stage")
def _(spark, d):
    rows = _train(spark, d, "fold", "compound", "family", "size", "discount", "price", "tax", "y")
    model = models.TwoStageModel(["size", "discount"], ["price", "tax"], "y", "compound", "ridge", 1.0, 50.0).fit(rows.where("fold < 2"))
    return metrics.regression_metrics(model.transform(rows.where("fold = 2")), "y", "prediction", ["family"])


@query("model_separated_vs_unified")
def _(spark, d):
    rows = _train(spark, d, "fold", "family", "price", "size", "tax", "y")
    return models.separated_vs_unified(rows.where("fold < 2"), rows.where("fold = 2"), "family", ["price", "size", "tax"], "y")


@query("model_experts")
def _(spark, d):
    rows = _train(spark, d, "fold", "price", "size", "tax", "y")
    return models.ablation(rows.where("fold < 2"), rows.where("fold = 2"), {"all": {"a": ["price"], "b": ["size", "tax"]}, "a": {"a": ["price"]}}, "y", "fold")


@query("isolation_forest")
def _(spark, d):
    rows = _train(spark, d, "row", "family", "y", "price", "tax")
    return models.isolation_forest(rows, rows, ["y", "price", "tax"], "family", "row", trees=20).groupBy("family").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("n_outliers"))


@query("compound_clusters")
def _(spark, d):
    return models.cluster_compounds(batches(spark, d), "compound", ["y", "price", "tax"], 4)[0].select("compound", "n", "cluster")


@query("knn_applicability", """a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 4 = 0), q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 4 <> 0),
x AS (SELECT q.vec_id, list_distance(q.v, a.v) AS dist FROM q, a), r AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM x),
x2 AS (SELECT a.vec_id, list_distance(a.v, b.v) AS dist FROM a, a AS b), r2 AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM x2),
own AS (SELECT avg(dist) AS d FROM r2 WHERE rn BETWEEN 2 AND 6 GROUP BY vec_id), p AS (SELECT quantile_cont(d, 0.9) AS p1, quantile_cont(d, 0.95) AS p2, quantile_cont(d, 0.99) AS p3 FROM own),
k AS (SELECT vec_id, avg(dist) AS d FROM r WHERE rn <= 5 GROUP BY vec_id)
FINAL SELECT vec_id, round(d, 4) AS knn_distance, CASE WHEN d <= p1 THEN 'HIGH' WHEN d <= p2 THEN 'MEDIUM' WHEN d <= p3 THEN 'LOW' ELSE 'OUT_OF_DOMAIN' END AS reliability FROM k, p""", "knn_distance")
def _(spark, d):
    """ML17"""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    out = models.applicability(rows.where("vec_id % 4 <> 0"), rows.where("vec_id % 4 = 0"), "vec_id", "v")
    return out.select("vec_id", F.round("knn_distance", 4).alias("knn_distance"), "reliability")


# ---- streams -------------------------------------------------------------------------------------------------------------


@query("stream_monitor", """
FINAL SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS n, avg(abs(value - 100)) AS mae, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS low_share FROM events GROUP BY 1""", "mae low_share")
def _(spark, d):
    """The events replayed as a stream; windows are written as they stand when it ends."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumns({"ts": F.col("ts").cast("timestamp"), "p": F.lit(100.0), "c": F.when(F.col("event_type") == "error", "LOW").otherwise("HIGH")})
    out = jobs.monitor_stream(stream, "ts", "value", "p", "c")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")
    q = out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("window_start").cast("string").alias("window_start"), "n", "mae", "low_share")

