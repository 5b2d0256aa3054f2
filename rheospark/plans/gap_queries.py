"""Queries for operators that no other query runs: name rules, sources and sinks, calibration, recommendation views,
streams, and models that SQL can follow. The docstrings name the operators of the survey."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggs, calibrate, features, joins, metrics, models, recommend, splits, windows
from ..sources import io
from ..sources.io import cut, table
from ..streaming import jobs
from .queries import B, ERRORS
from .registry import query
from .views import batches

KEYS = ["order_id", "batch_no"]


def scratch(spark, tag: str) -> str:
    return f"{io.shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# ---- name rules ----------------------------------------------------------------------------------------------------------


@query("known_lots", """
FINAL SELECT p_partkey FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND trim(CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 4 = 1 THEN NULL ELSE p_brand END) <> ''""")
def _(spark, d):
    """PR3"""
    lot = F.when(F.col("p_partkey") % 4 == 0, " ").when(F.col("p_partkey") % 4 != 1, F.col("p_brand"))
    return scalar.known_lots(table(spark, d, "part").withColumn("lot", lot), ["PROMO", "ECONOMY"], "p_type", "lot").select("p_partkey")


@query("code_rules", r"""n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'M1-C' WHEN 1 THEN 'R1-D' WHEN 2 THEN ' X9-' ELSE 'M1' END || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') || CASE p_partkey % 3 WHEN 0 THEN '---tail' WHEN 1 THEN '-b-c' ELSE '--z' END AS code, trim(CASE p_partkey % 4 WHEN 2 THEN ' ' ELSE '' END) AS e FROM part)
FINAL SELECT p_partkey, split_part(trim(code), '-', 1) || CASE WHEN contains(trim(code), '-') THEN '-' || split_part(trim(code), '-', 2) ELSE '' END AS clean, split_part(trim(code), '-', 1) IN ('M1', 'R1') AND contains(trim(code), '-') AS main_mix,
 CASE WHEN regexp_matches(code, '[A-Z]\d-[A-Z]\d{5}') THEN regexp_extract(code, '[A-Z]\d-[A-Z]\d{5}') ELSE substr(code, 1, 12) END AS family, trim(split_part(split_part(code, '---', 1), '--', 1)) AS compound FROM n""")
def _(spark, d):
    """PR4, PR6, PR7"""
    k = F.col("p_partkey")
    code = F.concat(F.when(k % 4 == 0, "M1-C").when(k % 4 == 1, "R1-D").when(k % 4 == 2, " X9-").otherwise("M1"), F.lpad((k % 100000).cast("string"), 5, "0"), F.when(k % 3 == 0, "---tail").when(k % 3 == 1, "-b-c").otherwise("--z"))
    rows = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return rows.select("p_partkey", scalar.clean_code(F.col("code")).alias("clean"), scalar.is_main_mix(F.col("code")).alias("main_mix"), scalar.family_by_pattern(F.col("code")).alias("family"), scalar.clean_compound(F.col("code")).alias("compound"))


@query("qm_category", """n AS (SELECT p_partkey, ['STSA value', 'Iodine no.', 'OAN', 'BET area', 'ctab', 'Moisture', 'viscosity', 'ash'][1 + CAST(p_partkey % 8 AS INT)] AS t, ['CB1', 'CS100', 'CE2'][1 + CAST(p_partkey % 3 AS INT)] AS m FROM part)
FINAL SELECT p_partkey, CASE WHEN t = 'STSA value' AND m = 'CB1' THEN 'cb_stsa' WHEN t = 'Iodine no.' AND m = 'CB1' THEN 'cb_iodine' WHEN t = 'OAN' THEN 'cb_structure' WHEN t = 'BET area' AND m = 'CS100' THEN 'silica_bet' WHEN t = 'ctab' AND m = 'CS100' THEN 'silica_ctab'
 WHEN t = 'Moisture' THEN 'moisture' WHEN t = 'viscosity' THEN 'polymer_viscosity' END AS category FROM n""")
def _(spark, d):
    """PR13"""
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int"))
    text = pick("STSA value", "Iodine no.", "OAN", "BET area", "ctab", "Moisture", "viscosity", "ash")
    return table(spark, d, "part").select("p_partkey", scalar.qm_category(text, pick("CB1", "CS100", "CE2")).alias("category"))


@query("prefer_and_aliases", """
FINAL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS best, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_brand END, p_type) AS kind FROM part""", "best")
def _(spark, d):
    """PR14, PR41"""
    k = F.col("p_partkey")
    best = scalar.prefer(F.when(k % 2 == 0, F.col("p_retailprice")), F.when(k % 3 == 0, F.col("p_size").cast("double")))
    rows = table(spark, d, "part").select("p_partkey", best.alias("best"), F.when(k % 5 == 0, F.col("p_brand")).alias("kind"), F.col("p_type").alias("old_kind"))
    return scalar.apply_aliases(rows, {"old_kind": "kind", "never": "kind"})


@query("projections", """
FINAL SELECT p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part""")
def _(spark, d):
    """PR23, PR24"""
    rows = scalar.project(table(spark, d, "part"), ["p_partkey"], ["p_brand", "p_nothing"], ["p_ty", "p_si"])
    return scalar.project_policy(rows.withColumn("after", F.lit(1)), {"p_brand": {"pre", "post"}, "p_type": {"pre"}, "p_size": {"pre"}, "after": {"post"}}, "pre", ["p_partkey"])


@query("pid_quality", f"""{B}, k AS (SELECT order_id, batch_no, coalesce(flag = 'R' AND tax * 20 <= 1, false) AS ok, price FROM g)
FINAL SELECT order_id, batch_no, CASE WHEN ok THEN 'PASSED' ELSE 'FAILED_LOW_QUALITY' END AS pid_status, CASE WHEN ok THEN 'HIGH' ELSE 'LOW' END AS pid_confidence, CASE WHEN ok THEN price ELSE 0 END AS price FROM k""", "price")
def _(spark, d):
    """PR33"""
    rows = batches(spark, d).withColumns({"v": F.col("flag") == "R", "i": F.col("tax") * 20})
    return scalar.pid_quality(rows, "v", "i", "price").select(*KEYS, "pid_status", "pid_confidence", "price")


# ---- features, joins, aggregates -----------------------------------------------------------------------------------------


@query("cb_v1", f"""{B}
FINAL SELECT order_id, batch_no, price * size AS cb_work, y / nullif(tax, 0) AS cb_torque_ratio, discount AS cb_structure, (tax - y) / nullif(size, 0) AS cb_decay, p / nullif(price * size, 0) AS cb_energy_ratio FROM g""", "cb_work cb_torque_ratio cb_structure cb_decay cb_energy_ratio")
def _(spark, d):
    """FB2"""
    return features.cb_v1(batches(spark, d), "price", "size", "tax", "y", "discount", "p").select(*KEYS, "cb_work", "cb_torque_ratio", "cb_structure", "cb_decay", "cb_energy_ratio")


@query("assemble", f"""{B}
FINAL SELECT a.order_id, a.batch_no, a.y, c.price, z.tax FROM g a JOIN g c ON a.order_id = c.order_id AND a.batch_no = c.batch_no AND c.flag <> 'N' JOIN g z ON a.order_id = z.order_id AND a.batch_no = z.batch_no AND z.mixer < 7""", "price tax")
def _(spark, d):
    """JN2"""
    rows = batches(spark, d)
    return joins.assemble([rows.select(*KEYS, "y"), rows.where("flag <> 'N'").select(*KEYS, "price"), rows.where("mixer < 7").select(*KEYS, "tax")], KEYS)


@query("shrunk_bias_by_count", f"""{B}, q AS (SELECT compound, family, CAST(count(*) AS DOUBLE) AS n_eff, avg(y - p) AS raw_bias FROM g GROUP BY compound, family), c AS (SELECT family, avg(y - p) AS cluster_bias FROM g GROUP BY family)
FINAL SELECT q.*, cluster_bias, n_eff / (n_eff + 5) * raw_bias + (1 - n_eff / (n_eff + 5)) * cluster_bias AS bias FROM q JOIN c USING (family)""", "n_eff raw_bias cluster_bias bias")
def _(spark, d):
    """AG17"""
    return aggs.shrunk_bias_by_count(batches(spark, d).withColumn("r", F.col("y") - F.col("p")), "compound", "family", "r")


def _ranks(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"


@query("prune_correlated", f"""{B}, f AS (SELECT y, price, p, tax FROM g), r AS (SELECT {", ".join(map(_ranks, ("y", "price", "p", "tax")))} FROM f),
k1 AS (SELECT abs(corr(y, price)) < 0.9 AS price, abs(corr(y, p)) AS yp, abs(corr(price, p)) AS pp, abs(corr(y, tax)) AS yt, abs(corr(price, tax)) AS pt, abs(corr(p, tax)) AS ppt FROM r),
k2 AS (SELECT *, yp < 0.9 AND (NOT price OR pp < 0.9) AS p FROM k1), k3 AS (SELECT *, yt < 0.9 AND (NOT price OR pt < 0.9) AND (NOT p OR ppt < 0.9) AS tax FROM k2)
FINAL SELECT 'y' AS feature UNION ALL SELECT 'price' FROM k3 WHERE price UNION ALL SELECT 'p' FROM k3 WHERE p UNION ALL SELECT 'tax' FROM k3 WHERE tax""")
def _(spark, d):
    """AG21"""
    kept = aggs.prune_correlated(batches(spark, d).select("y", "price", "p", "tax"), ["y", "price", "p", "tax"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("promotion_decision", f"""{B}, m AS (SELECT family, avg(abs(y - p)) AS old, avg(abs(y - 25)) AS new FROM g GROUP BY family), o AS (SELECT avg(abs(y - 25)) <= 14 AS ok FROM g)
FINAL SELECT family, old, new, CASE WHEN new < old AND ok THEN 'PROMOTE' ELSE 'RETAIN' END AS decision FROM m, o""", "old new")
def _(spark, d):
    """AG45"""
    rows = batches(spark, d).withColumn("c", F.lit(25.0))
    m = rows.groupBy("family").agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("old"), F.avg(F.abs(F.col("y") - 25)).alias("new"))
    gates = metrics.evaluate_gates(metrics.regression_metrics(rows, "y", "c"), [("mae", "mae", "<=", 14)])
    return metrics.promotion_decision(m, "old", "new", gates)


def _rolled(key: str, n: int) -> str:
    return f"""h_{key} AS (SELECT a.order_id, a.batch_no, c.residual, row_number() OVER (PARTITION BY a.order_id, a.batch_no ORDER BY c.start DESC, c.order_id DESC, c.batch_no DESC) AS rn
 FROM r a JOIN r c ON a.{key} = c.{key} AND (c.start, c.order_id, c.batch_no) < (a.start, a.order_id, a.batch_no) AND c.visible < a.start),
m_{key} AS (SELECT order_id, batch_no, avg(residual) AS rolled FROM h_{key} WHERE rn <= {n} GROUP BY 1, 2)"""


@query("rolling_residual", f"""{B}, t AS (SELECT l_partkey, quantile_cont(y, 0.5) AS med FROM g WHERE order_id % 10 < 7 GROUP BY l_partkey), o AS (SELECT quantile_cont(y, 0.5) AS med FROM g WHERE order_id % 10 < 7),
r AS (SELECT order_id, batch_no, l_partkey, l_suppkey, start, visible, y - coalesce(t.med, o.med) AS residual FROM g LEFT JOIN t USING (l_partkey), o), {_rolled("l_partkey", 5)}, {_rolled("l_suppkey", 10)}
FINAL SELECT r.order_id, r.batch_no, residual, a.rolled AS group_roll5, c.rolled AS mixer_roll10 FROM r LEFT JOIN m_l_partkey a USING (order_id, batch_no) LEFT JOIN m_l_suppkey c USING (order_id, batch_no)""", "residual group_roll5 mixer_roll10")
def _(spark, d):
    """WF7"""
    order = [F.col("start"), F.col("order_id"), F.col("batch_no")]
    rows = cut(batches(spark, d).select(*KEYS, "l_partkey", "l_suppkey", "start", "visible", "y"), "batches")
    out = windows.rolling_residual(rows, F.col("order_id") % 10 < 7, "l_partkey", "l_suppkey", order, "start", "visible", "y")
    return out.select(*KEYS, "residual", "group_roll5", "mixer_roll10")


@query("top_features", f"""{B}, c AS (SELECT l_partkey, stddev_pop(y) AS score FROM g GROUP BY l_partkey)
FINAL SELECT l_partkey, score FROM c ORDER BY score DESC, l_partkey LIMIT 15""", "score")
def _(spark, d):
    """SO6"""
    return windows.top_features(batches(spark, d).groupBy("l_partkey").agg(F.stddev_pop("y").alias("score")), "score", "l_partkey", 15)


@query("total_order", f"""{B}
FINAL SELECT order_id, batch_no, row_number() OVER (ORDER BY price DESC NULLS LAST, order_id, batch_no) AS place FROM g""")
def _(spark, d):
    """SO1: every row's place in a total order."""
    return windows.number_rows(batches(spark, d), [F.desc_nulls_last("price"), F.col("order_id"), F.col("batch_no")], "place").select(*KEYS, "place")


# ---- sources and sinks: what is written is read back -----------------------------------------------------------------------


@query("read_configured", """
FINAL SELECT c_custkey, c_mktsegment FROM customer""")
def _(spark, d):
    """IO1"""
    return io.read_table(spark, {"path": f"{d}/customer.parquet"}).select("c_custkey", "c_mktsegment")


@query("csv_and_report", """
FINAL SELECT s_suppkey, s_acctbal FROM supplier""", "s_acctbal")
def _(spark, d):
    """IO4, IO7"""
    path = scratch(spark, "report")
    io.write_report(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return io.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double", ["s_suppkey", "s_acctbal"])


@query("daily_files", """
FINAL SELECT event_id, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' UNION ALL SELECT event_id, -1.0 FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-06'""", "value")
def _(spark, d):
    """IO5, IO6: the second writing replaces one date only."""
    path = scratch(spark, "daily")
    rows = table(spark, d, "events").select("event_id", "value", F.to_date("ts").alias("date")).repartition("date")
    io.write_daily(rows, path)
    io.write_daily(rows.where("date = DATE '2024-01-06'").withColumn("value", F.lit(-1.0)), path)
    return io.read_daily(spark, path, "2024-01-05").unionByName(io.read_daily(spark, path, "2024-01-06")).select("event_id", "value")


@query("log_and_state", """
FINAL SELECT o_custkey, CAST(2 AS BIGINT) AS n_runs, count(*) AS n_orders, CAST(0 AS BIGINT) AS n_before FROM orders GROUP BY o_custkey""")
def _(spark, d):
    """IO8, IO9"""
    path = scratch(spark, "state")
    before = io.load_state(spark, f"{path}/state", "o_custkey long, n_orders long")
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    n_before = before.count()
    io.save_state(counts, f"{path}/state", "o_custkey")
    for _ in range(2):
        io.append_log(counts, f"{path}/log")
    runs = spark.read.parquet(f"{path}/log").groupBy("o_custkey").agg(F.count("*").alias("n_runs"))
    return io.load_state(spark, f"{path}/state", "o_custkey long, n_orders long").join(runs, "o_custkey").withColumn("n_before", F.lit(n_before).cast("long"))


@query("vector_files", """
FINAL SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings""", "total")
def _(spark, d):
    """IO10"""
    path = scratch(spark, "vectors")
    io.write_vectors(table(spark, d, "embeddings"), path, ["vec_id"], "embedding")
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("n"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("export_latest", """
FINAL SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS x FROM events ORDER BY x DESC LIMIT 4)""")
def _(spark, d):
    """IO11"""
    path = scratch(spark, "latest")
    io.export_latest_dates(table(spark, d, "events").select("event_id", F.to_date("ts").alias("date")), path, "date", 4)
    return spark.read.parquet(path).select("event_id", "date")


@query("snapshot", f"""{B}, m AS (SELECT compound, {ERRORS} FROM g GROUP BY compound)
FINAL SELECT *, '{{"least": 3}}' AS config FROM m""", "mae rmse r2")
def _(spark, d):
    """IO12"""
    path = scratch(spark, "snapshot")
    io.snapshot(spark, path, {"metrics": metrics.regression_metrics(batches(spark, d), "y", "p", ["compound"])}, {"least": 3})
    config = spark.read.text(f"{path}/config").select(F.col("value").alias("config"))
    return spark.read.parquet(f"{path}/metrics").join(F.broadcast(config))


# ---- calibration -----------------------------------------------------------------------------------------------------------


def _residuals(spark, d):
    return batches(spark, d).select("l_suppkey", "start", *KEYS, F.when(F.col("flag") != "N", F.col("y")).alias("y"), "p")


@query("adaptive_kalman", f"""RECURSIVE {B}, r AS (SELECT l_suppkey, order_id, batch_no, p, CASE WHEN flag <> 'N' THEN y - p END AS res, row_number() OVER (PARTITION BY l_suppkey ORDER BY start, order_id, batch_no) AS i FROM g),
s AS (SELECT l_suppkey, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS BIGINT) AS batch_no, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS before, CAST(0 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS v FROM r WHERE i = 1
 UNION ALL SELECT l_suppkey, i, order_id, batch_no, p, b, CASE WHEN res IS NULL THEN b ELSE b + gain * (res - b) END, CASE WHEN res IS NULL THEN v ELSE (1 - gain) * (v + 0.2) END FROM (
  SELECT r.*, s.b, s.v, CASE WHEN abs(r.res - s.b) > 3 THEN 0.10 WHEN abs(r.res - s.b) > 1.8 THEN least(1.5 * (s.v + 0.2) / (s.v + 1.2), 0.75) ELSE least((s.v + 0.2) / (s.v + 1.2), 0.75) END AS gain FROM s JOIN r ON r.l_suppkey = s.l_suppkey AND r.i = s.i + 1))
FINAL SELECT l_suppkey, order_id, batch_no, before AS bias, p + before AS calibrated FROM s WHERE i > 0""", "bias calibrated")
def _(spark, d):
    """CA3"""
    return calibrate.adaptive_kalman(_residuals(spark, d), ["l_suppkey"], ["start", *KEYS], "y", "p").select("l_suppkey", *KEYS, "bias", "calibrated")


@query("carried_offset", f"""{B}, r AS (SELECT order_id, batch_no, p, CASE WHEN flag <> 'N' AND abs(y - p) <= 10 THEN y - p END AS res FROM g), c AS (SELECT order_id, CAST(order_id % 5 AS DOUBLE) AS carried FROM g WHERE order_id % 3 = 0 GROUP BY 1)
FINAL SELECT order_id, batch_no, coalesce(last_value(res IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), carried, 0) AS offset_, last_value(res IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_carried FROM r LEFT JOIN c USING (order_id)""", "offset_ next_carried")
def _(spark, d):
    """CA4"""
    rows = _residuals(spark, d)
    state = rows.where("order_id % 3 = 0").select("order_id", (F.col("order_id") % 5).cast("double").alias("carried")).distinct()
    out, new = calibrate.order_offset(rows, ["order_id"], [F.col("batch_no")], "y", "p", state)
    return out.join(new, "order_id", "left").select(*KEYS, F.col("offset").alias("offset_"), F.col("carried").alias("next_carried"))


@query("alpha_policy", f"""{B}
FINAL SELECT order_id, batch_no, CASE batch_no % 5 WHEN 0 THEN 0.60 WHEN 1 THEN 0.40 WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 ELSE 0.0 END AS alpha FROM g""", "alpha")
def _(spark, d):
    """CA5"""
    name = F.get(F.array(*map(F.lit, ("change_point", "fast", "normal", "stable", "rejected"))), (F.col("batch_no") % 5).cast("int"))
    return batches(spark, d).select(*KEYS, calibrate.alpha_policy(name).alias("alpha"))


# ---- recommendation --------------------------------------------------------------------------------------------------------


@query("stage_mask", f"""{B}
FINAL SELECT order_id, batch_no, coalesce(tax > 0, false) AS has_dry, coalesce(discount > 0, false) AND flag <> 'N' AS has_oil, coalesce(tax > 0.04, false) AND flag <> 'N' AS has_wet FROM g""")
def _(spark, d):
    """RC1"""
    rows = batches(spark, d).withColumns({"route": F.when(F.col("flag") == "N", "dry").otherwise("oil"), "w": F.col("tax") - 0.04})
    return recommend.stage_mask(rows, {"dry": "tax", "oil": "discount", "wet": "w"}, "route").select(*KEYS, "has_dry", "has_oil", "has_wet")


@query("template_candidates", f"""{B}, l AS (SELECT compound, quantile_cont(price, 0.1) AS lo, quantile_cont(price, 0.3) AS hi FROM g GROUP BY 1),
t AS (SELECT compound, price, tax, row_number() OVER (PARTITION BY compound ORDER BY price, order_id, batch_no) AS rn FROM g JOIN l USING (compound) WHERE price BETWEEN lo AND hi AND y BETWEEN 5 AND 45)
FINAL SELECT g.order_id, g.batch_no, g.y, t.price, t.tax FROM g JOIN t USING (compound) WHERE rn <= 5""", "price tax")
def _(spark, d):
    """RC3"""
    rows = batches(spark, d)
    templates = windows.best_cohort(rows, ["compound"], "price", F.col("y").between(5, 45), [F.col("order_id"), F.col("batch_no")], 5)
    return recommend.template_candidates(rows.select(*KEYS, "y", "compound", "price", "tax"), templates, ["compound"], ["price", "tax"]).drop("compound")


@query("candidate_status", f"""{B}
FINAL SELECT order_id, batch_no, CASE WHEN mixer = 0 THEN 'NO_BOUNDS' WHEN batch_no = 1 THEN 'COLD_START' WHEN price > 60000 THEN 'OUT_OF_DOMAIN' WHEN y > 45 THEN 'QUALITY_RISK' ELSE 'OK' END AS status,
 CASE WHEN mixer = 0 THEN 'no safe bounds for this recipe' WHEN batch_no = 1 THEN 'too little history' WHEN price > 60000 THEN 'far from known batches' WHEN y > 45 THEN 'interval leaves the specification' ELSE '' END AS status_reason FROM g""")
def _(spark, d):
    """RC5"""
    rows = batches(spark, d).withColumns({"match": F.when(F.col("mixer") == 0, "UNAVAILABLE").otherwise("EXACT"), "level": F.when(F.col("batch_no") == 1, "L1").otherwise("L3"), "ood": F.col("price") > 60000, "in_spec": F.col("y") <= 45})
    return recommend.candidate_status(rows, "match", "level").select(*KEYS, "status", "status_reason")


RUN = f"""{B}, c AS (SELECT order_id, compound, batch_no - 1 AS candidate, price / 500 AS kwh, price / y AS per_ton, y < 45 AS ok FROM g),
q AS (SELECT order_id, min(compound) AS compound, count(CASE WHEN ok THEN 1 END) AS n_valid, arg_min(kwh, (per_ton, candidate)) FILTER (WHERE ok) AS best_kwh, max(CASE WHEN candidate = 0 THEN kwh END) AS nominal FROM c GROUP BY order_id),
z AS (SELECT *, nominal - best_kwh AS saving, CASE WHEN n_valid = 0 THEN 'NO_VALID_CANDIDATE' WHEN n_valid < 2 THEN 'TOO_FEW_VALID' WHEN coalesce(nominal - best_kwh <= 0, true) THEN 'NO_SAVING' WHEN NOT coalesce(nominal - best_kwh >= 3 OR (nominal - best_kwh) / nominal >= 0.08, false) THEN 'SAVING_TOO_SMALL' ELSE '' END AS why FROM q)"""


def _recommended(spark, d):
    rows = batches(spark, d).select("order_id", (F.col("batch_no") - 1).alias("candidate"), (F.col("price") / 500).alias("kwh"), (F.col("price") / F.col("y")).alias("per_ton"), (F.col("y") < 45).alias("valid"))
    kinds = batches(spark, d).groupBy("order_id").agg(F.min("compound").alias("compound"))
    return recommend.recommend(rows.withColumn("actual", F.col("kwh")), ["order_id"], "kwh", "per_ton", "actual", min_valid=2).join(kinds, "order_id")


@query("shadow_run", f"""{RUN}, s AS (SELECT compound, count(*) AS n, count(CASE WHEN why = '' THEN 1 END) AS n_recommended, avg(CASE WHEN why = '' THEN saving END) AS mean_saving FROM z GROUP BY 1),
k AS (SELECT compound, why, count(*) AS k FROM z WHERE why <> '' GROUP BY 1, 2), m AS (SELECT compound, arg_min(why, (-k, why)) AS top_rejection FROM k GROUP BY 1)
FINAL SELECT s.*, top_rejection, (SELECT count(*) FROM z WHERE why = '') AS n_accepted, (SELECT count(*) FROM z WHERE why <> '') AS n_rejected FROM s LEFT JOIN m USING (compound)""", "mean_saving")
def _(spark, d):
    """RC7"""
    out = recommend.shadow_run(_recommended(spark, d), "compound")
    counts = out["recommended"].agg(F.count("*").alias("n_accepted")).join(F.broadcast(out["rejected"].agg(F.count("*").alias("n_rejected"))))
    return out["summary"].join(F.broadcast(counts))


@query("review_views", f"""{RUN}, w AS (SELECT *, order_id % 3 AS c, order_id % 5 AS m FROM z)
FINAL SELECT 'pilot' AS view, order_id FROM w WHERE why = '' AND c = 0 AND m >= 3 UNION ALL SELECT 'observe', order_id FROM w WHERE why = '' AND c = 1 UNION ALL SELECT 'cold_start', order_id FROM w WHERE m <= 1 UNION ALL SELECT 'preliminary', order_id FROM w WHERE why = '' AND m = 2""")
def _(spark, d):
    """RC8"""
    rows = _recommended(spark, d).withColumns({"confidence": F.get(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), (F.col("order_id") % 3).cast("int")), "maturity": F.concat(F.lit("L"), (F.col("order_id") % 5).cast("string"))})
    return windows.union_all([v.select(F.lit(n).alias("view"), "order_id") for n, v in recommend.review_views(rows).items()])


# ---- streams: the events replayed from their files -------------------------------------------------------------------------


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream, mode: str = "append"):
    """Rows that the stream gives until its input ends."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


@query("stream_score", """
FINAL SELECT event_id, value * 2 + 1 AS prediction FROM events""", "prediction")
def _(spark, d):
    """ST1"""
    folder = scratch(spark, "scores")
    q = jobs.score_stream(_stream(spark, d), lambda b: b.select("event_id", (F.col("value") * 2 + 1).alias("prediction")), f"{folder}/out", f"{folder}/state")
    q.awaitTermination()
    return spark.read.schema("event_id long, prediction double").parquet(f"{folder}/out").drop("batch")


@query("stream_features", """
FINAL SELECT event_id, value / nullif(event_id % 7, 0) AS ratio, CASE WHEN value <= 150 THEN value END AS clean FROM events""", "ratio clean")
def _(spark, d):
    """ST2"""
    out = jobs.features_stream(_stream(spark, d), {"ratio": scalar.safe_ratio(F.col("value"), (F.col("event_id") % 7).cast("double")), "clean": F.when(F.col("value") <= 150, F.col("value"))})
    return _run(out.select("event_id", "ratio", "clean"))


@query("stream_match", """p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT event_id AS lab_id, user_id, ts AS measured_at, value FROM events WHERE event_type = 'purchase')
FINAL SELECT event_id, lab_id, 'MATCHED' AS status FROM p JOIN r USING (user_id) WHERE measured_at BETWEEN ts AND ts + INTERVAL 12 HOUR""")
def _(spark, d):
    """ST3: matches; what expires comes out only once the watermark has passed it."""
    p = _stream(spark, d).where("event_type = 'signup'").select("event_id", "user_id", "ts")
    lab = _stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("lab_id"), "user_id", F.col("ts").alias("measured_at"))
    return _run(jobs.match_stream(p, lab, "user_id", "ts", "measured_at")).where("status = 'MATCHED'").select("event_id", "lab_id", "status")


@query("stream_dedup", """
FINAL SELECT count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT DISTINCT user_id FROM events)""")
def _(spark, d):
    """ST5: one feedback of each group."""
    out = _run(jobs.dedup_feedback(_stream(spark, d), "user_id", "ts", "40 days").select("user_id", "event_id"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("stream_drift", """m AS (SELECT avg(value) AS mean, stddev_samp(value) AS std FROM events), w AS (SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, count(*) AS n, avg(event_id % 48) AS mean_delay, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS fallback_share, avg(value) AS value FROM events GROUP BY 1)
FINAL SELECT window_start, n, mean_delay, fallback_share, value, (value - mean) / std AS shift FROM w, m""", "mean_delay fallback_share value shift")
def _(spark, d):
    """ST7"""
    profile = aggs.reference_profile(table(spark, d, "events"), ["value"])
    stream = _stream(spark, d)
    out = jobs.drift_stream(stream, "ts", ["value"], profile, F.col("event_id") % 48, F.col("event_type") == "error")
    out = _run(out, "complete")
    return out.select(F.col("window_start").cast("string").alias("window_start"), "n", "mean_delay", "fallback_share", "value", "shift")


@query("stream_reject", """
FINAL SELECT event_id, event_id % 50 > 24 AS late, CASE WHEN abs(value - 50) > 40 THEN 'REJECTED' ELSE 'VALIDATED' END AS status, CASE WHEN abs(value - 50) > 40 THEN 'outlier' END AS reject_reason FROM events""")
def _(spark, d):
    """ST8"""
    stream = _stream(spark, d).withColumns({"arrived": F.col("ts") + F.make_interval(hours=(F.col("event_id") % 50).cast("int")), "p": F.lit(50.0)})
    return _run(jobs.validate(jobs.reject_late(stream, "ts", "arrived"), "value", "p", 40.0).select("event_id", "late", "status", "reject_reason"))


@query("confidence_score", """
FINAL SELECT event_id, greatest(0, 0.25 * ((event_id % 11) / 10) + 0.2 * exp(-(event_id % 30) / 24) + 0.25 * exp(-(value / 20) / 3) + 0.15 * exp(-(event_id % 40) / 24) + 0.15 * (1 - least(1, (event_id % 3) / 2)) - 0.1 * (event_id % 2)) AS score FROM events""", "score")
def _(spark, d):
    """ST9"""
    k = F.col("event_id")
    value = jobs.confidence_score((k % 11) / 10, (k % 30).cast("double"), F.col("value") / 20, (k % 3) / 2, (k % 40).cast("double"), k % 2)
    return _run(_stream(spark, d).select("event_id", value.alias("score")))


@query("prediction_interval", f"""{B}, s AS (SELECT compound, stddev_pop(y - p) AS s FROM g WHERE order_id % 10 < 7 GROUP BY 1), a AS (SELECT stddev_pop(y - p) AS a FROM g WHERE order_id % 10 < 7)
FINAL SELECT order_id, batch_no, p - 1.96 * coalesce(s, a) AS low, p + 1.96 * coalesce(s, a) AS high FROM g LEFT JOIN s USING (compound), a WHERE order_id % 10 >= 7""", "low high")
def _(spark, d):
    """ST10"""
    rows = batches(spark, d).withColumn("r", F.col("y") - F.col("p"))
    return jobs.interval(rows.where("order_id % 10 >= 7"), rows.where("order_id % 10 < 7"), "compound", "r", "p").select(*KEYS, "low", "high")


# ---- models whose result SQL can follow --------------------------------------------------------------------------------------


@query("guidance", f"""{B}, u AS (SELECT 'price' AS feature, price AS value, y FROM g UNION ALL SELECT 'tax', tax, y FROM g UNION ALL SELECT 'p', p, y FROM g),
r AS (SELECT feature, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM u),
s AS (SELECT feature, corr(a, b) AS rho, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM r GROUP BY feature)
FINAL SELECT *, CASE WHEN rho > 0 THEN 'higher raises the label' WHEN rho < 0 THEN 'higher lowers the label' ELSE 'no direction' END AS direction FROM s ORDER BY abs(rho) DESC, feature LIMIT 2""", "rho p10 p50 p90")
def _(spark, d):
    """ML16"""
    return models.guidance(batches(spark, d), ["price", "tax", "p"], "y", 2)


@query("out_of_range", f"""{B}, f AS (SELECT order_id, batch_no, 'price' AS feature, price AS value FROM g UNION ALL SELECT order_id, batch_no, 'p', p FROM g), w AS (SELECT feature, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z FROM f WHERE order_id % 10 < 7 GROUP BY 1),
o AS (SELECT order_id, batch_no, feature, greatest(a - value, value - z) / nullif(z - a, 0) AS o FROM f JOIN w USING (feature))
FINAL SELECT g.order_id || '_' || g.batch_no AS row_id, count(o.feature) AS n_out, coalesce(string_agg(o.feature, ', ' ORDER BY o.o DESC, o.feature), '') AS out_features FROM g LEFT JOIN o ON g.order_id = o.order_id AND g.batch_no = o.batch_no AND o.o > 0 GROUP BY 1""")
def _(spark, d):
    """ML18"""
    rows = batches(spark, d).withColumn("row_id", F.concat_ws("_", *KEYS))
    return models.out_of_range(rows, aggs.reference_profile(rows.where("order_id % 10 < 7"), ["price", "p"]), "row_id", ["price", "p"])


@query("confidence_light", f"""{B}, m AS (SELECT avg(price) AS mp, avg(tax) AS mt, covar_pop(price, price) + 1e-6 AS a, covar_pop(price, tax) AS c, covar_pop(tax, tax) + 1e-6 AS b FROM g),
q AS (SELECT order_id, batch_no, sqrt((b * (price - mp) ** 2 - 2 * c * (price - mp) * (tax - mt) + a * (tax - mt) ** 2) / (a * b - c * c)) AS mahalanobis, discount * 10 AS dense, (batch_no % 4) / 3 AS spread FROM g, m),
v AS (SELECT order_id, batch_no, mahalanobis, 0.4 * exp(-0.3 * mahalanobis) + 0.3 * dense + 0.3 * (1 - least(1, spread)) AS confidence FROM q)
FINAL SELECT order_id, batch_no, mahalanobis, confidence, CASE WHEN confidence >= 0.7 THEN 'Green' WHEN confidence >= 0.4 THEN 'Yellow' ELSE 'Red' END AS light FROM v""", "mahalanobis confidence")
def _(spark, d):
    """ML19"""
    rows = batches(spark, d).withColumns({"dense": F.col("discount") * 10, "spread": (F.col("batch_no") % 4) / 3})
    return models.confidence(rows, rows, ["price", "tax"], "spread", "dense").select(*KEYS, "mahalanobis", "confidence", "light")


@query("local_prediction", f"""{B}, near AS (SELECT DISTINCT compound AS a, compound AS b, 1.0 AS w FROM g), f AS (SELECT compound, count(*) AS n, avg(tax) AS mx, avg(y) AS my, covar_pop(tax, y) * count(*) AS sxy, var_pop(tax) * count(*) AS sxx FROM g GROUP BY compound)
FINAL SELECT order_id, batch_no, my + sxy / (sxx + 1) * (tax - mx) AS local_prediction FROM g JOIN f USING (compound)""", "local_prediction")
def _(spark, d):
    """ML20: a compound's own rows; ridge with a penalty of 1 on the slope has a closed form."""
    rows = batches(spark, d).select(*KEYS, "compound", "tax", "y")
    own = rows.select("compound", F.col("compound").alias("near"), F.lit(0.0).alias("distance")).distinct()
    return models.local_prediction(rows, rows, "compound", own, ["tax"], "y").select(*KEYS, "local_prediction")


@query("similar_recipes", """h AS (SELECT p_partkey, p_type, CAST(p_size % 3 AS BIGINT) AS mixer, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part),
j AS (SELECT x.p_partkey, x.mixer, z.p_partkey AS other, (abs(x.a - z.a) / greatest(abs(x.a), 1) + abs(x.b - z.b) / greatest(abs(x.b), 1)) / 2 AS distance, CASE WHEN z.mixer <> x.mixer THEN 1 ELSE 0 END AS far FROM h x JOIN h z ON x.p_type = z.p_type AND x.p_partkey <> z.p_partkey AND abs(x.b - z.b) <= 100 AND floor(x.a / 10) = floor(z.a / 10)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, mixer ORDER BY far, distance, other) AS rn FROM j)
FINAL SELECT p_partkey, mixer, string_agg(CAST(other AS VARCHAR), ', ' ORDER BY distance, other) AS similar, avg(distance) AS mean_distance FROM r WHERE rn <= 5 GROUP BY 1, 2""", "mean_distance")
def _(spark, d):
    """ML21: within a type, a decade of sizes and a band of prices."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", (F.col("p_size") % 3).cast("long").alias("mixer"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")).withColumn("decade", F.floor(F.col("a") / 10))
    return models.similar_recipes(rows, rows, "p_partkey", ["p_type", "decade"], ["a", "b"], "mixer", 5, ("b", 100.0))


@query("score_package", f"""{B}
FINAL SELECT order_id, batch_no, 2 * price + 1 AS prediction, 2 * price + 1 + tax AS calibrated FROM g""", "prediction calibrated")
def _(spark, d):
    """ML24: a stored SQL transformer stands for the model package."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    path = scratch(spark, "package")
    PipelineModel([SQLTransformer(statement="SELECT *, 2 * price + 1 AS prediction FROM __THIS__")]).write().save(path)
    out = models.score(batches(spark, d), PipelineModel.load(path), F.col("tax"))
    return out.select(*KEYS, "prediction", "calibrated")


def _train(spark, d, *columns):
    """Rows of a model, written once: a fit reads them many times, and would join and number them each time."""
    rows = batches(spark, d).withColumn("fold", F.floor(splits.uniform(F.col("order_id"), seed=3) * 3).cast("long"))
    return cut(rows.select(*columns), "train")


# ---- models without a closed form ------------------------------------------------------------------------------------------


def _errors(df, p: str, name: str):
    return metrics.regression_metrics(df, "y", p).withColumn("model", F.lit(name))


@query("model_hybrid")
def _(spark, d):
    """ML6"""
    rows = _train(spark, d, "fold", "compound", "family", "price", "size", "tax", "discount", "y").withColumn("w", F.lit(1.0))
    model = models.HybridModel(["price", "size"], ["tax", "discount"], "y", "compound", "family", "family", "w").fit(rows.where("fold < 2"))
    return _errors(model.transform(rows.where("fold = 2")), "prediction", "hybrid")


@query("model_energy")
def _(spark, d):
    """ML9"""
    rows = _train(spark, d, "fold", "family", "price", "size", "y")
    model = models.EnergyModel(["price", "size"], "y", "family", low=0.0, high=60.0, kind="ridge").fit(rows.where("fold < 2"))
    return _errors(model.transform(rows.where("fold = 2"), "size"), "energy_pred", "energy")


@query("model_high_energy")
def _(spark, d):
    """ML10"""
    rows = _train(spark, d, "fold", "price", "size", "y").withColumns({"high": F.col("y") > 45, "r": F.col("y") - F.col("price") / 1500})
    model = models.HighEnergyModel(["price", "size"], "high", "r").fit(rows.where("fold < 2"))
    return metrics.detector_metrics(model.transform(rows.where("fold = 2")).withColumn("f", F.col("detected") == 1), "f", "high")


@query("model_compare_cv")
def _(spark, d):
    """ML13"""
    errors = models.compare_models_cv(_train(spark, d, "fold", "price", "size", "y"), ["price", "size"], "y", "fold")
    return spark.createDataFrame([(n, float(e)) for n, e in sorted(errors.items())], "model string, rmse double")


@query("model_stacked")
def _(spark, d):
    """ML14"""
    rows = _train(spark, d, "fold", "price", "size", "y")
    return _errors(models.stacked(rows.where("fold < 2"), rows.where("fold = 2"), ["price", "size"], "y", "fold"), "stack", "stacked")


@query("permutation_importance")
def _(spark, d):
    """ML15"""
    rows = _train(spark, d, *KEYS, "fold", "price", "size", "y").withColumn("row", F.concat_ws("_", *KEYS))
    model = models.fit_regression(rows.where("fold < 2"), ["price", "size"], "y", "prediction")
    return models.permutation_importance(model, rows.where("fold = 2"), ["price", "size"], "y", "prediction", "row")


@query("hard_em")
def _(spark, d):
    """ML22"""
    rows = _train(spark, d, "label_group", "batch_no", "price", "size", "y")
    rows = cut(rows.withColumn("y", F.avg("y").over(Window.partitionBy("label_group"))), "train")
    return models.hard_em(rows, "label_group", "batch_no", ["price", "size"], "y")


@query("group_ridge")
def _(spark, d):
    """ML23"""
    rows = _train(spark, d, "label_group", "price", "tax", "y").withColumns({"a": F.col("price") / 50_000 - 1, "b": F.col("tax") * 25 - 1})
    beta = models.group_ridge(rows, "label_group", ["a", "b"], "y", "minimax", steps=5)
    return spark.createDataFrame([(n, float(b)) for n, b in zip(("intercept", "a", "b"), beta, strict=True)], "term string, beta double")
