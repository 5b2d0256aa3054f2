"""Queries for the stage solver and the metrics of curves: a user's event values in order of time are one curve.

The speed is the value modulo 40, the torque half the value; even users have oil, with step times made from their number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves
from .queries import E
from .registry import query
from .views import events

# ---- the same steps in SQL ---------------------------------------------------------------------------------------------


def _first(condition: str, span: str) -> str:
    return f"list_min(list_filter({span}, lambda i: {condition}))"


def _step(t: int, start: str) -> str:
    return _first(f"v[i+2] - v[i+1] < -{t}", f"range({start} + 1, n - 1)")


def _plateau(start: str) -> str:
    return f"coalesce({_first('v[i+1] >= target - 20 AND (i + 5 >= n OR list_min(v[i+1:i+5]) >= target - 30)', f'range({start}, n)')}, least({start} + 10, n - 1))"


def _discharge(start: str) -> str:
    long = _first("v[i+1] - v[i+6] >= 10 AND v[i+1] - v[i+16] >= 15", f"range({start}, n - 15)")
    return f"CASE WHEN {start} >= n - 5 THEN n - 1 ELSE coalesce({long} + 2, {_step(10, start)}, {_step(5, start)}, greatest({start} + 1, n - 5)) END"


FIRST_DROP = f"CASE WHEN n < 10 THEN 30 WHEN coalesce({_first('v[i+2] - v[i+1] < -5', 'range(0, n - 1)')} + 1, 0) < 25 THEN 30 ELSE {_first('v[i+2] - v[i+1] < -5', 'range(0, n - 1)')} + 1 END"

CURVES = f"""{E},
c0 AS (SELECT user_id, list(value ORDER BY t, event_id) AS v, count(*) AS n, user_id % 2 = 0 AS oil, 70.0 AS target, CAST(35 + user_id % 25 AS BIGINT) AS os, CAST(45 + user_id % 30 AS BIGINT) AS oe FROM e GROUP BY user_id),
c1 AS (SELECT *, {FIRST_DROP} AS a1 FROM c0)"""

BOUNDS = f"""{CURVES},
c2 AS (SELECT *, CASE WHEN os < a1 + 10 OR os >= n - 40 THEN a1 + 45 ELSE os END AS s0 FROM c1),
c3 AS (SELECT *, CASE WHEN oe <= s0 OR oe >= n - 20 THEN s0 + 40 ELSE oe END AS e0 FROM c2),
c4 AS (SELECT *, least(s0, n - 15) AS s1, least(e0, n - 10) AS e1 FROM c3),
c5 AS (SELECT *, CASE WHEN NOT oil THEN a1 WHEN s1 <= a1 THEN a1 + 5 ELSE s1 END AS a2 FROM c4),
c6 AS (SELECT *, CASE WHEN NOT oil THEN a1 WHEN e1 <= a2 THEN a2 + 5 ELSE e1 END AS a3 FROM c5),
c7 AS (SELECT *, {_plateau("a3")} AS f4 FROM c6),
c8 AS (SELECT *, CASE WHEN f4 <= a3 THEN a3 + 5 ELSE f4 END AS a4 FROM c7),
c9 AS (SELECT *, {_discharge("a4")} AS f5 FROM c8),
d1 AS (SELECT *, CASE WHEN f5 <= a4 THEN a4 + 5 ELSE f5 END AS a5 FROM c9),
d2 AS (SELECT *, list_min(v[a5+1:least(a5 + 80, n)]) AS low, a5 + list_position(v[a5+1:least(a5 + 80, n)], list_min(v[a5+1:least(a5 + 80, n)])) - 1 AS low_at FROM d1),
d3 AS (SELECT *, CASE WHEN a5 >= n - 3 THEN n - 1 ELSE greatest(a5 + 1, least(coalesce({_first("v[i+1] >= low + 3", "range(low_at + 1, least(low_at + 100, n))")}, low_at), n - 1)) END AS f_bot FROM d2),
d4 AS (SELECT *, least(a5, n) AS b5 FROM d3), d5 AS (SELECT *, least(a4, b5 - 2) AS b4 FROM d4), d6 AS (SELECT *, CASE WHEN oil THEN least(a3, b4 - 2) END AS b3 FROM d5), d7 AS (SELECT *, least(a2, b3 - 2) AS b2 FROM d6),
d8 AS (SELECT *, greatest(CASE WHEN oil THEN least(a1, b2 - 2) ELSE least(a1, b4 - 2) END, 0) AS t1 FROM d7),
d9 AS (SELECT *, CASE WHEN oil THEN greatest(b2, t1) ELSE t1 END AS t2 FROM d8), e1 AS (SELECT *, CASE WHEN oil THEN greatest(b3, t2) ELSE t1 END AS t3 FROM d9),
e2 AS (SELECT *, greatest(b4, t3) AS t4 FROM e1), e3 AS (SELECT *, greatest(b5, t4) AS t5 FROM e2),
e4 AS (SELECT *, least(greatest(f_bot, t5), n) AS bs FROM e3),
e5 AS (SELECT *, coalesce(list_max(list_filter(range(bs, n), lambda i: v[i+1] >= 50)) + 1, n) AS p_end,
 list_min(list_transform(list_filter(range(bs, n - 1), lambda i: v[i+2] - v[i+1] < -5), lambda i: {{'d': v[i+2] - v[i+1], 'i': i}})) AS drop_ FROM e4),
e6 AS (SELECT *, CASE WHEN bs >= n - 5 THEN n ELSE least(CASE WHEN p_end > bs + 5 THEN p_end ELSE n END, CASE WHEN drop_.i + 1 > bs + 5 THEN drop_.i + 1 ELSE n END, n) END AS f_end FROM e5),
st AS (SELECT *, CASE WHEN f_end <= bs THEN n ELSE f_end END AS be, list_transform(v, lambda x: x % 40) AS speed, list_transform(v, lambda x: x / 2) AS torque FROM e6)"""


# ---- and in Spark ------------------------------------------------------------------------------------------------------



def oil():
    return F.col("user_id") % 2 == 0


def target():
    return F.lit(70.0)


def whole_curves(spark, d):
    rows = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "value"))).alias("r"))
    rows = rows.select("user_id", F.transform("r", lambda x: x["value"]).alias("v"))
    return rows.withColumns({"speed": F.transform("v", lambda x: x % 40), "torque": F.transform("v", lambda x: x / 2)})


def bounded(spark, d):
    return curves.stage_bounds(whole_curves(spark, d), "v", "v", "v", target(), oil(), 35 + F.col("user_id") % 25, 45 + F.col("user_id") % 30)


def spans():
    return {name: (a, b) for name, a, b in curves.stage_spans(oil())}


@query("align_channels", f"""{CURVES}, x AS (SELECT user_id, v[1:n - user_id % 4] AS a, v[1:n - user_id % 3] AS b, v[1:n - user_id % 7] AS z FROM c0), m AS (SELECT *, least(len(a), len(b)) AS k FROM x)
FINAL SELECT user_id, k AS n_a, k AS n_b, k AS n_z, CAST(least(k, len(z)) AS BIGINT) AS known_z, list_sum(z[1:k]) AS sum_z FROM m""", "sum_z")
def _(spark, d):
    """CV2"""
    cut = lambda k: F.slice("v", F.lit(1), F.size("v") - (F.col("user_id") % k).cast("int"))
    rows = whole_curves(spark, d).withColumns({"a": cut(4), "b": cut(3), "z": cut(7)})
    out = curves.align_channels(rows, ["a", "b"], ["z"])
    return out.select("user_id", *[F.size(c).alias(f"n_{c}") for c in "abz"], F.size(curves.known(F.col("z"))).alias("known_z"), curves.total(curves.known(F.col("z"))).alias("sum_z"))


@query("null_spikes", f"""{CURVES}
FINAL SELECT user_id, CAST(len(list_filter(v, lambda x: x <= 150)) AS BIGINT) AS n_known, coalesce(list_sum(list_filter(v, lambda x: x <= 150)), 0) AS total FROM c0""", "total")
def _(spark, d):
    """CV3"""
    v = curves.known(curves.null_spikes(F.col("v"), 150.0))
    return whole_curves(spark, d).select("user_id", F.size(v).alias("n_known"), curves.total(v).alias("total"))


@query("first_drop", f"""{CURVES}
FINAL SELECT user_id, a1 AS first_drop FROM c1""")
def _(spark, d):
    """CV8"""
    return whole_curves(spark, d).select("user_id", curves.first_drop(F.col("v")).alias("first_drop"))


@query("plateau_start", f"""{CURVES}
FINAL SELECT user_id, {_plateau("a1")} AS plateau FROM c1""")
def _(spark, d):
    """CV9"""
    return whole_curves(spark, d).select("user_id", curves.plateau_start(F.col("v"), target(), curves.first_drop(F.col("v"))).alias("plateau"))


@query("discharge_start", f"""{CURVES}, z AS (SELECT *, user_id % 60 AS z FROM c0)
FINAL SELECT user_id, {_discharge("z")} AS discharge FROM z""")
def _(spark, d):
    """CV10"""
    return whole_curves(spark, d).select("user_id", curves.discharge_start(F.col("v"), (F.col("user_id") % 60).cast("int")).alias("discharge"))


@query("stage_bounds", f"""{BOUNDS}
FINAL SELECT user_id, t1, t2, t3, t4, t5, bs AS bottom_start, be AS bottom_end FROM st""")
def _(spark, d):
    """CV11, CV12, CV13"""
    return bounded(spark, d).select("user_id", *[f"t{i}" for i in range(1, 6)], "bottom_start", "bottom_end")


STAGES_SQL = """st6 AS (SELECT user_id, n, v, speed, torque, unnest([{'k': 1, 'stage': 'loading', 's': 0, 'e': t1}, {'k': 2, 'stage': 'dry', 's': t1, 'e': CASE WHEN oil THEN t2 ELSE t4 END}, {'k': 3, 'stage': 'oil', 's': t2, 'e': t3},
 {'k': 4, 'stage': 'wet', 's': t3, 'e': CASE WHEN oil THEN t4 ELSE t3 END}, {'k': 5, 'stage': 'plateau', 's': t4, 'e': t5}, {'k': 6, 'stage': 'bottom', 's': bs, 'e': be}]) AS x FROM st)"""


@query("stages_long", f"""{BOUNDS}, {STAGES_SQL}
FINAL SELECT user_id, x.stage AS stage, x.s AS s, x.e AS e FROM st6""")
def _(spark, d):
    """CV14"""
    return curves.stages_long(bounded(spark, d), ["user_id"], oil())


@query("viscosity_metrics", f"""{BOUNDS}, k AS (SELECT user_id, t4, t5, list_transform(range(0, n), lambda i: CASE WHEN speed[i+1] > 0 THEN v[i+1] / (speed[i+1] * speed[i+1]) END) AS eta FROM st)
FINAL SELECT user_id, list_avg(eta) AS visc_mean, list_avg(eta[t4+1:t5]) AS visc_plateau, eta[t5+1] AS visc_discharge FROM k""", "visc_mean visc_plateau visc_discharge")
def _(spark, d):
    """CV18"""
    out = curves.viscosity_metrics(bounded(spark, d), "v", "speed", {"plateau": spans()["plateau"]}, F.col("t5"))
    return out.select("user_id", "visc_mean", "visc_plateau", "visc_discharge")


@query("time_shares", f"""{BOUNDS}
FINAL SELECT user_id, t1 / n AS share_loading, ((CASE WHEN oil THEN t2 ELSE t4 END) - t1) / n AS share_dry, (t3 - t2) / n AS share_oil, ((CASE WHEN oil THEN t4 ELSE t3 END) - t3) / n AS share_wet, (t5 - t4) / n AS share_plateau,
 (n - t5) / n AS share_discharge, n AS total_time, t5 AS reach_discharge FROM st""", "share_loading share_dry share_oil share_wet share_plateau share_discharge")
def _(spark, d):
    """CV19"""
    top = {name: span for name, span in spans().items() if name != "bottom"}
    out = curves.time_shares(bounded(spark, d), top, F.size("v"), F.col("t5"))
    return out.select("user_id", *[f"share_{name}" for name in [*top, "discharge"]], "total_time", "reach_discharge")


@query("ram_metrics", f"""{BOUNDS}
FINAL SELECT user_id, CAST(len(list_filter(range(0, n - 1), lambda i: v[i+2] - v[i+1] > 10)) AS BIGINT) AS ram_lifts, list_avg(v[t5+1:]) AS ram_stable, CASE WHEN n > 1 THEN list_sum(speed) - (speed[1] + speed[n]) / 2 ELSE 0 END AS shear_history FROM st""", "ram_stable shear_history")
def _(spark, d):
    """CV20"""
    return curves.ram_metrics(bounded(spark, d), "v", "speed", F.col("t5")).select("user_id", "ram_lifts", "ram_stable", "shear_history")


@query("rheology_metrics", f"""{BOUNDS}, {STAGES_SQL},
one AS (SELECT user_id, list_max(v[1:x.e]) AS power_max_1, list_max(torque[1:x.e]) AS torque_max_1 FROM st6 WHERE x.k = 1),
two AS (SELECT user_id, x.e > x.s + 3 AS long, v[x.s+1:x.e] AS p, list_filter(list_transform(range(x.s, x.e), lambda i: CASE WHEN speed[i+1] > 0 THEN torque[i+1] / speed[i+1] END), lambda z: z IS NOT NULL) AS eta FROM st6 WHERE x.k = 2),
fit AS (SELECT user_id, regr_slope(y, i) AS slope FROM (SELECT user_id, unnest(p) AS y, unnest(range(0, len(p))) AS i FROM two WHERE long) GROUP BY user_id)
FINAL SELECT user_id, power_max_1, torque_max_1, slope AS power_slope_2, CASE WHEN long THEN eta[len(eta)] END AS eta_last FROM one JOIN two USING (user_id) LEFT JOIN fit USING (user_id)""", "power_max_1 torque_max_1 power_slope_2 eta_last")
def _(spark, d):
    """CV21"""
    s = spans()
    out = curves.rheology_metrics(bounded(spark, d), "v", "torque", "speed", s["loading"], s["dry"])
    return out.select("user_id", "power_max_1", "torque_max_1", "power_slope_2", "eta_last")


@query("specific_energy", f"""{BOUNDS}, k AS (SELECT user_id, user_id % 5 AS solids, v[t4+1:t5] AS p, list_transform(v, lambda x: greatest(x - 100, 0)) AS hot, n FROM st)
FINAL SELECT user_id, CASE WHEN solids = 0 THEN 0 WHEN len(p) = 0 THEN 0 WHEN len(p) = 1 THEN p[1] / solids ELSE (list_sum(p) - (p[1] + p[len(p)]) / 2) / solids END AS plateau_specific_energy,
 CASE WHEN n > 1 THEN list_sum(hot) - (hot[1] + hot[n]) / 2 ELSE 0 END AS thermal_above FROM k""", "plateau_specific_energy thermal_above")
def _(spark, d):
    """CV22"""
    rows = bounded(spark, d).withColumns({"solids": (F.col("user_id") % 5).cast("double"), "plateau_integral": curves.trapezoid(curves.part(F.col("v"), *spans()["plateau"]))})
    return curves.specific_energy(rows, {"plateau": "plateau_integral"}, "solids", "v").select("user_id", "plateau_specific_energy", "thermal_above")


VALID = f"""{BOUNDS}, {STAGES_SQL},
q AS (SELECT user_id, x.k AS k, x.stage AS stage, x.e - x.s AS len, list_avg(w[x.s+1:x.e]) AS w, list_avg(speed[x.s+1:x.e]) AS sp, list_avg(torque[x.s+1:x.e]) AS tq, list_max(w[x.s+1:x.e]) AS top, list_stddev_pop(w[x.s+1:x.e]) AS sd
 FROM (SELECT *, list_transform(v, lambda z: 15 + z / 3) AS w FROM st6)),
r AS (SELECT user_id, 10 * k AS pos, stage || ': too short' AS reason FROM q WHERE len < 3 AND (k NOT IN (3, 4) OR user_id % 2 = 0) UNION ALL SELECT user_id, 10 * k + 1, stage || ': too long' FROM q WHERE len > 300
 UNION ALL SELECT user_id, 100, 'temperature out of range' FROM st WHERE 15 + list_min(v) / 3 < 15 OR 15 + list_max(v) / 3 > 250
 UNION ALL SELECT a.user_id, 110, 'no heating' FROM q a JOIN q b USING (user_id) WHERE a.k = 5 AND b.k = 1 AND a.w <= b.w + 10
 UNION ALL SELECT user_id, 120 + k, stage || ': speed too low' FROM q WHERE k BETWEEN 2 AND 5 AND sp < 10 AND (k NOT IN (3, 4) OR user_id % 2 = 0)
 UNION ALL SELECT user_id, 130 + k, stage || ': power or torque too low' FROM q WHERE k IN (2, 4, 5) AND (w < 10 OR tq < 10) AND (k <> 4 OR user_id % 2 = 0)
 UNION ALL SELECT user_id, 140 + 2 * k, stage || ': ram at zero' FROM q WHERE k < 6 AND top < 10 AND (k NOT IN (3, 4) OR user_id % 2 = 0)
 UNION ALL SELECT user_id, 141 + 2 * k, stage || ': ram flat' FROM q WHERE k < 6 AND sd < 0.01 AND w < 20 AND (k NOT IN (3, 4) OR user_id % 2 = 0)),
f AS (SELECT user_id, arg_min(reason, pos) AS reason FROM r GROUP BY user_id)"""


def _valid(spark, d):
    rows = bounded(spark, d).withColumn("w", F.transform("v", lambda z: 15 + z / 3))
    parts = [(name, a, b, oil() if name in ("oil", "wet") else F.lit(True)) for name, a, b in curves.stage_spans(oil())]
    return curves.curve_valid(rows, "w", "speed", "w", "torque", "w", parts)


@query("curve_valid", f"""{VALID}
FINAL SELECT user_id, reason, reason IS NULL AS valid FROM st LEFT JOIN f USING (user_id)""")
def _(spark, d):
    """CV23"""
    return _valid(spark, d).select("user_id", "reason", "valid")


@query("reason_counts", f"""{VALID}
FINAL SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM st LEFT JOIN f USING (user_id) GROUP BY 1""")
def _(spark, d):
    """CV24"""
    return curves.reason_counts(_valid(spark, d))


@query("sticky_batches", f"""{BOUNDS}
FINAL SELECT user_id FROM st WHERE n >= 35 AND len(list_filter(v[1:35], lambda x: x > 50)) > 0 AND n > 60 AND a5 >= n - 20""")
def _(spark, d):
    """CV25"""
    rows = bounded(spark, d)
    after = lambda c, by: F.when(c <= by, by + 5).otherwise(c)  # noqa: E731  the discharge before it is capped
    s = F.when((35 + F.col("user_id") % 25 < F.col("a1") + 10) | (35 + F.col("user_id") % 25 >= F.size("v") - 40), F.col("a1") + 45).otherwise(35 + F.col("user_id") % 25)
    rows = rows.withColumn("a1", curves.first_drop(F.col("v"))).withColumn("s0", s)
    e = F.when((45 + F.col("user_id") % 30 <= F.col("s0")) | (45 + F.col("user_id") % 30 >= F.size("v") - 20), F.col("s0") + 40).otherwise(45 + F.col("user_id") % 30)
    rows = rows.withColumn("e1", F.least(e, F.size("v") - 10)).withColumn("a2", after(F.least(F.col("s0"), F.size("v") - 15), F.col("a1")))
    rows = rows.withColumn("a3", F.when(oil(), after(F.col("e1"), F.col("a2"))).otherwise(F.col("a1")).cast("int"))
    rows = rows.withColumn("a4", after(curves.plateau_start(F.col("v"), target(), F.col("a3")), F.col("a3")))
    rows = rows.withColumn("a5", after(curves.discharge_start(F.col("v"), F.col("a4")), F.col("a4")))
    return curves.sticky_batches(rows, "v", F.col("a5"), 60, 20).select("user_id")


@query("curve_vector", f"""{BOUNDS}, {STAGES_SQL}, k AS (SELECT user_id, x.k AS k, unnest(range(0, 5)) AS i, v[x.s+1:x.e] AS a, speed[x.s+1:x.e] AS b FROM st6), p AS (SELECT *, i * (len(a) - 1) / 4.0 AS z FROM k),
w AS (SELECT *, CASE WHEN len(a) = 0 THEN 0 ELSE a[CAST(floor(z) AS INT) + 1] + (a[CAST(ceil(z) AS INT) + 1] - a[CAST(floor(z) AS INT) + 1]) * (z - floor(z)) END AS va,
 CASE WHEN k = 6 OR len(a) = 0 THEN 0 ELSE b[CAST(floor(z) AS INT) + 1] + (b[CAST(ceil(z) AS INT) + 1] - b[CAST(floor(z) AS INT) + 1]) * (z - floor(z)) END AS vb FROM p)
FINAL SELECT user_id, CAST(10 * (k - 1) + i AS BIGINT) AS at, va AS value FROM w UNION ALL SELECT user_id, CAST(10 * (k - 1) + 5 + i AS BIGINT), vb FROM w""", "value")
def _(spark, d):
    """CV28"""
    bounds = list(spans().values())
    vector = curves.curve_vector([F.col("v"), F.col("speed")], bounds, 5, {(5, 1)})
    return bounded(spark, d).select("user_id", F.posexplode(vector).alias("at", "value"))
