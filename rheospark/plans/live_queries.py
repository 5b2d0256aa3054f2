"""Queries of running jobs and stored packages: keyed calibration, the life of feedback, delays and drift of a stream,
database tables, a table function, fitted models that are saved and loaded. The docstrings name the survey's operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import curves
from ..operators import aggs, joins, metrics, models
from ..sources import io
from ..sources.io import cut, table
from ..streaming import jobs
from .curve_queries import BOUNDS, STAGES_SQL, bounded
from .gap_queries import KEYS, _run, _stream, scratch
from .queries import B
from .registry import query
from .views import batches


def _late_files(spark, rows, time: str, files: int = 6) -> str:
    """A folder of files, written one after the other, that hold rows by ranges of time, but each row up to 12 hours late: so
    keys are out of order across micro-batches."""
    folder = scratch(spark, "late")
    arrival = F.unix_timestamp(time) + F.pmod(F.xxhash64(*rows.columns), F.lit(43_200))
    late = rows.withColumn("_at", arrival)
    ends = late.agg(F.min("_at").alias("_a"), (F.max("_at") + 1).alias("_b"))
    number = F.floor((F.col("_at") - F.col("_a")) * files / (F.col("_b") - F.col("_a"))).cast("int")
    late = cut(late.join(F.broadcast(ends)).withColumn("_file", number).drop("_at", "_a", "_b"), "late-rows")
    for i in range(files):
        late.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("stream_calibrate", """RECURSIVE e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value / 20 - 5.0 END AS res, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
l AS (SELECT user_id, i, lag(res, 2) OVER w AS f, lag(res, 3) OVER w AS g FROM e WHERE res IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY i)),
j AS (SELECT e.*, f, CASE WHEN f IS NULL THEN NULL WHEN g IS NULL THEN 0.3 WHEN abs(f - g) >= 2 OR (f * g > 0 AND abs(f) >= 2.5 AND abs(g) >= 2.5) THEN 0.65 ELSE 0.2 END AS a FROM e LEFT JOIN l USING (user_id, i)),
s AS (SELECT user_id, i, event_id, ts, res, a, CAST(0.0 AS DOUBLE) AS before, CAST(CASE WHEN f IS NULL THEN 0.0 ELSE a * f END AS DOUBLE) AS state FROM j WHERE i = 1
 UNION ALL SELECT j.user_id, j.i, j.event_id, j.ts, j.res, j.a, s.state, CASE WHEN j.f IS NULL THEN s.state ELSE (1 - j.a) * s.state + j.a * j.f END FROM s JOIN j ON j.user_id = s.user_id AND j.i = s.i + 1)
FINAL SELECT user_id, event_id, greatest(-4.0, least(4.0, before)) AS correction, CAST(a AS DOUBLE) AS alpha, CASE WHEN res IS NULL THEN 'NO_LABEL' WHEN a IS NULL THEN 'WARM_UP' WHEN a = 0.65 THEN 'CHANGE_POINT' ELSE 'UPDATE' END AS event
 FROM s WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", "correction alpha")
def _(spark, d):
    """ST4: the events of each user as a running calibration, read from files that hold them out of order; rows come out once the
    watermark, a day behind, has passed them."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 20).alias("y"), F.lit(5.0).alias("p"))
    folder = _late_files(spark, rows, "ts")
    stream = jobs.read_stream(spark, folder, "event_id long, user_id long, ts timestamp, y double, p double")
    return _run(jobs.calibrate_stream(stream, "user_id", "ts", "event_id", "y", "p", late="1 day")).select("user_id", "event_id", "correction", "alpha", "event")


FEEDBACK_SQL = """p AS (SELECT event_id, user_id, ts, value / 4 AS p FROM events WHERE event_type = 'signup'), r AS (SELECT event_id AS lab_id, user_id, ts AS measured_at, value / 4 AS y FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM p), (SELECT max(measured_at) FROM r)) - INTERVAL 1 HOUR AS mark)"""


@query("stream_lifecycle", f"""{FEEDBACK_SQL}
FINAL SELECT event_id, lab_id, CASE WHEN lab_id IS NULL THEN 'EXPIRED' WHEN abs(y - p) > 10 THEN 'REJECTED' ELSE 'VALIDATED' END AS status, CASE WHEN abs(y - p) > 10 THEN 'outlier' END AS reject_reason
 FROM p LEFT JOIN r ON r.user_id = p.user_id AND measured_at BETWEEN ts AND ts + INTERVAL 12 HOUR, w WHERE lab_id IS NOT NULL OR ts + INTERVAL 12 HOUR < mark""")
def _(spark, d):
    """ST3: what becomes of each prediction; those that may still get a result are pending and don't come out."""
    p = _stream(spark, d).where("event_type = 'signup'").select("event_id", "user_id", "ts", (F.col("value") / 4).alias("p"))
    lab = _stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("lab_id"), "user_id", F.col("ts").alias("measured_at"), (F.col("value") / 4).alias("y"))
    return _run(jobs.feedback_stream(p, lab, "user_id", "ts", "measured_at", "y", "p")).select("event_id", "lab_id", "status", "reject_reason")


@query("stream_first_feedback", """w AS (SELECT date_trunc('day', ts) AS day, user_id, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY 1, 2)
FINAL SELECT CAST(day AS VARCHAR) AS window_start, user_id, event_id, n FROM w WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(spark, d):
    """ST5: which feedback of a user and day is kept: the earliest, from files out of order."""
    folder = _late_files(spark, table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "ts")
    stream = jobs.read_stream(spark, folder, "event_id long, user_id long, ts timestamp")
    return _run(jobs.first_feedback(stream, "user_id", "ts", "event_id", late="1 day")).select(F.col("window_start").cast("string").alias("window_start"), "user_id", "event_id", "n")


EDGES, SHARES = [20.0, 50.0, 120.0], [0.25, 0.25, 0.25, 0.25]
_BINS = ["value <= 20", "value > 20 AND value <= 50", "value > 50 AND value <= 120", "value > 120"]
_PSI = " + ".join(f"(b{i} - {s}) * ln(b{i} / {s})" for i, s in enumerate(SHARES))


@query("stream_delays", f"""w AS (SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, count(*) AS n, {", ".join(f"quantile_disc((event_id * 7919) % 1000 / 10, {p}) AS delay_p{round(100 * p)}" for p in (0.5, 0.9, 0.99))},
 {", ".join(f"greatest(count(CASE WHEN {b} THEN 1 END) / CAST(count(*) AS DOUBLE), 1e-4) AS b{i}" for i, b in enumerate(_BINS))} FROM events GROUP BY 1)
FINAL SELECT window_start, n, delay_p50, delay_p90, delay_p99, {_PSI} AS psi FROM w""", "delay_p50 delay_p90 delay_p99 psi")
def _(spark, d):
    """ST7: exact percentiles of the lab delay from the stream's counts, and the drift of the values' bins."""
    stream = _stream(spark, d).withColumn("delay", (F.col("event_id") * 7919) % 1000 / 10)
    out = jobs.delay_report(_run(jobs.delay_stream(stream, "ts", "delay", "value", EDGES), "complete"), SHARES)
    return out.withColumn("window_start", F.col("window_start").cast("string"))


def _database(spark, rows, name: str, types: str) -> dict[str, str]:
    """rows as a table of an embedded database, that of Spark's own metastore; its options for a reader."""
    options = {"url": f"jdbc:derby:memory:plant{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": name}
    rows.coalesce(1).write.format("jdbc").options(**options, createTableColumnTypes=types).mode("overwrite").save()
    return options


@query("read_database", """
FINAL SELECT o_orderkey, o_custkey, o_totalprice FROM orders""", "o_totalprice")
def _(spark, d):
    """IO1: a database table read over four connections, each a range of its key."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    low, high = rows.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    options = _database(spark, rows, "plant_orders", "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE")
    return io.read_table(spark, {**options, "column": "o_orderkey", "lower": low, "upper": high + 1, "partitions": 4})


@query("read_database_query", """
FINAL SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey""", "top")
def _(spark, d):
    """IO2: a query that the database runs itself."""
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    options = _database(spark, rows, "lab_orders", "o_custkey BIGINT, o_totalprice DOUBLE")
    own = 'SELECT "o_custkey", count(*) AS "n", max("o_totalprice") AS "top" FROM lab_orders WHERE "o_totalprice" > 1000 GROUP BY "o_custkey"'
    return io.read_lab(spark, {k: v for k, v in options.items() if k != "dbtable"} | {"query": own})


@query("stage_table", f"""{BOUNDS}, {STAGES_SQL}
FINAL SELECT user_id, x.stage AS stage, x.s AS s, x.e AS e FROM st6""")
def _(spark, d):
    """UD4: the stages of each curve by a table function in SQL."""
    curves.register_tables(spark)
    view = f"bounds_{uuid.uuid4().hex}"
    bounded(spark, d).withColumn("has_oil", F.col("user_id") % 2 == 0).createOrReplaceTempView(view)
    return spark.sql(f"SELECT user_id, x.stage, x.s, x.e FROM {view}, LATERAL stage_table(t1, t2, t3, t4, t5, bottom_start, bottom_end, has_oil) AS x")


@query("unseen_rows", """
FINAL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 10 < 2)""")
def _(spark, d):
    """JN14: lines of parts that the first orders don't have."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return joins.unseen(line, line.where("l_orderkey % 10 < 2").select("l_partkey"), ["l_partkey"])


OLS = f"""{B}, f AS (SELECT regr_slope(y, price) AS k, regr_intercept(y, price) AS c FROM g WHERE order_id % 10 < 7)"""


@query("score_fitted", f"""{OLS}
FINAL SELECT order_id, batch_no, c + k * price AS prediction, c + k * price + tax AS calibrated FROM g, f""", "prediction calibrated")
def _(spark, d):
    """ML24: a package fitted on the training orders, stored, loaded again and used on all; least squares has a closed form."""
    from pyspark.ml import PipelineModel

    rows = cut(batches(spark, d).select(*KEYS, "price", "tax", "y"), "batches")
    fitted = models.fit_regression(rows.where("order_id % 10 < 7"), ["price"], "y", "prediction", reg=0.0)
    path = scratch(spark, "package")
    fitted.model.write().save(path)
    return models.score(rows, PipelineModel.load(path), F.col("tax")).select(*KEYS, "prediction", "calibrated")


@query("stream_score_fitted", """f AS (SELECT regr_slope(value, event_id % 24) AS k, regr_intercept(value, event_id % 24) AS c FROM events WHERE event_id % 5 < 3)
FINAL SELECT event_id, c + k * (event_id % 24) AS prediction FROM events, f""", "prediction")
def _(spark, d):
    """ST1: micro-batches scored by a stored model."""
    from pyspark.ml import PipelineModel

    hour = (F.col("event_id") % 24).cast("double").alias("x")
    fitted = models.fit_regression(table(spark, d, "events").where("event_id % 5 < 3").select(hour, "value"), ["x"], "value", "prediction", reg=0.0)
    path = scratch(spark, "package")
    fitted.model.write().save(path)
    package, folder = PipelineModel.load(path), scratch(spark, "scores")
    q = jobs.score_stream(_stream(spark, d), lambda b: models.score(b.select("event_id", hour), package).select("event_id", "prediction"), f"{folder}/out", f"{folder}/state")
    q.awaitTermination()
    return spark.read.schema("event_id long, prediction double").parquet(f"{folder}/out").drop("batch")


@query("local_neighbours", f"""{B}, m AS (SELECT compound, avg(price) / 10000 AS c, avg(size) / 10 AS s FROM g GROUP BY compound),
d AS (SELECT a.compound, b.compound AS near, sqrt((a.c - b.c) ** 2 + (a.s - b.s) ** 2) AS distance FROM m a JOIN m b ON true),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY compound ORDER BY distance, near) AS rn FROM d) WHERE rn <= 3),
w AS (SELECT n.compound, exp(-1.5 * n.distance) AS w, g.tax AS x, g.y FROM n JOIN g ON g.compound = n.near),
t AS (SELECT compound, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS b0, sum(w * x * y) AS b1 FROM w GROUP BY compound),
k AS (SELECT compound, (b1 - s1 * b0 / s0) / (s2 + 1 - s1 * s1 / s0) AS slope, b0, s0, s1 FROM t)
FINAL SELECT order_id, batch_no, (b0 - slope * s1) / s0 + slope * tax AS local_prediction FROM g JOIN k USING (compound)""", "local_prediction")
def _(spark, d):
    """ML20: a ridge on the rows of a compound's three nearest compounds, weighted by exp(-1.5 distance); with one feature it has a
    closed form. Compounds are few: their means are compared with each other."""
    rows = cut(batches(spark, d).select(*KEYS, "compound", "price", "size", "tax", "y"), "batches")
    means = rows.groupBy("compound").agg((F.avg("price") / 10000).alias("c"), (F.avg("size") / 10).alias("s"))
    return models.local_prediction(rows, rows, "compound", models.nearest_groups(means, "compound", ["c", "s"], 3), ["tax"], "y").select(*KEYS, "local_prediction")


@query("centroids_whole", """c AS (SELECT label, i, avg(embedding[i]) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
q AS (SELECT vec_id, c.label AS centroid, sqrt(sum((e.x - c.m) ** 2)) AS distance FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings) e JOIN c USING (i) GROUP BY vec_id, c.label)
FINAL SELECT vec_id, CAST(arg_min(centroid, (distance, centroid)) AS BIGINT) AS centroid, min(distance) AS distance FROM q GROUP BY vec_id""", "distance")
def _(spark, d):
    """JN23: in all dimensions, and with centroids that go along in several blocks."""
    rows = table(spark, d, "embeddings")
    n = rows.select(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(n)]
    rows = rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(names)])
    means = rows.groupBy("label").agg(*[F.avg(x).alias(x) for x in names])
    return joins.nearest_centroid(rows, means, names, "label", most=4).select("vec_id", "centroid", "distance")


BUCKETS = {"maturity": "CAST(size % 4 AS VARCHAR)", "route": "flag", "family": "family", "mixer": "CAST(mixer AS VARCHAR)", "energy": "CAST(CAST(floor(price / 20000) AS BIGINT) AS VARCHAR)", "recipe": "compound"}


@query("bucket_directions", f"""{B}, x AS (SELECT order_id, batch_no, y, p, unnest([{", ".join(f"{{'t': '{t}', 'v': {v}}}" for t, v in BUCKETS.items())}]) AS b FROM g),
d AS (SELECT a.b.t AS bucket_type, a.b.v AS bucket_value, a.order_id, count(*) AS n_pairs, count(CASE WHEN sign(c.y - a.y) = sign(c.p - a.p) THEN 1 END) AS n_alike
  FROM x a JOIN x c ON a.order_id = c.order_id AND a.b.t = c.b.t AND a.b.v = c.b.v AND a.batch_no < c.batch_no WHERE abs(c.y - a.y) > 0.3 GROUP BY 1, 2, 3)
FINAL SELECT bucket_type, bucket_value, count(*) AS n_orders, CAST(sum(n_pairs) AS BIGINT) AS n_pairs, avg(n_alike / CAST(n_pairs AS DOUBLE)) AS direction FROM d GROUP BY 1, 2""", "direction")
def _(spark, d):
    """AG37: direction accuracy in each bucket of the residual report's six bucketings."""
    of = {"maturity": (F.col("size") % 4).cast("string"), "route": F.col("flag"), "family": F.col("family"), "mixer": F.col("mixer").cast("string"), "energy": F.floor(F.col("price") / 20000).cast("string"), "recipe": F.col("compound")}
    rows = batches(spark, d).select(*KEYS, "y", "p", *[v.alias(f"b_{t}") for t, v in of.items()])
    return metrics.bucket_directions(rows, {t: f"b_{t}" for t in of}, "order_id", "batch_no", "y", "p")


@query("clean_numbers", """
FINAL SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS clean, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice ELSE (SELECT median(o_totalprice) FILTER (WHERE o_orderkey % 11 <> 0) FROM orders) END AS filled FROM orders""", "clean filled")
def _(spark, d):
    """ML1: values that aren't numbers become missing, missing ones the median."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("clean"))
    clean = models.doubles(rows, ["clean"])
    middle = aggs.percentiles(clean, [], {"_m": "clean"}, [0.5])
    return clean.join(F.broadcast(middle)).select("o_orderkey", "clean", F.coalesce("clean", F.col("_m")[0]).alias("filled"))
