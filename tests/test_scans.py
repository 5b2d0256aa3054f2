import numpy as np
import pytest
from pyspark.sql import functions as F

from rheospark.operators import calibrate, joins, scans
from rheospark.streaming import jobs


def some(n, hot, seed=1):
    rng = np.random.default_rng(seed)
    keys = ["hot"] * hot + [["a", "b", None, "d", "e"][int(i)] for i in rng.integers(0, 5, n - hot)]
    return [(k, int(i), float(rng.uniform()) if i % 5 else (1.0 if i % 10 else 0.0), float(rng.normal())) for i, k in enumerate(keys)]


@pytest.mark.parametrize(("hot", "parts"), [(600, 9), (0, 3), (50, 1)])
def test_affine_scan_as_a_loop(spark, hot, parts):
    rows = some(700, hot)
    df = spark.createDataFrame(rows, "k string, i long, m double, c double")
    still = F.col("i") % 7 == 0
    out = scans.affine_scan(df, ["k"], ["i"], {"s": (F.when(still, 1.0).otherwise(F.col("m")), F.when(still, 0.0).otherwise(F.col("c")), 2.0), "slow": (F.lit(0.999), F.col("c"), -1.0)}, parts)
    want, state = {}, {}
    for k, i, m, c in rows:
        s, t = state.get(k, (2.0, -1.0))
        want[i] = (s, t)
        state[k] = (s if i % 7 == 0 else m * s + c, 0.999 * t + c)
    got = {r.i: (r.s, r.slow) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_long_decay_stays_in_range(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 997 == 5, 1e-300).otherwise(0.35).alias("m"), (F.col("id") % 11).cast("double").alias("c"))
    got = {r.i: r.s for r in scans.affine_scan(df, ["k"], ["i"], {"s": (F.col("m"), F.col("c"), 0.0)}, 3).collect()}
    s = 0.0
    for i in range(20000):
        assert got[i] == pytest.approx(s, abs=1e-8), i
        s = (1e-300 if i % 997 == 5 else 0.35) * s + i % 11


@pytest.mark.parametrize(("n", "parts"), [(1, 9), (4, 9), (4, 1)])
def test_running_top_and_last(spark, n, parts):
    rng = np.random.default_rng(4)
    rows = [(k, i, None if rng.uniform() < 0.4 else int(rng.integers(0, 30))) for k, i, _, _ in some(400, 300)]
    df = spark.createDataFrame(rows, "k string, i long, x int")
    top = {r.i: r.top for r in scans.running_top(df, ["k"], ["i"], "x", n, "top", parts).collect()}
    last = {r.i: r["last"] for r in scans.running_last(df, ["k"], ["i"], "x", "last", parts).collect()}
    seen, end = {}, {}
    for k, i, x in rows:
        assert top[i] == sorted(seen.get(k, []), reverse=True)[:n]
        if x is not None:
            seen.setdefault(k, []).append(x)
            end[k] = x
        assert last[i] == end.get(k)


def test_a_key_with_all_rows_is_many_tasks(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(0.8).alias("m"), F.lit(1.0).alias("c"))
    rows = scans.ranged(df, ["k"], ["i"], 8)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2500
    assert scans.spanning(rows).count() == 8
    plan = scans.affine_scan(df, ["k"], ["i"], {"s": (F.col("m"), F.col("c"), 0.0)})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("parts", [1, 11])
def test_calibrations_of_a_hot_key_equal_a_loop(spark, parts):
    rng = np.random.default_rng(8)
    rows = [("hot" if rng.uniform() < 0.8 else None, i, None if rng.uniform() < 0.3 else float(rng.normal(2, 3)), 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, y double, p double")
    ewma = {r.i: r.correction for r in calibrate.ewma_calibrate(df, ["k"], ["i"], "y", "p", parts=parts).collect()}
    kalman = {r.i: (r.kalman, r.ewma) for r in calibrate.kalman_calibrate(df, ["k"], ["i"], "y", "p", parts=parts).collect()}
    clip = lambda x, most: max(-most, min(most, x))
    past, states = {}, {}
    for k, i, y, p in rows:
        s, b, v, e = states.get(k, (0.0, 0.0, 1.0, 0.0))
        assert ewma[i] == pytest.approx(clip(s, 4), abs=1e-9)
        assert kalman[i] == pytest.approx((clip(b, 6), clip(e, 6)), abs=1e-9)
        if y is not None:
            seen = past.setdefault(k, [])
            seen.append(y - p)
            if len(seen) >= 3:
                a = jobs.alpha(seen[-3], seen[-4] if len(seen) > 3 else None)
                s = (1 - a) * s + a * seen[-3]
            gain = (v + 0.01) / (v + 1.01)
            states[k] = (s, b + gain * (y - p - b), (1 - gain) * (v + 0.01), 0.8 * e + 0.2 * (y - p))


def test_asof_of_a_hot_key(spark):
    rng = np.random.default_rng(9)
    points = [("hot" if i % 3 else None, float(i % 400), i) for i in range(900)]
    times = [("hot" if i % 4 else None, float(rng.uniform(-5, 420)), i) for i in range(300)]
    out = joins.asof_value(spark.createDataFrame(points, "k string, t double, v int"), spark.createDataFrame(times, "k string, at double, i int"), ["k"], "t", "at", ["v"])
    for r in out.collect():
        seen = [(t, v) for k, t, v in points if k == r.k and t <= r["at"]]
        assert r.asof_v == (max(seen)[1] if seen else None)
    assert out.count() == 300


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i long, x int")
    assert scans.running_top(df, ["k"], ["i"], "x", 2, "top").collect() == []
    assert scans.running_last(df, ["k"], ["i"], "x", "last").collect() == []
    assert scans.affine_scan(df, ["k"], ["i"], {"s": (F.lit(1), F.lit(0), 0.0)}).collect() == []
