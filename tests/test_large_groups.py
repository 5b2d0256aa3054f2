"""The ways for groups too large for one task give what the plain ones give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rheospark.operators import aggs, joins, metrics, models, quantiles


@pytest.fixture
def values(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(40)), rng.gauss(0, 9)]), rng.gauss(5, 2)) for _ in range(900)]
    return spark.createDataFrame([*rows, ("none", None, None)], "k string, x double, z double")


def close(got, want):
    assert got.keys() == want.keys()
    for key in want:
        for a, b in zip(got[key], want[key], strict=True):
            assert (a is None) == (b is None)
            assert a is None or list(a) == pytest.approx(list(b), abs=1e-12) if isinstance(a, list) else a == b


@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_of_large_groups(values, keys):
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    of = lambda bound: {tuple(r[k] for k in keys): (r.x, r.z, r.n) for r in quantiles.percentiles(values, keys, {"x": "x", "z": F.col("z") * 2}, ps, [F.count("x").alias("n")], bound).collect()}
    close(of(10), of(10**6))


def test_operators_on_percentiles_of_large_groups(values, monkeypatch):
    both = []
    for bound in (10**6, 10):
        monkeypatch.setattr(quantiles, "BOUND", bound)
        both.append([
            {(r.k, r.level): (r.n, r.x_low, r.x_high, r.x_median, r.z_median) for r in aggs.safe_bounds(values, [["k"], []], ["x", "z"]).collect()},
            {r.k: tuple(r)[1:] for r in aggs.energy_benchmark(values, ["k"], "x").collect()},
            sorted(map(str, aggs.drop_mad_outliers(values, ["k"], "x").collect())),
            {r.feature: tuple(r)[1:] for r in aggs.reference_profile(values, ["x", "z"]).collect()},
        ])
    plain, large = both
    assert plain[0] == large[0] and plain[2] == large[2]
    for i in (1, 3):
        assert plain[i].keys() == large[i].keys()
        assert all(a == pytest.approx(b, abs=1e-9) or a == b for k in plain[i] for a, b in zip(plain[i][k], large[i][k], strict=True))


@pytest.mark.parametrize("strict", [True, False])
def test_pairs_of_long_orders_are_counted(spark, strict):
    rng = random.Random(6)
    rows = [(o, i, rng.choice([None, float(rng.randrange(12))]) if i % 9 == 0 else float(rng.randrange(12)), None if i % 13 == 0 else float(rng.randrange(20))) for o in (1, 2, 3) for i in range((5, 90, 300)[o - 1])]
    df = spark.createDataFrame(rows, "o int, i int, y double, p double")
    want = {}
    for o in (1, 2, 3):
        own = [(y, p) for oo, _, y, p in rows if oo == o and y is not None]
        n = k = 0
        for i, (y, p) in enumerate(own):
            for yy, pp in own[i + 1 :]:
                low, high = sorted(((y, p), (yy, pp)), key=lambda x: x[0])
                if high[0] > low[0] + 2 or not strict and high[0] == low[0] + 2:
                    n += 1
                    k += p is not None and pp is not None and high[1] > low[1]
        want[o] = (n, k)
    for short in (10**6, 20, 0):
        out = metrics.direction_by_order(df, "o", "i", "y", "p", 2.0, strict, short)
        assert {r.o: (r.n_pairs, r.n_alike) for r in out.collect()} == {o: x for o, x in want.items() if x[0]}, short


def test_interval_join_of_any_lengths(spark):
    rng = random.Random(7)
    points = [(rng.choice("ab"), rng.uniform(-50, 1000), i) for i in range(400)] + [("a", None, 400), ("a", 10.0, 401), ("c", 1.0, 402)]
    spans = []
    for i in range(120):
        s = rng.uniform(-60, 1000)
        spans.append((rng.choice("ab"), s, s + rng.choice([0.0, 1e-9, 0.3, 5.0, 17.0, 400.0, -1.0]), i))
    spans += [("a", 10.0, 10.0, 120), ("a", None, 3.0, 121)]
    p, w = spark.createDataFrame(points, "k string, t double, i int"), spark.createDataFrame(spans, "k string, s double, e double, j int")
    got = sorted((r.i, r.j) for r in joins.window_join(p, w, ["k"], "t", "s", "e").collect())
    want = sorted((i, j) for k, t, i in points for kk, s, e, j in spans if k == kk and t is not None and s is not None and s <= t <= e)
    assert got == want and len(want) > 1000


def test_neighbours_meet_few_cells(spark):
    """Clusters: exact neighbours from a small part of all cells, with a hot one and copies."""
    rng = np.random.default_rng(3)
    centres = rng.uniform(-1000, 1000, (12, 3))
    ref = np.concatenate([c + rng.normal(0, 1, (n, 3)) for c, n in zip(centres, [400] + [40] * 11, strict=True)] + [np.repeat(centres[:1], 9, axis=0)])
    own = np.concatenate([centres + rng.normal(0, 1, centres.shape) for _ in range(10)] + [rng.uniform(-2000, 2000, (5, 3))])
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = {tuple(r.v): r.near for r in models._nearest(frame(own), frame(ref), "v", 6, 100).collect()}
    assert len(got) == len(own)
    for v in own:
        assert got[tuple(v)] == pytest.approx(np.sort(np.linalg.norm(ref - v, axis=1))[:6])
    placed, asked = models.pivot_visits(frame(own), frame(ref).groupBy("v").agg(F.count("*").alias("n")), "v", 6)
    cells = placed.select("cell").distinct().count()
    assert asked.count() < 0.4 * cells * len(own)
