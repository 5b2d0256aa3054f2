"""Faults that a review found: small frames on which the code before failed or differed from its SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rheospark.functions import curves
from rheospark.operators import aggs, metrics, models, recommend, splits
from rheospark.streaming import jobs


def test_effective_weights_balance_by_the_median(spark):
    df = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 1.0), ("a", "3", 1.0), ("a", "4", 1.0), ("b", "5", 1.0)], "c string, g string, w double")
    got = {r.c: (r.balance, r.loss_weight) for r in splits.effective_weights(df, "c", "g", "w").collect()}
    # balances 1/2 and 1, their median 3/4
    assert got["a"][0] == pytest.approx(2 / 3) and got["b"][0] == pytest.approx(4 / 3)
    assert 4 * got["a"][1] + got["b"][1] == pytest.approx(5.0)


def test_time_holdout_takes_the_last_recipes_by_median(spark):
    rows = [(r, f"2024-01-{d:02d}") for r in range(10) for d in (r + 1, r + 11)]
    df = spark.createDataFrame(rows, "r long, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.r: r.split for r in splits.time_holdout(df, "r", "t", 0.2).collect()}
    assert got == {r: "oot" if r >= 8 else "train" for r in range(10)}


def test_delay_percentiles_are_exact_beyond_a_sketch(spark):
    rows = spark.range(200_000).select(F.timestamp_seconds(F.col("id") % 86_400).alias("ts"), (F.col("id") * 7919 % 100_003 / 10).alias("delay"), F.lit(1.0).alias("v"))
    got = jobs.delay_report(jobs.delay_stream(rows, "ts", "delay", "v", [0.5]), [0.5, 0.5]).first()
    values = sorted(i * 7919 % 100_003 / 10 for i in range(200_000))
    assert (got.n, got.delay_p50, got.delay_p90, got.delay_p99) == (200_000, values[99_999], values[179_999], values[197_999])


def test_trend_validity_rounds_as_sql_does(spark):
    # 1.015 * 100 is below 101.5, so both are 1.01; the shortest decimal would be a tie and give 1.02
    df = spark.createDataFrame([("o", 1.0, 1.015), ("o", 2.0, 1.01), ("o", 3.0, 1.012)], "o string, y double, p double")
    got = metrics.trend_validity(df, "o", "y", "p").first()
    assert duckdb.sql("SELECT round_even(CAST(1.015 AS DOUBLE), 2)").fetchall() == [(1.01,)]
    assert (got.unique_p, got.failure) == (1, "constant_prediction")


def test_quality_check_at_the_edge_of_spec(spark):
    # predictions whose interval ends just at the lower limit
    edge = "SELECT s, 20 + (round(q * s * 39.2, 2)::DOUBLE / q) / 200 AS p FROM range(1, 51) t(s), range(1, 51) u(q)"
    rows = duckdb.sql(f"SELECT s, p, coalesce(p - 1.96 * s / 10 >= 20 AND p + 1.96 * s / 10 <= 60, false) FROM ({edge})").fetchall()
    df = spark.createDataFrame(rows, "s long, p double, want boolean").withColumns({"lo": F.lit(20.0), "hi": F.lit(60.0), "far": F.lit(0.0)})
    got = recommend.quality_check(df, "p", "s", "lo", "hi", "far", unit=10.0)
    assert got.where("in_spec != want").count() == 0
    doubles = recommend.quality_check(df.withColumn("sigma", F.col("s") / 10), "p", "sigma", "lo", "hi", "far")
    assert doubles.where("in_spec != want").count() > 0


def test_model_rows_are_joined_once(spark):
    from rheospark.plans import gap_queries, more_queries

    for train in (gap_queries._train, more_queries._train):
        plan = train(spark, "/root/testdata/sf0.001", "fold", "price", "size", "y")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan


def test_isolation_forest_scores_do_not_depend_on_blocks(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("g"), F.col("id") % 2).alias("g"), (F.col("id") * 37 % 101 / 7).alias("a"), (F.col("id") * 53 % 89 / 3).alias("b"))
    df = df.unionByName(spark.createDataFrame([(5000, None, 1.0, 2.0), (5001, "few", 1.0, None)], df.schema))
    one, many = (sorted((r.id, r.anomaly_score, r.is_outlier) for r in models.isolation_forest(df, df, ["a", "b"], "g", "id", trees=5, block=n).collect()) for n in (100_000, 70))
    assert one == many and len(one) == 2002
    assert [s for i, s, _ in one if i >= 5000] == [None, None] and all(s is not None for i, s, _ in one if i < 5000)


def test_spearman_reads_its_rows_once(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 2.0, 5.0), ("a", None, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), (None, 1.0, 2.0)], "k string, x double, y double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = df.mapInPandas(count, df.schema)
    got = {r.k: r.rho for r in aggs.grouped_spearman(rows, ["k"], "x", "y").collect()}
    # ranks of a: x 1, 2.5, 2.5 and y 2, 1, 4
    assert got["a"] == pytest.approx(0.5 / 7**0.5) and got["b"] is None and set(got) <= {"a", "b", None}
    assert seen.value == 7
    seen.add(-7)
    audit = aggs.feature_audit(rows, ["x"], "y", "k").first()
    assert (audit.missing_rate, audit.dominant_rate, audit.n_distinct) == (pytest.approx(1 / 7), 4 / 6, 2) and seen.value == 7


def test_prune_correlated_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") * F.col("id")).cast("double").alias("b"), (F.col("id") * 37 % 101).cast("double").alias("c"))

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    assert aggs.prune_correlated(df.mapInPandas(count, df.schema), ["a", "b", "c"]) == ["a", "c"] and seen.value == 100


def test_similar_recipes_compares_points_not_copies(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([0, 1, 2]), float(rng.randrange(4)), rng.choice([900.0, 930.5, 1000.0, 1104.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "r long, t string, m long, a double, b double")
    want = {}
    for r, t, m, a, b in rows:
        of = [(int(m2 != m), (abs(a - a2) / max(abs(a), 1) + abs(b - b2) / max(abs(b), 1)) / 2, r2) for r2, t2, m2, a2, b2 in rows if r2 != r and t2 == t and abs(b - b2) <= 100]
        best = sorted(of)[:5]
        want[r] = ", ".join(str(o) for _, o in sorted((d, o) for _, d, o in best))
    out = models.similar_recipes(df, df, "r", ["t"], ["a", "b"], "m", 5, ("b", 100.0))
    assert {r.r: r.similar for r in out.collect()} == want
    # twenty copies of each recipe make no more pairs
    copies = df.crossJoin(spark.range(20).withColumnRenamed("id", "i")).withColumn("r", F.col("r") + 400 * F.col("i")).drop("i")
    assert models.similar_recipes(copies, copies, "r", ["t"], ["a", "b"], "m", 5, ("b", 100.0)).count() == 8000


def test_sticky_batches_writes_its_discharge_once(spark):
    df = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(70)), lambda i: 60.0 + i * 0).alias("v"))
    rows = df.withColumn("s0", F.size("v") - 1 - F.col("id").cast("int") * 20)
    for i in range(1, 9):
        rows = rows.withColumn(f"s{i}", F.when(F.col(f"s{i - 1}") <= 3, F.col(f"s{i - 1}") + 5).otherwise(F.col(f"s{i - 1}")))
    out = curves.sticky_batches(rows, "v", F.col("s8"), 60, 20).select("id")
    assert [r.id for r in out.collect()] == [0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 10


def test_compound_clusters_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(120).select(F.concat(F.lit("c"), F.col("id") % 6).alias("c"), (F.col("id") % 6 * 10 + F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    out, _ = models.cluster_compounds(df.mapInPandas(count, df.schema), "c", ["a", "b"], 2)
    assert sorted(r.n for r in out.collect()) == [20] * 6 and seen.value == 120


@pytest.mark.parametrize("early", [True, False])
def test_visible_values_by_key_in_small_batches_and_in_ranges(spark, early):
    from rheospark.operators.folds import visible_values

    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(1, 40)]), rng.choice([None, *range(1, 60)]), i, rng.choice([None, float(i)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s long, v long, i long, y double").withColumns({c: F.timestamp_seconds(c) for c in "sv"})
    seen_at = F.when(F.col("s").isNotNull() & F.col("v").isNotNull(), F.greatest("s", "v"))
    order, more = [F.col("s"), F.col("i")], {"early": F.col("v") < F.col("s")} if early else {}
    known = F.col("y").isNotNull()
    run = lambda history, bound: {r.i: r["values"] for r in visible_values(df, history, ["k"], F.col("s"), seen_at, order, F.col("y"), 3, bound=bound, **more).collect()}
    want = {}
    for k, s, v, i, _ in rows:
        past = [(ss, ii, yy) for kk, ss, vv, ii, yy in rows if kk == k and None not in (k, s, ss, vv, yy) and (max(ss, vv) < s or early and vv < ss == s and ii < i)]
        want[i] = [y for *_, y in sorted(past, reverse=True)[:3]]
    assert sum(map(len, want.values())) > 200
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for history in (known, df.where(known)):
            assert run(history, 10**6) == want
            assert run(history, 10) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rolling_visible_deals_rows_out_once(spark):
    from rheospark.operators import windows

    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.timestamp_seconds("id").alias("s"), F.timestamp_seconds(F.col("id") + 5).alias("v"), "id", F.col("id").cast("double").alias("y"))
    out = windows.rolling_visible(df, ["k"], [F.col("s"), F.col("id")], "s", "v", "y")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Join" not in plan


def test_workoff_tasks_follow_the_rows(spark, monkeypatch):
    from rheospark.operators import folds

    df = spark.range(600).select((F.col("id") % 90).alias("o"), (F.col("id") % 7).alias("m"), F.col("id").cast("double").alias("y"))
    run = lambda: aggs.workoff_ratio(df, "o", "m", "y", F.col("m") == 3)
    want = sorted(run().collect())
    monkeypatch.setattr(folds, "TASK_ROWS", 20)
    out = run()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(o" in plan and ", 30)" in plan
    assert sorted(out.collect()) == want and len(want) == 90


@pytest.mark.parametrize("bound", [10**6, 10])
def test_scan_tasks_follow_the_rows(spark, monkeypatch, bound):
    from rheospark.operators import calibrate, scans

    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, None if rng.random() < 0.3 else rng.gauss(2, 3), 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, y double, p double")
    both = lambda parts: [{r.i: tuple(r)[4:] for r in f(df, ["k"], ["i"], "y", "p", parts=parts).collect()} for f in (calibrate.ewma_calibrate, calibrate.kalman_calibrate)]
    want = both(3)  # in ranges
    monkeypatch.setattr(scans, "BOUND", bound)
    monkeypatch.setattr(scans, "TASK_ROWS", 20)
    for got, known in zip(both(None), want, strict=True):
        assert got.keys() == known.keys() and all(got[i] == pytest.approx(known[i], abs=1e-9) for i in known)
    plan = calibrate.kalman_calibrate(df, ["k"], ["i"], "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert ", 30)" in plan and (bound == 10 or plan.count("Exchange") == 1 and "Join" not in plan)


def test_super_groups_tasks_follow_the_pairs(spark, monkeypatch):
    from rheospark.operators import folds

    rng = random.Random(2)
    rows = [(f"o{i}", f"p{rng.randrange(90)}") for i in range(60)] + [("o1", None), (None, "p3"), (None, None), ("o900", None), (None, "p900")]
    df = spark.createDataFrame(rows, "a string, b string")
    plain = sorted(map(str, splits.super_groups(df, "a", "b").collect()))
    monkeypatch.setattr(folds, "TASK_ROWS", 3)
    out = splits.super_groups(df, "a", "b")
    assert sorted(map(str, out.collect())) == plain and len(plain) == len(rows)
    assert ", 20)" in out._jdf.queryExecution().executedPlan().toString()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        if a and b:
            root[find(b)] = find(a)
    least = {}
    for a, b in rows:
        if a and b:
            least[find(a)] = min(least.get(find(a), a), a)
    for r in out.collect():
        own = find(r.a or r.b) if r.a or r.b else None
        assert r.super_group == least.get(own, r.a or r.b)


def test_a_vector_goes_along_once_for_a_bin_of_cells(spark):
    import numpy as np

    rng = np.random.default_rng(5)  # no structure: a vector visits most cells
    ref, own = rng.normal(size=(400, 24)), rng.normal(size=(60, 24))
    frame = lambda x: spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    counted = frame(ref).groupBy("v").agg(F.count("*").alias("n"))
    placed, asked = models.pivot_visits(frame(own), counted, "v", 3, 100)
    assert placed.count() == 400 and asked.count() <= 60 * 5
    assert asked.agg(F.sum(F.size("cells"))).first()[0] > 60 * 10
    got = {tuple(r.v): r.near for r in models._nearest(frame(own), frame(ref), "v", 3, 100).collect()}
    assert len(got) == 60
    for v in own:
        assert got[tuple(v)] == pytest.approx(np.sort(np.linalg.norm(ref - v, axis=1))[:3])


def test_ranks_of_a_compound_report_read_no_sketch(spark):
    # a sketch that is read twice differs from itself between machines, and ranks between its edges were wrong then (F11)
    df = spark.range(400).select((F.col("id") % 2).alias("c"), (F.col("id") % 80).alias("o"), "id", (F.col("id") * 37 % 101 * 1.0).alias("y"), (F.col("id") * 53 % 97 * 1.0).alias("p"))
    ranks, report = aggs.value_ranks(df, ["c"], "y", "r"), metrics.compound_report(df, "c", "o", "id", "y", "p")
    for out in (ranks, report):
        assert "approx" not in out._jdf.queryExecution().toString().lower()
    rows = [tuple(r) for r in df.select("c", "y", "p").collect()]
    want = duckdb.connect().execute(f"SELECT c, y, rank() OVER (PARTITION BY c ORDER BY y) + (count(*) OVER (PARTITION BY c, y) - 1) / 2.0 FROM (VALUES {', '.join(map(str, rows))}) t(c, y, p)").fetchall()
    assert {tuple(r) for r in ranks.collect()} == set(want)


def test_models_are_compared_in_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    # each task of some hundred jobs sends a result to the driver (F17)
    tasks, rows_seen = [], []

    class Fake:
        avgMetrics = [1.0]

        def __init__(self, **_):
            pass

        def fit(self, rows):
            tasks.append(rows.rdd.getNumPartitions())
            rows_seen.append(rows.count())
            return self

    monkeypatch.setattr(models, "CrossValidator", Fake)
    df = spark.range(600).repartition(64).select((F.col("id") % 3).alias("fold"), (F.col("id") * 1.0).alias("a"), (F.col("id") % 7 * 1.0).alias("y"))
    assert models.compare_models_cv(df, ["a"], "y", "fold") == {"linear": 1.0, "forest": 1.0, "boosted": 1.0}
    assert max(tasks) <= spark.sparkContext.defaultParallelism and rows_seen == [600] * 3


def test_trees_of_cells_are_those_of_rows(spark):
    """pyspark.ml's own trees over rows of few distinct values, with weights, and over the cells of such rows (F3, F8, F9)."""
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(3 * (a > 4) - 2 * (b > 2) * (a > 1) + rng.normal()), float(rng.integers(1, 3))) for a, b in rng.integers(0, 9, (600, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double, w double").coalesce(2)
    plain = models.gbt("x", "y", "p", "w", trees=6).fit(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df))
    want = {(r.a, r.b): r.p for r in plain.transform(VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)).collect()}
    fitted = models.fit_regression(df, ["a", "b"], "y", "p", "gbt", "w", trees=6)
    out = fitted.transform(df)
    assert out.columns == ["a", "b", "y", "w", "p"]
    assert max(abs(r.p - want[r.a, r.b]) for r in out.collect()) < 1e-9


def test_cut_points(spark):
    df = spark.createDataFrame([("x", float(i % 3), float(i)) for i in range(101)] + [("y", 7.0, None)], "k string, a double, b double")
    got = {(r.k, r.column): r.cuts for r in models.cut_points(df, ["a", "b"], "k", 4).collect()}
    assert got == {("x", "a"): [0.5, 1.5], ("x", "b"): [25.0, 50.0, 75.0], ("y", "a"): []}


def test_hybrid_has_an_expert_of_trees_per_route(spark, monkeypatch):
    """The experts of all routes are pyspark.ml's own of each (F12), ridge for few rows; a compound in several clusters doesn't
    multiply rows (F3)."""
    rng = np.random.default_rng(6)
    rows = [(f"r{i % 3}" if i < 300 else "few", float(a), float(b), float((i % 3) * (a > 4) - (b > 2) * (a > 1) + rng.normal())) for i, (a, b) in enumerate(rng.integers(0, 9, (320, 2)))]
    df = spark.createDataFrame(rows, "r string, a double, b double, y double").repartition(4)
    out = models.RouteExperts("r", ["a", "b"], "y").fit(df).transform(df.unionByName(spark.createDataFrame([("new", 1.0, 1.0, 0.0), (None, 1.0, 1.0, 0.0)], df.schema)), "p")
    got = {(r.r, r.a, r.b): r.p for r in out.collect()}
    assert out.count() == 322 and got["new", 1.0, 1.0] == got[None, 1.0, 1.0] == 0.0
    for route, kind in (("r0", "gbt"), ("r1", "gbt"), ("few", "ridge")):
        own = df.where(F.col("r") == route)
        assert 1e-9 > max(abs(r.q - got[route, r.a, r.b]) for r in models.fit_regression(own, ["a", "b"], "y", "q", kind).transform(own).collect())
    monkeypatch.setattr(models, "CELLS", 50)  # a route of many cells is fitted by Spark
    large = models.RouteExperts("r", ["a", "b"], "y").fit(df.where("r = 'r0'")).transform(df.where("r = 'r0'"), "p")
    assert all(abs(r.p - got["r0", r.a, r.b]) < 1e-9 for r in large.collect())
    both = df.withColumns({"compound": F.lit("c"), "w": F.lit(1.0)})
    model = models.HybridModel(["a"], ["b"], "y", "compound", "r", "r", "w").fit(both)
    assert model.experts.forests.count() == 3 and model.transform(both).count() == 320


def test_model_hybrid_fits_trees_for_its_routes(spark, monkeypatch):
    import __spark_entry__

    seen = []
    monkeypatch.setattr(models.RouteExperts, "fit", lambda self, train: seen.append(self.min_rows) or (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        __spark_entry__.queries()["model_hybrid"](spark, "/root/testdata/sf0.001")
    assert seen == [30]


def test_given_folds_are_filters_and_boosted_trees_see_cells(spark, monkeypatch):
    """No row of a fold goes to Python, and a hundred passes read cells, not rows (F6)."""
    df = spark.range(900).select((F.col("id") % 3).alias("fold"), (F.col("id") % 5 * 1.0).alias("a"), (F.col("id") % 5 * 2.0 + F.col("id") % 7).alias("y"))
    for train, test in models.CrossValidator(numFolds=3, foldCol="fold")._kFold(df):
        assert (train.count(), test.count()) == (600, 300)
        assert "Python" not in train._jdf.queryExecution().toString() + test._jdf.queryExecution().toString()
    seen, own = [], models.GBTRegressor._fit
    monkeypatch.setattr(models.GBTRegressor, "_fit", lambda self, rows: seen.append(rows.count()) or own(self, rows))
    out = models.compare_models_cv(df, ["a"], "y", "fold")
    assert seen == [5] * 4 and out["boosted"] < 2.1 and set(out) == {"linear", "forest", "boosted"}


def test_high_energy_trees_see_cells(spark, monkeypatch):
    """The detector's and the corrector's trees see a row for each cell (and class), with their weights; limits are exact (F9)."""
    df = spark.range(1000).select((F.col("id") % 5 * 1.0).alias("a"), (F.col("id") % 10 > 7).alias("high"), (F.col("id") * 1.0).alias("r"))
    seen = []
    for kind in (models.GBTClassifier, models.GBTRegressor):
        monkeypatch.setattr(kind, "_fit", lambda self, rows, own=kind._fit: seen.append((rows.count(), round(sum(r._weight for r in rows.collect())))) or own(self, rows))
    model = models.HighEnergyModel(["a"], "high", "r").fit(df)
    assert seen == [(7, 1000), (2, 200)]
    assert np.allclose(model.limits, np.percentile([i for i in range(1000) if i % 10 > 7], [5, 95]))
    assert model.transform(df).count() == 1000


def test_hard_em_refits_until_no_choice_changes(spark, monkeypatch):
    """The query leaves the number of rounds to the method, ten at most (F11)."""
    import inspect

    import __spark_entry__

    seen = []
    monkeypatch.setattr(models, "hard_em", lambda *a, **k: seen.append(inspect.signature(own).bind(*a, **k)) or a[0].limit(0)) if (own := models.hard_em) else None
    __spark_entry__.queries()["hard_em"](spark, "/root/testdata/sf0.001")
    seen[0].apply_defaults()
    assert seen[0].arguments["rounds"] == 10


def test_bucket_directions_deal_rows_out_by_order_once(spark):
    """Rows aren't shuffled for each kind of bucket (F10); long and short orders, null buckets, orders and labels as by plain pairs."""
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice([1.0, 1.2, 2.0, 5.0, None]), rng.choice([1.0, 2.0, 3.0, None]), rng.choice("abc"), rng.choice([1, 2, None])) for i in range(90)]
    df = spark.createDataFrame(rows, "o long, q long, y double, p double, s string, t long")
    want = {}
    for kind, at in (("s", 4), ("t", 5)):
        for a in rows:
            for b in rows:
                if a[0] == b[0] and a[1] < b[1] and a[at] == b[at] is not None and a[2] and b[2] and (a[2] > b[2] + 0.3 or b[2] > a[2] + 0.3):
                    one = want.setdefault((kind, str(a[at])), {}).setdefault(a[0], [0, 0])
                    one[0] += 1
                    one[1] += bool(a[3] and b[3]) and np.sign(b[2] - a[2]) == np.sign(b[3] - a[3])
    want = {k: (len(v), sum(n for n, _ in v.values()), round(sum(x / n for n, x in v.values()) / len(v), 9)) for k, v in want.items()}
    for short in (1000, 20, 1):
        out = metrics.bucket_directions(df, {"s": "s", "t": "t"}, "o", "q", "y", "p", short=short)
        assert {(r.bucket_type, r.bucket_value): (r.n_orders, r.n_pairs, round(r.direction, 9)) for r in out.collect()} == want
    plan = metrics.bucket_directions(df, {"s": "s", "t": "t"}, "o", "q", "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("Generate") < plan.index("Window")


def test_waiting_rows_of_a_batch_are_one_value_of_the_state():
    """A key's rows of a micro-batch go to the state store as one value, not one each (F7)."""
    import pandas as pd

    from unittest.mock import MagicMock

    made = jobs._Calibrator(["k_", "t_", "s_", "correction", "alpha", "event"], 3, 4.0, 10**15)
    made.init(MagicMock())
    kept, made.waiting.appendList = [], None
    made.waiting.appendValue = kept.append
    made.waiting.get, made.waiting.exists, made.carry.exists = (lambda: iter(kept)), (lambda: bool(kept)), (lambda: False)
    for t in ([5000, 1000, 3000], [2000, 9000]):
        list(made.handleInputRows(("a",), iter([pd.DataFrame({"t_": t, "s_": [1.0] * len(t), "y_": [None, *[6.0] * (len(t) - 1)], "p_": [5.0] * len(t)})]), None))
    assert len(kept) == 2
    now = MagicMock()
    now.getCurrentWatermarkInMs.return_value = 5
    out = pd.concat(made.handleExpiredTimer(("a",), now, None))
    assert out["t_"].tolist() == [1000, 2000, 3000, 5000]
    assert out["event"].tolist() == ["WARM_UP", "NO_LABEL", "WARM_UP", "NO_LABEL"]
    assert np.frombuffer(made.waiting.put.call_args[0][0][0][0], jobs._WAITING)["t"].tolist() == [9000]
