"""Operators without SQL, and edge frames: nulls, ties, empty inputs, zero denominators, minimum group sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rheospark.functions import curves as c
from rheospark.functions import scalar as s
from rheospark.operators import aggs, calibrate, features, joins, metrics, models, recommend, splits, windows
from rheospark.sources import io


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    lit = F.lit
    assert one(spark, s.number(lit("x")).alias("a"), s.number(lit("1.5")).alias("b"), s.number(lit(float("nan"))).alias("c"), s.number(lit(None), 2).alias("d")) == (None, 1.5, None, 2.0)
    assert one(spark, s.safe_ratio(lit(1.0), lit(0.0)), s.clip(lit(None).cast("double"), 1.0, 2.0), s.clip(lit(9.0), 1.0, 2.0), s.half_even(lit(2.5))) == (None, None, 2.0, 2)
    names = ["CE100", "CE19A", "CN1", "CS100X", "CS2", "CA5511", "CB", "CTP3", "zz", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(s.material_class(F.col("n")).alias("k")).collect()
    assert [r.k for r in rows] == ["elastomer", "other", "natural_rubber", "silica", "oil", "silane", "carbon_black", "ctp", "other", "other"]
    assert tuple(one(spark, s.clean_code(lit("M1-A-B")), s.compound_family(lit("M1-- x")), s.compound_family(lit(" ")), s.family_by_pattern(lit("xxM1-T12345yy")), s.clean_compound(lit("A---b")), s.base_compound(lit("R1-1234567890123456")))) == ("M1-A", "M1", "Unknown", "M1-T12345", "A", "M1-12345678901")
    assert tuple(one(spark, s.norm_order_id(lit("2024~77")), s.norm_order_id(lit("77")), s.batch_key(lit("o_1"), lit(7)), *s.parse_batch_key(lit("o_1_0007")))) == ("77", "77", "o_1_0007", "o_1", 7)
    assert [one(spark, s.sample_to_batch_120(lit(n), lit(99), lit(99)))[0] for n in (1, 2, 3, 6, 12)] == [1, 1, 2, 4, 9]
    assert one(spark, s.rewrite_lot(lit("1234567")), s.rewrite_lot(lit("123")), s.maturity(lit(30), lit(True), lit(False)), s.lever_category(lit("Rotor_x"))) == ("9000567", "123", "L3", "rotor_speed")
    assert one(spark, s.top_factors({"a": lit(1.0), "b": lit(3.0), "c": lit(None).cast("double")}, 2).alias("t")).t == ["b", "a"]
    assert one(spark, s.reason_code(lit(-0.5), lit(0.0)), s.reason_code(lit(0.0), lit(0.35)), s.material_system(lit("x"), lit(1.0), lit(2.0)), s.phase_route(lit(0.0), lit(None).cast("double"))) == ("OVER_SILANISED", "DISPERSION", "CarbonBlack", "dry")


def test_frames_of_scalars(spark):
    df = spark.createDataFrame([("o1", 1.0, 2.0, None, "A"), ("o2", 0.0, 0.0, 5.0, None)], "k string, a double, b double, c double, m string")
    assert [r.p for r in s.add_products(df, {"p": ["a", "b"]}).collect()] == [2.0, 0.0]
    assert [r.g for r in s.gate(df, "k", "o1", {"g": "b"}).collect()] == [2.0, 0.0]
    ratios = s.recipe_ratios(df, ["a"], "a", ["b"], "c").collect()
    assert ratios[0].oil_filler == 0.0 and ratios[1].filler_polymer == 0.0 and ratios[0].filler_polymer == 2.0
    hot = s.one_hot(df, "m", ["A", "B"]).collect()
    assert [(r.m_A, r.m_B, r.m_missing) for r in hot] == [(1, 0, 0), (0, 0, 1)]
    assert s.project(df, ["k"], ["b"], ["c"]).columns == ["k", "b", "c"]
    with pytest.raises(ValueError):
        s.project_policy(df, {"a": {"x"}}, "x", ["k"])
    assert s.apply_aliases(df, {"a": "b", "m": "n"}).columns == ["k", "b", "c", "n"]
    diff = s.context_diff(df, [("a", "b")], [("k", "m")]).collect()
    assert [(r.diff_a, r.diff_k) for r in diff] == [(1.0, 1), (0.0, 1)]
    assert s.valid_stage_order(df, ["a"], ["a", "b"]).count() == 2 and s.valid_stage_order(df, [], ["b", "a"]).count() == 1


def arr(v):
    return F.array(*[F.lit(x).cast("double") for x in v]) if len(v) else F.array().cast("array<double>")


def test_curve_edges(spark):
    get = lambda col: one(spark, col.alias("x")).x
    assert get(c.decode_hex(F.lit("000A00zz0014F"))) == [10.0, 20.0, 15.0] and get(c.decode_hex(F.lit("000Azzzz"), strict=True)) == [] and get(c.decode_hex(F.lit(None).cast("string"))) == []
    assert get(c.resample(arr([]), 3)) == [0.0, 0.0, 0.0] and get(c.resample(arr([1, 3]), 3)) == [1.0, 2.0, 3.0]
    assert get(c.trapezoid(arr([4]))) == 4.0 and get(c.trapezoid(arr([4]), 0.0)) == 0.0 and get(c.trapezoid(arr([]))) == 0.0 and get(c.trapezoid(arr([1, None, 3]))) == 2.0
    assert get(c.mean(arr([]))) is None and get(c.std_pop(arr([1, 3]))) == 1.0
    assert get(c.first_drop(arr([5] * 9))) == 30 and get(c.first_drop(arr([5] * 40 + [-5] + [0] * 5))) == 40
    assert get(c.slope(arr([1, 2, 3]))) is None and get(c.slope(arr([1, 2, 3, 4]))) == pytest.approx(1.0)
    rising = [100.0] * 20 + [140.0] * 40
    assert get(c.plateau_start(arr(rising), F.lit(150.0), F.lit(5))) == 20
    assert get(c.discharge_start(arr([150.0] * 40 + [138.0 - i for i in range(20)]), F.lit(30))) in (37, 38, 39, 40, 41)
    want = math.exp(-75000 / 8.314 * (1 / (140 + 273.15) - 1 / 423.15))
    assert get(c.arrhenius_dose(arr([140, 100, 250]))) == pytest.approx(want)
    spans = [("loading", F.lit(0), F.lit(3), F.lit(True)), ("plateau", F.lit(3), F.lit(6), F.lit(True))]
    reason = lambda temp, ram=(20,): get(c.invalid_reason(arr(temp), arr([20] * 6), arr([20] * 6), arr([20] * 6), arr(list(ram) * 6), spans))
    assert reason([20, 21, 22, 120, 130, 140]) is None
    assert reason([20, 21, 22, 20, 21, 22]) == "no heating" and reason([20] * 5 + [300]) == "temperature out of range"
    assert reason([20, 21, 22, 120, 130, 140], (5,)) == "loading: ram at zero" and reason([20, 21, 22, 120, 130, 140], (15,)) == "loading: ram flat"


def test_stage_bounds_are_ordered(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in (10, 40, 120, 200, 320):
        temp = np.concatenate([np.linspace(80, 150, max(1, n - 20)), np.linspace(150, 90, min(20, n))])[:n]
        rows.append((n, temp.tolist(), rng.normal(50, 20, n).tolist(), rng.normal(100, 40, n).tolist()))
    df = spark.createDataFrame(rows, "n long, temp array<double>, ram array<double>, power array<double>")
    for oil in (True, False):
        for start, end in ((None, None), (F.lit(90), F.lit(150.0))):
            bounds = c.stage_bounds(df, "temp", "ram", "power", F.lit(145.0), F.lit(oil), start, end)
            for r in bounds.collect():
                b = [0, r.t1, r.t2, r.t3, r.t4, r.t5, r.bottom_start, r.bottom_end]
                assert b == sorted(b) and b[-1] <= r.n
                assert oil or r.t1 == r.t2 == r.t3
                if r.n == 320 and oil and start is not None:
                    assert (r.t2, r.t3) == (90, 150)
            stages = c.stages_long(bounds, ["n"], F.lit(oil))
            assert stages.count() == 30


def test_dropouts_and_interpolation(spark):
    v = [50, 1, 1, 1, 50, 1, 1, 1, 1, 50, None]
    df = spark.createDataFrame([("k", i, None if x is None else float(x)) for i, x in enumerate(v)], "k string, t long, v double")
    out = [r.v for r in c.null_short_dropouts(df, ["k"], "t", "v", 5.0).orderBy("t").collect()]
    assert out == [50, None, None, None, 50, 1, 1, 1, 1, 50, None]
    filled = [r.v for r in c.interpolate(spark.createDataFrame([("k", 0, None), ("k", 1, 2.0), ("k", 2, None), ("k", 3, 6.0), ("k", 4, None), ("z", 0, None)], "k string, t long, v double"), ["k"], "t", "v").orderBy("k", "t").collect()]
    assert filled == [2.0, 2.0, 4.0, 6.0, 6.0, 0.0]


def test_empty_and_single_rows(spark):
    schema = "o string, seq long, y double, p double, w double"
    empty = spark.createDataFrame([], schema)
    single = spark.createDataFrame([("a", 1, 2.0, 3.0, 1.0)], schema)
    assert metrics.regression_metrics(empty, "y", "p").first().n == 0
    r = metrics.regression_metrics(single, "y", "p").first()
    assert (r.n, r.mae, r.r2) == (1, 1.0, None)
    for f in (metrics.direction_accuracy, metrics.step_direction):
        assert f(single, "o", "seq", "y", "p").first()[0] == 0
    assert aggs.drop_mad_outliers(empty, ["o"], "y").count() == 0 and aggs.safe_bounds(empty, [["o"]], ["y"]).count() == 0
    assert metrics.risk_alert(spark.createDataFrame([(None, None, None, None)], "r2 double, mae double, rmse double, outlier_pct double")).first().level == "NO_LAB_DATA"
    assert windows.rolling_offset(single, ["o"], [F.col("seq")], "y").first()["offset"] == 0.0


def test_zero_weights_and_minimum_sizes(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 2.0, 1.0), ("b", None, 1.0)], "k string, v double, w double")
    assert {r.k: r.weighted_mean for r in aggs.weighted_mean(df, ["k"], "v", "w").collect()} == {"a": None, "b": 2.0}
    twenty = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", float(i)) for i in range(19)], "k string, v double")
    assert [r.k for r in aggs.safe_bounds(twenty, [["k"]], ["v"]).collect()] == ["a"]
    ties = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "v double")
    assert sorted(r.bucket for r in aggs.qcut(ties, "v", 4).collect()) == [1, 1, 1, 2]
    assert [r.r for r in ties.select(windows.avg_rank(F.col("v"), []).alias("r")).orderBy("r").collect()] == [2.0, 2.0, 2.0, 4.0]
    assert aggs.mode(spark.createDataFrame([("a", "y"), ("a", "x")], "k string, v string"), ["k"], "v").first().v == "x"


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"o{i // 3}", f"p{i % 3}", None, float(i)) for i in range(60)], "o string, p string, s string, y double")
    rows = splits.label_groups(df, "o", "p", "s")
    sums = rows.groupBy("label_group").agg(F.sum("label_weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in sums)
    groups = rows.select("label_group", F.lit("s").alias("stratum")).distinct()
    split = splits.stratified_group_split(groups, "label_group", "stratum")
    assert split.groupBy("label_group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    joined = splits.super_groups(spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3"), ("d", "2"), (None, "3")], "x string, y string"), "x", "y")
    assert {(r.x, r.super_group) for r in joined.collect()} == {("a", "a"), ("b", "a"), ("d", "a"), ("c", "c"), (None, "c")}
    folds = splits.balanced_group_kfold(rows, "o", 5).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {12}


def test_calibrations(spark):
    rows = [("k", i, None if i == 3 else float(i % 3), 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, i long, y double, p double")

    def kalman(res, q=0.01, r=1.0):
        b, v, out = 0.0, 1.0, []
        for x in res:
            out.append(max(-6, min(6, b)))
            if x is not None:
                v += q
                g = v / (v + r)
                b, v = b + g * (x - b), (1 - g) * v
        return out

    got = [r.kalman for r in calibrate.kalman_calibrate(df, ["k"], ["i"], "y", "p").orderBy("i").collect()]
    assert got == pytest.approx(kalman([r[2] for r in rows]))
    assert calibrate.adaptive_kalman(df, ["k"], ["i"], "y", "p").orderBy("i").first().bias == 0.0
    out, state = calibrate.order_offset(df, ["k"], [F.col("i")], "y", "p")
    assert [r["offset"] for r in out.orderBy("i").collect()][:5] == [0.0, 0.0, 1.0, 2.0, 2.0] and state.first().carried == 2.0
    again, _ = calibrate.order_offset(df, ["k"], [F.col("i")], "y", "p", state)
    assert again.orderBy("i").first()["offset"] == 2.0
    assert one(spark, calibrate.alpha_policy(F.lit("fast")), calibrate.alpha_policy(F.lit("rejected"))) == (0.4, 0.0)


def test_features(spark):
    df = spark.createDataFrame([(150.0, 60.0, 2.0, 0.0, 5.0), (None, 60.0, 2.0, -1.0, 5.0)], "t double, d double, s double, p double, q double")
    rows = features.silica_pid(df, "t", "d", "s", "p", "q").collect()
    assert rows[0].pid_linear == 300.0 and rows[0].pid_work == 60.0 and rows[0].pid_valid and not rows[1].pid_valid
    e = spark.createDataFrame([(36000.0, 0.0, 100.0, 120.0, 0.5), (36000.0, 36000.0, None, None, 0.0)], "a double, b double, m0 double, m1 double, w double")
    out = features.energy_labels(e, "a", "b", "m0", "m1", "w").collect()
    assert [(r.total_kwh, r.energy_source, r.kwh_per_ton, r.energy_status) for r in out] == [(20.0, "METER", 40.0, "VALID"), (20.0, "INTEGRAL", None, "VALID")]
    cb = spark.createDataFrame([(float(i), float(i % 3), 1.0, 100.0, 60.0, 50.0, 40.0, 120.0) for i in range(6)], "l double, s double, a double, p double, d double, pe double, sp double, t double")
    assert features.cb_v21(cb, "l", "s", "a", "p", "d", "pe", "sp", "t").where("cb_completion is null").count() == 0


def test_joins(spark):
    points = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("b", 1, 7.0)], "k string, t long, v double")
    times = spark.createDataFrame([("a", 0), ("a", 1), ("a", 9), ("c", 3)], "k string, at long")
    got = {(r.k, r["at"]): r.asof_v for r in joins.asof_value(points, times, ["k"], "t", "at", ["v"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 10.0, ("a", 9): 50.0, ("c", 3): None}
    spans = spark.createDataFrame([("a", 1, 5), ("b", 2, 1)], "k string, s long, e long")
    out = joins.window_agg(points, spans, ["k"], [], "t", "s", "e", [F.sum("v").alias("v")]).collect()
    assert [(r.k, r.v) for r in out] == [("a", 60.0)]
    assert joins.unseen(spark.createDataFrame([(None,), ("a",)], "k string"), spark.createDataFrame([("a",), (None,)], "k string"), ["k"]).collect() == [(None,)]


def test_recommendation(spark):
    df = spark.createDataFrame([("b1",), ("b2",)], "k string")
    c1 = recommend.generate_candidates(df, ["k"], {"speed": (F.lit(50.0), F.lit(40.0), F.lit(60.0), F.lit(True)), "ram": (F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(False))})
    assert c1.count() == 52 and c1.where("speed not between 40 and 60 or ram <> 0").count() == 0
    assert sorted(map(tuple, c1.collect())) == sorted(map(tuple, c1.collect()))
    q = c1.withColumns({"pred": F.lit(50.0), "sigma": F.lit(1.0), "lo": F.lit(45.0), "hi": F.lit(55.0), "d": F.lit(0.5), "ml": F.lit("EXACT"), "mat": F.lit("L4")})
    q = recommend.candidate_status(recommend.quality_check(q, "pred", "sigma", "lo", "hi", "d"), "ml", "mat")
    assert q.where("status <> 'OK' or not valid").count() == 0
    r = recommend.recommend(q.withColumns({"kwh": F.col("speed"), "pt": F.col("speed"), "actual": F.lit(50.0)}), ["k"], "kwh", "pt", "actual")
    assert {x.decision for x in r.collect()} <= {"RECOMMEND", "REJECT"} and r.where("n_valid <> 26").count() == 0
    views = recommend.shadow_run(r.withColumn("branch", F.lit("x")), "branch")
    assert views["summary"].first().n == 2


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        a, b, z = rng.normal(size=3)
        rows.append((i, f"c{i % 6}", f"g{i % 2}", i % 3, float(a), float(b), float(z), float(30 + 5 * a - 2 * b + (i % 6) + 0.1 * rng.normal()), 1.0, f"l{i // 2}"))
    df = spark.createDataFrame(rows, "id long, compound string, route string, fold long, a double, b double, z double, y double, w double, grp string").repartition(4)
    df.cache().count()
    return df


def test_ridge_models(spark, train):
    m = models.fit_regression(train, ["a", "b", "z"], "y", "p", reg=0.0)
    x = np.array([[1, r.a, r.b, r.z] for r in train.collect()])
    y = np.array([r.y for r in train.collect()])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.id: r.p for r in m.transform(train).collect()}
    assert np.allclose([got[r.id] for r in train.collect()], x @ beta, atol=1e-6)
    base = models.BaselineModel(["a", "b"], "y", "compound", bias=True).fit(train).transform(train)
    assert metrics.regression_metrics(base, "y", "baseline").first().r2 > 0.95
    two = models.TwoStageModel(["a"], ["b"], "y", "compound", "ridge").fit(train).transform(train)
    assert two.where("prediction is null").count() == 0 and two.count() == 240
    out = models.separated_vs_unified(train, train, "route", ["a", "b"], "y").collect()
    assert {(r.route, r.model) for r in out} == {(s, m) for s in ("g0", "g1", "OVERALL") for m in ("unified", "separated")}


def test_hybrid_experts_energy(spark, train):
    h = models.HybridModel(["a", "b"], ["z"], "y", "compound", "route", "route", "w", min_rows=1000).fit(train).transform(train)
    assert h.count() == 240 and metrics.regression_metrics(h, "y", "prediction").first().r2 > 0.8
    e = models.ExpertSubsystem({"x": ["a"], "y": ["b", "z"]}, "y", "fold", "ridge").fit(train)
    assert (e.weights >= 0).all() and e.transform(train).where("subsystem is null").count() == 0
    en = models.EnergyModel(["a", "b"], "y", "route", kind="ridge").fit(train).transform(train, "w")
    assert en.count() == 240 and en.where("energy_pred < 10 or energy_pred > 120").count() == 0
    assert models.ablation(train, train, {"one": {"x": ["a"]}}, "y", "fold").first().variant == "one"


def test_forest_neighbours_and_others(spark, train):
    odd = train.where("id < 60").unionByName(train.where("id = 0").withColumns({"id": F.lit(9999).cast("long"), "a": F.lit(50.0), "b": F.lit(-50.0)}))
    out = models.isolation_forest(odd, odd, ["a", "b", "z"], "route", "id", trees=20)
    top = out.where("route = 'g0'").orderBy(F.desc("anomaly_score")).first()
    assert top.id == 9999 and out.where("route = 'g0' and is_outlier").count() >= 1
    vec = train.select("id", F.array("a", "b").alias("v"))
    near = models.applicability(vec.where("id >= 200"), vec.where("id < 200"), "id", "v").collect()
    ref = np.array([r.v for r in vec.where("id < 200").collect()])
    for r in near[:5]:
        assert r.knn_distance == pytest.approx(np.sort(np.linalg.norm(ref - np.array(r.v), axis=1))[:5].mean())
    # blocks, copies on both sides, nulls and no reference
    some = vec.where("id < 40").unionByName(vec.where("id < 7"))
    asked = vec.where("id >= 30 and id < 90").unionByName(vec.where("id = 50")).unionByName(vec.where("id = 1").withColumn("v", F.lit(None).cast("array<double>")))
    whole, parted = (sorted((r.id, round(r.knn_distance or -1, 9), r.reliability) for r in models.applicability(asked, some, "id", "v", 5, n).collect()) for n in (1000, 7))
    ref = np.array([r.v for r in some.collect()])
    assert whole == parted and len(whole) == 62 and whole[0] == (1, -1, "OUT_OF_DOMAIN")
    for r in asked.where("v is not null").collect()[:8]:
        assert dict((i, d) for i, d, _ in whole)[r.id] == pytest.approx(np.sort(np.linalg.norm(ref - np.array(r.v), axis=1))[:5].mean())
    assert {r.reliability for r in models.applicability(asked, some.limit(0), "id", "v").collect()} == {"OUT_OF_DOMAIN"}
    conf = models.confidence(train, train, ["a", "b"], "w", "w")
    assert {r.light for r in conf.select("light").distinct().collect()} <= {"Green", "Yellow", "Red"}
    profile = aggs.reference_profile(train, ["a", "b"])
    assert models.out_of_range(odd.where("id = 9999"), profile, "id", ["a", "b"]).first().n_out == 2
    clusters, _ = models.cluster_compounds(train, "compound", ["a", "b", "y"], 2)
    assert clusters.count() == 6
    beta = models.group_ridge(train, "grp", ["a", "b"], "y", "attention", steps=20, rate=0.5)
    assert beta[1] > 2
    chosen = models.hard_em(train, "grp", "id", ["a", "b"], "y", rounds=3)
    assert chosen.count() == 120
    neighbours = spark.createDataFrame([(f"c{i}", f"c{j}", 0.1 * abs(i - j)) for i in range(6) for j in range(6)], "compound string, near string, distance double")
    local = models.local_prediction(train, train, "compound", neighbours, ["a", "b"], "y")
    assert metrics.regression_metrics(local, "y", "local_prediction").first().r2 > 0.8
    m = models.fit_regression(train, ["a", "b", "z"], "y", "p")
    imp = {r.feature: r.delta_mae for r in models.permutation_importance(m, train, ["a", "z"], "y", "p", "id").collect()}
    assert imp["a"] > 1 > abs(imp["z"])
    assert models.guidance(train, ["a", "b", "z"], "y", 2).first().feature == "a"
    assert aggs.prune_correlated(train.withColumn("a2", F.col("a") * 2), ["a", "a2", "b"]) == ["a", "b"]


def test_sources(spark, tmp_path, train):
    p = f"file://{tmp_path}"
    daily = train.select("id", F.expr("date'2024-01-31' + cast(id % 3 as int)").alias("date"))
    io.write_daily(daily, f"{p}/daily")
    io.write_daily(daily.where("date = date'2024-02-01'").withColumn("id", F.col("id") + 1000), f"{p}/daily")
    back = io.read_daily(spark, f"{p}/daily")
    assert back.count() == 240 and back.where("id >= 1000").count() == 80
    assert io.read_daily(spark, f"{p}/daily", "2024-02-01").where("id < 1000").count() == 0
    io.write_report(train.select("id", "y"), f"{p}/report")
    assert io.read_csv(spark, f"{p}/report", "id long, y double", ["id"]).count() == 240
    assert io.load_state(spark, f"{p}/state", "k string, v double").count() == 0
    io.save_state(spark.createDataFrame([("a", 1.0)], "k string, v double"), f"{p}/state", "k")
    assert io.load_state(spark, f"{p}/state", "k string, v double").first().v == 1.0
    io.append_log(train.select("id").limit(1), f"{p}/log")
    io.append_log(train.select("id").limit(1), f"{p}/log")
    assert spark.read.parquet(f"{p}/log").count() == 2
    io.write_vectors(train.select("id", F.array("a", "b").alias("v")), f"{p}/vec", ["id"], "v")
    assert dict(spark.read.parquet(f"{p}/vec").dtypes)["v"] == "array<double>"
    io.export_latest_dates(daily, f"{p}/latest", "date", 1)
    assert spark.read.parquet(f"{p}/latest").count() == 80
    m = models.fit_regression(train, ["a"], "y", "p")
    io.snapshot(spark, f"{p}/snap", {"rows": train.select("id")}, {"k": 3}, {"m": m.model})
    assert spark.read.text(f"{p}/snap/config").first().value == '{"k": 3}'
    assert io.read_table(spark, {"path": f"{p}/snap/rows"}).count() == 240
