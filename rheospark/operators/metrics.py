"""Metrics: errors, trends within orders, variances by layer, buckets, reports, gates and alerts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from ..sources.io import cut
from .aggs import corr, grouped_spearman, mode, pct
from .scans import running_rank, running_sums


def error_aggs(y: str, p: str, w: str | None = None) -> list[Column]:
    """n, mae, rmse, r2 as aggregates; weighted if a weight is given. R2 is null where all labels are equal."""
    known = F.col(y).isNotNull() & F.col(p).isNotNull()
    weight = F.when(known, F.col(w) if w else F.lit(1.0))
    e, label = F.when(known, F.col(y) - F.col(p)), F.when(known, F.col(y))
    total = F.nullif(F.sum(weight), F.lit(0.0))
    sse, syy = F.sum(weight * e * e), F.sum(weight * label * label) - F.sum(weight * label) * F.sum(weight * label) / total
    return [F.count(F.when(known, 1)).alias("n"), (F.sum(weight * F.abs(e)) / total).alias("mae"), F.sqrt(sse / total).alias("rmse"), F.when(syy > 1e-12, 1 - sse / syy).alias("r2")]


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None, w: str | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*error_aggs(y, p, w))


def energy_metrics(df: DataFrame, y: str, p: str, weight_ton: str, by: list[str] | None = None) -> DataFrame:
    off = F.abs(F.col(y) - F.col(p))
    rate = lambda c: F.avg(c.cast("double"))
    extra = [F.avg(F.when(F.col(y) != 0, 100.0 * off / F.abs(F.col(y)))).alias("mape"), F.avg(F.when(F.col(weight_ton) > 0, off / F.col(weight_ton))).alias("mae_per_ton"), rate(off <= 2).alias("hit_2kwh"), rate(off <= 0.05 * F.abs(F.col(y))).alias("hit_5pct")]
    return df.groupBy(*(by or [])).agg(*error_aggs(y, p), *extra)


def collapse_label_groups(df: DataFrame, group: str, order: str, seq: str, y: str, p: str, w: str, more: list[str] | None = None) -> DataFrame:
    """One row per label group: mean label and prediction, summed weight, first order, least sequence number."""
    firsts = [F.min_by(c, F.struct(seq, c)).alias(c) for c in [order, *(more or [])]]
    return df.groupBy(group).agg(F.avg(y).alias(y), F.avg(p).alias(p), F.sum(w).alias(w), *firsts, F.min(seq).alias(seq))


def metrics_rollup(df: DataFrame, y: str, p: str, by: str) -> DataFrame:
    """Metrics of each value and of all (by = OVERALL)."""
    out = df.rollup(by).agg(F.grouping(by).alias("_g"), *error_aggs(y, p))
    return out.withColumn(by, F.when(F.col("_g") == 1, "OVERALL").otherwise(F.col(by))).drop("_g")


nominal_metrics = metrics_rollup


def variance_ratio(df: DataFrame, order: str, y: str, p: str, least: int = 3, floor: float = 1e-5) -> DataFrame:
    """Mean over orders of var(prediction) / var(label), population variances; orders with enough rows and variance."""
    per = df.groupBy(order).agg(F.count("*").alias("n"), F.var_pop(y).alias("vy"), F.var_pop(p).alias("vp"))
    return per.where((F.col("n") >= least) & (F.col("vy") > floor)).agg(F.count("*").alias("n_orders"), F.avg(F.col("vp") / F.col("vy")).alias("variance_ratio"))


#: Rows of an order up to which each row is compared with the list of the others.
SHORT_ORDER = 256
#: Binary digits of a rank that one level of _counted_pairs() looks at.
DIGIT = 4


def direction_by_order(df: DataFrame, order: str, seq: str, y: str, p: str, min_delta: float = 0.3, strict: bool = True, short: int | None = None) -> DataFrame:
    """Per order the share of pairs, of those whose labels differ enough, that the predictions order alike. Labels differ
    enough if the greater one is above (not strict: at least) the lesser one plus min_delta, which is positive.

    A production lot is short, and its rows are compared with each other. Orders of more than SHORT_ORDER rows are
    counted without making pairs, see _counted_pairs()."""
    short = SHORT_ORDER if short is None else short
    rows = df.select(order, F.col(seq).alias("_q"), F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")).where("_y is not null")
    sizes = rows.groupBy(order).agg(F.count("*").alias("_n"))
    long_ones = sizes.where(F.col("_n") > short).select(order)
    any_long = not long_ones.isEmpty()
    later = F.collect_list(F.struct(F.col("_y").alias("y"), F.col("_p").alias("p"))).over(Window.partitionBy(order).orderBy("_q").rowsBetween(1, Window.unboundedFollowing))
    above = (lambda a, b: a > b + F.lit(min_delta)) if strict else (lambda a, b: a >= b + F.lit(min_delta))
    far = F.filter("_l", lambda x: above(x["y"], F.col("_y")) | above(F.col("_y"), x["y"]))
    alike = F.filter("_f", lambda x: F.signum(x["y"] - F.col("_y")) == F.signum(x["p"] - F.col("_p")))
    few = rows.join(sizes.where(F.col("_n") <= short).select(order), order, "left_semi") if any_long else rows
    few = few.withColumn("_l", later).withColumn("_f", far).select(order, F.size("_f").cast("long").alias("n"), F.size(alike).cast("long").alias("k"))
    counts = few.groupBy(order).agg(F.sum("n").alias("n_pairs"), F.sum("k").alias("n_alike"))
    if any_long:
        counts = counts.unionByName(_counted_pairs(rows.join(long_ones, order, "left_semi"), order, min_delta, strict))
    return counts.where("n_pairs > 0").withColumn("direction", F.col("n_alike") / F.col("n_pairs"))


def _counted_pairs(rows: DataFrame, order: str, min_delta: float, strict: bool) -> DataFrame:
    """n_pairs and n_alike of each order (_y, _p), as a merge sort counts inversions. Every row is a point at _y + min_delta and
    asks at _y how many points with a lesser _p lie before it. Of ranks of _p, read as digits of DIGIT bits, the lesser
    ones agree in their leading digits and have a lesser next one; so for each level there is one running count for each
    digit among the rows that agree so far. A row is read once a level, and long orders are parted (scans.running_sums)."""
    ranked = running_rank(rows.where("_p is not null"), [order], "_p", "_r").unionByName(rows.where("_p is null"), allowMissingColumns=True)
    top = ranked.agg(F.max("_r")).first()[0] or 1
    levels, base = max(1, -(-int(top).bit_length() // DIGIT)), 1 << DIGIT
    r = F.col("_r") - 1
    kinds = F.array(F.struct((F.col("_y") + min_delta).alias("t"), F.lit(2 if strict else 0).alias("kind")), F.struct(F.col("_y").alias("t"), F.lit(1).alias("kind")))
    # level -1: all rows, whatever their prediction, for the number of pairs
    cells = [F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("parent"), F.lit(0).alias("digit"))]
    cells += [F.struct(F.lit(i).alias("level"), F.shiftright(r, DIGIT * (i + 1)).cast("long").alias("parent"), F.shiftright(r, DIGIT * i).bitwiseAND(base - 1).cast("int").alias("digit")) for i in range(levels)]
    each = F.when(F.col("_r").isNotNull(), F.array(*cells)).otherwise(F.array(cells[0]))
    sides = ranked.select(order, "_r", F.explode(kinds).alias("x")).select(order, "_r", "x.*").select(order, "t", "kind", F.explode(each).alias("c")).select(order, "t", "kind", "c.*")
    point = F.col("kind") != 1
    counted = running_sums(sides, [order, "level", "parent"], ["t", "kind"], {f"c{i}": (point & (F.col("digit") == i)).cast("long") for i in range(base)})
    lesser = F.aggregate(F.slice(F.array(*[f"c{i}" for i in range(base)]), 1, F.col("digit")), F.lit(0).cast("long"), lambda s, x: s + x)
    asked = counted.where("kind = 1")
    return asked.groupBy(order).agg(F.sum(F.when(F.col("level") == -1, F.col("c0"))).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("level") >= 0, lesser)), F.lit(0)).alias("n_alike"))


def direction_accuracy(df: DataFrame, order: str, seq: str, y: str, p: str, min_delta: float = 0.3, strict: bool = True) -> DataFrame:
    return direction_by_order(df, order, seq, y, p, min_delta, strict).agg(F.count("*").alias("n_orders"), F.avg("direction").alias("direction_accuracy"))


def step_direction(df: DataFrame, order: str, seq: str, y: str, p: str) -> DataFrame:
    """Share of steps to the next row of an order, of those where the label moves, that the prediction moves alike."""
    w = Window.partitionBy(order).orderBy(seq)
    steps = df.select(F.signum(F.col(y) - F.lag(y).over(w)).alias("a"), F.signum(F.col(p) - F.lag(p).over(w)).alias("b"))
    return steps.where("a != 0").agg(F.count("*").alias("n_steps"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("step_direction"))


def order_spearman(df: DataFrame, order: str, y: str, p: str, least: int = 3) -> DataFrame:
    """Mean over orders of the rank correlation, orders with enough rows; orders of constant sides don't count."""
    counts = df.groupBy(order).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rho = grouped_spearman(df.join(counts, order, "left_semi"), [order], y, p, large=False).where("rho is not null")
    return rho.agg(F.count("*").alias("n_orders"), F.avg("rho").alias("spearman"))


def high_dev_mae(df: DataFrame, order: str, y: str, p: str, w: str, least_std: float = 0.5, k: float = 1.5) -> DataFrame:
    """Weighted error of rows more than k sample deviations from their order's mean, in orders that vary."""
    win = Window.partitionBy(order)
    rows = df.withColumns({"_m": F.avg(y).over(win), "_s": F.stddev_samp(y).over(win)})
    rows = rows.where((F.col("_s") > least_std) & (F.abs(F.col(y) - F.col("_m")) > k * F.col("_s")))
    return rows.agg(F.count("*").alias("n"), (F.sum(F.col(w) * F.abs(F.col(y) - F.col(p))) / F.nullif(F.sum(w), F.lit(0.0))).alias("high_dev_mae"))


def variance_layers(df: DataFrame, layers: list[str], order: str, actual: str) -> DataFrame:
    """Per layer: population variance and deviation over all rows and their mean within orders, and that to the actual's."""
    rows = df.select(order, *[F.col(c).cast("double").alias(c) for c in [actual, *layers]]).unpivot([order], [actual, *layers], "layer", "value")
    whole = rows.groupBy("layer").agg(F.var_pop("value").alias("global_var"), F.stddev_pop("value").alias("global_std"))
    inside = rows.groupBy("layer", order).agg(F.var_pop("value").alias("v"), F.stddev_pop("value").alias("s"), F.count("value").alias("n")).where("n >= 2")
    inside = inside.groupBy("layer").agg(F.avg("v").alias("intra_order_var"), F.avg("s").alias("intra_order_std"))
    out = whole.join(inside, "layer", "left")
    base = out.where(F.col("layer") == actual).select(F.col("intra_order_var").alias("_b"))
    return out.join(F.broadcast(base)).withColumn("intra_order_var_ratio", F.col("intra_order_var") / F.nullif(F.col("_b"), F.lit(0.0))).drop("_b")


def std_ratio_gate(df: DataFrame, by: str, y: str, p: str, least: int = 5, floor: float = 0.2) -> DataFrame:
    per = df.groupBy(by).agg(F.count("*").alias("n"), F.stddev_pop(y).alias("sy"), F.stddev_pop(p).alias("sp")).where((F.col("n") >= least) & (F.col("sy") > floor))
    per = per.withColumn("ratio", F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col("sp") / F.col("sy"))))
    return per.agg(F.count("*").alias("n_groups"), pct("ratio", 0.5).alias("median_ratio"), (F.sum(F.col("ratio") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("weighted_ratio"))


def stage2_capture(df: DataFrame, order: str, stage2: str, residual: str) -> DataFrame:
    out = variance_ratio(df, order, residual, stage2).withColumnRenamed("variance_ratio", "capture")
    return out.withColumn("tier", F.when(F.col("capture") >= 0.3, "HIGH").when(F.col("capture") >= 0.1, "MEDIUM").otherwise("LOW"))


def deviation_corr(df: DataFrame, by: str, y: str, p: str, least: int = 3) -> DataFrame:
    w = Window.partitionBy(by)
    rows = df.withColumns({"_n": F.count("*").over(w), "_y": F.col(y) - F.avg(y).over(w), "_p": F.col(p) - F.avg(p).over(w)}).where(F.col("_n") >= least)
    return rows.agg(F.count("*").alias("n"), corr("_y", "_p").alias("deviation_corr"), (F.stddev_pop("_p") / F.nullif(F.stddev_pop("_y"), F.lit(0.0))).alias("std_ratio"))


def bucket_report(df: DataFrame, buckets: list[str], y: str, p: str, reason: str) -> DataFrame:
    """AG37: per kind of bucket and bucket: n, means, residual, errors, rank correlation, most frequent reason. The rows are
    written once, narrow and not yet by bucket, for they are read for errors, ranks and reasons."""
    df = cut(df.select(y, p, reason, *buckets), "buckets")
    cells = F.array(*[F.struct(F.lit(b).alias("bucket_type"), F.col(b).cast("string").alias("bucket_value")) for b in buckets])
    rows = df.select(y, p, reason, F.explode(cells).alias("_b")).select(y, p, reason, "_b.*").where("bucket_value is not null")
    keys = ["bucket_type", "bucket_value"]
    out = rows.groupBy(*keys).agg(F.avg(y).alias("actual_mean"), F.avg(p).alias("pred_mean"), F.avg(F.col(y) - F.col(p)).alias("residual_mean"), *error_aggs(y, p))
    return out.join(grouped_spearman(rows, keys, y, p), keys, "left").join(mode(rows, keys, reason, "reason_top1"), keys, "left")


def reason_audit(df: DataFrame, reason: str, confidence: str) -> DataFrame:
    out = df.groupBy(reason, confidence).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def trend_validity(df: DataFrame, order: str, y: str, p: str, least: int = 3) -> DataFrame:
    """Per order whether a trend can be measured: distinct values (rounded to two digits), share of ties, first failure."""
    out = df.groupBy(order).agg(F.count("*").alias("n"), F.count_distinct(half_even(F.col(y), 2)).alias("unique_y"), F.count_distinct(half_even(F.col(p), 2)).alias("unique_p"))
    out = out.withColumns({"tie_ratio_y": 1 - F.col("unique_y") / F.col("n"), "tie_ratio_p": 1 - F.col("unique_p") / F.col("n")})
    return out.withColumn("failure", F.when(F.col("n") < least, "too_few").when(F.col("unique_y") < 2, "constant_label").when(F.col("unique_p") < 2, "constant_prediction").otherwise("valid"))


def compound_report(df: DataFrame, compound: str, order: str, seq: str, y: str, p: str, least: int = 10) -> DataFrame:
    df = cut(df.select(compound, order, seq, y, p), "rows")  # read for the counts, the errors, the orders and the ranks
    big = df.groupBy(compound).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    rows = df.join(big, compound)
    by_order = direction_by_order(rows.withColumn("_o", F.struct(compound, order)), "_o", seq, y, p)
    direction = by_order.groupBy(F.col(f"_o.{compound}").alias(compound)).agg(F.avg("direction").alias("direction_accuracy"))
    return regression_metrics(rows, y, p, [compound]).join(direction, compound, "left").join(grouped_spearman(rows, [compound], y, p), compound, "left")


def compare_models(a: DataFrame, b: DataFrame, key: str, metric: str, margin: float = 0.0) -> DataFrame:
    out = a.select(key, F.col(metric).alias("before")).join(b.select(key, F.col(metric).alias("after")), key)
    change = F.col("after") - F.col("before")
    return out.withColumns({"change": change, "diagnosis": F.when(change < -margin, "improved").when(change > margin, "worse").otherwise("unchanged")})


def detector_metrics(df: DataFrame, flag: str, truth: str) -> DataFrame:
    f, t = F.col(flag).cast("int"), F.col(truth).cast("int")
    return df.agg((F.sum(f * t) / F.nullif(F.sum(f), F.lit(0))).alias("precision"), (F.sum(f * t) / F.nullif(F.sum(t), F.lit(0))).alias("recall"), F.avg(f.cast("double")).alias("activation"))


def evaluate_gates(metrics: DataFrame, spec: list[tuple[str, str, str, float]]) -> DataFrame:
    """metrics: one row. spec: (gate, column, ">=" or "<=", threshold). A null value doesn't pass."""
    test = lambda c, op, t: F.coalesce(F.col(c) >= t if op == ">=" else F.col(c) <= t, F.lit(False))
    cells = [F.struct(F.lit(g).alias("gate"), test(c, op, t).alias("passed"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for g, c, op, t in spec]
    return metrics.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def promotion_decision(metrics: DataFrame, old: str, new: str, gates: DataFrame, margin: float = 0.0) -> DataFrame:
    passed = gates.agg(F.min(F.col("passed").cast("int")).alias("_ok"))
    return metrics.join(F.broadcast(passed)).withColumn("decision", F.when((F.col(new) < F.col(old) - margin) & (F.col("_ok") == 1), "PROMOTE").otherwise("RETAIN")).drop("_ok")


def risk_alert(metrics: DataFrame) -> DataFrame:
    """metrics: r2, mae, rmse, outlier_pct. Adds level and reasons; NO_LAB_DATA where there is no metric at all."""
    warn = [F.when(F.col("r2") < 0.70, "R2 below 0.70"), F.when(F.col("mae") > 3, "MAE above 3")]
    critical = [F.when(F.col("rmse") > 4.5, "RMSE above 4.5"), F.when(F.col("outlier_pct") > 10, "outliers above 10 %")]
    bad, some = F.array_compact(F.array(*critical)), F.array_compact(F.array(*critical, *warn))
    none = F.coalesce("r2", "mae", "rmse").isNull()
    level = F.when(none, "NO_LAB_DATA").when(F.size(bad) > 0, "CRITICAL").when(F.size(some) > 0, "WARNING").otherwise("NORMAL")
    return metrics.withColumns({"level": level, "reasons": F.concat_ws("; ", some)})


def gap_report(df: DataFrame, train: Column, branch: str, y: str, p: str, q: float = 0.9) -> DataFrame:
    """Bias and gaps of rows above their branch's training percentile."""
    limits = df.where(train).groupBy(branch).agg(pct(y, q).alias("threshold"))
    high = df.join(limits, branch).where(F.col(y) > F.col("threshold"))
    gap = F.col(y) - F.col(p)
    return high.groupBy(branch).agg(F.first("threshold").alias("threshold"), F.count("*").alias("n"), F.avg(gap).alias("bias"), F.avg(F.abs(gap)).alias("abs_gap"), F.avg(100.0 * gap / F.col(y)).alias("pct_gap"))


def stability_audit(df: DataFrame, fold: str, columns: list[str], y: str) -> DataFrame:
    """Correlation of each expert with the label per fold: mean, spread, CV %, whether the sign flips, and the dominant one."""
    per = df.groupBy(fold).agg(*[corr(c, y).alias(c) for c in columns]).unpivot([fold], columns, "expert", "r")
    out = per.groupBy("expert").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"))
    out = out.withColumns({"cv_pct": 100.0 * F.col("std") / F.nullif(F.abs("mean"), F.lit(0.0)), "sign_flip": F.col("min") * F.col("max") < 0})
    return out.withColumn("dominant", F.abs("mean") == F.max(F.abs("mean")).over(Window.partitionBy()))


def subset_metrics(df: DataFrame, subsets: Mapping[str, Column], y: str, p: str) -> DataFrame:
    """Metrics of overlapping named subsets; a subset without rows stays, with n = 0."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in subsets.items()]))
    got = regression_metrics(df.withColumn("subset", F.explode(names)), y, p, ["subset"])
    every = df.sparkSession.createDataFrame([(n,) for n in subsets], "subset string")
    return every.join(got, "subset", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bucket_directions(df: DataFrame, buckets: Mapping[str, str], order: str, seq: str, y: str, p: str, min_delta: float = 0.3, short: int | None = None) -> DataFrame:
    """AG37: per kind of bucket (name -> column) and bucket the orders with pairs of batches in it whose labels differ enough,
    those pairs, and the mean over the orders of the share that the predictions order alike.

    A short order's rows are compared once, and each pair counts in the buckets that both rows share: rows are dealt out by order and
    not written for each kind of bucket. Longer orders go through direction_by_order() by bucket."""
    short = SHORT_ORDER if short is None else short
    names = {f"_b{i}": t for i, t in enumerate(buckets)}
    cells = [F.col(c).cast("string").alias(b) for b, c in zip(names, buckets.values(), strict=True)]
    rows = df.where(F.col(y).isNotNull()).select(F.col(order).alias("_o"), F.col(seq).alias("_q"), F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"), *cells)
    sizes = rows.groupBy("_o").agg(F.count("*").alias("_n"))
    long_ones = sizes.where(F.col("_n") > short).select("_o")
    any_long = not long_ones.isEmpty()
    short_ones = sizes.where(F.col("_n") <= short).select(F.col("_o").alias("_s"))
    few = rows.join(short_ones, F.col("_o").eqNullSafe(F.col("_s")), "left_semi") if any_long else rows
    later = F.collect_list(F.struct("_y", "_p", *names)).over(Window.partitionBy("_o").orderBy("_q").rowsBetween(1, Window.unboundedFollowing))
    d = F.lit(min_delta)
    far = F.filter("_l", lambda x: (x["_y"] > F.col("_y") + d) | (F.col("_y") > x["_y"] + d))
    alike = lambda x: F.signum(x["_y"] - F.col("_y")) == F.signum(x["_p"] - F.col("_p"))
    here = lambda b: lambda x: x[b] == F.col(b)
    both = lambda b: lambda x: (x[b] == F.col(b)) & alike(x)
    kinds = [F.struct(F.lit(t).alias("bucket_type"), F.col(b).alias("bucket_value"), F.size(F.filter("_f", here(b))).cast("long").alias("n"), F.size(F.filter("_f", both(b))).cast("long").alias("k")) for b, t in names.items()]
    pairs = few.withColumn("_l", later).withColumn("_f", far).select("_o", F.explode(F.array(*kinds)).alias("x")).select("_o", "x.*").where("n > 0")
    found = pairs.groupBy("_o", "bucket_type", "bucket_value").agg(F.sum("n").alias("n_pairs"), F.sum("k").alias("n_alike"))
    found = found.select("bucket_type", "bucket_value", "n_pairs", (F.col("n_alike") / F.col("n_pairs")).alias("direction"))
    if any_long:
        each = F.array(*[F.struct(F.lit(t).alias("bucket_type"), F.col(b).alias("bucket_value")) for b, t in names.items()])
        rest = rows.join(long_ones.withColumnRenamed("_o", "_s"), F.col("_o").eqNullSafe(F.col("_s")), "left_semi")
        rest = rest.select(F.struct("_o").alias("_order"), "_q", "_y", "_p", F.explode(each).alias("_b")).where("_b.bucket_value is not null")
        rest = rest.select(F.struct("_b.bucket_type", "_b.bucket_value", "_order").alias("_o"), "_q", "_y", "_p")
        more = direction_by_order(rest, "_o", "_q", "_y", "_p", min_delta)
        found = found.unionByName(more.select("_o.bucket_type", "_o.bucket_value", "n_pairs", "direction"))
    return found.groupBy("bucket_type", "bucket_value").agg(F.count("*").alias("n_orders"), F.sum("n_pairs").alias("n_pairs"), F.avg("direction").alias("direction"))
