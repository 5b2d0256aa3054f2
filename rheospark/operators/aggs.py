"""Aggregations: label collapse, material shares, pivots, robust outliers, bounds, shrunk biases, profiles, audits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from ..sources.io import cut
from .folds import deal
from .quantiles import percentiles
from .scans import running_sums
from .windows import avg_rank


def pct(column: str | Column, p: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(column, F.lit(p))


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of the rows that have both values; null where a side is constant (F.corr divides by 0 then)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def collapse_retests(df: DataFrame, keys: list[str], result: str, order: str, firsts: list[str]) -> DataFrame:
    """Mean result and the first (by order) other values of each key; null keys go."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.avg(result).alias(result), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in firsts], F.count("*").alias("n_tests"))


def material_pct(df: DataFrame, keys: list[str], kind: str, weight: str, kinds: Iterable[str]) -> DataFrame:
    """Share of each kind in the weight of the key, in percent; null where the whole weight is 0."""
    whole = F.nullif(F.sum(weight), F.lit(0))
    return df.groupBy(*keys).agg(*[(100.0 * F.sum(F.when(F.col(kind) == k, F.col(weight)).otherwise(0.0)) / whole).alias(f"pct_{k.lower().replace(' ', '_')}") for k in kinds])


def pivot_mean(df: DataFrame, keys: list[str], name: str, value: str, wanted: Iterable[str], prefix: str = "") -> DataFrame:
    """One column per wanted name with the mean of its values."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(name) == n, F.col(value))).alias(f"{prefix}{n}") for n in wanted])


def centroid(df: DataFrame, keys: list[str], numeric: list[str], text: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in text], F.count("*").alias("n_batches"))


def batch_list(df: DataFrame, keys: list[str], seq: str, out: str = "batches") -> DataFrame:
    """The distinct sequence numbers of a key in order, comma-separated."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(seq)), ",").alias(out))


def workoff_ratio(df: DataFrame, order: str, material: str, weight: str, is_workoff: Column) -> DataFrame:
    """Per order: number of work-off materials, their summed mean weights, and the share of all materials' mean weights."""
    rows = cut(df.select(order, material, F.col(weight).alias("_w"), is_workoff.cast("int").alias("_off")), "rows")
    rows = deal(rows, [order], rows.count())  # once, for both steps; a task's groups don't grow with the table
    means = rows.groupBy(order, material).agg(F.avg("_w").alias("w"), F.max("_off").alias("off"))
    return means.groupBy(order).agg(F.sum("off").cast("long").alias("n_workoff"), F.sum(F.when(F.col("off") == 1, F.col("w")).otherwise(0.0)).alias("workoff_weight"), (F.sum(F.when(F.col("off") == 1, F.col("w")).otherwise(0.0)) / F.nullif(F.sum("w"), F.lit(0))).alias("workoff_ratio"))


def narrow_keys(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Keys whose values span at most the limit."""
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("_span")).where(F.col("_span") <= limit).drop("_span")


def drop_wide(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Rows of keys whose values span at most the limit; the spans have one row per key."""
    return df.join(narrow_keys(df, keys, value, limit), keys)


def drop_mad_outliers(df: DataFrame, keys: list[str], value: str, k: float = 2.5, least: float = 1.5, low: float = 5.0, high: float = 10.0) -> DataFrame:
    """Rows within clamp(k * max(1.4826 * MAD, least), low, high) of the key's median; null values go. Both medians come from
    the counts of the key's values, so that df is read twice: for the counts and for the rows."""
    known = df.where(F.col(value).isNotNull())
    counted = cut(known.groupBy(*keys, value).agg(F.count("*").alias("_c")), "values")
    medians = cut(percentiles(counted, keys, {"_p": value}, [0.5], count="_c").select(*keys, F.col("_p")[0].alias("_med")), "medians")
    off = counted.join(medians, keys).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    mads = percentiles(off, keys, {"_p": "_off"}, [0.5], count="_c").select(*keys, F.col("_p")[0].alias("_mad"))
    limit = F.greatest(F.lit(low), F.least(F.lit(high), k * F.greatest(1.4826 * F.col("_mad"), F.lit(least))))
    limits = cut(medians.join(mads, keys).select(*keys, "_med", limit.alias("_limit")), "limits")  # written, its size is known to the join
    return known.join(limits, keys).where(F.abs(F.col(value) - F.col("_med")) <= F.col("_limit")).drop("_med", "_limit")


def flag_far_from_median(df: DataFrame, keys: list[str], value: str, limit: float = 20.0) -> DataFrame:
    medians = percentiles(df, keys, {"_p": value}, [0.5]).select(*keys, F.col("_p")[0].alias("group_median"))
    return df.join(medians, keys, "left").withColumn("far", F.coalesce(F.abs(F.col(value) - F.col("group_median")) > limit, F.lit(False)))


def safe_bounds(df: DataFrame, levels: list[list[str]], features: list[str], low: float = 0.05, high: float = 0.95, min_rows: int = 20, min_values: int = 5) -> DataFrame:
    """P-low, P-high and median of each feature for every level of keys. Rows of equal keys and values are counted and written
    once; every level reads the counts.

    Columns: all keys (null where the level doesn't have them), level (number of the level), n and per feature low, high,
    median rounded half-even to two digits; 0 with fewer than min_values values.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    points = (("low", low), ("high", high), ("median", 0.5))
    counted = cut(df.groupBy(*keys, *features).agg(F.count("*").alias("_c")), "counted")
    each = []
    for at, level in enumerate(levels):
        sizes = [F.sum("_c").alias("n"), *[F.coalesce(F.sum(F.when(F.col(f).isNotNull(), F.col("_c"))), F.lit(0)).alias(f"_n_{f}") for f in features]]
        found = percentiles(counted, level, {f"_p_{f}": f for f in features}, [p for _, p in points], sizes, count="_c")
        cells = [F.when(F.col(f"_n_{f}") >= min_values, half_even(F.col(f"_p_{f}")[i], 2)).otherwise(0.0).alias(f"{f}_{name}") for f in features for i, (name, _) in enumerate(points)]
        each.append(found.select(*[F.col(k) if k in level else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], "n", *cells, F.lit(at).alias("level")))
    return reduce(DataFrame.unionByName, each).where(F.col("n") >= min_rows)


def label_audit(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def energy_benchmark(df: DataFrame, by: list[str], value: str) -> DataFrame:
    out = percentiles(df, by, {"_p": value}, [0.1, 0.5, 0.9], [F.count(value).alias("n"), F.avg(value).alias("mean")])
    p10, p50, p90 = (F.col("_p")[i] for i in range(3))
    return out.select(*by, "n", "mean", p10.alias("p10"), p50.alias("p50"), p90.alias("p90"), (F.col("mean") - p10).alias("saving_potential"))


def stage_share(df: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    whole = F.nullif(sum((F.sum(F.coalesce(F.col(s), F.lit(0.0))) for s in stages), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(*by).agg(*[(F.sum(F.coalesce(F.col(s), F.lit(0.0))) / whole).alias(f"{s}_share") for s in stages])


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, out: str = "weighted_mean") -> DataFrame:
    """Null where the weights of known values sum to 0."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0))).alias(out))


def shrunk_bias(df: DataFrame, group: str, cluster: str, residual: str, weight: str, k: float = 5.0) -> DataFrame:
    """Bias of each group: n_eff / (n_eff + k) of its own weighted mean and the rest of its cluster's, where
    n_eff = (sum w)^2 / sum w^2. Columns: group, cluster, n_eff, raw_bias, cluster_bias, bias."""
    w, r = F.col(weight), F.col(residual)
    mean = F.sum(w * r) / F.nullif(F.sum(w), F.lit(0))
    groups = df.groupBy(group, cluster).agg((F.sum(w) * F.sum(w) / F.nullif(F.sum(w * w), F.lit(0))).alias("n_eff"), mean.alias("raw_bias"))
    clusters = df.groupBy(cluster).agg(mean.alias("cluster_bias"))
    part = F.col("n_eff") / (F.col("n_eff") + k)
    return groups.join(clusters, cluster).withColumn("bias", part * F.col("raw_bias") + (1 - part) * F.col("cluster_bias"))


def apply_bias(df: DataFrame, biases: DataFrame, group: str, cluster: str, out: str = "bias", within: bool = False) -> DataFrame:
    """Bias of the group, else the mean of its cluster's groups, else the mean of all groups. within: a group may lie in several
    clusters, and has a bias in each."""
    clusters = biases.groupBy(cluster).agg(F.avg("bias").alias("_c"))
    whole = biases.agg(F.avg("bias").alias("_a"))
    keys = [group, cluster] if within else [group]
    joined = df.join(biases.select(*keys, F.col("bias").alias("_g")), keys, "left").join(clusters, cluster, "left").join(F.broadcast(whole))
    return joined.withColumn(out, F.coalesce("_g", "_c", "_a", F.lit(0.0))).drop("_g", "_c", "_a")


def shrunk_bias_by_count(df: DataFrame, group: str, cluster: str, residual: str, k: float = 5.0) -> DataFrame:
    return shrunk_bias(df.withColumn("_one", F.lit(1.0)), group, cluster, residual, "_one", k)


def process_delta(df: DataFrame, train: Column, by: list[str], columns: list[str]) -> DataFrame:
    """delta_<c> = value less the training mean of its route and material (all training rows' where there is none); a
    null gives 0."""
    means = df.where(train).groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    whole = df.where(train).agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    out = df.join(means, by, "left").join(F.broadcast(whole))
    out = out.withColumns({f"delta_{c}": F.coalesce(F.col(c) - F.coalesce(f"_m_{c}", f"_a_{c}"), F.lit(0.0)) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns], *[f"_a_{c}" for c in columns])


def long(df: DataFrame, keep: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep, columns, name, value)


def reference_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: count, mean, sample deviation and the percentiles 1, 5, 25, 50, 75, 95, 99."""
    points = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    rows = long(df, [], columns).where("value is not null")
    out = percentiles(rows, ["feature"], {"_p": "value"}, points, [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")])
    return out.select("feature", "n", "mean", "std", *[F.col("_p")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(points)])


def feature_audit(df: DataFrame, columns: list[str], label: str, row: str, most_missing: float = 0.6, most_dominant: float = 0.98) -> DataFrame:
    """Per feature: missing rate, share of the most frequent value, distinct values, Spearman to the label, why to drop."""
    cells = cut(long(df, [label], columns).groupBy("feature", "value", label).agg(F.count("*").alias("_c")), "cells")  # df is read once
    n = cells.where(F.col("feature") == columns[0]).agg(F.sum("_c")).first()[0] or 0
    counts = cells.where("value is not null").groupBy("feature", "value").agg(F.sum("_c").alias("c"))
    top = counts.groupBy("feature").agg(F.max("c").alias("top"), F.count("*").alias("n_distinct"), F.sum("c").alias("known"))
    rho = counted_spearman(cells.where(f"value is not null and {label} is not null"), ["feature"], "value", label, "_c")
    out = top.join(rho, "feature", "left").withColumns({"missing_rate": 1 - F.col("known") / n, "dominant_rate": F.col("top") / F.col("known")})
    reason = F.when(F.col("missing_rate") > most_missing, "missing").when(F.col("n_distinct") < 2, "constant").when(F.col("dominant_rate") > most_dominant, "dominant").otherwise("")
    score = F.abs(F.coalesce("rho", F.lit(0.0))) * (1 - F.col("missing_rate"))
    return out.withColumns({"score": score, "drop_reason": reason}).select("feature", "missing_rate", "dominant_rate", "n_distinct", "rho", "score", "drop_reason")


def value_ranks(df: DataFrame, keys: list[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """Mean rank of each distinct value of a key (keys, value, out), for keys of any size. count: the column that says how often
    a row counts.

    Distinct values are counted first; a running sum of the counts in order of value, over ranges of (key, value), is what
    lies before one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(count) if count else F.count("*")).alias("_n"))
    summed = running_sums(counts, keys or [F.lit(0)], [value], {"_less": F.col("_n")})
    return summed.select(*keys, value, (F.col("_less") + (F.col("_n") + 1) / 2.0).alias(out))


def counted_spearman(pairs: DataFrame, keys: list[str], x: str, y: str, count: str, out: str = "rho") -> DataFrame:
    """Spearman correlation with mean ranks, per key, of pairs of values that stand `count` times each; null for constant
    sides. A value ranks among all known ones of its side. pairs is read three times."""
    ranked = pairs.join(value_ranks(pairs, keys, x, "_x", count), [*keys, x]).join(value_ranks(pairs, keys, y, "_y", count), [*keys, y])
    mean = lambda v: F.sum(F.col(count) * v) / F.sum(count)
    cov = lambda a, b: mean(F.col(a) * F.col(b)) - mean(F.col(a)) * mean(F.col(b))
    varies = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return ranked.groupBy(*keys).agg(F.when(varies, cov("_x", "_y") / F.sqrt(cov("_x", "_x") * cov("_y", "_y"))).alias(out))


def grouped_spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "rho", large: bool = True) -> DataFrame:
    """Spearman correlation with mean ranks, per key; null for constant sides. Equal pairs are counted and written once, so that
    df is read once and its rows meet no ranks. large=False ranks each key in one window, which is cheaper where keys are
    many and small, such as orders."""
    if large:
        rows = df.select(*keys, F.col(x).alias("_vx"), F.col(y).alias("_vy"))
        pairs = cut(rows.groupBy(*keys, "_vx", "_vy").agg(F.count("*").alias("_c")), "pairs")
        return counted_spearman(pairs, keys, "_vx", "_vy", "_c", out)
    ranked = df.select(*keys, avg_rank(F.col(x), keys).alias("_x"), avg_rank(F.col(y), keys).alias("_y"))
    return ranked.groupBy(*keys).agg(corr("_x", "_y").alias(out))


def correlation_matrix(df: DataFrame, columns: list[str], count: str | None = None) -> dict[tuple[str, str], float]:
    """Pearson correlations of all pairs in one pass. count: the column that says how often a row counts."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return {}
    if count is None:
        row = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
        return {p: row[i] for i, p in enumerate(pairs)}
    middle = df.agg(*[((F.min(c) + F.max(c)) / 2).alias(c) for c in columns]).first()

    def weighted(a: str, b: str) -> Column:
        known = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y, w = (F.when(known, c) for c in (F.col(a) - F.lit(middle[a]), F.col(b) - F.lit(middle[b]), F.col(count)))  # shifted, so that sums cancel little
        n = F.sum(w)
        cov = lambda u, v: F.sum(w * u * v) / n - F.sum(w * u) / n * (F.sum(w * v) / n)
        return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), cov(x, y) / F.sqrt(cov(x, x) * cov(y, y)))

    row = df.agg(*[weighted(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[i] for i, p in enumerate(pairs)}


def prune_correlated(df: DataFrame, ranked: list[str], most: float = 0.9, keep: int = 60) -> list[str]:
    """Features in order of rank, without those whose rank correlation with one kept before is too high."""
    counted = cut(df.groupBy(*ranked).agg(F.count("*").alias("_c")), "counted")
    ranks = counted
    for c in ranked:
        ranks = ranks.join(value_ranks(counted, [], c, f"_r_{c}", "_c"), c, "left")
    rho = correlation_matrix(ranks.select(*[F.col(f"_r_{c}").alias(c) for c in ranked], "_c"), ranked, "_c")
    kept: list[str] = []
    for c in ranked:
        if len(kept) < keep and all(abs(rho.get((k, c), rho.get((c, k))) or 0.0) < most for k in kept):
            kept.append(c)
    return kept


def max_redundancy(df: DataFrame, new: list[str], old: list[str]) -> DataFrame:
    """For each new feature the existing one it correlates with most, and LOW / MEDIUM (0.75) / HIGH (0.90)."""
    row = df.agg(*[corr(a, b).alias(f"{a}|{b}") for a in new for b in old])
    cells = [F.struct(F.lit(a).alias("feature"), F.array_max(F.array(*[F.struct(F.abs(F.coalesce(F.col(f"`{a}|{b}`"), F.lit(0.0))).alias("r"), F.lit(b).alias("b")) for b in old])).alias("m")) for a in new]
    out = row.select(F.explode(F.array(*cells)).alias("x")).select("x.feature", F.col("x.m.b").alias("nearest"), F.col("x.m.r").alias("abs_r"))
    return out.withColumn("redundancy", F.when(F.col("abs_r") >= 0.9, "HIGH").when(F.col("abs_r") >= 0.75, "MEDIUM").otherwise("LOW"))


def group_correlation(df: DataFrame, by: str, columns: list[str], label: str, least: int = 30) -> DataFrame:
    """Per group and feature: n, coverage, Pearson and Spearman to the label; groups with more than `least` values."""
    rows = long(cut(df.select(by, label, *columns), "rows"), [by, label], columns)
    known = F.col("value").isNotNull() & F.col(label).isNotNull()
    pearson = rows.groupBy(by, "feature").agg(F.count("*").alias("rows"), F.count_if(known).alias("n"), corr("value", label).alias("pearson")).where(F.col("n") > least)
    rho = grouped_spearman(rows.where(known), [by, "feature"], "value", label, "spearman")
    return pearson.join(rho, [by, "feature"]).select(by, "feature", "n", "pearson", "spearman", (F.col("n") / F.col("rows")).alias("coverage"))


def qcut_edges(df: DataFrame, column: str, q: int, by: list[str] | None = None) -> DataFrame:
    """Quantile edges as an array without repeats."""
    points = F.array(*[F.lit(i / q) for i in range(q + 1)])
    return df.groupBy(*(by or [])).agg(F.array_distinct(F.percentile(column, points)).alias("edges"))


def qcut(df: DataFrame, column: str, q: int, out: str = "bucket") -> DataFrame:
    """Bucket number from 1: right-closed quantile bins, the lowest included; repeated edges merge; null for null."""
    edges = qcut_edges(df, column, q)
    at = F.size(F.filter("edges", lambda e: e < F.col(column)))
    return df.join(F.broadcast(edges)).withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(F.lit(1), at))).drop("edges")


def label_conflicts(df: DataFrame, group: str, value: str, std: float = 3.0, span: float = 6.0) -> DataFrame:
    out = df.groupBy(group).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))
    return out.where((F.col("n") > 1) & ((F.col("std") > std) | (F.col("range") > span)))


def label_group_summary(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    per = df.groupBy(group).agg(F.count("*").alias("size"), F.avg(value).alias("y"), F.sum(weight).alias("w"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("size").alias("n_rows"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), F.avg("y").alias("mean_label"), F.stddev_samp("y").alias("std_label"), F.sum("w").alias("weight"))


def leakage_audit(df: DataFrame, keys: Mapping[str, str], split: str) -> DataFrame:
    """For each key (name -> column): how many values stand in more than one split, PASS or FAIL."""
    parts = []
    for name, column in keys.items():
        per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct(split).alias("n"))
        parts.append(per.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n_leaks")).withColumn("key", F.lit(name)))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("key", "n_keys", "n_leaks", F.when(F.col("n_leaks") == 0, "PASS").otherwise("FAIL").alias("status"))


def few_shot_bias(df: DataFrame, history: DataFrame, family: str, track: str, residual: str, least: int = 2) -> DataFrame:
    fam = history.groupBy(family).agg(F.avg(residual).alias("_f"), F.count(residual).alias("_n"))
    tra = history.groupBy(track).agg(F.avg(residual).alias("_t"))
    out = df.join(fam, family, "left").join(tra, track, "left")
    ok = F.coalesce(F.col("_n") >= least, F.lit(False))
    return out.withColumns({"bias": F.coalesce(F.when(ok, F.col("_f")), F.col("_t"), F.lit(0.0)), "bias_source": F.when(ok, "family").when(F.col("_t").isNotNull(), "track").otherwise("none")}).drop("_f", "_n", "_t")


def calibration_bias(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean residual, and the mean absolute error without and with it."""
    bias = df.agg(F.avg(F.col(y) - F.col(p)).alias("bias"))
    return df.join(F.broadcast(bias)).agg(F.first("bias").alias("bias"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae_before"), F.avg(F.abs(F.col(y) - F.col(p) - F.col("bias"))).alias("mae_after"))


def mgmt_summary(keys_of: DataFrame, df: DataFrame, key: str, value: str, hit: Column) -> DataFrame:
    """Counts, sum and mean per key; keys without rows stay, with 0."""
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keys_of.select(key).distinct().join(per, key, "left").select(key, zero("n"), zero("n_hit"), F.coalesce("total", F.lit(0.0)).alias("total"), "mean")


def coverage(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"))
    return out.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def mode_of(column: str) -> Column:
    """Most frequent value, ties by the least (aggregate)."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY `{column}`)")


def pilot_window(df: DataFrame, by: list[str], setpoints: list[str], factor: str) -> DataFrame:
    aggs = [F.count("*").alias("n")]
    for s in setpoints:
        aggs += [pct(s, 0.25).alias(f"{s}_p25"), pct(s, 0.5).alias(f"{s}_p50"), pct(s, 0.75).alias(f"{s}_p75"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max")]
    return df.groupBy(*by).agg(*aggs).join(mode(df, by, factor), by)


def mode(df: DataFrame, by: list[str], column: str, out: str | None = None) -> DataFrame:
    """The most frequent value of each key, ties by the least value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(out or column))


def lever_importance(df: DataFrame, lever: Column, value: str) -> DataFrame:
    out = df.groupBy(lever.alias("lever")).agg(F.sum(value).alias("importance"))
    return out.withColumn("pct", 100.0 * F.col("importance") / F.sum("importance").over(Window.partitionBy()))


def contribution_pct(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = F.nullif(sum((F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in columns), F.lit(0.0)), F.lit(0.0))
    return df.withColumns({f"{c}_pct": 100.0 * F.abs(F.coalesce(F.col(c), F.lit(0.0))) / whole for c in columns})


def fingerprint(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group the number of rows and the exact median of each column. df is read once."""
    rows = cut(df.select(by, *columns), "rows")
    out = percentiles(rows, [by], {f"_p_{c}": c for c in columns}, [0.5], [F.count("*").alias("n")])
    return out.select(by, "n", *[F.col(f"_p_{c}")[0].alias(f"{c}_median") for c in columns])


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[f(c).alias(f"n_{c}") for c in columns])


def delta_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature the population variance of the raw column and of its delta_ column, and their ratio."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns], *[F.var_pop(f"delta_{c}").alias(f"delta_{c}") for c in columns])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("raw_var"), F.col(f"delta_{c}").alias("delta_var")) for c in columns]
    out = row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return out.withColumn("ratio", F.col("delta_var") / F.nullif(F.col("raw_var"), F.lit(0.0)))


def date_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    parsed = df.select(*[F.try_to_timestamp(F.col(c).cast("string")).alias(c) for c in columns]).unpivot([], columns, "column", "t")
    return parsed.groupBy("column").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("t").alias("n_parsed"))
