"""Label groups, sample weights, connected groups, splits without leaks, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut
from .aggs import mode
from .folds import BOUND, deal, key_sizes
from .quantiles import percentiles


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A repeatable uniform number in [0, 1) for the keys, from an MD5, as other engines can make it too."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def label_groups(df: DataFrame, order: str, pallet: str, sample: str | None = None) -> DataFrame:
    """label_group (sample id, else order|pallet in upper case, else the order), group_size and label_weight = 1 / size."""
    clean = lambda c: F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit(""))
    both = F.when(clean(order).isNotNull() & clean(pallet).isNotNull(), F.concat_ws("|", clean(order), clean(pallet)))
    group = F.coalesce(*([clean(sample)] if sample else []), both, clean(order))
    out = df.withColumn("label_group", group)
    sizes = out.groupBy("label_group").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "label_group", "left").withColumn("label_weight", 1.0 / F.col("group_size"))


def effective_weights(df: DataFrame, compound: str, group: str, label_weight: str, risk: str | None = None) -> DataFrame:
    """label weight times compound balance (1 / sqrt(groups), by its median, within 1/3 and 3) times risk, within 0.05 and
    5; loss_weight is scaled so that its sum is the number of rows."""
    per = df.groupBy(compound).agg(F.count_distinct(group).alias("_n")).withColumn("_b", 1 / F.sqrt("_n"))
    middle = percentiles(per, [], {"_m": "_b"}, [0.5]).select(F.col("_m")[0].alias("_med"))
    per = per.join(F.broadcast(middle)).select(compound, F.greatest(F.lit(1 / 3), F.least(F.lit(3.0), F.col("_b") / F.col("_med"))).alias("balance"))
    raw = F.col(label_weight) * F.col("balance") * (F.coalesce(F.col(risk), F.lit(1.0)) if risk else F.lit(1.0))
    out = df.join(per, compound, "left").withColumn("effective_weight", F.greatest(F.lit(0.05), F.least(F.lit(5.0), raw)))
    whole = out.agg((F.count("*") / F.sum("effective_weight")).alias("_k"))
    return out.join(F.broadcast(whole)).withColumn("loss_weight", F.col("effective_weight") * F.col("_k")).drop("_k")


def super_groups(df: DataFrame, a: str, b: str) -> DataFrame:
    """super_group of each row: rows that share a value of a or of b, directly or through others, are in one group.

    Labels of the distinct pairs go to and fro between both sides as minima until none changes; each round is written,
    so that lineage stays short and a lost executor costs one round."""
    df = cut(df, "rows")  # read for the pairs and for the result
    of = {"_a": F.col(a).cast("string"), "_b": F.col(b).cast("string")}
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    labels = cut(df.where(known).select(of["_a"].alias("a"), of["_b"].alias("b")).distinct().withColumn("label", F.col("a")), "groups")
    rows, largest = (max(x) for x in zip(key_sizes(labels, ["a"]), key_sizes(labels, ["b"]), strict=True))
    # tasks follow the number of pairs; a value of very many pairs is left to Spark's own joins, which part it
    by = (lambda rows_of, key: deal(rows_of, [key], rows)) if largest <= BOUND else (lambda rows_of, _: rows_of)
    while True:
        by_b = labels.groupBy("b").agg(F.min("label").alias("mb"))
        by_a = cut(by(by(labels, "b").join(by_b, "b").select("a", "mb"), "a").groupBy("a").agg(F.min("mb").alias("ma")), "least")
        # a label is itself a value of a: what that value has reached meanwhile is taken over at once
        jump = by_a.select(F.col("a").alias("ma"), F.col("ma").alias("far"))
        by_a = by_a.join(jump, "ma", "left").select("a", F.least("ma", F.coalesce("far", "ma")).alias("least"))
        new = cut(by(labels, "a").join(by_a, "a").select("a", "b", F.col("least").alias("label"), F.col("label").alias("old")), "groups")
        changed = new.where("label != old").limit(1).count()
        labels = new.drop("old")
        if not changed:
            break
    of_a = by(labels, "a").groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("super_group"))
    of_b = labels.select(F.col("b").alias("_b"), F.col("label").alias("_lb")).distinct()
    whole = by(df.where(known).withColumn("_a", of["_a"]), "_a").join(of_a, "_a").drop("_a")
    rest = df.where(~known).join(of_a, of["_a"] == F.col("_a"), "left").join(of_b, of["_b"] == F.col("_b"), "left")
    rest = rest.withColumn("super_group", F.coalesce("super_group", "_lb", of["_a"], of["_b"])).drop("_a", "_b", "_lb")
    return whole.unionByName(rest)


def strata(df: DataFrame, group: str, silica: str, wet: str, label: str) -> DataFrame:
    """Per group the most frequent of silica x wet x label quartile."""
    edges = percentiles(df, [], {"_e": label}, [0.25, 0.5, 0.75])
    quartile = F.size(F.filter("_e", lambda e: F.col(label) > e))
    rows = df.join(F.broadcast(edges)).withColumn("stratum", F.concat_ws("-", F.col(silica).cast("string"), F.col(wet).cast("string"), quartile.cast("string")))
    return mode(rows, [group], "stratum")


def stratified_group_split(groups: DataFrame, group: str, stratum: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """groups: a row per group. split of each: in random order within its stratum the first go to train, then val, test."""
    order = Window.partitionBy(stratum).orderBy(uniform(group, seed=seed), group)
    at = (F.row_number().over(order) - 0.5) / F.count("*").over(Window.partitionBy(stratum))
    return groups.withColumn("split", F.when(at <= train, "train").when(at <= train + val, "val").otherwise("test"))


def time_holdout(df: DataFrame, recipe: str, time: str, ratio: float = 0.15) -> DataFrame:
    """split per recipe: the last `ratio` of recipes by median time (ties by recipe) are "oot"."""
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    per = percentiles(df, [recipe], {"_m": micros}, [0.5]).select(recipe, F.col("_m")[0].alias("median_time"))
    at = F.row_number().over(Window.orderBy("median_time", recipe))  # a row per recipe
    n = F.count("*").over(Window.partitionBy())
    return per.withColumn("split", F.when(at > F.floor(n * (1 - ratio)), "oot").otherwise("train"))


def group_kfold(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform(key, seed=seed) * k).cast("int"))


def balanced_group_kfold(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Groups by falling size dealt round-robin."""
    per = df.groupBy(key).agg(F.count("*").alias("_n"))
    dealt = per.select(key, ((F.row_number().over(Window.orderBy(F.desc("_n"), key)) - 1) % k).alias("fold"))
    return df.join(dealt, key)


def kfold(df: DataFrame, keys: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(uniform(*keys, seed=seed) * k).cast("int"))


def random_split(df: DataFrame, keys: list[str], share: float = 0.8, seed: int = 0) -> DataFrame:
    return df.withColumn("split", F.when(uniform(*keys, seed=seed) < share, "train").otherwise("test"))


def cold_start(df: DataFrame, train: DataFrame, recipe: str, least: int = 3) -> DataFrame:
    counts = train.groupBy(recipe).agg(F.count("*").alias("_n"))
    return df.join(counts, recipe, "left").where(F.coalesce("_n", F.lit(0)) < least).drop("_n")


def high_energy_flags(train: DataFrame, df: DataFrame, branch: str, energy: str, per_ton: str, q: float = 0.9) -> DataFrame:
    """high_energy and high_per_ton: above the branch's training percentile (all training rows' for a new branch)."""
    both = {"_e": energy, "_t": per_ton}
    own = percentiles(train, [branch], both, [q]).select(branch, *[F.col(c)[0].alias(c) for c in both])
    whole = percentiles(train, [], both, [q]).select(F.col("_e")[0].alias("_ae"), F.col("_t")[0].alias("_at"))
    out = df.join(own, branch, "left").join(F.broadcast(whole))
    flag = lambda c, o, a: F.coalesce(F.col(c) > F.coalesce(o, a), F.lit(False))
    return out.withColumns({"high_energy": flag(energy, "_e", "_ae"), "high_per_ton": flag(per_ton, "_t", "_at")}).drop("_e", "_t", "_ae", "_at")
