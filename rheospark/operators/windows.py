"""Window functions, orders, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import BOUND, deal, key_sizes, visible_values
from .joins import first_rows
from .quantiles import percentiles


def number_in_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumns({"n_in_group": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "group_size": F.count("*").over(Window.partitionBy(*keys))})


def number_rows(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """SO1: every row's place, from 1, in a total order. Rows are dealt out by ranges of the order; counts of the ranges, one
    row each, give where a range begins, so that no task sorts more than its range."""
    from ..sources.io import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = dealt.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return rows.withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_before")


def group_transform(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({n: a.over(w) for n, a in aggs.items()})


def collapse_islands(df: DataFrame, keys: list[str], seq: str, gap: int = 2) -> DataFrame:
    """The last row of each run of sequence numbers that follow at most `gap` apart; seq is unique within a key."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("_next", F.lead(seq).over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col(seq) > gap)).drop("_next")


def labelled_lag(df: DataFrame, keys: list[str], order: list[Column], value: str, k: int) -> DataFrame:
    """The k-th labelled value back from each labelled row, itself counted (feedback), and the one before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.where(F.col(value).isNotNull()).withColumns({"feedback": F.lag(value, k - 1).over(w), "feedback_before": F.lag(value, k).over(w)})


def rolling_visible(df: DataFrame, keys: list[str], order: list[Column], start: str, visible: str, value: str, n_mean: int = 3, n_std: int = 10, sizes: tuple[int, int] | None = None) -> DataFrame:
    """WF6: mean of the last n_mean and population deviation of the last n_std known values of earlier rows (in `order`, which
    begins with start) of the key that were visible strictly before the row's start. Rows count from the later of their own
    start and visibility on; those visible before they start count for rows behind them that start with them. See
    folds.visible_values(), also for sizes."""
    seen_at = F.when(F.col(start).isNotNull() & F.col(visible).isNotNull(), F.greatest(F.col(visible), F.col(start)))
    out = visible_values(df, F.col(value).isNotNull(), keys, F.col(start), seen_at, order, F.col(value), max(n_mean, n_std), out="_h", early=F.col(visible) < F.col(start), sizes=sizes)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    size = lambda a: F.nullif(F.size(a), F.lit(0))
    mean = lambda a: total(a, lambda x: x) / size(a)
    out = out.withColumns({"_m": F.slice("_h", 1, n_mean), "_s": F.slice("_h", 1, n_std)})
    out = out.withColumns({f"roll{n_mean}_mean": mean(F.col("_m")), "_mu": mean(F.col("_s"))})
    var = total(F.col("_s"), lambda x: (x - F.col("_mu")) * (x - F.col("_mu"))) / size(F.col("_s"))
    return out.withColumn(f"roll{n_std}_std", F.sqrt(var)).drop("_h", "_m", "_s", "_mu")


def rolling_residual(df: DataFrame, train: Column, group: str, mixer: str, order: list[Column], start: str, visible: str, value: str) -> DataFrame:
    """Residual to the training rows' median of the group (all training rows' where the group has none), rolled over the
    group's last five and the mixer's last ten visible rows."""
    whole = percentiles(df.where(train), [], {"_p": value}, [0.5]).select(F.col("_p")[0].alias("_all"))
    sizes = key_sizes(df, [group])
    if sizes[1] <= BOUND:  # dealt out by group once, for the medians and for what is rolled
        middle = F.percentile(F.when(train, F.col(value)), F.lit(0.5)).over(Window.partitionBy(group))
        out = deal(df, [group], sizes[0]).withColumn("_med", F.when(F.col(group).isNotNull(), middle))
    else:
        out = df.join(percentiles(df.where(train), [group], {"_p": value}, [0.5]).select(group, F.col("_p")[0].alias("_med")), group, "left")
    out = out.join(F.broadcast(whole)).withColumn("residual", F.col(value) - F.coalesce("_med", "_all"))
    out = rolling_visible(out.drop("_med", "_all"), [group], order, start, visible, "residual", 5, 5, sizes)
    out = out.withColumnRenamed("roll5_mean", "group_roll5").drop("roll5_std")
    sizes = key_sizes(df, [mixer])
    return rolling_visible(out, [mixer], order, start, visible, "residual", 10, 10, sizes).withColumnRenamed("roll10_mean", "mixer_roll10").drop("roll10_std")


def rolling_offset(df: DataFrame, keys: list[str], order: list[Column], residual: str) -> DataFrame:
    """The last known residual of earlier rows of the key; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.last(residual, ignorenulls=True).over(w), F.lit(0.0)))


def pct_of_total(df: DataFrame, value: str, keys: list[str], out: str = "pct") -> DataFrame:
    return df.withColumn(out, 100.0 * F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*keys)), F.lit(0)))


def diff(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    return df.withColumn(f"{value}_diff", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def avg_rank(value: Column, keys: list[str]) -> Column:
    """Rank with ties at their mean; null for null."""
    known = value.isNotNull()
    at = F.rank().over(Window.partitionBy(*keys, known).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, known, value))
    return F.when(known, at + (ties - 1) / 2.0)


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return first_rows(df, keys, order)


def top_volatile(df: DataFrame, key: str, value: str, n: int, least: float) -> DataFrame:
    """Detail rows of the n keys with the largest sample deviation above `least` (ties by key)."""
    top = df.groupBy(key).agg(F.stddev_samp(value).alias("volatility")).where(F.col("volatility") > least).orderBy(F.desc("volatility"), key).limit(n)
    return df.join(top, key)


def head_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return first_rows(df, keys, order, n)


def best_cohort(df: DataFrame, keys: list[str], value: str, ok: Column, order: list[Column], k: int = 20, low: float = 0.1, high: float = 0.3) -> DataFrame:
    """Per key the k rows of least value among those in spec between two percentiles of the key's values."""
    limits = percentiles(df, keys, {"_p": value}, [low, high])
    inside = df.join(limits, keys).where(ok & F.col(value).between(F.col("_p")[0], F.col("_p")[1])).drop("_p")
    return first_rows(inside, keys, [F.col(value), *order], k)


def top_features(df: DataFrame, score: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), name).limit(k)


def latest_batches(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intersect_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def except_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def union_cohorts(a: DataFrame, b: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both cohorts, labelled; of equal keys the first cohort's."""
    both = a.withColumn("cohort", F.lit(1)).unionByName(b.withColumn("cohort", F.lit(2)))
    return first_rows(both, keys, [F.col("cohort"), *order])
