"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut
from .scans import running_sums

#: Rows (or distinct values) of a group up to which its values may meet in one task.
BOUND = 1_000_000


def percentiles(df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column | str], ps: Sequence[float], aggs: Sequence[Column] = (), bound: int | None = None, count: str | None = None) -> DataFrame:
    """One row for each key (one in all without keys) with an array of the percentiles `ps` of each column: exact, linear
    between neighbours, nulls left out (null for a key without values); and the further aggregates aggs. count: the column
    that says how often a row counts (not for aggs).

    Spark's own percentile merges a group's values in one task. It is used if no group has more than `bound` rows. Else
    equal values are counted and written first, and it merges the counts, if no group has more distinct values than that. Else
    running sums of the counts in order of value, over ranges of (key, column, value), say which values stand at the
    wanted ranks. The results are equal."""
    bound = BOUND if bound is None else bound
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else df.count()
    points = F.array(*map(F.lit, ps))
    percentile = lambda c, n: F.percentile(c, points, F.col(n)) if n else F.percentile(c, points)
    if (largest or 0) <= bound:
        return df.groupBy(*keys).agg(*aggs, *[percentile(c, count).alias(n) for n, c in columns.items()])
    times = F.col(count) if count else F.lit(1)
    cells = F.array(*[F.struct(F.lit(n).alias("_name"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_value")) for n, c in columns.items()])
    long = df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_")).alias("_group"), times.alias("_n"), F.explode(cells).alias("_x")).select("_group", "_n", "_x.*")
    counted = cut(long.where(F.col("_value").isNotNull()).groupBy("_group", "_name", "_value").agg(F.sum("_n").alias("_n")), "values")
    sizes = cut(counted.groupBy("_group", "_name").agg(F.sum("_n").alias("_all"), F.count("*").alias("_distinct")), "sizes")
    if (sizes.agg(F.max("_distinct")).first()[0] or 0) <= bound:
        every = counted.groupBy("_group", "_name").agg(percentile("_value", "_n").alias("_p"))
    else:
        at = lambda p: (F.col("_all") - 1) * F.lit(p)
        holds = lambda r: (F.col("_less") <= r) & (r < F.col("_less") + F.col("_n"))
        low, high = (lambda p: F.floor(at(p)).cast("long")), (lambda p: F.ceil(at(p)).cast("long"))
        ranked = running_sums(counted, ["_group", "_name"], ["_value"], {"_less": F.col("_n")}).join(sizes, ["_group", "_name"])
        ends = [F.max(F.when(holds(f(p)), F.col("_value"))).alias(f"_{side}{i}") for i, p in enumerate(ps) for side, f in (("l", low), ("h", high))]
        value = lambda i, p: F.when(low(p) == high(p), F.col(f"_l{i}")).otherwise((high(p) - at(p)) * F.col(f"_l{i}") + (at(p) - low(p)) * F.col(f"_h{i}"))
        every = ranked.groupBy("_group", "_name", "_all").agg(*ends).select("_group", "_name", F.array(*[value(i, p) for i, p in enumerate(ps)]).alias("_p"))
    own = [F.col(f"_group.k{i}").alias(k) for i, k in enumerate(keys)]
    out = every.groupBy(*(["_group"] if keys else [])).agg(*[F.max(F.when(F.col("_name") == n, F.col("_p"))).alias(n) for n in columns]).select(*own, *columns)
    whole = df.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_count")]))  # keys without values have a row too
    if not keys:
        return whole.join(F.broadcast(out)).drop("_count")
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return whole.join(out.withColumnsRenamed({k: f"_{i}" for i, k in enumerate(keys)}), same, "left").drop("_count", *[f"_{i}" for i in range(len(keys))])
