"""Joins: enrichment, latest rows, intervals, as-of and point-in-time lookups, tiers of fallbacks, traces.

Keys are equi keys wherever there are any, so that Spark can deal both sides out; the remaining condition filters within
a key. Dimensions are left to Spark's own size check instead of being broadcast by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import visible_values
from .scans import running_last


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", at).where(F.col("_rn") <= n).drop("_rn")


def union_prefer_first(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """All rows, but of equal keys only what the earliest frame has; within a frame the first in `order`."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_rows(both, keys, [F.col("_source"), *order]).drop("_source")


def map_labels(lab: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Each lab result goes to every batch of its pallet; null keys match nothing."""
    return lab.join(mapping, keys)


def assemble(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), frames)


def enrich_left(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(dim, keys, "left")


def lot_quality(charges: DataFrame, qm: DataFrame, key: str) -> DataFrame:
    norm = lambda d: d.withColumn(key, F.upper(F.trim(F.col(key))))
    return norm(charges).join(norm(qm), key)


def latest_per_key(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], ties: list[str]) -> DataFrame:
    """All rows of left, with the values of right's latest row of the key (ties: the greatest of `ties`)."""
    packed = right.groupBy(*keys).agg(F.max(F.struct(ts, *ties, *[v for v in values if v not in (ts, *ties)])).alias("_v"))
    return left.join(packed, keys, "left").select("*", *[F.col(f"_v.{v}").alias(f"latest_{v}") for v in values]).drop("_v")


def step_with_prev(steps: DataFrame, wanted: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Value of each step that `wanted` (keys, step) names, and of the step numbered one less (null if there is none)."""
    before = steps.select(*keys, (F.col(step) + 1).alias(step), F.col(value).alias(f"prev_{value}"))
    return steps.join(wanted.select(*keys, step).distinct(), [*keys, step], "left_semi").join(before, [*keys, step], "left")


def window_join(points: DataFrame, windows: DataFrame, keys: list[str], time: str, start: str, end: str) -> DataFrame:
    """Points inside start .. end (both included) of the windows of the same key. Times are numbers; null ones and windows that
    end before they start have no points.

    A window of a length up to 2 ** level lies in two cells of that length at most, and is a row for each. A point is a row
    for each level that the windows of its key have, and meets the windows of its cell. So a key with many points and windows
    is many small groups, whatever the mixture of lengths, and a pair that meets is never far from a match."""
    a, b, t = (F.col(c).cast("double") for c in (start, end, time))
    level = F.ceil(F.log2(F.greatest(b - a, F.lit(2.0**-20)))).cast("int")
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    spread = windows.where(b >= a).withColumn("_level", level)
    cells = spread.withColumn("_cell", F.explode(F.sequence(cell(a), cell(b))))
    levels = spread.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    asked = points.join(levels, keys).withColumn("_level", F.explode("_levels")).withColumn("_cell", cell(t)).drop("_levels")
    return asked.join(cells, [*keys, "_level", "_cell"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_level", "_cell")


def window_agg(points: DataFrame, windows: DataFrame, keys: list[str], window_keys: list[str], time: str, start: str, end: str, aggs: list[Column]) -> DataFrame:
    return window_join(points, windows, keys, time, start, end).groupBy(*keys, *window_keys).agg(*aggs)


def asof_value(points: DataFrame, times: DataFrame, keys: list[str], time: str, at: str, values: list[str]) -> DataFrame:
    """For each row of times the values of the last point of its key at or before `at`; null if there is none.

    Both sides are one sorted sequence per key: a running "last value" over the union takes each point once, where a
    join would compare every point of a key with every time. A key of any size is many tasks (scans.running_last)."""
    own = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    point = points.select(*named, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(time, *[v for v in values if v != time]).alias("_v"))
    look = times.select(*named, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    both = point.unionByName(look, allowMissingColumns=True)
    found = running_last(both, own, ["_t", "_side", "_v"], "_v", "_found").where("_side = 1")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(f"asof_{v}") for v in values])


def value_at(points: DataFrame, times: DataFrame, keys: list[str], time: str, at: str, values: list[str]) -> DataFrame:
    """Values of the point of the key exactly at the time."""
    side = points.select(*keys, F.col(time).alias(at), *[F.col(v).alias(f"at_{v}") for v in values])
    return times.join(side, [*keys, at], "left")


def value_at_last(points: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.max_by(v, time).alias(f"last_{v}") for v in values])


def batch_kpis(points: DataFrame, windows: DataFrame, keys: list[str], time: str, spans: dict[str, tuple[str, str]], channels: list[str]) -> DataFrame:
    """Mean, maximum and trapezoid integral of each channel in each named span (start and end columns of windows, one row
    per key), in one pass over the points."""
    joined = points.join(windows, keys)
    order = Window.partitionBy(*keys).orderBy(time)
    gap = F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(order)
    area = {f"_area_{c}": gap * (F.col(c) + F.lag(c).over(order)) / 2 for c in channels}
    joined = joined.withColumns(area | {"_prev": F.lag(time).over(order)})
    aggs = []
    for name, (start, end) in spans.items():
        inside = F.col(time).between(F.col(start), F.col(end))
        for c in channels:
            aggs += [F.avg(F.when(inside, F.col(c))).alias(f"{name}_{c}_mean"), F.max(F.when(inside, F.col(c))).alias(f"{name}_{c}_max")]
            aggs.append(F.sum(F.when(inside & (F.col("_prev") >= F.col(start)), F.col(f"_area_{c}"))).alias(f"{name}_{c}_integral"))
    return joined.groupBy(*keys).agg(*aggs)


def trace(start: DataFrame, hops: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins along a chain of hops (table, keys), distinct rows."""
    return reduce(lambda a, hop: a.join(hop[0], hop[1], "left"), hops, start).distinct()


def trace_workoff(consumed: DataFrame, recipes: DataFrame, produced: DataFrame, recipe_keys: list[str], pallet_keys: list[str]) -> DataFrame:
    return consumed.join(recipes, recipe_keys, "left_semi").join(produced, pallet_keys, "left").distinct()


def semi(df: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keys_of, keys, "left_semi")


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key isn't in seen; a row with a null key is unseen."""
    return df.join(seen, keys, "left_anti")


def exclude_neighbours(df: DataFrame, bad: DataFrame, keys: list[str], seq: str, radius: int = 1) -> DataFrame:
    near = bad.select(*keys, F.explode(F.sequence(F.col(seq) - radius, F.col(seq) + radius)).alias(seq)).distinct()
    return df.join(near, [*keys, seq], "left_anti")


def tiered_fill(df: DataFrame, history: DataFrame, columns: list[str], tiers: list[list[str]]) -> DataFrame:
    """Each null is filled from history's mean by the first tier of keys that has one; an empty tier is the whole history."""
    for i, keys in enumerate(tiers):
        means = [F.avg(c).alias(f"_{i}_{c}") for c in columns]
        table = history.groupBy(*keys).agg(*means) if keys else history.agg(*means)
        df = df.join(table, keys, "left") if keys else df.join(F.broadcast(table))  # one row
    own = [*[F.coalesce(c, *[f"_{i}_{c}" for i in range(len(tiers))]).alias(c) for c in columns]]
    rest = [c for c in df.columns if c not in columns and not any(c == f"_{i}_{x}" for i in range(len(tiers)) for x in columns)]
    return df.select(*rest, *own)


def match_bounds(df: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], values: list[str]) -> DataFrame:
    """Values of the first tier (name, table with a row per key, keys) that has the key, and match_level."""
    level, found = None, {v: [] for v in values}
    for i, (name, table, keys) in enumerate(tiers):
        side = table.select(*keys, F.lit(True).alias(f"_hit{i}"), *[F.col(v).alias(f"_{i}_{v}") for v in values])
        df = df.join(side, keys, "left")
        hit = F.col(f"_hit{i}").isNotNull()
        level = F.when(hit, name) if level is None else level.when(hit, name)
        for v in values:
            found[v].append(F.when(hit, F.struct(F.col(f"_{i}_{v}").alias("x"))))
    out = df.withColumns({"match_level": level.otherwise("UNAVAILABLE")} | {v: F.coalesce(*c)["x"] for v, c in found.items()})
    return out.drop(*[f"_hit{i}" for i in range(len(tiers))], *[f"_{i}_{v}" for i in range(len(tiers)) for v in values])


def recipe_params(df: DataFrame, params: DataFrame, key: str, name: str, value: str, wanted: dict[str, str]) -> DataFrame:
    """One column per wanted parameter: the greatest value whose name is like the pattern."""
    aggs = [F.max(F.when(F.upper(F.col(name)).like(p.upper()), F.col(value))).alias(c) for c, p in wanted.items()]
    return df.join(params.groupBy(key).agg(*aggs), key, "left")


def merge_metrics(frames: dict[str, DataFrame], key: str, metric: str) -> DataFrame:
    """Full join of one metric per model by key, and the model with the least (first in order on a tie)."""
    sides = [f.select(key, F.col(metric).alias(f"{metric}_{n}")) for n, f in frames.items()]
    out = reduce(lambda a, b: a.join(b, key, "full"), sides)
    least = F.least(*[F.col(f"{metric}_{n}") for n in frames]) if len(frames) > 1 else F.col(f"{metric}_{next(iter(frames))}")
    return out.withColumn("best_model", F.coalesce(*[F.when(F.col(f"{metric}_{n}") == least, n) for n in frames]))


def sample_to_batch_nearest(samples: DataFrame, batches: DataFrame, keys: list[str], pallet: str, sample: str, batch: str) -> DataFrame:
    """The batch of a sample: a single batch is trusted, else the pallet whose last batch is nearest to the sample number
    (ties: the lower pallet)."""
    pallets = batches.groupBy(*keys, pallet).agg(F.max(batch).alias("last_batch"))
    counts = batches.groupBy(*keys).agg(F.count_distinct(batch).alias("n_batches"))
    joined = samples.drop(pallet).join(pallets, keys).join(counts, keys)
    near = first_rows(joined.withColumn("_d", F.abs(F.col("last_batch") - F.col(sample))), [*keys, sample], [F.col("_d"), F.col(pallet)])
    return near.drop("_d")


def pit_last_n(df: DataFrame, history: DataFrame, keys: list[str], start: str, visible: str, order: list[str], value: str, n: int) -> DataFrame:
    """JN21: mean and count of the last n values of the key that were visible before start; see folds.visible_values()."""
    out = visible_values(df, history, keys, F.col(start), F.col(visible), [F.col(c) for c in order], F.col(value), n, out="_last")
    known = F.filter("_last", lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0))
    count = F.when(F.size("_last") > 0, F.size(known).cast("long"))
    return out.withColumns({f"last{n}_mean": mean, f"last{n}_n": count}).drop("_last")


def expand_candidates(df: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Each batch with every candidate of its key."""
    return df.join(candidates, keys)


def nearest_centroid(df: DataFrame, centroids: DataFrame, features: list[str], ident: str, most: int = 10_000) -> DataFrame:
    """Nearest centroid (Euclidean; ties by id) of each row. Centroids go along in blocks of `most`, one after the other, so that
    what is broadcast is bounded however many there are; a row keeps the best it has met."""
    blocks = max(1, -(-centroids.count() // most))
    of = F.pmod(F.xxhash64(ident), F.lit(blocks))
    here = F.array(*[F.col(f).cast("double") for f in features])
    far = lambda c: F.aggregate(F.zip_with(here, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = df.withColumn("_b", F.lit(None).cast(f"struct<d:double,id:{centroids.schema[ident].dataType.simpleString()}>"))
    for i in range(blocks):
        packed = centroids.where(of == i).agg(F.collect_list(F.struct(F.col(ident).alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("c"))).alias("_c"))
        best = F.array_min(F.transform("_c", lambda x: F.struct(far(x["c"]).alias("d"), x["id"].alias("id"))))
        out = out.join(F.broadcast(packed)).withColumn("_b", F.least("_b", best)).drop("_c")
    return out.select(*df.columns, F.col("_b.id").alias("centroid"), F.sqrt("_b.d").alias("distance"))


def match_feedback(predictions: DataFrame, lab: DataFrame, key: str, ts: str) -> DataFrame:
    """Pending predictions with their label group's first lab result: status MATCHED or PENDING."""
    one = first_rows(lab, [key], [F.col(ts)])
    out = predictions.join(one, key, "left")
    return out.withColumn("status", F.when(F.col(ts).isNull(), "PENDING").otherwise("MATCHED"))


def keep_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return df.join(groups.select(key), key, "left_semi")


def class_phr(recipes: DataFrame, key: str, kind: Column, amount: str, wanted: str) -> DataFrame:
    """Sum of the amount of one material class by recipe."""
    return recipes.where(kind == wanted).groupBy(key).agg(F.sum(amount).alias(f"{wanted}_phr"))
