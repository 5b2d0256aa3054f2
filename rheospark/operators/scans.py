"""Scans over the rows of each key in order, for keys of any size.

Rows are dealt out by ranges of (key, order), so that a key with very many rows lies in many ranges. What a scan needs to
know of earlier rows it works out in each chunk (the rows of one key in one range) by window functions; what the chunks
before add is carried over by the same functions, over one row a chunk. Only the first and the last key of a range
can go on in another one, so that what is carried, and broadcast, has at most two rows a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.io import cut

#: Rows of a key up to which one task scans it, and rows of a task of a scan, about.
BOUND, TASK_ROWS = 1_000_000, 250_000
#: Natural logarithm of what a block of an affine scan may shrink its state to; e ** 500 is far inside a double's range.
BLOCK = 500.0


def ranged(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """df with _key (a struct, in which nulls are values) and _part, the number of its range of (key, order); as it is if it
    has them already."""
    if "_part" in df.columns:
        return df
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys)]))
    return cut(keyed.repartitionByRange(parts, "_key", *order).withColumn("_part", F.spark_partition_id()), "ranges")


def spanning(rows: DataFrame) -> DataFrame:
    """_part, _key of the chunks of keys that lie in more than one range: two a range at most."""
    ends = rows.groupBy("_part").agg(F.min("_key").alias("a"), F.max("_key").alias("b"))
    chunks = ends.select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("_key"))
    several = chunks.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    return cut(chunks.join(several, "_key").select("_part", "_key"), "chunks")


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None, bound: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What a scan begins with: rows (written, for they are read twice) with _key and _part, and what spanning() says of them.
    The number of tasks follows the number of rows, so that what a task sorts doesn't grow with the table.

    Where no key has more than `bound` rows and no parts are given, rows are dealt out by key, and there are no chunks."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    n, largest = rows.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    tasks = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // TASK_ROWS))
    if parts is None and (largest or 0) <= (BOUND if bound is None else bound):
        return rows.withColumns({"_key": key, "_part": F.lit(0)}).repartition(tasks, "_key"), None
    out = ranged(rows, keys, order, tasks)
    return out.repartition(tasks, "_part", "_key"), spanning(out)


def _within(order: Sequence[Column | str], *keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _affine(rows: DataFrame, keys: list[str], order: Sequence[Column | str], m: str, c: str) -> DataFrame:
    """Add _mul, _add: the state before a row is _mul times the state before the first row of its keys, plus _add.

    Products are sums of logarithms. They are taken in blocks whose product is not below e ** -BLOCK, where running sums of c
    over the product so far neither leave the range of a double nor cancel; a block sees the end of the one before it,
    and what lies farther back has shrunk below e ** -BLOCK."""
    w = _within(order, *keys)
    log = F.when(F.col(m) > 0, F.greatest(F.log(m), F.lit(-2 * BLOCK))).otherwise(-2 * BLOCK)
    out = rows.withColumn("_log", F.sum(log).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_block", F.floor(-F.col("_log") / BLOCK))
    shift = F.col("_log") + BLOCK * F.col("_block")
    own = _within(order, *keys, "_block")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_own", F.exp(shift) * F.sum(F.col(c) * F.exp(-shift)).over(so_far))
    out = out.withColumns({"_own_before": F.lag("_own").over(w), "_log_before": F.lag("_log").over(w)})
    out = out.withColumns({"_own_first": F.first("_own_before").over(so_far), "_log_first": F.first("_log_before").over(so_far)})
    after = F.col("_own") + F.coalesce(F.exp(F.col("_log") - F.col("_log_first")) * F.col("_own_first"), F.lit(0.0))
    out = out.withColumns({"_after": after})
    out = out.withColumns({"_mul": F.coalesce(F.exp("_log_before"), F.lit(1.0)), "_add": F.coalesce(F.lag("_after").over(w), F.lit(0.0))})
    return out.drop("_block", "_own", "_own_before", "_log_before", "_own_first", "_log_first")


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], states: Mapping[str, tuple[Column, Column, float]], parts: int | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Add for each name of states the state before each row of its key, in `order` (ascending and total), of a recurrence
    state' = m * state + c that begins with `start`: name -> (m, c, start), where 0 <= m <= 1. A row that changes nothing
    has m = 1 and c = 0. Null keys are a key. chunks: of a df that comes from ranged() or dealt(), what spanning() says of it;
    then _key and _part stay in the result, for the next scan."""
    names = df.columns
    cells = {f"_{x}{i}": v.cast("double") for i, (m, c, _) in enumerate(states.values()) for x, v in (("m", m), ("c", c))}
    whole_keys = "_part" in names and chunks is None
    rows = ranged(df.withColumns(cells), keys, order, parts)
    chunks = spanning(rows) if chunks is None and not whole_keys else chunks
    at, out = F.struct(*order), rows
    for i, (name, (_, _, start)) in enumerate(states.items()):
        if whole_keys:
            own = _affine(out, ["_part", "_key"], order, f"_m{i}", f"_c{i}")
            out = own.withColumn(name, F.col("_mul") * F.lit(start) + F.col("_add")).drop("_log", "_after", "_mul", "_add")
            continue
        whole = _affine(rows.join(F.broadcast(chunks), ["_part", "_key"]), ["_part", "_key"], order, f"_m{i}", f"_c{i}")
        ends = whole.groupBy("_part", "_key").agg(F.max_by(F.struct(F.exp("_log").alias("m"), F.col("_after").alias("c")), at).alias("_x"))
        ends = ends.select("_part", "_key", F.col("_x.m").alias("_xm"), F.col("_x.c").alias("_xc"))
        carried = _affine(ends, ["_key"], ["_part"], "_xm", "_xc").select("_part", "_key", (F.col("_mul") * start + F.col("_add")).alias("_carried"))
        own = _affine(out, ["_part", "_key"], order, f"_m{i}", f"_c{i}")
        out = own.join(F.broadcast(carried), ["_part", "_key"], "left")
        out = out.withColumn(name, F.col("_mul") * F.coalesce("_carried", F.lit(start)) + F.col("_add")).drop("_log", "_after", "_mul", "_add", "_carried")
    return out.select(*[F.col(f"`{c}`") for c in names], *states)


def _tops(rows: DataFrame, w: WindowSpec, x: str, n: int, out: str) -> DataFrame:
    """Add the n largest x of the rows before, the largest first: each place keeps the largest it has been given and hands the
    other one on to the next place."""
    before = _before(w)
    for i in range(n):
        rows = rows.withColumn(f"_p{i}", F.max(f"_x{i}" if i else x).over(before))
        given = F.col(f"_x{i}" if i else x)
        rows = rows.withColumn(f"_x{i + 1}", F.when(given.isNotNull() & F.col(f"_p{i}").isNotNull(), F.least(given, f"_p{i}")))
    found = F.array_compact(F.array(*[f"_p{i}" for i in range(n)]))
    return rows.withColumn(out, found).drop(*[f"_p{i}" for i in range(n)], *[f"_x{i + 1}" for i in range(n)])


def running_top(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], x: str, n: int, out: str, parts: int | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Add `out`: the n largest x (of any type that has an order; null is none) of the earlier rows of the key in `order`,
    the largest first. Rows that are equal in order see each other or not; null keys are a key. chunks: see affine_scan()."""
    names = df.columns
    if "_part" in names and chunks is None:
        return _tops(df, _within(order, "_part", "_key"), x, n, out)
    rows = ranged(df, keys, order, parts)
    chunks = spanning(rows) if chunks is None else chunks
    mine = rows.where(F.col(x).isNotNull()).join(F.broadcast(chunks), ["_part", "_key"]).select("_part", "_key", F.col(x).alias("_x"))
    best = mine.withColumn("_rn", F.row_number().over(Window.partitionBy("_part", "_key").orderBy(F.desc("_x")))).where(F.col("_rn") <= n).drop("_rn")
    ends = best.withColumn("_kind", F.lit(1)).unionByName(chunks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    carried = _tops(ends, _within(["_part", "_kind"], "_key"), "_x", n, "_carried").where("_kind = 0").select("_part", "_key", "_carried")
    own = _tops(rows, _within(order, "_part", "_key"), x, n, out).join(F.broadcast(carried), ["_part", "_key"], "left")
    both = F.slice(F.sort_array(F.concat(out, "_carried"), False), 1, n)
    return own.withColumn(out, F.when(F.size("_carried") > 0, both).otherwise(F.col(out))).select(*[F.col(f"`{c}`") for c in names], out)


def running_last(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], x: str, out: str, parts: int | None = None) -> DataFrame:
    """Add `out`: the last x that isn't null of the row itself and the earlier rows of the key in `order`."""
    names = df.columns
    rows = ranged(df, keys, order, parts)
    chunks = spanning(rows)
    here = rows.join(F.broadcast(chunks), ["_part", "_key"]).where(F.col(x).isNotNull())
    from_end = _within([(F.col(o) if isinstance(o, str) else o).desc() for o in order], "_part", "_key")
    ends = here.withColumn("_rn", F.row_number().over(from_end)).where("_rn = 1").select("_part", "_key", F.col(x).alias("_x"))
    carried = chunks.join(ends, ["_part", "_key"], "left").withColumn("_carried", F.last("_x", ignorenulls=True).over(_before(_within(["_part"], "_key")))).drop("_x")
    own = rows.withColumn(out, F.last(x, ignorenulls=True).over(_within(order, "_part", "_key").rowsBetween(Window.unboundedPreceding, 0)))
    own = own.join(F.broadcast(carried), ["_part", "_key"], "left").withColumn(out, F.coalesce(out, "_carried"))
    return own.select(*[F.col(f"`{c}`") for c in names], out)


def running_sums(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], sums: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """Add for each name of sums the sum of its column (null counts as 0) over the earlier rows of the key in `order`."""
    names = df.columns
    cells = {f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())}
    rows = ranged(df.withColumns(cells), keys, order, parts)
    chunks = spanning(rows)
    ends = rows.join(F.broadcast(chunks), ["_part", "_key"]).groupBy("_part", "_key").agg(*[F.sum(c).alias(c) for c in cells])
    before = _before(_within(["_part"], "_key"))
    carried = ends.select("_part", "_key", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_c{c}") for c in cells])
    own = rows.withColumns({f"_o{c}": F.coalesce(F.sum(c).over(_before(_within(order, "_part", "_key"))), F.lit(0)) for c in cells})
    own = own.join(F.broadcast(carried), ["_part", "_key"], "left")
    return own.select(*[F.col(f"`{c}`") for c in names], *[(F.col(f"_o{c}") + F.coalesce(f"_c{c}", F.lit(0))).alias(n) for c, n in zip(cells, sums, strict=True)])


def running_rank(df: DataFrame, keys: Sequence[Column | str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """Add `out`: 1 and the number of rows of the key with a lesser value (nulls least). Equal values lie in one range."""
    names = df.columns
    rows = ranged(df, keys, [value], parts)
    chunks = spanning(rows)
    ends = rows.join(F.broadcast(chunks), ["_part", "_key"]).groupBy("_part", "_key").agg(F.count("*").alias("_n"))
    carried = ends.select("_part", "_key", F.coalesce(F.sum("_n").over(_before(_within(["_part"], "_key"))), F.lit(0)).alias("_carried"))
    own = rows.withColumn(out, F.rank().over(_within([value], "_part", "_key"))).join(F.broadcast(carried), ["_part", "_key"], "left")
    return own.withColumn(out, F.col(out) + F.coalesce("_carried", F.lit(0))).select(*[F.col(f"`{c}`") for c in names], out)
