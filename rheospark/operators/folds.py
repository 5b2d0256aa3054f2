"""Folds over sorted rows: Spark deals rows out by key and sorts them, a task reads them once and holds a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .scans import running_top


def fold_rows(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], zero: tuple, step: Callable[[tuple, tuple], tuple], outputs: list[str]) -> DataFrame:
    """Add the state before each row (`outputs`, doubles) of a fold over the rows of each key in `order`: it begins with zero
    and step(state, values of inputs) gives the next. A key is one task's, read as it comes from the sort and never held."""
    names = df.columns
    at, of = [names.index(k) for k in keys], [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, zero
        for batch in batches:
            before = []
            values = [batch.column(i).to_pylist() for i in of]
            for key, *x in zip(list(zip(*(batch.column(i).to_pylist() for i in at), strict=True)), *values, strict=True):
                if key != now:
                    now, state = key, zero
                before.append(state)
                state = step(state, tuple(x))
            columns = list(zip(*before, strict=True)) or [()] * len(outputs)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in columns)], [*names, *outputs])

    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in outputs)])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


#: Rows of a key up to which a task takes them one after the other, and rows of a task, about.
BOUND, TASK_ROWS = 1_000_000, 500_000


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of df and of its largest key."""
    whole, largest = df.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    return whole or 0, largest or 0


def deal(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df by keys, in as many tasks as its number of rows asks for, so that what a task sorts doesn't grow with the table."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-rows // TASK_ROWS)), *keys)


def _latest(keys: list[str], n: int, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows sorted by keys and what they see: history (_kind 2: _pos, its place in the key; _y) and rows that ask
    (_kind 1: _row; _full). Gives _row and the n values of the greatest places before, greatest first. Of a key that goes on
    in the next batch n places are held.

    A key's number goes before the place, so that what an earlier key has left is less than any place of the key. Each of
    the n places keeps the greatest number it has been given and hands the other one on to the next."""
    bits = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, held_y = None, np.empty(0, np.int64), pa.array([], pa.float64())
        for batch in (b for b in batches if b.num_rows):
            codes = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            for c in codes:
                changed[1:] |= c[1:] != c[:-1]
            key = np.cumsum(changed)
            ends = [tuple(repr(batch.column(k)[i].as_py()) for k in keys) for i in (0, batch.num_rows - 1)]
            if ends[0] != last:
                held, held_y = held[:0], held_y[:0]
            asks = batch.column("_kind").to_numpy(zero_copy_only=False) == 1
            place = batch.column("_pos").to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.concatenate([held, np.where(asks, -1, (key << bits) | place)])
            places, given = np.full((n, asks.sum()), -1, np.int64), number
            for i in range(n):
                before = np.concatenate([[-1], np.maximum.accumulate(given)[:-1]])
                places[i] = before[len(held) :][asks]
                given = np.minimum(given, before)
            full = batch.column("_full").to_numpy(zero_copy_only=False)[asks].astype(bool)
            seen = (places.T >> bits == key[asks][:, None]) & full[:, None]
            at = np.flatnonzero(number >= 0)
            at = at[np.argsort(number[at])]
            values = pa.concat_arrays([held_y, batch.column("_y").cast(pa.float64())])
            found = values.take(pa.array(at[np.searchsorted(number[at], places.T[seen])]))
            offsets = np.concatenate([[0], np.cumsum(seen.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_row").filter(pa.array(asks)), pa.ListArray.from_arrays(pa.array(offsets), found)], ["_row", out])
            at = at[number[at] >> bits == key[-1]][-n:]
            last, held, held_y = ends[1], number[at] & ((1 << bits) - 1), values.take(pa.array(at))

    return run


def visible_values(df: DataFrame, history: DataFrame | Column, keys: list[str], start: Column, visible: Column, order: list[Column], value: Column, n: int, out: str = "values", early: Column | None = None, sizes: tuple[int, int] | None = None, bound: int | None = None) -> DataFrame:
    """Add to each row of df the values of the last n rows (in `order`, nulls first) of history with its keys that were visible
    strictly before its start, latest first; none for a null key or start. History that is null there is never visible.
    history: a frame, or which rows of df are history. early: history that counts at its own time too, for rows of df behind
    it in `order` (df and history have these columns). sizes: see key_sizes(), of df.

    Both sides become one sequence in order of time, in which the last n that have been seen are kept, and no two rows are
    ever compared. Where no key has more than `bound` rows, rows are dealt out by key, and a row that asks and is history goes
    along once. Else a running top n over ranges of (key, time) says what has been seen (scans.running_top), and a key of any
    size is many tasks."""
    bound, own = BOUND if bound is None else bound, [f"_k{i}" for i in range(len(keys))]
    whole, largest = sizes or key_sizes(df, keys)
    if not isinstance(history, Column):
        whole, largest = (a + b for a, b in zip((whole, largest), key_sizes(history, keys), strict=True))
    if largest > bound:
        return _visible_in_ranges(df, history, keys, start, visible, order, value, n, out, early)
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    full = start.isNotNull()
    for k in keys:
        full = full & F.col(k).isNotNull()
    late = F.lit(True) if early is None else ~F.coalesce(early, F.lit(False))
    marks = [(f"_o{i}", c) for i, c in enumerate(order)]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    asks = F.struct(F.lit(1).alias("_kind"), start.cast("timestamp").alias("_t"), F.lit(False).alias("_late"), F.lit(None).cast("double").alias("_y"), full.alias("_full"), row.alias("_row"))
    past = F.struct(F.lit(2).alias("_kind"), visible.cast("timestamp").alias("_t"), late.alias("_late"), value.cast("double").alias("_y"), F.lit(True).alias("_full"), F.lit(None).cast(df.select(row.alias("_")).schema[0].dataType).alias("_row"))
    if isinstance(history, Column):
        dealt = deal(df, keys, whole).withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, value)))
        both = dealt.select(*named, "_pos", F.explode(F.when(history & visible.isNotNull(), F.array(asks, past)).otherwise(F.array(asks))).alias("_e")).select(*own, "_pos", "_e.*")
    else:
        asked = df.select(*named, *[c.alias(name) for name, c in marks if early is not None], asks.alias("_e"))
        seen = history.where(visible.isNotNull()).select(*named, *[c.alias(name) for name, c in marks], past.alias("_e"))
        both = deal(asked.unionByName(seen, allowMissingColumns=True), own, whole)
        at = Window.partitionBy(*own).orderBy(*[name for name, _ in marks], "_e._kind", "_e._y")
        both = both.withColumn("_pos", F.row_number().over(at)).select(*own, "_pos", "_e.*")
    # at one time late history comes behind those who ask: strictly before
    order_seen = ["_t", "_late", *(["_pos"] if early is not None else []), "_kind"]
    schema = StructType([StructField("_row", both.schema["_row"].dataType), StructField(out, ArrayType(DoubleType()))])
    return both.sortWithinPartitions(*own, *order_seen).mapInArrow(_latest(own, n, out), schema).select("_row.*", out)


def _visible_in_ranges(df: DataFrame, history: DataFrame | Column, keys: list[str], start: Column, visible: Column, order: list[Column], value: Column, n: int, out: str, early: Column | None) -> DataFrame:
    history = df.where(history) if isinstance(history, Column) else history
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    marks = [(f"_{part}{i}", v) for i, c in enumerate(order) for part, v in (("known", c.isNotNull()), ("at", c))]
    seen = F.struct(*[F.col(name) for name, _ in marks], F.col("_y").alias("y"))
    own = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]
    late = F.lit(True) if early is None else ~F.coalesce(early, F.lit(False))
    past = history.where(known).select(*named, visible.cast("timestamp").alias("_t"), late.alias("_late"), *[v.alias(name) for name, v in marks], value.cast("double").alias("_y"))
    past = past.where(F.col("_t").isNotNull()).withColumns({"_x": seen, "_kind": F.lit(2)}).drop("_y")
    asked = df.select(*named, start.cast("timestamp").alias("_t"), F.lit(False).alias("_late"), *[v.alias(name) for name, v in marks if early is not None], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.lit(1).alias("_kind"))
    both = asked.unionByName(past, allowMissingColumns=True)
    # at one time late history comes behind those who ask: strictly before
    found = running_top(both, own, ["_t", "_late", *[name for name, _ in marks], "_kind"], "_x", n, "_top").where("_kind = 1")
    complete = F.col("_t").isNotNull()
    for o in own:
        complete = complete & F.col(o).isNotNull()
    values = F.when(complete, F.transform("_top", lambda x: x["y"])).otherwise(F.array().cast("array<double>"))
    return found.select("_row.*", values.alias(out))
