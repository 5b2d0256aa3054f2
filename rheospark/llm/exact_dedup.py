"""Exact dedup by a content sort.

Normalised texts are sorted as bytes: splitters sampled from their leading bytes range-partition them, Spark's external
sort puts equal ones next to each other, and each text is compared whole with its neighbour. The order is (leading
bytes, hash of the whole text, whole text, key). The key is part of the splitters, so that copies of one text may lie
in many partitions, however many there are. Splitters hold leading bytes only, so that no whole text goes to the driver;
the hash parts texts with equal beginnings.

A run of equal texts that begins or ends a partition may go on in another one. One row of each such run, with its text,
is compared across partitions: about two rows a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import drop_clashes, table, written

#: Leading bytes of a text in a splitter.
LEADING = 64
#: Columns that every row gets.
VERDICT = ["keep_id", "group_size", "kept", "text_sha256"]
_SORTED = ["_k", "_t", "_lead", "_hash"]
_FOUND = [*VERDICT, "_run", "_part", "_head", "_more"]


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _only(texts: pa.Array, at: np.ndarray, marked: np.ndarray) -> pa.Array:
    """The texts at the marked places, null at the others. pc.if_else() of a slice and a null scalar gives offsets beyond its data
    (pyarrow 23), and would make room for all texts of the slice."""
    return texts.take(pa.array(at, mask=~marked))


def _verdicts(names: list[str], carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a partition's sorted rows (carried columns, _k, _t, _hash) to rows with least key and size of their run. Rows of the
    run that is going on wait, without their texts, until it ends. _head: the text, at the first row of a run that may
    go on elsewhere; rows with _more are no documents but such texts."""
    types: list[pa.DataType] = []

    def made(own: list, least: pa.Array, sizes: np.ndarray, first: np.ndarray, digests: pa.Array, runs: np.ndarray, part: int, heads: pa.Array) -> pa.RecordBatch:
        n = len(runs)
        columns = [*own, least, pa.array(sizes), pa.array(first), digests, pa.array(runs), pa.array(np.full(n, part, np.int32)), heads, pa.array(np.zeros(n, bool))]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begin = None  # hash of the partition's first run
        text = code = least = None  # of the run that is going on
        number, size, rows = -1, 0, []
        alike: list[tuple] = []  # earlier runs with its hash: other texts, if hashes collide

        def close(at_end: bool) -> pa.RecordBatch:
            own = pa.Table.from_batches(rows).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns[:carried]]
            zeros = pa.array(np.zeros(size, np.int64))
            first = np.arange(size) == 0
            heads = pa.array([text if at_end or code == begin else None] + [None] * (size - 1), pa.string())
            return made(columns, least.take(zeros), np.full(size, size), first, pa.array([_digest(text)]).take(zeros), np.full(size, number), part, heads)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, texts, codes = (batch.column(carried + i) for i in range(3))
            types[:] = [*batch.schema.types[: carried + 1], pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
            change = np.flatnonzero(pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)) + 1  # full comparisons
            starts = np.concatenate(([0], change))
            slim = batch.select([*range(carried), carried])
            if text is not None and texts[0].as_py() == text:
                more = int(starts[1]) if len(starts) > 1 else n
                rows.append(slim.slice(0, more))
                size += more
                starts = starts[1:]
            if not len(starts):
                continue
            if text is not None:
                yield close(False)
                alike.append((code, number, text, least, size))
            begin = codes[0].as_py() if begin is None else begin
            ended, ends = starts[:-1], starts[1:]
            open_code = codes[int(starts[-1])].as_py()
            if len(ended):
                sizes, lo, hi = ends - ended, int(ended[0]), int(ends[-1])
                of = np.repeat(np.arange(len(ended)), sizes)
                take = pa.array(ended[of])
                names = texts.take(pa.array(ended))
                edge = pc.equal(codes.take(pa.array(ended)), begin).to_numpy(zero_copy_only=False)
                first = np.zeros(hi - lo, bool)
                first[ended - lo] = True
                heads = _only(texts, np.arange(lo, hi), first & edge[of])
                digests = pa.array([_digest(t) for t in names.to_pylist()]).take(pa.array(of))
                yield made([slim.column(i).slice(lo, hi - lo) for i in range(carried)], key.take(take), np.repeat(sizes, sizes), first, digests, number + 1 + of, part, heads)
                same = pc.equal(codes.take(pa.array(ended)), open_code).to_numpy(zero_copy_only=False)
                alike += [(open_code, number + 1 + int(i), names[int(i)].as_py(), key.slice(int(ended[i]), 1), int(sizes[i])) for i in np.flatnonzero(same)]
            number += len(ended) + 1
            at = int(starts[-1])
            text, code, least = texts[at].as_py(), open_code, key.slice(at, 1)
            size, rows = n - at, [slim.slice(at)]
            alike = [x for x in alike if x[0] == code]
        if text is not None:
            yield close(True)
            for other, at, name, low, count in alike:
                if other != begin:  # else it has come out as a head
                    nothing = [pa.nulls(1, t) for t in types[:carried]]
                    row = made(nothing, low, np.array([count]), np.array([False]), pa.array([""]), np.array([at]), part, pa.array([name]))
                    yield row.set_column(len(types) - 1, names[-1], pa.array([True]))

    return run


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """`key`, the columns `carry`, and VERDICT for every row of docs: keep_id and group_size of the rows with an equal normalised
    text, kept (one row of each group: the one with the least key), SHA-256 of the normalised text in lowercase hex.

    Null and empty texts are equal to one another; a text of white space only is one space. Null keys come last: keep_id
    is null only if all keys of a group are. Of rows that agree in key and text any one is kept. An empty table gives an
    empty result. Columns of docs called like VERDICT or beginning with one of the names used here can't be carried
    (they are left out; names compare without case); other columns of docs aren't read. Texts of any length are compared
    whole; only `parts` (spark.sql.shuffle.partitions) and the rows of one key and text bound how finely rows are dealt.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = drop_clashes(docs.select(*[F.col(f"`{c}`") for c in carry or []]), [key, *_SORTED, *_FOUND]).columns if carry else []
    t = normalised(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("_k"), *[F.col(f"`{c}`") for c in own], t.alias("_t"))
    rows = rows.withColumns({"_lead": F.substring(F.col("_t").cast("binary"), 1, LEADING), "_hash": F.xxhash64("_t")})
    last = F.asc_nulls_last("_k")
    dealt = rows.repartitionByRange(parts, "_lead", "_hash", last).sortWithinPartitions("_lead", "_hash", "_t", last)
    carried = dealt.select("_k", *[F.col(f"`{c}`") for c in own], F.col("_k").alias("_key"), "_t", "_hash")
    key_field = StructField(key, docs.schema[key].dataType)
    out = StructType(
        [key_field, *[docs.schema[c] for c in own], StructField("keep_id", key_field.dataType), StructField("group_size", LongType()), StructField("kept", BooleanType()), StructField("text_sha256", StringType())]
        + [StructField("_run", LongType()), StructField("_part", IntegerType()), StructField("_head", StringType()), StructField("_more", BooleanType())]
    )
    found = written(carried.mapInArrow(_verdicts(out.names, 1 + len(own)), out), "sorted")
    return _joined(found, key, own)


def _joined(found: DataFrame, key: str, own: list[str]) -> DataFrame:
    """Runs of one text in several partitions become one group. What is broadcast has about two rows a partition."""
    heads = found.where(F.col("_head").isNotNull()).select("_head", F.struct("_part", "_run").alias("_at"), "keep_id", "group_size")
    groups = heads.groupBy("_head").agg(F.min("_at").alias("_first"), F.min("keep_id").alias("_keep"), F.sum("group_size").alias("_size"), F.collect_list("_at").alias("_all")).where(F.size("_all") > 1)
    runs = groups.select("_first", "_keep", "_size", F.explode("_all").alias("_at")).select(F.col("_at._part").alias("_part"), F.col("_at._run").alias("_run"), "_keep", "_size", (F.col("_at") == F.col("_first")).alias("_is_first"))
    rows = found.where("not _more").join(F.broadcast(runs), ["_part", "_run"], "left")
    many = F.col("_size").isNotNull()
    verdict = {"keep_id": F.when(many, F.col("_keep")).otherwise(F.col("keep_id")), "group_size": F.coalesce("_size", "group_size"), "kept": F.col("kept") & F.coalesce("_is_first", F.lit(True))}
    return rows.withColumns(verdict).select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in own], *VERDICT)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, as they are: whole texts and all columns, but for those it can't carry."""
    whole = [c for c in docs.columns if c != key]
    kept = exact_groups(docs, key, text, whole).where("kept")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns if c in kept.columns and c not in VERDICT])


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(norm) AS text_sha256 FROM t WINDOW w AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
