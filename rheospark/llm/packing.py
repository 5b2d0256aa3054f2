"""Packing by concatenate and cut, in two passes.

The first pass makes token ids once and writes them with each document's offset inside its input partition and the
partition's number. The sum of tokens by partition, one row for each, gives by prefix sums where each partition begins
in the one long stream of tokens. The second pass cuts that stream into windows of fixed size. Nothing is shuffled but
the records at the boundaries of partitions, and those only if whole sequences are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_arrow_batches, table, written
from .tokens import forget_words, word_encoder

SEQUENCE = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Bytes of texts that are encoded together, about; a worker takes about 400 MB with 4 MB, 670 with 16.
CHUNK_BYTES = 4_000_000
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _larger(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold `least` bytes, for words that repeat within a batch are looked up once."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def token_table(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: part, doc_id, local_start, n_tokens, width, ids of every row of docs, written to the shared folder.

    ids are little-endian unsigned integers of `width` bytes, end_id last. A null text counts as empty (end_id only),
    null and repeated keys stay as they are, an empty table gives an empty one; other columns of docs aren't read.
    """
    small_arrow_batches(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        part, start = TaskContext.get().partitionId(), 0
        width = encoder.dtype.itemsize
        for batch in _larger(batches, CHUNK_BYTES):
            ids, sizes = encoder.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes += 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            constant = lambda v, n=len(sizes): pa.array(np.full(n, v, np.int32))
            binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [constant(part), batch.column(0), pa.array(start + ends[:-1]), pa.array(sizes), constant(width), binary],
                ["part", "doc_id", "local_start", "n_tokens", "width", "ids"],
            )
            start += int(ends[-1])

    schema = f"part int, doc_id {key_type}, local_start long, n_tokens long, width int, ids binary"
    return written(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(encode, schema), "tokens")


def with_global_start(tokens: DataFrame) -> DataFrame:
    """Add `start`, each document's place in the whole stream. What is broadcast has one row per input partition."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tokens.join(F.broadcast(totals.select("part", before.alias("base"))), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def cut_pieces(tokens: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Second pass: the pieces of each document between the boundaries of windows of `size` ids."""
    key_type = tokens.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, start, n, width, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "width", "ids")), strict=True):
                whole = np.frombuffer(ids, f"<u{width}").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(start + at, size)
                    length = min(n - at, size - offset)
                    rows.append((doc, at, length, zlib.crc32(whole[at : at + length].tobytes()), n, sequence, offset))
                    at += length
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PIECE)

    schema = f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return with_global_start(tokens).select("doc_id", "start", "n_tokens", "width", "ids").mapInArrow(cut, schema)


PARTS = "sequence_id long, offset long, ids binary"


def window_parts(tokens: DataFrame, size: int = SEQUENCE, then: Callable[[Iterator], Iterator] = iter, schema: str = PARTS) -> DataFrame:
    """sequence_id, offset, ids: sequences whole where a task has all of one, else its parts (at boundaries of tasks).
    `then` takes the batches on in the same Python worker and gives batches of `schema`."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        kept, begin = b"", -1  # ids that still wait for more, and where in the stream they begin
        for batch in batches:
            rows: list[tuple] = []
            for start, width, ids in zip(*(batch.column(c).to_pylist() for c in ("start", "width", "ids")), strict=True):
                if begin < 0 or begin + len(kept) // width != start:
                    if kept:
                        rows.append((begin // size, begin % size, kept))
                    kept, begin = b"", start
                kept += ids
                at, length = 0, len(kept) // width
                while (room := size - (begin + at) % size) <= length - at:
                    rows.append(((begin + at) // size, (begin + at) % size, kept[at * width : (at + room) * width]))
                    at += room
                kept, begin = kept[at * width :], begin + at
            yield _pieces(rows)
        if kept:
            yield _pieces([(begin // size, begin % size, kept)])

    return with_global_start(tokens).select("start", "width", "ids").mapInArrow(lambda batches: then(fill(batches)), schema)


def sequences(tokens: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """sequence_id, n_tokens, width, ids of every sequence (ids not padded). Only sequences that no task has whole are
    shuffled."""
    parts = window_parts(tokens, size).withColumn("width", F.lit(id_width(tokens)))
    whole = F.length("ids") == size * F.col("width")
    joined = (
        parts.where(~whole).groupBy("sequence_id", "width").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
        .select("sequence_id", F.expr("aggregate(transform(p, x -> x.ids), cast('' as binary), (a, x) -> a || x)").alias("ids"), "width")
    )
    both = parts.where(whole).select("sequence_id", "ids", "width").unionByName(joined)
    return both.select("sequence_id", (F.length("ids") / F.col("width")).cast("long").alias("n_tokens"), "width", "ids")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["sequence_id", "offset", "ids"])


def id_width(tokens: DataFrame) -> int:
    """Bytes of an id."""
    row = tokens.select("width").first()
    return row[0] if row else 4


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text) in sequences of `size` ids; only the last sequence isn't full.

    Documents follow in the order of the input's partitions. Nulls, repeated rows and empty tables: see token_table().
    """
    return cut_pieces(token_table(docs, tokenizer, end_id), size)


def op2_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
