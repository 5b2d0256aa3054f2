"""Training-order materialisation: a keyed permutation deals every sequence to a slot; shards of fixed-size records.

The permutation is a Feistel network over the smallest domain of an even number of bits that holds all sequence ids; an
id that falls outside is walked on through the network until it falls inside. So the slot of a sequence, and the
sequence of a slot, follow from the key and the number of sequences alone. Shards hold equally many slots each, a range
of slots is a partition, and one task writes it in order. A record is the slot (eight bytes), the ids of one sequence,
padded to the full length, and a line feed: record r of a shard begins at byte r * stride, so reading can begin, and go
on, at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, small_arrow_batches, table
from .packing import SEQUENCE, id_width, token_table, window_parts
from .tokens import forget_words

KEY, ROUNDS, PAD_ID, HEADER = 20240607, 6, 0, 8
#: Records of a shard: 128 MB of two-byte ids.
SHARD_ROWS = 1 << 15
MANIFEST = "sequences long, size int, width int, shard_rows long, key long"


def _mix(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A round function: 64-bit finaliser of the half, the key and the round."""
    x = x ^ np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(ids: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Slots of ids (0 .. n - 1), or ids of slots."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    width, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(ids).astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> width, x & mask
        for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_mix(left, key, turn) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key, turn) & mask)
        out[walking] = left << width | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def _pack(ids: bytes, width: int) -> bytes:
    """Compressed for the shuffle; first the low bytes of all ids, then the next ones, as those repeat more."""
    return zlib.compress(np.frombuffer(ids, np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unpack(packed: bytes, width: int) -> bytes:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(width, -1).T.tobytes()


def write_shards(tokens: DataFrame, path: str, size: int = SEQUENCE, key: int = KEY, shard_rows: int = SHARD_ROWS) -> int:
    """tokens: a token_table(). Write path/data, a file for each shard with names in the order of shards, and path/manifest.

    Parts of sequences go to the partition of their shard, the range of slots that the permutation deals them to, and meet
    there in order of slot and offset; the task writes them as they come. Returns the number of sequences. An empty table
    gives a manifest of 0 sequences.
    """
    spark = tokens.sparkSession
    n = -(-(tokens.agg(F.sum("n_tokens")).first()[0] or 0) // size)
    width = id_width(tokens)
    small_arrow_batches(spark, 1000)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permute(batch.column(0).to_numpy(), n, key)
            small = [_pack(x, width) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(1), pa.array(small, pa.binary())], ["slot", "offset", "ids"])

    def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        filler = np.array([PAD_ID], f"<u{width}").tobytes()
        record = lambda slot, x: slot.to_bytes(HEADER, "little") + x + filler * (size - len(x) // width)
        now, ids = None, b""  # slot and what has been read of it
        for batch in batches:
            records = []
            for slot, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != slot:
                    if now is not None:
                        records.append(record(now, ids))
                    now, ids = slot, b""
                ids += _unpack(packed, width)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([record(now, ids)], pa.binary())], ["record"])

    if n:
        dealt = window_parts(tokens, size, deal, "slot long, offset long, ids binary")
        dealt = dealt.repartitionById(-(-n // shard_rows), F.floor(F.col("slot") / shard_rows).cast("int"))
        records = dealt.sortWithinPartitions("slot", "offset").select("slot", "ids").mapInArrow(pad, "record binary")
        # the bytes of a binary go through a string unchanged; each record ends with a line feed
        records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).text(f"{path}/data")
    spark.createDataFrame([(n, size, width, shard_rows, key)], MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return n


def manifest(spark: SparkSession, path: str) -> dict:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").first().asDict()


def _records(spark: SparkSession, path: str, m: dict, from_slot: int, row: Callable[[np.ndarray], object], schema: str) -> DataFrame:
    """slot, shard, byte_offset, sequence_id and row(ids) of every record from a slot on. Spark has no DataFrame reader for
    records of fixed length; its RDD reader cuts files of any size between records."""
    if from_slot >= m["sequences"]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{path}/data").select("path").orderBy("path")  # names only, not what is in them
    first = from_slot // m["shard_rows"]
    paths = ",".join(r.path for r in files.collect()[first:]) if first else f"{path}/data/part-*"
    stride, width, key, n, of_shard = HEADER + m["size"] * m["width"] + 1, m["width"], m["key"], m["sequences"], m["shard_rows"]

    def parse(records: Iterator[bytes]) -> Iterator[tuple]:
        while some := list(islice(records, 256)):
            slots = np.array([int.from_bytes(x[:HEADER], "little") for x in some])
            sequences = permute(slots, n, key, inverse=True).tolist()
            for slot, sequence, x in zip(slots.tolist(), sequences, some, strict=True):
                if slot >= from_slot:
                    shard, at = divmod(slot, of_shard)
                    yield slot, shard, at * stride, sequence, row(np.frombuffer(x[HEADER:-1], f"<u{width}"))

    return spark.createDataFrame(spark.sparkContext.binaryRecords(paths, stride).mapPartitions(parse), schema)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, sequence_id, ids (array) of all records from a slot on; shards before it aren't opened."""
    schema = "slot long, shard long, byte_offset long, sequence_id long, ids array<long>"
    return _records(spark, path, manifest(spark, path), from_slot, lambda ids: ids.tolist(), schema)


def materialise(docs: DataFrame, path: str, size: int = SEQUENCE, key: int = KEY, shard_rows: int = SHARD_ROWS) -> int:
    """Tokens of all rows of docs (doc_id, text), packed into sequences and written in training order below path.

    Null texts count as empty, repeated rows are rows like any other, extra columns aren't read, an empty table gives an
    empty manifest. Returns the number of sequences.
    """
    tokens = token_table(docs.select("doc_id", "text"))
    n = write_shards(tokens, path, size, key, shard_rows)
    discard(tokens)
    return n


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the written shards: a row for each sequence, read back."""
    path = fresh_path(spark, "shards")
    materialise(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    schema = "slot long, shard long, byte_offset long, sequence_id long, ids_crc32 long"
    return _records(spark, path, manifest(spark, path), 0, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), schema)
