"""SimHash near-dedup with Golay codes.

A 64-bit fingerprint is parted into three segments of 22, 21 and 21 bits, each read as a word of the binary Golay code
of length 23. That code is perfect: every word has exactly one codeword within three bits. The keys of a segment are
the codewords that it and its 23 neighbours decode to, at most six. Two segments that differ in at most two bits share
a key: what lies half-way between them is a neighbour of both.

Fingerprints that differ in at most three bits have segments with at most two errors each, and share a key in all
three; or one segment has all three errors, and the other two agree exactly. So each fingerprint gets the products of
its segments' keys (36 bits each) and three keys of two whole segments; what shares a key is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_arrow_batches, table, written
from .graph import components

SEED = 42
#: Words of a shingle, and the most bits in which linked fingerprints differ.
SHINGLE, BITS = 3, 3
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code of length 23.
GENERATOR = 0b110001110101
SEGMENTS = (22, 21, 21)
#: A run of more fingerprints than this with one key isn't compared pair by pair in one task but goes to in_balls().
LARGE_RUN = 4096


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of every shingle of n words, repeats included; of all words if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes both concern ASCII only
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)] if words else []
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: Column, n: int = SHINGLE) -> Column:
    """The 64-bit SimHash of a whole text as a (signed) long; null counts as empty."""

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(shingle_hashes(t, n)) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(make, "long")(text)


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Of each word of 23 bits the syndrome, by its low 12 and high 11 bits; and by syndrome the words that turn a word
    with it into the codewords of its neighbours, at most six, the last repeated."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    bits = np.array([remainder(1 << i) for i in range(23)])
    numbers = np.arange(1 << 12)
    parts = np.zeros((2, 1 << 12), np.int64)
    for i in range(23):
        parts[i // 12] ^= np.where(numbers >> (i % 12) & 1, bits[i], 0)
    error = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            error[np.bitwise_xor.reduce(bits[list(places)])] = sum(1 << p for p in places)
    turns = np.empty((1 << 11, 6), np.int64)
    for s in range(1 << 11):
        found = sorted({int(error[s]), *(int(1 << i ^ error[s ^ bits[i]]) for i in range(23))})
        turns[s] = (found + found[-1:] * 6)[:6]
        assert len(found) <= 6
    return parts, turns


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Six codeword indices (12 bits each) for each word of up to 23 bits, along a last axis; the last may repeat."""
    parts, turns = _patterns()
    syndrome = parts[0][words & 0xFFF] ^ parts[1][words >> 12]
    return (words[..., None] ^ turns[syndrome]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints: the number of each one's fingerprint, and the key as int64."""
    segments, shift = [], 0
    for width in SEGMENTS:
        segments.append((prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    # the last of six repeats where there are fewer; the first of equal ones counts
    each = [segment_keys(s) for s in segments]
    fresh = [np.concatenate([np.ones((len(k), 1), bool), k[:, 1:] != k[:, :-1]], axis=1) for k in each]
    products = (each[0][:, :, None, None] << 24) | (each[1][:, None, :, None] << 12) | each[2][:, None, None, :]
    valid = fresh[0][:, :, None, None] & fresh[1][:, None, :, None] & fresh[2][:, None, None, :]
    owner = np.broadcast_to(np.arange(len(prints))[:, None, None, None], products.shape)
    exact = [(kind + 1 << 48) | (segments[i] << 22) | segments[j] for kind, (i, j) in enumerate(combinations(range(3), 2))]
    return np.concatenate([owner[valid], *[np.arange(len(prints))] * 3]), np.concatenate([products[valid], *exact])


def ball(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words within two bits of each fingerprint, with the number of the fingerprint."""
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    words = prints[:, None] ^ np.array(masks, np.uint64)
    return np.repeat(np.arange(len(prints)), len(masks)), words.ravel().view(np.int64)


def _keyed(make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), rows):
                part = prints[at : at + rows]
                owner, key = make(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[owner])], ["key", "print"])

    return run


def _links(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints of one run that keep it connected as all its links would: at most one for each of many."""
    size = len(prints)
    words = prints.view(np.uint64)
    label = np.arange(size)
    while True:
        least = label.copy()
        for at in range(0, size, 512):
            near = np.bitwise_count(words[at : at + 512, None] ^ words[None, :]) <= bits
            least[at : at + 512] = np.where(near, label[None, :], size).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    linked = np.flatnonzero(label != np.arange(size))
    return prints[linked], prints[label[linked]]


def _verified(bits: int, large: int):
    """From rows sorted by key and print to links u, v; prints of runs over `large` come out with v null."""

    def of_runs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        u, v, hot = [], [], []
        for size in range(2, 9):  # runs of few: every pair at once
            at = starts[sizes == size]
            for i, j in combinations(range(size), 2):
                a, b = prints[at + i], prints[at + j]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= bits
                u.append(a[near])
                v.append(b[near])
        for at, size in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            run = prints[at : at + size]
            if size > large:
                hot.append(run)
            else:
                a, b = _links(run, bits)
                u.append(a)
                v.append(b)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return join(u), join(v), join(hot)

    def batch_of(u: np.ndarray, v: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
        links = pa.table({"u": u, "v": v}).group_by(["u", "v"]).aggregate([])
        both = [pa.concat_arrays([links["u"].combine_chunks(), pa.array(hot)]), pa.concat_arrays([links["v"].combine_chunks(), pa.nulls(len(hot), pa.int64())])]
        return pa.RecordBatch.from_arrays(both, ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = prints = np.empty(0, np.int64)
        spilling = None  # key of a run over `large` whose prints so far have come out
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if spilling is not None:
                more = np.searchsorted(keys, spilling, side="right")
                yield batch_of(keys[:0], keys[:0], prints[:more])
                keys, prints = keys[more:], prints[more:]
                if len(keys):
                    spilling = None
            if not len(keys):
                continue
            last = np.searchsorted(keys, keys[-1])  # the last run may go on in the next batch
            yield batch_of(*of_runs(keys[:last], prints[:last]))
            keys, prints = keys[last:], prints[last:]
            if len(keys) > large:
                spilling = keys[0]
                yield batch_of(keys[:0], keys[:0], prints)
                keys = prints = keys[:0]
        if len(keys):
            yield batch_of(*of_runs(keys, prints))

    return run


def _pairs(prints: DataFrame, make, rows: int, bits: int, large: int) -> DataFrame:
    spark = prints.sparkSession
    keyed = prints.mapInArrow(_keyed(make, rows), "key long, print long")
    dealt = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "print")
    return written(dealt.mapInArrow(_verified(bits, large), "u long, v long"), "links")


def near_links(prints: DataFrame, bits: int = BITS, large: int = LARGE_RUN) -> DataFrame:
    """prints: distinct 64-bit fingerprints (long). Returns u, v: links between fingerprints that differ in at most
    `bits` (3 or fewer) bits, such that all linked ones are connected. No cap: runs over `large` are compared anew by the
    words within two bits of each fingerprint, of which two fingerprints at most three bits apart share one; at most
    2081 fingerprints have any one such word."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find up to 3 differing bits")
    small_arrow_batches(prints.sparkSession, 50_000)
    found = _pairs(prints, golay_keys, 500, bits, large)
    hot = found.where("v is null").select(F.col("u").alias("print")).distinct()
    links = found.where("v is not null")
    if hot.isEmpty():
        return links
    return links.unionByName(_pairs(written(hot, "hot"), ball, 50, bits, 1 << 12).where("v is not null"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Add fingerprint (16 hex digits) and component_id (the least key that can be reached over links) to (key, text).

    Null and empty texts and texts without words have fingerprint zero, which links like any other. Null keys don't count
    as least; a component with no other key has null. Repeated rows and equal texts share their fingerprint. Empty
    table: empty result. Only the key, fingerprint and component_id are returned.
    """
    small_arrow_batches(docs.sparkSession)
    prints = written(docs.select(F.col(f"`{key}`").alias("_k"), simhash(F.col(f"`{text}`"), n).alias("print")), "prints")
    least = written(prints.groupBy("print").agg(F.min("_k").alias("least")), "least")
    roots = components(near_links(least.select("print"), bits))
    rooted = least.join(roots, least["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(ids, "root").select("print", "component_id")
    return prints.join(ids, "print").select(F.col("_k").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
