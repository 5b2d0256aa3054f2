"""SimHash near-dedup of texts by the similarity of their word shingles, with Golay keys: the stage of the pipeline.

Texts that share four fifths of their five-word shingles have SimHash bits that differ with a probability of about 0.15,
too many for the three-bit links of simhash.py. So the fingerprint has 512 bits. Pairs of its 23-bit segments make
TABLES tables; a text stands in each with the products of both segments' Golay keys (28 on average, see simhash.py).
With a bit error of 0.15 two segments share a key with a probability of 0.61, so eight tables miss two or three pairs
of a hundred just at 0.8, one at 0.83 and fewer above. What shares a key is compared by 128 bits in its task, what remains
by 512 bits, and what may still be similar enough by the shingles themselves.

Short runs of texts with one key give all their pairs. A longer run falls into crowds, which are connected by near enough
bits. A small crowd gives all its near pairs, a large one at first a minimum spanning tree of its bit distances; of all
the trees a text is in, through its many keys, only its NEAREST nearest links go on, so that dense groups need a few links
for each text. Once the trees' links are verified, each crowd whose texts are
not all in one group gives every near pair of texts of different groups, and these are verified too: the groups are those
that all near pairs give. Runs too long for one task are parted into blocks, and
pairs of blocks are tasks of their own. A pair of blocks that
is still too long is parted again, until none is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_arrow_batches, written
from .graph import components
from .simhash import segment_keys, shingle_hashes

#: Words of a shingle, least similarity (Jaccard) of linked texts.
SHINGLE, SIMILAR = 5, 0.8
WORDS, TABLES, SEGMENT = 8, 8, 23
#: Most differing bits of the first 128, and of all 512, for texts that may be similar enough: each more than two
#: standard deviations above what a similarity of 0.8 gives.
NEAR_128, NEAR_512 = 28, 96
#: Runs and crowds up to this give all their pairs; runs over 2 * LARGE_RUN are parted into blocks of about half of it.
SHORT_RUN, LARGE_RUN = 4, 4096
#: Links of a text in the trees of large crowds that are verified before its crowds are looked at as a whole.
NEAREST = 3


def long_print(hashes: np.ndarray) -> np.ndarray:
    """512-bit SimHash as eight uint64; the further words take bits of hashes of the shingle's hash."""
    out = np.zeros(WORDS, np.uint64)
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        for k in range(WORDS):
            x = part + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            octets = (x ^ (x >> np.uint64(31))).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts[k] += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    for k in range(WORDS):
        out[k] = np.packbits(2 * counts[k] > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _segments(prints: np.ndarray) -> np.ndarray:
    """The first 2 * TABLES segments of 23 bits of each row of eight words."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    parts = bits[:, : 2 * TABLES * SEGMENT].reshape(len(prints), 2 * TABLES, SEGMENT)
    return parts.astype(np.int64) @ (1 << np.arange(SEGMENT, dtype=np.int64))


def _make_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hashes = np.unique(shingle_hashes(text, SHINGLE))
            if len(hashes):
                nodes.append(node)
                prints.append(long_print(hashes).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(prints, pa.binary())], ["node", "print"])


def _make_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, prints = batch.column(0).to_numpy(), np.array([np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()], np.uint64).reshape(-1, WORDS)
        for at in range(0, len(nodes), 500):
            node, p = nodes[at : at + 500], prints[at : at + 500]
            keys = segment_keys(_segments(p))  # rows, segments, six keys of which the last may repeat
            fresh = np.concatenate([np.ones((*keys.shape[:2], 1), bool), keys[:, :, 1:] != keys[:, :, :-1]], axis=2)
            table = np.arange(TABLES, dtype=np.int64)[None, :, None, None] << 24
            both = table | keys[:, 0::2, :, None] << 12 | keys[:, 1::2, None, :]
            valid = fresh[:, 0::2, :, None] & fresh[:, 1::2, None, :]
            owner = np.broadcast_to(np.arange(len(node))[:, None, None, None], both.shape)[valid]
            halves = p[:, :2].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[valid]), *map(pa.array, (halves[owner, 0], halves[owner, 1], node[owner]))], ["key", "p1", "p2", "node"])


def _tree(p: np.ndarray, most: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Edges up to `most` bits of a minimum spanning tree of the rows of two words, and the rows of each part they connect."""
    far = np.full(len(p), 1000)
    parent = np.zeros(len(p), np.int64)
    left = np.ones(len(p), bool)
    at, edges, order, cuts = 0, [], [0], []
    for _ in range(len(p) - 1):
        left[at] = False
        d = np.bitwise_count(p ^ p[at]).sum(axis=1, dtype=np.int64)
        closer = left & (d < far)
        far[closer], parent[closer] = d[closer], at
        rest = np.flatnonzero(left)
        at = int(rest[far[rest].argmin()])
        if far[at] <= most:
            edges.append((at, int(parent[at])))
        else:  # all that is left is farther from all parts so far
            cuts.append(len(order))
        order.append(at)
    return edges, np.split(np.array(order, np.int64), cuts)


def _run_links(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key to candidate links u, v; rows of runs over 2 * large come out as u and their key, those of large
    crowds as u and the crowd's name, a hash of its nodes. far: the distance in bits, for links of a large crowd's tree."""
    names = ["u", "v", "key", "crowd", "far"]

    def rows_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, pa.int64())) for c in names], names)

    def out(u, v, far=None) -> pa.RecordBatch:
        columns = {"u": np.minimum(u, v), "v": np.maximum(u, v)} | ({} if far is None else {"far": far})
        found = pa.table({c: pa.array(x, pa.int64()) for c, x in columns.items()}).group_by(list(columns)).aggregate([])
        return rows_of(len(found), **{c: found[c].combine_chunks() for c in columns})

    def spilled(keys, nodes) -> pa.RecordBatch:
        return rows_of(len(nodes), u=pa.array(nodes), key=pa.array(keys))

    def crowded(nodes) -> pa.RecordBatch:
        name = int.from_bytes(hashlib.blake2b(np.sort(nodes).tobytes(), digest_size=8).digest(), "little", signed=True)
        return rows_of(len(nodes), u=pa.array(nodes), crowd=pa.array(np.full(len(nodes), name)))

    def finish(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, p, node = rows[:, 0], rows[:, 1:3].view(np.uint64), rows[:, 3]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in range(2, SHORT_RUN + 1):
            at = starts[sizes == size]
            for i, j in combinations(range(size), 2):
                near = np.bitwise_count(p[at + i] ^ p[at + j]).sum(axis=1, dtype=np.int64) <= NEAR_128
                u.append(node[at + i][near])
                v.append(node[at + j][near])
        for at, size in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
            if size > 2 * large:
                yield spilled(keys[at : at + size], node[at : at + size])
                continue
            edges, crowds = _tree(p[at : at + size], NEAR_128)
            large_crowd = np.zeros(size, bool)
            for crowd in (c for c in crowds if len(c) > SHORT_RUN):
                large_crowd[crowd] = True
                yield crowded(node[at + crowd])
            edges = np.array(edges, np.int64).reshape(-1, 2)
            edges = edges[large_crowd[edges[:, 0]]] + at
            yield out(node[edges[:, 0]], node[edges[:, 1]], np.bitwise_count(p[edges[:, 0]] ^ p[edges[:, 1]]).sum(axis=1, dtype=np.int64))
            for crowd in (at + c for c in crowds if 1 < len(c) <= SHORT_RUN):
                i, j = (crowd[x] for x in np.triu_indices(len(crowd), 1))
                near = np.bitwise_count(p[i] ^ p[j]).sum(axis=1, dtype=np.int64) <= NEAR_128
                u.append(node[i[near]])
                v.append(node[j[near]])
        yield out(np.concatenate(u), np.concatenate(v))

    kept = np.empty((0, 4), np.int64)
    going = None  # key of a run that has begun to come out
    for batch in batches:
        rows = np.concatenate([kept, np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)])
        if going is not None:
            more = int(np.searchsorted(rows[:, 0], going, side="right"))
            yield spilled(rows[:more, 0], rows[:more, 3])
            rows = rows[more:]
            going = going if not len(rows) else None
        if not len(rows):
            kept = rows
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if last:
            yield from finish(rows[:last])
        kept = rows[last:]
        if len(kept) > 2 * large:
            going = kept[0, 0]
            yield spilled(kept[:, 0], kept[:, 3])
            kept = kept[:0]
    if len(kept):
        yield from finish(kept)


def _links(keyed: DataFrame) -> DataFrame:
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key")
    return written(dealt.mapInArrow(partial(_run_links, large=LARGE_RUN), "u long, v long, key long, crowd long, far long"), "candidates")


def _parted(spilled: DataFrame, prints: DataFrame, turn: int) -> DataFrame:
    """spilled: key, node of too long runs. Their rows dealt to pairs of blocks, of about LARGE_RUN rows a pair; every two
    nodes of a run meet in at least one pair. Blocks differ by turn."""
    sizes = spilled.groupBy("key").agg(F.ceil(F.count("*") / (LARGE_RUN / 2)).cast("int").alias("blocks"))
    octets = lambda i: F.concat(*[F.substring("print", 8 * i + j, 1) for j in range(8, 0, -1)])  # noqa: E731  reverse() would take bytes for UTF-8
    word = lambda i: F.conv(F.hex(octets(i)), 16, -10).cast("long").alias(f"p{i + 1}")
    rows = spilled.join(sizes, "key").join(prints.select("node", word(0), word(1)), "node")
    block = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own != other")
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit(turn)).alias("key"), "p1", "p2", "node")


def candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prints: node, print (64 bytes). Distinct links u, v of nodes whose first 128 bits are near enough; the large crowds as
    distinct rows crowd, node: of these, links has the NEAREST links of each node in the crowds' trees only."""
    small_arrow_batches(prints.sparkSession, 20_000)
    found, every, turn = _links(prints.mapInArrow(_make_keys, "key long, p1 long, p2 long, node long")), None, 0
    while True:
        every = every.unionByName(found) if every is not None else found
        spilled = found.where("key is not null").select("key", F.col("u").alias("node"))
        if spilled.isEmpty():
            break
        found, turn = _links(_parted(spilled, prints, turn)), turn + 1
    crowds = every.where("crowd is not null").select("crowd", F.col("u").alias("node"))
    trees = every.where("far is not null").select("u", "v", "far").distinct()
    ends = trees.unionByName(trees.select(F.col("v").alias("u"), F.col("u").alias("v"), "far"))
    nearest = ends.withColumn("rn", F.row_number().over(Window.partitionBy("u").orderBy("far", "v"))).where(F.col("rn") <= NEAREST)
    links = every.where("v is not null and far is null").select("u", "v").unionByName(nearest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return links.distinct(), crowds.distinct()


def candidate_links(prints: DataFrame) -> DataFrame:
    return candidates(prints)[0]


def _crowd_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows crowd, root, node, print sorted by crowd; all pairs of nodes of a crowd with near prints and different roots."""

    def pairs(root: np.ndarray, node: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], 0
        for i in range(len(node)):
            j = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            j = j[np.bitwise_count(p[j, :2] ^ p[i, :2]).sum(axis=1, dtype=np.int64) <= NEAR_128]
            j = j[np.bitwise_count(p[j] ^ p[i]).sum(axis=1, dtype=np.int64) <= NEAR_512]
            u.append(np.minimum(node[i], node[j]))
            v.append(np.maximum(node[i], node[j]))
            n += len(j)
            if n and (n > 100_000 or i == len(node) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
                u, v, n = [], [], 0

    numbers, words = np.empty((0, 3), np.int64), np.empty((0, WORDS), np.uint64)
    for batch in batches:
        numbers = np.concatenate([numbers, np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)])
        words = np.concatenate([words, np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, WORDS)])
        starts = np.flatnonzero(np.diff(numbers[:, 0], prepend=~numbers[:1, 0])) if len(numbers) else []
        for at, end in zip(starts[:-1], starts[1:], strict=True):
            yield from pairs(numbers[at:end, 1], numbers[at:end, 2], words[at:end])
        if len(starts):
            numbers, words = numbers[starts[-1] :], words[starts[-1] :]
    yield from pairs(numbers[:, 1], numbers[:, 2], words)


def _across(crowds: DataFrame, roots: DataFrame, prints: DataFrame) -> DataFrame | None:
    """Distinct near pairs of nodes of one crowd that are in different groups; None if all crowds are within one."""
    spark = crowds.sparkSession
    rooted = written(crowds.join(roots, "node", "left").select("crowd", "node", F.coalesce("root", "node").alias("root")), "rooted")
    mixed = rooted.groupBy("crowd").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("crowd")
    rows = written(rooted.join(mixed, "crowd"), "mixed")
    discard(rooted)
    if rows.isEmpty():
        return None
    small_arrow_batches(spark, 5000)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(prints, "node").select("crowd", "root", "node", "print").repartition(parts, "crowd").sortWithinPartitions("crowd")
    return written(dealt.mapInArrow(_crowd_pairs, "u long, v long").distinct(), "across")


def _far(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        x = [np.bitwise_count(np.frombuffer(m, "<u8") ^ np.frombuffer(n, "<u8")).sum() for m, n in zip(a, b, strict=True)]
        yield pd.Series(np.array(x, np.int64))


def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([np.unique(shingle_hashes(t, SHINGLE)).view(np.int64) for t in texts])


def _similar(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The links u, v of texts that are similar by their shingles."""
    small_arrow_batches(links.sparkSession, 1000)
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = texts.join(nodes, "node").select("node", F.pandas_udf(_sets, "array<long>")("text").alias("s"))
    sets = written(sets.dropDuplicates(["node"]), "sets")
    a, b = (sets.select(F.col("node").alias(n), F.col("s").alias(f"s_{n}")) for n in ("u", "v"))
    common = F.size(F.array_intersect("s_u", "s_v"))
    similar = common >= SIMILAR * (F.size("s_u") + F.size("s_v") - common)
    found = written(links.join(a, "u").join(b, "v").where(similar).select("u", "v"), "similar")
    discard(sets)
    return found


def similar_groups(texts: DataFrame) -> DataFrame:
    """texts: node (long, one number for equal texts), text. Returns node, root for nodes of groups of more than one: texts linked by
    a Jaccard similarity of their five-word shingles of at least 0.8. Texts without words are in no group."""
    spark = texts.sparkSession
    small_arrow_batches(spark, 1000)
    prints = texts.select("node", "text").mapInArrow(_make_prints, "node long, print binary")
    prints = written(prints.groupBy("node").agg(F.max("print").alias("print")), "prints")
    links, crowds = candidates(prints)
    a, b = (prints.select(F.col("node").alias(n), F.col("print").alias(f"print_{n}")) for n in ("u", "v"))
    far = F.pandas_udf(_far, "long")("print_u", "print_v")
    links = written(links.join(a, "u").join(b, "v").where(far <= NEAR_512).select("u", "v"), "near")
    verified = _similar(links, texts)
    roots = components(verified)
    across = _across(crowds, roots, prints)
    if across is not None:
        roots = components(verified.unionByName(_similar(across, texts)))
    discard(prints)
    return roots


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of equal or similar texts the row with the least key (null last; ties by text, then any of rows
    that agree in both). Null and empty texts are equal to one another. Columns stay as they are; an empty table gives
    an empty result. Texts are named by a 64-bit hash; two texts with one hash are told apart by a second one and named
    by both.
    """
    whole = F.coalesce(F.col("doc").getField(text), F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumns({"_node": F.xxhash64(whole), "_other": F.xxhash64(F.lit("other"), whole)})
    order = F.struct(F.col("doc").getField(key).isNull().alias("none"), F.col("doc").getField(key).alias("k"))
    first_of = [F.min(order).alias("first"), F.count("*").alias("n"), F.count_distinct(order).alias("keys"), F.min("_other").alias("a"), F.max("_other").alias("b")]
    firsts = written(named.groupBy("_node").agg(*first_of), "firsts")
    if not (collided := firsts.where("a != b").select("_node", F.lit(True).alias("_collided"))).isEmpty():
        both = F.when(F.col("_collided"), F.xxhash64("_node", "_other")).otherwise(F.col("_node"))
        named = named.join(collided, "_node", "left").select("doc", both.alias("_node"), "_other")
        firsts = written(named.groupBy("_node").agg(*first_of), "firsts")
    groups = similar_groups(named.select(F.col("_node").alias("node"), whole.alias("text")))
    rooted = firsts.join(groups, firsts["_node"] == groups["node"], "left").select("_node", "first", F.coalesce("root", "_node").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct("first", "_node")).alias("best")).select(F.col("best._node").alias("_node"), F.col("best.first").alias("_first"))
    kept = named.join(written(best, "best"), "_node").where(order.eqNullSafe(F.col("_first"))).drop("_first")
    if not firsts.where("n > keys").isEmpty():  # rows that agree in key and text
        kept = kept.dropDuplicates(["_node"])
    return kept.select("doc.*")
