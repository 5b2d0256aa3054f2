"""Phrase mining by the partition algorithm of Savasere, Omiecinski and Navathe (SON), and scores of collocations.

First pass: a shard is as many texts as a task can hold as numbers (SHARD_BYTES). It is mined completely, phrases of one
word first and longer ones from those whose parts are frequent, at a support s lowered in proportion to its share of the
language's words. A shard that doesn't report a phrase has it s - 1 times at most. So what the shards report, put together, bounds
each phrase's count from above; a phrase whose bound reaches the global count is a candidate. With more shards than the
global count, s is one, and the bound is the count itself.

More shards have a lower s each, and report many more phrases. So the reports are put together in counters, not in rows: a
phrase adds to two counters that its hash names, which stop at the global count, and the lesser one bounds it from above.
A task hands on all its counters, 32 MB before they are compressed, however much its shards report.

Second pass: the counters are the filter, of a fixed size at any size of the corpus; nothing else is broadcast. Each shard
counts every phrase whose bound reaches the global count, and the counts are added up exactly. What passes by chance, for
its counters are shared, is counted like the others and falls to the global count.

Beyond some 50 shards (1.2 GB) a support of 100 is two or one in a shard: nearly every phrase is frequent in some shard, and
adds to the counters until most of them reach 100. The first pass is made for each size then, at a support of one: a shard reports
the phrases of that size whose two shorter parts may be frequent in the whole corpus, and not only in the shard. Of the counters
a bit each stays, that they have reached the global count (4 MB), and these bits are the filter of the next size and of the second pass.
From some 7 GB on counters and texts of a task double with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_hot, table, written

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Text bytes of a shard, about; a worker takes about ten times as much at most.
SHARD_BYTES = 24_000_000
#: Shards of a task, where there are more shards than cores; and rows of counts that a task of the second pass adds up before it
#: hands them on.
SHARDS, ROWS = 8, 1_500_000
#: Keys are numbered in so many slices, for tables of a fraction of the size.
SLICES = 16
#: Counters of each of the filter's two rows, as a power of two: of a byte each, 32 MB; and of a block of them, that is handed on as one.
FILTER_BITS, BLOCK_BITS = 24, 16
#: Local supports up to this prune too little: the shards are mined size by size.
LOW_SUPPORT = 2
#: All words on a counter, on average, as a share of the global count; beyond that the filter grows.
LOAD = 0.85
#: What ends a piece, and a word.
ENDS, SPACES = ".,;:!?\n\v\f\r", " \t"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Languages with a smaller share of all words than this are mined at a support of one, so that no more than its inverse go along.
RARE = 1000
#: Low bits of a phrase's hash that hold its language's number (from 1; 0: a rare one).
LANG_BITS = 10

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in SPACES]] = 1
_KIND[[ord(c) for c in ENDS]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(UNKNOWN))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A number from 0 for each distinct key."""
    numbers, distinct = np.empty(len(keys), np.int32), 0
    slices = (keys % SLICES).astype(np.int8)
    for i in range(SLICES):
        own = np.flatnonzero(slices == i)
        found, names = pd.factorize(keys[own])
        numbers[own] = found + distinct
        distinct += len(names)
    return numbers, distinct


class Shard:
    """Words of some texts in order: number of the word, piece, language."""

    def __init__(self, langs: pa.StringArray, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        kind = _KIND[data]
        stops = np.flatnonzero(kind == 2).astype(np.int32)
        inside = kind == 0
        del kind
        edge = inside.copy()  # where words begin, also behind a text that ends in one
        edge[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        edge[at] = inside[at]
        starts = np.flatnonzero(edge).astype(np.int32)
        edge[:] = inside  # where they end
        edge[:-1] &= ~inside[1:]
        at = offsets[1:][offsets[1:] > 0] - 1
        edge[at] = inside[at]
        bounds = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(np.flatnonzero(edge).astype(np.int32) - starts + 1, out=bounds[1:])
        del edge
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_FOLD[data[inside]])])
        del inside, data
        coded = words.dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        del words, coded, bounds
        doc = np.searchsorted(offsets, starts, side="right")
        self.piece = (np.searchsorted(stops, starts) + doc).astype(np.int32)  # both only grow, so a piece has one sum
        names = langs.dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy(zero_copy_only=False)[doc - 1]
        self.n_words = np.bincount(self.lang, minlength=len(self.langs))

    def hashes(self, at: np.ndarray, size: int, numbers: dict[str, int]) -> np.ndarray:
        """Of the phrases of `size` words that begin at `at`: a hash of language and words, alike in every shard, with the
        language's number in its LANG_BITS low bits; what is above them is never 0."""
        if not hasattr(self, "_of_word"):
            self._of_word = np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
            self._of_lang = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed=1) for x in self.langs), np.uint64, len(self.langs))
        own = np.array([numbers.get(x, 0) for x in self.langs], np.uint64)
        lang = self.lang[at]
        h = self._of_lang[lang]
        for i in range(size):
            h = (h ^ (h >> np.uint64(31))) * _MIX + self._of_word[self.word[at + i]]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = np.maximum((h ^ (h >> np.uint64(27))) >> np.uint64(LANG_BITS), np.uint64(1)) << np.uint64(LANG_BITS)
        return h | own[lang]

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.word[at + i])) for i in range(size)]
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string()) if size > 1 else parts[0].cast(pa.string())

    def levels(self, longest: int, keep: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """size, first places and counts of the distinct phrases of each size that keep(first places, counts, size) marks; longer
        ones only from those whose two shorter parts it has marked."""
        n = len(self.word)
        code = np.full(n, -1, np.int32)  # number of the kept phrase that begins at a place
        places, keys = np.arange(n, dtype=np.int32), self.lang.astype(np.int64) * max(1, len(self.words)) + self.word
        for size in range(1, longest + 1):
            numbers, distinct = _numbered(keys)
            del keys
            counts = np.bincount(numbers, minlength=distinct)
            first = np.empty(distinct, np.int32)
            first[numbers[::-1]] = places[::-1]  # the earliest is written last
            kept = keep(first, counts, size)
            yield size, first[kept], counts[kept]
            if size == longest or not kept.any():
                return
            code[:] = -1
            code[places] = np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32)[numbers]
            del numbers, counts, first
            places = np.flatnonzero((code[: n - size] >= 0) & (code[1 : n - size + 1] >= 0) & (self.piece[: n - size] == self.piece[size:])).astype(np.int32)
            keys = code[places].astype(np.int64) * int(kept.sum()) + code[places + 1]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    waiting, size = [], 0

    def made() -> Shard:
        langs, texts = (pa.concat_arrays([b.column(i) for b in waiting]) for i in range(2))
        waiting.clear()
        return Shard(langs, texts)

    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            rows = batch.slice(at, 100)
            waiting.append(rows)
            size += pc.sum(pc.binary_length(rows.column(1))).as_py() or 0
            if size >= most:
                size = 0
                yield made()
                pa.default_memory_pool().release_unused()
    if waiting:
        yield made()


def _places(hashes: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each phrase in each row of the filter."""
    return (hashes >> np.uint64(LANG_BITS) & np.uint64((1 << filter_bits) - 1)).astype(np.int64), (hashes >> np.uint64(64 - filter_bits)).astype(np.int64)


def _raise(counters: np.ndarray, places: np.ndarray, by: np.ndarray, most: int) -> None:
    """Add to counters, which stop at `most`."""
    own, which = np.unique(places, return_inverse=True)
    counters[own] = np.minimum(counters[own] + np.bincount(which, np.minimum(by, most), len(own)), most)


def _added(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[pa.RecordBatch]:
    """Rows that agree in all but `value` added up, as far as ROWS of them hold them."""
    held: list[pa.Table] = []

    def add() -> pa.Table:
        whole = pa.concat_tables(held)
        names = whole.column_names
        return whole.group_by([c for c in names if c != value]).aggregate([(value, "sum")]).rename_columns([*[c for c in names if c != value], value]).select(names)

    rows = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows > ROWS:
            held = [add()]
            rows = held[0].num_rows
            if rows > ROWS // 2:
                yield from held[0].to_batches(100_000)
                held, rows = [], 0
    if held:
        yield from add().to_batches(100_000)


def _mine(totals: dict[str, int], numbers: dict[str, int], least: int, longest: int, filter_bits: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First pass: the counters of a task in blocks, numbered from 0, of what its shards report: each phrase that is frequent
    in a shard, with its count there less s - 1. And block -1, the sum of s - 1 by number of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, missed = np.zeros((2, 1 << filter_bits), np.min_scalar_type(least)), np.zeros(1 << LANG_BITS, np.int64)
        for shard in _shards(batches, shard_bytes):
            unseen = np.array([-(-least * int(n) // totals[lang]) - 1 if lang in totals else 0 for lang, n in zip(shard.langs, shard.n_words, strict=True)], np.int64).clip(0)
            for i, lang in enumerate(shard.langs):
                if lang in numbers:
                    missed[numbers[lang]] += unseen[i]
            for size, first, counts in shard.levels(longest, lambda first, counts, _, s=shard, u=unseen: counts > u[s.lang[first]]):
                for at in range(0, len(first), 200_000):
                    part = first[at : at + 200_000]
                    excess = counts[at : at + 200_000] - unseen[shard.lang[part]]
                    for row, places in zip(counters, _places(shard.hashes(part, size, numbers), filter_bits), strict=True):
                        _raise(row, places, excess, least)
        yield _block(-1, missed)
        blocks = counters.reshape(-1, 1 << min(BLOCK_BITS, filter_bits))
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield _block(int(i), blocks[i])

    return run


def _block(number: int, counters: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([counters.tobytes()])], ["block", "counters"])


def _blocks_added(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of one number added up, row by row; a task holds one of each number at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = np.frombuffer(data.as_buffer(), np.int64 if number < 0 else np.min_scalar_type(least))
                if number not in sums:
                    sums[number] = block.copy()
                elif number < 0:
                    sums[number] += block
                else:
                    sums[number] = np.minimum(sums[number].astype(np.int64) + block, least).astype(block.dtype)
        for number, block in sums.items():
            yield _block(number, block)

    return run


def _count(shared, missed: np.ndarray, numbers: dict[str, int], least: int, longest: int, filter_bits: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second pass: how often each phrase of the filter occurs in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.frombuffer(shared.value, np.min_scalar_type(least)).reshape(2, -1)

        def held(h: np.ndarray) -> np.ndarray:
            bound = np.minimum(*(row[places] for row, places in zip(counters, _places(h, filter_bits), strict=True)))
            return bound + missed[(h & np.uint64((1 << LANG_BITS) - 1)).astype(np.int64)] >= least

        def passing(shard: Shard, first: np.ndarray, size: int) -> np.ndarray:
            return np.concatenate([np.zeros(0, bool), *(held(shard.hashes(first[at : at + 200_000], size, numbers)) for at in range(0, len(first), 200_000))])

        for shard in _shards(batches, shard_bytes):
            for size, first, counts in shard.levels(longest, lambda first, _, size, s=shard: passing(s, first, size)):
                yield from _rows(shard, first, counts, size)

    return run


def _rows(shard: Shard, first: np.ndarray, counts: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(first), 50_000):
        part = first[at : at + 50_000]
        names = pa.array(shard.langs, pa.string()).take(pa.array(shard.lang[part]))
        yield pa.RecordBatch.from_arrays([names, shard.phrases(part, size), pa.array(np.full(len(part), size, np.int32)), pa.array(counts[at : at + 50_000])], ["lang", "phrase", "size", "f"])


def _held(shared, filter_bits: int) -> Callable[[Shard, np.ndarray, int], np.ndarray]:
    """Which phrases of a shard (first places, size) have their bits in both rows of a filter."""
    rows = np.frombuffer(shared.value, np.uint8).reshape(2, -1)

    def both(h: np.ndarray) -> np.ndarray:
        return np.logical_and(*(row[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1 for row, places in zip(rows, _places(h, filter_bits), strict=True)))

    return lambda shard, first, size: np.concatenate([np.zeros(0, bool), *(both(shard.hashes(first[at : at + 200_000], size, {})) for at in range(0, len(first), 200_000))])


def _mine_size(shared, wanted: int, least: int, filter_bits: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First pass, one size: the counters of a task, in blocks, of all phrases of `wanted` words whose shorter parts the filter
    holds; that is a local support of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held = np.zeros((2, 1 << filter_bits), np.min_scalar_type(least)), _held(shared, filter_bits)
        for shard in _shards(batches, shard_bytes):
            for size, first, counts in shard.levels(wanted, lambda first, _, size, s=shard: np.ones(len(first), bool) if size == wanted else held(s, first, size)):
                for at in range(0, len(first) if size == wanted else 0, 200_000):
                    hashes = shard.hashes(first[at : at + 200_000], size, {})
                    for row, places in zip(counters, _places(hashes, filter_bits), strict=True):
                        _raise(row, places, counts[at : at + 200_000], least)
        blocks = counters.reshape(-1, 1 << min(BLOCK_BITS, filter_bits))
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield _block(int(i), blocks[i])

    return run


def _count_held(shared, longest: int, filter_bits: int, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second pass after _mine_size(): how often each phrase that the filter holds occurs in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(shared, filter_bits)
        for shard in _shards(batches, shard_bytes):
            for size, first, counts in shard.levels(longest, lambda first, _, size, s=shard: held(s, first, size)):
                yield from _rows(shard, first, counts, size)

    return run


def word_totals(docs: DataFrame) -> DataFrame:
    """docs: lang, text. Words and bytes of each language: lang, total, n_bytes."""
    return docs.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("total"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


def frequent_phrases(docs: DataFrame, totals: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, filter_bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES, size_by_size: bool | None = None) -> DataFrame:
    """docs: lang, text (neither null). lang, phrase, size, f of every phrase of up to `longest` words that occurs `least` times or
    more in its language; written. totals: see word_totals(). size_by_size: None where a shard's support is too low."""
    spark = docs.sparkSession
    whole, size = totals.agg(F.sum("total"), F.sum("n_bytes")).first()
    known = {r.lang: r.total for r in totals.where(F.col("total") * RARE > (whole or 0)).collect()}  # RARE of them at most
    numbers = {lang: i + 1 for i, lang in enumerate(sorted(known))}
    shards = max(1, math.ceil((size or 0) / shard_bytes))
    if -(-least // shards) <= LOW_SUPPORT if size_by_size is None else size_by_size:
        return _by_size(docs, whole or 0, shards, least, longest, filter_bits, shard_bytes)
    # tasks hold whole shards, and more than one where there are more than cores: they add up what they find
    docs = docs.coalesce(max(min(shards, spark.sparkContext.defaultParallelism), math.ceil(shards / SHARDS)))
    mine = _mine(known, numbers, least, longest, filter_bits, shard_bytes)
    counters, missed = _collected(docs.mapInArrow(mine, "block int, counters binary"), least, filter_bits)
    shared = spark.sparkContext.broadcast(counters.tobytes())
    del counters
    return _summed(docs, _count(shared, missed, numbers, least, longest, filter_bits, shard_bytes), least)


def _collected(blocks: DataFrame, least: int, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of all tasks added up: the counters of both rows of the filter, and block -1."""
    mined = blocks.repartition("block").mapInArrow(_blocks_added(least), "block int, counters binary").toArrow()
    width = min(BLOCK_BITS, filter_bits)
    counters, missed = np.zeros((2 << filter_bits >> width, 1 << width), np.min_scalar_type(least)), np.zeros(1 << LANG_BITS, np.int64)
    for number, data in zip(mined.column("block").to_pylist(), mined.column("counters"), strict=True):
        if number < 0:
            missed = np.frombuffer(data.as_buffer(), np.int64)
        else:
            counters[number] = np.frombuffer(data.as_buffer(), counters.dtype)
    return counters, missed


def _summed(docs: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], least: int) -> DataFrame:
    counts = docs.mapInArrow(lambda rows: _added(count(rows), "f"), "lang string, phrase string, size int, f long")
    return written(counts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "frequent")


def _by_size(docs: DataFrame, whole: int, shards: int, least: int, longest: int, filter_bits: int, shard_bytes: int) -> DataFrame:
    """frequent_phrases() where the local support is one: the first pass is made for each size. What it has of a size adds up to no
    more than all words, so that with LOAD of `least` on a counter by chance few phrases pass that aren't frequent."""
    more = max(0, math.ceil(math.log2(max(1, whole) / (LOAD * least)) - filter_bits))
    filter_bits += more
    docs = docs.coalesce(max(min(shards, docs.sparkSession.sparkContext.defaultParallelism), math.ceil(shards / (SHARDS << more))))
    bits = np.zeros((2, 1 << max(filter_bits - 3, 0)), np.uint8)
    for size in range(1, longest + 1):
        shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
        counters, _ = _collected(docs.mapInArrow(_mine_size(shared, size, least, filter_bits, shard_bytes), "block int, counters binary"), least, filter_bits)
        bits |= np.packbits(counters.reshape(2, -1) >= least, axis=1)
        shared.unpersist()
        del counters
    return _summed(docs, _count_held(docs.sparkSession.sparkContext.broadcast(bits.tobytes()), longest, filter_bits, shard_bytes), least)


def score_cuts(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every frequent phrase of two words or more, by its lowest-scoring cut."""
    phrases = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    first = F.expr("substring_index(phrase, ' ', k)")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), first.alias("part")), F.struct(F.lit("r").alias("side"), F.expr("substring_index(phrase, ' ', k - size)").alias("part"))))
    asked = written(cuts.withColumn("x", sides).select("lang", "phrase", "a", "k", "x.side", "x.part"), "cuts")
    parts = asked.groupBy("lang", "part").agg(F.count("*").alias("n")).join(frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = join_hot(asked, written(parts, "parts"), ["lang", "part"], ["phrase", "k"]).groupBy("lang", "phrase", "a", "k")
    both = both.agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    sizes = both.groupBy("lang").agg(F.count("*").alias("n")).join(totals.select("lang", "total"), "lang")
    scored = join_hot(both, written(sizes, "sizes"), ["lang"], ["phrase"]).withColumnRenamed("total", "words").drop("n").withColumnRenamed("words", "n")
    exact = F.expr("(cast(1000 * a as decimal(38, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(38, 0)) * cast(r as decimal(20, 0)))")
    lowest = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("x")
    return scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def within_longer(frequent: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase of those that a longer frequent one contains with 100 * f(longer) >= share * f(phrase)."""
    words = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))))")
    subs = frequent.where("size > 2").withColumn("w", words).select("lang", F.explode(inner).alias("phrase"), "f")
    longer = subs.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return frequent.join(longer, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, filter_bits: int = FILTER_BITS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, then a (both descending), then phrase.

    Texts are lower-cased (A-Z) and parted at ENDS; words are parted by SPACES. Null and empty texts have no words; a null
    language counts as `und`. Repeated rows count each time. A table without a phrase of `least` occurrences, or without
    rows, gives an empty result. Other columns of docs aren't read.
    """
    rows = docs.select(language(F.col(f"`{lang}`")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    totals = written(word_totals(rows), "totals")
    frequent = frequent_phrases(rows, totals, least, longest, filter_bits, shard_bytes)
    scored = score_cuts(frequent, totals).join(within_longer(frequent), ["lang", "phrase"], "left_anti")
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", at.cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS size) WHERE len(w) >= size),
f AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.k, k.a, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * k.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ') JOIN n ON n.lang = k.lang),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM x) WHERE rn = 1),
z AS (SELECT lang, unnest(range(1, size - m + 2)) AS i, m, w, a FROM c, (SELECT unnest(range(2, {LONGEST})) AS m) WHERE m < size),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM z GROUP BY ALL),
kept AS (SELECT y.* FROM y LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
