"""Product codes of vectors; the nearest codebook entry is found by a GNAT over the entries.

A GNAT (geometric near-neighbour access tree) has at each node a few split points; every other entry below the node
belongs to its nearest split point, and for each pair (split point, child) the node holds the least and the greatest
distance from the split point to the entries of that child. A query is compared with the split points of a node in
turn. What it knows then, its distance to a split point and the best distance so far, rules out each child whose whole
range is farther from it than the best by the triangle inequality. Entries are integers: squared distances are exact,
their roots are rounded down for lower bounds and up for upper ones, and a child goes only if the lower bound is above
the best distance strictly, so that an equal one with a lower index is never lost.

The codebooks are trained by rounds of assigning and averaging. They are a fixed number of integers (parts x entries x
width), so they and the trees over them go to every task; of the vectors nothing but sums by part and entry comes back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a node, and the number of entries up to which a node is a leaf.
SPLITS, LEAF = 6, 6
#: Integer components beyond this are refused: sums of squared differences would leave 64 bits.
MOST = 1 << 26


@dataclass
class Node:
    """Entries of a subtree. splits: their numbers; lo and hi: least and greatest squared distance from a split point (row) to
    the entries of a child (column), itself counted; children: what belongs to each split point but itself."""

    splits: np.ndarray
    lo: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    hi: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    children: list[Node | None] = field(default_factory=list)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _down(square: np.ndarray) -> np.ndarray:
    """A float not above the root of an integer below 2 ** 62 (its conversion to a float is off by half a unit at most)."""
    return np.maximum(0.0, np.sqrt(square.astype(np.float64)) * (1 - 4e-16 * 2))


def _up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + 4e-16 * 2)


def build(entries: np.ndarray, numbers: np.ndarray | None = None) -> Node:
    """The tree over entries (rows of integers). Split points are chosen far from each other, first the one of least number."""
    numbers = np.arange(len(entries)) if numbers is None else numbers
    if len(numbers) <= LEAF:
        return Node(numbers)
    chosen = [0]
    far = squared(entries[numbers], entries[numbers[0]])
    while len(chosen) < SPLITS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(entries[numbers], entries[numbers[chosen[-1]]]))
    if len(chosen) == 1:  # all are equal: the least number stands for them
        return Node(numbers[:1])
    splits = numbers[chosen]
    d = squared(entries[numbers][None, :, :], entries[splits][:, None, :])
    owner = d.argmin(axis=0)
    owner[chosen] = np.arange(len(chosen))
    lo, hi = (np.zeros((len(chosen), len(chosen)), np.int64) for _ in range(2))
    children = []
    for j in range(len(chosen)):
        own = owner == j
        lo[:, j], hi[:, j] = d[:, own].min(axis=1), d[:, own].max(axis=1)
        own[chosen[j]] = False
        children.append(build(entries, numbers[own]) if own.any() else None)
    return Node(splits, _down(lo), _up(hi), children)


def nearest(tree: Node, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each query (rows of integers) the nearest entry's number, the lower of equally near ones, its squared distance, and how
    many distances were computed in all."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    at = np.full(len(queries), len(entries))
    compared = 0

    def see(rows: np.ndarray, number: int) -> np.ndarray:
        nonlocal compared
        compared += len(rows)
        d = squared(queries[rows], entries[number])
        better = (d < best[rows]) | (d == best[rows]) & (number < at[rows])
        best[rows[better]], at[rows[better]] = d[better], number
        return d

    def visit(node: Node, rows: np.ndarray) -> None:
        if not node.children:
            for number in node.splits.tolist():
                see(rows, number)
            return
        alive = np.ones((len(node.splits), len(rows)), bool)
        for i, number in enumerate(node.splits.tolist()):
            asked = np.flatnonzero(alive[i])
            if not len(asked):
                continue
            d = see(rows[asked], number)
            low, high, reach = _down(d), _up(d), _up(best[rows[asked]])
            for j in range(len(node.splits)):
                # |distance to an entry| >= lo - d and >= d - hi; one more rounding each, so a little less still
                bound = np.maximum(node.lo[i, j] - high, low - node.hi[i, j]) * (1 - 1e-15)
                gone = bound > reach
                if gone.any():
                    alive[j, asked[gone]] = False
        for j, child in enumerate(node.children):
            if child is not None and len(rest := rows[alive[j]]):
                visit(child, rest)

    if len(queries) and len(entries):
        visit(tree, np.arange(len(queries)))
    return at, best, compared


class Codebooks:
    """Integer entries (parts, entries, width) and a GNAT over each part's."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [build(e) for e in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of integers the entry's number and the squared distance, by part."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        found = [nearest(tree, e, cut[:, i]) for i, (tree, e) in enumerate(zip(self.trees, self.entries, strict=True))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vectors(rows: DataFrame, key: str, vector: str, label: str | None, parts: int, scale: int) -> DataFrame:
    """id, label, v (array of long): the rows whose vector has finite components only, each floor(scale * x). Vectors that
    can't be cut into `parts` equal parts of at least one component are left out too."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite
    some = F.col(f"`{label}`") if label else F.lit(None).cast("int")
    ints = F.transform(v, lambda x: F.when(F.abs(x * float(scale)) < float(MOST), F.floor(x * float(scale))).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {MOST}")).cast("long")))
    return rows.where(whole).select(F.col(f"`{key}`").alias("id"), some.alias("label"), ints.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, part and entry: the number of parts assigned and their sum by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        counts, sums, waiting = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), 0

        def out() -> pa.RecordBatch:
            part, entry = np.nonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        for batch in batches:
            vectors = _matrix(batch.column(0))
            number, _ = books.assign(vectors)
            cut = vectors.reshape(len(vectors), parts, width)
            for i in range(parts):
                counts[i] += np.bincount(number[:, i], minlength=entries)
                np.add.at(sums[i], number[:, i], cut[:, i])
            waiting += len(vectors)
            if waiting > 1 << 32:  # a sum stays below 2 ** 61
                yield out()
                counts[:], sums[:], waiting = 0, 0, 0
        yield out()

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """vectors: id, v, all of one length. The first codebook is the `entries` vectors of least id (nulls last, ties by
    components). What comes to the driver is one row for each part and entry."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    if not first:
        return None
    start = np.array([r.v for r in first], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    width = books.entries.shape[2]
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
        whole = lambda c: F.sum(c.cast("decimal(38,0)"))  # noqa: E731  beyond 64 bits for very many rows
        means = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[whole(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        after = books.entries.copy()
        for row in means.collect():
            after[row.part, row.entry] = [int(row[f"s{i}"]) // row.n for i in range(width)]
        books = Codebooks(after)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Add code (two hex digits or more for each part) and error (sum of squared distances) to vectors (id, label, v), without v."""
    digits = max(2, math.ceil(math.log(max(2, books.entries.shape[1]), 16)))
    kept = [c for c in vectors.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([f"{i:0{digits}x}" for i in range(books.entries.shape[1])], object)
        for batch in batches:
            number, d = books.assign(_matrix(batch.column("v")))
            codes = names[number].sum(axis=1) if len(number) else np.empty(0, object)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(codes, pa.string()), pa.array(d.sum(axis=1))], [*kept, "code", "error"])

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept) + ", code string, error long"
    return vectors.mapInArrow(run, schema)


def add_sums(rows: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """rows (written) with the sum of `value` over rows of an equal label, nulls together. Frequent labels are salted."""
    named = rows.withColumns({"_none": F.col(label).isNull(), "_name": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    sums = named.groupBy("_none", "_name").agg(F.count("*").alias("n"), F.sum(value).alias(out))
    joined = join_hot(named, written(sums, "label-sums"), ["_none", "_name"], ["id", "code"])
    return joined.drop("_none", "_name", "n")


def product_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """id, label, code, error of every usable row, and the codebooks (None if no row is usable).

    Left out: rows whose vector is null, empty, has a null or non-finite component, or a length that isn't the length of
    the usable vector of least key (nulls last) or can't be cut into `parts`. Fewer rows than `entries` give as many entries. Null and
    repeated keys and labels stay as they are. A component times `scale` beyond 2 ** 26 is an error: distances would not
    fit into 64 bits. Other columns aren't read; an empty table gives no rows.
    """
    vectors = written(integer_vectors(rows, key, vector, label, parts, scale), "vectors")
    least = vectors.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v")).first()
    vectors = vectors.where(F.size("v") == (least[0] if least else 0))
    books = train(vectors, parts, entries, rounds)
    if books is None:
        return vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    return encode(vectors, books), books


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = product_codes(table(spark, sf_dir, "embeddings"))
    rows = add_sums(written(codes, "codes"), "label", "error", "label_error")
    digest: Column = F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest())
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _oracle() -> str:
    def assigned(i: int) -> str:
        return f"""
d{i} AS (SELECT v.id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c ON v.part = c.part AND v.place = c.place GROUP BY v.id, v.part, c.entry),
a{i} AS (SELECT id, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY d, entry) AS rn FROM d{i}) WHERE rn = 1),"""

    def moved(i: int) -> str:
        return f"""
m{i} AS (SELECT v.part, a.entry, v.place, CAST(floor(sum(v.x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM v JOIN a{i} a ON v.id = a.id AND v.part = a.part GROUP BY v.part, a.entry, v.place),
c{i + 1} AS (SELECT c.part, c.entry, c.place, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry AND m.place = c.place),"""

    rounds = "".join(assigned(i) + moved(i) for i in range(ROUNDS)) + assigned(ROUNDS)
    return f"""
WITH kept AS (SELECT vec_id AS id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, CAST((i - 1) // (len(embedding) // {PARTS}) AS BIGINT) AS part, CAST((i - 1) % (len(embedding) // {PARTS}) AS BIGINT) AS place, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
least AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS entry FROM kept ORDER BY id LIMIT {ENTRIES}),
c0 AS (SELECT v.part, l.entry, v.place, v.x FROM v JOIN least l ON v.id = l.id),{rounds}
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), books
"""


OP11_SQL = _oracle()
