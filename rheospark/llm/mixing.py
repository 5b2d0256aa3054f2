"""Mixing sources to target weights: each source gives random documents, by prefix sums of sizes, up to its exact budget.

Every document has a random key, a hash of its id and text. Within a source the documents stand in the order of their
keys. Keys fall into buckets of equal width, so that a source of any size is dealt out evenly: a sum for each (source,
bucket) and prefix sums over those give where a bucket begins, and a window inside the bucket gives the rest. A source
whose budget exceeds its size begins anew: every document is taken `epochs` times and those at the front once more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_clashes, n_words, table, written

#: Sources in the order of their names have these weights, again and again; none is dropped.
WEIGHTS = (3.0, 1.0, 2.0)
#: All budgets together, as a share of all sizes; the most that a source gives, in times its size.
TOTAL_SHARE, MOST_EPOCHS = 1.5, 2.0
#: Words in the buckets of one number, about, over all sources; with more words than MOST_BUCKETS buckets hold so, they hold more.
BUCKET_WORDS, MOST_BUCKETS = 20_000, 1 << 16
SEED = 1
KEYS = float(1 << 60)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> the same with target. One row per source: a table as small as the list of sources.

    The total is shared by weight; what exceeds `most` times a source's size is shared anew by weight among the rest,
    until none is above. That is the same as filling up to one level: with the sources in the order of size / weight,
    those at the front are full, and the first level at which the next is not above its limit holds for all others. Later
    levels are lower, so the highest of those that fit is taken.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": share * F.sum("source_size").over(whole),
            "full": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("full")) / F.col("rest")  # if all before are full and none from here on
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    rows = rows.withColumn("level", F.max("level").over(whole))
    # if all are full there is no level, and every source gives its limit
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"))


def mix(docs: DataFrame, size: Column, random: Column, source: str = "source", weights: tuple[float, ...] = WEIGHTS,
        share: float = TOTAL_SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Add size, source_size, target and taken (words the mix takes of the row, repeats counted) to every row of docs.

    size: a row's words; random: its hash-random key, a long from 0 up to 2 ** 60. The last document taken in a source is taken in part, so
    that a source's sum is its target rounded down to a whole word. Null source: a source of its own, last in order.
    Rows that tie in the random key stand in the order of their sizes; if they tie in that too they are alike here.
    Size 0 or null: taken 0. Empty table: empty result. Columns of docs named like the new ones are replaced.
    docs is read three times; give a slim or written table where reading or the columns size and random cost much.
    """
    docs = docs.withColumns({"_size": F.coalesce(size, F.lit(0)).cast("long"), "_r": F.coalesce(random, F.lit(0)).cast("long")})
    docs = drop_clashes(docs, ["size", "source_size", "target", "taken", "_s", "_null", "_b", "_before", "_at"], keep=(source,))
    column = F.col(f"`{source}`")
    docs = docs.withColumns({"_s": F.coalesce(column.cast("string"), F.lit("")), "_null": column.isNull()})
    total = docs.agg(F.sum("_size")).first()[0] or 0
    buckets = min(MOST_BUCKETS, math.ceil(total / BUCKET_WORDS) or 1)
    docs = docs.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(F.col("_r") / KEYS * buckets).cast("int")))
    sums = docs.groupBy("_s", "_null", "_b").agg(F.sum("_size").alias("_n"))
    sizes = sums.groupBy("_s", "_null").agg(F.sum("_n").alias("source_size"))
    plan = source_targets(sizes.withColumn("source", F.when(~F.col("_null"), F.col("_s"))), weights, share, most)
    plan = plan.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_null"), "source_size", "target")
    by_source = Window.partitionBy("_s", "_null").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(by_source), F.lit(0))).drop("_n").join(plan, ["_s", "_null"])
    inside = Window.partitionBy("_s", "_null", "_b").orderBy("_r", "_size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_at", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    left = F.floor("target") - epochs * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("_size"), left - F.col("_before") - F.col("_at")))
    joined = docs.join(sums, ["_s", "_null", "_b"])
    return joined.withColumn("taken", (epochs * F.col("_size") + more).cast("long")).withColumnRenamed("_size", "size").drop("_s", "_null", "_b", "_r", "_at", "_before")


def random_key(key: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """A random key from 0 up to 2 ** 60: the first digits of an MD5, which SQL engines have too."""
    digits = F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"))), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each row of mix() as often as it is taken whole, and its first words where it is taken in part."""
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    words = F.split(F.col(f"`{text}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the space before it
    rows = mixed.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(0), whole.cast("int")), F.filter(F.array(part.cast("int")), lambda x: x > 0))))
    cut = F.when(F.col("_part") > 0, F.array_join(F.slice(words, 1, F.col("_part")), "")).otherwise(F.col(f"`{text}`"))
    return rows.withColumn(text, cut).drop("_part")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), random_key().alias("r")), "mix")
    return mix(slim, F.col("n"), F.col("r")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws(' ', '1', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS r
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
             coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
l AS (SELECT max((total - filled) / rest) AS level FROM f WHERE (total - filled) / rest * weight <= most),
t AS (SELECT source, source_size, coalesce(least(level * weight, most), most) AS target FROM f, l),
p AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY r, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
