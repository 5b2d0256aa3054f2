"""Helpers that the corpus operators share: table access, shared folders, cut lineage, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import shared_dir

#: A word, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts: few rows in each batch that goes to Python, so that a worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_clashes(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop input columns that an operator's own columns would clash with (names compare without case, as Spark's do)."""
    own, kept = {n.lower() for n in names}, {k.lower() for k in keep}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own or c.lower() in kept])


def least_hashes(rows: DataFrame, count: int, most: int, hashed: str, *ties: str) -> DataFrame:
    """The `most` of `count` rows with the least 64-bit hash. Only hashes so low that about three times as many remain are
    sorted, so that the task that takes the first ones reads a bounded number of rows, however many there are."""
    low = F.col(hashed) / 2.0**64 + 0.5 <= 3.0 * most / max(count, 1)
    return rows.where(low).orderBy(hashed, *ties).limit(most)


def join_hot(rows: DataFrame, names: DataFrame, on: list[str], spread: list[str], share: int = 1000, least: int = 1000) -> DataFrame:
    """Rows with what names (written; `on`, n = rows of the name, more) says of them; rows without a name are left out.

    Names with more than one in `share` of all rows, and more than `least`, are hot: their rows get a salt, a hash of the
    columns `spread`, and the name a row for each salt. There are at most `share` hot names, for their n add up to no more
    than the total; only those are broadcast."""
    total = names.agg(F.sum("n")).first()[0] or 0
    most = max(least, total // share)
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(names.where(F.col("n") > most).select(*on, parts.alias("parts")))
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int")).otherwise(0)
    salted = rows.join(hot, on, "left").withColumn("salt", salt).drop("parts")
    each = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, parts - 1).otherwise(0))))
    return salted.join(each, [*on, "salt"]).drop("salt")


def n_words(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
