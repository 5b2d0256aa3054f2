"""Sources and sinks: database tables, CSV, daily Parquet, reports, logs, state, vectors, snapshots."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from spark.checkpoint.dir. Where none is set, a local master gets
    a temporary one; on a cluster that is an error, for a folder of one machine would lose data."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends: plans that read it may run until then."""
    if hasattr(spark, "_jvm"):  # not over Spark Connect, where the server's owner clears the shared folder
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df below the shared folder and read it again. The folder goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_table(spark: SparkSession, cfg: Mapping[str, object]) -> DataFrame:
    """A table by configuration: {"path": ...} for Parquet, or JDBC options with url and dbtable or query.

    With column, lower, upper and partitions a JDBC read is dealt out over that many connections.
    """
    if "path" in cfg:
        return spark.read.parquet(str(cfg["path"]))
    options = {k: str(v) for k, v in cfg.items() if k not in ("column", "lower", "upper", "partitions")}
    if "column" in cfg:
        options |= {"partitionColumn": str(cfg["column"]), "lowerBound": str(cfg["lower"]), "upperBound": str(cfg["upper"]), "numPartitions": str(cfg["partitions"])}
    return spark.read.format("jdbc").options(**options).load()


def read_lab(spark: SparkSession, cfg: Mapping[str, object]) -> DataFrame:
    """The result of a query that the database runs itself."""
    if "query" in cfg:
        cfg = {k: v for k, v in cfg.items() if k != "query"} | {"dbtable": f"({cfg['query']}) q"}
    return read_table(spark, cfg)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def write_daily(df: DataFrame, path: str, date: str = "date") -> None:
    """Parquet by month and date; only the dates that df holds are replaced."""
    out = df.withColumn("month", F.date_format(date, "yyyy-MM"))
    out.write.partitionBy("month", date).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_daily(spark: SparkSession, path: str, date: str | None = None, column: str = "date") -> DataFrame:
    """All dates, or one: then only its folder is read."""
    df = spark.read.parquet(path)
    if date is None:
        return df
    day = F.lit(date).cast("date")
    return df.where((F.col("month") == date[:7]) & (F.col(column) == day))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def save_state(df: DataFrame, path: str, key: str) -> None:
    """A keyed snapshot, one row per key."""
    df.dropDuplicates([key]).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The snapshot, or no rows where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def write_vectors(df: DataFrame, path: str, keys: list[str], vector: str) -> None:
    df.select(*keys, F.col(vector).cast("array<double>").alias(vector)).write.mode("overwrite").parquet(path)


def latest_dates(df: DataFrame, date: str = "date", n: int = 10) -> DataFrame:
    """Rows of the n latest dates. What is broadcast is n dates."""
    days = df.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return df.join(F.broadcast(days), date, "left_semi")


def export_latest_dates(df: DataFrame, path: str, date: str = "date", n: int = 10) -> None:
    latest_dates(df, date, n).write.partitionBy(date).mode("overwrite").parquet(path)


def snapshot(spark: SparkSession, path: str, frames: Mapping[str, DataFrame], config: Mapping[str, object], models: Mapping[str, object] | None = None) -> None:
    """Freeze an experiment: its tables, its configuration as JSON, and its fitted models."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    for name, model in (models or {}).items():
        model.write().overwrite().save(f"{path}/models/{name}")
