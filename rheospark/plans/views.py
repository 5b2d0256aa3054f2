"""Roles over the given tables: orders as production orders, lines as batches, parts as compounds, events as curve points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import table

BATCH_SQL = """
b AS (
  SELECT l_orderkey AS order_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS batch_no,
         l_partkey, l_suppkey, CAST(l_suppkey % 10 AS BIGINT) AS mixer, l_quantity AS y, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag AS flag, l_shipdate AS visible, o_orderdate AS start, p_brand AS compound, p_type AS family, CAST(p_size AS BIGINT) AS size,
         20 + (l_extendedprice / l_quantity) / 200 AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
g AS (SELECT *, CAST(ceil(batch_no / 2.0) AS BIGINT) AS pallet, order_id || '|' || CAST(ceil(batch_no / 2.0) AS BIGINT) AS label_group FROM b)
"""

EVENT_SQL = """
e AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1000000.0 AS t, event_type, value, props,
         CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS BIGINT) AS sec
  FROM events)
"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per batch, with its pallet and label group."""
    line, order, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    at = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.select(
        F.col("l_orderkey").alias("order_id"), F.row_number().over(at).cast("long").alias("batch_no"), "l_partkey", "l_suppkey",
        (F.col("l_suppkey") % 10).alias("mixer"), F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("visible"),
        F.col("o_orderdate").alias("start"), F.col("p_brand").alias("compound"), F.col("p_type").alias("family"), F.col("p_size").cast("long").alias("size"),
        (20 + (F.col("l_extendedprice") / F.col("l_quantity")) / 200).alias("p"),
    )
    pallet = F.ceil(F.col("batch_no") / 2.0).cast("long")
    return rows.withColumns({"pallet": pallet, "label_group": F.concat_ws("|", "order_id", pallet)})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of curves: one curve per user and day, a second per event."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    at = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return rows.select("event_id", "user_id", "day", (F.unix_micros("ts") / 1000000.0).alias("t"), "event_type", "value", "props", (F.row_number().over(at) - 1).cast("long").alias("sec"))
