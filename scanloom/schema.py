"""The point model, and the clouds that the driver tables stand for.

A scan is a set of rows with the same scan_id; a channel is a column. Coordinates are flat doubles, left-handed with y
up, so that expressions over them stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType(
    [T.StructField("scan_id", T.IntegerType()), T.StructField("point_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z")]
    + [T.StructField(c, T.ShortType()) for c in ("r", "g", "b")]
    + [T.StructField(c, T.FloatType()) for c in ("reflectance", "temperature", "amplitude")]
    + [T.StructField("type", T.IntegerType()), T.StructField("deviation", T.FloatType())]
    + [T.StructField(c, T.DoubleType()) for c in ("nx", "ny", "nz")]
)
FRAMES = "scan_id int, seq int, m array<double>, algo int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose files give fewer tasks than there are cores is dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as eight scans. point_id is arithmetic over the columns that tell lines apart: no shuffle numbers them, and
    filters reach the scan of the table."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rest = F.col("l_partkey") * 1009 + F.col("l_suppkey") * 53 + F.col("l_quantity").cast("long")
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return spread(table(spark, sf_dir, "lineitem").select(*columns)).select(
        (F.col("l_suppkey") % 8).cast("int").alias("scan_id"), (line * 1000003 + rest % 1000003).alias("point_id"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("reflectance"), F.col("l_linenumber").cast("int").alias("type"),
    )


POINTS_SQL = """pts AS (
  SELECT (l_suppkey % 8)::INT AS scan_id,
    (l_orderkey * 8 + l_linenumber)::BIGINT * 1000003 + (l_partkey * 1009 + l_suppkey * 53 + l_quantity::BIGINT) % 1000003 AS point_id,
    l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax AS reflectance, l_linenumber::INT AS type
  FROM lineitem)"""


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as poses: each user is a run, ordered by time; the value is its position on one axis, the hour another."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("x"), (F.col("event_id") % 24).cast("double").alias("z"))


TRAJECTORY_SQL = "traj AS (SELECT user_id AS run, ts, event_id, value AS x, (event_id % 24)::DOUBLE AS z FROM events)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as scan poses on a spiral: positions from the account balance, angles from the key."""
    k, a = F.col("s_suppkey").cast("double"), F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scan_id"), (a / 100).alias("tx"), (k / 10).alias("ty"), (F.abs(a) / 50 - k).alias("tz"), (k % 60 - 30).alias("rx"), (k % 80 - 40).alias("ry"), (k % 170 - 85).alias("rz"))


POSES_SQL = "poses AS (SELECT s_suppkey AS scan_id, s_acctbal / 100 AS tx, s_suppkey / 10.0 AS ty, abs(s_acctbal) / 50 - s_suppkey AS tz, s_suppkey::DOUBLE % 60 - 30 AS rx, s_suppkey::DOUBLE % 80 - 40 AS ry, s_suppkey::DOUBLE % 170 - 85 AS rz FROM supplier)"
