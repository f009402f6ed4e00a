"""The provided tables as commerce inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page views: visitor, four dimensions, session start, duration."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        user.alias("mid"), (user % 5).cast("string").alias("ch"), (user % 3).cast("string").alias("vc"), (user % 7).cast("string").alias("ar"),
        F.when(user % 2 == 0, "0").otherwise("1").alias("is_new"), "event_type", "event_id", "ts", (F.col("event_type") == "signup").cast("int").alias("sv"), F.col("value").cast(MONEY).alias("dur"),
    )


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

PAGE_LOG_SQL = """
    SELECT user_id AS mid, CAST(user_id % 5 AS VARCHAR) AS ch, CAST(user_id % 3 AS VARCHAR) AS vc, CAST(user_id % 7 AS VARCHAR) AS ar,
           CASE WHEN user_id % 2 = 0 THEN '0' ELSE '1' END AS is_new, event_type, event_id, ts,
           CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS sv, CAST(value AS DECIMAL(18,2)) AS dur
    FROM events"""


def edges_sql(ts: str, seconds: int) -> str:
    """Select items stt, edt and cur_date of a tumbling window."""
    start = f"time_bucket(INTERVAL {seconds} SECOND, {ts})"
    return (
        f"strftime({start}, '%Y-%m-%d %H:%M:%S') AS stt, strftime({start} + INTERVAL {seconds} SECOND, '%Y-%m-%d %H:%M:%S') AS edt, "
        f"strftime({start}, '%Y-%m-%d') AS cur_date"
    )
