"""Sources of raw records: a Kafka topic, a folder of text files that stands in for one, and JDBC tables; records kept for several readers.

The Kafka source needs Spark's Kafka package, which this environment lacks: that path is not tested here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import renamed, to_camel


def kafka_text(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """(value): all records of a topic from its start; a null record is an empty text."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))


def folder_text(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(value): the lines of all files that come into a folder, as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def jdbc_table(spark: SparkSession, url: str, query: str, camel: bool = False, **options: str) -> DataFrame:
    """A query's rows; give partitionColumn, lowerBound, upperBound and numPartitions with dbtable to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    found = (reader if "dbtable" in options else reader.option("query", query)).load()
    return renamed(found, to_camel) if camel else found


#: Let a task write several partitions at once, so that it need not sort its rows by them; make tasks of a shuffle small, for making and parsing texts takes long
#: for each byte, and a few large tasks leave cores idle at the end; let the job's shuffle files go when it has ended.
_WRITING = {
    "spark.sql.maxConcurrentOutputFileWriters": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: Records are read whole and their texts hardly repeat: dictionaries and bounds of columns would be work for nothing.
_PLAIN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def kept(df: DataFrame, *partitions: str) -> DataFrame:
    """``df``, written once as Parquet under spark.checkpoint.dir (where that is unset, a temporary folder) by ``partitions``, of few values: several readers of
    parsed records then parse nothing again, and read only what they ask for. The files stay, for results are evaluated later."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/millrace-checkpoints"
    path = f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**_PLAIN).partitionBy(*partitions).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
