"""A configuration that is fed by changes and has versions: every micro-batch is routed by the version it met first, also when it is repeated."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.changes import routed
from millrace.sources.upserts import Upserts


class Configuration:
    """Rules by key in a folder. ``schema`` is that of a rule; ``keep`` bounds how many later changes a pinned version outlives."""

    def __init__(self, path: str, key: Sequence[str], schema: str, keep: int = 10_000):
        self.path, self.schema = path.rstrip("/"), schema
        self.rules = Upserts(f"{self.path}/rules", key, buckets=1)
        self.rules.store.keep = keep

    def feed(self, captured: DataFrame, number: int, order: str = "ts_ms") -> bool:
        """Take in capture records (op, columns of the rule, and their order); d deletes a rule."""
        kind = F.when(F.col("op") == "d", "-D").otherwise("+I")
        return self.rules.write(captured.withColumn("kind", kind).drop("op"), number, order=order)

    def sink(self, order: str = "ts_ms") -> Callable[[DataFrame, int], None]:
        return lambda batch, number: self.feed(batch, number, order) and None

    def version(self, spark: SparkSession) -> int:
        return self.rules.store.manifest(spark)["version"]

    def table(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self.rules.table(spark, self.schema, version)

    def pinned(self, spark: SparkSession, number: int, reader: str = "stream") -> int:
        """The version that a reader's micro-batch met first; noted before the micro-batch is routed."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pins/{reader}/{number:020d}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            stream = fs.open(path)
            try:
                if text := spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"):
                    return int(text)
            finally:
                stream.close()
        now = self.version(spark)
        out = fs.create(path, True)
        out.write(bytearray(str(now).encode()))
        out.close()
        return now

    def routing(self, keys: Sequence[tuple[str, str]], write: Callable[[DataFrame, int], None], reader: str = "stream") -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that routes each micro-batch by its pinned version."""

        def each(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            write(routed(batch, self.table(spark, self.pinned(spark, number, reader)), keys), number)

        return each
