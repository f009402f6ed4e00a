"""The dimension job: raw change records to keyed tables, which tables, columns and keys being told by a configuration that changes while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.changes import cdc, cleaned, parsed
from millrace.sources.sinks import Dimension
from millrace.streaming.configuration import Configuration
from millrace.streaming.jobs import Job

RULE = "source_table string, sink_table string, sink_columns string, sink_row_key string"
#: Records that mark the ends of a bulk load and hold no row.
MARKS = ("bootstrap-start", "bootstrap-complete")


class DimensionJob:
    """Dimensions in folders of ``path``, one for each rule's sink_table: the columns of sink_columns, keyed by sink_row_key.

    A micro-batch is parsed once and merged by the rules of its pinned version, one job for each rule that it has records for; rules are few. Every
    dimension commits by the micro-batch's number, so a repeated micro-batch changes nothing, whichever dimensions it had reached before.
    """

    def __init__(self, path: str, database: str, buckets: int = 64):
        self.path, self.database, self.buckets = path.rstrip("/"), database, buckets
        self.rules = Configuration(f"{self.path}/_rules", ["source_table"], RULE)

    def dimension(self, sink_table: str, sink_columns: str, sink_row_key: str) -> Dimension:
        columns = [c.strip() for c in sink_columns.split(",")]
        return Dimension(f"{self.path}/{sink_table}", sink_row_key, [c for c in columns if c != sink_row_key], buckets=self.buckets)

    def configure(self, raw: DataFrame, number: int) -> bool:
        """Take in capture records (JSON texts) of the rules' table. A rule that is deleted or updated drops the table that it named, which an update begins anew."""
        records = parsed(raw, cdc(RULE.replace(" string", ": string"))).where("op is not null")
        image = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
        rows = records.select("op", image.alias("row"), F.col("before.sink_table").alias("dropped"), "ts_ms").where("row.source_table is not null").persist()
        try:
            if not self.rules.feed(rows.select("op", "row.*", "ts_ms"), number):
                return False
            spark = raw.sparkSession
            for r in rows.where("op in ('d', 'u') and dropped is not null").select("dropped").distinct().collect():  # names of tables
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r.dropped}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            return True
        finally:
            rows.unpersist()

    def merge(self, raw: DataFrame, number: int) -> None:
        """One micro-batch of raw change records (value)."""
        spark = raw.sparkSession
        rules = self.rules.table(spark, self.rules.pinned(spark, number)).collect()
        log = cleaned(parsed(raw), self.database, without=MARKS).persist()
        try:
            held = {r[0] for r in log.select("table").distinct().collect()}  # names of tables
            for rule in (r for r in rules if r.source_table in held):
                dim = self.dimension(rule.sink_table, rule.sink_columns, rule.sink_row_key)
                rows = log.where(F.col("table") == rule.source_table)
                rows = rows.select(*(F.col("data")[c].alias(c) for c in (dim.key, *dim.columns)), (F.col("type") == "delete").alias("__deleted"), "ts")
                dim.merge(rows, F.col("__deleted"), number)
        finally:
            log.unpersist()

    def table(self, spark: SparkSession, sink_table: str) -> DataFrame | None:
        """A dimension as it is now; None where no rule names it or nothing came for it."""
        rule = self.rules.table(spark).where(F.col("sink_table") == sink_table).first()
        return None if rule is None else self.dimension(rule.sink_table, rule.sink_columns, rule.sink_row_key).table(spark)

    def job(self, source: Callable[[SparkSession], DataFrame], checkpoint: str) -> Job:
        return Job("dimensions", source, lambda raw: raw, self.merge, checkpoint)
