"""Keyed changelogs: records of a key and a value, where a null value (a tombstone) deletes the key.

``Upserts`` takes the row kinds of a changelog (+I, +U put a row; -U, -D take one back) and appends, for each key of a micro-batch, the last
state as a JSON key and a JSON value. Readers get the records themselves, or the table: the last value of every key, without deleted ones.
``compact`` folds the records into a base that lies in buckets by a hash of the key; only buckets with changed keys are written again.
Commits are those of ``Committed``: a repeated micro-batch is skipped, and a crash leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.committed import Committed

_RECORD = "key string, value string, number bigint"
#: JSON that gives every value back.
EXACT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def put(kind: str = "kind"):
    return F.col(kind).isin("+I", "+U")


class Upserts:
    """A changelog in a folder; ``key`` names its key columns. Rows whose key has a null are a key like others."""

    def __init__(self, path: str, key: Sequence[str], buckets: int = 16):
        self.store, self.key, self.buckets = Committed(path), list(key), buckets

    def write(self, changes: DataFrame, number: int, kind: str = "kind", order: str = "seq") -> bool:
        """Append the last state of every key of ``changes``; of records with the same ``order`` one that puts a row is last."""
        spark = changes.sparkSession
        if self.store.done(spark, number):
            return False
        last = Window.partitionBy(*self.key).orderBy(F.desc(order), put(kind).desc())
        values = [c for c in changes.columns if c not in (kind, order)]
        rows = changes.withColumn("__n", F.row_number().over(last)).where("__n = 1")
        rows = rows.select(F.to_json(F.struct(*self.key), EXACT).alias("key"), F.when(put(kind), F.to_json(F.struct(*values), EXACT)).alias("value"), F.lit(number).cast("bigint").alias("number"))
        return self.store.commit(spark, {"log": (rows.schema, self.store.stage(rows))}, number)

    def sink(self, kind: str = "kind", order: str = "seq") -> Callable[[DataFrame, int], None]:
        return lambda batch, number: self.write(batch, number, kind, order) and None

    def records(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """(key, value, number): every record since the last compaction, tombstones with a null value."""
        found = self.store.table(spark, "log", version=version)
        return spark.createDataFrame([], _RECORD) if found is None else found

    def texts(self, spark: SparkSession) -> DataFrame:
        """(value): the records as a reader of plain texts gets them, a tombstone as an empty text; parsing drops those as malformed."""
        return self.records(spark).select(F.coalesce("value", F.lit("")).alias("value"))

    def _last(self, records: DataFrame) -> DataFrame:
        """The record with the greatest number of each key: a hash aggregate of the numbers, joined back by key."""
        top = records.groupBy(F.col("key").alias("__k")).agg(F.max("number").alias("__n"))
        return records.join(top, F.col("key") == F.col("__k")).where("number = __n").select("key", "value", "number")

    def _base(self, spark: SparkSession, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        found = self.store.table(spark, "base", None if buckets is None else [str(b) for b in buckets], version)
        return spark.createDataFrame([], _RECORD) if found is None else found.select("key", "value", "number")

    def table(self, spark: SparkSession, schema: str, version: int | None = None) -> DataFrame:
        """Rows as they are now, or were at a version, with the columns of ``schema``."""
        now = self._last(self._base(spark, version=version).unionByName(self.records(spark, version))).where("value is not null")
        return now.select(F.inline(F.array(F.from_json("value", schema, EXACT))))

    def compact(self, spark: SparkSession) -> None:
        """Fold the records into the base, tombstones with the rows they delete."""
        slots = self.store.manifest(spark)["tables"].get("log", {"slots": {}})["slots"]
        if not slots:
            return
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        log = self.records(spark).withColumn("bucket", bucket)
        touched = sorted(r[0] for r in log.select("bucket").distinct().collect())  # at most self.buckets numbers
        merged = self._last(self._base(spark, touched).unionByName(log.drop("bucket"))).where("value is not null").withColumn("bucket", bucket)
        staged = self.store.stage(merged.repartition(len(touched), "bucket"), "bucket")
        gone = {"log": list(slots), "base": [str(b) for b in touched if str(b) not in staged]}
        self.store.commit(spark, {"base": (merged.drop("bucket").schema, staged)}, drop=gone)
