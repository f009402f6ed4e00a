"""Sinks: JSON records with snake_case names, partitioned and routed tables, keyed upserts and dimensions in micro-batches.

Sinks of micro-batches commit by the batch's number (``millrace.sources.committed``), so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import renamed, to_snake
from millrace.sources.committed import Committed


def as_json(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """(value): each row as a JSON text with snake_case names, without internal columns."""
    snake = renamed(df.drop(*drop), to_snake)
    return snake.select(F.to_json(F.struct(*snake.columns)).alias("value"))


def write_daily(df: DataFrame, path: str, day: str = "cur_date") -> None:
    """Append to a Parquet table partitioned by day, so that serving queries read one day's files."""
    df.write.mode("append").partitionBy(day).parquet(path)


def stream_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)


def latest_by_key(key: Sequence[str], order: Sequence[str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives ``write`` the last row of every key of a micro-batch; of rows that tie, the greatest."""

    def each(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in order]
        last = batch.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__r")).select(*(F.col("__r")[c].alias(c) for c in batch.columns))
        write(last, number)

    return each


def routed_to(path: str, by: str = "sink_table") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each row to the table its column ``by`` names, all tables by one commit."""
    return Committed(path).routed(by)


def routed_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows that ``routed_to`` committed for one name; other tables are not read. None where there were none."""
    return Committed(path).table(spark, name)


class Dimension:
    """A keyed table kept up by micro-batches of changes: nulls leave a column as it is, deletes remove the row.

    Rows lie in ``buckets`` folders by a hash of their key. A micro-batch merges and writes the buckets it touches, and one commit puts all of
    them in place, so readers see a micro-batch whole or not at all. Every column keeps the order of its last change, so changes may come late.
    Deleted keys are kept as such.
    """

    def __init__(self, path: str, key: str, columns: Sequence[str], order: Sequence[str] = ("ts",), buckets: int = 64):
        self.store, self.key, self.columns, self.order, self.buckets = Committed(path), key, list(columns), list(order), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, deleted: Column, number: int) -> None:
        """Take in the changes of one micro-batch; repeating a number changes nothing."""
        spark = batch.sparkSession
        if self.store.done(spark, number):
            return
        order = F.struct(*self.order)
        last = [F.max(F.when(~deleted & F.col(c).isNotNull(), F.struct(order.alias("at"), F.col(c).alias("v")))).alias(c) for c in self.columns]
        new = batch.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.when(deleted, order)).alias("gone"), F.max(F.when(~deleted, order)).alias("put"), *last)
        new = new.persist()
        try:
            touched = [str(r[0]) for r in new.select(self._bucket(F.col(self.key))).distinct().collect()]
            old = self.store.table(spark, "rows", touched)
            every = new if old is None else old.select(*new.columns).unionByName(new)
            merged = every.groupBy(self.key).agg(*(F.max(c).alias(c) for c in ("gone", "put", *self.columns))).withColumn("bucket", self._bucket(F.col(self.key)))
            self.store.commit(spark, {"rows": (merged.drop("bucket").schema, self.store.stage(merged.repartition("bucket"), "bucket") if touched else {})}, number)
        finally:
            new.unpersist()

    def sink(self, deleted: Column) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: self.merge(batch, deleted, number)

    def table(self, spark: SparkSession, buckets: Sequence[str] | None = None) -> DataFrame | None:
        """The rows as they are now, of all buckets or some; None before the first batch."""
        stored = self.store.table(spark, "rows", buckets)
        if stored is None:
            return None
        since = lambda c: F.col("gone").isNull() | (F.col(c) >= F.col("gone"))
        return stored.where(F.col("put").isNotNull() & since("put")).select(self.key, *(F.when(since(f"{c}.at"), F.col(f"{c}.v")).alias(c) for c in self.columns))

    def look_up(self, batch: DataFrame, key: str, columns: Mapping[str, str], how: str = "left") -> DataFrame:
        """A micro-batch with columns (theirs to ours) of the rows that its column ``key`` names, as they are now. Only the buckets that hold its keys are read."""
        stored = self.store.table(batch.sparkSession, "rows", [])
        if stored is None:
            none = batch.withColumns({n: F.lit(None) for n in columns.values()})
            return none if how == "left" else none.where(F.lit(False))
        own = F.col(key).cast(stored.schema[self.key].dataType)
        touched = [str(r[0]) for r in batch.where(own.isNotNull()).select(self._bucket(own)).distinct().collect()]  # at most self.buckets numbers
        side = self.table(batch.sparkSession, touched).select(F.col(self.key).alias("__key"), *(F.col(c).alias(n) for c, n in columns.items()))
        return batch.join(side, own == F.col("__key"), how).drop("__key")


def create_table(spark: SparkSession, name: str, columns: str, partitioned_by: Sequence[str] = ()) -> bool:
    """Create a Parquet table; False, and nothing done, where it exists or no columns are given."""
    if not columns.strip() or spark.catalog.tableExists(name):
        return False
    by = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet{by}")
    return True


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a table; False where there is none."""
    if not spark.catalog.tableExists(name):
        return False
    spark.sql(f"DROP TABLE {name}")
    return True
