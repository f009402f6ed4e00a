"""A table's snapshot and then its change log, without a gap and without doubles, while the table is being written to.

The snapshot is read in chunks of keys. Around each chunk's read the log's position is taken, before (low) and after (high). A change at or below
low is in the chunk already; one above high is not in it; one in between may be or not. So ``initial`` gives each chunk as it was at its high
position: its rows, replaced by the last change of their key between low and high; and ``following``
gives the changes above the high position of their key's chunk. Together they are each row once and each later change once. Changes to keys
outside all chunks follow from the position where the snapshot began.

Chunks are committed one by one (``millrace.sources.committed``), with their positions, so a snapshot that stops goes on with the next chunk.
Nothing is locked; the source has to give its log in the order of its positions, with whole row images.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.committed import Committed

BOUNDS = "chunk bigint, low bigint, high bigint"


class Capture:
    """A capture of one table into a folder. ``first``, ``last``: least and greatest key (whole numbers) when it began; ``size``: keys of a chunk.

    A capture keeps the range that it began with: give the same one when going on.
    """

    def __init__(self, path: str, key: str, columns: Sequence[str], first: int, last: int, size: int):
        self.store, self.key, self.columns = Committed(path), key, list(columns)
        self.first, self.last, self.size = first, last, size

    def snapshot(self, spark: SparkSession, read: Callable[[int, int], DataFrame], position: Callable[[], int]) -> int:
        """Read the chunks that are not committed yet: ``read`` gives the rows with keys from its first argument to below its second, ``position`` the log's last position. Gives how many were read."""
        done = self.store.manifest(spark)["numbers"].get("snapshot", -1)
        chunks = max(0, (self.last - self.first) // self.size + 1)
        for chunk in range(done + 1, chunks):
            low = position()
            begin = self.first + chunk * self.size
            rows = read(begin, min(begin + self.size, self.last + 1)).select(self.key, *self.columns)
            staged = self.store.stage(rows.withColumn("chunk", F.lit(chunk).cast("bigint")))  # read here and now, before the next line
            high = position()
            bounds = spark.createDataFrame([(chunk, low, high)], BOUNDS)
            schema = rows.withColumn("chunk", F.lit(chunk).cast("bigint")).schema
            self.store.commit(spark, {"rows": (schema, staged), "bounds": (bounds.schema, self.store.stage(bounds.coalesce(1)))}, chunk, "snapshot")
        return chunks - done - 1

    def _placed(self, spark: SparkSession, log: DataFrame) -> DataFrame:
        """``log`` with low and high of each key's chunk; outside all chunks both are the position where the snapshot began."""
        bounds = self.store.table(spark, "bounds")
        bounds = spark.createDataFrame([], BOUNDS) if bounds is None else bounds
        begin = bounds.agg(F.min("low")).first()[0] or 0
        key = F.col(self.key)
        chunk = F.when(key.between(self.first, self.last), F.floor((key - self.first) / self.size)).cast("bigint")
        side = bounds.select(F.col("chunk").alias("__c"), F.col("low").alias("__low"), F.col("high").alias("__high"))  # one row for each chunk
        placed = log.withColumn("__chunk", chunk).join(side, F.col("__chunk") == F.col("__c"), "left")
        return placed.withColumns({"__low": F.coalesce("__low", F.lit(begin)), "__high": F.coalesce("__high", F.lit(begin))}).drop("__c")

    def initial(self, spark: SparkSession, log: DataFrame) -> DataFrame:
        """(op = r, seq, key, columns): every row as it was at its chunk's high position. ``log``: (seq, op, key, columns), op d for deletes."""
        window = self._placed(spark, log).where("seq > __low and seq <= __high")
        latest = window.groupBy(F.col(self.key).alias("__k")).agg(F.max("seq").alias("__s"))
        changed = window.join(latest, (F.col(self.key) == F.col("__k")) & (F.col("seq") == F.col("__s"))).select("seq", "op", self.key, *self.columns)
        rows, bounds = self.store.table(spark, "rows"), self.store.table(spark, "bounds")
        put = changed.where("op <> 'd'").select(F.lit("r").alias("op"), "seq", self.key, *self.columns)
        if rows is None:
            return put
        kept = rows.join(changed.select(F.col(self.key).alias("__k")), F.col(self.key) == F.col("__k"), "left_anti").join(bounds.select("chunk", F.col("high").alias("seq")), "chunk")
        return kept.select(F.lit("r").alias("op"), "seq", self.key, *self.columns).unionByName(put)

    def following(self, spark: SparkSession, log: DataFrame) -> DataFrame:
        """(op, seq, key, columns): the changes that ``initial`` does not hold; ``log`` may be a stream."""
        return self._placed(spark, log).where("seq > __high").select("op", "seq", self.key, *self.columns)
