"""Places and prefix sums in a total order, by one range exchange: tasks number their own range, and what the ranges before it hold is added."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._jobs import released, small_batches, written


def _schema(rows: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + more


def running(rows: DataFrame, order: Sequence[Column], amount: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` (bigint) over all rows that come earlier in ``order``. Written."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(amount).to_numpy()
            ends = np.cumsum(own) + total
            yield batch.append_column("__part", pa.array(np.full(len(own), part, dtype=np.int64))).append_column("before", pa.array(ends - own))
            total = int(ends[-1]) if len(own) else total

    placed = written(small_batches(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(add), _schema(rows, "`__part` bigint, before bigint")))
    ranges = placed.groupBy("__part").agg(F.sum(amount).alias("__s"))
    offset = F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("__part", offset.alias("__o"))  # as many rows as there are ranges
    return placed.join(F.broadcast(offsets), "__part").withColumn("before", F.col("before") + F.col("__o")).drop("__part", "__o")


def ranked(rows: DataFrame, key: str, ranges: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``__rank``: each row's place, from 0, among those with the same ``key`` (bigint, nulls are a key) in ``order``. Written.

    ``ranges`` is what the order begins with, short enough for the driver's sample of it; rows that agree on it meet in one range. A
    key's rows lie over as many ranges as they need. Of each range only its first key can have begun before, which bounds what is broadcast.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            local = []
            for k in batch.column(key).to_pylist():
                seen = seen + 1 if k == last else 0
                last = k
                local.append(seen)
            yield batch.append_column("__part", pa.array(np.full(len(local), part, dtype=np.int64))).append_column("__rank", pa.array(local, pa.int64()))

    own = F.col(key).asc()
    placed = written(small_batches(rows).repartitionByRange(own, *ranges).sortWithinPartitions(own, *ranges, *order).mapInArrow(released(number), _schema(rows, "`__part` bigint, `__rank` bigint")))
    held = placed.groupBy(key, "__part").agg((F.max("__rank") + 1).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    begun = held.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), before.alias("__o")).where("__o > 0")  # at most one row for each range
    found = placed.join(F.broadcast(begun), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left")
    return found.withColumn("__rank", F.col("__rank") + F.coalesce("__o", F.lit(0))).drop("__part", "__k", "__p", "__o")
