"""Streaming jobs from the batch operators: watermarks of 5 seconds, tumbling windows, joins with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.changes import routed
from millrace.operators.windows import tumbling

DELAY = "5 seconds"


def windowed(stream: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column, delay: str = DELAY) -> DataFrame:
    """Windows are given out once, when the watermark passes their end; later rows are dropped."""
    return tumbling(stream.withWatermark(ts, delay), ts, size, keys, *aggregates)


def unique_by_day(stream: DataFrame, keys: list[str], ts: str, delay: str = DELAY) -> DataFrame:
    """The first row of each key and day. State goes a day and the delay after the row."""
    day = stream.withColumn("__day", F.date_trunc("day", ts)).withWatermark("__day", f"1 day {delay}")
    return day.dropDuplicates([*keys, "__day"]).drop("__day")


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], lts: str, rts: str, before: str, after: str, how: str = "inner", delay: str = DELAY) -> DataFrame:
    """Pairs with equal keys where ``lts`` lies from ``before`` before ``rts`` to ``after`` after it; both states are bounded by the watermarks."""
    a, b = left.withWatermark(lts, delay), right.withWatermark(rts, delay)
    on = (a[lts] >= b[rts] - F.expr(f"interval {before}")) & (a[lts] <= b[rts] + F.expr(f"interval {after}"))
    for x, y in keys:
        on &= a[x] == b[y]
    return a.join(b, on, how)


@dataclass(frozen=True)
class Job:
    """A streaming job: where rows come from, what is made of them, and where each micro-batch goes.

    ``run`` starts it; with ``once`` it takes what is there and ends. Spark's checkpoint folder gives every micro-batch
    its number, and the sinks of ``millrace.sources.sinks`` write a number's rows once however often it is repeated.
    """

    name: str
    source: Callable[[SparkSession], DataFrame]
    transform: Callable[[DataFrame], DataFrame]
    sink: Callable[[DataFrame, int], None]
    checkpoint: str
    every: str = "2 seconds"

    def run(self, spark: SparkSession, once: bool = False) -> StreamingQuery:
        writer = self.transform(self.source(spark)).writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).foreachBatch(self.sink)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.every)).start()


def routing(config: Callable[[SparkSession], DataFrame], keys: Sequence[tuple[str, str]], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that routes a micro-batch by the configuration as it is then: changes hold from the next one on."""

    def each(batch: DataFrame, number: int) -> None:
        write(routed(batch, config(batch.sparkSession), keys), number)

    return each


def order_counts(stream: DataFrame, ts: str, size: str, key: str, order_id: str, amount: str, delay: str = DELAY) -> DataFrame:
    """Sum and number of different orders of each window and key.

    Streams cannot count distinct values, so orders are aggregated first, and their rows are counted: state is one row of a few dozen bytes for
    each open window, key and order, spread by all three, and none grows with the orders of a window. Rows without an order add to the sum only.
    """
    orders = stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("__w"), key, order_id).agg(F.sum(amount).alias("__amount"))
    return tumbling(orders, "__w", size, [key], F.sum("__amount").alias("order_amount"), F.count(order_id).alias("order_count"))
