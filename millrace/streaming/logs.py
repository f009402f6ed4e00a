"""The behaviour-log job: raw texts are parsed once, visitors' flags repaired by state, and each micro-batch goes to five tables by one commit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators import logs
from millrace.sources.committed import Committed
from millrace.streaming.jobs import Job

KINDS = ("err", "start", "page", "action", "display")


def kinds(log: DataFrame) -> DataFrame:
    """(kind, value): the rows of ``logs.split`` as JSON texts, from one pass over cleaned logs."""
    whole = [c for c in log.columns if c != "err"]
    page = F.col("page").isNotNull()
    one = lambda kind, keep, value: F.when(keep, F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"))))
    each = lambda kind, many: F.when(page, F.transform(many, lambda x: F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct("common", "page", "ts", x.alias(kind))).alias("value"))))
    parts = [
        one("err", F.col("err").isNotNull(), F.to_json(F.struct("err"))), one("start", F.col("start").isNotNull(), F.to_json(F.struct(*whole))),
        one("page", page, F.to_json(F.struct(*(c for c in whole if c not in ("actions", "displays"))))), each("action", F.col("actions")), each("display", F.col("displays")),
    ]
    return log.select(F.inline(F.flatten(F.array_compact(F.array(*parts)))))


class Repair(StatefulProcessor):
    """Keeps a visitor's first visit date and writes the repaired flag beside each record, as ``keyed.repaired_is_new`` does in batch; rows are taken by time within a micro-batch."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "day date", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = self.first.get()[0] if self.first.exists() else None
        for r in sorted(rows, key=lambda r: (r.ts, r.is_new or "")):
            if r.is_new in ("0", "1") and first is None:
                first = r.day - dt.timedelta(days=int(r.is_new == "0"))
                self.first.update((first,))
            yield Row(record=r.record, flag="0" if r.is_new == "1" and r.day != first else r.is_new)

    def close(self) -> None:
        pass


def repaired(log: DataFrame, ttl: int | None = None) -> DataFrame:
    """Cleaned logs with repaired ``common.is_new``; records travel as they were parsed."""
    day = F.to_date(F.timestamp_millis("ts"))
    keyed = log.select(F.col("common.mid").alias("mid"), "ts", day.alias("day"), F.col("common.is_new").alias("is_new"), F.struct(*log.columns).alias("record"))
    schema = f"record {keyed.schema['record'].dataType.simpleString()}, flag string"
    found = keyed.groupBy("mid").transformWithState(Repair(ttl), schema, "Append", "None" if ttl is None else "ProcessingTime")
    common = F.col("record.common").withField("is_new", F.col("flag")).alias("common")
    return found.select(*(common if c == "common" else F.col("record")[c].alias(c) for c in log.columns))


def base_log_job(source: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, ttl: int | None = None) -> Job:
    """From a stream of raw texts (value) to the tables of ``KINDS`` (value: JSON) in ``path``, which appear together."""
    return Job("base_log", source, lambda raw: kinds(repaired(logs.cleaned(raw), ttl)), Committed(path).routed("kind"), checkpoint)
