"""Keyed state of streams, for what Catalyst cannot stream: first-visit dates, daily flags and deltas of repeated rows.

Each key's state is one small value. With a ``ttl`` it goes that long after its last update (by processing time, as a
key that comes back later would be a first one again); without, it is kept. The RocksDB state store is needed: set
spark.sql.streaming.stateStore.providerClass to ``ROCKSDB``. Rows without a time keep their place in the output, get
no flag (0) or their full amounts, and leave the state as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, DecimalType, DoubleType, IntegerType, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS, IDLE_MS = 24 * 3600 * 1000, 30 * 1000


def _sorted(rows: Iterator[pd.DataFrame], ts: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(ts, kind="stable", na_position="last")


class Visits(StatefulProcessor):
    """Flags of each row in order of arrival, times sorted within a batch: ``first`` of its day, ``back`` after more than
    ``days`` times 24 hours since the midnight of the last active day, ``new`` for the key's first row of all."""

    def __init__(self, ts: str, names: tuple[str | None, str | None, str | None], days: int, ttl: int | None):
        self.ts, self.names, self.days, self.ttl = ts, names, days, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day date", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, self.ts)
        timed = frame[self.ts].notna()
        day = frame.loc[timed, self.ts].dt.normalize()
        before = day.shift(1)
        if len(day):
            before.iloc[0] = pd.Timestamp(self.last.get()[0]) if self.last.exists() else pd.NaT
            self.last.update((day.iloc[-1].date(),))
        flags = (day != before, frame.loc[timed, self.ts] > before + pd.Timedelta(days=self.days), before.isna())
        for name, flag in zip(self.names, flags, strict=True):
            if name:
                frame[name] = flag.reindex(frame.index, fill_value=False).astype("int32")
        yield frame

    def close(self) -> None:
        pass


class FirstVisit(StatefulProcessor):
    """Keeps each visitor's first visit date (the day before where the first row says known) and repairs the flag of rows
    that claim to be new on another day. Flags that are neither new nor known never write the state."""

    def __init__(self, ts: str, is_new: str, to: str, ttl: int | None):
        self.ts, self.is_new, self.to, self.ttl = ts, is_new, to, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "day date", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, self.ts)
        first = self.first.get()[0] if self.first.exists() else None
        counts = frame[self.ts].notna() & frame[self.is_new].isin(["0", "1"])
        if first is None and counts.any():
            one = frame[counts].iloc[0]
            first = (one[self.ts] - pd.Timedelta(days=int(one[self.is_new] == "0"))).date()
            self.first.update((first,))
        late = counts & (frame[self.is_new] == "1") & (frame[self.ts].dt.date != first)
        yield frame.assign(**{self.is_new: frame[self.is_new].mask(late, "0"), self.to: first})

    def close(self) -> None:
        pass


class Delta(StatefulProcessor):
    """Replaces amounts by what they exceed the key's amounts before; null amounts count as zero."""

    def __init__(self, ts: str, amounts: list[tuple[str, str, bool]], ttl: int | None):
        self.ts, self.amounts, self.ttl = ts, amounts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"`{a}` {kind}" for a, kind, _ in self.amounts), self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, self.ts)
        timed = frame[self.ts].notna()
        last = self.last.get() if self.last.exists() else None
        new, state = {}, []
        for k, (a, _, exact) in enumerate(self.amounts):
            zero = Decimal(0) if exact else 0.0
            now = frame[a].where(frame[a].notna(), zero)
            before = now[timed].shift(1)
            if len(before):
                before.iloc[0] = last[k] if last is not None else zero
                state.append(now[timed].iloc[-1] if exact else float(now[timed].iloc[-1]))
            new[a] = now.where(~timed, now - before.reindex(now.index, fill_value=zero))
        if state:
            self.last.update(tuple(state))
        yield frame.assign(**new)

    def close(self) -> None:
        pass


def _run(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: StructType, ttl: int | None) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None" if ttl is None else "ProcessingTime")


def visits(stream: DataFrame, keys: list[str], ts: str, first: str | None = "first", back: str | None = None, new: str | None = None, days: int = 7, ttl: int | None = None) -> DataFrame:
    """Visitors and users of a day (``first``), returning users (``back``), users never seen before (``new``)."""
    schema = StructType(list(stream.schema.fields))
    for name in (first, back, new):
        schema = schema.add(name, IntegerType()) if name else schema
    return _run(stream, keys, Visits(ts, (first, back, new), days, ttl), schema, ttl)


def first_of_day(stream: DataFrame, keys: list[str], ts: str, flag: str, ttl: int | None = None) -> DataFrame:
    """``flag``: 1 on a key's first row of a day in order of arrival, else 0."""
    return visits(stream, keys, ts, flag, ttl=ttl)


def first_visit(stream: DataFrame, key: str, ts: str = "ts", is_new: str = "is_new", to: str = "first_visit", ttl: int | None = None) -> DataFrame:
    return _run(stream, [key], FirstVisit(ts, is_new, to, ttl), StructType(list(stream.schema.fields)).add(to, DateType()), ttl)


def deltas(stream: DataFrame, keys: list[str], ts: str, amounts: list[str], ttl: int | None = None) -> DataFrame:
    """Decimals stay exact; the amounts must be decimals or doubles."""
    kinds = {f.name: f.dataType for f in stream.schema}
    for a in amounts:
        if not isinstance(kinds[a], DecimalType | DoubleType):
            raise TypeError(f"{a} is neither decimal nor double")
    own = [(a, kinds[a].simpleString(), isinstance(kinds[a], DecimalType)) for a in amounts]
    return _run(stream, keys, Delta(ts, own, ttl), stream.schema, ttl)
