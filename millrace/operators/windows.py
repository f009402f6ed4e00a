"""Tumbling event-time windows with partial aggregation, in batch and in streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import DATE, DATE_TIME


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """(stt, edt, cur_date, keys, aggregates) of windows of ``size``; stt, edt and cur_date are texts made from the window's edges."""
    found = df.groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggregates)
    rest = [c for c in found.columns if c != "w"]
    return found.select(F.date_format("w.start", DATE_TIME).alias("stt"), F.date_format("w.end", DATE_TIME).alias("edt"), F.date_format("w.start", DATE).alias("cur_date"), *rest)
