"""Keyed state in batch: first of day, first ever, returning users, first visits, deltas of repeated rows.

Rows are taken in the order of ``order``; give enough columns to make it total. What needs only first rows is an
aggregate by key and day, combined before its shuffle and split by day, so that one busy key is no large task; the
rest are window functions over what is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, TimestampNTZType, TimestampType


def _by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def firsts(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each combination of ``keys`` (columns ``columns``, all by default)."""
    rest = [c for c in (columns if columns is not None else df.columns) if c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__r")).select(*(F.col("__r")[c].alias(c) for c in (columns if columns is not None else df.columns)))


def packed(df: DataFrame, order: Sequence[str], last: Column | None = None) -> Column | None:
    """One decimal that sorts as ``order`` (a time and a whole number at most, neither null), then as ``last`` (0 or 1); None where the columns are others.

    Decimals have a fixed width, so their minima are hash aggregates; those of structs sort every row.
    """
    kinds = [df.schema[c].dataType for c in order]
    if not 1 <= len(order) <= 2 or not isinstance(kinds[0], TimestampType | TimestampNTZType | IntegralType) or not all(isinstance(k, IntegralType) for k in kinds[1:]):
        return None
    whole = lambda x: x.cast("decimal(20,0)")
    first = F.col(order[0])
    micros = whole(first if isinstance(kinds[0], IntegralType) else F.unix_micros(first.cast("timestamp")))
    rest = whole(F.col(order[1])) + F.lit(Decimal(2**63)).cast("decimal(20,0)") if len(order) == 2 else F.lit(0).cast("decimal(20,0)")
    low = (rest * 2 + (whole(last) if last is not None else 0)).cast("decimal(21,0)")
    return (micros.cast("decimal(17,0)") * F.lit(Decimal(2**65)).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def first_times(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """(keys, ts): the first time of each key and day, by a hash aggregate that is combined before its shuffle."""
    return df.groupBy(*keys, F.to_date(ts).alias("__day")).agg(F.min(ts).alias(ts)).select(*keys, ts)


def first_of_day_flags(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], flag: str) -> DataFrame:
    """``df`` with ``flag``: 1 on the first row in ``order`` of each key and day, else 0.

    The firsts are a hash aggregate, joined back by key and day: one row for each, which Spark broadcasts while it is small. Rows of a busy key
    stay where they are. Rows that tie in ``order`` count as one first together, so make it total.
    """
    place = packed(df, order)
    if place is None:
        place = F.struct(*order)
    rows = df.withColumn("__day", F.to_date(ts)).withColumn("__at", place)
    names = {k: f"__k{i}" for i, k in enumerate([*keys, "__day"])}
    first = rows.groupBy(*names).agg(F.min("__at").alias("__first")).select(*(F.col(k).alias(n) for k, n in names.items()), "__first")
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return rows.join(first, on, "left").withColumn(flag, F.coalesce((F.col("__at") == F.col("__first")).cast("int"), F.lit(0))).drop("__day", "__at", "__first", *names.values())


def firsts_of_day(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key and day. Where only keys and time are wanted, ``first_times`` does it without sorting."""
    return firsts(df, [*keys, F.to_date(ts)], order, columns)


def first_ever(keys: Sequence[str], order: Sequence[str]) -> Column:
    """1 on a key's first row of all, else 0. Give it the first rows of days only."""
    return (F.row_number().over(_by(keys, order)) == 1).cast("int")


def returning(keys: Sequence[str], ts: str, order: Sequence[str], days: int = 7) -> Column:
    """1 where a row comes more than ``days`` times 24 hours after the midnight that began the key's last active day.

    Give it the first rows of days only: then a key has one row a day at most.
    """
    last = F.date_trunc("day", F.lag(ts).over(_by(keys, order))).cast("timestamp_ntz")
    return F.coalesce((F.col(ts).cast("timestamp_ntz") > last + F.expr(f"interval {days} days")).cast("int"), F.lit(0))


def first_visit(df: DataFrame, key: str, ts: str = "ts", is_new: str = "is_new", order: Sequence[str] | None = None) -> DataFrame:
    """First visit date of each key: the date of its first row, or the day before where that row says the visitor is known.

    Rows that are neither new ("1") nor known ("0") do not count. Of rows that tie in ``order`` (by default ``ts``) a known one is first.
    """
    known = F.col(is_new) == "0"
    rows = df.where(F.col(is_new).isin("0", "1"))
    place = packed(df, order or [ts], F.when(known, 0).otherwise(1))
    if place is None:
        day = F.when(known, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))
        return rows.groupBy(key).agg(F.min(F.struct(*(order or [ts]), day.alias("__visit")))["__visit"].alias("first_visit"))
    first = rows.groupBy(key).agg(F.min(place).alias("__p"), F.min_by(ts, place).alias("__t") if (order or [ts])[0] != ts else F.min(ts).alias("__t"))
    return first.select(key, F.date_sub(F.to_date("__t"), F.when(F.col("__p") % 2 == 0, 1).otherwise(0)).alias("first_visit"))


def repaired_is_new(df: DataFrame, key: str, ts: str = "ts", is_new: str = "is_new", order: Sequence[str] | None = None) -> DataFrame:
    """Visitors that claim to be new on another day than their first visit are known.

    The first visits are an aggregate; joining them lets Spark broadcast them or split a busy key.
    """
    visits = first_visit(df, key, ts, is_new, order).select(F.col(key).alias("__key"), "first_visit")
    late = (F.col(is_new) == "1") & (F.to_date(ts) != F.col("first_visit"))
    return df.join(visits, F.col(key) == F.col("__key"), "left").withColumn(is_new, F.when(late, "0").otherwise(F.col(is_new))).drop("__key", "first_visit")


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Each amount less the one that the same key had before, so that sums count the last version of a row only."""
    w = _by(keys, order)
    return df.select(*(c for c in df.columns if c not in amounts), *((F.col(a) - F.coalesce(F.lag(a).over(w), F.lit(0))).alias(a) for a in amounts))
