"""Cleaning rules of the aggregates: which rows count, and their times. Column names are parameters; rows without what a rule needs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_all(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.dropna(subset=list(columns))


def home_or_detail(page: DataFrame, page_id: str = "page_id", mid: str = "mid", ts: str = "ts", home: str = "home", detail: str = "good_detail") -> DataFrame:
    """Views of the home page and of goods, with a visitor and a time."""
    return with_all(page, mid, ts).where(F.col(page_id).isin(home, detail))


def logins(page: DataFrame, uid: str = "uid", last_page_id: str = "last_page_id") -> DataFrame:
    """A user's first page of a session: one without a page before it, or behind the login page."""
    return with_all(page, uid).where(F.col(last_page_id).isNull() | (F.col(last_page_id) == "login"))


def seconds_to_millis(ts: str = "ts") -> Column:
    """Facts carry seconds, windows want milliseconds."""
    return (F.col(ts).cast("bigint") * 1000).alias(ts)


def facts(df: DataFrame, *needed: str, ts: str = "ts") -> DataFrame:
    """Facts with all of ``needed`` and a time, the time in milliseconds: carts and payments need user_id, details id and
    sku_id, orders by province id and order_id."""
    return with_all(df, *needed, ts).withColumn(ts, seconds_to_millis(ts))
