"""Behaviour logs: cleaning and the split into page, start, error, action and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.changes import parsed

COMMON = "struct<mid:string,uid:string,sid:string,ar:string,ch:string,vc:string,is_new:string>"
PAGE = "struct<page_id:string,last_page_id:string,item:string,item_type:string,during_time:bigint>"
LOG = f"common {COMMON}, page {PAGE}, start map<string,string>, err map<string,string>, actions array<map<string,string>>, displays array<map<string,string>>, ts bigint"


def cleaned(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parsed logs that have a page or a start, a visitor and a time; malformed texts go."""
    return parsed(raw, LOG, value).where("(page is not null or start is not null) and common.mid is not null and ts is not null")


def split(log: DataFrame) -> dict[str, DataFrame]:
    """Five tables of cleaned logs; one record may be in several.

    err: the columns of the error alone. start: whole records that have a start, without the error; actions and displays
    stay. page: records that have a page, without error, actions and displays. action, display: one row for each element
    of a page's arrays, with common, page and ts; empty and missing arrays give none.
    """
    whole = [c for c in log.columns if c != "err"]
    each = lambda c, name: log.where("page is not null").select("common", "page", "ts", F.explode(c).alias(name))
    return {
        "err": log.where("err is not null").select("err"),
        "start": log.where("start is not null").select(*whole),
        "page": log.where("page is not null").select(*(c for c in whole if c not in ("actions", "displays"))),
        "action": each("actions", "action"),
        "display": each("displays", "display"),
    }


def keyword_searches(page: DataFrame, origins: tuple[str, ...] = ("search", "home")) -> DataFrame:
    """(keyword, ts) of searches among page rows."""
    keep = F.col("page.last_page_id").isin(*origins) & (F.col("page.item_type") == "keyword") & F.col("page.item").isNotNull()
    return page.where(keep).select(F.col("page.item").alias("keyword"), "ts")
