"""Serving queries over daily tables of windows: channel figures and keyword sums of one day (today by default), and their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(df: DataFrame, date: str | None) -> DataFrame:
    """The filter is on the partition column, so other days are not read."""
    return df.where(F.col("cur_date") == (F.lit(date) if date else F.date_format(F.current_date(), "yyyy-MM-dd")))


def channel_figures(page_views: DataFrame, *keys: str) -> DataFrame:
    """One row for each channel (and other keys) in one aggregate; ratios are null where there are no sessions."""
    sv = F.sum("sv_ct").cast("double")
    return page_views.groupBy(*keys, "ch").agg(
        F.sum("uv_ct").cast("bigint").alias("uv_ct"), F.sum("sv_ct").cast("bigint").alias("sv_ct"), F.try_divide(F.sum("pv_ct").cast("double"), sv).alias("pv_per_session"),
        (F.try_divide(F.sum(F.col("dur_sum").cast("decimal(18,2)")).cast("double"), sv) / 100).alias("dur_per_session"), F.try_divide(F.count_if(F.col("pv_ct") == 1).cast("double"), sv).alias("uj_rate"),
    )


def channel_stats(page_views: DataFrame, date: str | None = None) -> DataFrame:
    return channel_figures(_day(page_views, date))


def keyword_stats(keywords: DataFrame, date: str | None = None) -> DataFrame:
    return _day(keywords, date).groupBy("keyword").agg(F.sum("keyword_count").alias("keyword_count"))


#: The names of the five series, in order.
SERIES = (("uv_ct", "独立访客数"), ("sv_ct", "会话总数"), ("pv_per_session", "会话平均浏览页面数"), ("dur_per_session", "会话平均停留时长x100"), ("uj_rate", "跳出率"))


def _answer(data) -> Column:
    return F.to_json(F.struct(F.lit(0).alias("status"), F.lit("").alias("msg"), data.alias("data")), {"ignoreNullFields": "false"}).alias("value")


def channel_json(stats: DataFrame) -> DataFrame:
    """(value): one JSON answer with the channels in order of their names and a series for each figure. Channels are few."""
    rows = F.array_sort(F.collect_list(F.struct("ch", *(c for c, _ in SERIES))))
    data = lambda c: F.transform("r", lambda x: x[c].cast("double")).alias("data")
    series = [F.struct(F.lit(name).alias("name"), data(c)) for c, name in SERIES]
    return stats.agg(rows.alias("r")).select(_answer(F.struct(F.transform("r", lambda x: x["ch"]).alias("categories"), F.array(*series).alias("series"))))


def keyword_json(stats: DataFrame, most: int | None = None) -> DataFrame:
    """(value): one JSON answer with all keywords, by falling count, then name. It is one value, so a display of a large vocabulary asks for the ``most`` commonest."""
    top = stats if most is None else stats.orderBy(F.desc("keyword_count"), "keyword").limit(most)
    rows = F.sort_array(F.collect_list(F.struct((-F.col("keyword_count")).alias("k"), F.col("keyword").alias("name"))))
    return top.agg(rows.alias("r")).select(_answer(F.transform("r", lambda x: F.struct(x["name"].alias("name"), (-x["k"]).alias("value")))))
