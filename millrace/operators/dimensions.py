"""Dimension look-ups as left joins. There is no cache to go stale, and no hint: Spark broadcasts a dimension while its
size is below the session's threshold and joins by sorting beyond it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dim:
    """Look up ``key`` (a column of the facts) in ``table`` by ``id``, and take ``columns`` (theirs to ours)."""

    table: str
    id: str
    key: str
    columns: Mapping[str, str]


def enrich(df: DataFrame, dim: DataFrame, spec: Dim, how: str = "left") -> DataFrame:
    """``df`` with the columns of one dimension; rows without a match get nulls (how=left) or go (how=inner)."""
    side = dim.select(F.col(spec.id).alias("__key"), *(F.col(c).alias(n) for c, n in spec.columns.items()))
    return df.join(side, F.col(spec.key) == F.col("__key"), how).drop("__key")


def enrich_all(df: DataFrame, tables: Mapping[str, DataFrame], *specs: Dim) -> DataFrame:
    """A chain of look-ups; a later one may use columns of an earlier one."""
    for spec in specs:
        df = enrich(df, tables[spec.table], spec)
    return df
