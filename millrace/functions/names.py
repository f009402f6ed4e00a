"""Column names between snake_case and camelCase."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def to_camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(w.capitalize() for w in rest)


def to_snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def renamed(df: DataFrame, rule) -> DataFrame:
    return df.toDF(*(rule(c) for c in df.columns))
