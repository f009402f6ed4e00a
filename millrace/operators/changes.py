"""Change records (database, table, type, ts, data, old): cleaning, predicates, projection, routing and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE = "`database` string, `table` string, type string, ts bigint, data map<string,string>, old map<string,string>"


def parsed(raw: DataFrame, schema: str = CHANGE, value: str = "value") -> DataFrame:
    """JSON text into columns; malformed, empty and null texts go, and records without any of the columns.

    The text is parsed before a generator, past which Catalyst does not copy it into every expression that uses a column.
    """
    found = raw.select(F.from_json(value, schema).alias("__r")).select(F.inline(F.array("__r")))
    return found.where(reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNotNull() for c in found.columns)))


def cleaned(changes: DataFrame, database: str, types: Sequence[str] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """Records of one database and of some types with data."""
    keep = (F.col("database") == database) & (F.size("data") > 0)
    if types is not None:
        keep &= F.col("type").isin(*types)
    if without:
        keep &= ~F.col("type").isin(*without)
    return changes.where(keep)


def of_table(changes: DataFrame, name: str, *types: str) -> DataFrame:
    found = changes.where(F.col("table") == name)
    return found.where(F.col("type").isin(*types)) if types else found


def changed_to(column: str, after: str, before: str | None = None) -> Column:
    """True where an update moved a column to ``after``, from ``before`` or from any value."""
    old = F.col("old")[column]
    return (old.isNotNull() if before is None else old == before) & (F.col("data")[column] == after)


def projected(changes: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    """Elements of ``data`` as columns; keywords give new names. Missing elements are null."""
    return changes.select(*(F.col("data")[c].alias(c) for c in columns), *(F.col("data")[c].alias(n) for n, c in renamed.items()), "ts")


def cdc(row: str) -> str:
    """Schema of change records as a log-based capture writes them: op (r: snapshot, c, u, d), before, after, ts_ms; ``row`` is that of the table."""
    return f"op string, before struct<{row}>, after struct<{row}>, ts_ms bigint"


def captured(raw: DataFrame, row: str, value: str = "value") -> DataFrame:
    """(op, columns of the row image): raw capture records of one table; malformed ones go."""
    return unwrapped(parsed(raw, cdc(row), value).where("op is not null"))


def unwrapped(cdc: DataFrame) -> DataFrame:
    """Row image of capture records (op, before, after): the earlier one where op is d, else the later one."""
    return cdc.select("op", F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")).alias("row")).select("op", "row.*")


def routed(changes: DataFrame, config: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Records that the configuration names, with its columns; ``data`` keeps the elements listed in sink_columns.

    No hint: Spark broadcasts the configuration while its size is below the session's threshold.
    """
    on = reduce(lambda a, b: a & b, (changes[c] == config[k] for c, k in keys))
    joined = changes.join(config, on)
    names = F.split("sink_columns", ",")
    return joined.withColumn("data", F.map_filter("data", lambda k, _: F.array_contains(names, k)))


def upserted(changes: DataFrame, key: str, columns: Sequence[str], deleted: Column, order: Sequence[str] = ("ts",)) -> DataFrame:
    """State of a keyed table after all changes: for each column the last value that is not null since the last delete.

    ``order`` says which change is later; times alone often tie, so add a sequence where there is one. Changes that
    still tie: deletes come first, and of several values the greatest stays. One aggregate, combined before its shuffle.
    """
    at = F.struct(*order)
    put = ~F.coalesce(deleted, F.lit(False))
    last = [F.max(F.when(put & F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"__{k}") for k, c in enumerate(columns)]
    found = changes.groupBy(key).agg(F.max(F.when(~put, at)).alias("__gone"), F.max(F.when(put, at)).alias("__put"), *last)
    since = lambda c: F.col("__gone").isNull() | (F.col(c) >= F.col("__gone"))
    return found.where(F.col("__put").isNotNull() & since("__put")).select(key, *(F.when(since(f"__{k}.at"), F.col(f"__{k}.v")).alias(c) for k, c in enumerate(columns)))
