"""Queries that begin with raw change records, as a whole job would get them: made from the provided tables, parsed, cleaned and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import date_time_to_millis
from millrace.operators import changes, keyed, orders, windows
from millrace.sources import files

from .inputs import LINE_ORDER, edges_sql, table

LINE = ["l_orderkey", "l_linenumber"]
#: Time of an order's records in seconds, by its number.
_TIME = "(1704067200 + 60 * {0})"


def _record(name: str, kind: Column | str, ts: Column, broken: Column, old: Column | None = None, **data: Column) -> Column:
    """A record as JSON text; every broken one is cut short. Data are numbers, times and codes, which hold nothing that JSON escapes.

    The text is put together from its parts, a fifth of what ``to_json`` costs; where a part is null, ``to_json`` writes the record.
    """
    data, kind = {k: v.cast("string") for k, v in data.items()}, F.lit(kind) if isinstance(kind, str) else kind
    values = F.create_map(*(x for k, v in data.items() for x in (F.lit(k), v)))
    parts = [F.lit("shop").alias("database"), F.lit(name).alias("table"), kind.alias("type"), ts.cast("bigint").alias("ts"), values.alias("data")]
    slow = F.to_json(F.struct(*parts, *([] if old is None else [old.alias("old")])))
    pairs = [x for k, (n, v) in enumerate(data.items()) for x in (F.lit(f'{"" if k == 0 else '",'}"{n}":"'), v)]
    last = [F.lit('"}}')] if old is None else [F.lit('"},"old":'), F.to_json(old), F.lit("}")]
    fast = F.concat(F.lit(f'{{"database":"shop","table":"{name}","type":"'), kind, F.lit('","ts":'), ts.cast("bigint").cast("string"), F.lit(',"data":{'), *pairs, *last)
    whole = F.coalesce(fast, slow)
    return F.when(broken, F.substring(whole, 1, 40)).otherwise(whole).alias("value")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.firsts(table(spark, sf_dir, "lineitem"), LINE, LINE_ORDER, [*LINE, *LINE_ORDER])


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): placed orders and their cancellations, details, activities and coupons; some records are cut short, some updates begin elsewhere."""
    o, d = table(spark, sf_dir, "orders"), _lines(spark, sf_dir)
    time, line_time = F.expr(_TIME.format("o_orderkey")), F.expr(f"{_TIME.format('l_orderkey')} + l_partkey % 1200")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber")
    cancel_time = time + 1000 + F.col("o_custkey") % 600
    old = F.create_map(F.lit("order_status"), F.when(F.col("o_orderkey") % 3 == 0, "1002").otherwise("1001"))
    never = F.lit(False)
    # one row of the table gives all its records, so that each table is read, and the lines' first rows are found, once
    of_order = [
        _record("order_info", "insert", time, F.col("o_orderkey") % 11 == 0, id=F.col("o_orderkey"), user_id=F.col("o_custkey"), province_id=F.col("o_custkey") % 34, order_status=F.lit("1001")),
        F.when(F.col("o_orderstatus") != "O", _record(
            "order_info", "update", cancel_time, never, old, id=F.col("o_orderkey"), order_status=F.when(F.col("o_orderstatus") == "F", "1005").otherwise("1002"), operate_time=F.date_format(F.timestamp_seconds(cancel_time), "yyyy-MM-dd HH:mm:ss"),
        )),
    ]
    of_line = [
        _record("order_detail", "insert", line_time, F.col("l_partkey") % 50 == 0, id=ident, order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), sku_num=F.col("l_quantity").cast("int")),
        F.when(F.col("l_discount") > F.expr("0.05"), _record("order_detail_activity", "insert", line_time, never, order_detail_id=ident, activity_id=F.col("l_suppkey") % 5, activity_rule_id=F.col("l_suppkey"))),
        F.when(F.col("l_tax") > F.expr("0.04"), _record("order_detail_coupon", "insert", line_time, never, order_detail_id=ident, coupon_id=F.col("l_suppkey") % 7)),
    ]
    return _texts(o, of_order).union(_texts(d, of_line))


def _texts(rows: DataFrame, records: list[Column]) -> DataFrame:
    """(value): all records of each row. They are columns first, which Spark compiles; inside the generator it would interpret them."""
    named = rows.select(*(r.alias(f"__{k}") for k, r in enumerate(records)))
    return named.select(F.explode(F.array(*named.columns)).alias("value")).where("value is not null")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned records, parsed once and kept by table: each join then reads the records of its own table only."""
    return files.kept(changes.cleaned(changes.parsed(change_log(spark, sf_dir)), "shop").drop("database"), "table")


def order_details_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orders.order_details(_log(spark, sf_dir))
    return found.select("id", "order_id", "sku_id", "sku_num", "user_id", "province_id", "activity_id", "activity_rule_id", "coupon_id", "ts")


def order_cancel_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that were cancelled (from placed, by the record's old status) at most 905 seconds before or after their own record."""
    log = _log(spark, sf_dir)
    return orders.cancel_facts(orders.order_details(log), orders.cancellations(log)).select("id", "order_id", "user_id", "sku_id", "activity_id", "coupon_id", "date_id", "cancel_time", "sku_num", "ts")


def cart_add_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions to carts by the records' own old quantities; some records are cut short, some updates do not name the quantity."""
    number = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    event, before = F.col("event_id"), F.col("user_id") % 60
    old = F.when(event % 5 == 0, F.create_map(F.lit("is_checked"), F.lit("0"))).otherwise(F.create_map(F.lit("sku_num"), before.cast("string")))
    kind = F.when(F.col("event_type") == "click", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    raw = table(spark, sf_dir, "events").select(_record("cart_info", kind, F.unix_seconds(F.col("ts").cast("timestamp")), event % 13 == 0, old, id=event, user_id=F.col("user_id"), sku_num=number))
    return orders.cart_additions(changes.cleaned(changes.parsed(raw), "shop")).select("id", "user_id", "sku_num", "ts")


def register_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups by windows of their records' create_time; records without a time that can be read go."""
    text = F.when(F.col("event_id") % 9 == 0, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.to_json(F.struct(F.col("event_id").alias("id"), text.alias("create_time"))).alias("value"))
    found = changes.parsed(raw, "id bigint, create_time string").withColumn("ts", F.timestamp_millis(date_time_to_millis(F.col("create_time")))).where("ts is not null")
    return windows.tumbling(found, "ts", "10 seconds", [], F.count("*").alias("register_ct"))


_DETAILS = f"""
    WITH l AS (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, {_TIME.format("l_orderkey")} + l_partkey % 1200 AS ts
        FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_ORDER)}) = 1),
    d AS (SELECT id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS sku_num, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_custkey % 34 AS VARCHAR) AS province_id,
            CASE WHEN l_discount > 0.05 THEN CAST(l_suppkey % 5 AS VARCHAR) END AS activity_id, CASE WHEN l_discount > 0.05 THEN CAST(l_suppkey AS VARCHAR) END AS activity_rule_id, CASE WHEN l_tax > 0.04 THEN CAST(l_suppkey % 7 AS VARCHAR) END AS coupon_id, ts, o_orderstatus, o_orderkey, o_custkey
        FROM l JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 50 <> 0 AND o_orderkey % 11 <> 0)"""
SQL = {
    "order_details_from_log": f"{_DETAILS} SELECT id, order_id, sku_id, sku_num, user_id, province_id, activity_id, activity_rule_id, coupon_id, ts FROM d",
    "order_cancel_within": f"""{_DETAILS},
    c AS (SELECT *, {_TIME.format("o_orderkey")} + 1000 + o_custkey % 600 AS cts FROM d WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0)
    SELECT id, order_id, user_id, sku_id, activity_id, coupon_id, strftime(make_timestamp(cts * 1000000), '%Y-%m-%d') AS date_id, strftime(make_timestamp(cts * 1000000), '%Y-%m-%d %H:%M:%S') AS cancel_time, sku_num, cts AS ts
    FROM c WHERE abs(ts - cts) <= 905""",
    "cart_add_from_log": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'click' THEN n ELSE n - CAST(user_id % 60 AS INT) END AS sku_num, CAST(floor(epoch(ts)) AS BIGINT) AS ts
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS n FROM events) WHERE event_id % 13 <> 0 AND (event_type = 'click' OR (event_type <> 'error' AND event_id % 5 <> 0 AND n > user_id % 60))""",
    "register_from_log": f"SELECT {edges_sql('ts', 10)}, COUNT(*) AS register_ct FROM events WHERE event_type = 'signup' AND event_id % 9 <> 0 GROUP BY ALL",
}
QUERIES = {f.__name__: f for f in (order_details_from_log, order_cancel_within, cart_add_from_log, register_from_log)}
