"""Trade queries: order facts, payments, refunds, carts, and windows of order amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import keyed, windows
from millrace.operators.dimensions import Dim, enrich, enrich_all

from .inputs import LINE_ORDER, MONEY, edges_sql, table

LINE = ["l_orderkey", "l_linenumber"]
PRIORITIES = [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("5-LOW", "low")]
FLAGS = [("R", "returned"), ("A", "accepted"), ("N", "none")]


def _dictionary(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "dic_code string, dic_name string")


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.firsts(table(spark, sf_dir, "lineitem"), LINE, LINE_ORDER, [*LINE, *LINE_ORDER])


def order_details(detail: DataFrame, orders: DataFrame, activity: DataFrame, coupon: DataFrame, key: list[str], order_id: str = "order_id") -> DataFrame:
    """Details with their order, and with activity and coupon where there are any: one final row for each detail."""
    return detail.join(orders, order_id).join(activity, key, "left").join(coupon, key, "left")


def order_detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = _details(spark, sf_dir)  # one aggregate, whose exchange all three uses share
    activity = detail.where("l_discount > 0.05").select(*LINE, F.col("l_discount").alias("activity"))
    coupon = detail.where("l_tax > 0.04").select(*LINE, F.col("l_tax").alias("coupon"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    found = order_details(detail.select(*LINE, "l_partkey", "l_quantity", "l_extendedprice"), orders, activity, coupon, LINE, "l_orderkey")
    return found.select(*LINE, "l_partkey", "l_quantity", "l_extendedprice", "o_custkey", "o_orderstatus", "activity", "coupon")


def _amounts(lines: DataFrame) -> DataFrame:
    """Lines with the four amounts of an order detail: before and after what activity and coupon take off."""
    price = F.col("l_extendedprice").cast(MONEY)
    cut = lambda c: F.round(price * F.col(c).cast("decimal(9,4)"), 2).cast(MONEY)
    found = lines.withColumn("original_amount", price).withColumn("activity_reduce_amount", cut("l_discount")).withColumn("coupon_reduce_amount", cut("l_tax"))
    return found.withColumn("order_amount", (F.col("original_amount") - F.col("activity_reduce_amount") - F.col("coupon_reduce_amount")).cast(MONEY))


AMOUNTS = ["original_amount", "activity_reduce_amount", "coupon_reduce_amount", "order_amount"]


def order_cancel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled orders (status F) with each of their details once and its amounts, where the detail came at most 30 days after the order."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    detail = _amounts(_details(spark, sf_dir)).select(*LINE, "l_partkey", "l_quantity", "l_shipdate", *AMOUNTS[1:])
    found = detail.join(orders, "l_orderkey").where(F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 30 days"))
    return found.select(
        *LINE, "o_custkey", "l_partkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("cancel_time"), F.col("l_quantity").alias("sku_num"),
        *(F.col(a).cast("double").alias(a) for a in AMOUNTS[1:]),
    )


def sku_facts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four amounts of each part in windows of 10 seconds. Repeated details count once, with their last amounts; the supplier is that
    of the window's first detail; names of six look-ups come after the sums."""
    lines = _amounts(table(spark, sf_dir, "lineitem")).select(*LINE, *LINE_ORDER, *AMOUNTS)
    changed = keyed.deltas(lines, LINE, LINE_ORDER, AMOUNTS)
    first = F.min(F.struct(*LINE, "l_suppkey"))["l_suppkey"].alias("spu_id")
    found = windows.tumbling(changed, "l_shipdate", "10 seconds", ["l_partkey"], first, *(F.sum(c).cast("double").alias(c) for c in AMOUNTS))
    part = table(spark, sf_dir, "part")
    brands, kinds = part.groupBy("p_brand").agg(F.min("p_name").alias("tm_name")), part.groupBy("p_type").agg(F.max("p_name").alias("name"))
    tables = {"part": part, "brand": brands, "kind": kinds} | {t: table(spark, sf_dir, t) for t in ("supplier", "nation", "region")}
    return enrich_all(
        found, tables, Dim("part", "p_partkey", "l_partkey", {"p_name": "sku_name", "p_brand": "tm_id", "p_type": "category3_id"}), Dim("supplier", "s_suppkey", "spu_id", {"s_name": "spu_name", "s_nationkey": "category2_id"}),
        Dim("brand", "p_brand", "tm_id", {"tm_name": "tm_name"}), Dim("kind", "p_type", "category3_id", {"name": "category3_name"}),
        Dim("nation", "n_nationkey", "category2_id", {"n_name": "category2_name", "n_regionkey": "category1_id"}), Dim("region", "r_regionkey", "category1_id", {"r_name": "category1_name"}),
    )


def order_cancel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cancelled = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    lines = table(spark, sf_dir, "lineitem").join(cancelled, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(*LINE, "l_partkey", "l_quantity", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("cancel_time"))


def payment_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped from 5 days before to 15 days after their order, with the name of the order's priority (known ones only)."""
    near = F.col("l_shipdate").between(F.expr("o_orderdate - interval 5 days"), F.expr("o_orderdate + interval 15 days"))
    paid = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), (F.col("l_orderkey") == F.col("o_orderkey")) & near)
    named = enrich(paid, _dictionary(spark, PRIORITIES), Dim("dic", "dic_code", "o_orderpriority", {"dic_name": "payment_type_name"}), "inner")
    return named.select(*LINE, "l_partkey", "o_custkey", "payment_type_name", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("callback_time"), F.col("l_extendedprice").alias("amount"))


def refund_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines with their order and two look-ups of one dictionary."""
    refund = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    dic = _dictionary(spark, FLAGS + PRIORITIES)
    found = enrich(refund, dic, Dim("dic", "dic_code", "l_returnflag", {"dic_name": "refund_type_name"}), "inner")
    found = enrich(found, dic, Dim("dic", "dic_code", "o_orderpriority", {"dic_name": "refund_reason_name"}), "inner")
    return found.select(*LINE, "o_custkey", "refund_type_name", "refund_reason_name", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_id"), F.col("l_quantity").alias("refund_num"))


def refund_pay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refund payments matched to refunds on order and part, then to the order."""
    lines = table(spark, sf_dir, "lineitem")
    pay = lines.where("l_linestatus = 'F'").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("refund_amount"))
    refund = lines.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("refund_num"))
    return pay.join(refund, ["l_orderkey", "l_partkey"]).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_custkey", "refund_amount", "refund_num")


def comment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dic = _dictionary(spark, PRIORITIES)
    return enrich(table(spark, sf_dir, "orders"), dic, Dim("dic", "dic_code", "o_orderpriority", {"dic_name": "appraise_name"}), "inner").select("o_orderkey", "o_custkey", "appraise_name")


def cart_add_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities added to carts: first quantities, and increases by what they exceed the one before."""
    number = F.try_to_number(F.regexp_extract("props", "[0-9]+", 0), F.lit("999999999")).cast("int").alias("sku_num")
    cart = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "ts", number)
    old = F.lag("sku_num").over(keyed._by(["user_id"], ["ts", "event_id"]))
    cart = cart.withColumn("old", old).where("old is null or sku_num > old")
    return cart.select("event_id", "user_id", F.when(F.col("old").isNull(), F.col("sku_num")).otherwise(F.col("sku_num") - F.col("old")).alias("sku_num"))


def sku_order_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order amounts by day, part and supplier; repeated details count once, with their last amounts. Names come after the sums."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE, *LINE_ORDER, (F.col("l_extendedprice").cast(MONEY) * F.col("l_quantity").cast("decimal(9,0)")).alias("order_amount"), F.col("l_extendedprice").cast(MONEY).alias("original_amount"))
    changed = keyed.deltas(lines, LINE, LINE_ORDER, ["order_amount", "original_amount"])
    sums = [F.sum(c).cast("double").alias(c) for c in ("order_amount", "original_amount")]
    found = windows.tumbling(changed, "l_shipdate", "1 day", ["l_partkey", "l_suppkey"], *sums)
    tables = {t: table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region")}
    return enrich_all(
        found, tables, Dim("part", "p_partkey", "l_partkey", {"p_name": "sku_name", "p_brand": "tm_name", "p_type": "category_name"}),
        Dim("supplier", "s_suppkey", "l_suppkey", {"s_name": "spu_name", "s_nationkey": "nation_id"}), Dim("nation", "n_nationkey", "nation_id", {"n_name": "category2_name", "n_regionkey": "region_id"}),
        Dim("region", "r_regionkey", "region_id", {"r_name": "category1_name"}),
    )


def province_order_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and orders by day and nation; repeated details count once."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE, *LINE_ORDER, F.col("l_extendedprice").cast(MONEY).alias("amount"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    joined = keyed.deltas(lines, LINE, LINE_ORDER, ["amount"]).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = windows.tumbling(joined, "o_orderdate", "1 day", ["c_nationkey"], F.sum("amount").cast("double").alias("order_amount"), F.count_distinct("l_orderkey").alias("order_count"))
    return enrich(found, table(spark, sf_dir, "nation"), Dim("nation", "n_nationkey", "c_nationkey", {"n_name": "province_name"}))


_ORDER = ", ".join(LINE_ORDER)
_LAG = f"OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER})"
_DIC = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FLAGS + PRIORITIES) + ") AS {0}(dic_code, dic_name)"
_PRI = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PRIORITIES) + ") AS {0}(dic_code, dic_name)"
_CUT = "CAST(l_extendedprice AS DECIMAL(18,2)) AS o, " + ", ".join(f"CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST({x} AS DECIMAL(9,4)), 2) AS DECIMAL(18,2)) AS {n}" for x, n in (("l_discount", "a"), ("l_tax", "c")))
_DETAIL = f"(SELECT * FROM lineitem QUALIFY ROW_NUMBER() {_LAG} = 1)"
SQL = {
    "order_detail_join": f"""
        WITH d AS {_DETAIL}
        SELECT d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_quantity, d.l_extendedprice, o_custkey, o_orderstatus, a.l_discount AS activity, c.l_tax AS coupon
        FROM d JOIN orders ON d.l_orderkey = o_orderkey
        LEFT JOIN (SELECT * FROM d WHERE l_discount > 0.05) a ON a.l_orderkey = d.l_orderkey AND a.l_linenumber = d.l_linenumber
        LEFT JOIN (SELECT * FROM d WHERE l_tax > 0.04) c ON c.l_orderkey = d.l_orderkey AND c.l_linenumber = d.l_linenumber""",
    "order_cancel_facts": f"""
        WITH d AS (SELECT *, {_CUT} FROM {_DETAIL})
        SELECT l_orderkey, l_linenumber, o_custkey, l_partkey, strftime(o_orderdate, '%Y-%m-%d') AS date_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS cancel_time, l_quantity AS sku_num,
            CAST(a AS DOUBLE) AS activity_reduce_amount, CAST(c AS DOUBLE) AS coupon_reduce_amount, CAST(o - a - c AS DOUBLE) AS order_amount
        FROM d JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_shipdate <= o_orderdate + INTERVAL 30 DAY""",
    "sku_facts_window": f"""
        WITH m AS (SELECT *, o - a - c AS f FROM (SELECT *, {_CUT} FROM lineitem)),
        l AS (SELECT *, {", ".join(f"{x} - COALESCE(LAG({x}) {_LAG}, 0) AS {x}d" for x in "oacf")} FROM m),
        w AS (SELECT {edges_sql("l_shipdate", 10)}, l_partkey, arg_min(l_suppkey, l_orderkey * 100 + l_linenumber) AS spu_id, CAST(SUM(od) AS DOUBLE) AS original_amount, CAST(SUM(ad) AS DOUBLE) AS activity_reduce_amount,
            CAST(SUM(cd) AS DOUBLE) AS coupon_reduce_amount, CAST(SUM(fd) AS DOUBLE) AS order_amount FROM l GROUP BY ALL)
        SELECT w.*, p_name AS sku_name, p.p_brand AS tm_id, p.p_type AS category3_id, s_name AS spu_name, s_nationkey AS category2_id, b.m AS tm_name, k.m AS category3_name, n_name AS category2_name, n_regionkey AS category1_id, r_name AS category1_name
        FROM w LEFT JOIN part p ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = spu_id LEFT JOIN (SELECT p_brand, MIN(p_name) AS m FROM part GROUP BY 1) b ON b.p_brand = p.p_brand
        LEFT JOIN (SELECT p_type, MAX(p_name) AS m FROM part GROUP BY 1) k ON k.p_type = p.p_type LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "order_cancel_join": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS date_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS cancel_time
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
    "payment_interval_join": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, dic_name AS payment_type_name, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS callback_time, l_extendedprice AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 5 DAY AND o_orderdate + INTERVAL 15 DAY
        JOIN {_PRI.format("dic")} ON dic_code = o_orderpriority""",
    "refund_join": f"""
        SELECT l_orderkey, l_linenumber, o_custkey, d1.dic_name AS refund_type_name, d2.dic_name AS refund_reason_name, strftime(l_shipdate, '%Y-%m-%d') AS date_id, l_quantity AS refund_num
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN {_DIC.format("d1")} ON d1.dic_code = l_returnflag JOIN {_DIC.format("d2")} ON d2.dic_code = o_orderpriority
        WHERE l_returnflag = 'R'""",
    "refund_pay_join": """
        SELECT p.l_orderkey, p.l_partkey, o_custkey, refund_amount, refund_num
        FROM (SELECT l_orderkey, l_partkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS refund_amount FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) p
        JOIN (SELECT l_orderkey, l_partkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS refund_num FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) r
        ON p.l_orderkey = r.l_orderkey AND p.l_partkey = r.l_partkey JOIN orders ON p.l_orderkey = o_orderkey""",
    "comment_lookup": f"SELECT o_orderkey, o_custkey, dic_name AS appraise_name FROM orders JOIN {_PRI.format('dic')} ON dic_code = o_orderpriority",
    "cart_add_delta": """
        SELECT event_id, user_id, CAST(CASE WHEN old IS NULL THEN sku_num ELSE sku_num - old END AS INT) AS sku_num FROM (
            SELECT *, LAG(sku_num) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old
            FROM (SELECT event_id, user_id, ts, CAST(regexp_extract(props, '[0-9]+') AS INT) AS sku_num FROM events WHERE event_type = 'click')) WHERE old IS NULL OR sku_num > old""",
    "sku_order_window": f"""
        SELECT w.*, p_name AS sku_name, p_brand AS tm_name, p_type AS category_name, s_name AS spu_name, s_nationkey AS nation_id, n_name AS category2_name, n_regionkey AS region_id, r_name AS category1_name
        FROM (SELECT {edges_sql("l_shipdate", 86400)}, l_partkey, l_suppkey, CAST(SUM(oa) AS DOUBLE) AS order_amount, CAST(SUM(pa) AS DOUBLE) AS original_amount FROM (
            SELECT *, a - COALESCE(LAG(a) {_LAG}, 0) AS oa, b - COALESCE(LAG(b) {_LAG}, 0) AS pa
            FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(9,0)) AS a, CAST(l_extendedprice AS DECIMAL(18,2)) AS b FROM lineitem)) GROUP BY ALL) w
        LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "province_order_window": f"""
        SELECT w.*, n_name AS province_name FROM (
            SELECT {edges_sql("o_orderdate", 86400)}, c_nationkey, CAST(SUM(amount) AS DOUBLE) AS order_amount, COUNT(DISTINCT l_orderkey) AS order_count
            FROM (SELECT *, b - COALESCE(LAG(b) {_LAG}, 0) AS amount FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS b FROM lineitem))
            JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) w LEFT JOIN nation ON n_nationkey = c_nationkey""",
}
QUERIES = {
    f.__name__: f
    for f in (order_detail_join, order_cancel_facts, sku_facts_window, order_cancel_join, payment_interval_join, refund_join, refund_pay_join, comment_lookup, cart_add_delta, sku_order_window, province_order_window)
}
