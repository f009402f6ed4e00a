"""Facts from change records: order details, cancellations within their retention, and cart additions, by the records' own fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.changes import changed_to, of_table, projected

# Names of the records' fields and codes of an order's status.
DETAIL = ("id", "order_id", "sku_id", "sku_name", "order_price", "sku_num", "create_time", "split_total_amount", "split_activity_amount", "split_coupon_amount")
CART = ("id", "user_id", "sku_id", "cart_price", "sku_name", "is_checked", "create_time", "operate_time", "is_ordered", "order_time", "source_type", "source_id")
PLACED, CANCELLED = "1001", "1005"
#: Seconds that a detail waits for its order, activity and coupon, and for a cancellation.
DETAIL_WAIT, CANCEL_WAIT = 5, 905


def details(changes: DataFrame) -> DataFrame:
    return projected(of_table(changes, "order_detail", "insert"), *DETAIL)


def infos(changes: DataFrame) -> DataFrame:
    return projected(of_table(changes, "order_info", "insert"), "id", "user_id", "province_id")


def activities(changes: DataFrame) -> DataFrame:
    return projected(of_table(changes, "order_detail_activity", "insert"), "order_detail_id", "activity_id", "activity_rule_id")


def coupons(changes: DataFrame) -> DataFrame:
    return projected(of_table(changes, "order_detail_coupon", "insert"), "order_detail_id", "coupon_id")


def cancellations(changes: DataFrame) -> DataFrame:
    """Updates that moved a placed order to cancelled, by the record's old status."""
    return projected(of_table(changes, "order_info", "update").where(changed_to("order_status", CANCELLED, PLACED)), "id", "operate_time")


def order_details(changes: DataFrame) -> DataFrame:
    """Details with their order's user and province (details without an order go), and activity and coupon where there are any."""
    info = infos(changes).select(F.col("id").alias("__o"), "user_id", "province_id")
    activity = activities(changes).select(F.col("order_detail_id").alias("__a"), "activity_id", "activity_rule_id")
    coupon = coupons(changes).select(F.col("order_detail_id").alias("__c"), "coupon_id")
    found = details(changes).join(info, F.col("order_id") == F.col("__o"))
    return found.join(activity, F.col("id") == F.col("__a"), "left").join(coupon, F.col("id") == F.col("__c"), "left").drop("__o", "__a", "__c")


def cancel_columns() -> list[Column]:
    return [
        *(F.col(c) for c in ("id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id")), F.substring("operate_time", 1, 10).alias("date_id"),
        F.col("operate_time").alias("cancel_time"), *(F.col(c) for c in ("sku_num", "split_activity_amount", "split_coupon_amount", "split_total_amount")), F.col("cancel_ts").alias("ts"),
    ]


def cancel_facts(found: DataFrame, cancels: DataFrame, seconds: int = CANCEL_WAIT) -> DataFrame:
    """Details (of ``order_details``) whose order was cancelled, where the two records' times differ by ``seconds`` at most."""
    cancel = cancels.select(F.col("id").alias("__o"), "operate_time", F.col("ts").alias("cancel_ts"))
    near = F.abs(F.col("ts") - F.col("cancel_ts")) <= seconds
    return found.join(cancel, (F.col("order_id") == F.col("__o")) & near).select(*cancel_columns())


def cart_additions(changes: DataFrame) -> DataFrame:
    """Cart records that add something: inserts with their quantity, and updates that raised it by what they added to the record's old one."""
    cart = of_table(changes, "cart_info", "insert", "update")
    new, old = F.expr("try_cast(data['sku_num'] AS int)"), F.expr("try_cast(old['sku_num'] AS int)")
    added = cart.withColumn("__n", F.when(F.col("type") == "insert", new).otherwise(new - old)).where((F.col("type") == "insert") | (new > old))
    return added.select(*(F.col("data")[c].alias(c) for c in CART), F.col("__n").alias("sku_num"), "ts")
