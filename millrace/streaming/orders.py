"""Order facts as changelogs of a stream of change records: regular joins with a bounded wait, retracted and replaced as records come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import orders
from millrace.streaming.changelog import Side, changelog_join
from millrace.streaming.jobs import DELAY


def watermarked(changes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Change records with ``ts`` as a timestamp and a watermark that follows the records of all tables.

    Watermarks of several inputs advance with the slowest, so a table that is quiet would hold back all others. Behind a generator Catalyst cannot
    filter the records by table before the watermark has seen them.
    """
    rest = [c for c in changes.columns if c != "ts"]
    timed = changes.select(F.timestamp_seconds("ts").alias("ts"), F.struct(*rest).alias("__r")).withWatermark("ts", delay)
    return timed.select("ts", F.inline(F.array("__r")))


def _seconds(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_seconds(c) for c in columns})


def order_detail_changes(changes: DataFrame, wait: float = orders.DETAIL_WAIT, delay: str = DELAY) -> DataFrame:
    """(kind, seq, changed, columns of ``orders.order_details``): details join their order first, then wait for activity and coupon."""
    log = watermarked(changes, delay)
    side = lambda rows, key, *columns, **how: Side(rows, [key], "ts", {c: c for c in columns}, watermarked=True, **how)
    placed = changelog_join(side(orders.details(log), "order_id", *orders.DETAIL, "ts"), side(orders.infos(log), "id", "user_id", "province_id"), retention=wait, delay=delay)
    base = Side(placed, ["id"], "changed", kind="kind", watermarked=True)
    activity = side(orders.activities(log), "order_detail_id", "activity_id", "activity_rule_id", required=False)
    return _seconds(changelog_join(base, activity, side(orders.coupons(log), "order_detail_id", "coupon_id", required=False), retention=wait, delay=delay), "ts")


def cancel_changes(details: DataFrame, changes: DataFrame, wait: float = orders.CANCEL_WAIT, delay: str = DELAY) -> DataFrame:
    """(kind, seq, changed, columns of ``orders.cancel_facts``): details (as ``order_detail_changes`` gives them) that were cancelled within the wait."""
    base = Side(details, ["order_id"], "changed", kind="kind", watermarked=True)
    cancel = Side(orders.cancellations(watermarked(changes, delay)), ["id"], "ts", {"operate_time": "operate_time", "ts": "cancel_ts"}, watermarked=True)
    return _seconds(changelog_join(base, cancel, retention=wait, delay=delay), "cancel_ts").select("kind", "seq", "changed", *orders.cancel_columns())
