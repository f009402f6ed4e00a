"""Queries over change records and raw logs made from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import changes, logs

from .inputs import table

CONFIG = [("signup", "insert", "dim_user", "event_id,user_id"), ("purchase", "insert", "dwd_payment", "event_id,user_id,props"), ("view", "update", "dwd_view", "user_id,event_type")]


def _change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON change records: every tenth is malformed, every seventh lies in another database."""
    data = F.create_map(*(x for c in ("event_id", "user_id", "event_type", "props") for x in (F.lit(c), F.col(c).cast("string"))))
    whole = F.to_json(F.struct(
        F.when(F.col("event_id") % 7 == 0, "other").otherwise("shop").alias("database"), F.col("event_type").alias("table"), F.when(F.col("event_type") == "view", "update").otherwise("insert").alias("type"),
        F.col("event_id").alias("ts"), data.alias("data"),
    ))
    return table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(whole).alias("value"))


def dim_etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.cleaned(changes.parsed(_change_log(spark, sf_dir)), "shop", without=("bootstrap-start", "bootstrap-complete"))
    return changes.projected(found, "user_id", "event_type", id="event_id")


def config_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame(CONFIG, "source_table string, source_type string, sink_table string, sink_columns string")
    found = changes.cleaned(changes.parsed(_change_log(spark, sf_dir)), "shop", types=("insert", "update"))
    found = changes.routed(found, config, [("table", "source_table"), ("type", "source_type")])
    return found.select("ts", "sink_table", F.array_join(F.transform(F.map_entries("data"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("data"))


def dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a user table after all events: an error deletes, a view leaves the value as it was."""
    log = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value")))
    return changes.upserted(log, "user_id", ["event_type", "value", "props"], F.col("event_type") == "error")


def dim_upsert_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with times that tie within a day: the event's number tells which change is later."""
    log = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "view", F.col("value"))).withColumn("ts", F.date_trunc("day", "ts"))
    return changes.upserted(log, "user_id", ["event_type", "value", "props"], F.col("event_type") == "error", ["ts", "event_id"])


def cdc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row images of capture records made from events: errors delete, sign-ups create, every ninth record is malformed."""
    row = F.struct("event_id", "user_id", "event_type")
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    raw = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 == 0, F.lit("[1,")).otherwise(F.to_json(F.struct(
        op.alias("op"), F.when(op != "c", row).alias("before"), F.when(op != "d", row).alias("after"), F.col("event_id").alias("ts_ms"),
    ))).alias("value"))
    return changes.captured(raw, "event_id: bigint, user_id: bigint, event_type: string")


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that moved an order's status to F, from O or from anything, by the record's old values."""
    data, old = (F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"))), F.create_map(F.lit("status"), F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise("P"))
    log = table(spark, sf_dir, "orders").select(F.lit("order_info").alias("table"), F.when(F.col("o_orderkey") % 5 == 0, "insert").otherwise("update").alias("type"), F.col("o_orderkey").alias("ts"), data.alias("data"), old.alias("old"))
    log = changes.of_table(log, "order_info", "update")
    return log.where(changes.changed_to("status", "F")).select(F.col("data")["id"].alias("id"), changes.changed_to("status", "F", "O").alias("was_open"))


def log_split_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the rows of raw behaviour logs are split: errors have an error, sign-ups a start (with a page where the number is even), others a page."""
    start, page = F.col("event_type") == "signup", (F.col("event_type") != "signup") | (F.col("event_id") % 2 == 0)
    raw = table(spark, sf_dir, "events").select(F.to_json(F.struct(
        F.struct(F.col("user_id").cast("string").alias("mid")).alias("common"), F.when(page, F.struct(F.col("event_type").alias("page_id"))).alias("page"), F.when(start, F.create_map(F.lit("entry"), F.lit("icon"))).alias("start"),
        F.when(F.col("event_type") == "error", F.create_map(F.lit("code"), F.col("event_id").cast("string"))).alias("err"), F.array(F.create_map(F.lit("a"), F.lit("b"))).alias("displays"), F.col("event_id").alias("ts"),
    )).alias("value"))
    out = logs.split(logs.cleaned(raw))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return (
        out["err"].select(F.lit("err").alias("kind"), F.col("err")["code"].cast("bigint").alias("id"), none("page_id"), none("entry"))
        .unionByName(out["start"].select(F.lit("start").alias("kind"), F.col("ts").alias("id"), "page.page_id", F.col("start")["entry"].alias("entry")))
        .unionByName(out["page"].select(F.lit("page").alias("kind"), F.col("ts").alias("id"), "page.page_id", F.col("start")["entry"].alias("entry")))
        .unionByName(out["display"].select(F.lit("display").alias("kind"), F.col("ts").alias("id"), "page.page_id", none("entry")))
    )


def log_split_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action rows of raw behaviour logs: event k % 4 of the properties gives how many actions a page has."""
    e = table(spark, sf_dir, "events")
    many = (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 4).alias("n")
    action = F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda k: F.create_map(F.lit("action_id"), k.cast("string")))).otherwise(F.expr("array()"))
    raw = e.select(F.when(F.col("event_id") % 10 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(
        F.struct(F.col("user_id").cast("string").alias("mid")).alias("common"), F.struct(F.col("event_type").alias("page_id")).alias("page"), action.alias("actions"), F.col("event_id").alias("ts"),
    ))).alias("value"))
    return logs.split(logs.cleaned(raw))["action"].select(F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"), F.col("action")["action_id"].alias("action_id"), "ts")


_GOOD = "event_id % 10 <> 0 AND event_id % 7 <> 0"
_PICK = ", ".join(f"CASE WHEN list_contains(string_split(sink_columns, ','), '{c}') THEN '{c}=' || CAST({c} AS VARCHAR) END" for c in ("event_id", "user_id", "event_type", "props"))
SQL = {
    "dim_etl": f"SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type, event_id AS ts FROM events WHERE {_GOOD}",
    "config_routing": f"""
        SELECT event_id AS ts, sink_table, concat_ws(';', {_PICK}) AS data FROM events
        JOIN (VALUES {", ".join(str(c) for c in CONFIG)}) AS cfg(source_table, source_type, sink_table, sink_columns)
        ON event_type = source_table AND CASE WHEN event_type = 'view' THEN 'update' ELSE 'insert' END = source_type WHERE {_GOOD}""",
    "dim_upsert": """
        SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(v, ts) FILTER (v IS NOT NULL) AS value, arg_max(props, ts) AS props FROM (
            SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v, MAX(ts) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS gone FROM events)
        WHERE gone IS NULL OR ts > gone GROUP BY user_id""",
    "dim_upsert_ties": """
        SELECT user_id, arg_max(event_type, o) AS event_type, arg_max(v, o) FILTER (v IS NOT NULL) AS value, arg_max(props, o) AS props FROM (
            SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v, MAX(o) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS gone
            FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY date_trunc('day', ts), event_id) AS o FROM events))
        WHERE gone IS NULL OR o > gone GROUP BY user_id""",
    "cdc_rows": "SELECT CASE WHEN event_type = 'error' THEN 'd' WHEN event_type = 'signup' THEN 'c' ELSE 'u' END AS op, event_id, user_id, event_type FROM events WHERE event_id % 9 <> 0",
    "status_changes": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 2 = 0 AS was_open FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 <> 0",
    "log_split_kinds": """
        SELECT 'err' AS kind, event_id AS id, NULL AS page_id, NULL AS entry FROM events WHERE event_type = 'error'
        UNION ALL SELECT 'start', event_id, CASE WHEN event_id % 2 = 0 THEN event_type END, 'icon' FROM events WHERE event_type = 'signup'
        UNION ALL SELECT 'page', event_id, event_type, CASE WHEN event_type = 'signup' THEN 'icon' END FROM events WHERE event_type <> 'signup' OR event_id % 2 = 0
        UNION ALL SELECT 'display', event_id, event_type, NULL FROM events WHERE event_type <> 'signup' OR event_id % 2 = 0""",
    "log_split_actions": """
        SELECT CAST(user_id AS VARCHAR) AS mid, event_type AS page_id, CAST(unnest(range(1, CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 + 1)) AS VARCHAR) AS action_id, event_id AS ts
        FROM events WHERE event_id % 10 <> 0""",
}
QUERIES = {f.__name__: f for f in (dim_etl, config_routing, dim_upsert, dim_upsert_ties, cdc_rows, status_changes, log_split_actions, log_split_kinds)}
