"""Traffic and user queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import split_words
from millrace.operators import keyed, rules, segmentation, windows
from millrace.sources import serving

from .inputs import PAGE_LOG_SQL, edges_sql, page_log, table

ORDER = ["ts", "event_id"]


def total(column, name):
    return F.sum(column).cast("bigint").alias(name)


def page_view_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visitor's first view of a day is flagged by a hash aggregate that is joined back; one aggregate gives all figures."""
    log = keyed.first_of_day_flags(page_log(spark, sf_dir), ["mid"], "ts", ORDER, "uv")
    return windows.tumbling(log, "ts", "10 seconds", ["ch", "vc", "ar", "is_new"], total("uv", "uv_ct"), total("sv", "sv_ct"), F.count("*").alias("pv_ct"), F.sum("dur").cast("double").alias("dur_sum"))


def home_detail_uv_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rules.home_or_detail(page_log(spark, sf_dir), "event_type", home="view", detail="click")
    first = keyed.first_times(log, ["mid", "event_type"], "ts")
    return windows.tumbling(first, "ts", "10 seconds", [], F.count_if(F.col("event_type") == "view").alias("home_uv_ct"), F.count_if(F.col("event_type") == "click").alias("good_detail_uv_ct"))


def login_back_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = page_log(spark, sf_dir).where("event_type = 'signup'")
    first = keyed.first_times(log, ["mid"], "ts").withColumn("back", keyed.returning(["mid"], "ts", ["ts"]))
    return windows.tumbling(first, "ts", "10 seconds", [], F.count("*").alias("uu_ct"), total("back", "back_ct"))


def register_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(page_log(spark, sf_dir).where("event_type = 'signup'"), "ts", "10 seconds", [], F.count("*").alias("register_ct"))


def cart_uu_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = keyed.first_times(page_log(spark, sf_dir).where("event_type = 'click'"), ["mid"], "ts")
    return windows.tumbling(first, "ts", "10 seconds", [], F.count("*").alias("cart_add_uu_ct"))


def payment_uu_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payer's first row of all is the first of its days' first rows."""
    log = page_log(spark, sf_dir).where("event_type = 'purchase'")
    first = keyed.first_times(log, ["mid"], "ts").withColumn("new", keyed.first_ever(["mid"], ["ts"]))
    return windows.tumbling(first, "ts", "5 seconds", [], F.count("*").alias("payment_suc_unique_user_ct"), total("new", "payment_suc_new_user_ct"))


def visitor_first_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.first_visit(page_log(spark, sf_dir), "mid", order=ORDER).select("mid", F.date_format("first_visit", "yyyy-MM-dd").alias("first_visit"))


def is_new_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.repaired_is_new(page_log(spark, sf_dir), "mid", order=ORDER).select("event_id", "mid", "is_new")


def is_new_repair_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitors whose rows disagree: every third claims to be known, every seventh says neither; times tie within an hour."""
    log = page_log(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    log = log.withColumn("is_new", F.when(F.col("event_id") % 7 == 0, "2").when(F.col("event_id") % 3 == 0, "0").otherwise("1"))
    return keyed.repaired_is_new(log, "mid", order=ORDER).select("event_id", "mid", "is_new")


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every script; a document's time is its id in seconds."""
    docs = table(spark, sf_dir, "documents").select("text", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("ts"))
    return windows.tumbling(split_words(docs, "text", "keyword"), "ts", "10 seconds", ["keyword"], F.count("keyword").alias("keyword_count"))


def keyword_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir)


def keyword_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir).groupBy("cur_date", "keyword").agg(total("keyword_count", "keyword_count"))


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five channel figures of every day."""
    return serving.channel_figures(page_view_window(spark, sf_dir), "cur_date")


_FIRST = "CASE WHEN CAST(ts AS DATE) IS NOT DISTINCT FROM LAG(CAST(ts AS DATE)) OVER (PARTITION BY {k} ORDER BY ts, event_id) THEN 0 ELSE 1 END"
_BY_MID = _FIRST.format(k="mid")
_PAGE_VIEW = f"""
    SELECT {edges_sql("ts", 10)}, ch, vc, ar, is_new, CAST(SUM(uv) AS BIGINT) AS uv_ct, CAST(SUM(sv) AS BIGINT) AS sv_ct, COUNT(*) AS pv_ct, CAST(SUM(dur) AS DOUBLE) AS dur_sum
    FROM (SELECT *, {_BY_MID} AS uv FROM ({PAGE_LOG_SQL})) GROUP BY ALL"""
_KEYWORDS = f"""
    SELECT {edges_sql("ts", 10)}, keyword, COUNT(keyword) AS keyword_count FROM (
        SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [NULL] ELSE w END) AS keyword
        FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))) AS w FROM documents)) GROUP BY ALL"""
SQL = {
    "page_view_window": _PAGE_VIEW,
    "home_detail_uv_window": f"""
        SELECT {edges_sql("ts", 10)}, COUNT(*) FILTER (event_type = 'view') AS home_uv_ct, COUNT(*) FILTER (event_type = 'click') AS good_detail_uv_ct
        FROM (SELECT *, {_FIRST.format(k="mid, event_type")} AS uv FROM ({PAGE_LOG_SQL}) WHERE event_type IN ('view', 'click')) WHERE uv = 1 GROUP BY ALL""",
    "login_back_window": f"""
        SELECT {edges_sql("ts", 10)}, CAST(SUM(uu) AS BIGINT) AS uu_ct, CAST(SUM(back) AS BIGINT) AS back_ct FROM (
            SELECT *, {_BY_MID} AS uu,
                CASE WHEN ts > date_trunc('day', LAG(ts) OVER (PARTITION BY mid ORDER BY ts, event_id)) + INTERVAL 7 DAY THEN 1 ELSE 0 END AS back
            FROM ({PAGE_LOG_SQL}) WHERE event_type = 'signup') WHERE uu = 1 GROUP BY ALL""",
    "register_window": f"SELECT {edges_sql('ts', 10)}, COUNT(*) AS register_ct FROM events WHERE event_type = 'signup' GROUP BY ALL",
    "cart_uu_window": f"""
        SELECT {edges_sql("ts", 10)}, CAST(SUM(uu) AS BIGINT) AS cart_add_uu_ct
        FROM (SELECT *, {_BY_MID} AS uu FROM ({PAGE_LOG_SQL}) WHERE event_type = 'click') WHERE uu = 1 GROUP BY ALL""",
    "payment_uu_window": f"""
        SELECT {edges_sql("ts", 5)}, CAST(SUM(uu) AS BIGINT) AS payment_suc_unique_user_ct, CAST(SUM(fresh) AS BIGINT) AS payment_suc_new_user_ct FROM (
            SELECT *, {_BY_MID} AS uu, CASE WHEN ROW_NUMBER() OVER (PARTITION BY mid ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh
            FROM ({PAGE_LOG_SQL}) WHERE event_type = 'purchase') WHERE uu = 1 GROUP BY ALL""",
    "visitor_first_visit": f"""
        SELECT mid, strftime(arg_min(CASE WHEN is_new = '0' THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END, ts), '%Y-%m-%d') AS first_visit
        FROM ({PAGE_LOG_SQL}) GROUP BY mid""",
    "is_new_repair": f"""
        SELECT event_id, p.mid, CASE WHEN is_new = '1' AND CAST(ts AS DATE) <> d THEN '0' ELSE is_new END AS is_new
        FROM ({PAGE_LOG_SQL}) p JOIN (
            SELECT mid, arg_min(CASE WHEN is_new = '0' THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END, ts) AS d FROM ({PAGE_LOG_SQL}) GROUP BY mid) v ON v.mid = p.mid""",
    "is_new_repair_mixed": f"""
        WITH l AS (SELECT event_id, mid, date_trunc('hour', ts) AS h, CASE WHEN event_id % 7 = 0 THEN '2' WHEN event_id % 3 = 0 THEN '0' ELSE '1' END AS n FROM ({PAGE_LOG_SQL})),
        v AS (SELECT mid, CASE WHEN n = '0' THEN CAST(h AS DATE) - 1 ELSE CAST(h AS DATE) END AS d FROM l WHERE n IN ('0', '1') QUALIFY ROW_NUMBER() OVER (PARTITION BY mid ORDER BY h, event_id) = 1)
        SELECT event_id, l.mid, CASE WHEN n = '1' AND CAST(h AS DATE) <> d THEN '0' ELSE n END AS is_new FROM l LEFT JOIN v ON l.mid = v.mid""",
    "keyword_window": _KEYWORDS,
    "keyword_totals": f"SELECT cur_date, keyword, CAST(SUM(keyword_count) AS BIGINT) AS keyword_count FROM ({_KEYWORDS}) GROUP BY ALL",
    "channel_stats": f"""
        SELECT cur_date, ch, CAST(SUM(uv_ct) AS BIGINT) AS uv_ct, CAST(SUM(sv_ct) AS BIGINT) AS sv_ct,
            CAST(SUM(pv_ct) AS DOUBLE) / NULLIF(CAST(SUM(sv_ct) AS DOUBLE), 0) AS pv_per_session,
            CAST(SUM(CAST(dur_sum AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(SUM(sv_ct) AS DOUBLE), 0) / 100 AS dur_per_session,
            CAST(COUNT(*) FILTER (pv_ct = 1) AS DOUBLE) / NULLIF(CAST(SUM(sv_ct) AS DOUBLE), 0) AS uj_rate
        FROM ({_PAGE_VIEW}) GROUP BY ALL""",
}
QUERIES = {
    f.__name__: f
    for f in (page_view_window, home_detail_uv_window, login_back_window, register_window, cart_uu_window, payment_uu_window, visitor_first_visit, is_new_repair, is_new_repair_mixed, keyword_window, keyword_totals, channel_stats)
}
#: The same queries under their earlier names.
QUERIES |= {"keyword_window_unicode": keyword_window, "keyword_totals_unicode": keyword_totals}
SQL |= {f"{k}_unicode": SQL[k] for k in ("keyword_window", "keyword_totals")}


#: Letters as Han characters: texts of the documents stand in for searches in a script without spaces.
_HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"


def keyword_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of texts without spaces. Every whole document, its letters as Han characters and its spaces gone, is cut by the dictionary
    of the words that stand in the documents. SQL has no best path; tests compare with every cut of short texts."""
    docs = table(spark, sf_dir, "documents").select(F.lower("text").alias("text"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    dictionary = segmentation.runs_of(docs, "text", f"a-z{_HAN}").select(F.translate("run", letters, _HAN).alias("word"))
    joined = docs.select(F.translate("text", letters + " \t\n\r", _HAN).alias("text"))
    return segmentation.word_counts(joined, "text", dictionary, "keyword", "keyword_count")


QUERIES |= {"keyword_segmented": keyword_segmented}
