"""Hand-written cases of the small operators, sources and sinks."""

import datetime as dt
import json

from pyspark.sql import functions as F

from millrace.functions import dates, names, text
from millrace.operators import changes, keyed, logs, rules
from millrace.sources import files, serving, sinks


def test_dates(spark):
    row = spark.range(1).select(
        dates.date_time_to_millis(F.lit("2024-02-29 00:00:01")).alias("a"), dates.date_to_millis(F.lit("1970-01-02")).alias("b"), dates.date_time_to_millis(F.lit("soon")).alias("c"),
        dates.millis_to_text(F.lit(1000)).alias("d"), dates.millis_to_text(F.lit(86_400_000), dates.DATE).alias("e"), dates.millis_to_text(F.lit(0), dates.PARTITION).alias("f"),
        dates.millis_to_timestamp(F.lit(1500)).alias("g"), dates.today().alias("h"), dates.millis_to_text(F.lit(None).cast("bigint")).alias("i"),
    ).first()
    assert tuple(row)[:6] == (1709164801000, 86_400_000, None, "1970-01-01 00:00:01", "1970-01-02", "19700101")
    assert row.g == dt.datetime(1970, 1, 1, 0, 0, 1, 500000) and len(str(row.h)) == 8 and row.i is None


def test_names(spark):
    assert [names.to_camel(x) for x in ("order_id", "ORDER_ID", "id")] == ["orderId", "orderId", "id"]
    assert [names.to_snake(x) for x in ("orderId", "id", "skuNum")] == ["order_id", "id", "sku_num"]
    assert names.renamed(spark.range(1).withColumn("a_b", F.lit(1)), names.to_camel).columns == ["id", "aB"]


def test_words_keep_texts_without_any(spark):
    rows = text.split_words(spark.createDataFrame([("a A b",), (None,), ("..",)], "t string"), "t").collect()
    assert sorted((r.t or "", r.word or "") for r in rows) == [("", ""), ("..", ""), ("a A b", "a"), ("a A b", "b")]


def test_parsing_drops_what_is_no_record(spark):
    raw = spark.createDataFrame([('{"table":"t","ts":1,"data":{"a":"b"}}',), ("{broken",), ("",), (None,), ("{}",), ("[]",)], "value string")
    assert [(r.table, r.ts, r.data) for r in changes.parsed(raw).collect()] == [("t", 1, {"a": "b"})]


def test_parsing_happens_once(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    found = changes.projected(changes.cleaned(changes.parsed(raw), "shop", types=("insert",)), "a", "b")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_upserts_with_ties(spark):
    rows = [(1, "a", None, "put", 7), (1, None, None, "delete", 7), (2, "a", "x", "put", 1), (2, None, "y", "put", 2), (2, "b", None, "put", 2), (3, "a", "b", "put", 1), (3, None, None, "delete", 2), (4, None, None, "put", 1)]
    df = spark.createDataFrame(rows, "k bigint, a string, b string, op string, ts bigint")
    found = changes.upserted(df, "k", ["a", "b"], F.col("op") == "delete").collect()
    assert {tuple(r) for r in found} == {(1, "a", None), (2, "b", "y"), (4, None, None)}
    assert changes.upserted(df.limit(0), "k", ["a"], F.col("op") == "delete").collect() == []


def test_first_visit_and_repair(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, day(5), "0", 1), (1, day(5), "1", 2), (2, day(5), "1", 3), (2, day(6), "1", 4), (3, day(5), "x", 5), (3, day(7), "1", 6), (4, day(1), None, 7)]
    df = spark.createDataFrame(rows, "mid bigint, ts timestamp, is_new string, event_id bigint")
    assert {(r.mid, r.first_visit.day) for r in keyed.first_visit(df, "mid", order=["ts", "event_id"]).collect()} == {(1, 4), (2, 5), (3, 7)}
    assert {r.event_id: r.is_new for r in keyed.repaired_is_new(df, "mid", order=["ts", "event_id"]).collect()} == {1: "0", 2: "0", 3: "1", 4: "0", 5: "x", 6: "1", 7: None}


def test_split_of_one_record_with_everything(spark):
    record = {"common": {"mid": "m"}, "page": {"page_id": "p", "last_page_id": "search", "item_type": "keyword", "item": "tea"}, "start": {"entry": "icon"}, "err": {"code": "7"}, "actions": [{"a": "1"}], "displays": [{"d": "1"}, {"d": "2"}], "ts": 3}
    raw = spark.createDataFrame([(json.dumps(record),), (json.dumps({"common": {"mid": "m"}, "ts": 1}),), (json.dumps(record | {"common": {}}),)], "value string")
    out = logs.split(logs.cleaned(raw))
    assert out["err"].columns == ["err"] and [r.err for r in out["err"].collect()] == [{"code": "7"}]
    assert out["start"].columns == ["common", "page", "start", "actions", "displays", "ts"] and out["start"].count() == 1
    assert out["page"].columns == ["common", "page", "start", "ts"] and out["page"].first().start == {"entry": "icon"}
    assert [r.action for r in out["action"].collect()] == [{"a": "1"}] and [r.display["d"] for r in out["display"].collect()] == ["1", "2"]
    assert [tuple(r) for r in logs.keyword_searches(out["page"]).collect()] == [("tea", 3)]


def test_cleaning_rules(spark):
    page = spark.createDataFrame([("m", "u", "home", None, 1), (None, "u", "home", None, 1), ("m", None, "good_detail", "login", 1), ("m", "v", "cart", "login", 2), ("m", "w", "home", "cart", None)], "mid string, uid string, page_id string, last_page_id string, ts bigint")
    assert rules.home_or_detail(page).count() == 2
    assert sorted(r.uid for r in rules.logins(page).collect()) == ["u", "u", "v"]
    facts = spark.createDataFrame([("1", "2", 5), (None, "2", 5), ("1", None, 5), ("1", "2", None)], "id string, sku_id string, ts bigint")
    assert [tuple(r) for r in rules.facts(facts, "id", "sku_id").collect()] == [("1", "2", 5000)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    stream = files.folder_text(spark, f"{tmp_path}/in")
    sinks.stream_to(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "two"]
    row = spark.createDataFrame([(1, "x", 2)], "orderId bigint, skuName string, ts bigint")
    assert [json.loads(r.value) for r in sinks.as_json(row, ["ts"]).collect()] == [{"order_id": 1, "sku_name": "x"}]
    for _ in range(2):
        sinks.write_daily(spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "cur_date string, n bigint"), f"{tmp_path}/daily")
    assert spark.read.parquet(f"{tmp_path}/daily").where("cur_date = '2024-01-01'").count() == 2


def test_tables(spark):
    name = "default.millrace_table_test"
    assert not sinks.create_table(spark, name, " ")
    assert sinks.create_table(spark, name, "id string, day string", ["day"]) and not sinks.create_table(spark, name, "id string")
    assert sinks.drop_table(spark, name) and not sinks.drop_table(spark, name)


def test_serving_answers(spark):
    rows = [("2024-01-01", "web", 1, 2, 1, 100.0), ("2024-01-01", "web", 1, 2, 7, 300.0), ("2024-01-01", "app", 3, 0, 1, 1.0), ("2024-01-02", "web", 9, 9, 9, 9.0)]
    stats = serving.channel_stats(spark.createDataFrame(rows, "cur_date string, ch string, uv_ct bigint, sv_ct bigint, pv_ct bigint, dur_sum double"), "2024-01-01")
    answer = json.loads(serving.channel_json(stats).first().value)
    assert answer["status"] == 0 and answer["data"]["categories"] == ["app", "web"]
    assert [s["data"] for s in answer["data"]["series"]] == [[3, 2], [0, 4], [None, 2.0], [None, 1.0], [None, 0.25]]
    words = serving.keyword_stats(spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-01", "b", 5), ("2024-01-01", "a", 2)], "cur_date string, keyword string, keyword_count bigint"), "2024-01-01")
    assert json.loads(serving.keyword_json(words).first().value) == {"status": 0, "msg": "", "data": [{"name": "b", "value": 5}, {"name": "a", "value": 3}]}


def test_jdbc_table(spark):
    url, driver = "jdbc:derby:memory:millrace;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "a"), (2, "b")], "order_id bigint, sku_name string").write.format("jdbc").options(url=url, dbtable="details", driver=driver).mode("overwrite").save()
    found = files.jdbc_table(spark, url, "SELECT * FROM details", camel=True, driver=driver)
    assert found.columns == ["orderId", "skuName"] and sorted(map(tuple, found.collect())) == [(1, "a"), (2, "b")]


def test_first_rows_are_hash_aggregates(spark):
    from millrace import catalogue

    names = ("page_view_window", "home_detail_uv_window", "login_back_window", "cart_uu_window", "payment_uu_window", "visitor_first_visit", "is_new_repair", "is_new_repair_mixed", "channel_stats")
    for name in names:
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan, name


def test_flags_of_first_rows(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, day(1, 5), 9), (1, day(1, 5), -3), (1, day(1, 7), 1), (1, day(2), 4), (None, day(1), 1), (None, day(1), 2), (2, None, 5), (2, dt.datetime(1960, 1, 1, 3), 8), (2, dt.datetime(1960, 1, 1, 2), 9)]
    df = spark.createDataFrame(rows, "mid bigint, ts timestamp, id bigint")
    want = {(1, -3), (1, 4), (None, 1), (2, 9)}
    for given in (df, df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), df.withColumn("id", F.lpad((F.col("id") + 50).cast("string"), 3, "0"))):  # the last order cannot be packed
        found = keyed.first_of_day_flags(given, ["mid"], "ts", ["ts", "id"], "first").where("first = 1 and ts is not null").select("mid", "id").collect()
        assert {(r.mid, int(r.id) - 50 if isinstance(r.id, str) else r.id) for r in found} == want
    times = keyed.first_times(df.where("ts is not null"), ["mid"], "ts").collect()
    assert sorted((r.mid or 0, r.ts) for r in times) == [(0, day(1)), (1, day(1, 5)), (1, day(2)), (2, dt.datetime(1960, 1, 1, 2))]
