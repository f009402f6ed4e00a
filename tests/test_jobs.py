"""Whole jobs: five log tables by one commit, look-ups of a live dimension, a configuration with versions."""

import json

import pytest
from pyspark.sql import functions as F
from test_streaming import CHANGES, LOG, streamed

from millrace.operators import keyed, logs
from millrace.sources import committed, sinks
from millrace.streaming import configuration, jobs, state
from millrace.streaming.logs import KINDS, base_log_job, kinds, repaired

DAY = 24 * 3600 * 1000


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # stores of state to commit in each micro-batch
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def record(mid, ts, is_new="1", **parts):
    return (json.dumps({"common": {"mid": mid, "is_new": is_new, "ch": "x"}, "ts": ts, **parts}),)


RAW = [
    [record("a", 1000, page={"page_id": "home", "during_time": 5}, actions=[{"action_id": "1"}, {"action_id": "2"}], displays=[]), ("{broken",), (None,), record("b", 5, start={"entry": "icon"}, err={"code": "7"})],
    [record("a", DAY + 5, page={"page_id": "cart"}, displays=[{"item": "i"}]), record("a", 2000, page={"page_id": "home"}), record(None, 1, page={"page_id": "x"}), record("c", 9, is_new="0", page={"page_id": "p"})],
    [record("c", DAY, is_new="1", start={"entry": "push"}, page={"page_id": "q"}, actions=[{"action_id": "9"}]), record("b", 6, is_new="2", page={"page_id": "z"}, err={"code": "8"})],
]


def texts(df):
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in df.collect())


def test_logs_go_to_five_tables_by_one_commit(spark, tmp_path):
    source = lambda s: streamed(s, tmp_path, RAW, "value string")
    path = f"{tmp_path}/out"
    base_log_job(source, path, f"{tmp_path}/cp").run(spark, once=True).awaitTermination(200)
    store = committed.Committed(path)
    assert store.tables(spark) == sorted(KINDS) and store.manifest(spark)["version"] == len(RAW)  # one commit for each micro-batch
    every = logs.cleaned(spark.createDataFrame([r for b in RAW for r in b], "value string"))
    day = every.withColumns({"mid": F.col("common.mid"), "at": F.timestamp_millis("ts"), "is_new": F.col("common.is_new")})
    fixed = keyed.repaired_is_new(day, "mid", "at", "is_new", ["at"]).withColumn("common", F.col("common").withField("is_new", F.col("is_new"))).select(*every.columns)
    for kind, rows in logs.split(fixed).items():
        assert texts(store.table(spark, kind)) == texts(rows.select(F.to_json(F.struct("*")))), kind
    assert {json.loads(r.value)["common"]["is_new"] for r in store.table(spark, "page").where("value like '%cart%'").collect()} == {"0"}
    store.routed("kind")(spark.createDataFrame([("page", "again")], "kind string, value string"), len(RAW) - 1)  # a repeated micro-batch
    assert store.table(spark, "page").where("value = 'again'").isEmpty()


def test_raw_logs_are_parsed_once(spark, tmp_path):
    query = kinds(repaired(logs.cleaned(streamed(spark, tmp_path, RAW[:1], "value string")))).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        plan = query._jsq.explainInternal(False)
    finally:
        query.stop()
    assert plan.count("from_json") == 1 and plan.count("FileScan") == 1


def test_look_ups_read_the_buckets_of_the_batch_and_see_changes(spark, tmp_path):
    dim = sinks.Dimension(f"{tmp_path}/dim", "k", ["a", "b"], buckets=16)
    facts = spark.createDataFrame([("1", 10), ("3", 30), ("99", 0), (None, 5)], "key string, v int")
    assert dim.look_up(facts, "key", {"a": "name"}).where("name is not null").isEmpty() and dim.look_up(facts, "key", {"a": "name"}, "inner").isEmpty()
    deleted = F.col("op") == "delete"
    dim.merge(spark.createDataFrame([r for b in LOG for r in b] + [(100 + k, "f", "f", "put", 1) for k in range(200)], CHANGES), deleted, 0)
    found = dim.look_up(facts, "key", {"a": "name", "b": "more"})
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("1", 10, "again", None), ("3", 30, "late", "late"), ("99", 0, None, None), (None, 5, None, None)], key=str)
    read = {f.rsplit("/", 2)[1] for f in found.inputFiles() if "bucket=" in f}
    assert len(dim.store.manifest(spark)["tables"]["rows"]["slots"]) == 16 and 1 <= len(read) <= 3
    dim.merge(spark.createDataFrame([(1, "changed", None, "put", 8), (3, None, None, "delete", 9)], CHANGES), deleted, 1)
    assert {(r.key, r.name) for r in dim.look_up(facts, "key", {"a": "name"}).collect()} == {("1", "changed"), ("3", None), ("99", None), (None, None)}
    assert {r.key for r in dim.look_up(facts, "key", {"a": "name"}, "inner").collect()} == {"1"}


def test_a_merge_that_fails_leaves_the_dimension(spark, tmp_path, monkeypatch):
    dim = sinks.Dimension(f"{tmp_path}/dim", "k", ["a", "b"], buckets=4)
    deleted = F.col("op") == "delete"
    dim.merge(spark.createDataFrame([(k, "x", "y", "put", 1) for k in range(20)], CHANGES), deleted, 0)
    whole = committed.Committed.commit
    monkeypatch.setattr(committed.Committed, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        dim.merge(spark.createDataFrame([(k, "new", None, "put", 2) for k in range(20)], CHANGES), deleted, 1)
    assert {r.a for r in dim.table(spark).collect()} == {"x"}
    monkeypatch.setattr(committed.Committed, "commit", whole)
    dim.merge(spark.createDataFrame([(k, "new", None, "put", 2) for k in range(20)], CHANGES), deleted, 1)
    assert {(r.a, r.b) for r in dim.table(spark).collect()} == {("new", "y")}


RULE = "source_table string, sink_table string, sink_columns string"


def test_a_repeated_batch_is_routed_as_it_was_first(spark, tmp_path):
    rules = configuration.Configuration(f"{tmp_path}/conf", ["source_table"], RULE)
    feed = lambda n, *rows: rules.feed(spark.createDataFrame(rows, f"op string, {RULE}, ts_ms bigint"), n)
    got = {}
    route = rules.routing([("table", "source_table")], lambda df, n: got.setdefault(n, []).append(sorted((r.sink_table, sorted(r.data.items())) for r in df.collect())))
    batch = spark.createDataFrame([("o", {"id": "1", "v": "2"}), ("p", {"id": "9"})], "`table` string, data map<string,string>")
    route(batch, 0)  # no rules yet
    feed(0, ("r", "o", "facts", "id", 1), ("c", "p", "dims", "id", 1))
    route(batch, 1)
    feed(1, ("u", "o", "facts_b", "id,v", 2))
    route(batch, 2)
    feed(2, ("d", "p", None, None, 3))
    route(batch, 3)
    first = [got[k][0] for k in range(4)]
    o = [("id", "1")]
    assert first == [[], [("dims", [("id", "9")]), ("facts", o)], [("dims", [("id", "9")]), ("facts_b", [*o, ("v", "2")])], [("facts_b", [*o, ("v", "2")])]]
    for k in range(4):
        route(batch, k)
        assert got[k][1] == first[k]
    other = rules.routing([("table", "source_table")], lambda df, n: got.setdefault("other", df.count()), reader="second")
    other(batch, 0)
    assert got["other"] == 1 and rules.version(spark) == 3 and not rules.feed(spark.createDataFrame([("d", "o", None, None, 9)], f"op string, {RULE}, ts_ms bigint"), 2)


def test_routing_in_a_stream(spark, tmp_path):
    rules = configuration.Configuration(f"{tmp_path}/conf", ["source_table"], RULE)
    rules.feed(spark.createDataFrame([("c", "o", "facts", "id", 1)], f"op string, {RULE}, ts_ms bigint"), 0)
    source = lambda s: streamed(s, tmp_path, [[("o", {"id": "1", "v": "2"})], [("o", {"id": "3"}), ("q", {"id": "4"})]], "`table` string, data map<string,string>")
    write = sinks.routed_to(f"{tmp_path}/out")
    jobs.Job("versions", source, lambda df: df, rules.routing([("table", "source_table")], write), f"{tmp_path}/cp").run(spark, once=True).awaitTermination(120)
    assert sorted(r.data["id"] for r in sinks.routed_table(spark, f"{tmp_path}/out", "facts").collect()) == ["1", "3"]


def change(table, kind, ts, database="shop", **data):
    return (json.dumps({"database": database, "table": table, "type": kind, "ts": ts, "data": data}),)


def rule(op, ts, before=None, after=None):
    names = ("source_table", "sink_table", "sink_columns", "sink_row_key")
    return (json.dumps({"op": op, "before": before and dict(zip(names, before, strict=True)), "after": after and dict(zip(names, after, strict=True)), "ts_ms": ts}),)


def test_dimensions_from_raw_records(spark, tmp_path):
    from millrace.streaming.dimensions import DimensionJob

    dims = DimensionJob(f"{tmp_path}/dims", "shop", buckets=4)
    raw = lambda *rows: spark.createDataFrame(list(rows), "value string")
    rows = lambda name: sorted(map(tuple, dims.table(spark, name).collect())) if dims.table(spark, name) is not None else None
    dims.configure(raw(rule("r", 1, after=("sku_info", "dim_sku", "id,name,price", "id")), ("{broken",), rule("c", 2, after=("brand", "dim_brand", "id,name", "id"))), 0)
    log = [
        [change("sku_info", "bootstrap-start", 1), change("sku_info", "bootstrap-insert", 1, id="1", name="a", price="5", more="x"), change("brand", "insert", 1, id="7", name="b"), change("other", "insert", 1, id="1"), ("{",), (None,)],
        [change("sku_info", "update", 2, id="1", name="a2"), change("sku_info", "insert", 2, id="2", name="c", price="1"), change("brand", "delete", 2, id="7", name="b"), change("sku_info", "insert", 2, "elsewhere", id="9")],
    ]
    source = lambda s: streamed(s, tmp_path, log, "value string")
    dims.job(source, f"{tmp_path}/cp").run(spark, once=True).awaitTermination(200)
    assert rows("dim_sku") == [("1", "a2", "5"), ("2", "c", "1")] and rows("dim_brand") == [] and rows("dim_other") is None
    for number, batch in enumerate(log):  # repeated micro-batches
        dims.merge(raw(*batch), number)
    assert rows("dim_sku") == [("1", "a2", "5"), ("2", "c", "1")] and rows("dim_brand") == []
    dims.configure(raw(rule("u", 3, ("sku_info", "dim_sku", "id,name,price", "id"), ("sku_info", "dim_sku", "id,price", "id")), rule("d", 4, before=("brand", "dim_brand", "id,name", "id"))), 1)
    assert rows("dim_sku") is None and rows("dim_brand") is None  # dropped, to begin anew
    dims.merge(raw(change("sku_info", "update", 5, id="1", name="n", price="6"), change("brand", "insert", 5, id="8")), 2)
    assert rows("dim_sku") == [("1", "6")] and rows("dim_brand") is None
