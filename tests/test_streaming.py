"""Streaming jobs against the batch operators, and what only streams do: state, sinks, late rows, configuration that changes."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes, keyed, windows
from millrace.sources import sinks
from millrace.streaming import jobs, state

T = dt.datetime(2024, 1, 1, 12)
ROWS = [(1, T, 5.0), (1, T + dt.timedelta(seconds=3), 7.0), (2, T + dt.timedelta(seconds=12), 1.0), (1, T + dt.timedelta(days=1), 9.0), (3, T + dt.timedelta(days=3), 0.0)]


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # stores of state to commit in each micro-batch
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, batches, schema, name="in"):
    """A stream with one micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-raw/{k}")
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"{name}-raw" / str(k)).glob("*.parquet"))
        part.rename(folder / f"{k:03}.parquet")
        stamp = 1_700_000_000 + k
        __import__("os").utime(folder / f"{k:03}.parquet", (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


@pytest.fixture
def stream(spark, tmp_path):
    return streamed(spark, tmp_path, [ROWS], "k bigint, ts timestamp, v double")


def collected(spark, df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination(90)
    return spark.table(name).collect()


def test_windowed(spark, stream, tmp_path):
    out = collected(spark, jobs.windowed(stream, "ts", "10 seconds", [], F.count("*").alias("n")), tmp_path, "w")
    assert sorted((r.stt, r.n) for r in out) == [("2024-01-01 12:00:00", 2), ("2024-01-01 12:00:10", 1), ("2024-01-02 12:00:00", 1)]


def test_late_rows_are_dropped(spark, tmp_path):
    late = [(1, T, 1.0)], [(1, T + dt.timedelta(minutes=5), 1.0)], [(1, T + dt.timedelta(minutes=6), 1.0)], [(1, T + dt.timedelta(seconds=1), 1.0), (1, T + dt.timedelta(minutes=9), 1.0)], [(1, T + dt.timedelta(minutes=20), 1.0)]
    out = collected(spark, jobs.windowed(streamed(spark, tmp_path, late, "k bigint, ts timestamp, v double"), "ts", "10 seconds", ["k"], F.count("*").alias("n")), tmp_path, "late")
    assert sorted((r.stt[11:], r.n) for r in out) == [("12:00:00", 1), ("12:05:00", 1), ("12:06:00", 1), ("12:09:00", 1)]


def test_first_of_day(spark, stream, tmp_path):
    out = collected(spark, state.first_of_day(stream, ["k"], "ts", "uv"), tmp_path, "f")
    assert sorted((r.k, r.ts, r.uv) for r in out) == [(k, t, u) for (k, t, _), u in sorted(zip(ROWS, [1, 0, 1, 1, 1], strict=True))]


def test_deltas(spark, stream, tmp_path):
    out = collected(spark, state.deltas(stream, ["k"], "ts", ["v"]), tmp_path, "d")
    assert sorted((r.k, r.v) for r in out) == [(1, 2.0), (1, 2.0), (1, 5.0), (2, 1.0), (3, 0.0)]


def test_deltas_of_decimals_and_missing_times(spark, tmp_path):
    rows = [[(1, T, Decimal("0.10")), (1, None, Decimal("5.00"))], [(1, T + dt.timedelta(1), Decimal("0.30")), (2, T, None)]]
    out = collected(spark, state.deltas(streamed(spark, tmp_path, rows, "k bigint, ts timestamp, v decimal(18,2)"), ["k"], "ts", ["v"], ttl=state.DAY_MS), tmp_path, "dd")
    assert sorted((r.k, r.v) for r in out) == [(1, Decimal("0.10")), (1, Decimal("0.20")), (1, Decimal("5.00")), (2, Decimal("0.00"))]


def test_visits_equal_the_batch_operators(spark, tmp_path):
    days = [0, 0, 1, 9, 9, 20]
    rows = [[(k, T + dt.timedelta(days=d, seconds=k + j), j * 10 + k) for k in (1, 2)] for j, d in enumerate(days)]
    flat = [r for b in rows for r in b]
    schema = "mid bigint, ts timestamp, event_id bigint"
    out = collected(spark, state.visits(streamed(spark, tmp_path, rows, schema), ["mid"], "ts", "uu", "back", "new"), tmp_path, "v")
    order = ["ts", "event_id"]
    batch = spark.createDataFrame(flat, schema)
    first = keyed.firsts_of_day(batch, ["mid"], "ts", order).withColumn("back", keyed.returning(["mid"], "ts", order)).withColumn("new", keyed.first_ever(["mid"], order))
    want = {(r.mid, r.event_id): (1, r.back, r.new) for r in first.collect()}
    assert {(r.mid, r.event_id): (r.uu, r.back, r.new) for r in out if r.uu} == want
    assert len(out) == len(flat) and sum(b for _, b, _ in want.values()) == 4 and sum(n for _, _, n in want.values()) == 2


def test_first_visit_equals_the_batch_operator(spark, tmp_path):
    rows = [[(1, T, "2", 1)], [(1, T, "0", 2), (2, T, "1", 3)], [(1, T, "1", 4), (2, T, "1", 5)], [(2, T + dt.timedelta(1), "1", 6), (2, T + dt.timedelta(1), None, 7)]]
    schema = "mid bigint, ts timestamp, is_new string, event_id bigint"
    out = collected(spark, state.first_visit(streamed(spark, tmp_path, rows, schema), "mid"), tmp_path, "fv")
    batch = keyed.repaired_is_new(spark.createDataFrame([r for b in rows for r in b], schema), "mid", order=["ts", "event_id"])
    want = {r.event_id: r.is_new for r in batch.collect()}
    assert {r.event_id: r.is_new for r in out} == want == {1: "2", 2: "0", 3: "1", 4: "0", 5: "1", 6: "0", 7: None}
    assert {r.event_id: r.first_visit for r in out}[4] == dt.date(2023, 12, 31)


def test_windows_equal_the_batch_operator(spark, tmp_path):
    rows = [[(k % 3, T + dt.timedelta(seconds=3 * k), float(k))] for k in range(6)] + [[(9, T + dt.timedelta(hours=1), 0.0)]]
    schema = "k bigint, ts timestamp, v double"
    out = collected(spark, jobs.windowed(streamed(spark, tmp_path, rows, schema), "ts", "10 seconds", ["k"], F.sum("v").alias("v")), tmp_path, "wb")
    batch = windows.tumbling(spark.createDataFrame([r for b in rows[:-1] for r in b], schema), "ts", "10 seconds", ["k"], F.sum("v").alias("v"))
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch.collect()))


def test_unique_by_day_and_counts(spark, stream, tmp_path):
    out = collected(spark, jobs.unique_by_day(stream, ["k"], "ts"), tmp_path, "u")
    assert sorted((r.k, r.ts.day) for r in out) == [(1, 1), (1, 2), (2, 1), (3, 4)]
    out = collected(spark, jobs.order_counts(stream, "ts", "1 hour", "k", "v", "v"), tmp_path, "oc")
    assert sorted((r.k, r.order_amount, r.order_count) for r in out) == [(1, 9.0, 1), (1, 12.0, 2), (2, 1.0, 1)]


def test_order_counts_equal_the_batch_operator(spark, tmp_path):
    rng = __import__("random").Random(6)
    batches = [[(rng.choice(["a", "b", None]), T + dt.timedelta(seconds=20 * j + rng.randint(0, 19)), rng.choice([1, 2, 3, 4, None]), rng.randint(1, 9)) for _ in range(30)] for j in range(4)]
    schema = "p string, ts timestamp, o bigint, amount bigint"
    end = [[("z", T + dt.timedelta(hours=j), 1, 1)] for j in (1, 2)]
    df = jobs.order_counts(streamed(spark, tmp_path, batches + end, schema), "ts", "10 seconds", "p", "o", "amount", delay="30 seconds")
    assert "collect_set" not in df._jdf.queryExecution().analyzed().toString()
    query = df.writeStream.format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.tumbling(spark.createDataFrame([r for b in batches for r in b], schema), "ts", "10 seconds", ["p"], F.sum("amount").alias("order_amount"), F.count_distinct("o").alias("order_count"))
    got = {tuple(r) for r in spark.table("counts").collect() if r.p != "z"}
    assert got == {tuple(r) for r in batch.collect()} and len(got) > 10
    rows = [p.stateOperators for p in query.recentProgress if p.stateOperators]
    most = max(max(o.numRowsTotal for o in ops) for ops in rows)
    assert most <= sum(len(set(b)) for b in batches) and rows[-1][0].numRowsTotal <= 3  # a row for each window, key and order; closed windows are gone


def test_interval_join(spark, tmp_path):
    a = streamed(spark, tmp_path, [[(1, T), (2, T)], [(9, T + dt.timedelta(days=2))]], "ak bigint, at timestamp", "a")
    b = streamed(spark, tmp_path, [[(1, T + dt.timedelta(minutes=10)), (2, T + dt.timedelta(minutes=20))], [(9, T + dt.timedelta(days=2))]], "bk bigint, bt timestamp", "b")
    out = collected(spark, jobs.interval_join(a, b, [("ak", "bk")], "at", "bt", "15 minutes", "5 seconds"), tmp_path, "ij")
    assert sorted((r.ak, r.bk) for r in out) == [(1, 1), (9, 9)]


CHANGES = "k bigint, a string, b string, op string, ts bigint"
LOG = [
    [(1, "x", "y", "put", 1), (2, "x", None, "put", 1)], [(1, None, "z", "put", 2), (2, None, None, "delete", 2)], [(2, None, "n", "put", 2), (3, "late", "late", "put", 5)],
    [(3, "early", "early", "put", 4), (1, None, None, "delete", 7), (1, "again", None, "put", 7), (4, None, None, "delete", 1)],
]


def test_dimension_equals_the_batch_operator(spark, tmp_path):
    dim = sinks.Dimension(f"{tmp_path}/dim", "k", ["a", "b"], buckets=3)
    assert dim.table(spark) is None
    deleted = F.col("op") == "delete"
    source = lambda s: streamed(s, tmp_path, LOG, CHANGES)
    jobs.Job("dim", source, lambda df: df, dim.sink(deleted), f"{tmp_path}/cp").run(spark, once=True).awaitTermination(120)
    want = {(1, "again", None), (2, None, "n"), (3, "late", "late")}
    assert {tuple(r) for r in dim.table(spark).collect()} == want
    every = spark.createDataFrame([r for b in LOG for r in b], CHANGES)
    assert {tuple(r) for r in changes.upserted(every, "k", ["a", "b"], deleted).collect()} == want
    dim.merge(spark.createDataFrame(LOG[3], CHANGES), deleted, 3)  # a repeated batch changes nothing
    assert {tuple(r) for r in dim.table(spark).collect()} == want


def test_routing_takes_the_configuration_of_each_batch(spark, tmp_path):
    rules = [[("o", "facts_a", "id")], [("o", "facts_b", "id,v")]]
    config = lambda s: s.createDataFrame(rules.pop(0), "source_table string, sink_table string, sink_columns string")
    rows = [[("o", {"id": "1", "v": "2"}), ("p", {"id": "9"})], [("o", {"id": "3", "v": "4"})]]
    source = lambda s: streamed(s, tmp_path, rows, "`table` string, data map<string,string>")
    write = sinks.routed_to(f"{tmp_path}/out")
    jobs.Job("route", source, lambda df: df, jobs.routing(config, [("table", "source_table")], write), f"{tmp_path}/cp").run(spark, once=True).awaitTermination(120)
    got = {name: [r.data for r in sinks.routed_table(spark, f"{tmp_path}/out", name).collect()] for name in ("facts_a", "facts_b")}
    assert got == {"facts_a": [{"id": "1"}], "facts_b": [{"id": "3", "v": "4"}]}


def test_latest_by_key_breaks_ties(spark):
    got = []
    batch = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "c"), (2, 0, "d")], "k bigint, ts bigint, v string")
    sinks.latest_by_key(["k"], ["ts"], lambda df, n: got.extend((n, *r) for r in df.collect()))(batch, 7)
    assert sorted(got) == [(7, 1, 5, "b"), (7, 2, 1, "c")]
