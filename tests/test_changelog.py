"""Changelog joins over several micro-batches against the batch operators; state that goes; cancellations around their bound."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_streaming import streamed

from millrace.operators import changes, orders
from millrace.sources import upserts
from millrace.streaming import jobs, state
from millrace.streaming.changelog import Joined, Side, changelog_join
from millrace.streaming.orders import cancel_changes, order_detail_changes

T = dt.datetime(2024, 1, 1, 12)


def at(seconds):
    return T + dt.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # stores of state to commit in each micro-batch
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def batches(spark, df, tmp_path, name="q"):
    """Rows of each micro-batch."""
    out = {}
    df.writeStream.foreachBatch(lambda b, n: out.setdefault(n, b.collect()) and None).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination(240)
    return [out[k] for k in sorted(out)]


def folded(rows):
    """The rows that a changelog leaves."""
    left = Counter()
    for r in rows:
        left[tuple(r)[3:]] += 1 if r.kind in ("+I", "+U") else -1
    assert all(n >= 0 for n in left.values())
    return sorted(left.elements(), key=str)


# ---- the join of one key in plain Python, through the same processor


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        self.pop(k, None)


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, ms):
        self.timers.add(ms)


class In:
    def __init__(self, side, kind, row, seconds):
        self.side, self.kind, self.row, self.at, self.ts = side, kind, row, seconds * 1_000_000, at(seconds)


def run(processor, *rows):
    return [(r.kind, *(r[f"r{k}"] for k in range(len(processor.held)))) for r in processor.handleInputRows(("k",), iter(rows), None)]


def processor(*required, retention=5):
    p, h = Joined(required, retention * 1_000_000), Handle()
    p.init(h)
    return p, h


def test_inner_and_outer_rows_are_retracted():
    p, _ = processor(True, False)
    assert run(p, In(0, "+I", "b", 0)) == [("+I", "b", None)]
    assert run(p, In(1, "+I", "x", 1)) == [("-U", "b", None), ("+U", "b", "x")]
    assert run(p, In(1, "+I", "y", 2)) == [("+I", "b", "y")]
    assert run(p, In(1, "-D", "x", 2)) == [("-D", "b", "x")]
    assert run(p, In(1, "-D", "y", 2)) == [("-U", "b", "y"), ("+U", "b", None)]
    assert run(p, In(1, "-D", "never", 2)) == [] and run(p, In(0, "-U", "b", 2), In(0, "+U", "c", 2)) == [("-D", "b", None), ("+I", "c", None)]
    p, _ = processor(True, True)
    assert run(p, In(0, "+I", "b", 0), In(0, "+I", "b", 0)) == [] and run(p, In(1, "+I", "o", 3)) == [("+I", "b", "o"), ("+I", "b", "o")]
    assert run(p, In(0, "-D", "b", 4)) == [("-D", "b", "o")] and run(p, In(1, "-D", "o", 4)) == [("-D", "b", "o")]


def test_rows_match_within_the_retention_only():
    p, _ = processor(True, True)
    assert run(p, In(0, "+I", "b", 0), In(1, "+I", "late", 6), In(1, "+I", "just", 5), In(1, "+I", "before", -5), In(1, "+I", "early", -6)) == [("+I", "b", "just"), ("+I", "b", "before")]


def test_timers_remove_what_is_over():
    p, h = processor(True, False)
    run(p, In(0, "+I", "b", 0), In(1, "+I", "x", 2))
    due = sorted(h.timers)
    assert due == [5001, 7001]

    class Info:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    assert list(p.handleExpiredTimer(("k",), None, Info(due[0]))) == [] and [len(s) for s in p.held] == [0, 1]
    list(p.handleExpiredTimer(("k",), None, Info(due[1])))
    assert [len(s) for s in p.held] == [0, 0]


# ---- streams


def records(*rows):
    """Change records as JSON texts: (table, type, seconds, data, old)."""
    base = int(T.replace(tzinfo=dt.UTC).timestamp())
    return [(json.dumps({"database": "shop", "table": t, "type": k, "ts": base + s, "data": d, "old": o}),) for t, k, s, d, o in rows]


def detail(i, order, s):
    return ("order_detail", "insert", s, {"id": i, "order_id": order, "sku_id": f"s{i}", "sku_num": "1"}, None)


def info(order, s, user="u"):
    return ("order_info", "insert", s, {"id": order, "user_id": user, "province_id": "7"}, None)


def activity(i, s, a="a"):
    return ("order_detail_activity", "insert", s, {"order_detail_id": i, "activity_id": a, "activity_rule_id": f"r{a}"}, None)


def coupon(i, s, c="c"):
    return ("order_detail_coupon", "insert", s, {"order_detail_id": i, "coupon_id": c}, None)


def cancel(order, s, old="1001", new="1005"):
    return ("order_info", "update", s, {"id": order, "order_status": new, "operate_time": "2024-01-01 13:00:00"}, {"order_status": old})


LOG = [
    [detail("d1", "o1", 0), detail("d2", "o1", 0), activity("d2", 1), detail("d3", "o2", 1)],  # d3 waits for its order
    [info("o1", 0), info("o2", 3), ("order_info", "update", 3, {"id": "o2", "user_id": "other"}, {"user_id": "u"})],
    [activity("d1", 4), coupon("d1", 4), coupon("d2", 2), detail("d4", "none", 4)],  # late activity and coupon
    [coupon("d3", 5, "c3"), info("o5", 5), detail("d5", "o5", 6), detail("d6", None, 6)],
]
END = [[detail("d9", "o9", 500)], [detail("d10", "o10", 1000)], [detail("d11", "o11", 1001)]]


def stream(spark, tmp_path, log, name="in"):
    raw = streamed(spark, tmp_path, [records(*b) for b in log], "value string", name)
    return changes.cleaned(changes.parsed(raw), "shop")


def test_order_details_equal_the_batch_operator(spark, tmp_path):
    got = batches(spark, order_detail_changes(stream(spark, tmp_path, LOG)), tmp_path)
    flat = [r for b in got for r in b]
    every = spark.createDataFrame(records(*(r for b in LOG for r in b)), "value string")
    batch = orders.order_details(changes.cleaned(changes.parsed(every), "shop"))
    columns = [c for c in flat[0].asDict() if c not in ("kind", "seq", "changed")]
    want = sorted((tuple(r) for r in batch.select(*columns).collect()), key=str)
    assert folded(flat) == want and [r[0] for r in want] == ["d1", "d2", "d3", "d5"]
    assert sum(r.kind == "-U" for r in flat) >= 2 and len([b for b in got if b]) >= 3  # images were replaced in later micro-batches
    assert {r[0]: r[-3:] for r in want}["d1"] == ("a", "ra", "c")


def test_late_parts_and_state_after_the_bound(spark, tmp_path):
    log = [[detail("d1", "o1", 0), info("o1", 0)], [detail("d8", "o8", 100), info("o8", 100)], [detail("d7", "o7", 101), info("o7", 101)], [activity("d1", 102), coupon("d8", 103)], *END]
    df = order_detail_changes(stream(spark, tmp_path, log))
    query = df.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp")
    out: list = []
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(240)
    left = {r[0]: r[-3:] for r in folded(out)}
    assert left["d1"] == (None, None, None) and left["d8"] == (None, None, "c")
    kept = [[op.numRowsTotal for op in p.stateOperators] for p in query.recentProgress if p.stateOperators]
    assert max(map(sum, kept)) == 9 and kept[-1] == [0, 2]  # only the two details that wait for their orders; what the watermark has passed is gone


def test_upserts_of_the_details(spark, tmp_path):
    sink = upserts.Upserts(f"{tmp_path}/table", ["id"], buckets=2)
    job = jobs.Job("details", lambda s: stream(s, tmp_path, LOG), lambda c: order_detail_changes(c).drop("changed"), sink.sink(), f"{tmp_path}/cp")
    job.run(spark, once=True).awaitTermination(240)
    rows = {r.id: (r.user_id, r.activity_id, r.coupon_id) for r in sink.table(spark, "id string, user_id string, activity_id string, coupon_id string").collect()}
    assert rows == {"d1": ("u", "a", "c"), "d2": ("u", "a", "c"), "d3": ("u", None, "c3"), "d5": ("u", None, None)}
    sink.compact(spark)
    assert {r.id for r in sink.table(spark, "id string").collect()} == set(rows)


CANCELS = [
    [detail("a", "near", 0), info("near", 0), detail("b", "far", 0), info("far", 0), detail("c", "edge", 0), info("edge", 0), detail("d", "paid", 0), info("paid", 0), detail("e", "back", 0), info("back", 0)],
    [cancel("near", 904), cancel("edge", 905), cancel("paid", 600, old="1002"), cancel("back", 700, new="1004")],
    [cancel("far", 906)],
]


def test_cancellations_around_the_bound(spark, tmp_path):
    log = stream(spark, tmp_path, CANCELS)
    details = order_detail_changes(log)
    got = [r for b in batches(spark, cancel_changes(details, log), tmp_path) for r in b]
    every = changes.cleaned(changes.parsed(spark.createDataFrame(records(*(r for b in CANCELS for r in b)), "value string")), "shop")
    want = orders.cancel_facts(orders.order_details(every), orders.cancellations(every)).collect()
    assert folded(got) == sorted(map(tuple, want), key=str) and sorted(r.id for r in want) == ["a", "c"]
    assert {(r.date_id, r.cancel_time) for r in want} == {("2024-01-01", "2024-01-01 13:00:00")}


def test_every_type_comes_back(spark, tmp_path):
    schema = "k bigint, ts timestamp, n timestamp_ntz, m decimal(20,4), x double, b boolean, d date, a array<int>"
    row = (2**62 + 1, at(0) + dt.timedelta(microseconds=123457), at(1) + dt.timedelta(microseconds=7), __import__("decimal").Decimal("123456789.0001"), 0.1 + 0.2, True, dt.date(2024, 2, 29), [1, None])
    base = streamed(spark, tmp_path, [[row]], schema, "a")
    other = streamed(spark, tmp_path, [[(2**62 + 1, at(0), None)]], "j bigint, ts timestamp, v string", "b")
    out = batches(spark, changelog_join(Side(base, ["k"], "ts"), Side(other, ["j"], "ts", {"v": "v"}), retention=1), tmp_path)
    assert [tuple(r) for b in out for r in b] == [("+I", 0, row[1], *row, None)]
    with pytest.raises(ValueError):
        changelog_join(Side(base, ["k"], "ts", required=False), Side(other, ["j"], "ts"), retention=1)
    with pytest.raises(ValueError):
        changelog_join(Side(base, ["k"], "ts"), Side(other, ["j", "v"], "ts"), retention=1)


def test_cart_additions_by_the_old_quantity(spark):
    cart = lambda kind, n, old: ("cart_info", kind, 0, {"id": "1", "sku_num": n}, old)
    rows = [cart("insert", "3", None), cart("update", "5", {"sku_num": "2"}), cart("update", "2", {"sku_num": "2"}), cart("update", "1", {"sku_num": "2"}), cart("update", "9", {"is_checked": "1"}), cart("delete", "9", None), cart("update", "x", {"sku_num": "2"})]
    found = orders.cart_additions(changes.parsed(spark.createDataFrame(records(*rows), "value string"))).select("id", F.col("sku_num").alias("n")).collect()
    assert sorted((r.id, r.n) for r in found) == [("1", 3), ("1", 3)]
