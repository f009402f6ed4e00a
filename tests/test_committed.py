"""Commits that appear at once, crashes between staging and commit, and keyed changelogs with tombstones."""

import datetime as dt
from decimal import Decimal

import pytest

from millrace.operators import changes
from millrace.sources import committed, sinks, upserts


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_commits_are_seen_whole(spark, tmp_path):
    store = committed.Committed(f"{tmp_path}/t")
    assert store.table(spark, "a") is None and store.tables(spark) == []
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("u",)], "y string")
    assert store.append(spark, 0, {"a": a, "b": b})
    assert rows(store.table(spark, "a")) == [(1,)] and rows(store.table(spark, "b")) == [("u",)]
    assert not store.append(spark, 0, {"a": a, "b": b})  # a repeated micro-batch
    assert store.append(spark, 0, {"a": a}, writer="other")  # numbers are each writer's own
    assert rows(store.table(spark, "a")) == [(1,), (1,)]


def test_a_crash_between_stage_and_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    store = committed.Committed(f"{tmp_path}/t")
    one = lambda k: {"a": spark.createDataFrame([(k,)], "x int"), "b": spark.createDataFrame([(-k,)], "x int")}
    store.append(spark, 0, one(1))
    whole = committed.Committed.commit
    monkeypatch.setattr(committed.Committed, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append(spark, 1, one(2))
    assert rows(store.table(spark, "a")) == [(1,)] and rows(store.table(spark, "b")) == [(-1,)]
    monkeypatch.setattr(committed.Committed, "commit", whole)
    assert store.append(spark, 1, one(2)) and not store.append(spark, 1, one(2))
    assert rows(store.table(spark, "a")) == [(1,), (2,)] and rows(store.table(spark, "b")) == [(-2,), (-1,)]
    assert store.vacuum(spark) == 0 and store.vacuum(spark, older_ms=-1000) == 2  # the two folders of the crash
    assert rows(store.table(spark, "a")) == [(1,), (2,)]


def test_an_unfinished_manifest_is_not_read(spark, tmp_path):
    store = committed.Committed(f"{tmp_path}/t")
    store.append(spark, 0, {"a": spark.range(2)})
    (tmp_path / "t" / "_manifests" / ".half").write_text('{"version": 2, "tab')
    assert rows(store.table(spark, "a")) == [(0,), (1,)]


def test_routed_rows_compaction_and_old_manifests(spark, tmp_path):
    store = committed.Committed(f"{tmp_path}/t", keep=3)
    write = store.routed("sink")
    for k in range(6):
        write(spark.createDataFrame([("p/q r", k), ("b", -k)], "sink string, x int"), k)
        write(spark.createDataFrame([("b", 99)], "sink string, x int"), k)
    assert store.tables(spark) == ["b", "p/q r"]
    assert rows(store.table(spark, "p/q r")) == [(k,) for k in range(6)] and rows(store.table(spark, "b")) == sorted((-k,) for k in range(6))
    assert len(list((tmp_path / "t" / "_manifests").glob("*.json"))) == 3
    store.compact(spark, "b")
    assert rows(store.table(spark, "b")) == sorted((-k,) for k in range(6)) and len(store.manifest(spark)["tables"]["b"]["slots"]) == 1
    assert rows(sinks.routed_table(spark, f"{tmp_path}/t", "p/q r")) == [(k,) for k in range(6)]


ROW = "id bigint, at timestamp, price decimal(18,2), name string"
T = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)


def changelog(spark, *records):
    return spark.createDataFrame([(k, s, i, T, p and Decimal(p), n) for k, s, i, p, n in records], f"kind string, seq int, {ROW}")


def test_upserts_with_tombstones(spark, tmp_path):
    log = upserts.Upserts(f"{tmp_path}/u", ["id"], buckets=3)
    table = lambda: {r.id: (r.price, r.name) for r in log.table(spark, ROW).collect()}
    assert table() == {}
    log.write(changelog(spark, ("+I", 0, 1, "1.10", "a"), ("+I", 0, 2, "2.00", None), ("+I", 0, 3, None, "c")), 0)
    log.write(changelog(spark, ("-U", 0, 1, "1.10", "a"), ("+U", 1, 1, "1.20", "a"), ("-D", 0, 2, "2.00", None), ("-D", 0, 3, None, "c"), ("+I", 1, 3, "3.00", "back")), 1)
    want = {1: (Decimal("1.20"), "a"), 3: (Decimal("3.00"), "back")}
    assert table() == want and log.table(spark, ROW).first().at == T
    assert not log.write(changelog(spark, ("-D", 0, 1, None, None)), 1) and table() == want  # a repeated micro-batch
    raw = log.records(spark).collect()
    assert [r.value for r in raw if r.key == '{"id":2}' and r.number == 1] == [None]
    assert sum(r.value == "" for r in log.texts(spark).collect()) == 1
    assert changes.parsed(log.texts(spark), ROW).count() == len(raw) - 1  # tombstones are dropped by parsing
    log.compact(spark)
    assert table() == want and log.records(spark).isEmpty()
    log.write(changelog(spark, ("+I", 0, 2, "5.00", "again"), ("-D", 0, 1, None, None), ("-D", 0, 77, None, None)), 2)
    want = {2: (Decimal("5.00"), "again"), 3: (Decimal("3.00"), "back")}
    assert table() == want
    log.compact(spark)
    log.compact(spark)
    assert table() == want and log.store.vacuum(spark, older_ms=-1000) >= 0 and table() == want
    for k in (2, 3):
        log.write(changelog(spark, ("-D", 0, k, None, None)), 1 + k)
    log.compact(spark)
    assert table() == {} and not log.store.manifest(spark)["tables"]["base"]["slots"]


def test_a_put_comes_after_a_retraction_of_the_same_order(spark, tmp_path):
    log = upserts.Upserts(f"{tmp_path}/u", ["id"])
    log.write(changelog(spark, ("+U", 0, 1, "2.00", "new"), ("-U", 0, 1, "1.00", "old")), 0)
    assert [r.name for r in log.table(spark, ROW).collect()] == ["new"]


def test_compaction_leaves_untouched_buckets(spark, tmp_path):
    log = upserts.Upserts(f"{tmp_path}/u", ["id"], buckets=8)
    log.write(changelog(spark, *(("+I", 0, k, "1.00", "x") for k in range(40))), 0)
    log.compact(spark)
    before = log.store.manifest(spark)["tables"]["base"]["slots"]
    log.write(changelog(spark, ("+U", 0, 5, "2.00", "y")), 1)
    log.compact(spark)
    after = log.store.manifest(spark)["tables"]["base"]["slots"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == len(after) == 8
    assert {r.id: r.name for r in log.table(spark, ROW).collect()} == {k: "y" if k == 5 else "x" for k in range(40)}
