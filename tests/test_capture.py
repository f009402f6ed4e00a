"""A snapshot of a database table in chunks while it is written to, then its log: nothing lost, nothing doubled."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import collected, streamed

from millrace.sources import capture

LOG = "seq bigint, op string, id bigint, v string"
URL, DRIVER = "jdbc:derby:memory:captured;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


class Database:
    """A Derby table with a log that every write goes to."""

    def __init__(self, spark):
        self.spark = spark
        spark._jvm.java.lang.Class.forName(DRIVER)
        self.con = spark._jvm.java.sql.DriverManager.getConnection(URL)
        for name in ("shop", "log"):
            try:
                self.run(f"DROP TABLE {name}")
            except Exception as e:
                assert "does not exist" in str(e)
        self.run("CREATE TABLE shop (id BIGINT PRIMARY KEY, v VARCHAR(40))")
        self.run("CREATE TABLE log (seq BIGINT PRIMARY KEY, op VARCHAR(1), id BIGINT, v VARCHAR(40))")
        self.rows, self.seq = {}, 0

    def run(self, sql):
        st = self.con.createStatement()
        st.execute(sql)
        st.close()

    def write(self, i, v):
        op = "d" if v is None else "u" if i in self.rows else "c"
        if op == "d" and i not in self.rows:
            return
        self.seq += 1
        self.run(f"DELETE FROM shop WHERE id = {i}")
        if v is None:
            del self.rows[i]
        else:
            self.run(f"INSERT INTO shop VALUES ({i}, '{v}')")
            self.rows[i] = v
        self.run(f"INSERT INTO log VALUES ({self.seq}, '{op}', {i}, {'NULL' if v is None else repr(v)})")

    def read(self, a, b):
        return self.query(f"SELECT id AS \"id\", v AS \"v\" FROM shop WHERE id >= {a} AND id < {b}")

    def query(self, sql):
        return self.spark.read.format("jdbc").options(url=URL, driver=DRIVER, query=sql).load()

    def log(self):
        return self.query('SELECT seq AS "seq", op AS "op", id AS "id", v AS "v" FROM log')


def applied(initial, following):
    """The table that the records leave, and checks that each makes sense in turn."""
    rows = {}
    for r in initial:
        assert r.op == "r" and r.id not in rows
        rows[r.id] = r.v
    assert len({r.seq for r in following}) == len(following)
    for r in sorted(following, key=lambda r: r.seq):
        assert (r.op == "c") == (r.id not in rows), r  # nothing is created twice, or changed before it is there
        if r.op == "d":
            del rows[r.id]
        else:
            rows[r.id] = r.v
    return rows


@pytest.fixture
def database(spark):
    base = Database(spark)
    for k in range(40):
        base.write(k, f"first {k}")
    return base


def test_writes_during_the_snapshot(spark, tmp_path, database):
    rng = random.Random(4)
    took = capture.Capture(f"{tmp_path}/cap", "id", ["v"], 0, 39, 9)

    def busy(times):
        for _ in range(times):
            database.write(rng.randint(0, 45), None if rng.random() < 0.3 else f"new {rng.randint(0, 99)}")

    def read(a, b):
        busy(6)  # after the low position, before the read
        rows = spark.createDataFrame(database.read(a, b).collect(), "id bigint, v string")
        busy(6)  # after the read, before the high position
        return rows

    assert took.snapshot(spark, read, lambda: database.seq) == 5
    busy(15)
    log = database.log()
    bounds = took.store.table(spark, "bounds").collect()
    assert all(b.high > b.low for b in bounds) and log.where("op = 'd'").count() > 5
    initial, following = took.initial(spark, log).collect(), took.following(spark, log).collect()
    assert applied(initial, following) == database.rows
    everything = {r.seq for r in log.collect()}
    assert {r.seq for r in following} < everything
    # the same in a stream of the log, some of it after the snapshot
    rows = sorted((tuple(r) for r in log.select("seq", "op", "id", "v").collect()))
    stream = took.following(spark, streamed(spark, tmp_path, [rows[: len(rows) // 2], rows[len(rows) // 2 :]], LOG))
    assert sorted(map(tuple, collected(spark, stream, tmp_path, "captured"))) == sorted(map(tuple, following))


def test_a_stopped_snapshot_goes_on(spark, tmp_path, database):
    took = capture.Capture(f"{tmp_path}/cap", "id", ["v"], 0, 39, 10)

    def read(a, b):
        if a == 20 and not database.rows.get("stopped"):
            database.rows["stopped"] = True
            raise OSError("lost")
        return database.read(a, b)

    with pytest.raises(OSError):
        took.snapshot(spark, read, lambda: database.seq)
    database.rows.pop("stopped")
    database.write(3, "later")
    database.write(25, "in a chunk to come")
    again = capture.Capture(f"{tmp_path}/cap", "id", ["v"], 0, 39, 10)
    assert again.snapshot(spark, database.read, lambda: database.seq) == 2 and again.snapshot(spark, database.read, lambda: database.seq) == 0
    log = database.log()
    assert applied(again.initial(spark, log).collect(), again.following(spark, log).collect()) == database.rows
    assert [r.id for r in again.following(spark, log).collect()] == [3]


def test_an_empty_table(spark, tmp_path):
    took = capture.Capture(f"{tmp_path}/cap", "id", ["v"], 0, -1, 10)
    assert took.snapshot(spark, lambda a, b: None, lambda: 0) == 0
    log = spark.createDataFrame([(1, "c", 5, "x")], LOG)
    assert took.initial(spark, log).collect() == [] and [(r.op, r.id) for r in took.following(spark, log).collect()] == [("c", 5)]
    assert took.following(spark, log.where(F.lit(False))).collect() == []
