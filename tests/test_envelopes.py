"""Queries over raw records parse the log once: their joins read kept records, not the tables and the JSON text again."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace import catalogue
from millrace.plans import envelopes


def test_the_log_is_parsed_once(spark):
    for name in ("order_details_from_log", "order_cancel_within"):
        found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "jsontostructs" not in plan.lower() and not any("lineitem" in f for f in found.inputFiles())
        assert found.count() > 0


def test_records_are_the_texts_that_to_json_writes(spark):
    rows = spark.createDataFrame([(1, "2", 3, 4), (None, "2", 3, 4), (1, None, 3, 4), (1, "2", None, 4), (1, "2", 3, None)], "a int, b string, ts int, o int")
    old = F.when(F.col("o").isNotNull(), F.create_map(F.lit("b"), F.col("o").cast("string")))
    for more in (None, old):
        found = envelopes._record("t", "insert", F.col("ts"), F.lit(False), more, a=F.col("a"), b=F.col("b"))
        data = F.create_map(F.lit("a"), F.col("a").cast("string"), F.lit("b"), F.col("b"))
        parts = [F.lit("shop").alias("database"), F.lit("t").alias("table"), F.lit("insert").alias("type"), F.col("ts").cast("bigint").alias("ts"), data.alias("data")]
        want = F.to_json(F.struct(*parts, *([] if more is None else [more.alias("old")])))
        assert all(a == b for a, b in rows.select(found, want).collect())


def test_kept_records_are_written_plainly(spark):
    """Dictionaries and bounds of texts that hardly repeat were half of the write; the session's settings come back."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    found = envelopes._log(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(name, None) == before
    files = {f.removeprefix("file://") for f in found.inputFiles()}
    assert {f.split("/table=")[1].split("/")[0] for f in files} == {"order_info", "order_detail", "order_detail_activity", "order_detail_coupon"}
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = [group.column(k) for k in range(group.num_columns)]
        assert not any(c.has_dictionary_page or (c.statistics is not None and c.statistics.has_min_max) for c in columns)
