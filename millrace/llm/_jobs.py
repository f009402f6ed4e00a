"""Small Spark helpers of the llm operators: tables, folds, samples and written intermediates."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of one Arrow batch between Spark and a Python worker, unless the session asks for fewer.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been bounded: an executor holds several of them outside its heap."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        have = str(conf.get(key, None) or 0).lower().removesuffix("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            conf.set(key, str(most))
    return df


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(function: Callable) -> Callable:
    """A function of Arrow batches after which the worker's freed memory goes back."""

    def run(batches):
        yield from function(batches)
        release()

    return run


def released_table(function: Callable) -> Callable:
    """The same for a function of one group's table."""

    def run(table):
        out = function(table)
        release()
        return out

    return run


def released_tables(function: Callable) -> Callable:
    """The same for a function of two groups' tables."""

    def run(left, right):
        out = function(left, right)
        release()
        return out

    return run


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{tempfile.gettempdir()}/millrace-checkpoints"
    return root.rstrip("/")


#: Lets Spark delete the shuffle files of a job that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back. Lost executors then cost no recomputation,
    and the job's shuffle files go as soon as it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` wrote for these frames; only files in the shared folder are touched."""
    for df in frames:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/millrace-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of text of a labelled sample, beside its bound on rows.
SAMPLE_BYTES = 128 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int, most: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label) outside the held-out fold, of at most ``most`` bytes. Written.

    The bound is taken on ``labels`` by a hash of doc_id, so it is the same set on every run; that bounded table
    is what is broadcast to the scan of the documents. Where the texts are too long together, rows go by the same hash.
    Labels that are null are not used; an id with several labels counts with its largest, one with several texts with
    the least of them.
    """
    keep = fold(F.col("doc_id"), modulus) != held_out
    few = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    sample = written(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    total = 0
    for place, size in sorted(tuple(r) for r in sample.select(F.xxhash64("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0))).collect()):
        total += size
        if total > most:
            return sample.where(F.xxhash64("doc_id") < place)
    return sample
