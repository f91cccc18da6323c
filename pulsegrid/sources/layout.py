"""Tables written so that lookups read little: buckets by trace with bloom filters, and files ranged by write index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket and of a file of a range, about.
BUCKET_ROWS, RANGE_ROWS = 4_000_000, 4_000_000
#: A trace with so many times a bucket's share of rows is written by several tasks.
HEAVY = 4
#: Bytes of a row group: what a lookup inside a file reads at least.
GROUP_BYTES = 16 << 20


def write_by_trace(spans: DataFrame, path: str, buckets: int | None = None, name: str | None = None) -> str:
    """Spans as an external table, bucketed by trace_id and sorted by trace_id and seq, with a Parquet bloom filter on trace_id
    and on span_id; its name. Each bucket is written by one task, a heavy trace by several, in files of its bucket."""
    spark = spans.sparkSession
    rows = spans.count()
    buckets = buckets or max(8, -(-rows // BUCKET_ROWS))
    name = name or f"spans_{uuid.uuid4().hex}"
    bucket = F.pmod(F.hash("trace_id"), F.lit(buckets))
    heavy = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, HEAVY * rows // buckets)).select("trace_id", F.lit(True).alias("_heavy"))
    # at most buckets / HEAVY traces are heavy
    met = spans.join(F.broadcast(heavy), "trace_id", "left")
    part = bucket + F.when(F.col("_heavy"), F.pmod(F.xxhash64("seq"), F.lit(HEAVY)).cast("int")).otherwise(0) * buckets
    dealt = met.withColumn("_part", part).repartitionById(buckets * HEAVY, "_part").drop("_part", "_heavy").sortWithinPartitions("trace_id", "seq")
    writer = dealt.write.mode("overwrite").format("parquet").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES)
    for c in ("trace_id", "span_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.bucketBy(buckets, "trace_id").sortBy("trace_id", "seq").option("path", path).saveAsTable(name)
    return name


def trace(spark: SparkSession, table: str, trace_id: str) -> DataFrame:
    """The spans of a trace: one bucket is read, and in it the row groups that may hold it."""
    return spark.table(table).where(F.col("trace_id") == trace_id)


def write_by_index(events: DataFrame, path: str, rows_a_file: int = RANGE_ROWS) -> None:
    """Events in files ranged by write index and sorted by it, so that a range of it prunes files and row groups by their least
    and largest value."""
    files = max(1, -(-events.count() // rows_a_file))
    events.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)


def index_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Events with low <= seq < high."""
    return spark.read.parquet(path).where((F.col("seq") >= low) & (F.col("seq") < high))
