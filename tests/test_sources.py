"""The archive that writes each chunk once, event files as a data source, VARIANT, table functions."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import event_files, ingest, table_functions, tables
from pulsegrid.streaming import streams
from pulsegrid.streaming.archive import ChunkArchive

ROW = "seq long, ts_us long"


def add(spark, path, low, high):
    spark.range(low, high, 1, 1).selectExpr("id AS seq", "id * 10 AS ts_us").write.mode("append").parquet(path)


def start(spark, path, archive, check):
    q = streams.read_events(spark, path, ROW, 1).writeStream.foreachBatch(archive).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()


def test_archive_writes_each_full_chunk_once(spark, tmp_path):
    """A failure between write and commit, a restart, a replayed batch and repeated rows: each full chunk once, no partial one."""
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    archive = ChunkArchive(str(tmp_path / "out"), 100)
    add(spark, source, 0, 250)
    start(spark, source, archive, check)
    add(spark, source, 250, 420)

    class Failing(ChunkArchive):
        def _commit(self, *args):
            raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        start(spark, source, Failing(archive.path, 100), check)
    assert archive.read(spark, ROW).count() == 200  # what was written isn't part of the archive
    start(spark, source, archive, check)
    add(spark, source, 30, 60)  # rows that are archived already
    start(spark, source, archive, check)
    archive(spark.range(900, 1000).selectExpr("id AS seq", "id * 10 AS ts_us"), 1)  # a batch that was committed
    add(spark, source, 420, 600)
    start(spark, source, archive, check)
    got = archive.read(spark, ROW)
    assert sorted(r.seq for r in got.collect()) == list(range(600))
    assert got.where("ts_us != seq * 10").count() == 0


def batches(spark, sf):
    e = tables.events(spark, sf)
    return ingest.to_binary(e.select("seq", "ts_us", "duration_ms", "status_code", "trace_id"), "trace_id")


def events(df):
    return sorted((r.timestamp, r.duration_ms, r.status_code, r.is_error) for r in df.collect())


def test_event_files(spark, sf, tmp_path):
    """Read as a table and as a stream, files hold what from_binary gives; filters are pushed."""
    event_files.register(spark)
    own = batches(spark, sf)
    folder = str(tmp_path / "files")
    for i, part in enumerate([own.where("hash(batch_id) % 2 = 0"), own.where("hash(batch_id) % 2 != 0")]):
        part.select("body").write.format("event_batches").option("prefix", f"p{i}").mode("append").save(folder)
    expected = ingest.from_binary(own)
    read = spark.read.format("event_batches").load(folder)
    assert events(read) == events(expected)
    late = "timestamp >= 1704500000000000 AND status_code < 500 AND file LIKE 'p%'"
    assert events(read.where(late)) == events(expected.where("timestamp >= 1704500000000000 AND status_code < 500"))
    q = spark.readStream.format("event_batches").load(folder).writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert events(spark.table("files")) == events(expected)


def test_table_functions(spark, sf):
    table_functions.register(spark)
    own = batches(spark, sf).unionByName(spark.createDataFrame([("bad", bytearray(b"xx")), ("none", None)], "batch_id string, body binary"))
    out = spark.sql("SELECT * FROM decode_batches(TABLE({own}) PARTITION BY batch_id)", own=own.select("batch_id", "body"))
    assert events(out) == events(ingest.from_binary(own))
    with pytest.raises(Exception, match="batch_id and body"):
        spark.sql("SELECT * FROM decode_batches(TABLE(SELECT 1 AS x))")


def test_unknown_fields_survive(spark):
    """Unknown fields keep their types through a round trip; what isn't an object gives no row."""
    bodies = ['{"traceId": "t", "durationMs": "slow", "spanId": "s", "new": {"a": [1, 2.5, null]}, "flag": true}', "[1]", "no json", None, "{}"]
    v = ingest.from_json_variant(spark.createDataFrame([(b,) for b in bodies], "body string"))
    rows = v.withColumn("json", F.to_json("event")).drop("event").collect()
    assert len(rows) == 2 and rows[0].traceId == "t" and rows[0].durationMs is None and rows[0].spanId == "s"
    again = ingest.from_json_variant(spark.createDataFrame([(rows[0].json,)], "body string"))
    assert sorted((r.key, r.value) for r in ingest.unknown_fields(again).collect()) == [("flag", "true"), ("new", '{"a":[1,2.5,null]}')]
