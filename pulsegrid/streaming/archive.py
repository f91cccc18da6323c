"""An archive of full chunks, each written exactly once, as a foreachBatch sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkArchive:
    """Rows by chunk of write index (seq div chunk). A batch writes the chunks that are full with it as zstd Parquet, keeps the
    rows of the others for the next batch, and is committed by one rename of a manifest; what no manifest names is not part of
    the archive.

    So a batch that fails between write and commit leaves nothing behind that is read, and its replay writes the same places
    again; a replay of a committed batch does nothing. Rows that come for an archived chunk again are left out. At most one
    chunk for each gap in the write index waits. The archive lies in a folder that all executors reach.
    """

    def __init__(self, path: str, chunk: int = 1_000_000):
        self.path, self.chunk = path.rstrip("/"), chunk

    def _fs(self, spark: SparkSession):
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, spark: SparkSession) -> list[int]:
        """Numbers of the committed batches."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = self._fs(spark)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _commit(self, spark: SparkSession, batch: int, told: dict) -> None:
        """The batch counts from here on."""
        fs, at = self._fs(spark), spark._jvm.org.apache.hadoop.fs.Path
        draft = at(f"{self.path}/manifest/_{batch}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not fs.rename(draft, at(f"{self.path}/manifest/{batch}.json")):
            raise OSError(f"batch {batch} could not be committed")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = self._manifests(spark)
        if batch in done:
            return
        own = rows.withColumn("chunk_id", F.expr(f"seq div {self.chunk}"))
        before = max((b for b in done if b < batch), default=None)
        if before is not None:
            own = own.unionByName(spark.read.parquet(f"{self.path}/waiting/{before}"))
            archived = spark.read.schema("chunk_id long").json([f"{self.path}/chunks/{b}" for b in done if b < batch])
            own = own.join(archived, "chunk_id", "left_anti")
        own = own.dropDuplicates(["seq"])
        own.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/all/{batch}")
        held = spark.read.parquet(f"{self.path}/all/{batch}")
        full = held.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == self.chunk).select("chunk_id")
        ready = held.join(full, "chunk_id", "left_semi")
        ready.repartition("chunk_id").sortWithinPartitions("chunk_id", "seq").write.mode("overwrite").option("compression", "zstd").partitionBy("chunk_id").parquet(f"{self.path}/data/{batch}")
        held.join(full, "chunk_id", "left_anti").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/waiting/{batch}")
        full.coalesce(1).write.mode("overwrite").json(f"{self.path}/chunks/{batch}")
        self._commit(spark, batch, {"batch": batch})
        fs, at = self._fs(spark), spark._jvm.org.apache.hadoop.fs.Path
        for old in [f"all/{batch}", *([f"waiting/{before}"] if before is not None else [])]:
            fs.delete(at(f"{self.path}/{old}"), True)

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """The archived rows, of committed batches only; schema: that of the rows."""
        paths = [f"{self.path}/data/{b}" for b in self._manifests(spark)]
        fs, at = self._fs(spark), spark._jvm.org.apache.hadoop.fs.Path
        paths = [f"{p}/{f.getPath().getName()}" for p in paths for f in fs.listStatus(at(p)) if f.getPath().getName().startswith("chunk_id=")]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
