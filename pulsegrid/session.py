"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "_pulsegrid_shipped"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, name: str = "pulsegrid") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per context)."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    archive = Path(tempfile.mkdtemp(prefix="pulsegrid-")) / "pulsegrid_dist.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, f"{_PACKAGE.name}/{path.relative_to(_PACKAGE)}")
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-pulsegrid-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def temporary_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/pulsegrid-{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors. The table goes when the
    driver ends."""
    spark = df.sparkSession
    path = temporary_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
