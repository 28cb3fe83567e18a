"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
#: A side of a join that takes more than this is shuffled, not sent to every task.
BROADCAST_BYTES = 24 << 20
#: Arrow batches for Python workers are at most so large where the session sets nothing or Spark's own default: a worker
#: and its executor hold some of them at a time, and a batch of long texts is large by bytes, not by rows.
ARROW_BYTES, ARROW_SETTING, ARROW_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
#: With this Spark drops shuffle files when a write ends, else when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes in memory for a byte in a Parquet file, about: keys here are hashes and ids, which hardly compress.
EXPANSION = 2


def session(cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every operator assumes: UTC, AQE and Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(PACKAGE.name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, and bound the batches that they get.

    Workers import it by name, so module-level caches live as long as a worker does. Spark's own
    file server carries the archive; executors need no shared folder for it.
    """
    context = spark.sparkContext
    if spark.conf.get(ARROW_SETTING, None) in (None, f"{ARROW_DEFAULT}b", str(ARROW_DEFAULT), "64m", "64MB"):
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    if getattr(context, "_marlstone_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}-src.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._marlstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, the one place all executors share.

    Where the setting is missing, as in tests on one machine, a local folder stands in for it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        own = getattr(context, "_marlstone_shared", None)
        base = own or f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir=os.environ.get('TMPDIR'))}"
        context._marlstone_shared = base
    return f"{base.rstrip('/')}/{PACKAGE.name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors, leaves no shuffle files."""
    spark, folder = df.sparkSession, folder or shared_folder(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate table that nothing reads any more, to keep the shared folder small."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it takes at most most_bytes, else as it is, for a shuffled join.

    df must be stored: its size is that of its files, which Spark knows without a job.
    """
    files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if files * EXPANSION <= most_bytes else df
