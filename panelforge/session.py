"""Session set-up: the few SQL settings the plans rely on."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches of long texts stay small, in the workers as in the executors and where they are read.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "1048576",
              "spark.sql.parquet.columnarReaderBatchSize": "512"}
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A panel that is already hash-partitioned by Code can be joined on (Code, Date)
    # without another exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **ARROW_CONF,
    # Brokerage exports come in shift_jis, outside the default list of charsets.
    "spark.sql.legacy.javaCharsets": "true",
}


#: Rows of the stock panel, and lines of the trade tables, that one task sorts or groups. A task's memory follows from
#: these, whatever the size of the input.
PANEL_ROWS, LINE_ROWS = 500_000, 250_000
#: Bytes of a file, and of a shuffle whose partitions are merged, that one task reads at most.
TASK_BYTES = 16 << 20
#: Rows up to which a table that was counted travels to every task of a join.
SMALL_ROWS = 1 << 18
#: Whether a write removes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BYTES_CONF = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


def in_bytes(size: str) -> int:
    """A size as Spark's settings write it: a number with or without a unit (b, k, kb, kib, up to p)."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def smaller_tasks(spark: SparkSession) -> None:
    """Let no task read more than TASK_BYTES of a file or of merged partitions; settings are lowered, never raised."""
    for key in BYTES_CONF:
        if in_bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))


def panel_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of a panel of about ``rows`` rows: one for PANEL_ROWS, or those of the session where they are not too small for that."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / PANEL_ROWS), min(wanted, math.ceil(rows * 10 / PANEL_ROWS)))


def more_partitions(spark: SparkSession, rows: int) -> None:
    """Let shuffles deal ``rows`` lines to tasks of LINE_ROWS: the session's number is raised, never lowered; small ones are merged anyway."""
    if math.ceil(rows / LINE_ROWS) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(math.ceil(rows / LINE_ROWS)))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Hash partitions by ``keys``, ``parts`` of them or the session's number."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else built, and give its workers this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    smaller_tasks(spark)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once a session: they do not inherit the driver's import path."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    root = Path(__file__).resolve().parent
    if spark.conf.get("panelforge.shipped", None) != str(root):
        target = Path(tempfile.mkdtemp(prefix="panelforge-")) / "panelforge_sources.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(str(target))
        spark.conf.set("panelforge.shipped", str(root))
    return spark


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "panelforge") -> SparkSession:
    """Single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="panelforge-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it again.

    Cuts the lineage: a lost executor costs neither the result nor its inputs.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here remove their shuffle files at their end, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage_tight(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for large tables: packed tighter, and nothing is left of the shuffles behind it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """``stage_tight`` in ``parts`` buckets of ``key``: later joins, windows and groups by the key need no exchange.

    Rows that are hash-partitioned by the key into as many partitions become one file a bucket.
    """
    spark = df.sparkSession
    token = f"{name}-{uuid.uuid4().hex}"
    table = token.replace("-", "_")
    with shuffles_dropped(spark):
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{token}")
        writer.bucketBy(parts, key).saveAsTable(table)
    return spark.table(table)


def small(df: DataFrame) -> DataFrame:
    """A table that is read cheaply: it travels to every task when its counted rows allow, otherwise joins stay as they are."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def reuse(df: DataFrame) -> DataFrame:
    """Keep a sector-level panel that several jobs of one fit read.

    Blocks spill to disk, and a lost executor's blocks are recomputed from lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
