"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}

# Settings that fit any cluster size; partition counts are left to AQE.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Rows of the largest table for each shuffle partition.
ROWS_PER_PARTITION = 100_000
#: Rows of the largest table that a scan reads in one task.
ROWS_PER_SCAN = 1_000_000
#: Spark's own bytes for a scan task, and how many empty files fill it.
SCAN_BYTES, SCAN_FILES = 128 << 20, 32
#: Bytes up to which adaptive execution merges small partitions.
SMALL_PARTITION = "16k"


def build_session(app_name: str = "stampcard", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread_by_rows(spark: SparkSession, rows: int, row_bytes: float | None = None) -> None:
    """Shuffles of this session get a partition for every ``ROWS_PER_PARTITION`` rows, however well these compress; scans a task for every
    ``ROWS_PER_SCAN`` rows of ``row_bytes`` in a file.

    Adaptive execution merges partitions by their compressed bytes. States and sends repeat themselves so much that a million rows take a megabyte, so
    without this the rows of a task, and its memory, grow with the input. Scans are cut by bytes too, and what a task writes to a shuffle is held by row.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION))
    for name, value in (("initialPartitionNum", parts), ("minPartitionNum", parts), ("minPartitionSize", SMALL_PARTITION)):
        spark.conf.set(f"spark.sql.adaptive.coalescePartitions.{name}", value)
    if row_bytes:
        size = min(SCAN_BYTES, max(SCAN_FILES, int(row_bytes * ROWS_PER_SCAN)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size // SCAN_FILES)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir``, else one of our own in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="stampcard-", ignore_cleanup_errors=True)
    return _local_folders[app].name


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's stored tables; call it when their readers are done."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The written files survive lost executors and give later readers column pruning and, with
    ``partition_by``, partition pruning.
    """
    from stampcard.sources.sinks import write_parquet

    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path, partition_by=partition_by)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored.select(*df.columns)
