"""Session set-up and the shared folder that intermediate results are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows handed to Python can be whole scripts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


PARTITION_BYTES = 256 * 1024 * 1024


def settings_for(input_bytes: int, partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Partition settings for jobs whose largest shuffle is about the size of the input.

    Adaptive execution merges shuffle partitions that turn out small, so the number may be generous.
    """
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(max(200, -(-input_bytes // partition_bytes))),
    }


def create_spark_session(
    app_name: str = "DataProcessingApp",
    *,
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Return the running session or start one; calling it again is harmless."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="custlytics-"))
    return spark.sparkContext.getCheckpointDir()


_scratch: list[str] = []
_tables: list[str] = []
_reused: list[DataFrame] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; :func:`clear_scratch` removes what was written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def reused(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """``df`` kept by the executors from its first use until :func:`release`, for input that several steps read.

    Parts that an executor loses, or that do not fit, are computed or read again. For results that must be
    the same each time use :func:`checkpointed` or :func:`stored`."""
    kept = df.persist(level)
    _reused.append(kept)
    return kept


def release() -> None:
    """Let go of everything that :func:`reused` kept; :func:`clear_scratch` does this too."""
    while _reused:
        _reused.pop().unpersist()


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh table name and a path for its files; :func:`clear_scratch` drops both."""
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    _tables.append(table)
    return table, path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet below the shared folder and read from there.

    Like :func:`checkpointed`, but the rows are computed once (a checkpoint counts them first), only the columns
    in use are read, and the size of the files is known, so that small tables are broadcast without a shuffle.
    The files stay until :func:`forget` or :func:`clear_scratch`."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`stored` gave and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Release what is kept, drop the scratch tables and delete everything below the scratch paths given out so far.

    For the end of a job: frames that read from these paths can no longer be computed."""
    release()
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _scratch:
        _delete(spark, _scratch.pop())


#: Scripts in one batch for Python: what a worker holds at once does not grow with its partition.
SCRIPT_ROWS = 128


def script_batches(spark: SparkSession) -> None:
    """Set the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` down to ``SCRIPT_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= SCRIPT_ROWS:
        spark.conf.set(key, str(SCRIPT_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Used where a plan is read more than once and must give the same rows each time (partition
    numbers after a range repartition, rounds of an iteration), also when executors are lost.
    """
    shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
