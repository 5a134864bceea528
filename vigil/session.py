"""Session set-up. Everything time-related assumes a UTC session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# every key here can be set on a running session
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # payload merges follow "the later source wins"
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # folders are listed by so many tasks at most; the default has one for each of 10,000 folders
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # reruns replace only the partitions they produce
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

BUILD_CONF = {
    # static: recording a call site per column expression dominates the building of long expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoint files go when the frames they belong to are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(app_name: str = "vigil", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session. On a cluster, leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BUILD_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's own setting, or a scratch folder in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="vigil-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps iterative plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Set while `settled` writes: what a statement has shuffled goes when it has ended, not when the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables that are dropped at the end of each open `scratch` block.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that `stored` makes inside when the block has ended; those with `keep` are left to the block around it.

    Nothing that is evaluated later may read them.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """The rows of df, written once as compressed columns beside the checkpoints and read from there."""
    path = _new_path(df.sparkSession, label, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(parts: DataFrame | Iterable[DataFrame], label: str, keep: bool = False, by: str | None = None) -> DataFrame:
    """Like `stored`, in less space: frames of the same columns are written one after the other, in zstd, and what each has
    shuffled is freed before the next.  With `by`, that column's values have a folder each."""
    path, schema = None, None
    for df in [parts] if isinstance(parts, DataFrame) else parts:
        spark = df.sparkSession
        path, schema = path or _new_path(spark, label, keep), schema or df.schema
        before = spark.conf.get(FREED, None)
        spark.conf.set(FREED, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(schema).parquet(path)


def _new_path(spark: SparkSession, label: str, keep: bool) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    open_blocks = _SCRATCH[:-1] if keep else _SCRATCH
    if open_blocks:
        open_blocks[-1].append(path)
    return path


#: Rows of heavy work that are one task's share, where their number is known.
ROWS_A_TASK = 100_000


def spread(df: DataFrame, rows: int = 0) -> DataFrame:
    """Give heavy per-row work a task per core where the scan has fewer: few or unsplittable files.

    If the number of rows is given, there are as many tasks as keep each to its share, so that none grows with the input.
    A large input has more splits than that and is returned as it is, without a shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
