"""Helpers of the corpus operators: tables, stored intermediates, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

#: Rows up to which a side of a join may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: The same for rows of one whole-number id, of which 4 million are 32 MB.
BROADCAST_IDS = 4_000_000


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(shared_file(spark, "package", ".zip", made.getvalue()))
        _SHIPPED.add(context.applicationId)


def shared_file(spark: SparkSession, label: str, ending: str, data: bytes) -> str:
    """Write a small file into the shared folder; gives its path."""
    path = shared_path(spark, label) + ending
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(data)
    finally:
        stream.close()
    return path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Paths of the tables that are dropped at the end of each open `scratch` block.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that `stored` makes inside, but those with `keep`, when the block has ended.

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
    """The rows of df, written once as a table in the shared folder and read from there.

    Cuts the lineage: a lost executor costs no recomputation of what lies before.
    """
    path = shared_path(df.sparkSession, label)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `bound` (narrow) rows; else a shuffle join is planned.

    df must be stored or checkpointed, since it is counted here.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= bound else df


#: What lets go of the memory that an operator keeps in a worker from task to task.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    """Called by tasks of operators that don't need what others keep: a worker serves one stage after another."""
    if KEPT:
        for clear in KEPT:
            clear()
        KEPT.clear()
        release()


def release() -> None:
    """Hand memory that nothing uses back to the system: a worker otherwise keeps what former stages took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `size` bytes of text; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of largest count `n` (at least 1): all from the least of 32 steps an octave that leaves at most `size`."""
    step = F.floor(F.log2("n") * 32)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in steps:
        total += row["rows"]
        if total > size:
            break
        least = row["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)
