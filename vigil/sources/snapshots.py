"""Stored tables that change in one step: rows go to a folder of the run, a commit names the runs that hold.

    root/data/<table>/run=<run>/...    rows of one run, never changed afterwards
    root/manifests/<run>/              (name, run, entity_id): which runs hold for which entities after the run
    root/commits/<number>              a file with the run whose manifest holds from then on

Readers follow the commit of the highest number, so a run that fails before its last step leaves no trace, and all
tables of a run change together.  The last step renames a file to the next number, which fails if another run was
faster: that run's rows stay, and the loser can be run again.  Where renaming is not atomic (some object stores), only one
writer at a time is safe.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import cut_lineage

MANIFEST = "name string, run string, entity_id string"


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


@dataclass(frozen=True)
class Change:
    """New rows of a table, and whose stored rows they stand for.

    `replaced` (entity_id) are the entities that the run has looked at: their former rows go, also those of entities
    without new rows.  Without it, the rows are added to what is there.
    """

    rows: DataFrame
    replaced: DataFrame | None = None
    partition_by: tuple[str, ...] = field(default=("entity_id",))


def _files(spark: SparkSession):
    fs = spark._jvm.org.apache.hadoop.fs
    return fs, spark._jsc.hadoopConfiguration()


def last_commit(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number of the last commit (0: none), and its run."""
    fs, conf = _files(spark)
    folder = fs.Path(f"{root}/commits")
    system = folder.getFileSystem(conf)
    if not system.exists(folder):
        return 0, None
    done = max((s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().isdigit()), default=None)
    if done is None:
        return 0, None
    stream = system.open(fs.Path(folder, done))
    try:
        return int(done), spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, run, entity_id): the runs that hold; a null entity stands for all rows of the run."""
    _, run = last_commit(spark, root)
    if run is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{run}")


def publish(spark: SparkSession, root: str, number: int, run: str) -> None:
    """The step that makes a run hold: its commit takes the next number."""
    fs, conf = _files(spark)
    folder = fs.Path(f"{root}/commits")
    system = folder.getFileSystem(conf)
    system.mkdirs(folder)
    draft, final = fs.Path(folder, f".{run}"), fs.Path(folder, f"{number:010d}")
    stream = system.create(draft)
    stream.write(run.encode())
    stream.close()
    never_over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        fs.FileContext.getFileContext(folder.toUri(), conf).rename(draft, final, never_over)
    except Py4JJavaError as error:
        if system.exists(final):
            raise Conflict(f"commit {number} of {root} is taken") from error
        raise


def commit(root: str, changes: dict[str, Change]) -> None:
    """Write the changes of several tables and make them hold together."""
    spark = next(iter(changes.values())).rows.sparkSession
    number, _ = last_commit(spark, root)
    run = uuid.uuid4().hex
    kept = manifest(spark, root)
    for name, change in changes.items():
        # towards the partitions of the output; adaptive execution splits the large ones
        rows = change.rows.hint("rebalance", *change.partition_by) if change.partition_by else change.rows
        rows.write.partitionBy(*change.partition_by).parquet(f"{root}/data/{name}/run={run}")
        new = spark.createDataFrame([(name, run, None)], MANIFEST)
        if change.replaced is not None:
            gone = change.replaced.select(F.lit(name).alias("name"), F.col("entity_id").cast("string").alias("entity_id")).distinct()
            kept = kept.join(gone, ["name", "entity_id"], "left_anti").select("name", "run", "entity_id")
            # a row for each entity that the run has looked at, as later runs replace them one by one
            new = gone.select("name", F.lit(run).alias("run"), "entity_id")
        kept = cut_lineage(kept.unionByName(new))
    kept.write.parquet(f"{root}/manifests/{run}")
    publish(spark, root, number + 1, run)


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table that hold; `schema` names its columns (entity_id among them if rows were replaced)."""
    held = cut_lineage(manifest(spark, root).where(F.col("name") == name).drop("name"))
    if held.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, run string").parquet(f"{root}/data/{name}")
    whole = held.where("entity_id is null").select("run")
    out = rows.join(whole, "run", "left_semi")
    if "entity_id" in rows.columns:
        out = out.unionByName(rows.join(held.where("entity_id is not null"), ["run", "entity_id"], "left_semi"))
    return out.select(*[c for c in rows.columns if c != "run"])
