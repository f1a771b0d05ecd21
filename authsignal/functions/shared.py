"""Intermediate tables kept in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is named, a cluster raises, since a machine's own folder would not be seen by the
    others; only a single-machine master, as in tests, gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not single_machine(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="authsignal-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table once and read it back: lineage is cut and Catalyst knows its size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` once nothing reads them any more."""
    folder = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for parent in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if folder not in parent:
                raise ValueError(f"{parent} is not in the shared folder")
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def replace_folder(spark: SparkSession, new: str, old: str) -> None:
    """Put one folder of the shared folder in another's place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(path(old), True)
    if not store.rename(path(new), path(old)):
        raise OSError(f"{new} could not be moved to {old}")
