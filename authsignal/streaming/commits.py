"""Tables that a stream writes exactly once: batches beside a log of committed batch numbers.

A micro-batch is written to a folder of its own attempt first. Then its number is committed by
moving a one-line file, which names that folder, to its final name; the move is the only step that
readers notice, and the store refuses it if the name is taken. A batch that is replayed finds its
number committed and changes nothing; one that stopped half-way left a folder that no reader looks at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

COMMITTED = "committed_batch"


def _files(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def committed(spark: SparkSession, folder: str) -> dict[int, str]:
    """Batch numbers and their folders: one short line for each batch of the stream."""
    store, path = _files(spark, f"{folder}/commits")
    if not store.exists(path):
        return {}
    found = {}
    names = [status.getPath() for status in store.listStatus(path) if not status.getPath().getName().startswith((".", "_"))]
    if names:
        for line in spark.read.text([name.toString() for name in names]).collect():
            number, attempt = line["value"].split(" ", 1)
            found[int(number)] = f"{folder}/data/{attempt}"
    return found


def write_batch(batch: DataFrame, number: int, folder: str) -> bool:
    """Write and commit one batch; False, and no change, if its number is committed already."""
    spark = batch.sparkSession
    store, final = _files(spark, f"{folder}/commits/{number}")
    if store.exists(final):
        return False
    attempt = f"batch-{number}-{uuid.uuid4().hex}"
    batch.write.parquet(f"{folder}/data/{attempt}")
    _, draft = _files(spark, f"{folder}/commits/.{attempt}")
    out = store.create(draft, False)
    out.write(bytearray(f"{number} {attempt}\n".encode()))
    out.close()
    moved = not store.exists(final) and store.rename(draft, final)
    if not moved:
        store.delete(draft, False)
    return bool(moved)


def committed_sink(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream into a committed table over what is there."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder) and None)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_committed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of committed batches, with the number of the batch."""
    batches = committed(spark, folder)
    numbered = T.StructType([*schema.fields, T.StructField(COMMITTED, T.LongType())])
    if not batches:
        return spark.createDataFrame([], numbered)
    number = F.regexp_extract(F.col("_metadata.file_path"), "/data/batch-([0-9]+)-", 1).cast("long")
    return spark.read.schema(schema).parquet(*batches.values()).select("*", number.alias(COMMITTED))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row that the last committed batch has for each key: what a stream in update mode stands for."""
    others = [c for c in rows.columns if c not in keys and c != COMMITTED]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), COMMITTED).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*[c for c in rows.columns if c != COMMITTED])
