"""Tables that loops write to the shared folder, each round reading what the last one wrote.

A checkpoint keeps the estimated size of its plan, which joins multiply: after some rounds of a
loop these estimates alone take minutes.  A written table has the size of its files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = 16 << 20  # bytes of files of a table that is broadcast


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share."""
    place = spark.sparkContext._jsc.sc().getCheckpointDir()
    if place.isEmpty():
        raise RuntimeError("set a checkpoint folder that the driver and all executors share")
    return place.get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table of their own."""
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``written``."""
    remove(df.sparkSession, df.inputFiles())


def remove(spark: SparkSession, files: list[str]) -> None:
    """Delete the folders of files."""
    for place in {f.rsplit("/", 1)[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(files: list[str], columns: list[str], size: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The rows of a written table's files, for tasks that stream past a whole table."""
    for file in files:
        fs, own = pa.fs.FileSystem.from_uri(file)
        with fs.open_input_file(own) as f:
            yield from pa.parquet.ParquetFile(f).iter_batches(batch_size=size, columns=columns)


def join_written(rows: DataFrame, table: DataFrame, key: str, tasks: int) -> DataFrame:
    """Inner join with columns of a table from ``written``: it is broadcast if its files are small, else the rows are dealt to ``tasks``."""
    spark, size = table.sparkSession, 0
    for place in table.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return rows.join(F.broadcast(table), key) if size <= LISTED else rows.repartition(tasks, key).join(table, key)
