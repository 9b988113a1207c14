"""Cutting lineage so that jobs survive lost executors.

Intermediate results go to the folder that ``spark.checkpoint.dir`` names, which all executors
share; only where that setting is missing and all executors are threads of this process (tests) a
folder of this machine is taken.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; sets the checkpoint directory where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table written once to the shared folder and read again; removed when Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint of ``df``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Removes the tables written so far, between two pieces of work of a long session: no frame made
    before may be used afterwards."""
    _remove()
    _written.clear()


def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; whoever made the folder removes it
            pass


atexit.register(_remove)
