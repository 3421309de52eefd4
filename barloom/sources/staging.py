"""Tables that are written once and read back: they cut lineage, so what several steps read is computed once.

A run keeps them in one folder of its own, which goes when the driver's program ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_RUN = uuid.uuid4().hex
_folders: dict[str, object] = {}


def run_folder(spark: SparkSession) -> str:
    """The folder of this run below the shared one. It is deleted when the program ends, also after a failure."""
    path = f"{shared_folder(spark)}/barloom/run-{_RUN}"
    if path not in _folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        _folders[path] = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
    return path


@atexit.register
def clear() -> None:
    """Deletes what this run has staged. Nothing that was read from it can be read after that."""
    while _folders:
        system, place = _folders.popitem()[1]
        with contextlib.suppress(Exception):  # the Java side may be gone already
            system.delete(place, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the run's folder and read back."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
