"""Tables that cut lineage, in the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder.  Where none is configured, one process on one
    machine makes its own; executors elsewhere would not see that, so it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="canopy-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/canopy/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_home(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write once to the shared folder and read again.  A lost executor cannot take
    the table with it, and plans that loop stay small.  ``instead_of`` is an earlier
    result of this function that nothing will read any more: its files go."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if instead_of is not None:
        delete(spark, instead_of._scratch_path)
    return out


def _store(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, store = _store(spark, path)
    return store.exists(hadoop)


def delete(spark: SparkSession, path: str) -> None:
    hadoop, store = _store(spark, path)
    store.delete(hadoop, True)


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this application.  Frames made from them can no
    longer be read: call it when results have been written."""
    delete(spark, _home(spark))
