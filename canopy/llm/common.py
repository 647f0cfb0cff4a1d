"""Helpers that the training-data operators share.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``;
nothing here uses a machine-local folder on a cluster.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import materialise, scratch_path

__all__ = ["BATCH_BYTES", "bounded_batches", "map_arrow", "materialise", "once", "scratch_path", "table"]

#: Rows and bytes of a Python batch, whichever is reached first; a batch holds a row at
#: least.  Every stage uses these same values: the settings count when a plan runs, not
#: when it is made, so a stage with bounds of its own would change those of others.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds before a Python stage starts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def once(key: tuple, make: Callable):
    """One value for each worker process and key: tokenizers and their tables of met
    chunks outlive a task.  What is kept must bound its own size."""
    store = sys.modules.setdefault("canopy_worker_values", types.ModuleType("canopy_worker_values")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
