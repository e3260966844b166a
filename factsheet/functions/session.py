"""Session facts that operators need: the shared staging folder and small-input spreading."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_INPUT_BYTES = 1 << 30


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="factsheet-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    A session that names none gets a temporary folder if it runs in one process, and an error on a cluster,
    where a folder of one machine would lose what other machines write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = _local_folder()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; ``clear_staging`` removes what was staged."""
    return f"{shared_folder(spark)}/factsheet/{name}-{uuid.uuid4().hex}"


def clear_staging(spark: SparkSession) -> bool:
    """Remove everything staged below the shared folder; frames read from it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/factsheet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends at durable files."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input over all cores before work that is heavy per row.

    A file with one row group arrives in one task however many cores there are. Large
    inputs already come in many splits and keep them: no shuffle is added there.
    """
    if estimated_bytes(df) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
