"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a new temporary folder is used on a single machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise EngineError("storage.folder", "spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: a table written to the shared folder, which any executor can read again."""
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small table of one row group would else be read, and worked on, by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more rows than that."""
    return df.limit(rows + 1).count() <= rows
