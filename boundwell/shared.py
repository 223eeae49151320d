"""The folder that all executors share, for tables and files of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: the one the cluster names in spark.checkpoint.dir.

    Where that setting is absent a local master (tests, a laptop) gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="boundwell-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{use_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4()}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or file of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
