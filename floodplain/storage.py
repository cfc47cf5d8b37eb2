"""The folder that a cluster shares, for what has to outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on one machine (as in tests) a new one; on a cluster it is an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='floodplain-')}"
        context.setCheckpointDir(path)
        return context._jsc.sc().getCheckpointDir().get()
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/floodplain/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
