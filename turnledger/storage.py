"""Where a job may stage data that has to outlive an executor."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder of the session, for checkpoints and staged tables.

    It is whatever `spark.checkpoint.dir` names, or the directory set on the context, or
    else a folder of this application below the warehouse, which all executors share like
    any table. That last folder is removed when the application ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = f"{warehouse}/_staged-{sc.applicationId}"
        atexit.register(_remove, spark, configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        folder.getFileSystem(conf).delete(folder, True)
    except (Py4JError, OSError, AttributeError):
        pass  # the session has been stopped before


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created or replaced."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none for a folder that is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(folder))


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, also where there is one already."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(file, True).close()
