"""Session settings and the shared scratch folder in which lineage is cut."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, from ``spark.checkpoint.dir``.

    Only where the setting is absent and all executors share this machine a
    local temporary folder is made; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sessionloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _OWN.append((files, where))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, and the files are compressed
    and prunable; the result no longer depends on executors or shuffle files.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for files, where in _OWN:
        try:
            files.delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def partitions_for(rows: int, each: int, least: int = 1) -> int:
    """Number of partitions that keeps each at about ``each`` rows."""
    return max(least, math.ceil(rows / each))
