"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir`` or the folder set as the context's checkpoint folder.

    Where neither is set, a session on this machine alone (tests) takes a temporary folder; on a cluster that is an
    error, for executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="marlstone-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/marlstone/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again.

    Fixes what would differ if it were computed twice, cuts the lineage and survives lost executors.
    """
    path = f"{shared_path(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
