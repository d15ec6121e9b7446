"""Tables and files of one job, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only local sessions may lack the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file:///tmp/spark-veriloom-{spark.sparkContext.applicationId}"
    return f"{shared}/veriloom/{name}-{uuid.uuid4().hex}"
