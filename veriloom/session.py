"""Sessions with the settings that the engine's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a row costs much more time than bytes here, so small tables keep their tasks; large ones never reach it
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


def session(app: str = "veriloom", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | conf).getOrCreate()
