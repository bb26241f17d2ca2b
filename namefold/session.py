"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Partition counts and join strategies are fixed at run time, from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Hot keys of joins are split even where that costs another shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
CLUSTER_SETTINGS = {
    **SETTINGS,
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def configure(builder: SparkSession.Builder, settings: dict[str, str] = SETTINGS) -> SparkSession.Builder:
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder
