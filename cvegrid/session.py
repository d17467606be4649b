"""A Spark session with the settings the package is tested with."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


# HotSpot does not compile methods above 8,000 bytes of bytecode.  Stages whose fused code
# would be larger run faster as separately compiled expressions; set this on a cluster too.
CODE_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster the session comes from the submit command instead; nothing here sets a
    folder or a partition count that a cluster session would inherit.
    """
    # Python workers import this package, so they need the repository on their path.
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cvegrid")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config(*CODE_LIMIT)
        # Test tables are a few megabytes; keep their shuffles on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
